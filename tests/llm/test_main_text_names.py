"""Names that look like menus or adverts inside an article."""

import time

import pytest

from seqaudit.llm import main_text


@pytest.mark.parametrize("inner, want", [
    ("<h2 id='related-work'>Related work</h2><p>Body.</p>", "Related work\nBody."),
    ("<section id='search-algorithms'><p>Trees.</p></section>", "Trees."), ("<div id='social-history'><p>Old.</p></div>", "Old."),
    ("<h2 class='search'>Search</h2><p>x</p>", "Search\nx"),
    ("<pre><span class='hljs-comment'># x</span> code</pre>", "# x code"), ("<pre><span class='token comment'># x</span> code</pre>", "# x code"),
    ("<p>One <span class='ad'>buy now</span> two.</p>", "One two."), ("<p><span class='ad'>buy</span> One two.</p>", "One two."),
    ("<p>a</p><div class='ad-banner'>buy</div><p>b</p>", "a\nb"), ("<p>a</p><div role='search'>find</div><p>b</p>", "a\nb")])
def test_article_text(inner, want):
    page = f"<body><nav>Home</nav><article><p>Start of it.</p>{inner}</article><footer>f</footer></body>"
    assert main_text.extract(page, main_text.weights({})) == "Start of it.\n" + want


WEIGHTS = main_text.weights({})
CONTAINERS = ("comment-list user-comments post-comments comments-area comment-body reader-comments ad-slot ad-container advert-box promo-box "
              "cookie-bar site-notice newsletter-box share-buttons related-posts sidebar-left main-nav site-footer cookie-notice social-share").split()


@pytest.mark.parametrize("name", CONTAINERS)
@pytest.mark.parametrize("before, after", [("<article><p>Start of a text.</p>", "</article>"), ("<p>Start of a text.</p>", "")])
def test_containers_are_no_text(name, before, after):
    page = f"<body>{before}<div class='{name}'><p>Buy this now and more words here.</p></div>{after}</body>"
    assert main_text.extract(page, WEIGHTS) == "Start of a text."


@pytest.mark.parametrize("name", ["related-work", "search-algorithms", "social-history", "post-body", "main-content", "sharecropping", "menu-planning"])
def test_topics_stay(name):
    page = f"<body><article><p>Start.</p><div class='{name}'><p>Trees grow here.</p></div></article></body>"
    assert main_text.extract(page, WEIGHTS) == "Start.\nTrees grow here."


@pytest.mark.parametrize("inner, want", [
    ("<p>Let <math><mi>x</mi></math> be</p>", "Let x be"), ("<object>Fallback text.</object><p>z</p>", "Fallback text.\nz"),
    ("<p>a <select><option>o</p><p>after it</p>", "a\nafter it"), ("<p>a</p><iframe src='x'><p>lost</p><p>b</p>", "a\nb"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>a <b>bold</p><p>b</p>", "a bold\nb")])
def test_nothing_else_is_lost(inner, want):
    assert main_text.extract(f"<body><article>{inner}</article></body>", WEIGHTS) == want


N = 100_000
LONG = {
    "open tags": "<a" * N, "one long name": "<" + "a" * N, "nested": "<div>w " * N, "marks": "<!" * N, "less": "<" * N, "raw": "<svg>" * N,
    "quotes": "<a '>'" * N + '"', "unmatched ends": "<div>" * N + "</p>" * N, "unmatched inline": "<i><div>" + "<b>" * N + "</i>" * N,
    "distinct classes": "".join(f"<div class=c{k}>w " for k in range(N)), "lists": "<ul><li>" * N + "x", "attributes": "<a " + "class='x " * N + ">",
    "comments": "<!--" * N, "entities": "&amp" * N, "dashes": "<div class='" + "ad-" * N + "x'>y", "script": "<script></scrip" * N + ">",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_markup_takes_linear_time(kind):
    def took(text):
        start = time.process_time()
        main_text.extract(text, WEIGHTS)
        main_text.label_counts(text)
        return time.process_time() - start

    assert took(LONG[kind]) < 10  # a second or two each; the former scanner took hours
