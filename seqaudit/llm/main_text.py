"""Main text of web pages as a maximum-scoring subsequence.

A page is read once into blocks of words and the tags between them. Words score by their
surroundings (the open elements and their class names), positive in an article's
surroundings and negative in those of menus, adverts and footers; every tag costs. One
linear scan (Kadane) finds the contiguous region with the highest sum, and a final check
drops the blocks inside it that lie in an element which is never content.

Weights are log odds learned from labelled pages: those with exactly one ``article`` (or,
without any, one ``main``) element, whose words are inside or outside of it. About
``SAMPLE`` pages are read for that, chosen by a hash of the row; fixed pseudo-counts for
the usual element and class names stand in where the sample says nothing. Pages without
such an element are scored by the same weights.

Defined results. A null or empty page, or one without a word, has an empty text. Broken
markup never fails: unclosed elements end with their parent, an unclosed comment or
script ends the page, a lone ``<`` is text. Blocks are joined by one line feed, white space
inside a block is one space. Equal sums prefer the longer region. Rows are independent,
so repeated rows, ties and empty tables need no rule; extra columns are kept unless they
are named ``text`` or ``n_chars``. A page is read once: open elements are counted rather than
walked through, tags are sought only where one can still end, and an element that is
never closed is looked for once, so any text takes time in proportion to its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SAMPLE = 2_000
#: Bounds of one log odd, and of the one for being in or out of an article.
CLIP, CLIP_MAIN = 3.0, 9.0
TAG_COST = 0.05

# tried only where a ">" follows, so each match ends at one and a page is scanned once
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>"
    r"|([^<]++|<)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Elements whose content is no text of the page (fixed values of the HTML standard).
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
#: Of these, the ones that end with the block they are in if they are never closed; the others run to the end of the page.
_ENDS_WITH_BLOCK = frozenset("iframe svg select noscript template".split())
_BLOCK_END = re.compile(r"</(?:p|div|section|article|main|aside|header|footer|nav|li|ul|ol|td|tr|table|form|body|html|h[1-6])[\s/>]", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace".split())
#: Elements that end at the next one of their kind or at a block.
IMPLIED = {"p": frozenset(), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
           "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")),
           "option": frozenset(("select",))}
NEVER = frozenset("nav aside footer form button menu dialog head".split())
_NEVER_CLASS = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|sidebar|widgets?|related|recommend\w*|shar(?:e|ing)|social|comments?|commentlist|repl(?:y|ies)|disqus|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|login|signup|search|complementary|contentinfo)(?:[-_]|$)", re.I)
_NAMES = re.search(r"\(\?:(ads.*)\)\(\?:\[-_\]", _NEVER_CLASS.pattern).group(1)
#: Words of page layout: beside a name above they make it the name of a container ("comment-list", "site-footer").
_LAYOUT = ("list|area|box|bar|slot|container|wrapper|wrap|body|items?|left|right|top|bottom|main|site|page|user|post|posts|reader|buttons?|"
           "block|section|panel|inner|outer|column|col|row|group|grid|card|links?|icons?|mobile|desktop|sticky|fixed|float(?:ing)?|primary|secondary|global|form|thread")
#: A class or role made of such names and layout words alone drops a block outright; with a topic ("related-work") it only counts for the score.
_CONTAINER = re.compile(rf"(?=(?:.*[-_])?(?:{_NAMES})(?:[-_]|$))(?:{_NAMES}|{_LAYOUT})(?:[-_]+(?:{_NAMES}|{_LAYOUT}))*", re.I)
#: Ids are also anchors of topics, so only names that are no topic drop a block.
_NEVER_ID = re.compile(r"comments|commentlist|replies|disqus|sidebar|footer|masthead|navbar|breadcrumbs?|newsletter|ads?", re.I)
#: Inline pieces drop as adverts only: "comment" is also code, "search" or "nav" a link.
_NEVER_INLINE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pseudo-counts of words (inside, outside an article) per surrounding.
PRIOR = {
    **dict.fromkeys(("article", "main", "p", "blockquote", "pre", "h1", "h2", "h3"), (20.0, 2.0)),
    **dict.fromkeys(("nav", "aside", "footer", "header", "form", "menu", "button", "dialog", "never"), (1.0, 40.0)),
    **dict.fromkeys(("a", "li", "label"), (5.0, 15.0)),
    "in main": (200.0, 1.0), "out of main": (1.0, 200.0),
}
_NEUTRAL = frozenset("html body div span section b i em strong small br font center table tbody tr td th ul ol dl".split())


@dataclass
class Block:
    """Words between two block boundaries, the surroundings they share and the tags before them."""

    raw: list[str] = field(default_factory=list)
    around: frozenset[str] | None = frozenset()
    weight: float = 0.0  # of the surroundings, the article itself left out
    never: bool = False
    main: bool = False
    links: int = 0  # characters inside links
    tags: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.raw)).split())


#: More names open at once than this say nothing about a page; it is not learned from.
MOST_NAMES = 1000


class _Open:
    """The open elements of a page; every question about them is answered without walking the stack."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight
        self.stack: list[tuple[str, tuple[str, ...], bool, float, int]] = []  # name, names, never content, weight and block below it
        self.places: dict[str, list[int]] = {}
        self.names: Counter = Counter()
        self.total, self.block = 0.0, -1  # weight of the open names; place of the innermost block
        self.never_blocks = self.never_inline = 0

    def push(self, name: str, own: set[str], never: bool) -> None:
        self.stack.append((name, tuple(own), never, self.total, self.block))
        self.places.setdefault(name, []).append(len(self.stack) - 1)
        for n in sorted(own):
            self.names[n] += 1
            if self.names[n] == 1 and n not in ("article", "main"):
                self.total += self.weight.get(n, 0.0)
        if name in INLINE:
            self.never_inline += never
        else:
            self.never_blocks += never
            self.block = len(self.stack) - 1

    def pop(self) -> None:
        name, own, never, self.total, self.block = self.stack.pop()
        self.places[name].pop()
        for n in own:
            self.names[n] -= 1
            if not self.names[n]:
                del self.names[n]
        if name in INLINE:
            self.never_inline -= never
        else:
            self.never_blocks -= never

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    @property
    def main(self) -> bool:
        return "article" in self.names or "main" in self.names

    @property
    def never(self) -> bool:
        return self.never_blocks > 0 or ("header" in self.names and not self.main)


def parse(page: str | None, weight: dict[str, float] | None = None, named: bool = False) -> tuple[list[Block], Counter]:
    """Blocks with a word, in page order, and how often each element opens.

    A block has the ``weight`` of its surroundings and, if ``named``, their names (None if there are too many).
    """
    blocks: list[Block] = []
    opened: Counter = Counter()
    held, current, pending = _Open(weight or {}), Block(), 0
    at, page = 0, page or ""
    last_tag = page.rfind(">")
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal current, pending
        if any(not r.isspace() for r in current.raw):
            current.tags = pending
            blocks.append(current)
            pending = 0
        current = Block()

    while at < len(page):
        if at > last_tag:  # no tag can end any more
            words, at = page[at:].partition("<!--")[0], len(page)
        else:
            m = _TOKEN.match(page, at)
            at, words = m.end(), m.group(7)
        if words is not None:
            if held.never_inline:  # an inline piece that is no content goes alone
                current.raw += [" "] if current.raw else []
                continue
            if not current.raw:
                current.weight, current.never, current.main = held.total, held.never, held.main
                if named:
                    current.around = frozenset(held.names) if len(held.names) <= MOST_NAMES else None
            current.raw.append(words)
            if held.places.get("a"):
                current.links += len(words)
            continue
        slash, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if name is None:
            continue
        name, pending = name.lower(), pending + 1
        if name == "br":
            current.raw.append(" ")
            continue
        if name not in INLINE:
            close()
        if slash:
            place = held.last(name)
            if place > held.block or (place >= 0 and name not in INLINE):
                held.cut(place)
            continue
        opened[name] += 1
        if name in RAW and not attrs.rstrip().endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                unclosed.add(name)
                end = _BLOCK_END.search(page, at) if name in _ENDS_WITH_BLOCK else None
                at = end.start() if end else len(page)
            continue
        if name in VOID:
            continue
        if name not in INLINE:  # formatting left open ends with its block
            held.cut(held.block + 1)
            if held.stack and held.stack[-1][0] == "p":
                held.pop()
        if name in IMPLIED:
            place = held.last(name)
            if place >= 0 and place > held.last(*IMPLIED[name]):
                held.cut(place)
        classes: set[str] = set()
        never = name in NEVER or bool(attrs and _HIDDEN.search(attrs))
        likely = never
        if attrs:
            for kind, a, b, c in _ATTR.findall(attrs):
                found = (a or b or c).lower().split()
                classes.update(found)
                if name in _HEADINGS:
                    continue
                sure = _NEVER_INLINE if name in INLINE else _NEVER_ID if kind.lower() == "id" else _CONTAINER
                never = never or any(sure.fullmatch(c) for c in found)
                likely = likely or any(_NEVER_CLASS.search(c) for c in found)
        if name in ("body", "html", "article", "main"):
            never = likely = False
        held.push(name, {name} - _NEUTRAL | {"." + c for c in classes} | ({"never"} if never or likely else set()), never)
    close()
    return blocks, opened


def _surroundings(around: frozenset[str], main: bool) -> frozenset[str]:
    """Features of a word on a page that marks its article."""
    return around - {"article", "main"} | {"in main" if main else "out of main"}


def label_counts(page: str | None) -> dict[str, tuple[int, int]]:
    """Words (inside, outside the article) per surrounding of a labelled page; empty for other pages."""
    blocks, opened = parse(page, named=True)
    if opened["article"] != 1 and (opened["article"] or opened["main"] != 1):
        return {}
    out: dict[str, list[int]] = {}
    for b in blocks:
        if b.around is None:
            return {}
        n, inside = len(b.text().split()), b.main and not b.never
        for name in _surroundings(b.around, b.main):
            out.setdefault(name, [0, 0])[not inside] += n
    return {k: (a, b) for k, (a, b) in out.items()}


def weights(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log odds per surrounding, from counted words and the pseudo-counts."""
    out = {}
    for name in counts.keys() | PRIOR.keys():
        inside, outside = (a + b for a, b in zip(counts.get(name, (0, 0)), PRIOR.get(name, (5.0, 5.0))))
        bound = CLIP_MAIN if name.endswith("of main") or name == "in main" else CLIP
        out[name] = max(-bound, min(bound, math.log(inside / outside)))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum, the longest of equals; (0, 0) if none is positive."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, k
        run += s
        if run > best or (run == best and run > 0 and k + 1 - start > region[1] - region[0]):
            best, region = run, (start, k + 1)
    return region


def extract(page: str | None, weight: dict[str, float]) -> str:
    blocks, opened = parse(page, weight)
    marked = bool(opened["article"] or opened["main"])
    scores: list[float] = []
    for b in blocks:
        scores.append(-TAG_COST * b.tags)
        # a word is worth one by itself; being in or out of the article counts only on pages that mark one
        each = 1.0 + b.weight + (weight.get("in main" if b.main else "out of main", 0.0) if marked else 0.0)
        if b.never and b.main:
            each = 0.0  # dropped below, and no reason to end the region
        length = sum(map(len, b.raw))
        if not b.main and b.links * 2 > length:
            each -= CLIP  # mostly links
        scores.append(each * len(b.text().split()))
    start, end = best_region(scores)
    return "\n".join(t for b in blocks[start // 2:(end + 1) // 2] if not b.never and (t := b.text()))


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` of the pages, chosen by a hash; the result is a few numbers per name."""
    total = pages.count()
    every = max(1, -(-total // sample))
    narrow = pages.select(F.col(html_col).cast("string").alias("html"))
    chosen = narrow.where(F.pmod(F.xxhash64("html"), F.lit(every)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for name, (a, b) in label_counts(page).items():
                    own = sums.setdefault(name, [0, 0])
                    own[0] += a
                    own[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), *[pa.array([v[k] for v in sums.values()], pa.int64()) for k in (0, 1)]],
                ["name", "inside", "outside"])

    counted = chosen.mapInArrow(count, "name string, inside bigint, outside bigint").groupBy("name").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # rare names (fewer than 50 words in the sample) tell nothing, and leaving them out bounds the table
    rows = counted.where(F.col("inside") + F.col("outside") >= 50).collect()
    return weights({r["name"]: (r["inside"], r["outside"]) for r in rows})


def main_text(pages: DataFrame, weight: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` without the markup: the other columns, then ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = StructType([*[pages.schema[c] for c in keep], StructField("text", StringType()), StructField("n_chars", LongType())])

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weight) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                [*keep, "text", "n_chars"])

    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html"))
    return source.mapInArrow(pull, schema)
