"""The near-duplicate stage of the pipeline follows the links of both of its methods."""

import corpus_pipeline
from seqaudit.llm import near_copies, sliced_simhash


def test_links_of_simhash_and_of_sets_are_joined(spark):
    loop = "red green blue " * 60
    one, two = loop + "oak elm ash fir yew box", loop + "tin zinc lead iron gold neon"  # few sets in common, the same bits
    plain = [f"w{k}" for k in range(200)]
    near = " ".join(plain[:-1] + ["other"])  # one word of 200: other bits, nearly the same sets
    rows = [(1, one), (2, two), (3, " ".join(plain)), (4, near), (5, "a text of its own that is like no other one here"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sliced_simhash.fingerprint(one) == sliced_simhash.fingerprint(two)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {None, 1, 2, 3, 5}
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 5}


def test_a_group_is_reached_over_links_of_both_kinds(spark):
    loop = "red green blue " * 60
    words = [f"w{k}" for k in range(90)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, loop + "oak elm"), (7, "nothing else is like this row of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = spark.createDataFrame([(2, 3), (7, 7)], "src long, dst long")
    assert {r.doc_id for r in near_copies.keep_one(docs, links=links).collect()} == {1, 7}
