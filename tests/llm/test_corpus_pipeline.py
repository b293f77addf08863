"""The pipeline against the same five steps written for one machine."""

import collections
import os
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from seqaudit.llm import pseudonyms, queries
from seqaudit.session import read

from test_llm_operators import DOCS, EDGE, brute_overlap
from test_near_copies import brute_least

SF = "/root/testdata/sf0.001"


def brute(rows, items, verdicts):
    rows = [r for r, kept in zip(rows, verdicts) if kept]
    least, _ = brute_least([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    rows = [r for r in rows if not any(brute_overlap(r["text"], i) for i in items)]
    tool = pseudonyms.Pseudonyms(queries.DEMO_KEY)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(tool.text(r["text"])[0], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            out[(r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def test_pipeline_matches_brute_force(spark):
    docs = read(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    kept = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, SF).collect()}  # checked by its own test and SQL
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    want = brute(rows, items, [kept[r["doc_id"]] for r in rows])
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_on_edge_rows(spark, tmp_path):
    benchmark = read(spark, SF, "benchmark").limit(5)
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (EDGE, []):
        start = spark.createDataFrame(rows, DOCS)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, start, str(tmp_path))
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == start.columns
            out.write.parquet(os.path.join(tmp_path, f"{len(rows)}-{number}"))
            assert spark.read.parquet(os.path.join(tmp_path, f"{len(rows)}-{number}")).count() <= len(rows) + 200
