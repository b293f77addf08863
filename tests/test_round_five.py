"""Searches that shuffle no more than they need."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqaudit.functions.token_sets import CodedSets
from seqaudit.operators import metric, similarity as sim
from seqaudit.operators.components import connected_components
from seqaudit.session import cut, forget, settle
from test_similarity import as_map, components, levenshtein


def letters(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def test_postings_of_one_component_are_left_at_home(spark):
    """Only keys that two components hold are joined; a row's size and bitmap are fetched for those."""
    rnd = random.Random(5)
    seqs = [letters(rnd, 200) for _ in range(60)]
    near = seqs[0][:100] + ("A" if seqs[0][100] != "A" else "C") + seqs[0][101:]
    df = spark.createDataFrame(list(enumerate([*seqs, near])), "id long, payload string")
    table = sim.SetTable(df, CodedSets(8), 0.9)
    block = table.block(0.9)
    apart = cut(block.sets.withColumn("component", F.col("id")))
    asked, held = sim.shared_parts(block, apart)
    assert {r["id"] for r in held.collect()} == {0, 60} and {r["id"] for r in asked.collect()} <= {0, 60}
    assert [(r["src"], r["dst"]) for r in sim.apart_pairs(block, None).collect()] == [(0, 60)]
    together = cut(block.sets.withColumn("component", F.when(F.col("id") == 60, 0).otherwise(F.col("id"))))
    assert all(p.isEmpty() for p in sim.shared_parts(block, together))
    assert "hashed" not in table.reps.columns


def test_forgotten_tables_leave_no_files(spark, tmp_path):
    df = settle(spark.range(10))
    other = settle(spark.range(5))
    outside = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(outside)
    forget(df)
    forget(spark.read.parquet(outside))
    assert other.count() == 5 and spark.read.parquet(outside).count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(other.inputFiles()[0]).getParent()
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    forget(other)
    assert not files.exists(path)


def test_pair_diagnostics_reads_coded_sets(spark, monkeypatch):
    """The registered query meets rows under equal parts like the search it describes."""
    from seqaudit.plans import similarity_queries as q

    seen = []
    monkeypatch.setattr(q.sim, "pair_diagnostics", lambda df, tokens, t: seen.append(tokens) or df.select(
        *[F.lit(0).alias(c) for c in ("rows", "possible_pairs", "candidate_pairs", "verified_pairs", "skipped_pairs", "components")]))
    monkeypatch.setattr(q, "constructs", lambda spark, sf: spark.createDataFrame([(1, "ACGT")], "row_id long, sequence string"))
    q.pair_diagnostics(spark, "")
    assert seen == [CodedSets(q.K)]


def test_diagnostics_of_coded_sets_add_up(spark):
    rnd = random.Random(9)
    seqs = [letters(rnd, 120) for _ in range(40)]
    seqs += [s[:60] + "A" + s[61:] for s in seqs[:6]] + [seqs[7], "", "ACG"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, payload string")
    got = sim.pair_diagnostics(df, CodedSets(8), 0.8).first()
    edges = cut(sim.set_similarity_edges(df, CodedSets(8), 0.8))
    comps = connected_components(df.select("id"), edges).select("component").distinct().count()
    assert (got["rows"], got["possible_pairs"], got["components"]) == (len(seqs), len(seqs) * (len(seqs) - 1) // 2, comps)
    assert got["candidate_pairs"] + got["skipped_pairs"] == got["possible_pairs"] and got["verified_pairs"] <= got["candidate_pairs"]


def test_visits_of_a_batch_are_planned_in_bounded_shares(monkeypatch):
    """A worker holds ``CELLS`` numbers at once, whatever the pivots and the cells visited; the visits are the same."""
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    rows, pivots = unit(300), unit(40)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * rows @ pivots.T))
    own, reach = gaps.argmin(axis=1), np.where(np.arange(40) == 7, -1.0, 0.9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(list(rows)), pa.array(own.astype(np.int32)), pa.array(np.full(300, 0.8))],
                                       ["v", "x", "own", "best"])

    def planned():
        parts = list(metric._next_cells(batch, pivots, reach, 2, 18))
        return parts, [(v, c) for p in parts for v, c in zip(p.column(0).to_pylist(), p.column(2).to_pylist())]

    whole, want = planned()
    monkeypatch.setattr(metric, "CELLS", 2000)
    shares, got = planned()
    assert len(whole) == 1 and got == want and len(want) > 1000
    assert max(p.num_rows * 8 for p in shares) <= 2000
    assert all(np.allclose(p.column(1)[i].as_py(), rows[p.column(0)[i].as_py()]) for p in shares[:5] for i in range(p.num_rows))


def test_pieces_in_turns_lose_no_link(spark, monkeypatch):
    """Above ``TURN_POSTINGS`` the pieces are joined in turns, each of which holds a part of the postings."""
    rnd, seqs = random.Random(21), []
    for length in (40, 41, 60):
        s = letters(rnd, length)
        seqs += [s, *("".join(rnd.choice("ACGT") if i % 11 == k else c for i, c in enumerate(s)) for k in range(4)), s[:5] + s[6:]]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, payload string")
    pairs = [(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs))
             if 1 - levenshtein(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j])) >= 0.9 - 1e-12]
    join, turns = sim.piece_pairs, []
    monkeypatch.setattr(sim, "piece_pairs", lambda own, *rest: turns.append(own.count()) or join(own, *rest))
    monkeypatch.setattr(sim, "TURN_POSTINGS", 100)
    got = as_map(connected_components(df.select("id"), sim.edit_distance_edges(df, 0.9)))
    assert got == components(pairs, range(len(seqs)))
    assert len(turns) > 1 and max(turns) < sum(turns)
