"""Ordered columns, greedy selections, scores and sources against small sequential forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.functions import values
from seqaudit.operators import campaigns, candidates as c, corpus, metrics as m, ordered, plates
from seqaudit.sources import fasta, tables


def test_bucketed_running_sums_equal_plain_ones(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.choice("ab") if rnd.random() < 0.3 else "hot", rnd.randint(0, 30) / 3, rnd.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double, v long")
    order = [F.col("x"), F.col("id")]
    one = ordered.running_sum(df, "s", F.col("v"), order, F.col("x"), ["g"]).collect()
    many = ordered.running_sum(df, "s", F.col("v"), order, F.col("x"), ["g"], rows_per_task=25).collect()
    assert {r["id"]: r["s"] for r in one} == {r["id"]: r["s"] for r in many}


def test_one_value_for_all_rows_is_split(spark):
    df = spark.createDataFrame([(i, 1.0, "g") for i in range(1000)], "id long, x double, g string").repartition(7)
    bucketed, n = ordered.with_bucket(df, [F.col("x")], 25)
    assert n == 40 and max(r["count"] for r in bucketed.groupBy("__bucket").count().collect()) <= 50
    ranks = ordered.row_number(df, "r", [F.col("x"), F.col("id")], None, [], 25).collect()
    assert all(r["r"] == r["id"] + 1 for r in ranks)


@pytest.mark.parametrize("rows_per_task", [None, 10])
def test_quantiles_equal_numpy(spark, rows_per_task):
    rnd = random.Random(4)
    rows = [("ab"[rnd.random() < 0.3], rnd.choice([rnd.random(), 0.5, None])) for _ in range(200)] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ordered.quantiles(df, "v", {"m": 0.5, "q": 0.9}, ["g"], rows_per_task).collect()}
    assert set(got) == {"a", "b", "d"}
    for g, r in got.items():
        held = [v for k, v in rows if k == g and v is not None]
        assert abs(r["m"] - np.quantile(held, 0.5)) < 1e-12 and abs(r["q"] - np.quantile(held, 0.9)) < 1e-12
    one = ordered.quantiles(df, "v", {"m": 0.5}).first()
    assert abs(one["m"] - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-12


def test_metrics_of_constant_columns_are_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "t double, p double")
    row = m.regression_metrics(df, "t", "p").first()
    assert row["pearson"] is None and row["r2"] is None and row["mae"] == 1.5
    assert m.spearman(df, "t", "p").first()["spearman"] is None


def test_uncertainty_bins_split_like_near_equal_arrays(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(13)], "id long, u double")
    got = [r["count"] for r in m.near_equal_bins(df, "u", "id", 5, ["u"]).orderBy("bin").collect()]
    assert got == [len(a) for a in np.array_split(np.arange(13), 5)]


def test_minimising_audit_and_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 1.1), (2, 2.0, 2.2), (3, 3.0, 2.9)], "id long, t double, p double")
    row = m.ranking_audit(df, "t", "p", "id", 1, minimize=True).first()
    assert row["best_true_item_rank_by_prediction"] == 1 and row["top_k_target_mean"] == 1.0
    pool = spark.createDataFrame([("AAAA", 10.0, 2.0), ("TTTT", 8.0, 1.0)], "s string, mean double, std double")
    shown, rank = c.acquisition("mean", "std", "ucb", 1.0, minimize=True)
    assert [(r["s"], r["x"]) for r in pool.select("s", shown.alias("x"), rank.alias("r")).orderBy(F.desc("r")).collect()] == [("TTTT", 7.0), ("AAAA", 8.0)]
    n = spark.createDataFrame([(0.5, 0.05, 0.8), (-1.0, 0.05, 0.8)], "d double, a double, p double").select(m.sample_size("d", "a", "p").alias("n"))
    assert [r["n"] for r in n.collect()] == [32, None]


def greedy(rows, penalty, top_k, kind="kmer_cosine"):
    rows = sorted(rows)
    near = c.similarity_to(kind, [r[1] for r in rows], 3)
    sims = [near(i) for i in range(len(rows))]
    picked = []
    while len(picked) < min(top_k, len(rows)):
        best = max((i for i in range(len(rows)) if i not in picked),
                   key=lambda i: (rows[i][2] - penalty * max([sims[j][i] for j in picked], default=0.0), -i))
        picked.append(best)
    return [rows[i][0] for i in picked]


@pytest.mark.parametrize("kind", ["kmer_cosine", "kmer_jaccard", "edit_distance"])
def test_greedy_diverse_equals_plain_loop(spark, kind):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(20)), rnd.random() / 5) for i in range(60)]
    df = spark.createDataFrame([(r[0] % 2, *r) for r in rows], "pool long, id long, s string, a double")
    got = c.greedy_diverse(df, "pool", "id", "s", "a", method=kind, top_k=5, shortlist=10).orderBy("pool", "rank").collect()
    for p in (0, 1):
        assert [r["id"] for r in got if r["pool"] == p] == greedy([r for r in rows if r[0] % 2 == p], 0.2, 5, kind)
    src = df.select("pool", "id", "s", F.col("a").alias("score"))
    rounds = c.greedy_rounds(src, kind, 0.2, 3, 3).orderBy("pool", "rank").collect()
    assert [r["id"] for r in rounds if r["pool"] == 0] == greedy([r for r in rows if r[0] % 2 == 0], 0.2, 3, kind)


def test_budget_walk_equals_plain_loop(spark):
    rnd = random.Random(8)
    rows = [(i % 3, i, rnd.random(), rnd.choice("ABC"), float(rnd.randint(1, 9))) for i in range(150)]
    df = spark.createDataFrame(rows, "pool long, id long, score double, fam string, cost double")
    got = plates.select_batch(df, "pool", "id", "score", 12, "fam", 4, "cost", 30.0).collect()
    for p in range(3):
        spent, fam, want = 0.0, {}, []
        for _, i, s, f, cost in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1])):
            if len(want) >= 12:
                break
            if fam.get(f, 0) >= 4 or spent + cost > 30.0:
                continue
            want.append(i)
            spent, fam[f] = spent + cost, fam.get(f, 0) + 1
        assert [r["id"] for r in sorted((r for r in got if r["pool"] == p), key=lambda r: r["pick"])] == want


def test_chain_is_the_same_in_chunks_and_detects_tampering(spark):
    rows = [(k % 2, k, f"e{k}") for k in range(24)]
    fixed = {n: F.lit(n) for n in ("occurred_at", "actor", "action", "resource_type", "resource_id")}
    df = spark.createDataFrame(rows, "chain long, at long, event_id string").withColumns({**fixed, "details_json": F.lit("{}")})
    a = {r["at"]: r["event_hash"] for r in campaigns.build_chain(df, "chain", "at").collect()}
    built = campaigns.build_chain(df, "chain", "at", chunk=5)
    assert a == {r["at"]: r["event_hash"] for r in built.collect()}
    bad = built.withColumn("actor", F.when(F.col("at") == 6, "other").otherwise(F.col("actor")))
    assert [r["at"] for r in campaigns.verify_chain(bad, "at", ["chain"]).where("invalid").collect()] == [6]


def test_numbers_and_names(spark):
    texts = ["1_000", "1d", "nan", "Infinity", " 2.5 ", ".5", "1e999", "", None]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.parse_float("t").alias("v")).collect()]
    assert got == [1000.0, None, None, None, 2.5, 0.5, None, None, None]
    assert tables.clean_name("  DNA (5'-3') Seq ") == "dna_5_3_seq"
    df = spark.createDataFrame([("", "x"), ("a", "b")], "`Seq A` string, insert string")
    out = tables.apply_aliases(df, {"sequence": ["seq a", "insert"]}).collect()
    assert [r["sequence"] for r in out] == ["x", "a"]
    with pytest.raises(ValueError):
        tables.apply_aliases(df, {"sequence": ["seq a", "insert"]}, strict=True)


def test_fasta_index_follows_the_file(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACG\n\nTT\n>two x\nNN\n>three\nA\n")
    got = fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_index").collect()
    assert [(r["seq_index"], r["header"], r["sequence"]) for r in got] == [(0, "one", "ACGTT"), (1, "two x", "NN"), (2, "three", "A")]


def test_chunk_spans(spark):
    df = spark.createDataFrame([(n,) for n in (10, 64, 300, 512, 700)], "n int")
    got = df.select("n", corpus.chunk_spans("n", 256, 128, 64).alias("s"), corpus.window_count("n", 256, 128, 64).alias("w")).collect()
    for r in got:
        n, want = r["n"], []
        if 64 <= n <= 256:
            want = [(0, n)]
        elif n > 256:
            for s in range(0, n - 64 + 1, 128):
                want.append((s, min(s + 256, n)))
                if s + 256 >= n:
                    break
        assert [tuple(x) for x in r["s"]] == want and r["w"] == len(want)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
