"""One behaviour at every size, and the classification side of the audit."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqaudit.operators import campaigns, generate, ingest, models as ml, plates, similarity as sim, split as sp
from seqaudit.sources import tables
from seqaudit.streaming import stream


def digest(values):
    """The list digest, value by value."""
    lines = {}
    for v in values:
        lines[v] = lines.get(v, 0) + 1
    shards = {}
    for v in sorted(lines):
        shards.setdefault(v[:4], []).append(f"{v} x{lines[v]}")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return sha("\n".join(sha("\n".join(sorted(shards[k]))) for k in sorted(shards)))


def test_list_digest_has_one_definition(spark):
    rnd = random.Random(3)
    rows = [("hot", "same value")] * 500 + [("hot", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    rows += [(f"k{i % 9}", f"{rnd.randint(0, 40):04d}") for i in range(200)] + [("one", "ab")]
    got = sp.list_digest(spark.createDataFrame(rows, "k string, v string").repartition(5), "v", ["k"], "d", "n").collect()
    for r in got:
        own = [v for k, v in rows if k == r["k"]]
        assert (r["n"], r["d"]) == (len(own), digest(own))


def test_positions_are_never_cut(spark):
    df = spark.createDataFrame([(7, None, None), (12345, None, None), (12346, None, None)], "p long, i string, sequence_hash string")
    assert [r[0] for r in df.select(ingest.display_id("row", F.col("p"), "i")).collect()] == ["row_0007", "row_12345", "row_12346"]


def test_measurement_lines_are_numbered_over_files(spark, tmp_path):
    lines = []
    for name in ("b.txt", "a.txt", "c.txt"):
        own = [f"{'ACGT'[k % 4]}{'ACGT'[k // 4 % 4]}A\t{k}.5" if k % 7 else "# no data" for k in range(60)]
        (tmp_path / name).write_text("\n".join(own) + "\n")
    for name in ("a.txt", "b.txt", "c.txt"):
        lines += [float(x.split("\t")[1]) for x in (tmp_path / name).read_text().split("\n") if "\t" in x]
    whole = tables.read_measurements(spark, str(tmp_path)).orderBy("n").collect()
    assert [r["activity"] for r in whole] == lines and [r["n"] for r in whole] == list(range(1, len(lines) + 1))
    part = tables.read_measurements(spark, str(tmp_path), offset=45, limit=20).orderBy("n").collect()
    assert [r["activity"] for r in part] == lines[45:65]


def test_labels_are_encoded_whatever_their_number(spark):
    many = spark.createDataFrame([(f"class {i:05d}",) for i in range(1500)] + [(None,)], "l string")
    got = {r["l"]: r["encoded"] for r in ingest.encode_labels(many, "l").collect()}
    labels = sorted(l for l in got if l)
    assert got[None] is None and [got[l] for l in labels] == list(range(1500))
    two = spark.createDataFrame([("x",), ("y",)], "l string")
    assert {r["l"]: r["encoded"] for r in ingest.encode_labels(two, "l", "x").collect()} == {"x": 1, "y": 0}
    with pytest.raises(ValueError):
        ingest.encode_labels(many, "l", "class 00001")


def test_generation_goes_on_until_full(spark):
    parents = spark.createDataFrame([(1, "ACGNN"), (2, "NNNNNN")], "id long, s string")
    made = generate.masked_pool(parents, "id", "s", 12, "Mask-fill", 0.1, 5).collect()
    for key, count in ((1, 12), (2, 12)):
        own = [r["sequence"] for r in made if r["id"] == key]
        assert len(own) == len(set(own)) == count
    few = generate.masked_pool(parents.where("id = 1"), "id", "s", 20, "Mask-fill", 0.1, 5)
    assert {r["sequence"] for r in few.collect()} == {"ACG" + a + b for a, b in itertools.product("ACGT", repeat=2)}


def test_plates_refuse_what_they_cannot_hold(spark):
    picks = spark.createDataFrame([("p", i) for i in range(45)], "pool string, id long")
    controls = {"positive_control": 3, "negative_control": 3}
    laid = plates.assign_wells(picks, 96, controls, replicates=2)
    assert laid.count() == 96 and laid.select("well").distinct().count() == 96
    with pytest.raises(ValueError):
        plates.assign_wells(picks.unionByName(picks.limit(1)), 96, controls, replicates=2)
    with pytest.raises(ValueError):
        plates.assign_wells(picks.limit(1), 24, {"positive_control": 30})
    grid = plates.wells(spark, 96)
    first = [r["well"] for r in plates.anchors(grid, 96, 30).orderBy("n").collect()]
    assert set(first[:4]) == {"A1", "A12", "H1", "H12"} and set(first[4:8]) == {"A7", "E1", "E12", "H7"} and len(set(first)) == 30
    roles = spark.createDataFrame([("p", i, "r", i + 1) for i in range(92)], "pool string, id long, role string, pick int")
    assert plates.plate_plan(roles.where("pick <= 90"), 96, 6, 1).select("well").distinct().count() == 96
    with pytest.raises(ValueError):
        plates.plate_plan(roles, 96, 6, 1)


def test_rows_that_fail_filters_take_no_role(spark):
    rows = [("p", i, float(i), 0.1, 0.5, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "pool string, i long, p double, u double, g double, passes_basic_filters boolean")
    assert all(r["id"] % 2 == 0 for r in plates.role_selection(df, "pool", "i", "p", "u", "g", 12).collect())


def test_events_of_ids_that_hold_a_round_mark(spark):
    events = spark.createDataFrame([("e1", "promoter-rna"), ("e2", "promoter-rna-r001"), ("e3", "promoter"), ("e4", "promoter-r1"), ("e5", "other")],
                                   "event_id string, resource_id string")
    camps = spark.createDataFrame([("promoter-rna",), ("promoter",)], "campaign_id string")
    got = {}
    for r in campaigns.export_events(events, camps).collect():
        got.setdefault(r["campaign_id"], set()).add(r["event_id"])
    assert got["promoter-rna"] == {"e1", "e2"} and {"e3", "e4"} <= got["promoter"]


def _assay(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        gc = rnd.choice([0.25, 0.75])
        s = "".join(rnd.choice("GC") if rnd.random() < gc else rnd.choice("AT") for _ in range(60))
        rows.append((i, s, int(gc > 0.5), 4 * gc + rnd.random() / 10, 0.5))
    return spark.createDataFrame(rows, "row_id long, sequence string, label int, target double, prediction double")


def test_all_baselines_of_both_tasks(spark):
    train, test = _assay(spark, 120), _assay(spark, 60, 2)
    for task, target in (("classification", "label"), ("regression", "target")):
        out = ml.run_baselines(train, test, "sequence", target, task).toPandas()
        assert set(ml.BASELINES) <= set(out.columns) and "prediction" in out.columns and len(out) == 60
        for name in ml.BASELINES:
            if task == "classification":
                assert ((out[name] > 0.5) == (out["label"] == 1)).mean() > 0.9, name
            else:
                mean = out["target"].mean()
                assert ((out[name] - out["target"]) ** 2).sum() < 0.5 * ((out["target"] - mean) ** 2).sum(), name


def test_baselines_without_or_with_one_class(spark):
    train, test = _assay(spark, 40), _assay(spark, 10, 2)
    none = ml.run_baselines(train.limit(0), test, "sequence", "label", "classification").toPandas()
    assert none[list(ml.BASELINES)].isna().all().all() and len(none) == 10
    one = ml.run_baselines(train.where("label = 1"), test, "sequence", "label", "classification").toPandas()
    assert (one[list(ml.BASELINES)] == 1.0).all().all()


def test_forest_is_repeatable(spark):
    train, test = _assay(spark, 60).coalesce(1), _assay(spark, 20, 2).coalesce(1)
    a, b = (ml.forest_baseline(train, test, "sequence", "target", "f", trees=10).toPandas()["f"] for _ in range(2))
    assert np.array_equal(a, b)


def test_logistic_gradient_is_zero_at_the_fit(spark):
    """The fitted probabilities satisfy the score equations of the penalised loss in the intercept."""
    train = _assay(spark, 150)
    out = ml.logistic_baseline(train, train, "sequence", "label", 0, "p").toPandas()
    assert abs((out["p"] - out["label"]).sum()) < 1e-2


def test_rarest_tokens_order(spark):
    rows = [(i, sorted({1, 2, 100 + i, 200 + i % 5})) for i in range(40)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, hashed array<bigint>")
    short = {r["id"]: r["prefix"] for r in sim.rarest_first(df, F.lit(3)).collect()}
    assert all(short[i] == [100 + i, 200 + i % 5, 1] for i in range(40)) and short[99] == []
    one = {r["id"]: r["prefix"] for r in sim.rarest_first(df, F.size("hashed"), 1).collect()}
    assert all(one[i] == [2, 100 + i, 200 + i % 5, 1] for i in range(40))  # only token 1 has a place in the table
    full = {r["id"]: r["prefix"] for r in sim.rarest_first(df, F.size("hashed")).collect()}
    assert all(full[i] == [100 + i, 200 + i % 5, 1, 2] for i in range(40))


def test_label_state_needs_an_expiry(spark):
    with pytest.raises(ValueError):
        stream.label_conflicts(spark.readStream.format("rate").load(), "timestamp", "1 hour", 0)


@pytest.mark.parametrize("n", [100, 500])
def test_few_pairs_are_compared(spark, n):
    from seqaudit.functions import seq

    rnd = random.Random(42)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(100))) for i in range(n)]
    d = sim.pair_diagnostics(spark.createDataFrame(rows, "id long, payload string"), lambda c: seq.kmers(c, 8), 0.9).first()
    assert d["possible_pairs"] == n * (n - 1) // 2 and d["candidate_pairs"] <= 0.02 * d["possible_pairs"] and d["components"] == n


def test_dense_sets_need_about_one_comparison_a_row(spark):
    shared = [f"shared_{i}" for i in range(100)]
    rows = [(i, [*shared, f"unique_{i}"]) for i in range(500)]
    d = sim.pair_diagnostics(spark.createDataFrame(rows, "id long, payload array<string>"), lambda c: c, 0.9).first()
    assert d["components"] == 1 and 499 <= d["verified_pairs"] <= 600 and d["skipped_pairs"] > 100_000  # a row meets the hub of each of its keys


def test_audit_is_one_operator(spark):
    from seqaudit.operators import gates
    from seqaudit.plans.sensitivity import prediction_audit

    rnd = random.Random(8)
    rows = []
    for i in range(150):
        s = "".join(rnd.choice("ACGT") for _ in range(50))
        y = s.count("G") / 10 + rnd.random() / 5
        rows.append((i, s if i % 30 else "not dna", f"g{i // 2}", y, y + rnd.gauss(0, 0.05) if i % 31 else None, abs(rnd.gauss(0, 0.05))))
    df = spark.createDataFrame(rows, "row_id long, sequence string, grp string, target double, prediction double, u double")
    done = prediction_audit(df, "row_id", "sequence", "target", "prediction", "u", ["grp"], "predicted_absolute_error",
                            baselines=("gc_length_baseline", "kmer_ridge_or_logistic"), model_reps=50, lift_reps=50)
    run = done.run.collect()
    bad = {i for i in range(150) if i % 30 == 0 or i % 31 == 0}
    assert len(run) == 1 and {r["row_id"] for r in done.rejected.collect()} == bad
    assert sum(r["rows"] for r in done.split.collect()) == 150 - len(bad)
    r = run[0]
    assert r["model_metric"] > r["baseline_metric"] > 0.5 and r["lift_low"] is not None and r["leakage_ok"] == (r["test_rows"] >= 20)
    assert r["evidence"] in gates.EVIDENCE_LABELS and r["verdict"].startswith(gates.EVIDENCE_LABELS[r["evidence"]])
    assert {b["name"] for b in done.baselines.collect()} == {"gc_length_baseline", "kmer_ridge_or_logistic"}


def test_farthest_first_equals_the_plain_loop(spark):
    from seqaudit.operators import candidates

    rnd = random.Random(6)
    rows = [(p, "".join(rnd.choice("ACGT") for _ in range(12)), "A" * 12) for p in range(3) for _ in range((40, 25, 3)[p])]
    far = lambda a, b: sum(x != y for x, y in zip(a, b)) / len(a)
    want = {}
    for p in range(3):
        pool, picks = sorted({s for q, s, _ in rows if q == p}), []
        if len(pool) <= 5:
            picks = sorted(pool, reverse=True)
        while len(picks) < min(5, len(pool)):
            rest = [s for s in pool if s not in picks]
            picks.append(max(rest, key=lambda s: (min([far(s, x) for x in picks], default=np.inf), far(s, "A" * 12), s)))
        want |= {(p, i + 1): s for i, s in enumerate(picks)}
    got = candidates.farthest_first(spark.createDataFrame(rows, "p long, s string, base string"), "p", "s", "base", 5).collect()
    assert {(r["pool"], r["pick"]): r["sequence"] for r in got} == want
