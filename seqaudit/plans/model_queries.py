"""Baselines, ensembles, encoders and pooling."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import metrics as m, models as ml, split as sp
from ..session import ensure_checkpoint_dir, read, settle
from .catalog import query
from .ingest_queries import _r
from .views import assay, cte, r6, u, with_ctes

# Training rows and test rows by sequence hash, so copies never straddle the split.
cte("hashed", """SELECT *, CASE ('0x'||left(sha256(sequence),8))::bigint%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
 ln(1+length(sequence)) AS x1, gc AS x2 FROM assay""", ("assay",))
cte("gram", """SELECT count(*)::double AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(target) AS y, sum(x1*target) AS y1, sum(x2*target) AS y2
 FROM hashed WHERE split='train'""", ("hashed",))


def _sides(spark, sf, target="target"):
    """Training and test rows, derived once: every baseline reads both of them several times."""
    df = assay(spark, sf).select("row_id", "sequence", "target", "label").withColumn("split", sp.hash_split(F.sha2("sequence", 256)))
    df = settle(df.where("split <> 'validation'"))
    return df.where("split = 'train'"), df.where("split = 'test'")


def _validation(spark, sf):
    """Validation rows, or the training rows where there are none."""
    df = assay(spark, sf).select("row_id", "sequence", "target").withColumn("split", sp.hash_split(F.sha2("sequence", 256)))
    val = df.where("split = 'validation'")
    return df.where("split = 'train'") if val.isEmpty() else val


def _baseline(spark, sf, kind):
    train, test = _sides(spark, sf)
    out = ml.linear_baseline(train, test, "sequence", "target", kind, "prediction")
    return out.select("row_id", F.round("prediction", 5).alias("prediction"))


@query("ML1_gc_length_ridge", with_ctes(f""", std AS (SELECT *, s1/n AS m1, s2/n AS m2, y/n AS my, sqrt(s11/n-(s1/n)*(s1/n)) AS d1, sqrt(s22/n-(s2/n)*(s2/n)) AS d2 FROM gram),
 nrm AS (SELECT *, (s11-n*m1*m1)/(d1*d1)+1 AS a, (s12-n*m1*m2)/(d1*d2) AS b, (s22-n*m2*m2)/(d2*d2)+1 AS c, (y1-n*m1*my)/d1 AS p, (y2-n*m2*my)/d2 AS q FROM std),
 w AS (SELECT *, (c*p-b*q)/(a*c-b*b)/d1 AS w1, (a*q-b*p)/(a*c-b*b)/d2 AS w2 FROM nrm)
SELECT row_id, {r6('my+w1*(x1-m1)+w2*(x2-m2)', 5)} AS prediction FROM hashed, w WHERE split='test'""", "gram"))
def ml1(spark, sf):
    return _baseline(spark, sf, "gc_length_baseline")


@query("ML2_kmer_ridge")
def ml2(spark, sf):
    return _baseline(spark, sf, "kmer_ridge_or_logistic")


@query("ML2_kmer_logistic")
def ml2c(spark, sf):
    train, test = _sides(spark, sf)
    out = ml.logistic_baseline(train, test, "sequence", "label", 3, "score")
    return out.select("row_id", F.round("score", 4).alias("score"))


@query("ML3_kmer_random_forest")
def ml3(spark, sf):
    train, test = _sides(spark, sf)
    out = ml.forest_baseline(train, test, "sequence", "target", "prediction")
    return out.select("row_id", F.round("prediction", 6).alias("prediction"))


@query("ML4_kmer4_linear_probe")
def ml4(spark, sf):
    return _baseline(spark, sf, "kmer4_linear_probe")


DET = "({0}*({4}*{8}-{5}*{7})-{1}*({3}*{8}-{5}*{6})+{2}*({3}*{7}-{4}*{6}))"
A = ["(n+0.001)", "s1", "s2", "s1", "(s11+0.001)", "s12", "s2", "s12", "(s22+0.001)"]


def _cramer(i):
    b = list(A)
    for r, v in enumerate(("y", "y1", "y2")):
        b[3 * r + i] = v
    return f"{DET.format(*b)}/{DET.format(*A)}"


@query("ML5_least_squares_fallback", with_ctes(f""", w AS (SELECT {_cramer(0)} AS w0, {_cramer(1)} AS w1, {_cramer(2)} AS w2 FROM gram)
SELECT row_id, {r6('w0+w1*x1+w2*x2', 5)} AS prediction FROM hashed, w WHERE split='test'""", "gram"))
def ml5(spark, sf):
    return _baseline(spark, sf, "least_squares_fallback")


@query("ML6_baseline_predictions")
def ml6(spark, sf):
    train, test = _sides(spark, sf)
    out = ml.run_baselines(train, test, "sequence", "target")
    return out.select("row_id", *[F.round(n, 5).alias(n) for n in ml.BASELINES])


@query("ML6_classification_baselines")
def ml6c(spark, sf):
    """All baselines of a two-class task, next to the model's own prediction column."""
    train, test = _sides(spark, sf)
    with_model = test.withColumn("prediction", F.lit(0.5))
    out = ml.run_baselines(train.withColumn("prediction", F.lit(0.5)), with_model, "sequence", "label", "classification")
    return out.select("row_id", "prediction", *[F.round(n, 5).alias(n) for n in ml.BASELINES])


@query("ML7_best_baseline", with_ctes("""SELECT source, name, r2 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r2 DESC, pos) AS rn FROM (
 SELECT source, 'gc' AS name, 1 AS pos, round(1-sum(power(4*gc+2.1-target,2))/(var_pop(target)*count(*)),6) AS r2 FROM assay GROUP BY source
 UNION ALL SELECT source, 'flat', 2, round(1-sum(power(4.0-target,2))/(var_pop(target)*count(*)),6) FROM assay GROUP BY source)) WHERE rn=1""", "assay"))
def ml7(spark, sf):
    df = assay(spark, sf).withColumns({"gc_base": 4 * F.col("gc") + 2.1, "flat_base": F.lit(4.0)})
    score = lambda c, n, i: m.regression_metrics(df, "target", c, ["source"]).select(
        "source", F.lit(n).alias("name"), F.lit(i).alias("pos"), F.round("r2", 6).alias("r2"))
    return ml.best_baseline(score("gc_base", "gc", 1).union(score("flat_base", "flat", 2)), "name", "r2", "pos", ["source"])


@query("ML8_category_codes", """WITH c AS (SELECT source AS value, count(*) AS rows FROM documents GROUP BY source), k AS (SELECT value, row_number() OVER (ORDER BY rows DESC, value)-1 AS code FROM c),
 top AS (SELECT * FROM k WHERE code<5)
SELECT doc_id, coalesce(code,(SELECT count(*) FROM top)) AS source_code FROM documents LEFT JOIN top ON source=value""")
def ml8(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source")
    levels = ml.category_levels(docs, ["source"], 6)
    return ml.encode_categories(docs, levels, ["source"]).select("doc_id", "source_code")


@query("ML9_zscore", f"""WITH e AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding,1)-1 AS d FROM embeddings),
 f AS (SELECT d, avg(x) AS m, CASE WHEN stddev_pop(x)<1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM e GROUP BY d)
SELECT vec_id, {r6('sum((x-m)/s)')} AS total, {r6('max((x-m)/s)')} AS top FROM e JOIN f USING (d) GROUP BY vec_id""")
def ml9(spark, sf):
    df = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    z = ml.zscore(df, "x", "z")
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.array_max("z"), 6).alias("top"))


@query("ML10_bagged_ensemble")
def ml10(spark, sf):
    train, test = _sides(spark, sf)
    build = ml.kmer_features("sequence", 3)
    heads = ml.fit_ensemble(train, ["sequence"], build, "target", "row_id", members=5)
    scored = ml.predict(test, ["sequence"], build, heads, "raw")
    mean, std = ml.ensemble_mean_std("raw")
    scored = scored.withColumns({"prediction": mean, "std": std})
    # calibrated on rows that are neither fitted nor scored
    val = ml.predict(_validation(spark, sf), ["sequence"], build, heads, "raw").withColumn("prediction", mean)
    error = ml.calibration_rmse(val, "prediction", "target")
    return scored.select("row_id", F.round("prediction", 5).alias("prediction"), F.round(ml.calibrated_std(scored, "std", error), 5).alias("uncertainty"))


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


def _heads(spark, fitted):
    rows = [(i, float(h[0]), [float(v) for v in h[1:]]) for i, h in enumerate(fitted)]
    return spark.createDataFrame(rows, "member int, bias double, weights array<double>")


@query("ML11_embedding_ensemble_training")
def ml11(spark, sf):
    """Regression heads: ridge members on bootstraps of the training rows, scored on the others."""
    df = _vectors(spark, sf)
    side = sp.hash_split(F.sha2(F.col("vec_id").cast("string"), 256))
    heads = ml.fit_ensemble(df.where(side == "train"), ["x"], ml.array_features("x"), "y", "vec_id", members=4, first_plain=True)
    scored = ml.score_embeddings(df.where(side != "train"), "x", _heads(spark, heads))
    return scored.select("vec_id", F.round("prediction", 5).alias("prediction"), F.round("uncertainty", 5).alias("uncertainty"))


@query("ML11_embedding_classifier_ensemble")
def ml11c(spark, sf):
    """Classification heads: logistic members on stratified bootstraps; the classes are the lower and the upper labels."""
    df = _vectors(spark, sf).where("y is not null and x is not null").withColumn("upper", (F.col("y") >= 5).cast("double"))
    side = sp.hash_split(F.sha2(F.col("vec_id").cast("string"), 256))
    width = df.select(F.max(F.size("x")).alias("d")).first()["d"] or 0
    heads = ml.fit_logistic_ensemble(df.where(side == "train"), ["x"], ml.array_features("x"), "upper", "vec_id", width, members=4, first_plain=True)
    scored = ml.score_embeddings(df.where(side != "train"), "x", _heads(spark, heads), logistic=True)
    return scored.select("vec_id", F.round("prediction", 5).alias("prediction"), F.round("uncertainty", 5).alias("uncertainty"))


# Heads for scoring: the mean embedding of each label is one member's weight vector.
@query("ML12_embedding_ensemble_scoring", f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding,1) AS d FROM embeddings),
 h AS (SELECT label AS member, d, avg(x) AS w FROM e GROUP BY label, d), s AS (SELECT vec_id, member, 1/(1+exp(-(sum(x*w)+member/10.0))) AS v FROM e JOIN h USING (d) GROUP BY vec_id, member)
SELECT vec_id, {r6('avg(v)')} AS prediction, {r6('stddev_samp(v)')} AS uncertainty FROM s GROUP BY vec_id""")
def ml12(spark, sf):
    df = _vectors(spark, sf)
    cells = df.select(F.col("y").cast("int").alias("member"), F.posexplode("x").alias("d", "v")).groupBy("member", "d").agg(F.avg("v").alias("w"))
    heads = cells.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("d", "w"))).alias("c")).select(
        "member", (F.col("member") / 10.0).alias("bias"), F.transform("c", lambda s: s["w"]).alias("weights"))
    return ml.score_embeddings(df, "x", heads, logistic=True).select(
        "vec_id", F.round("prediction", 6).alias("prediction"), F.round("uncertainty", 6).alias("uncertainty"))


def _pooled(spark, sf, method):
    df = _vectors(spark, sf)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("x", i * 8 + 1, 8))
    df = df.withColumn("tokens", tokens).withColumn("mask", F.transform("tokens", lambda t: F.when(t[0] > 0, 1).otherwise(0)))
    return df.select("vec_id", F.posexplode(ml.pool("tokens", "mask", method)).alias("d", "v")).select("vec_id", "d", F.round("v", 6).alias("v"))


@query("ML13_mean_pooling", f"""WITH e AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding,1)-1 AS i, embedding FROM embeddings)
SELECT vec_id, (i%8)::int AS d, {r6('coalesce(sum(x) FILTER (embedding[(i//8)*8+1]>0),0)/greatest(count(*) FILTER (embedding[(i//8)*8+1]>0),1)')} AS v FROM e GROUP BY vec_id, i%8""")
def ml13(spark, sf):
    return _pooled(spark, sf, "mean")


@query("ML13_attention_pooling", f"""WITH e AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding,1)-1 AS i, embedding FROM embeddings),
 t AS (SELECT vec_id, i//8 AS t, avg(x) AS m, any_value(embedding[(i//8)*8+1])>0 AS on_ FROM e GROUP BY vec_id, i//8),
 w AS (SELECT vec_id, t, exp(CASE WHEN on_ THEN m ELSE -1e9 END - max(CASE WHEN on_ THEN m ELSE -1e9 END) OVER (PARTITION BY vec_id)) AS w FROM t)
SELECT vec_id, (i%8)::int AS d, {r6('sum(x*w)/sum(w)')} AS v FROM e JOIN w ON e.vec_id=w.vec_id AND w.t=e.i//8 GROUP BY e.vec_id, i%8""".replace("SELECT vec_id, (i%8)", "SELECT e.vec_id, (i%8)"))
def ml13a(spark, sf):
    return _pooled(spark, sf, "attention")


@query("ML14_bagged_ridge_spread")
def ml14(spark, sf):
    train, test = _sides(spark, sf)
    build = ml.gc_length_matrix("sequence")
    heads = ml.fit_ensemble(train, ["sequence"], build, "target", "row_id", members=24, seed=7)
    mean, std = ml.ensemble_mean_std("raw")
    return ml.predict(test, ["sequence"], build, heads, "raw").select("row_id", F.round(mean, 5).alias("prediction"), F.round(std, 5).alias("uncertainty"))


@query("ML14_forest_tree_spread")
def ml14f(spark, sf):
    """Mean and deviation of the single trees of a forest over the test rows."""
    from pyspark.ml.regression import RandomForestRegressor

    train, test = _sides(spark, sf)
    vector = ml.sequence_vector("sequence", 3)
    model = RandomForestRegressor(featuresCol="__x", labelCol="target", numTrees=96, minInstancesPerNode=3, maxDepth=8, seed=13,
                                  featureSubsetStrategy="all").fit(train.select(vector.alias("__x"), "target"))
    ensure_checkpoint_dir(spark)
    nodes = ml.forest_nodes(model, f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4().hex}", spark)
    features = F.concat(seq.gc_length_features("sequence"), seq.kmer_frequencies("sequence", 3))
    spread = ml.tree_spread(test.withColumn("__f", features), nodes, "__f")
    return spread.select("row_id", F.round("tree_mean", 5).alias("prediction"), F.round("tree_std", 5).alias("uncertainty"))


@query("ML16_scored_batch", with_ctes(f"SELECT row_id, {r6('2*gc+0.3*uncertainty')} AS ucb FROM assay ORDER BY round(2*gc+0.3*uncertainty,6) DESC, row_id LIMIT 96", "assay"))
def ml16(spark, sf):
    import pandas as pd

    df = assay(spark, sf).select("row_id", "gc", "uncertainty")
    fn = lambda pdf: pd.DataFrame({"mean": 2 * pdf["gc"], "spread": pdf["uncertainty"]})
    scored = ml.score_table(df, fn, "row_id long, gc double, uncertainty double, mean double, spread double")
    return scored.select("row_id", F.round(F.col("mean") + 0.3 * F.col("spread"), 6).alias("ucb")).orderBy(F.desc("ucb"), "row_id").limit(96)


@query("UDF3_score_callback", with_ctes(f"SELECT row_id, {r6('3*gc')} AS mean, {r6('abs(gc-0.5)')} AS uncertainty FROM assay", "assay"))
def udf3(spark, sf):
    import pandas as pd

    df = assay(spark, sf).select("row_id", "gc")
    out = ml.score_table(df, lambda p: pd.DataFrame({"mean": np.round(3 * p["gc"], 6), "uncertainty": np.round((p["gc"] - 0.5).abs(), 6)}),
                         "row_id long, gc double, mean double, uncertainty double")
    return _r(out.drop("gc"), "row_id")
