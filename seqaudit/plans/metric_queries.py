"""Metrics, curves and bootstrap intervals over the whole assay table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrand import poisson_steps
from ..operators import bootstrap as bs, metrics as m
from ..session import read
from .catalog import query
from .ingest_queries import _r
from .views import assay, cte, r6, u_int, with_ctes


def a(sql):
    return with_ctes(sql, "assay")


REG = """sqrt(avg(power({p}-target,2))) AS rmse, avg(abs({p}-target)) AS mae, 1-sum(power({p}-target,2))/(var_pop(target)*count(*)) AS r2, corr(target,{p}) AS pearson"""


@query("MET1_regression_metrics", a(f"""SELECT lang, {r6('rmse')} AS rmse, {r6('mae')} AS mae, {r6('r2')} AS r2, {r6('pearson')} AS pearson, num_rows
FROM (SELECT lang, {REG.format(p='prediction')}, count(*) AS num_rows FROM assay GROUP BY lang)"""))
def met1(spark, sf):
    return _r(m.regression_metrics(assay(spark, sf), "target", "prediction", ["lang"]), "lang")


RANK = "(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v})-1)/2.0)"


@query("MET2_spearman", a(f"""SELECT lang, {r6('corr(a,b)')} AS spearman FROM (SELECT lang, {RANK.format(g='lang', v='round(target,1)')} AS a, {RANK.format(g='lang', v='prediction')} AS b FROM assay) GROUP BY lang"""))
def met2(spark, sf):
    df = assay(spark, sf).withColumn("target", F.round("target", 1))
    return _r(m.spearman(df, "target", "prediction", ["lang"]), "lang")


@query("MET3_auroc", a(f"""SELECT lang, {r6("(sum(r) FILTER (label=1)-p*(p+1)/2)/(p*(count(*)-p))")} AS auroc FROM (SELECT *, {RANK.format(g='lang', v='round(score,2)')} AS r, sum(label) OVER (PARTITION BY lang) AS p FROM assay) GROUP BY lang, p"""))
def met3(spark, sf):
    df = assay(spark, sf).withColumn("score", F.round("score", 2))
    return _r(m.auroc(df, "label", "score", ["lang"]), "lang")


@query("MET4_average_precision", a(f"""SELECT lang, {r6('avg(hits/pos)')} AS average_precision FROM (SELECT lang, label, sum(label) OVER w AS hits, row_number() OVER w AS pos FROM assay
 WINDOW w AS (PARTITION BY lang ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)) WHERE label=1 GROUP BY lang"""))
def met4(spark, sf):
    return _r(m.average_precision(assay(spark, sf), "label", "score", "row_id", ["lang"]), "lang")


CONF = """count(*)::double AS n, count(*) FILTER (score>=0.5 AND label=1)::double AS tp, count(*) FILTER (score>=0.5 AND label=0)::double AS fp,
 count(*) FILTER (score<0.5 AND label=1)::double AS fn, count(*) FILTER (score<0.5 AND label=0)::double AS tn"""


@query("MET5_classification_metrics", a(f"""SELECT lang, {r6('(tp+tn)/n')} AS accuracy, {r6('0.5*(tp/(tp+fn)+tn/(tn+fp))')} AS balanced_accuracy, {r6('2*tp/(2*tp+fp+fn)')} AS f1,
 {r6('tp/(tp+fp)')} AS precision, {r6('tp/(tp+fn)')} AS recall FROM (SELECT lang, {CONF} FROM assay GROUP BY lang)"""))
def met5(spark, sf):
    out = m.classification_metrics(assay(spark, sf), "label", "score", ["lang"])
    return _r(out.select("lang", "accuracy", "balanced_accuracy", "f1", "precision", "recall"), "lang")


CLIP = "greatest(1e-7,least(1-1e-7,score))"


@query("MET6_brier_log_loss", a(f"""SELECT lang, {r6(f'avg(power({CLIP}-label,2))')} AS brier, {r6(f'-avg(label*ln({CLIP})+(1-label)*ln(1-{CLIP}))')} AS log_loss,
 CASE WHEN min(label)<max(label) THEN 'ok' ELSE 'not_evaluable_single_class' END AS status FROM assay GROUP BY lang"""))
def met6(spark, sf):
    out = m.classification_metrics(assay(spark, sf), "label", "score", ["lang"])
    return _r(out.select("lang", "brier", "log_loss", "status"), "lang")


@query("MET7_pairwise_accuracy", a(f"""SELECT {r6('count(*) FILTER (a.prediction>b.prediction)::double/count(*)')} AS pairwise_accuracy, count(*) AS pairs FROM
 (SELECT round(target,2) AS t, prediction FROM assay) a JOIN (SELECT round(target,2) AS t, prediction FROM assay) b ON a.t>b.t"""))
def met7(spark, sf):
    return _r(m.pairwise_accuracy(assay(spark, sf).withColumn("target", F.round("target", 2)), "target", "prediction"))


@query("MET8_primary_metric", a(f"""SELECT lang, {r6("coalesce((sum(r) FILTER (label=1)-p*(p+1)/2)/nullif(p*(count(*)-p),0), avg(((score>=0.5)=(label=1))::int))")} AS primary_metric,
 CASE WHEN p>0 AND p<count(*) THEN 'auroc' ELSE 'balanced_accuracy' END AS primary_metric_name FROM (SELECT *, {RANK.format(g='lang', v='score')} AS r, sum(label) OVER (PARTITION BY lang) AS p FROM assay) GROUP BY lang, p"""))
def met8(spark, sf):
    df = assay(spark, sf)
    both = m.auroc(df, "label", "score", ["lang"]).join(m.classification_metrics(df, "label", "score", ["lang"]), "lang")
    value, name = m.primary_metric("classification", {n: F.col(n) for n in ("auroc", "balanced_accuracy")})
    return both.select("lang", F.round(value, 6).alias("primary_metric"), name.alias("primary_metric_name"))


# Draws over documents: unit index by md5 order, exactly as the operator numbers them.
cte("units", """SELECT unit, row_number() OVER (ORDER BY ('0x'||left(md5(unit),12))::bigint, unit)-1 AS pick, count(*) OVER () AS n
 FROM (SELECT DISTINCT doc_id::varchar AS unit FROM assay)""", ("assay",))


def draws(reps, seed):
    """Poisson(1) weight of every (replicate, unit), from the hash that the operator uses."""
    u = f"{u_int(f"'{seed}'", 'rep', 'unit')}/4294967296.0::double"
    steps = "+".join(f"(CASE WHEN u>{c!r}::double THEN 1 ELSE 0 END)" for c in poisson_steps())
    return f"""weights AS (SELECT rep, unit, ({steps})::double AS w FROM (SELECT rep, unit, {u} AS u FROM units, range({reps}) r(rep)) WHERE u>{poisson_steps()[0]!r}::double)"""


def r2_by_rep(pred, name):
    return f"""{name} AS (SELECT rep, 1-sum(w*se)/(sum(w*tt)-sum(w*t)*sum(w*t)/sum(w*n)) AS value FROM weights JOIN (SELECT doc_id::varchar AS unit, count(*) AS n, sum(target) AS t, sum(target*target) AS tt,
 sum(power({pred}-target,2)) AS se FROM assay GROUP BY doc_id) USING (unit) GROUP BY rep)"""


@query("MET9_bootstrap_interval", with_ctes(f""", {draws(200, 42)}, {r2_by_rep('prediction', 'v')}
SELECT {r6('quantile_cont(value,0.025)')} AS ci_low, {r6('quantile_cont(value,0.975)')} AS ci_high, count(value) AS valid_resamples, 'leakage_cluster' AS bootstrap_unit FROM v""", "units"))
def met9(spark, sf):
    return _r(bs.metric_interval(assay(spark, sf), "regression", "target", "prediction", "doc_id", "row_id"))


@query("MET9_bootstrap_interval_auroc", with_ctes(f""", {draws(200, 42)}, rows AS (SELECT rep, score, sum(w) FILTER (label=1) AS pw, sum(w) FILTER (label=0) AS nw FROM weights JOIN assay ON unit=doc_id::varchar GROUP BY rep, score),
 c AS (SELECT rep, coalesce(pw,0) AS pw, coalesce(nw,0) AS nw, sum(coalesce(nw,0)) OVER (PARTITION BY rep ORDER BY score ROWS UNBOUNDED PRECEDING) AS t FROM rows),
 v AS (SELECT rep, sum(pw*(t-nw/2.0))/(sum(pw)*sum(nw)) AS value FROM c GROUP BY rep)
SELECT {r6('quantile_cont(value,0.025)')} AS ci_low, {r6('quantile_cont(value,0.975)')} AS ci_high, count(value) AS valid_resamples, 'leakage_cluster' AS bootstrap_unit FROM v""", "units"))
def met9a(spark, sf):
    return _r(bs.metric_interval(assay(spark, sf), "classification", "label", "score", "doc_id", "row_id"))


@query("MET10_paired_lift", with_ctes(f""", {draws(500, 42)}, {r2_by_rep('prediction', 'a')}, {r2_by_rep('round(4*gc+2.1,6)', 'b')}
SELECT 'ok' AS status, {r6('quantile_cont(a.value-b.value,0.025)')} AS lift_low, {r6('quantile_cont(a.value-b.value,0.975)')} AS lift_high, count(*) AS valid_resamples, 'leakage_cluster' AS bootstrap_unit FROM a JOIN b USING (rep)""", "units"))
def met10(spark, sf):
    df = assay(spark, sf).withColumn("baseline", F.round(4 * F.col("gc") + 2.1, 6))
    return _r(bs.paired_lift(df, "regression", "target", "prediction", "baseline", "doc_id", "row_id"))


UE = "SELECT row_id, uncertainty AS u, abs(prediction-target) AS e FROM assay"


@query("MET11_uncertainty_audit", a(f"""SELECT count(*) AS num_rows, {r6('corr(u,e)')} AS uncertainty_abs_error_pearson, {r6('corr(ru,re)')} AS uncertainty_abs_error_spearman, {r6('avg(u)')} AS mean_uncertainty,
 {r6('avg(e)')} AS mean_abs_error, {r6('avg(abs(u-e))')} AS mean_absolute_calibration_gap, 'ok' AS status
FROM (SELECT u, e, {RANK.format(g='1', v='u')} AS ru, {RANK.format(g='1', v='e')} AS re FROM ({UE}))"""))
def met11(spark, sf):
    return _r(m.uncertainty_audit(assay(spark, sf), "target", "prediction", "uncertainty", "row_id")[0])


@query("MET11_uncertainty_bins", a(f"""SELECT bin, count(*) AS count, {r6('avg(u)')} AS mean_u, {r6('avg(e)')} AS mean_e FROM (SELECT u, e, ntile(5) OVER (ORDER BY u, row_id) AS bin FROM ({UE})) GROUP BY bin"""))
def met11b(spark, sf):
    return _r(m.uncertainty_audit(assay(spark, sf), "target", "prediction", "uncertainty", "row_id")[1])


@query("MET12_ranking_audit", a(f"""SELECT count(*) AS num_rows, 96 AS top_k, {r6('avg(target)')} AS overall_target_mean, {r6('avg(target) FILTER (rp<=96)')} AS top_k_target_mean,
 {r6('avg(target) FILTER (rp<=96)/avg(target)')} AS top_k_enrichment, max(rp) FILTER (rt=1) AS best_true_item_rank_by_prediction, {r6('corr(sa,sb)')} AS spearman
FROM (SELECT target, row_number() OVER (ORDER BY prediction DESC, row_id) AS rp, row_number() OVER (ORDER BY target DESC, row_id) AS rt, {RANK.format(g='1', v='target')} AS sa, {RANK.format(g='1', v='prediction')} AS sb FROM assay)"""))
def met12(spark, sf):
    return _r(m.ranking_audit(assay(spark, sf), "target", "prediction", "row_id", 96))


@query("MET13_curve_points", a(f"""SELECT threshold, {r6('tp/P')} AS tpr, {r6('fp/N')} AS fpr, {r6('tp/(tp+fp)')} AS precision FROM (
 SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS P, sum(q) OVER () AS N FROM (SELECT round(score,3) AS threshold, sum(label) AS p, sum(1-label) AS q FROM assay GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC))"""))
def met13(spark, sf):
    return _r(m.curve_points(assay(spark, sf).withColumn("score", F.round("score", 3)), "label", "score"), "threshold")


@query("MET14_top_overlap", a(f"""SELECT k, {r6('sum(c) OVER (ORDER BY k)/k')} AS overlap FROM (SELECT k, (SELECT 0)+coalesce(c,0) AS c FROM (SELECT unnest(range(1,(SELECT count(*) FROM assay)+1)) AS k)
 LEFT JOIN (SELECT greatest(x,y) AS k, count(*) AS c FROM (SELECT row_number() OVER (ORDER BY target DESC, row_id) AS x, row_number() OVER (ORDER BY prediction DESC, row_id) AS y FROM assay) GROUP BY 1) USING (k))"""))
def met14(spark, sf):
    return _r(m.top_overlap(assay(spark, sf), "target", "prediction", "row_id"), "k")


@query("MET15_residual_histogram", a(f"""SELECT bin::int AS bin, count(*) AS rows, {r6('any_value(lo+w*bin)')} AS "left" FROM (SELECT lo, w, least(floor((r-lo)/w), b-1) AS bin FROM (
 SELECT r, lo, b, (hi-lo)/b AS w FROM (SELECT round(prediction-target,6) AS r, min(round(prediction-target,6)) OVER () AS lo, max(round(prediction-target,6)) OVER () AS hi, greatest(6,least(20,floor(2*sqrt(count(*) OVER ())))) AS b FROM assay))) GROUP BY bin"""))
def met15(spark, sf):
    df = assay(spark, sf).select(F.lit(0.0).alias("target"), F.round(F.col("prediction") - F.col("target"), 6).alias("prediction"))
    return _r(m.residual_histogram(df, "target", "prediction"))


# 2.8015852181129683 = normal quantiles of 0.975 and 0.8 added
@query("MET16_sample_size", "SELECT c_custkey, greatest(2,ceil(power(2.8015852181129683/(abs(c_acctbal)/10000+0.05),2)))::bigint AS rows_needed FROM customer")
def met16(spark, sf):
    """One planning row per observed customer balance: effect from the data, usual alpha and power."""
    df = read(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000 + 0.05).alias("effect"),
                                           F.lit(0.05).alias("alpha"), F.lit(0.8).alias("power"))
    return df.select("c_custkey", m.sample_size("effect", "alpha", "power").alias("rows_needed"))


@query("MET17_comparison_rows", a(f"""SELECT row_id, sha256(sequence) AS sequence_hash, doc_id AS leakage_cluster, target, prediction AS model_prediction, 'gc_length' AS baseline_name, {r6('4*gc+2.1')} AS baseline_prediction FROM assay"""))
def met17(spark, sf):
    df = assay(spark, sf)
    model = df.select("row_id", F.sha2("sequence", 256).alias("sequence_hash"), F.col("doc_id").alias("leakage_cluster"), "target",
                      F.col("prediction").alias("model_prediction"))
    base = df.select("row_id", F.lit("gc_length").alias("baseline_name"), F.round(4 * F.col("gc") + 2.1, 6).alias("baseline_prediction"))
    return model.join(base, "row_id")


@query("MET18_model_against_baselines", with_ctes(f""", {draws(200, 42)}, {r2_by_rep('prediction', 'v')}
SELECT 'model' AS name, (SELECT {r6('1-sum(power(prediction-target,2))/(var_pop(target)*count(*))')} FROM assay) AS primary_metric, {r6('quantile_cont(value,0.025)')} AS ci_low, {r6('quantile_cont(value,0.975)')} AS ci_high FROM v
UNION ALL SELECT 'gc_length', {r6('1-sum(power(round(4*gc+2.1,6)-target,2))/(var_pop(target)*count(*))')}, NULL, NULL FROM assay""", "units"))
def met18(spark, sf):
    df = assay(spark, sf).withColumn("base", F.round(4 * F.col("gc") + 2.1, 6))
    ci = bs.metric_interval(df, "regression", "target", "prediction", "doc_id", "row_id").select("ci_low", "ci_high")
    model = m.regression_metrics(df, "target", "prediction").select(F.lit("model").alias("name"), F.col("r2").alias("primary_metric")).join(ci)
    null = F.lit(None).cast("double")
    base = m.regression_metrics(df, "target", "base").select(F.lit("gc_length").alias("name"), F.col("r2").alias("primary_metric"),
                                                            null.alias("ci_low"), null.alias("ci_high"))
    return _r(model.union(base), "name")


@query("AGG7_replicate_noise", f"""WITH g AS (SELECT user_id, count(*) AS c, var_pop(value) AS v FROM events GROUP BY user_id)
SELECT count(*) AS unique_candidates, count(*) FILTER (c>1) AS replicated_candidates, {r6('avg(v) FILTER (c>1)')} AS within_candidate_variance, {r6('(SELECT var_pop(value) FROM events)')} AS total_variance,
 {r6('greatest(0,least(1,1-avg(v) FILTER (c>1)/(SELECT var_pop(value) FROM events)))')} AS approximate_reliability FROM g""")
def agg7(spark, sf):
    return _r(m.replicate_noise(read(spark, sf, "events"), "user_id", "value"))


SL = "SELECT '{0}' AS \"column\", {0}::varchar AS level, count(*) AS n, {1} AS mae, {2} AS rmse, {3} AS bias, count(*)<5 AS low_n FROM assay GROUP BY {0}"


@query("AGG8_slice_summary", a(" UNION ALL ".join(SL.format(c, r6("avg(abs(prediction-target))"), r6("sqrt(avg(power(prediction-target,2)))"), r6("avg(prediction-target)")) for c in ("source", "lang", "label"))))
def agg8(spark, sf):
    return _r(m.slice_summary(assay(spark, sf), ["source", "lang", "label", "doc_id"], "target", "prediction"), "column", "level")
