"""Candidate scoring, ranking, constraints, plates; one pool per document source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import candidates as c, ordered, plates, similarity as sim
from ..session import settle
from .catalog import query
from .ingest_queries import _r
from .views import RC, assay, benchmark_seqs, r6, talk_seqs, with_ctes


def a(sql):
    return with_ctes(sql, "assay")


@query("CAND1_acquisition_ucb", a(f"SELECT row_id, {r6('prediction+1.5*greatest(uncertainty,1e-9)', 8)} AS ucb, {r6('prediction')} AS mean FROM assay"))
def cand1(spark, sf):
    df = assay(spark, sf)
    return df.select("row_id", F.round(c.acquisition("prediction", "uncertainty", "ucb", 1.5)[1], 8).alias("ucb"),
                     F.round(c.acquisition("prediction", "uncertainty", "mean")[1], 6).alias("mean"))


@query("CAND1_expected_improvement")
def cand1e(spark, sf):
    df = assay(spark, sf).join(c.incumbent(assay(spark, sf), "target", ["source"]), "source")
    shown, _ = c.acquisition("prediction", "uncertainty", "ei", incumbent=F.col("incumbent"))
    return df.select("row_id", F.round(shown, 6).alias("ei"))


@query("CAND2_minimize_scores", a(f"SELECT row_id, {r6('prediction-1.5*uncertainty', 8)} AS shown, {r6('-(prediction-1.5*uncertainty)', 8)} AS ranking FROM assay"))
def cand2(spark, sf):
    shown, ranking = c.acquisition("prediction", "uncertainty", "ucb", 1.5, minimize=True)
    return assay(spark, sf).select("row_id", F.round(shown, 8).alias("shown"), F.round(ranking, 8).alias("ranking"))


@query("CAND3_external_scores", a(f"""SELECT row_id, CASE WHEN done THEN 'used_declared_uncertainty' WHEN un IS NULL THEN 'missing_or_invalid_prediction_only' ELSE 'pool_incomplete_prediction_only' END AS uncertainty_status,
 {r6('CASE WHEN done THEN prediction+un ELSE prediction END')} AS acquisition_score, CASE WHEN done THEN 'prediction_plus_declared_uncertainty' ELSE 'prediction_only' END AS acquisition_policy
FROM (SELECT *, bool_and(un IS NOT NULL) OVER (PARTITION BY source) AS done FROM (SELECT *, CASE WHEN doc_id%40<>7 THEN uncertainty END AS un FROM assay))"""))
def cand3(spark, sf):
    df = assay(spark, sf).withColumn("un", F.when(F.col("doc_id") % 40 != 7, F.col("uncertainty")))
    out = c.external_scores(df, "prediction", "un", "predictive_standard_deviation", 1.0, "source")
    return _r(out.select("row_id", "uncertainty_status", "acquisition_score", "acquisition_policy"), "row_id")


@query("CAND4_simulation_utility", a(f"SELECT row_id, {r6('-prediction+0.4*uncertainty', 9)} AS utility FROM assay"))
def cand4(spark, sf):
    return assay(spark, sf).select("row_id", F.round(c.utility("prediction", "uncertainty", 0.4, "minimize"), 9).alias("utility"))


@query("CAND5_observed_incumbent", a("SELECT source, max(target) AS best_high, min(target) AS best_low FROM assay GROUP BY source"))
def cand5(spark, sf):
    df = assay(spark, sf)
    up = c.incumbent(df, "target", ["source"]).withColumnRenamed("incumbent", "best_high")
    return up.join(c.incumbent(df, "target", ["source"], True).withColumnRenamed("incumbent", "best_low"), "source")


@query("CAND6_greedy_diverse_ranking")
def cand6(spark, sf):
    return _r(c.greedy_diverse(assay(spark, sf), "source", "row_id", "sequence", "prediction", top_k=96), "pool", "id", "rank")


def _nearest(spark, sf):
    train = talk_seqs(spark, sf).select("train_id", F.col("sequence").alias("train_seq"))
    cand = benchmark_seqs(spark, sf).select("cand_id", F.col("sequence").alias("cand_seq"))
    return sim.nearest_training(cand, train), cand


KM = ("CASE WHEN length({0})<8 THEN [{0}] ELSE list_distinct(list_transform(range(1,length({0})-6), lambda i: least(substr({0},i,8), " + RC.format("substr({0},i,8)") + "))) END")
NEAR = f"""c AS (SELECT cand_id, sequence AS cs, {KM.format('sequence')} AS ck FROM benchmark_seqs), t AS (SELECT train_id, sequence AS ts, {KM.format('sequence')} AS tk FROM talk_seqs),
 s AS (SELECT cand_id, train_id, cs, ts, len(list_intersect(ck,tk))::double/(len(ck)+len(tk)-len(list_intersect(ck,tk))) AS similarity FROM c, t),
 k9 AS (SELECT *, levenshtein(cs,ts) AS edit_distance FROM s QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY similarity DESC, train_id)<=9),
 near AS (SELECT cand_id, cs, train_id, similarity, edit_distance, row_number() OVER (PARTITION BY cand_id ORDER BY similarity DESC, edit_distance, train_id) AS neighbor FROM k9)"""


def n(sql):
    return with_ctes(f", {NEAR} {sql}", "benchmark_seqs", "talk_seqs")


@query("JOIN11_nearest_training", n(f"SELECT cand_id, neighbor, train_id, {r6('similarity')} AS similarity, edit_distance FROM near WHERE neighbor<=3"))
def join11(spark, sf):
    return _r(_nearest(spark, sf)[0], "cand_id", "neighbor", "train_id")


STATUS = """CASE WHEN similarity<0.08 AND edit_distance::double/length(cs)>0.35 THEN 'outside_training_distribution' WHEN similarity<0.20 OR edit_distance::double/length(cs)>0.25 THEN 'sparse_training_neighborhood'
 ELSE 'near_training_distribution' END"""


@query("CAND7_training_distribution", n(f"SELECT cand_id, {STATUS} AS status FROM near WHERE neighbor=1"))
def cand7(spark, sf):
    near, cand = _nearest(spark, sf)
    best = cand.join(near.where("neighbor = 1"), "cand_id", "left")
    return best.select("cand_id", c.distribution_status("similarity", "edit_distance", F.length("cand_seq")).alias("status"))


RISK = ("list_sort(list_distinct(list_filter(['model_lift_not_proven', CASE WHEN uncertainty>=quantile_cont(uncertainty,0.75) OVER (PARTITION BY source) THEN 'high_uncertainty' END,"
        " CASE WHEN gc<0.42 THEN 'sparse_training_neighborhood' END], lambda x: x IS NOT NULL)))")


@query("CAND8_explanations", a(f"""SELECT row_id, array_to_string(f,';') AS risk_flags, 'prediction='||printf('%.4f',prediction)||'; uncertainty='||printf('%.4f',uncertainty)||'; acquisition='||printf('%.4f',prediction)||'; cluster=1; acquisition_policy=prediction_only; diversity_policy=kmer_cosine; training_status='||st||'; warnings='||array_to_string(f,',') AS ranking_reason
FROM (SELECT *, CASE WHEN gc<0.42 THEN 'sparse_training_neighborhood' ELSE 'near_training_distribution' END AS st, {RISK} AS f FROM assay)"""))
def cand8(spark, sf):
    df = assay(spark, sf).withColumns({
        "rank": F.lit(1), "acquisition_score": F.col("prediction"), "acquisition_policy": F.lit("prediction_only"),
        "diversity_policy": F.lit("kmer_cosine"), "uncertainty_status": F.lit("used_declared_uncertainty"),
        "st": F.when(F.col("gc") < 0.42, "sparse_training_neighborhood").otherwise("near_training_distribution")})
    return c.explain(df, "source", "st", ["model_lift_not_proven"]).select("row_id", F.array_join("risk_flags", ";").alias("risk_flags"), "ranking_reason")


RUNS = "coalesce(list_max(list_transform(regexp_extract_all(sequence,'A+|C+|G+|T+'), lambda x: length(x))),0)"
GCS = "(length(sequence)-length(replace(replace(sequence,'G',''),'C','')))::double/length(sequence)"


@query("CAND9_synthesis_filter", with_ctes(f"""SELECT cand_id, {r6('gc')} AS gc, novelty, CASE WHEN gc<0.4 OR gc>0.6 THEN 'gc_out_of_range' WHEN run>5 THEN 'homopolymer_too_long' WHEN contains(sequence,'GGTCTC') THEN 'forbidden_motif'
 WHEN novelty<120 THEN 'too_close_to_training' END AS filter_reason FROM (SELECT b.cand_id, b.sequence, any_value({GCS.replace('sequence', 'b.sequence')}) AS gc, any_value({RUNS.replace('(sequence', '(b.sequence')}) AS run, min(levenshtein(b.sequence,t.sequence)) AS novelty
 FROM benchmark_seqs b, (SELECT DISTINCT sequence FROM talk_seqs) t GROUP BY b.cand_id, b.sequence)""", "benchmark_seqs", "talk_seqs"))
def cand9(spark, sf):
    out = c.synthesis_filter(benchmark_seqs(spark, sf), "cand_id", "sequence", talk_seqs(spark, sf), "sequence", (0.4, 0.6), 5, ("GGTCTC",), 120)
    return _r(out.select("cand_id", "gc", "novelty", "filter_reason"), "cand_id")


@query("AGG13_filter_reason_counts", with_ctes(f"""SELECT CASE WHEN {GCS}<0.4 OR {GCS}>0.6 THEN 'gc_out_of_range' WHEN {RUNS}>5 THEN 'homopolymer_too_long' ELSE 'passed' END AS reason, count(*) AS rows FROM constructs GROUP BY 1""", "constructs"))
def agg13(spark, sf):
    df = assay(spark, sf)
    why = F.when((F.col("gc") < 0.4) | (F.col("gc") > 0.6), "gc_out_of_range").when(seq.max_homopolymer("sequence") > 5, "homopolymer_too_long").otherwise("passed")
    return df.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("CAND10_constraint_preview", a(f"""SELECT row_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN gc<0.42 THEN 'GC below minimum' END, CASE WHEN gc>0.58 THEN 'GC above maximum' END, CASE WHEN {RUNS}>5 THEN 'Homopolymer exceeds limit' END], lambda x: x IS NOT NULL),'; '),''),'Eligible under sequence constraints') AS preview FROM assay"""))
def cand10(spark, sf):
    return assay(spark, sf).select("row_id", c.constraint_preview("gc", seq.max_homopolymer("sequence"), 0.42, 0.58, 5).alias("preview"))


@query("CAND15_rank_and_funnel", a("""SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, row_id) AS rank, count(*) OVER (PARTITION BY source) AS generated, count(*) FILTER (gc<=0.55) OVER (PARTITION BY source) AS eligible FROM assay"""))
def cand15(spark, sf):
    df = settle(assay(spark, sf).select("source", "row_id", "prediction", "gc"))
    return c.ranked(df, "source", "prediction", "row_id").join(c.funnel(df, "source", F.col("gc") <= 0.55), "source").select(
        "source", "row_id", "rank", "generated", "eligible")


@query("CAND17_top_candidates", a("""SELECT source, row_id, rank, CASE WHEN uncertainty>0.4 THEN 'high uncertainty' ELSE 'ranked by policy' END AS reason FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, row_id) AS rank FROM assay) WHERE rank<=10"""))
def cand17(spark, sf):
    df = assay(spark, sf).withColumn("note", F.when(F.col("uncertainty") > 0.4, "high uncertainty"))
    top = ordered.top_k(df, 10, [F.desc("prediction"), F.col("row_id")], ["source"], F.col("row_id"))
    return top.select("source", "row_id", "rank", F.coalesce("note", F.lit("ranked by policy")).alias("reason"))


@query("CAND18_risk_display", a("""SELECT row_id, len(f) AS risk_count, coalesce(f[1],'none') AS primary_risk FROM (SELECT row_id, list_filter([CASE WHEN gc<0.45 THEN 'low_gc' END, CASE WHEN uncertainty>0.4 THEN 'high_uncertainty' END], lambda x: x IS NOT NULL) AS f FROM assay)"""))
def cand18(spark, sf):
    from ..functions.values import reasons

    df = assay(spark, sf).withColumn("risk_flags_json", F.to_json(reasons((F.col("gc") < 0.45, "low_gc"), (F.col("uncertainty") > 0.4, "high_uncertainty"))))
    f = F.from_json("risk_flags_json", "array<string>")
    return df.select("row_id", F.size(f).alias("risk_count"), F.coalesce(F.get(f, F.lit(0)), F.lit("none")).alias("primary_risk"))


# --- plates -----------------------------------------------------------------------

@query("PLATE1_well_catalogue", """WITH p AS (SELECT DISTINCT source AS pool FROM documents)
SELECT pool, chr((65+r)::int)||c AS well FROM p, range(8) t(r), range(1,13) s(c) WHERE r BETWEEN 1 AND 6 AND c BETWEEN 2 AND 11""")
def plate1(spark, sf):
    pools = assay(spark, sf).select(F.col("source").alias("pool")).distinct()
    grid = pools.select("pool", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("pos"))
    return grid.join(F.broadcast(plates.wells(spark, 96, True)), "pos").select("pool", "well")


@query("PLATE2_objective_score", a(f"SELECT row_id, {r6('0.7*prediction-0.3*uncertainty', 9)} AS weighted, {r6('prediction')} AS plain FROM assay"))
def plate2(spark, sf):
    df = assay(spark, sf).withColumn("acquisition_score", F.col("prediction"))
    return df.select("row_id", F.round(plates.objective_score(df, {"prediction": 0.7, "uncertainty": -0.3}), 9).alias("weighted"),
                     F.round(plates.objective_score(df), 6).alias("plain"))


@query("PLATE3_quota_selection", a("""SELECT pool, id, pick FROM (SELECT source AS pool, row_id AS id, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, row_id) AS pick FROM (
 SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY prediction DESC, row_id) AS q FROM assay) WHERE q<=20) WHERE pick<=60"""))
def plate3(spark, sf):
    return plates.select_batch(assay(spark, sf), "source", "row_id", "prediction", 60, "lang", 20).select("pool", "id", "pick")


# one row of a pool a step: taken if its family and the plate have room and its cost is left
@query("PLATE3_budget_selection", with_ctes(""", f AS (SELECT source AS pool, row_id AS id, lang, 1+length(sequence)/100.0::double AS cost, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, row_id) AS i FROM assay),
 w AS (SELECT source AS pool, 0::bigint AS i, NULL::bigint AS id, 0::double AS cost, 0 AS pick, 0::double AS spent, []::varchar[] AS held, false AS took FROM assay GROUP BY source
  UNION ALL SELECT pool, i, id, cost, pick+fits::int, spent + CASE WHEN fits THEN cost ELSE 0 END, CASE WHEN fits THEN list_append(held, lang) ELSE held END, fits
  FROM (SELECT f.pool, f.i, f.id, f.cost, f.lang, w.pick, w.spent, w.held, w.spent+f.cost<=80 AND len(list_filter(w.held, lambda x: x=f.lang))<20 AS fits FROM w JOIN f ON f.pool=w.pool AND f.i=w.i+1 WHERE w.pick<60))
SELECT pool, id, pick, round(cost,6) AS cost FROM w WHERE took""", "assay", recursive=True))
def plate3b(spark, sf):
    df = assay(spark, sf).withColumn("cost", 1 + F.length("sequence") / 100)
    return plates.select_batch(df, "source", "row_id", "prediction", 60, "lang", 20, "cost", 80.0).select("pool", "id", "pick", F.round("cost", 6).alias("cost"))


@query("PLATE4_batch_status", a("""SELECT source AS pool, least(90, count(*)) AS selected_candidates, CASE WHEN count(*) FILTER (coalesce(trim(CASE WHEN gc<0.3 THEN '' ELSE lang END),'')='')>0 THEN 'required candidate column is missing or blank: tag' ELSE '' END AS violations,
 CASE WHEN count(*) FILTER (gc<0.3)=0 THEN 'approved' ELSE 'draft' END AS status FROM assay GROUP BY source"""))
def plate4(spark, sf):
    df = assay(spark, sf).withColumn("tag", F.when(F.col("gc") < 0.3, "").otherwise(F.col("lang")))
    picks = plates.select_batch(df, "source", "row_id", "prediction", 90)
    out = plates.batch_status(df, picks, plates.missing_columns(df, "source", ["tag"]), "source", "row_id", 90, "approver-1")
    return out.select("pool", "selected_candidates", F.array_join("violations", " | ").alias("violations"), "status")


@query("PLATE5_well_assignment", a("""SELECT source AS pool, 2*least(45,count(*))+6 AS wells, 2*least(45,count(*))+6 AS distinct_wells, 6 AS controls FROM assay GROUP BY source"""))
def plate5(spark, sf):
    picks = plates.select_batch(assay(spark, sf), "source", "row_id", "prediction", 45)
    laid = plates.assign_wells(picks, 96, {"positive_control": 2, "negative_control": 2, "blank_control": 2}, replicates=2)
    return laid.groupBy("pool").agg(F.count(F.lit(1)).alias("wells"), F.countDistinct("well").alias("distinct_wells"),
                                    F.count_if(F.col("role") != "candidate").alias("controls"))


ROLES = """SELECT *, row_number() OVER (PARTITION BY source ORDER BY prediction DESC, row_id) AS a FROM assay"""
ROLE_SQL = f"""r1 AS ({ROLES}), r2 AS (SELECT *, row_number() OVER (PARTITION BY source, a<=24 ORDER BY uncertainty DESC, row_id) AS b FROM r1),
 r3 AS (SELECT *, row_number() OVER (PARTITION BY source, (a<=24 OR b<=10) ORDER BY gc, row_id) AS c FROM r2),
 roles AS (SELECT source AS pool, row_id AS id, CASE WHEN a<=24 THEN 'exploit_top_prediction' WHEN b<=10 THEN 'explore_high_uncertainty' ELSE 'diversity_representative' END AS role, CASE WHEN a<=24 THEN a WHEN b<=10 THEN 24+b ELSE 34+c END AS pick FROM r3)"""


@query("PLATE6_role_selection", a(f", {ROLE_SQL} SELECT * FROM roles WHERE pick<=40"))
def plate6(spark, sf):
    return plates.role_selection(assay(spark, sf), "source", "row_id", "prediction", "uncertainty", "gc", 40)


@query("PLATE7_plate_plan", a(f""", {ROLE_SQL} SELECT pool, role, count(*) AS wells FROM (SELECT pool, role FROM roles WHERE pick<=40 UNION ALL SELECT source, unnest(['positive_control','negative_control','blank_control','process_control','positive_control','negative_control']) FROM (SELECT DISTINCT source FROM assay)) GROUP BY pool, role"""))
def plate7(spark, sf):
    roles = plates.role_selection(assay(spark, sf), "source", "row_id", "prediction", "uncertainty", "gc", 40)
    return plates.plate_plan(roles, 96, 6, 13).groupBy("pool", "role").agg(F.countDistinct("well").alias("wells"))


@query("PLATE8_plate_source", a(f"""SELECT row_id, sequence_id AS design_id, {r6('prediction')} AS assay_prediction, {r6('uncertainty')} AS assay_uncertainty, true AS passes_basic_filters, {r6('gc')} AS gc_fraction, {RUNS} AS max_homopolymer FROM assay"""))
def plate8(spark, sf):
    df = plates.plate_source(assay(spark, sf).select("row_id", "sequence_id", "sequence", "prediction", "uncertainty"))
    return _r(df.select("row_id", "design_id", "assay_prediction", "assay_uncertainty", "passes_basic_filters", "gc_fraction", "max_homopolymer"), "row_id")
