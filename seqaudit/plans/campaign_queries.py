"""Campaign, registry and streaming queries: parts are candidates, line items outcomes, order months rounds."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import campaigns as ca, registry as rg
from ..session import read
from .catalog import query
from .corpus_queries import _scratch
from .ingest_queries import _r
from .views import cte, r6, raw_assay, with_ctes

cte("measured", """SELECT 'c'||left(o_orderpriority,1)||'-r'||lpad((year(o_orderdate)*12+month(o_orderdate)-23700)::varchar,3,'0') AS round_id, 'c'||left(o_orderpriority,1) AS campaign_id,
 (year(o_orderdate)*12+month(o_orderdate)-23700)::int AS round_number, l_partkey::varchar AS candidate_id, l_orderkey||'-'||l_linenumber AS replicate, l_quantity AS measured_value,
 CASE WHEN l_linenumber<>3 THEN l_extendedprice END AS cost, l_linestatus, l_orderkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey""")
cte("selections", """SELECT DISTINCT round_id, campaign_id, round_number, candidate_id, p_retailprice AS prediction, CASE WHEN campaign_id IN ('c1','c3','c5') THEN 'maximize' ELSE 'minimize' END AS direction
 FROM measured JOIN part ON p_partkey::varchar=candidate_id""", ("measured",))
cte("outcomes", "SELECT * FROM measured WHERE l_linestatus='F'", ("measured",))
cte("held", """SELECT s.*, o.m, o.c, o.reps FROM selections s LEFT JOIN (SELECT round_id, candidate_id, avg(measured_value) AS m, sum(coalesce(cost,0)) AS c, count(*) AS reps FROM outcomes GROUP BY 1,2) o USING (round_id, candidate_id)""", ("selections", "outcomes"))


def measured(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus")
    number = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 23700).cast("int")
    campaign = F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(campaign, F.lit("-r"), F.lpad(number.cast("string"), 3, "0")).alias("round_id"), campaign.alias("campaign_id"),
        number.alias("round_number"), F.col("l_partkey").cast("string").alias("candidate_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("replicate"), F.col("l_quantity").alias("measured_value"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("cost"), "l_linestatus", "l_orderkey")


def selections(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_retailprice").alias("prediction"))
    s = measured(spark, sf).select("round_id", "campaign_id", "round_number", "candidate_id").distinct().join(part, "candidate_id")
    return s.withColumn("direction", F.when(F.col("campaign_id").isin("c1", "c3", "c5"), "maximize").otherwise("minimize"))


def outcomes(spark, sf):
    return measured(spark, sf).where("l_linestatus = 'F'")


def _summary(spark, sf):
    return ca.summarize_rounds(selections(spark, sf), outcomes(spark, sf), ["campaign_id", "round_number", "round_id"], "direction")


SUM = f"""SELECT round_id, any_value(campaign_id) AS campaign_id, any_value(round_number) AS round_number, count(*) AS selected_candidates, count(m) AS measured_candidates, coalesce(sum(reps),0)::bigint AS measurement_rows, count(m)::double/count(*) AS coverage,
 avg(m) AS observed_mean, CASE WHEN any_value(direction)='maximize' THEN max(m) ELSE min(m) END AS observed_best, coalesce(sum(c),0) AS total_reported_cost FROM held GROUP BY round_id"""


def m(sql):
    return with_ctes(sql, "held")


@query("JOIN13_selections_with_outcomes", m("SELECT s.round_id, s.candidate_id, o.replicate, o.measured_value FROM selections s LEFT JOIN outcomes o ON o.round_id=s.round_id AND o.candidate_id=s.candidate_id"))
def join13(spark, sf):
    o = outcomes(spark, sf).select("round_id", "candidate_id", "replicate", "measured_value")
    return selections(spark, sf).select("round_id", "candidate_id").join(o, ["round_id", "candidate_id"], "left")


@query("CAMP3_round_summaries", m(f"""SELECT round_id, selected_candidates, measured_candidates, measurement_rows, {r6('coverage')} AS coverage, {r6('observed_mean')} AS observed_mean, observed_best, {r6('total_reported_cost', 2)} AS total_reported_cost FROM ({SUM})"""))
def camp3(spark, sf):
    s = _summary(spark, sf)
    return s.select("round_id", "selected_candidates", "measured_candidates", "measurement_rows", F.round("coverage", 6).alias("coverage"),
                    F.round("observed_mean", 6).alias("observed_mean"), "observed_best", F.round("total_reported_cost", 2).alias("total_reported_cost"))


AVGR = "(rank() OVER (PARTITION BY round_id ORDER BY {0}) + (count(*) OVER (PARTITION BY round_id, {0})-1)/2.0)"


@query("CAMP3_round_spearman", m(f"""SELECT round_id, {r6('CASE WHEN count(*)>1 AND stddev_pop(a)>1e-12 AND stddev_pop(b)>1e-12 THEN corr(a,b) END')} AS rho FROM (SELECT round_id, {AVGR.format('prediction')} AS a, {AVGR.format('m')} AS b FROM held WHERE m IS NOT NULL) GROUP BY round_id"""))
def camp3s(spark, sf):
    return _summary(spark, sf).where("measured_candidates > 0").select("round_id", F.round("prediction_outcome_spearman", 6).alias("rho"))


@query("CAMP4_top_quartile_hits", m(f"""SELECT round_id, any_value(lim) AS threshold, {r6("count(*) FILTER (CASE WHEN direction='maximize' THEN m>=lim ELSE m<=lim END)::double/count(*)")} AS hit_rate FROM (
 SELECT *, max(CASE WHEN pos=n//4+1 THEN m END) OVER (PARTITION BY round_id) AS lim FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY CASE WHEN direction='maximize' THEN -m ELSE m END, candidate_id) AS pos, count(*) OVER (PARTITION BY round_id) AS n FROM held WHERE m IS NOT NULL)) GROUP BY round_id"""))
def camp4(spark, sf):
    s = _summary(spark, sf).where("descriptive_hit_rate is not null")
    return s.select("round_id", F.col("descriptive_top_quartile_threshold").alias("threshold"), F.round("descriptive_hit_rate", 6).alias("hit_rate"))


@query("AGG19_round_costs", m(f"SELECT round_id, {r6('total_reported_cost', 2)} AS cost, {r6('coverage')} AS coverage FROM ({SUM})"))
def agg19(spark, sf):
    return _summary(spark, sf).select("round_id", F.round("total_reported_cost", 2).alias("cost"), F.round("coverage", 6).alias("coverage"))


@query("CAMP5_round_changes", m(f"SELECT round_id, {r6('observed_mean-lag(observed_mean IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY round_number)')} AS change FROM ({SUM})"))
def camp5(spark, sf):
    return ca.compare_rounds(_summary(spark, sf), "campaign_id", "round_number").select("round_id", F.round("mean_change_from_previous", 6).alias("change"))


@query("CAMP1_registered_selection", m("""SELECT round_id, candidate_id, row_number() OVER (PARTITION BY round_id ORDER BY candidate_id::bigint) AS rank, sha256('AC'||candidate_id) AS sequence_hash FROM selections"""))
def camp1(spark, sf):
    s = selections(spark, sf).withColumns({"sequence": F.concat(F.lit("AC"), "candidate_id"), "at": F.col("candidate_id").cast("bigint")})
    return ca.register_round(s.select("round_id", "candidate_id", "sequence", "at"), "round_id", "candidate_id", "at")[0].select("round_id", "candidate_id", "rank", "sequence_hash")


@query("CAMP1_selection_problems", """SELECT p_brand AS round_id, p_name AS candidate_id, 'duplicate identifier' AS problem FROM part GROUP BY p_brand, p_name HAVING count(*)>1""")
def camp1p(spark, sf):
    df = read(spark, sf, "part").select(F.col("p_brand").alias("round_id"), "p_name", "p_partkey")
    return ca.register_round(df, "round_id", "p_name", "p_partkey")[1]


BADO = "SELECT round_id, CASE WHEN l_orderkey%50=0 THEN 'x'||candidate_id ELSE candidate_id END AS candidate_id, replicate, CASE WHEN l_orderkey%30=1 THEN 'n.a.' ELSE measured_value::varchar END AS measured_value, l_orderkey%20 AS measured_at FROM outcomes"


def _bad_outcomes(spark, sf):
    k = F.col("l_orderkey")
    return outcomes(spark, sf).select(
        "round_id", F.when(k % 50 == 0, F.concat(F.lit("x"), "candidate_id")).otherwise(F.col("candidate_id")).alias("candidate_id"), "replicate",
        F.when(k % 30 == 1, "n.a.").otherwise(F.col("measured_value").cast("string")).alias("measured_value"), (k % 20).alias("measured_at"))


@query("CAMP2_outcome_problems", m(f"""SELECT problem, count(*) AS rows FROM (SELECT CASE WHEN candidate_id LIKE 'x%' THEN 'outside the locked selection' WHEN measured_value='n.a.' THEN 'invalid numeric outcome' WHEN measured_at<=2 THEN 'not later than the selection' END AS problem FROM ({BADO})) WHERE problem IS NOT NULL GROUP BY problem"""))
def camp2(spark, sf):
    rounds = selections(spark, sf).select("round_id").distinct().withColumn("selected_at", F.lit(2))
    out = ca.outcome_problems(_bad_outcomes(spark, sf), selections(spark, sf), rounds, ["round_id", "candidate_id"])
    return out.where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


@query("JOIN15_outcomes_outside_selection", m(f"SELECT DISTINCT round_id, candidate_id FROM ({BADO}) WHERE candidate_id LIKE 'x%'"))
def join15(spark, sf):
    return _bad_outcomes(spark, sf).join(selections(spark, sf), ["round_id", "candidate_id"], "left_anti").select("round_id", "candidate_id").distinct()


@query("CAMP2_outcome_upsert", """WITH o AS (SELECT l_partkey, l_suppkey, l_quantity, l_orderkey*10+l_linenumber AS seq_no, l_returnflag FROM lineitem), n AS (SELECT l_partkey, l_suppkey, arg_max(l_quantity, seq_no) AS l_quantity FROM o WHERE l_returnflag='R' GROUP BY 1,2),
 p AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM o WHERE l_returnflag='A' GROUP BY 1,2)
SELECT l_partkey, l_suppkey, coalesce(n.l_quantity,p.l_quantity) AS l_quantity FROM p FULL JOIN n USING (l_partkey, l_suppkey)""")
def camp2u(spark, sf):
    li = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    old = li.where("l_returnflag = 'A'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    return ca.upsert(old, li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "at")


# --- audit chain ------------------------------------------------------------------

def audit_events(spark, sf):
    e = read(spark, sf, "events")
    text = lambda c: F.col(c).cast("string")
    return e.select(
        "event_id", "user_id", F.concat(F.lit("e"), text("event_id")).alias("eid"), F.lit("2024-01-01T00:00:00+00:00").alias("occurred_at"),
        F.lit("cli").alias("actor"), F.col("event_type").alias("action"), F.lit("round").alias("resource_type"),
        F.concat(F.lit("c"), text("user_id"), F.lit("-r001")).alias("resource_id"), F.concat(F.lit('{"v":'), text("event_id"), F.lit("}")).alias("details_json"))


BODY = """'{{"action":"'||event_type||'","actor":"cli","details":{{"v":'||event_id||'}},"event_id":"e'||event_id||'","occurred_at":"2024-01-01T00:00:00+00:00","previous_hash":"'||{0}||'","resource_id":"c'||user_id||'-r001","resource_type":"round"}}'"""
CHAIN = f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 c AS (SELECT user_id, event_id, n, repeat('0',64) AS previous_hash, sha256({BODY.format("repeat('0',64)")}) AS event_hash FROM o WHERE n=1
  UNION ALL SELECT o.user_id, o.event_id, o.n, c.event_hash, sha256({BODY.format('c.event_hash').replace('event_type', 'o.event_type').replace('||event_id||', '||o.event_id||').replace('||user_id||', '||o.user_id||')}) FROM c JOIN o ON o.user_id=c.user_id AND o.n=c.n+1)"""


def _chain(spark, sf):
    e = audit_events(spark, sf).withColumnRenamed("event_id", "at").withColumnRenamed("eid", "event_id")
    return ca.build_chain(e, "user_id", "at")


@query("CAMP6_built_chain", f"WITH RECURSIVE {CHAIN} SELECT event_id AS at, previous_hash, event_hash FROM c")
def camp6(spark, sf):
    return _chain(spark, sf).select("at", "previous_hash", "event_hash")


@query("CAMP6_chain_verification", "SELECT event_id AS at, event_id%97=0 AS invalid FROM events")
def camp6v(spark, sf):
    e = _chain(spark, sf).withColumn("details_json", F.when(F.col("at") % 97 == 0, '{"v":"changed"}').otherwise(F.col("details_json")))
    return ca.verify_chain(e, "at", ["user_id"]).select("at", "invalid")


@query("CAMP7_prospective_protocol", """SELECT 'r'||o_orderkey AS protocol_identifier, sha256('s'||o_orderkey) AS selection_manifest_sha256, sha256('o'||o_orderkey) AS outcome_data_sha256 FROM orders WHERE o_orderstatus='F'""")
def camp7(spark, sf):
    k = F.col("o_orderkey").cast("string")
    done = F.col("o_orderstatus") == "F"
    rounds = read(spark, sf, "orders").select(
        F.concat(F.lit("r"), k).alias("round_id"), F.col("o_orderdate").alias("selected_at"), F.lit("sel.csv").alias("selection_path"),
        F.sha2(F.concat(F.lit("s"), k), 256).alias("selection_sha256"), F.when(done, "out.csv").alias("outcome_path"),
        F.when(done, F.sha2(F.concat(F.lit("o"), k), 256)).alias("outcome_sha256"), F.when(done, F.col("o_orderdate")).alias("measured_at"))
    return ca.prospective_protocol(rounds).select("protocol_identifier", "selection_manifest_sha256", "outcome_data_sha256")


@query("CAMP8_campaign_export", "SELECT CASE WHEN user_id%2=1 THEN 'c-rna' ELSE 'c' END||user_id AS campaign_id, count(*) AS events FROM events GROUP BY user_id")
def camp8(spark, sf):
    """Odd users' campaigns hold ``-r`` in their own id."""
    e = audit_events(spark, sf).drop("event_id").withColumnRenamed("eid", "event_id")
    odd = F.concat(F.lit("c-rna"), F.col("user_id").cast("string"), F.lit("-r001"))
    e = e.withColumn("resource_id", F.when(F.col("user_id") % 2 == 1, odd).otherwise(F.col("resource_id")))
    camps = e.select(F.regexp_extract("resource_id", "^(.*)-r001$", 1).alias("campaign_id")).distinct()
    return ca.export_events(e, camps).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("events"))


@query("CAMP9_archive", """SELECT c_custkey AS campaign_id, CASE WHEN c_acctbal<0 THEN 'archived' ELSE 'active' END AS status FROM customer""")
def camp9(spark, sf):
    c = read(spark, sf, "customer")
    camps = c.select(F.col("c_custkey").alias("campaign_id"), F.lit("active").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    ids = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("campaign_id"))
    return ca.archive(camps, ids, F.current_timestamp()).select("campaign_id", "status")


@query("CAMP9_purge_counts", """SELECT o_custkey AS campaign_id, 'rounds' AS "table", count(*) AS rows FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_acctbal<0 GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'outcomes', count(*) FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE c_acctbal<0 GROUP BY o_custkey""")
def camp9p(spark, sf):
    ids = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("campaign_id"))
    rounds = read(spark, sf, "orders").select(F.col("o_custkey").alias("campaign_id"), "o_orderkey")
    items = read(spark, sf, "lineitem").select("l_orderkey").join(rounds, F.col("l_orderkey") == F.col("o_orderkey")).select("campaign_id", "l_orderkey")
    return ca.purge({"rounds": rounds, "outcomes": items}, ids)[1]


# --- registry ---------------------------------------------------------------------

def runs(spark, sf):
    d = read(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(F.concat(F.lit("run"), k.cast("string")).alias("run_id"), F.col("source").alias("project"),
                    F.when(k % 3 == 0, "prediction").when(k % 3 == 1, "simulation").otherwise("training").alias("workflow"),
                    (k % 7 / 10).alias("primary_metric"), F.col("n_chars").alias("test_rows"), (k % 11).alias("updated_at"), k.alias("doc_id"))


cte("reg", """SELECT 'run'||doc_id AS run_id, source AS project, CASE doc_id%3 WHEN 0 THEN 'prediction' WHEN 1 THEN 'simulation' ELSE 'training' END AS workflow, (doc_id%7)/10.0 AS primary_metric, n_chars AS test_rows, doc_id%11 AS updated_at, doc_id FROM documents""")


@query("REG1_run_upsert", with_ctes(f"SELECT run_id, {r6('primary_metric+(CASE WHEN doc_id%4=0 THEN 1 ELSE 0 END)')} AS primary_metric, CASE WHEN doc_id%8=0 THEN 99 ELSE updated_at END AS created_at FROM reg", "reg"))
def reg1(spark, sf):
    base = runs(spark, sf).select("run_id", "primary_metric", F.col("updated_at").alias("created_at"), "doc_id")
    old = base.where("doc_id % 8 <> 0").select("run_id", "primary_metric", "created_at")
    new = base.where("doc_id % 4 = 0").select("run_id", (F.col("primary_metric") + 1).alias("primary_metric"), F.lit(99).cast("bigint").alias("created_at"), F.lit(1).alias("seq"))
    return rg.upsert_runs(old, new, "seq").select("run_id", F.round("primary_metric", 6).alias("primary_metric"), "created_at")


@query("REG1_replaced_candidates", """SELECT l_orderkey AS run_id, count(*) AS rows FROM lineitem WHERE l_orderkey%5<>0 OR l_linenumber>3 GROUP BY l_orderkey""")
def reg1c(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    new = li.where("run_id % 5 = 0")
    kept = rg.replace_children(li, new.where("l_linenumber > 3").unionByName(new.where("l_linenumber > 99")))
    extra = new.where("l_linenumber > 3")
    gone = kept.where("run_id % 5 <> 0").unionByName(extra)
    return gone.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query("REG2_flattened_summaries", with_ctes(f"SELECT run_id, project, {r6('primary_metric')} AS primary_metric, test_rows, test_rows+1 AS accepted_rows, 'completed' AS status FROM reg", "reg"))
def reg2(spark, sf):
    r = runs(spark, sf)
    metric = F.struct(F.col("primary_metric"))
    body = F.to_json(F.struct(
        "project", F.when(F.col("workflow") == "prediction", F.struct(metric.alias("test_metrics"))).alias("prediction_audit"),
        F.when(F.col("workflow") == "simulation", F.struct("primary_metric")).when(F.lit(False), F.struct("primary_metric")).alias("report"),
        F.when(F.col("workflow") == "training", F.col("primary_metric")).alias("task_head_primary_metric"),
        F.struct(F.struct(F.col("test_rows").alias("test")).alias("split_sizes")).alias("split_diagnostics"),
        F.struct((F.col("test_rows") + 1).alias("accepted_rows")).alias("audit")))
    nested = F.when(F.col("workflow") == "training", F.replace(F.replace(body, F.lit('"task_head_primary_metric"'), F.lit('"report":{"task_head_primary_metric"')), F.lit(',"split_diagnostics"'), F.lit('},"split_diagnostics"'))).otherwise(body)
    out = rg.flatten_summary(r.select("run_id", "workflow", nested.alias("j")), "j", "workflow")
    return out.select("run_id", "project", F.round("primary_metric", 6).alias("primary_metric"), "test_rows", "accepted_rows", "status")


@query("REG3_latest_runs", with_ctes("SELECT run_id, updated_at FROM reg ORDER BY updated_at DESC, run_id LIMIT 50", "reg"))
def reg3(spark, sf):
    return rg.list_runs(runs(spark, sf), 50).select("run_id", "updated_at")


@query("JOIN14_latest_candidates", with_ctes("SELECT run_id, conv_id*1000+turn AS rank FROM reg JOIN conversations ON conv_id=doc_id ORDER BY updated_at DESC, run_id, rank LIMIT 40", "reg"))
def join14(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rank"))
    return rg.latest_candidates(runs(spark, sf), c, 40).select("run_id", "rank")


@query("REG4_reindexed_summaries", with_ctes("SELECT project, sum(test_rows)::bigint AS test_rows, project<>'src3' AS readable FROM reg GROUP BY project", "reg"))
def reg4(spark, sf):
    path = _scratch(spark, "summaries")
    sums = runs(spark, sf).groupBy("project").agg(F.sum("test_rows").alias("test_rows"))
    text = F.to_json(F.struct("project", "test_rows"))
    text = F.when(F.col("project") == "src3", F.rtrim(text, F.lit("}"))).otherwise(text)  # one file that is no JSON
    sums.select(text.alias("value"), F.concat("project", F.lit("-summary")).alias("part")).write.partitionBy("part").text(path)
    found = rg.reindex(spark, path, "*")
    return found.select(F.regexp_extract("path", "part=(.*)-summary", 1).alias("project"),
                        F.regexp_extract("value", '"test_rows":([0-9]+)', 1).cast("bigint").alias("test_rows"), "readable")


@query("JOIN16_prediction_output_check", """SELECT k, unnest(list_filter([CASE WHEN k::bigint%9=0 THEN 'missing identifier' END, CASE WHEN k::bigint%9<>0 AND k::bigint%10=0 THEN 'duplicate identifier' END, CASE WHEN k::bigint%9<>0 AND k::bigint%13=0 THEN 'non-numeric prediction' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT doc_id::varchar AS k FROM documents)
UNION ALL SELECT 'z'||doc_id, 'unexpected identifier' FROM documents WHERE doc_id%21=0""")
def join16(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    k = F.col("doc_id")
    value = F.when(k % 13 == 0, "x").otherwise("1.5")
    out = d.where("doc_id % 9 <> 0").select(k.cast("string").alias("doc_id"), value.alias("p"))
    twice = out.where("doc_id % 10 = 0")
    extra = d.where("doc_id % 21 = 0").select(F.concat(F.lit("z"), k.cast("string")).alias("doc_id"), F.lit("2").alias("p"))
    return rg.prediction_output_check(d, out.union(twice).union(extra), "doc_id", "p")


@query("JOIN17_explanation_lookup", """SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'by rank '||doc_id WHEN doc_id%3=1 THEN 'by hash '||doc_id END AS ranking_reason FROM documents""")
def join17(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("run_id"), F.col("doc_id").alias("rank"), F.md5(F.col("doc_id").cast("string")).alias("sequence_hash"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("by rank "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("by hash "), F.col("doc_id").cast("string")))
    e = d.where("doc_id % 3 <> 2").select("run_id", F.when(F.col("doc_id") % 3 == 0, F.col("rank")).alias("rank"),
                                          F.when(F.col("doc_id") % 3 == 1, F.col("sequence_hash")).alias("sequence_hash"), text.alias("ranking_reason"))
    return rg.lookup_explanations(d, e, ["rank", "sequence_hash"]).select("doc_id", "ranking_reason")


@query("JOIN18_aligned_enrichment", "SELECT doc_id, n_chars, lang FROM documents")
def join18(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("h"), "lang")
    return rg.enrich_aligned(d.drop("lang"), d.select("doc_id", "h", "lang"), "doc_id", "h", ["lang"]).select("doc_id", "n_chars", "lang")


@query("JOIN19_collapsed_run_views", with_ctes("""SELECT run_id FROM reg QUALIFY row_number() OVER (PARTITION BY project, workflow, primary_metric ORDER BY updated_at DESC, run_id)=1""", "reg"))
def join19(spark, sf):
    return rg.collapse_views(runs(spark, sf), ["project", "workflow", "primary_metric"], [-F.col("updated_at")])


@query("GATE12_prospective_artifacts", """SELECT regexp_extract(filename, '[^/]+$') AS file, NOT starts_with(regexp_extract(filename, '[^/]+$'), 'o') AS verified
 FROM read_blob('/root/testdata/sf0.01/*')""")
def gate12(spark, sf):
    """Claimed digests of the table files against the files themselves."""
    from ..sources import tables

    inv = tables.inventory(spark, sf)
    name = F.element_at(F.split("path", "/"), -1)
    claims = inv.select("path", "size", F.when(name.startswith("o"), F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    bad = tables.verify_inventory(claims, inv)
    return inv.join(bad, "path", "left").select(name.alias("file"), F.col("problem").isNull().alias("verified"))


# --- streams ----------------------------------------------------------------------

def _stream(spark, df, name, files=1):
    """Write a table as two files and read them as a stream, ``files`` per trigger."""
    path = _scratch(spark, name)
    df.repartition(2).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("STR1_streaming_validation", with_ctes("SELECT coalesce(reason,'accepted') AS outcome, count(*) AS rows FROM ingested GROUP BY 1", "ingested"))
def str1(spark, sf):
    from ..streaming import stream

    rows = _stream(spark, raw_assay(spark, sf).select("row_id", "sequence_id", "sequence", "target"), "raw")
    good, bad, ck = (_scratch(spark, n) for n in ("good", "bad", "ck"))
    stream.start_validation(rows, good, bad, ck).awaitTermination()
    a = spark.read.parquet(good).select(F.lit("accepted").alias("outcome"))
    b = spark.read.parquet(bad).select(F.col("reason").alias("outcome"))
    return a.union(b).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("STR2_streaming_outcomes", m(f"""SELECT round_id, candidate_id, replicate, measured_value::double AS measured_value FROM (SELECT *, row_number() OVER (PARTITION BY round_id, candidate_id, replicate ORDER BY measured_at DESC, measured_value::double DESC) AS newest
 FROM ({BADO}) WHERE candidate_id NOT LIKE 'x%' AND measured_value<>'n.a.' AND measured_at>2) WHERE newest=1"""))
def str2(spark, sf):
    from ..streaming import stream

    """Several versions of one replicate arrive; the latest measurement is the current one."""
    rows = _stream(spark, _bad_outcomes(spark, sf), "outcomes", 2)
    store, bad, ck = (_scratch(spark, n) for n in ("store", "bad", "ck"))
    rounds = selections(spark, sf).select("round_id").distinct().withColumn("selected_at", F.lit(2))
    stream.start_outcome_import(rows, selections(spark, sf), rounds, store, bad, ck).awaitTermination()
    kept = stream.current_outcomes(spark.read.parquet(store), "measured_at")
    return kept.select("round_id", "candidate_id", "replicate", "measured_value")


# copies within 300 seconds of the earliest one of their span; a copy behind it opens the next span
@query("STR3_streaming_label_conflicts", """WITH RECURSIVE f AS (SELECT md5(text) AS h, doc_id, (doc_id*7919)%1000 AS s, doc_id%3 AS label, row_number() OVER (PARTITION BY md5(text) ORDER BY (doc_id*7919)%1000, doc_id) AS i FROM documents),
 w AS (SELECT h, i, doc_id, s AS opened, label AS want, false AS conflict, true AS opens FROM f WHERE i=1
  UNION ALL SELECT f.h, f.i, f.doc_id, CASE WHEN f.s>w.opened+300 THEN f.s ELSE w.opened END, CASE WHEN f.s>w.opened+300 THEN f.label ELSE w.want END,
   f.s<=w.opened+300 AND f.label<>w.want, f.s>w.opened+300 FROM w JOIN f ON f.h=w.h AND f.i=w.i+1)
SELECT h AS sequence_hash, doc_id AS row_id, conflict FROM w WHERE NOT opens""")
def str3(spark, sf):
    """Copies in event time, in several batches whose order is not that of their times; an end mark lets the watermark pass them all."""
    from ..streaming import stream

    second = (F.col("doc_id") * 7919) % 1000
    docs = read(spark, sf, "documents").select(F.md5("text").alias("sequence_hash"), F.col("doc_id").alias("row_id"), (F.col("doc_id") % 3).alias("target"),
                                             F.timestamp_seconds(F.lit(1_700_000_000) + second).alias("ts"))
    end = spark.range(1).select(F.lit("end").alias("sequence_hash"), F.lit(-1).cast("long").alias("row_id"), F.lit(0).cast("long").alias("target"),
                                F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    source, out, ck = (_scratch(spark, n) for n in ("copies", "conflicts", "ck"))
    docs.repartition(3).write.parquet(source)

    def run():
        arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = stream.label_conflicts(arriving, "ts", "1 hour", keep_ms=300_000)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        run()
        end.write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema("sequence_hash string, row_id long, target string, conflict boolean").parquet(out).select("sequence_hash", "row_id", "conflict")


@query("STR3_streaming_distinct", "SELECT md5(text) AS sequence_hash FROM documents GROUP BY 1")
def str3d(spark, sf):
    from ..streaming import stream

    docs = read(spark, sf, "documents").select(F.md5("text").alias("sequence_hash"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    out, ck = _scratch(spark, "distinct"), _scratch(spark, "ck")
    q = stream.distinct_sequences(_stream(spark, docs, "docs"), "sequence_hash", "ts", "1 hour").writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("sequence_hash")


@query("STR4_streaming_error_monitor", f"""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, {r6('avg(abs(value-10))', 9)} AS mae, {r6('avg(value-10)', 9)} AS bias FROM events GROUP BY 1,2
HAVING time_bucket(INTERVAL '1 day', any_value(ts)) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '2 days'""")
def str4(spark, sf):
    from ..streaming import stream

    e = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out, ck = _scratch(spark, "windows"), _scratch(spark, "ck")
    live = stream.error_monitor(_stream(spark, e, "events", 2), "ts", "event_type", F.col("value") - 10, "1 day", "2 days")
    # append: a window is written once, when the watermark has passed it, and its state is released
    q = live.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.schema("start timestamp, event_type string, n long, mae double, bias double").parquet(out)
    return _r(written, "start", "event_type", digits=9)
