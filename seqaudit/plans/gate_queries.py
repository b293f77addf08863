"""Claim gates over one run per (source, language) of the assay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as g
from .catalog import query
from .views import assay, cte, r6, with_ctes

cte("runs", f"""SELECT source||'-'||lang AS run_id, count(*) AS test_rows, count(DISTINCT doc_id) AS test_clusters, min(doc_id)%7=0 AS severe_warning,
 {r6('1-sum(power(prediction-target,2))/nullif(var_pop(target)*count(*),0)')} AS model_metric, {r6('1-sum(power(4*gc+2.1-target,2))/nullif(var_pop(target)*count(*),0)')} AS baseline_metric,
 {r6('avg(abs(prediction-target))')} AS mean_abs_error, {r6('avg(abs(uncertainty-abs(prediction-target)))')} AS calibration_gap, round(max(uncertainty)-0.5,2) AS uncertainty_spearman,
 CASE max(doc_id)%3 WHEN 0 THEN 'verified_holdout' WHEN 1 THEN 'internally_controlled' ELSE 'unverified' END AS training_independence,
 CASE max(doc_id)%4 WHEN 0 THEN 'none' WHEN 1 THEN 'predicted_absolute_error' WHEN 2 THEN 'predictive_standard_deviation' ELSE 'rank_only' END AS uncertainty_type,
 max(doc_id)%2=0 AS external_predictions, max(doc_id)%5=0 AS has_protocol, max(doc_id)%10=0 AS protocol_hashes_verified, max(doc_id)%3<>1 AS hashes_complete,
 CASE WHEN max(doc_id)%6=0 THEN 'controlled_execution_manifest_sha256:ab' END AS artifact_verification, max(doc_id)%3 AS ranked_candidates, max(doc_id)%4<>3 AS constraints_verified,
 CASE WHEN max(doc_id)%11=0 THEN ['row 1'] ELSE [] END AS violations, CASE WHEN max(doc_id)%4=1 THEN 'not_evaluated' ELSE 'evaluated' END AS similarity_status, max(doc_id)%9=0 AS similarity_changes,
 {r6('1-sum(power(prediction-target,2))/nullif(var_pop(target)*count(*),0)-(1-sum(power(4*gc+2.1-target,2))/nullif(var_pop(target)*count(*),0))-0.1')} AS lift_low
 FROM assay GROUP BY source, lang""", ("assay",))


def runs(spark, sf):
    df = assay(spark, sf)
    c, d = F.col, F.max("doc_id")
    var = F.nullif(F.var_pop("target") * F.count("target"), F.lit(0.0))
    err = c("prediction") - c("target")
    base = 4 * c("gc") + 2.1 - c("target")
    model, simple = 1 - F.sum(err * err) / var, 1 - F.sum(base * base) / var
    return df.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("test_rows"), F.countDistinct("doc_id").alias("test_clusters"),
        (F.min("doc_id") % 7 == 0).alias("severe_warning"), F.round(model, 6).alias("model_metric"),
        F.round(simple, 6).alias("baseline_metric"), F.round(F.avg(F.abs(err)), 6).alias("mean_abs_error"),
        F.round(F.avg(F.abs(c("uncertainty") - F.abs(err))), 6).alias("calibration_gap"),
        F.round(F.max("uncertainty") - 0.5, 2).alias("uncertainty_spearman"),
        F.when(d % 3 == 0, "verified_holdout").when(d % 3 == 1, "internally_controlled").otherwise("unverified").alias("training_independence"),
        F.when(d % 4 == 0, "none").when(d % 4 == 1, "predicted_absolute_error").when(d % 4 == 2, "predictive_standard_deviation")
        .otherwise("rank_only").alias("uncertainty_type"),
        (d % 2 == 0).alias("external_predictions"), (d % 5 == 0).alias("has_protocol"),
        (d % 10 == 0).alias("protocol_hashes_verified"), (d % 3 != 1).alias("hashes_complete"),
        F.when(d % 6 == 0, "controlled_execution_manifest_sha256:ab").alias("artifact_verification"),
        (d % 3).alias("ranked_candidates"), (d % 4 != 3).alias("constraints_verified"),
        F.when(d % 11 == 0, F.array(F.lit("row 1"))).otherwise(F.array().cast("array<string>")).alias("violations"),
        F.when(d % 4 == 1, "not_evaluated").otherwise("evaluated").alias("similarity_status"),
        (d % 9 == 0).alias("similarity_changes"), F.round(model - simple - 0.1, 6).alias("lift_low"),
        F.lit("ok").alias("uncertainty_status"),
    ).withColumn("run_id", F.concat_ws("-", "source", "lang")).drop("source", "lang")


def arr(*pairs):
    return "list_filter([" + ",".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


def leak_sql(src, rows="20", clusters="3"):
    items = arr((f"test_rows<{rows}", f"'test rows '||test_rows||' < required '||{rows}"),
                (f"test_clusters<{clusters}", f"'clusters '||test_clusters||' < required '||{clusters}"),
                ("severe_warning", "'split quality warning flagged as DO NOT TRUST'"),
                ("training_independence='unverified'", "'model-training independence is unverified'"),
                ("external_predictions AND training_independence<>'verified_holdout'",
                 "'external predictions were not declared as generated on a verified locked holdout'"))
    return f"SELECT *, list_concat({items}, list_transform(violations, lambda v: 'cross-split violation: '||v)) AS leakage_reasons FROM {src}"


def lift_sql(src, need="0.0"):
    items = arr(("model_metric IS NULL", "'model metric is missing'"), ("baseline_metric IS NULL", "'baseline metric is missing'"),
                ("len(leakage_reasons)>0", "'leakage gate failed'"),
                (f"model_metric-baseline_metric<{need}", f"'lift delta '||printf('%.6f',model_metric-baseline_metric)||' < required '||printf('%.6f',{need}::double)"),
                (f"model_metric-baseline_metric IS NOT NULL AND lift_low<{need}",
                 f"'lift delta 95% CI lower bound '||printf('%.6f',lift_low)||' < required '||printf('%.6f',{need}::double)"))
    return f"SELECT *, {items} AS lift_reasons FROM ({src})"


UNC = arr(("uncertainty_type='none'", "'uncertainty_type is ''none'''"),
          ("uncertainty_type<>'none' AND (uncertainty_spearman IS NULL OR uncertainty_spearman<0.2)",
           "'uncertainty/error spearman '||coalesce(uncertainty_spearman::varchar,'None')||' < required 0.2'"),
          ("uncertainty_type='predicted_absolute_error' AND calibration_gap>mean_abs_error",
           "'absolute-error scale gap ratio '||printf('%.6f',calibration_gap/mean_abs_error)||' exceeds 1.000000'"),
          ("uncertainty_type='rank_only'", "'uncertainty_type ''rank_only'' is not dimensionally evaluable by this audit'"))
GATED = f"SELECT *, {UNC} AS uncertainty_reasons FROM ({lift_sql(leak_sql('runs'))})"
PRIO = arr(("ranked_candidates<=0", "'no candidate-prioritization rows were produced'"), ("severe_warning", "'severe warning present'"),
           ("len(leakage_reasons)>0", "'leakage check did not meet the selected policy'"), ("len(lift_reasons)>0", "'lift check did not meet the selected policy'"),
           ("uncertainty_type<>'none' AND len(uncertainty_reasons)>0", "'uncertainty usability check did not meet the selected policy'"),
           ("NOT constraints_verified", "'candidate constraints were not verified'"))


def gate(sql):
    return with_ctes(sql, "runs")


def _joined(df, *names):
    return df.select("run_id", *[F.array_join(n, " | ").alias(n) if n.endswith("reasons") or n in ("support", "limitations") else F.col(n) for n in names])


@query("GATE1_leakage_gate", gate(f"SELECT run_id, array_to_string(leakage_reasons,' | ') AS leakage_reasons, len(leakage_reasons)=0 AS leakage_ok FROM ({leak_sql('runs')})"))
def g1(spark, sf):
    return _joined(g.leakage_gate(g.with_thresholds(runs(spark, sf))), "leakage_reasons", "leakage_ok")


@query("GATE2_lift_gate", gate(f"SELECT run_id, {r6('model_metric-baseline_metric')} AS lift_delta, array_to_string(lift_reasons,' | ') AS lift_reasons, len(lift_reasons)=0 AS lift_ok FROM ({lift_sql(leak_sql('runs'))})"))
def g2(spark, sf):
    out = g.lift_gate(g.leakage_gate(g.with_thresholds(runs(spark, sf))))
    return _joined(out.withColumn("lift_delta", F.round("lift_delta", 6)), "lift_delta", "lift_reasons", "lift_ok")


@query("GATE3_uncertainty_gate", gate(f"SELECT run_id, array_to_string(uncertainty_reasons,' | ') AS uncertainty_reasons, len(uncertainty_reasons)=0 AS uncertainty_ok FROM ({GATED})"))
def g3(spark, sf):
    return _joined(g.claim_gates(runs(spark, sf)), "uncertainty_reasons", "uncertainty_ok")


@query("GATE4_prioritization_gate", gate(f"""SELECT run_id, array_to_string(p,' | ') AS prioritization_reasons, CASE WHEN len(p)=0 THEN 'eligible_for_scientist_review' ELSE 'review_with_cautions' END AS prioritization_status,
 CASE WHEN constraints_verified THEN '' ELSE 'candidate biological/synthesis constraints were not verified' END AS constraint_reasons FROM (SELECT *, {PRIO} AS p FROM ({GATED}))"""))
def g4(spark, sf):
    return _joined(g.claim_gates(runs(spark, sf)), "prioritization_reasons", "prioritization_status", "constraint_reasons")


PROF = " UNION ALL ".join(f"SELECT '{n}' AS profile, run_id, len(leakage_reasons)=0 AND len(lift_reasons)=0 AS criteria_met FROM ({lift_sql(leak_sql('runs', r, c), l)})"
                          for n, r, c, l in (("declared", "20", "3", "0.0"), ("stricter", "50", "5", "0.05"), ("stringent", "100", "10", "0.1")))
STABLE = f"""SELECT run_id, d, (s<>d OR x<>d) AS changes FROM (SELECT run_id, bool_or(criteria_met) FILTER (profile='declared') AS d, bool_or(criteria_met) FILTER (profile='stricter') AS s,
 bool_or(criteria_met) FILTER (profile='stringent') AS x FROM ({PROF}) GROUP BY run_id)"""


@query("GATE5_threshold_profiles", gate(PROF))
def g5(spark, sf):
    return g.threshold_profiles(runs(spark, sf)).select("profile", "run_id", "criteria_met")


@query("GATE5_threshold_stability", gate(f"SELECT run_id, changes AS conclusion_changes_under_stricter_thresholds, d AND NOT changes AS stable_under_stricter_thresholds FROM ({STABLE})"))
def g5s(spark, sf):
    return g.threshold_stability(g.threshold_profiles(runs(spark, sf)))


ASSUR = """CASE WHEN external_predictions AND has_protocol AND protocol_hashes_verified THEN 'prospective_evaluation' WHEN NOT external_predictions THEN 'controlled_evaluation'
 WHEN hashes_complete THEN 'provenance_verified' ELSE 'self_declared' END"""
ALIM = arr(("a='prospective_evaluation' AND NOT hashes_complete", "'model, training-data, split, and code hashes are not all present'"),
           ("a='controlled_evaluation'", "'the evaluation remains retrospective unless a prospective protocol is supplied'"),
           ("a='provenance_verified' AND training_independence<>'verified_holdout'", "'the supplied provenance does not declare a verified locked holdout'"),
           ("a='self_declared'", "'independence from model training data was not independently verified'"),
           ("has_protocol AND NOT protocol_hashes_verified", "'a prospective protocol was supplied, but its selection/outcome artifacts were not verified'"),
           ("has_protocol AND NOT external_predictions", "'the internal training workflow cannot establish that model-based selection preceded these outcomes'"),
           ("external_predictions AND a<>'prospective_evaluation' AND artifact_verification IS NULL", "'the external model was not executed here against a locked test set'"),
           ("a<>'prospective_evaluation'", "'prospective biological utility has not been demonstrated'"))


@query("GATE6_assurance_level", gate(f"SELECT run_id, a AS assurance, array_to_string({ALIM},' | ') AS limitations FROM (SELECT *, {ASSUR} AS a FROM runs)"))
def g6(spark, sf):
    return _joined(g.assurance_level(runs(spark, sf)).withColumnRenamed("assurance_limitations", "limitations"), "assurance", "limitations")


EVID = f"""SELECT *, {ALIM} AS alim, len(leakage_reasons)=0 AS lk, len(lift_reasons)=0 AS lf, d AND NOT changes AS st, similarity_status='not_evaluated' AS un,
 (NOT (d AND NOT changes) OR similarity_changes OR similarity_status='not_evaluated') AS fragile FROM (SELECT *, {ASSUR} AS a FROM ({GATED})) JOIN ({STABLE}) USING (run_id)"""
KEY = """CASE WHEN model_metric IS NULL THEN 'insufficient_evidence' WHEN NOT (lk AND lf) OR fragile THEN 'descriptive_audit_only' WHEN a='prospective_evaluation' THEN 'prospectively_demonstrated'
 WHEN a='provenance_verified' AND training_independence='verified_holdout' THEN 'locked_holdout_credible' WHEN a='controlled_evaluation' THEN 'retrospectively_credible' ELSE 'descriptive_audit_only' END"""


@query("GATE7_evidence_level", gate(f"SELECT run_id, {KEY} AS evidence FROM ({EVID})"))
def g7(spark, sf):
    return g.evaluate_runs(runs(spark, sf)).select("run_id", "evidence")


SOUND = "(model_metric IS NOT NULL AND lk AND lf AND NOT fragile)"
SUP = arr((f"{SOUND} AND a='prospective_evaluation'", "'performance was measured after a hashed, timestamped candidate selection'"),
          (f"{SOUND} AND a='provenance_verified' AND training_independence='verified_holdout'", "'the locked-holdout declaration and complete provenance hashes cap this at holdout evidence'"),
          (f"{SOUND} AND a='controlled_evaluation'", "'model fitting, splitting, and retrospective evaluation ran in one controlled execution'"),
          ("lk", "'the selected leakage checks met their declared thresholds'"), ("lf", "'the model beat the tested simple baselines under the declared lift policy'"),
          ("st", "'the conclusion did not change under the included stricter threshold profiles'"))
ELIM = arr(("model_metric IS NULL", "'no usable held-out primary metric was produced'"),
           ("model_metric IS NOT NULL AND NOT (lk AND lf)", "'one or more retrospective leakage/lift checks did not meet the selected policy'"),
           ("model_metric IS NOT NULL AND lk AND lf AND fragile AND un", "'conclusion sensitivity to alternate similarity settings was not evaluated'"),
           ("model_metric IS NOT NULL AND lk AND lf AND fragile AND NOT un", "'the conclusion is sensitive to stricter thresholds or similarity settings'"),
           (f"{SOUND} AND {KEY}='descriptive_audit_only'", "'self-declared or incomplete provenance caps the result at descriptive evidence'"),
           ("a<>'prospective_evaluation'", "'retrospective performance does not establish wet-lab value'"))
LBL = lambda col, m: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query("GATE8_verdict", gate(f"""SELECT run_id, {LBL('k', g.EVIDENCE_LABELS)}||' ('||{LBL('a', g.ASSURANCE_LABELS)}||').'||coalesce(' '||s[1]||'.','')||coalesce(' '||l[1]||'.','')||coalesce(' '||l[2]||'.','') AS verdict
FROM (SELECT run_id, a, {KEY} AS k, {SUP} AS s, list_concat(alim,{ELIM}) AS l FROM ({EVID}))"""))
def g8(spark, sf):
    return g.evaluate_runs(runs(spark, sf)).select("run_id", "verdict")


@query("GATE11_candidate_eligibility", gate(f"""SELECT run_id, array_to_string(e,' | ') AS eligibility_reasons, len(e)=0 AS eligible FROM (SELECT run_id, {arr(
    ("test_rows<20", "'only '||test_rows||' held-out rows were available; the declared minimum is 20'"), ("len(leakage_reasons)>0", "'leakage/independence checks did not pass'"),
    ("len(lift_reasons)>0", "'model lift did not pass'"), ("NOT constraints_verified", "'biological and synthesis constraints were not verified'"),
    ("uncertainty_type='none'", "'uncertainty semantics were not declared'"))} AS e FROM ({GATED}))"""))
def g11(spark, sf):
    return _joined(g.eligibility_reasons(g.claim_gates(runs(spark, sf))), "eligibility_reasons", "eligible")


@query("GATE10_manifest_checks", """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN 'sideways' ELSE 'maximize' END AS direction,
 CASE WHEN o_orderkey%3=0 THEN 'abc' ELSE sha256(o_orderkey::varchar) END AS split_sha256 FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN direction='sideways' THEN 'direction is not an accepted value' END, CASE WHEN length(split_sha256)<>64 THEN 'split_sha256 is not a SHA-256 digest' END,
 CASE WHEN o_orderkey%7=0 THEN 'measured needs an ISO-8601 time with offset' END, CASE WHEN o_orderkey%7=1 THEN 'measurement does not follow the selection' END], lambda x: x IS NOT NULL),' | ') AS errors FROM m""")
def g10(spark, sf):
    from ..session import read

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    df = read(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "sideways").otherwise("maximize").alias("direction"),
        F.when(k % 3 == 0, "abc").otherwise(F.sha2(k.cast("string"), 256)).alias("split_sha256"),
        F.concat(day, F.lit("T08:00:00Z")).alias("selected"),
        F.when(k % 7 == 0, F.concat(day, F.lit("T09:00:00"))).when(k % 7 == 1, F.concat(day, F.lit("T10:00:00+02:00")))
        .otherwise(F.concat(day, F.lit("T09:00:00+00:00"))).alias("measured"))
    out = g.manifest_errors(df, ["split_sha256"], "selected", "measured", {"direction": ("maximize", "minimize")})
    return out.select("o_orderkey", F.array_join("errors", " | ").alias("errors"))
