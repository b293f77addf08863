"""Row validation, reject reasons, label handling and audit counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq, values as v
from ..operators import ingest
from ..session import read
from .catalog import query
from .views import RC, assay, r6, raw_assay, sql_float, sql_missing, with_ctes
from .sequence_queries import NORM


def ing(sql):
    return with_ctes(sql, "ingested")


def raw(sql):
    return with_ctes(sql, "raw_assay")


def _validated(spark, sf):
    return ingest.validate_rows(raw_assay(spark, sf))


def _accepted(spark, sf):
    return ingest.accepted(_validated(spark, sf))


@query("VAL1_normalize_sequence", raw(f"SELECT row_id, {NORM} AS s FROM raw_assay"))
def q1(spark, sf):
    return raw_assay(spark, sf).select("row_id", seq.normalize_sequence("sequence").alias("s"))


@query("VAL2_normalize_dna", raw("SELECT row_id, regexp_replace(upper(sequence),'[^ACGTN]','N','g') AS s FROM raw_assay"))
def q2(spark, sf):
    return raw_assay(spark, sf).select("row_id", seq.normalize_dna("sequence").alias("s"))


@query("VAL3_strip_to_acgt", raw("SELECT row_id, regexp_replace(upper(coalesce(sequence,'')),'[^ACGT]','','g') AS s FROM raw_assay"))
def q3(spark, sf):
    return raw_assay(spark, sf).select("row_id", seq.strip_to_acgt("sequence").alias("s"))


@query("VAL4_validate_dna", raw(f"SELECT row_id, regexp_matches({NORM},'^[ACGTN]+$') AS valid FROM raw_assay"))
def q4(spark, sf):
    return raw_assay(spark, sf).select("row_id", seq.valid_dna(seq.normalize_sequence("sequence")).alias("valid"))


@query("VAL5_invalid_symbols", raw(f"""SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all({NORM},'[^ACGTN]'))),',') AS symbols
FROM raw_assay WHERE NOT regexp_matches({NORM},'^[ACGTN]+$')"""))
def q5(spark, sf):
    s = seq.normalize_sequence("sequence")
    return raw_assay(spark, sf).where(~seq.valid_dna(s)).select("row_id", F.array_join(seq.invalid_symbols(s), ",").alias("symbols"))


@query("VAL6_missing_values", raw(f"SELECT row_id, {sql_missing('sequence')} AS no_sequence, {sql_missing('target')} AS no_target, {sql_missing('label')} AS no_label FROM raw_assay"))
def q6(spark, sf):
    return raw_assay(spark, sf).select("row_id", *[v.is_missing(c).alias(f"no_{c}") for c in ("sequence", "target", "label")])


@query("VAL7_parse_float", raw(f"SELECT row_id, {r6(sql_float('target'))} AS target, {r6(sql_float('prediction'))} AS prediction FROM raw_assay"))
def q7(spark, sf):
    return raw_assay(spark, sf).select("row_id", *[F.round(v.parse_float(c), 6).alias(c) for c in ("target", "prediction")])


LABEL = f"CASE WHEN NOT {sql_missing('label')} THEN CASE WHEN {sql_float('label')}=floor({sql_float('label')}) THEN {sql_float('label')}::bigint::varchar ELSE lower(trim(label)) END END"


@query("VAL8_class_labels", raw(f"SELECT row_id, {LABEL} AS label FROM raw_assay"))
def q8(spark, sf):
    return raw_assay(spark, sf).select("row_id", v.class_label("label").alias("label"))


@query("VAL9_ingest_accepted", ing(f"""SELECT row_id, seq AS sequence, {r6('target_value')} AS target, sha256(seq) AS sequence_hash,
 sha256(least(seq,{RC.format('seq')})) AS rc_stable_hash, length(seq) AS length FROM ingested WHERE reason IS NULL"""))
def q9(spark, sf):
    return _accepted(spark, sf).select("row_id", "sequence", F.round("target_value", 6).alias("target"), "sequence_hash",
                                       "rc_stable_hash", "length")


@query("VAL9_ingest_rejected", ing("SELECT row_id AS row_index, sequence_id AS id, seq AS sequence, reason FROM ingested WHERE reason IS NOT NULL"))
def q9r(spark, sf):
    return ingest.rejected(_validated(spark, sf), "row_id", "sequence_id")


@query("VAL10_fill_ids", ing("""SELECT row_id, CASE WHEN trim(sequence_id)<>'' THEN sequence_id ELSE 'p_'||lpad((pos-1)::varchar,6,'0') END AS sequence_id
FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS pos FROM ingested WHERE reason IS NULL)"""))
def q10(spark, sf):
    return ingest.fill_ids(_accepted(spark, sf), "sequence_id", "row_id", "p").select("row_id", "sequence_id")


PRED = f"""SELECT row_id, p, u, CASE WHEN p IS NULL THEN 'missing_or_invalid_prediction' END AS reason,
 CASE WHEN u>=0 THEN 'provided_valid' ELSE 'missing_or_invalid' END AS status
 FROM (SELECT row_id, {sql_float('prediction')} AS p, {sql_float('uncertainty')} AS u FROM raw_assay)"""


@query("VAL11_prediction_rows", raw(f"""SELECT row_id, {r6('p')} AS prediction, {r6('CASE WHEN u>=0 THEN u END')} AS uncertainty, status, reason FROM ({PRED})"""))
def q11(spark, sf):
    return ingest.prediction_rows(raw_assay(spark, sf), "prediction", "uncertainty").select(
        "row_id", F.round("prediction_value", 6).alias("prediction"), F.round("uncertainty_value", 6).alias("uncertainty"),
        F.col("uncertainty_input_status").alias("status"), "reason")


@query("VAL12_binary_labels", """WITH l AS (SELECT CASE WHEN toxic=1 THEN 'hit' ELSE 'miss' END AS label FROM labels)
SELECT CASE WHEN label='hit' THEN 1 ELSE 0 END AS is_positive, label, count(*) AS rows FROM l GROUP BY label""")
def q12(spark, sf):
    df = read(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "hit").otherwise("miss").alias("label"))
    negative, positive = ingest.binary_labels(df, "label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).select(
        F.when(F.col("label") == positive, 1).otherwise(0).alias("is_positive"), "label", "rows")


@query("VAL13_label_encoding", """SELECT p_type AS label, count(*) AS rows, any_value(code) AS encoded FROM part JOIN
 (SELECT p_type, row_number() OVER (ORDER BY lower(p_type))-1 AS code FROM (SELECT DISTINCT p_type FROM part)) USING (p_type) GROUP BY p_type""")
def q13(spark, sf):
    df = ingest.encode_labels(read(spark, sf, "part").select("p_type"), "p_type")
    return df.groupBy(F.col("p_type").alias("label"), "encoded").agg(F.count(F.lit(1)).alias("rows"))


@query("VAL14_required_columns", raw("""SELECT * FROM (SELECT 'sequence' AS "column", count(*) FILTER (coalesce(trim(sequence),'')='') AS blank FROM raw_assay
 UNION ALL SELECT 'sequence_id', count(*) FILTER (coalesce(trim(sequence_id),'')='') FROM raw_assay UNION ALL SELECT 'batch', count(*) FILTER (coalesce(trim(batch),'')='') FROM raw_assay) WHERE blank>0"""))
def q14(spark, sf):
    cols = ["sequence", "sequence_id", "batch"]
    one = raw_assay(spark, sf).agg(*[F.count_if(~v.non_blank(c)).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "blank").where("blank > 0")


@query("VAL15_evaluation_rows", raw(f"SELECT row_id FROM raw_assay WHERE {sql_float('prediction')} IS NOT NULL AND NOT {sql_missing('target')}"))
def q15(spark, sf):
    return raw_assay(spark, sf).where(v.parse_float("prediction").isNotNull() & ~v.is_missing("target")).select("row_id")


@query("VAL16_candidate_filters", with_ctes("""SELECT row_id, CASE WHEN len(flags)=0 THEN 'none' ELSE 'flagged' END AS risk FROM (
 SELECT row_id, source, list_filter([CASE WHEN uncertainty>0.5 THEN 'high_uncertainty' END, CASE WHEN gc>0.6 THEN 'gc_high' END], lambda x: x IS NOT NULL) AS flags, sequence_id FROM assay)
 WHERE contains(sequence_id,'d1') AND source='src1'""", "assay"))
def q16(spark, sf):
    flags = v.reasons((F.col("uncertainty") > 0.5, "high_uncertainty"), (F.col("gc") > 0.6, "gc_high"))
    df = assay(spark, sf).where(F.col("sequence_id").contains("d1") & (F.col("source") == "src1"))
    df = df.withColumn("risk_flags_json", F.to_json(flags))
    n = F.size(F.from_json("risk_flags_json", "array<string>"))
    return df.select("row_id", F.when(n == 0, "none").otherwise("flagged").alias("risk"))


@query("VAL17_drop_empty_columns", """SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def q17(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", F.lit("  ").alias("notes"), "c_mktsegment",
                                           F.lit(None).cast("string").alias("owner"))
    return ingest.drop_empty_columns(df)


@query("VAL18_column_levels", """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS cardinality, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS levels FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), NULL FROM orders""")
def q18(spark, sf):
    return ingest.column_levels(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("AGG1_reason_counts", ing("SELECT coalesce(reason,'accepted') AS outcome, count(*) AS rows FROM ingested GROUP BY 1"))
def a1(spark, sf):
    return ingest.reason_counts(_validated(spark, sf))


@query("AGG1_audit_counters", ing("""SELECT count(*) AS total_rows, count(*) FILTER (reason IS NULL) AS accepted_rows, count(*) FILTER (reason='missing_sequence') AS missing_sequence_rows,
 count(*) FILTER (reason='invalid_dna') AS invalid_dna_rows, count(*) FILTER (reason IN ('missing_target','non_numeric_target')) AS missing_target_rows FROM ingested"""))
def a1c(spark, sf):
    return ingest.audit_counters(_validated(spark, sf))


@query("AGG2_duplicate_labels", ing("""SELECT count(*) FILTER (rn>1) AS duplicate_sequences, count(*) FILTER (rn>1 AND target_value<>ft) AS conflicting_duplicate_labels FROM (
 SELECT target_value, row_number() OVER w AS rn, first_value(target_value) OVER w AS ft FROM ingested WHERE reason IS NULL WINDOW w AS (PARTITION BY seq ORDER BY row_id))"""))
def a2(spark, sf):
    return ingest.duplicate_labels(_accepted(spark, sf), "row_id")


def _r(df, *keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep])


@query("AGG3_target_summary", ing(f"""SELECT organism, count(*) AS count, {r6('avg(target_value)', 7)} AS mean, {r6('stddev_pop(target_value)', 7)} AS std, {r6('min(target_value)', 7)} AS min,
 {r6('median(target_value)', 7)} AS median, {r6('max(target_value)', 7)} AS max FROM ingested WHERE reason IS NULL GROUP BY organism"""))
def a3(spark, sf):
    return _r(ingest.target_summary(_accepted(spark, sf), group=["organism"]), "organism", digits=7)


@query("AGG3_class_counts", "SELECT quality::varchar AS label, count(*) AS rows FROM labels GROUP BY quality")
def a3c(spark, sf):
    return ingest.class_counts(read(spark, sf, "labels"), "quality")


@query("AGG4_metadata_coverage", ing(f"""SELECT 'batch' AS "column", {r6("avg((coalesce(trim(batch),'')<>'')::int)")} AS coverage FROM ingested WHERE reason IS NULL
UNION ALL SELECT 'organism', {r6("avg((coalesce(trim(organism),'')<>'')::int)")} FROM ingested WHERE reason IS NULL
UNION ALL SELECT 'uncertainty', {r6("avg((coalesce(trim(uncertainty),'')<>'')::int)")} FROM ingested WHERE reason IS NULL"""))
def a4(spark, sf):
    return _r(ingest.coverage(_accepted(spark, sf), ["batch", "organism", "uncertainty"]), "column")


BAL = """SELECT "column", value, count(*) AS rows FROM (SELECT 'batch' AS "column", CASE WHEN coalesce(batch,'')='' THEN '__missing__' ELSE batch END AS value FROM ingested WHERE reason IS NULL
UNION ALL SELECT 'organism', CASE WHEN coalesce(organism,'')='' THEN '__missing__' ELSE organism END FROM ingested WHERE reason IS NULL) GROUP BY ALL"""


@query("AGG5_group_counts", ing(BAL))
def a5(spark, sf):
    return ingest.group_balance(_accepted(spark, sf), ["batch", "organism"])


@query("AGG5_group_balance", ing(f"""SELECT "column", count(*) AS num_groups, {r6('max(rows)/sum(rows)')} AS largest_fraction FROM ({BAL}) GROUP BY "column" """))
def a5s(spark, sf):
    return _r(ingest.balance_summary(ingest.group_balance(_accepted(spark, sf), ["batch", "organism"])), "column")


@query("AGG6_audit_warnings", ing(""", ok AS (SELECT *, 'only' AS assay_name FROM ingested WHERE reason IS NULL)
SELECT 'rows' AS subject, 'DO NOT TRUST: only '||count(*)||' labeled rows passed validation; use this as a data audit or pilot benchmark until validation performance is strong.' AS warning FROM ok HAVING count(*)<1000000
UNION ALL SELECT 'assay_name', 'Group column ''assay_name'' has fewer than 2 groups after validation.' FROM ok HAVING count(DISTINCT assay_name)<2"""))
def a6(spark, sf):
    df = _validated(spark, sf).withColumn("assay_name", F.lit("only"))
    return ingest.audit_warnings(df, ["assay_name", "batch"], low_n=1000000)
