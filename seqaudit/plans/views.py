"""Assay-shaped tables derived from the driver's tables, once per engine.

The driver's tables hold no DNA. Every letter of a document is mapped onto the four
bases and the whole text is cut into 200-base constructs, so the derived table grows
with the text and no part of a text is left out. ``CTES`` states the same derivations
in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import seq
from ..functions.hashrand import uniform
from ..session import read, spread

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
WIDTH = 200


def constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"), "doc_id")
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    pieces = F.regexp_extract_all(dna, F.lit(".{1,%d}" % WIDTH), F.lit(0))
    return (
        docs.select("doc_id", "source", "lang", "n_chars", F.posexplode(pieces).alias("win", "sequence"))
        .withColumn("row_id", F.col("doc_id") * 100000 + F.col("win"))
        .withColumn("sequence_id", F.concat(F.lit("d"), "doc_id", F.lit("_"), "win"))
    )


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs with a measured target, a model prediction, an uncertainty and a label."""
    gc = seq.gc_fraction("sequence")
    noise = lambda tag: uniform(F.lit(tag), "sequence_id")
    df = constructs(spark, sf_dir).withColumn("gc", gc)
    df = df.withColumn("target", F.round(4 * F.col("gc") + 0.3 * F.log1p(F.length("sequence").cast("double"))
                                         + noise("t"), 6))
    df = df.withColumn("prediction", F.round(F.col("target") + noise("p") - 0.5, 6))
    df = df.withColumn("uncertainty", F.round(0.5 * noise("q") + 0.5 * F.abs(F.col("prediction") - F.col("target")), 6))
    df = df.withColumn("label", F.when(F.col("target") > 3.9, 1).otherwise(0))
    return df.withColumn("score", F.round(1 / (1 + F.exp(-4 * (F.col("prediction") - 3.9))), 6))


def raw_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string rows with the faults a lab table has: blanks, null words, bad symbols."""
    n = F.col("row_id") % 13
    df = assay(spark, sf_dir)
    dirty = (
        F.when(n == 1, F.lit(None).cast("string"))
        .when(n == 2, F.lit(" NaN "))
        .when(n == 3, F.concat("sequence", F.lit("X")))
        .when(n == 4, F.concat(F.lit(" "), F.lower("sequence"), F.lit("N ")))
        .otherwise(F.col("sequence"))
    )
    raw_target = (
        F.when(n == 5, F.lit("  "))
        .when(n == 6, F.lit("abc"))
        .when(n == 7, F.lit("1_000.5"))
        .when(n == 8, F.lit("1d"))
        .otherwise(F.col("target").cast("string"))
    )
    raw_label = F.when(n == 9, F.lit("1.0")).when(n == 10, F.lit(" Active ")).when(n == 11, F.lit("n/a")).otherwise(
        F.col("label").cast("string"))
    return df.select(
        "row_id", F.when(n == 12, F.lit(" ")).otherwise(F.col("sequence_id")).alias("sequence_id"),
        dirty.alias("sequence"), raw_target.alias("target"), raw_label.alias("label"),
        F.col("source").alias("batch"), F.when(n == 0, F.lit("")).otherwise(F.col("lang")).alias("organism"),
        F.when(n == 7, F.lit("inf")).otherwise(F.col("prediction").cast("string")).alias("prediction"),
        F.when(n == 8, F.lit("-0.5")).when(n == 9, F.lit(None).cast("string"))
        .otherwise(F.col("uncertainty").cast("string")).alias("uncertainty"),
    )


def u(*parts: str) -> str:
    """SQL twin of ``hashrand.uniform``; parts are SQL string expressions."""
    return f"(('0x'||left(md5({'||'.join(_joined(parts))}),8))::bigint/4294967296.0::double)"


def u_int(*parts: str) -> str:
    return f"('0x'||left(md5({'||'.join(_joined(parts))}),8))::bigint"


def _joined(parts):
    out = []
    for i, p in enumerate(parts):
        if i:
            out.append("':'")
        out.append(f"({p})::varchar")
    return out


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double,{digits})+0.0::double)"


RC = "reverse(translate({0},'ACGTN','TGCAN'))"
GC = "(length({0})-length(replace(replace({0},'G',''),'C','')))::double/length({0})"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (list(needs), body)


def with_ctes(query: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``query`` with the named CTEs and what they need, in dependency order."""
    done: list[str] = []

    def visit(name):
        if name in done:
            return
        for need in CTES[name][0]:
            visit(need)
        done.append(name)

    for name in names:
        visit(name)
    rec = "RECURSIVE " if recursive else ""
    return f"WITH {rec}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + ("\n" if query.startswith(",") else "\n") + query


cte("constructs", f"""
SELECT doc_id*100000+win AS row_id, 'd'||doc_id||'_'||win AS sequence_id, doc_id, win, sequence, source, lang, n_chars
FROM (SELECT doc_id, source, lang, n_chars, unnest(p) AS sequence, generate_subscripts(p,1)-1 AS win
      FROM (SELECT doc_id, source, lang, n_chars,
                   regexp_extract_all(translate(regexp_replace(lower(text),'[^a-z]','','g'),'{ALPHABET}','{BASES}'),'.{{1,{WIDTH}}}') AS p
            FROM documents))""")
cte("assay", f"""
SELECT *, CASE WHEN target > 3.9 THEN 1 ELSE 0 END AS label, round(1/(1+exp(-4*(prediction-3.9))),6) AS score FROM (
 SELECT *, round(0.5*{u("'q'", 'sequence_id')}+0.5*abs(prediction-target),6) AS uncertainty FROM (
  SELECT *, round(target+{u("'p'", 'sequence_id')}-0.5,6) AS prediction FROM (
   SELECT *, round(4*gc+0.3*ln(1+length(sequence)::double)+{u("'t'", 'sequence_id')},6) AS target FROM (
    SELECT *, {GC.format('sequence')} AS gc FROM constructs))))""", ("constructs",))
cte("raw_assay", """
SELECT row_id, CASE WHEN row_id%13=12 THEN ' ' ELSE sequence_id END AS sequence_id,
 CASE row_id%13 WHEN 1 THEN NULL WHEN 2 THEN ' NaN ' WHEN 3 THEN sequence||'X' WHEN 4 THEN ' '||lower(sequence)||'N ' ELSE sequence END AS sequence,
 CASE row_id%13 WHEN 5 THEN '  ' WHEN 6 THEN 'abc' WHEN 7 THEN '1_000.5' WHEN 8 THEN '1d' ELSE target::varchar END AS target,
 CASE row_id%13 WHEN 9 THEN '1.0' WHEN 10 THEN ' Active ' WHEN 11 THEN 'n/a' ELSE label::varchar END AS label,
 source AS batch, CASE WHEN row_id%13=0 THEN '' ELSE lang END AS organism,
 CASE WHEN row_id%13=7 THEN 'inf' ELSE prediction::varchar END AS prediction,
 CASE row_id%13 WHEN 8 THEN '-0.5' WHEN 9 THEN NULL ELSE uncertainty::varchar END AS uncertainty
FROM assay""", ("assay",))
# the ingest filter chain over raw_assay, as the oracle states it
NUM = r"'^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$'"


def sql_float(c: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({c}),{NUM}) THEN try_cast(replace(trim({c}),'_','') AS double) END)"


def sql_missing(c: str) -> str:
    return f"({c} IS NULL OR trim({c})='' OR lower(trim({c})) IN ('na','nan','none','null','n/a'))"


cte("ingested", f"""
SELECT *, {sql_float('target')} AS target_value,
 CASE WHEN seq='' THEN 'missing_sequence' WHEN NOT regexp_matches(seq,'^[ACGTN]+$') THEN 'invalid_dna'
      WHEN {sql_missing('target')} THEN 'missing_target' WHEN {sql_float('target')} IS NULL THEN 'non_numeric_target' END AS reason
FROM (SELECT *, CASE WHEN {sql_missing('sequence')} THEN '' ELSE upper(regexp_replace(sequence,'\\s+','','g')) END AS seq FROM raw_assay)""",
    ("raw_assay",))


def _cut_text(df: DataFrame, *keys: str) -> DataFrame:
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    pieces = F.regexp_extract_all(dna, F.lit(".{1,%d}" % WIDTH), F.lit(0))
    return spread(df.select(*keys, "text"), *keys).select(*keys, F.posexplode(pieces).alias("win", "sequence"))


def benchmark_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_text(read(spark, sf_dir, "benchmark"), "item_id").withColumn(
        "cand_id", F.col("item_id") * 1000 + F.col("win"))


def talk_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_text(read(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn(
        "train_id", F.col("conv_id") * 1000000 + F.col("turn") * 1000 + F.col("win"))


def _cut_sql(table: str, keys: str) -> str:
    return (f"SELECT {keys}, unnest(p) AS sequence, generate_subscripts(p,1)-1 AS win FROM (SELECT {keys}, regexp_extract_all("
            f"translate(regexp_replace(lower(text),'[^a-z]','','g'),'{ALPHABET}','{BASES}'),'.{{1,{WIDTH}}}') AS p FROM {table})")


cte("benchmark_seqs", f"SELECT *, item_id*1000+win AS cand_id FROM ({_cut_sql('benchmark', 'item_id')})")
cte("talk_seqs", f"SELECT *, conv_id*1000000+turn*1000+win AS train_id FROM ({_cut_sql('conversations', 'conv_id, turn')})")
# neighbouring constructs of one document, as parent and child
cte("neighbors", "SELECT a.row_id, a.sequence AS parent, b.sequence AS child FROM constructs a JOIN constructs b ON b.row_id=a.row_id+1", ("constructs",))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = constructs(spark, sf_dir).select("row_id", F.col("sequence").alias("parent"))
    b = constructs(spark, sf_dir).select((F.col("row_id") - 1).alias("row_id"), F.col("sequence").alias("child"))
    return a.join(b, "row_id")
