"""Sequence functions over every construct of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators.distances import min_edit_distance
from .catalog import query
from .views import RC, benchmark_seqs, constructs, neighbors, r6, raw_assay, talk_seqs, with_ctes

SEQ = "sequence"
NORM = "CASE WHEN sequence IS NULL OR lower(trim(sequence)) IN ('','na','nan','none','null','n/a') THEN '' ELSE upper(regexp_replace(sequence,'\\s+','','g')) END"


@query("SEQ1_reverse_complement", with_ctes(f"SELECT row_id, {RC.format(SEQ)} AS rc FROM constructs", "constructs"))
def q_rc(spark, sf):
    return constructs(spark, sf).select("row_id", seq.reverse_complement(SEQ).alias("rc"))


@query("SEQ2_sequence_hashes", with_ctes(
    f"SELECT row_id, sha256(sequence) AS sequence_hash, sha256(least(sequence,{RC.format(SEQ)})) AS rc_stable_hash FROM constructs", "constructs"))
def q_hash(spark, sf):
    return constructs(spark, sf).select("row_id", seq.sequence_hash(SEQ).alias("sequence_hash"),
                                        seq.canonical_hash(SEQ).alias("rc_stable_hash"))


def _raw(spark, sf):
    return raw_assay(spark, sf).select("row_id", seq.normalize_sequence(SEQ).alias("s"))


GCN = "(length({0})-length(replace(replace({0},'G',''),'C','')))"


@query("SEQ3_gc_fraction", with_ctes(
    f"SELECT row_id, {r6(f'CASE WHEN s={chr(39)*2} THEN 0 ELSE {GCN.format(chr(115))}/length(s) END')} AS gc FROM (SELECT row_id, {NORM} AS s FROM raw_assay)", "raw_assay"))
def q_gc(spark, sf):
    return _raw(spark, sf).select("row_id", F.round(seq.gc_fraction("s"), 6).alias("gc"))


@query("SEQ4_gc_fraction_acgt", with_ctes(
    f"SELECT row_id, {r6('CASE WHEN a=' + chr(39) * 2 + ' THEN 0 ELSE ' + GCN.format('a') + '/length(a) END')} AS gc FROM (SELECT row_id, regexp_replace({NORM},'[^ACGT]','','g') AS a FROM raw_assay)", "raw_assay"))
def q_gc_acgt(spark, sf):
    return _raw(spark, sf).select("row_id", F.round(seq.gc_fraction_acgt("s"), 6).alias("gc"))


@query("SEQ5_gc_length_features", with_ctes(
    f"SELECT row_id, {r6('ln(1+length(sequence))')} AS log_length, {r6(GCN.format(SEQ) + '/length(sequence)')} AS gc FROM constructs", "constructs"))
def q_gc_len(spark, sf):
    f = seq.gc_length_features(SEQ)
    return constructs(spark, sf).select("row_id", F.round(f[0], 6).alias("log_length"), F.round(f[1], 6).alias("gc"))


@query("SEQ6_max_homopolymer", with_ctes(f"""SELECT row_id, coalesce(list_max(list_transform(regexp_extract_all(s,'A+|C+|G+|T+|N+'), lambda x: length(x))),0) AS run
FROM (SELECT row_id, {NORM} AS s FROM raw_assay)""", "raw_assay"))
def q_run(spark, sf):
    return _raw(spark, sf).select("row_id", seq.max_homopolymer("s").alias("run"))


def _kmer_sql(tokens):
    return with_ctes(f"""SELECT row_id, len(t) AS n, sha256(array_to_string(list_sort(t),' ')) AS digest FROM (
 SELECT row_id, CASE WHEN s='' THEN [] WHEN length(s)<8 THEN {tokens[0]} ELSE {tokens[1]} END AS t FROM (SELECT row_id, {NORM} AS s FROM raw_assay))""", "raw_assay")


RAW_K = ("[s]", "list_distinct(list_transform(list_filter(list_transform(range(1,length(s)-6), lambda i: substr(s,i,8)), lambda w: regexp_matches(w,'^[ACGT]+$')),"
         f" lambda w: least(w,{RC.format('w')})))")
RAW_P = ("['0:'||s]", "list_filter(list_transform(range(1,length(s)-6), lambda i: (i-1)||':'||substr(s,i,8)), lambda w: regexp_matches(w,'^[0-9]+:[ACGT]+$'))")


def _kmer_digest(df, tokens):
    return df.select("row_id", tokens.alias("t")).select(
        "row_id", F.size("t").alias("n"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("digest"))


@query("SEQ7_canonical_kmers", _kmer_sql(RAW_K))
def q_kmers(spark, sf):
    return _kmer_digest(_raw(spark, sf), seq.kmers("s", 8))


@query("SEQ8_positional_kmers", _kmer_sql(RAW_P))
def q_positional(spark, sf):
    return _kmer_digest(_raw(spark, sf), seq.positional_kmers("s", 8))


@query("SEQ9_kmer_frequencies", with_ctes(f"""
, rows AS (SELECT row_id, lang, length(sequence)-2 AS total, unnest(list_transform(range(1,length(sequence)-1), lambda i: substr(sequence,i,3))) AS kmer FROM constructs WHERE length(sequence)>=3),
 freq AS (SELECT row_id, lang, kmer, count(*)::double/any_value(total) AS f FROM rows GROUP BY row_id, lang, kmer),
 n AS (SELECT lang, count(*) AS n FROM constructs GROUP BY lang)
SELECT lang, kmer, {r6('sum(f)/any_value(n)')} AS mean_frequency FROM freq JOIN n USING (lang) GROUP BY lang, kmer""", "constructs"))
def q_frequencies(spark, sf):
    rows = constructs(spark, sf).select("lang", seq.kmer_frequencies(SEQ, 3).alias("v"))
    names = F.array(*[F.lit(k) for k in seq.vocabulary(3)])
    cells = rows.select("lang", F.posexplode("v").alias("pos", "f"))
    mean = cells.groupBy("lang", "pos").agg(F.avg("f").alias("m")).where("m > 0")
    return mean.select("lang", F.element_at(names, F.col("pos") + 1).alias("kmer"), F.round("m", 6).alias("mean_frequency"))


@query("SEQ10_edit_distance", with_ctes("SELECT row_id, levenshtein(parent, child) AS distance FROM neighbors", "neighbors"))
def q_edit(spark, sf):
    return neighbors(spark, sf).select("row_id", seq.levenshtein("parent", "child").alias("distance"))


@query("SEQ11_min_edit_distance", with_ctes("""
SELECT b.cand_id, min(levenshtein(b.sequence, t.sequence)) AS min_edit_distance FROM benchmark_seqs b,
 (SELECT DISTINCT sequence FROM talk_seqs) t GROUP BY b.cand_id""", "benchmark_seqs", "talk_seqs"))
def q_min_edit(spark, sf):
    return min_edit_distance(benchmark_seqs(spark, sf), "cand_id", SEQ, talk_seqs(spark, sf), SEQ)


@query("SEQ12_normalized_hamming", with_ctes(f"""
SELECT row_id, CASE WHEN length(parent)<>length(child) THEN 1.0 ELSE {r6("len(list_filter(range(1,length(parent)+1), lambda i: substr(parent,i,1)<>substr(child,i,1)))::double/length(parent)")} END AS distance FROM neighbors""", "neighbors"))
def q_hamming(spark, sf):
    return neighbors(spark, sf).select("row_id", F.round(seq.hamming("parent", "child"), 6).alias("distance"))


@query("SEQ13_sequence_differences", with_ctes("""
SELECT row_id, len(d) AS changes, array_to_string(d[1:40],', ') AS shown FROM (
 SELECT row_id, list_concat(list_transform(list_filter(range(1,least(length(parent),length(child))+1), lambda i: substr(parent,i,1)<>substr(child,i,1)),
   lambda i: i||': '||substr(parent,i,1)||'→'||substr(child,i,1)),
   CASE WHEN length(parent)<>length(child) THEN ['Length: '||length(parent)||'→'||length(child)||' nt'] ELSE [] END) AS d FROM neighbors)""", "neighbors"))
def q_differences(spark, sf):
    d = neighbors(spark, sf).select("row_id", seq.differences("parent", "child").alias("d"))
    return d.select("row_id", F.size("d").alias("changes"), F.array_join(F.slice("d", 1, 40), ", ").alias("shown"))


MOTIF_SQL = "".join(
    f"CASE WHEN contains(sequence,'{m}') THEN ['{m}'] ELSE [] END || CASE WHEN contains(sequence,'{seq.complement_text(m)}') THEN ['{m} reverse complement'] ELSE [] END || "
    for m in seq.GOLDEN_GATE_SITES)


@query("SEQ14_motif_hits", with_ctes(
    f"SELECT row_id, array_to_string({MOTIF_SQL} []::varchar[], ', ') AS hits FROM constructs", "constructs"))
def q_motifs(spark, sf):
    return constructs(spark, sf).select(
        "row_id", F.array_join(seq.motif_hits(SEQ, seq.GOLDEN_GATE_SITES), ", ").alias("hits"))


CODE = "list_reduce(list_transform(range(1,7), lambda i: (instr('ACGT',substr({0},i,1))-1)::bigint), lambda a, b: a*4+b)+1"


@query("SEQ15_kmer_codes", with_ctes(f"""
SELECT row_id, count(*) AS windows, sum(CASE WHEN regexp_matches(w,'^[ACGT]+$') THEN {CODE.format('w')} ELSE 0 END)::bigint AS total FROM (
 SELECT row_id, unnest(list_transform(range(1,length(s)-4), lambda i: substr(s,i,6))) AS w FROM (SELECT row_id, {NORM} AS s FROM raw_assay) WHERE length(s)>=6) GROUP BY row_id""", "raw_assay"))
def q_codes(spark, sf):
    """Codes of all 6-mers of every sequence."""
    long_enough = _raw(spark, sf).where(F.length("s") >= 6)
    coded = long_enough.select("row_id", seq.kmer_codes("s", 6).alias("codes"))
    return coded.select("row_id", F.size("codes").cast("bigint").alias("windows"), F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SEQ16_base_tokens", with_ctes(f"""
SELECT row_id, array_to_string(list_transform(range(1,257), lambda i: CASE substr(s,i,1) WHEN 'C' THEN '1' WHEN 'G' THEN '2' WHEN 'T' THEN '3' ELSE '0' END),'') AS ids,
 array_to_string(list_transform(range(1,257), lambda i: CASE WHEN regexp_matches(substr(s,i,1),'^[ACGT]$') THEN '1' ELSE '0' END),'') AS mask,
 least(length(s),256) AS real_offsets FROM (SELECT row_id, {NORM} AS s FROM raw_assay)""", "raw_assay"))
def q_tokens(spark, sf):
    t = _raw(spark, sf).select("row_id", seq.base_tokens("s", 256).alias("t"))
    return t.select("row_id", F.array_join("t.input_ids", "").alias("ids"), F.array_join("t.attention_mask", "").alias("mask"),
                    F.size(F.filter("t.offsets", lambda o: o[1] > o[0])).alias("real_offsets"))


@query("SEQ17_kmer_ids_from_offsets", with_ctes(f"""
SELECT row_id, list_sum(list_transform(range(0,length(sequence)-5,6), lambda p: {CODE.format('substr(sequence,p+1,6)')}))::bigint AS code_sum,
 len(range(0,length(sequence),6)) AS spans FROM constructs WHERE length(sequence)>=6""", "constructs"))
def q_offset_ids(spark, sf):
    df = constructs(spark, sf).where(F.length(SEQ) >= 6)
    spans = F.transform(F.sequence(F.lit(0), F.length(SEQ) - 1, F.lit(6)),
                        lambda p: F.array(p, F.least(p + 6, F.length(SEQ))))
    df = df.withColumn("spans", spans)
    ids = seq.kmer_ids(SEQ, "spans", 6)
    return df.select("row_id", F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"),
                     F.size("spans").alias("spans"))


@query("SEQ18_decode_bases", with_ctes(f"SELECT row_id, regexp_replace(s,'[^ACGT]','A','g') AS decoded FROM (SELECT row_id, {NORM} AS s FROM raw_assay)", "raw_assay"))
def q_decode(spark, sf):
    t = _raw(spark, sf).select("row_id", "s", seq.base_tokens("s", 256).alias("t"))
    return t.select("row_id", seq.decode_bases(F.slice("t.input_ids", F.lit(1), F.length("s"))).alias("decoded"))


@query("SEQ19_masked_parent_summary", with_ctes(f"""
SELECT row_id, length(c) AS length, length(c)-length(replace(c,'N','')) AS masked,
 CASE WHEN f<>'' THEN {r6(GCN.format('f') + '/length(f)')} END AS fixed_gc,
 array_to_string(list_sort(list_distinct(regexp_extract_all(c,'[^ACGTN]'))),',') AS invalid
FROM (SELECT row_id, c, regexp_replace(c,'[^ACGT]','','g') AS f FROM (SELECT row_id, regexp_replace(replace(upper(coalesce(sequence,'')||'[mask]'),'[MASK]','N'),'\\s+','','g') AS c FROM raw_assay))""", "raw_assay"))
def q_masked(spark, sf):
    parent = F.concat(F.coalesce(F.col(SEQ), F.lit("")), F.lit("[mask]"))
    m = raw_assay(spark, sf).select("row_id", seq.masked_summary(parent).alias("m"))
    return m.select("row_id", "m.length", "m.masked", F.round("m.fixed_gc", 6).alias("fixed_gc"), "m.invalid")


@query("SEQ20_display_id", with_ctes("""
SELECT row_id, CASE WHEN trim(sequence_id)<>'' THEN sequence_id WHEN sequence IS NOT NULL THEN 'hash:'||left(sha256(sequence),12)
 ELSE 'row_'||CASE WHEN length(row_id::varchar)<4 THEN lpad(row_id::varchar,4,'0') ELSE row_id::varchar END END AS display_id FROM raw_assay""", "raw_assay"))
def q_display(spark, sf):
    from ..operators.ingest import display_id

    df = raw_assay(spark, sf).withColumn("sequence_hash", F.sha2("sequence", 256))
    return df.select("row_id", display_id("row", F.col("row_id"), "sequence_id").alias("display_id"))
