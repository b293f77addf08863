"""Corpus preparation, n-gram statistics, generation; whole texts of all documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import corpus as cp, generate as gen, split as sp
from ..session import ensure_checkpoint_dir, read, spread
from ..sources import fasta, tables
from .catalog import query
from .ingest_queries import _r
from .views import ALPHABET, BASES, assay, constructs, cte, r6, talk_seqs, u, with_ctes

LETTERS = f"translate(regexp_replace(lower(text),'[^a-z]','','g'),'{ALPHABET}','{BASES}')"
# whole documents as long sequences; the source is the file they lie in
cte("genomes", f"SELECT doc_id, source AS file, {LETTERS} AS sequence, length({LETTERS}) AS n FROM documents")
MAXL, STRIDE, MINL = 512, 256, 128
WIN = f"CASE WHEN n<{MINL} THEN 0 WHEN n<={MAXL} THEN 1 ELSE least(floor((n-{MINL})/{STRIDE})+1, ceil((n-{MAXL})::double/{STRIDE})+1) END::bigint"
cte("counted", f"SELECT *, {WIN} AS w FROM genomes", ("genomes",))


def genomes(spark, sf):
    docs = spread(read(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    return docs.select("doc_id", F.col("source").alias("file"), dna.alias("sequence")).withColumn("n", F.length("sequence"))


def counted(spark, sf):
    return genomes(spark, sf).withColumn("w", cp.window_count("n", MAXL, STRIDE, MINL))


@query("SPL10_chunk_coordinates", with_ctes(f""", s AS (SELECT doc_id, n, sequence, unnest(CASE WHEN n<{MINL} THEN [] WHEN n<={MAXL} THEN [0] ELSE range(0,n-{MINL}+1,{STRIDE}) END) AS start FROM genomes)
SELECT doc_id, start, least(start+{MAXL},n) AS "end", sha256(substr(sequence,start+1,{MAXL})) AS chunk_hash FROM s WHERE start=0 OR start-{STRIDE}+{MAXL}<n""", "genomes"))
def spl10(spark, sf):
    return cp.chunks(genomes(spark, sf), "sequence", MAXL, STRIDE, MINL).select("doc_id", "start", "end", F.sha2("chunk", 256).alias("chunk_hash"))


@query("SPL10_window_counts", with_ctes("SELECT doc_id, w FROM counted", "counted"))
def spl10c(spark, sf):
    return counted(spark, sf).select("doc_id", "w")


@query("SPL5_hash_split", with_ctes("""SELECT row_id, CASE ('0x'||left(sha256(sequence),8))::bigint%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM constructs""", "constructs"))
def spl5(spark, sf):
    return constructs(spark, sf).select("row_id", sp.hash_split(F.sha2("sequence", 256)).alias("split"))


@query("SPL6_bottom_sample", with_ctes("""SELECT row_id, split FROM (SELECT row_id, CASE ('0x'||left(sha256(sequence),8))::bigint%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM constructs)
 QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('5:'||row_id), row_id) <= CASE split WHEN 'train' THEN 200 ELSE 50 END""", "constructs"))
def spl6(spark, sf):
    df = constructs(spark, sf).select("row_id", sp.hash_split(F.sha2("sequence", 256)).alias("split"))
    return cp.bottom_sample(df, "split", "row_id", {"train": 200, "validation": 50, "test": 50}, 5)


# one recursive step per sequence of a file, in shuffled order
@query("SPL7_window_split", with_ctes(f""", o AS (SELECT file, doc_id AS id, w, row_number() OVER (PARTITION BY file ORDER BY md5('13:'||file||':'||doc_id), doc_id) AS k, floor(sum(w) OVER (PARTITION BY file)*0.8)::bigint AS goal FROM counted WHERE w>0),
 f AS (SELECT file, id, k, goal, CASE WHEN w<=goal OR (goal>0 AND 2*goal>w) THEN w ELSE 0 END::bigint AS c, (w<=goal OR (goal>0 AND 2*goal>w)) AS tr FROM o WHERE k=1
  UNION ALL SELECT o.file, o.id, o.k, o.goal, (f.c+CASE WHEN f.c+w<=o.goal OR (f.c<o.goal AND 2*(o.goal-f.c)>w) THEN w ELSE 0 END)::bigint, (f.c+w<=o.goal OR (f.c<o.goal AND 2*(o.goal-f.c)>w)) FROM f JOIN o ON o.file=f.file AND o.k=f.k+1)
SELECT file, id, CASE WHEN tr THEN 'train' ELSE 'eval' END AS split FROM f""", "counted", recursive=True))
def spl7(spark, sf):
    return cp.window_split(counted(spark, sf), "file", "doc_id", "w", 0.8, 13)


@query("SPL8_capped_windows", with_ctes("""SELECT doc_id, file, w FROM (SELECT *, sum(w) OVER (PARTITION BY file ORDER BY w DESC, doc_id ROWS UNBOUNDED PRECEDING)-w AS ex FROM counted WHERE w>0)
 WHERE ex < CASE file WHEN 'src1' THEN 40 WHEN 'src2' THEN 15 ELSE 25 END""", "counted"))
def spl8(spark, sf):
    return cp.cap_windows(counted(spark, sf).select("doc_id", "file", "w"), "file", "doc_id", "w", {"src1": 40, "src2": 15, "*": 25})


@query("SPL9_trimmed_eval", with_ctes("""SELECT doc_id, w FROM (SELECT *, sum(w) OVER (ORDER BY md5('3:'||doc_id), doc_id ROWS UNBOUNDED PRECEDING)-w AS ex FROM counted WHERE w>0) WHERE ex < 100""", "counted"))
def spl9(spark, sf):
    return cp.trim_eval(counted(spark, sf).select("doc_id", "w"), "doc_id", "w", 900, 0.9, 3)


MAN = """man AS (SELECT file AS path, doc_id AS seq_index, CASE doc_id%5 WHEN 0 THEN 'val' WHEN 1 THEN 'Test ' ELSE 'train' END AS split FROM genomes UNION ALL SELECT file, doc_id, 'train' FROM genomes WHERE doc_id%50=0 UNION ALL SELECT file, -doc_id-1, 'train' FROM genomes WHERE doc_id%70=0)"""


def _manifest(spark, sf):
    g = genomes(spark, sf).select(F.col("file").alias("path"), F.col("doc_id").alias("seq_index"))
    k = F.col("seq_index") % 5
    main = g.withColumn("split", F.when(k == 0, "val").when(k == 1, "Test ").otherwise("train"))
    twice = g.where("seq_index % 50 = 0").withColumn("split", F.lit("train"))
    bad = g.where("seq_index % 70 = 0").select("path", (-F.col("seq_index") - 1).alias("seq_index"), F.lit("train").alias("split"))
    return main.union(twice).union(bad), g


@query("SRC8_manifest_conflicts", with_ctes(f""", {MAN} SELECT path, seq_index, CASE WHEN seq_index<0 THEN 'negative index' ELSE 'train and eval overlap' END AS problem FROM man GROUP BY path, seq_index
 HAVING seq_index<0 OR count(DISTINCT CASE WHEN split='train' THEN 'train' ELSE 'eval' END)>1""", "genomes"))
def src8(spark, sf):
    manifest, g = _manifest(spark, sf)
    return cp.manifest_conflicts(manifest, g)


@query("SPL11_manifest_split", with_ctes("SELECT file AS path, doc_id AS seq_index, CASE WHEN doc_id%5<2 THEN 'eval' ELSE 'train' END AS split FROM genomes", "genomes"))
def spl11(spark, sf):
    _, g = _manifest(spark, sf)
    k = F.col("seq_index") % 5
    return cp.manifest_split(g.withColumn("split", F.when(k == 0, "val").when(k == 1, "test").otherwise("train")), g)


@query("SPL12_length_batches", with_ctes("""SELECT doc_id, batch, md5('9:'||batch) AS batch_order FROM (SELECT doc_id, (row_number() OVER (ORDER BY n, doc_id)-1)//16 AS batch FROM genomes)""", "genomes"))
def spl12(spark, sf):
    return cp.length_batches(genomes(spark, sf).select("doc_id", "n"), "doc_id", "n", 16, 7, 2).drop("n")


# Alias cells in integers: a source of weight w has n*w shares of a cell of t; light cells (n*w <= t) are filled up by heavy ones in order.
@query("SPL13_weighted_sources", """WITH w AS (SELECT source, count(*)::bigint AS w FROM documents GROUP BY source), c AS (SELECT sum(w)::bigint AS t, count(*)::bigint AS n FROM w),
 l AS (SELECT source, w*n AS own, sum(t-w*n) OVER (ORDER BY source) AS upto, row_number() OVER (ORDER BY source) AS i FROM w, c WHERE w*n<=t),
 h AS (SELECT source, sum(w*n-t) OVER (ORDER BY source) AS upto, row_number() OVER (ORDER BY source) AS j FROM w, c WHERE w*n>t),
 cells AS (
  SELECT l.source, own AS stays, (SELECT min_by(h.source, h.j) FROM h, c WHERE h.upto > l.upto-(t-own)) AS other FROM l, c
  UNION ALL SELECT h.source, t + h.upto - coalesce((SELECT min(l.upto) FROM l WHERE l.upto >= h.upto), h.upto), (SELECT g.source FROM h g WHERE g.j=h.j+1) FROM h, c),
 a AS (SELECT row_number() OVER (ORDER BY source)-1 AS cell, source, stays, other FROM cells),
 d AS (SELECT s AS step, ('0x'||left(md5('4:'||s),13))::bigint / 4503599627370496.0::double AS u FROM range(1,(SELECT count(*) FROM documents)+1) q(s)),
 e AS (SELECT step, floor(u*n)::bigint AS cell, u*n-floor(u*n) AS part, t FROM d, c)
SELECT step, CASE WHEN part < stays::double/t THEN source ELSE coalesce(other, source) END AS source FROM e JOIN a USING (cell)""")
def spl13(spark, sf):
    docs = read(spark, sf, "documents")
    weights = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return cp.source_draws(weights, "source", "weight", docs.count(), 4)


@query("SPL14_round_robin", """SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) WHERE source<>'src3' OR turn<=4""")
def spl14(spark, sf):
    return cp.interleave(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", {"src3": 4})


AUG = lambda tag: u("'21'", "row_id", f"'{tag}'")


@query("SPL15_reverse_augmentation", with_ctes(f"SELECT row_id, CASE WHEN {AUG('strand')}<0.5 THEN reverse(translate(sequence,'ACGTN','TGCAN')) ELSE sequence END AS augmented FROM constructs", "constructs"))
def spl15(spark, sf):
    return cp.augment(constructs(spark, sf).select("row_id", "sequence"), "row_id", "sequence", 0.5, 0.0, 21).select("row_id", "augmented")


@query("SPL15_indel_augmentation", with_ctes(f"""SELECT row_id, CASE WHEN {AUG('indel')}<0.6 AND length(sequence)>=2 THEN length(sequence)+CASE WHEN {AUG('kind')}<0.5 THEN 1 ELSE -1 END ELSE length(sequence) END AS n FROM constructs""", "constructs"))
def spl15i(spark, sf):
    out = cp.augment(constructs(spark, sf).select("row_id", "sequence"), "row_id", "sequence", 0.0, 0.6, 21)
    return out.select("row_id", F.length("augmented").alias("n"))


def _ids(spark, sf):
    df = talk_seqs(spark, sf)
    return df.select("train_id", F.slice(seq.base_tokens("sequence", 200)["input_ids"], F.lit(1), F.length("sequence")).alias("ids"))


MK = lambda tag: u("'8'", "train_id", "i", f"'{tag}'")


@query("SPL16_token_masking", with_ctes(f""", p AS (SELECT train_id, unnest(range(0,length(sequence))) AS i FROM talk_seqs), q AS (SELECT train_id, {MK('pick')}<0.15 AS c, {MK('kind')} AS k FROM p)
SELECT train_id, count(*) FILTER (c) AS chosen, count(*) FILTER (c AND k<0.8) AS masked FROM q GROUP BY train_id""", "talk_seqs"))
def spl16(spark, sf):
    out = cp.mask_tokens(_ids(spark, sf), "train_id", "ids", 0.15, 8)
    count = lambda a, f: F.size(F.filter(a, f))
    return out.select("train_id", count("labels", lambda x: x != -100).alias("chosen"), count("masked_ids", lambda x: x == 4).alias("masked"))


@query("SPL16_span_masking", with_ctes("SELECT train_id, greatest(1,round(length(sequence)*0.2))::bigint AS masked_at_most, length(sequence) AS n, true AS within FROM talk_seqs", "talk_seqs"))
def spl16s(spark, sf):
    out = cp.mask_spans(_ids(spark, sf), "train_id", "ids", 0.2, 5, 8)
    want = F.greatest(F.lit(1), F.round(F.size("ids") * 0.2)).cast("bigint")
    held = F.size(F.filter("masked_ids", lambda x: x == 4))
    return out.select("train_id", want.alias("masked_at_most"), F.size("masked_ids").alias("n"), (held <= want).alias("within"))


@query("SPL2_desired_sizes", with_ctes("SELECT source, greatest(1,round_even(count(*)*0.15,0))::bigint AS desired FROM constructs GROUP BY source", "constructs"))
def spl2(spark, sf):
    n = constructs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", F.greatest(F.lit(1), F.bround(F.col("n") * 0.15)).cast("bigint").alias("desired"))


# --- statistics -------------------------------------------------------------------

@query("AGG12_inferred_limits", with_ctes(f"""SELECT lang, greatest(1,round_even(median(length(sequence)),0))::int AS sequence_length, {r6('greatest(0,avg(gc)-greatest(2*stddev_pop(gc),0.08))')} AS gc_low, {r6('least(1,avg(gc)+greatest(2*stddev_pop(gc),0.08))')} AS gc_high FROM assay GROUP BY lang""", "assay"))
def agg12(spark, sf):
    return _r(cp.inferred_limits(constructs(spark, sf), "sequence", ["lang"]), "lang")


def grams(t, k):
    return f"SELECT substr(g,1,{k - 1}) AS context, substr(g,{k},1) AS next, count(*) AS rows FROM (SELECT unnest(list_transform(range(1,length(sequence)+({2 - k})), lambda i: substr(sequence,i,{k}))) AS g FROM {t} WHERE length(sequence)>={k}) GROUP BY ALL"


@query("AGG14_ngram_counts", with_ctes(grams("genomes", 3), "genomes"))
def agg14(spark, sf):
    return cp.ngram_counts(genomes(spark, sf), "sequence", 2)


@query("AGG14_markov_scores", with_ctes(f""", a AS ({grams('genomes', 3)}), b AS ({grams('talk_seqs', 3)}), f AS (SELECT context, next, a.rows AS seen, coalesce(b.rows,0) AS scored FROM a LEFT JOIN b USING (context, next)),
 t AS (SELECT *, sum(seen+1) OVER (PARTITION BY context) AS total, row_number() OVER (PARTITION BY context ORDER BY seen DESC, next) AS rk FROM f)
SELECT sum(scored)::bigint AS count, {r6('-sum(scored*ln((seen+1)/total))/sum(scored)')} AS loss, {r6('-sum(scored*ln((seen+1)/total))/sum(scored)/ln(2)')} AS bits_per_base, {r6('sum(scored) FILTER (rk=1)/sum(scored)')} AS top1_accuracy FROM t""", "genomes", "talk_seqs"))
def agg14m(spark, sf):
    return _r(cp.markov_scores(genomes(spark, sf), talk_seqs(spark, sf), "sequence", 2))


@query("AGG14_unigram_scores", with_ctes(f""", c AS ({grams('genomes', 1)}), p AS (SELECT rows, rows::double/sum(rows) OVER () AS p FROM c)
SELECT sum(rows)::bigint AS count, {r6('-sum(p*ln(p))')} AS loss, {r6('-sum(p*ln(p))/ln(2)')} AS bits_per_base, {r6('max(p)')} AS top1_accuracy FROM p""", "genomes"))
def agg14u(spark, sf):
    return _r(cp.unigram_scores(genomes(spark, sf), "sequence"))


@query("AGG15_calibration_error", with_ctes(f"""SELECT lang, {r6('sum(n*abs(a-c))/sum(n)')} AS ece FROM (SELECT lang, least(floor(score*10),9) AS b, count(*) AS n, avg(score) AS c, avg(label) AS a FROM assay GROUP BY 1,2) GROUP BY lang""", "assay"))
def agg15(spark, sf):
    return _r(cp.calibration_error(assay(spark, sf), "score", "label", ["lang"]), "lang")


@query("AGG16_class_accuracy", with_ctes(f"""SELECT label, {r6('avg(((score>=0.5)::int=label)::int)')} AS accuracy, count(*) AS rows, {r6('avg(abs(prediction-target))')} AS loss, {r6('exp(avg(abs(prediction-target)))')} AS perplexity, {r6('avg(abs(prediction-target))/ln(2)')} AS bits FROM assay GROUP BY label""", "assay"))
def agg16(spark, sf):
    df = assay(spark, sf).withColumns({"ok": (F.col("score") >= 0.5).cast("int") == F.col("label"), "loss": F.abs(F.col("prediction") - F.col("target"))})
    return _r(cp.class_accuracy(df, "label", "ok", "loss"), "label")


PREF = """act AS (SELECT pre, avg(target) AS a, avg(prediction) AS b FROM (SELECT left(sequence,35) AS pre, target, prediction FROM assay WHERE win=0 AND length(sequence)>=35) GROUP BY pre),
 j AS (SELECT c.row_id, a, b, count(*) OVER (PARTITION BY left(c.sequence,35))>1 AS amb FROM constructs c LEFT JOIN act ON pre=left(c.sequence,35))"""


def _cohort(spark, sf):
    act = assay(spark, sf).where((F.col("win") == 0) & (F.length("sequence") >= 35)).groupBy(F.substring("sequence", 1, 35).alias("pre")).agg(
        F.avg("target").alias("a"), F.avg("prediction").alias("b"))
    return cp.prefix_lookup(constructs(spark, sf).select("row_id", "sequence"), "sequence", act, "pre")


@query("JOIN12_prefix_lookup", with_ctes(f", {PREF} SELECT row_id, {r6('a', 8)} AS a, {r6('b', 8)} AS b, amb AS ambiguous FROM j", "assay"))
def join12(spark, sf):
    return _r(_cohort(spark, sf).select("row_id", "a", "b", "ambiguous"), "row_id", digits=8)


@query("AGG17_cohort_counters", with_ctes(f""", {PREF} SELECT count(*) AS rows, count(*) FILTER (a IS NOT NULL) AS joined_rows, count(*) FILTER (a IS NOT NULL AND amb) AS ambiguous_prefix_rows,
 count(*) FILTER (NOT amb AND abs(a-b)>0.25) AS replicate_filter_failures, count(*) FILTER (NOT amb AND abs(a-b)<=0.25 AND NOT (a+b)/2 BETWEEN 3.5 AND 4.5) AS range_filter_failures,
 count(*) FILTER (NOT amb AND abs(a-b)<=0.25 AND (a+b)/2 BETWEEN 3.5 AND 4.5) AS accepted_rows FROM j""", "assay"))
def agg17(spark, sf):
    return cp.cohort_counters(_cohort(spark, sf), "a", "b", 0.25, 3.5, 4.5)


@query("AGG18_gc_bin_weights", with_ctes(f"""SELECT doc_id, b AS gc_bin, {r6('1.0/count(*) OVER (PARTITION BY b)')} AS weight FROM (SELECT doc_id, CASE WHEN n=0 OR doc_id%17=0 THEN 50 ELSE (floor(100*(length(sequence)-length(replace(replace(sequence,'G',''),'C','')))::double/n/10)*10) END::int AS b FROM genomes)""", "genomes"))
def agg18(spark, sf):
    df = genomes(spark, sf).withColumn("gc", F.when((F.col("n") > 0) & (F.col("doc_id") % 17 != 0), 100 * seq.gc_fraction("sequence")))
    return _r(cp.gc_bin_weights(df, "doc_id", "gc"), "doc_id")


# --- generation -------------------------------------------------------------------

@query("CAND11_random_and_mutated", with_ctes("SELECT train_id, length(sequence) AS random_length, length(sequence) AS mutated_length, 0 AS bad FROM talk_seqs", "talk_seqs"))
def cand11(spark, sf):
    k = (F.lit(5), F.col("train_id"))
    df = talk_seqs(spark, sf).withColumns({"r": gen.random_dna(F.length("sequence"), F.lit(0.6), *k), "m": gen.mutate("sequence", 0.1, *k)})
    bad = F.when(F.col("r").rlike("^[ACGT]*$") & F.col("m").rlike("^[ACGT]*$"), 0).otherwise(1)
    return df.select("train_id", F.length("r").alias("random_length"), F.length("m").alias("mutated_length"), bad.alias("bad"))


@query("CAND11_recombined")
def cand11r(spark, sf):
    from .views import neighbors

    return neighbors(spark, sf).select("row_id", gen.recombine("parent", "child", F.lit(5), F.col("row_id")).alias("child"))


@query("CAND12_evolutionary_designs")
def cand12(spark, sf):
    from .views import benchmark_seqs

    train = benchmark_seqs(spark, sf)
    score = lambda df: df.withColumn("generation_score", F.round(1 - F.abs(F.col("gc") - 0.5), 6))
    designs, _ = gen.evolve(train, "sequence", max(64, train.count()), score, batch=128, min_distance=8)
    return designs.select("round", "attempt", "sequence", "novelty", "generation_score")


def _masked(spark, sf, mode):
    parents = read(spark, sf, "benchmark").select("item_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES).alias("parent"))
    parents = parents.withColumn("parent", F.regexp_replace("parent", "GGG", "NNN"))
    return gen.masked_pool(parents, "item_id", "parent", 6, mode, 0.08, 13)


@query("CAND13_masked_pool", f"SELECT item_id, 6 AS designs FROM benchmark WHERE contains({LETTERS},'GGG')")
def cand13(spark, sf):
    out = _masked(spark, sf, "Mask-fill")
    return out.where(F.col("parent").contains("N")).groupBy("item_id").agg(F.count(F.lit(1)).alias("designs"))


@query("CAND14_farthest_first")
def cand14(spark, sf):
    from ..operators.candidates import farthest_first

    return farthest_first(_masked(spark, sf, "Diversity sampling").withColumn("base", F.replace("parent", F.lit("N"), F.lit("A"))), "item_id", "sequence", "base", 6)


@query("CAND16_position_composition", f"""WITH m AS (SELECT {LETTERS} AS s FROM benchmark), p AS (SELECT regexp_replace(s,'GGG','NNN','g') AS parent, s FROM m),
 c AS (SELECT unnest(range(1,length(parent)+1)) AS position, parent, s FROM p), h AS (SELECT position, substr(s,position,1) AS base, count(*) AS n FROM c WHERE substr(parent,position,1)='N' GROUP BY 1,2)
SELECT position, base, {r6('n/sum(n) OVER (PARTITION BY position)')} AS fraction FROM h""")
def cand16(spark, sf):
    s = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    df = read(spark, sf, "benchmark").select(s.alias("s")).withColumn("parent", F.regexp_replace("s", "GGG", "NNN"))
    return _r(gen.position_composition(df, "parent", "s"), "position", "base")


NB = "SELECT row_id, parent, child, unnest(range(1,length(parent)+1)) AS i FROM neighbors WHERE length(parent)=length(child)"


@query("CAND16_mutation_rates", with_ctes(f"SELECT i AS position, {r6('avg((substr(parent,i,1)<>substr(child,i,1))::int)')} AS rate, count(*) AS rows FROM ({NB}) GROUP BY i", "neighbors"))
def cand16r(spark, sf):
    from .views import neighbors

    return _r(gen.mutation_profile(neighbors(spark, sf), "row_id", "parent", "child")[1], "position")


# --- sources and sinks ------------------------------------------------------------

def _scratch(spark, name):
    """A new folder next to the session's checkpoint folder, for write-and-read-back queries."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _lab_table(spark, sf):
    df = assay(spark, sf)
    return df.select(F.col("sequence_id").alias("Sequence ID"), F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("sequence")).alias("DNA (5'-3')"),
                     F.col("sequence").alias("insert"), F.col("target").cast("string").alias("Measured--Value"))


ALIAS = {"sequence": ["DNA (5'-3')", "insert"], "target": ["measured value"]}


@query("SRC1_delimited_tables", with_ctes("SELECT sequence_id, sequence, target::varchar AS target FROM assay", "assay"))
def src1(spark, sf):
    path = _scratch(spark, "lab") + ".csv"
    _lab_table(spark, sf).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    raw = tables.read_table(spark, path, clean=False)
    return tables.apply_aliases(raw, ALIAS, ["sequence", "target"]).select("sequence_id", "sequence", "target")


@query("SRC2_clean_headers", with_ctes("SELECT sequence_id, target::varchar AS measured_value FROM assay", "assay"))
def src2(spark, sf):
    return tables.apply_aliases(_lab_table(spark, sf), {}).select("sequence_id", "measured_value")


@query("SRC3_alias_resolution", with_ctes("SELECT sequence_id, sequence FROM assay", "assay"))
def src3(spark, sf):
    return tables.apply_aliases(_lab_table(spark, sf), ALIAS).select("sequence_id", "sequence")


@query("SRC4_strict_aliases", with_ctes("SELECT sequence_id, sequence, target::varchar AS target FROM assay", "assay"))
def src4(spark, sf):
    one = _lab_table(spark, sf).drop("DNA (5'-3')")
    return tables.apply_aliases(one, {**ALIAS, "target": ["Measured--Value"]}, strict=True).select("sequence_id", "sequence", "target")


@query("SRC5_multi_file_union", """SELECT kind, count(*) AS rows, count(score) AS scored FROM (SELECT 'customer' AS kind, c_acctbal AS score FROM customer UNION ALL SELECT 'supplier', NULL FROM supplier) GROUP BY kind""")
def src5(spark, sf):
    a, b = _scratch(spark, "customer") + ".csv", _scratch(spark, "supplier") + ".tsv"
    read(spark, sf, "customer").select(F.col("c_name").alias("Name"), F.col("c_acctbal").cast("string").alias("Score")).write.csv(a, header=True)
    read(spark, sf, "supplier").select(F.col("s_name").alias("name")).write.csv(b, header=True, sep="\t")
    df = tables.union_tables(spark, [a, b], {"name": []}, ["name"])
    kind = F.when(F.col("_source_file").contains("customer-"), "customer").otherwise("supplier")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.count("score").alias("scored"))


@query("SRC6_fasta_records", f"SELECT 'doc '||doc_id AS header, {LETTERS} AS sequence, length({LETTERS}) AS length FROM documents")
def src6(spark, sf):
    path = _scratch(spark, "fasta")
    body = F.regexp_replace("sequence", "(.{1,60})", "$1\n")
    genomes(spark, sf).select(F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\n"), body)).write.text(path)
    return fasta.read_fasta(spark, path).select("header", "sequence", "length")


@query("SRC7_fasta_check", with_ctes(r"SELECT file, count(*) AS sequences, sum(length(s))::bigint AS bases, count(*) FILTER (NOT regexp_matches(s,'^[ACGT]*$')) AS invalid_sequences FROM (SELECT file, CASE WHEN doc_id%9=0 THEN sequence||'N' ELSE sequence END AS s FROM genomes) GROUP BY file", "genomes"))
def src7(spark, sf):
    df = genomes(spark, sf).withColumn("sequence", F.when(F.col("doc_id") % 9 == 0, F.concat("sequence", F.lit("N"))).otherwise(F.col("sequence")))
    return fasta.check_fasta(df, "file")


@query("SRC9_pruned_parquet", "SELECT doc_id, source FROM documents")
def src9(spark, sf):
    return tables.select_columns(spark, f"{sf}/documents.parquet", ["doc_id", "source"])


@query("SRC10_measurement_lines", with_ctes("SELECT * FROM (SELECT sequence, round(target,3) AS activity, row_number() OVER (ORDER BY row_id) AS n FROM assay WHERE target IS NOT NULL) WHERE n>7", "assay"))
def src10(spark, sf):
    path = _scratch(spark, "lines")
    sep = F.when(F.col("row_id") % 3 == 0, "\t").when(F.col("row_id") % 3 == 1, ",").otherwise("  ")
    assay(spark, sf).where("target is not null").orderBy("row_id").select(F.concat(F.lower("sequence"), sep, F.round("target", 3).cast("string"))).write.text(path)
    return tables.read_measurements(spark, path, offset=7)


@query("SNK1_formula_guard", r"""SELECT doc_id, CASE WHEN regexp_matches(t,'^\s*[=+\-@]') OR regexp_matches(t,'^[\t\r\n]') THEN '''' || t ELSE t END AS cell FROM (
 SELECT doc_id, CASE doc_id%6 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN ' +1' WHEN 2 THEN '-x' WHEN 3 THEN '@a' WHEN 4 THEN chr(9)||'b' ELSE source END AS t FROM documents)""")
def snk1(spark, sf):
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "=SUM(A1)").when(k == 1, " +1").when(k == 2, "-x").when(k == 3, "@a").when(k == 4, "\tb").otherwise(F.col("source"))
    return tables.guard_formulas(read(spark, sf, "documents").select("doc_id", t.alias("cell")))


@query("SNK2_split_tables", with_ctes("""SELECT CASE ('0x'||left(sha256(sequence),8))::bigint%10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS rows FROM constructs GROUP BY 1""", "constructs"))
def snk2(spark, sf):
    path = _scratch(spark, "splits")
    tables.write_splits(constructs(spark, sf).select("row_id", "sequence", sp.hash_split(F.sha2("sequence", 256)).alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("SNK3_report_json", """SELECT '{"c_custkey":'||c_custkey||',"c_name":"'||c_name||'"}' AS value FROM customer""")
def snk3(spark, sf):
    path = _scratch(spark, "report")
    tables.write_report(read(spark, sf, "customer").select("c_name", "c_custkey"), path)
    return spark.read.text(path)


#: The files of the tables that the SQL is run on.
FILES = "(SELECT regexp_extract(filename, '[^/]+$') AS file, size, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/*'))"


@query("SNK4_file_inventory", f"SELECT * FROM {FILES}")
def snk4(spark, sf):
    inv = tables.inventory(spark, sf)
    return inv.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "sha256")


@query("SNK5_artifact_verification", f"""SELECT file||'.gone' AS file, 'missing' AS problem FROM {FILES}
 UNION ALL SELECT file, CASE WHEN starts_with(file,'part') THEN 'size mismatch' ELSE 'checksum mismatch' END FROM {FILES} WHERE starts_with(file,'part') OR starts_with(file,'nation')""")
def snk5(spark, sf):
    inv = tables.inventory(spark, sf)
    name = F.element_at(F.split("path", "/"), -1)
    claimed = inv.select("path", F.when(name.startswith("part"), F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                         F.when(name.startswith("nation"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    gone = inv.select(F.concat("path", F.lit(".gone")).alias("path"), "size", "sha256")
    out = tables.verify_inventory(claimed.union(gone), inv)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "problem")
