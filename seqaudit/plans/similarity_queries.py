"""Similarity components, leakage-safe split and cross-split checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import components as comp, metric, similarity as sim, split as sp
from ..session import cut, read
from .catalog import query
from .views import RC, assay, benchmark_seqs, constructs, cte, neighbors, r6, with_ctes

T = 0.9
K = 8

# Oracle side: distinct token sets, frequency-ordered prefixes, verified pairs.
KMERS = (f"CASE WHEN length(sequence)<{K} THEN [sequence] ELSE list_distinct(list_transform(range(1,length(sequence)-{K - 2}),"
         f" lambda i: least(substr(sequence,i,{K}), {RC.format(f'substr(sequence,i,{K})')}))) END")
MOTIFS = (f"CASE WHEN length(sequence)<{K} THEN ['0:'||sequence] ELSE list_transform(range(1,length(sequence)-{K - 2}),"
          f" lambda i: (i-1)||':'||substr(sequence,i,{K})) END")


def jaccard_ctes(prefix: str, tokens: str, t: float, table: str = "constructs") -> None:
    cte(f"{prefix}_sets", f"SELECT row_id, list_sort({tokens}) AS toks FROM {table}", (table,))
    cte(f"{prefix}_reps", f"SELECT toks, min(row_id) AS rep FROM {prefix}_sets GROUP BY toks", (f"{prefix}_sets",))
    cte(f"{prefix}_tok", f"SELECT rep, unnest(toks) AS tok, len(toks) AS n FROM {prefix}_reps", (f"{prefix}_reps",))
    cte(f"{prefix}_freq", f"SELECT tok, count(*) AS f FROM {prefix}_tok GROUP BY tok", (f"{prefix}_tok",))
    cte(f"{prefix}_pre", f"""SELECT * FROM (SELECT rep, tok, n, row_number() OVER (PARTITION BY rep ORDER BY f, tok) AS pos
        FROM {prefix}_tok JOIN {prefix}_freq USING (tok)) WHERE pos <= n-ceil({t}*n-1e-9)+1""", (f"{prefix}_freq",))
    cte(f"{prefix}_cand", f"""SELECT DISTINCT a.rep AS a, b.rep AS b FROM {prefix}_pre a JOIN {prefix}_pre b ON a.tok=b.tok AND a.rep<b.rep
        AND least(a.n,b.n)>={t}*greatest(a.n,b.n)-1e-9""", (f"{prefix}_pre",))
    cte(f"{prefix}_over", f"""SELECT c.a, c.b, len(x.toks) AS na, len(y.toks) AS nb, len(list_intersect(x.toks,y.toks)) AS o
        FROM {prefix}_cand c JOIN {prefix}_reps x ON c.a=x.rep JOIN {prefix}_reps y ON c.b=y.rep""", (f"{prefix}_cand",))
    cte(f"{prefix}_edges", f"""SELECT a, b FROM {prefix}_over WHERE o::double/(na+nb-o) >= {t}-1e-9
        UNION ALL SELECT rep, row_id FROM {prefix}_sets JOIN {prefix}_reps USING (toks) WHERE rep<>row_id""", (f"{prefix}_over",))


def component_ctes(prefix: str, edges: str, vertices: str, vertex: str, needs: tuple[str, ...]) -> None:
    """Smallest reachable vertex of every vertex, by keyed recursion."""
    cte(f"{prefix}_sym", f"SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}", needs)
    cte(f"{prefix}_walk", f"""SELECT {vertex} AS v, {vertex} AS root FROM {vertices}
        UNION SELECT s.b AS v, w.root FROM {prefix}_walk w JOIN {prefix}_sym s ON s.a=w.v WHERE w.root < s.b""",
        (f"{prefix}_sym",))
    cte(f"{prefix}_comp", f"SELECT v AS row_id, min(root) AS component FROM {prefix}_walk GROUP BY v", (f"{prefix}_walk",))


jaccard_ctes("kj", KMERS, T)
jaccard_ctes("pm", MOTIFS, T)
component_ctes("kj", "kj_edges", "constructs", "row_id", ("kj_edges",))
component_ctes("pm", "pm_edges", "constructs", "row_id", ("pm_edges",))


def _components(spark, sf, policy):
    df = constructs(spark, sf).select("row_id", "sequence")
    return sim.leakage_components(df, "row_id", "sequence", policy=policy, threshold=T, k=K).select(
        F.col("id").alias("row_id"), "component")


COMPONENT_SQL = "SELECT row_id, component FROM {0}_comp"


@query("JOIN2_set_similarity_components", with_ctes(COMPONENT_SQL.format("kj"), "kj_comp", recursive=True))
def set_similarity(spark, sf):
    return _components(spark, sf, "kmer_jaccard")


@query("JOIN6_positional_motif_components", with_ctes(COMPONENT_SQL.format("pm"), "pm_comp", recursive=True))
def positional(spark, sf):
    return _components(spark, sf, "position_aware_motif")


@query("JOIN4_reverse_complement_components", with_ctes(f"""
SELECT row_id, min(row_id) OVER (PARTITION BY least(sequence, {RC.format('sequence')})) AS component FROM constructs""", "constructs"))
def reverse_complement(spark, sf):
    return _components(spark, sf, "exact_reverse_complement")


@query("JOIN5_edit_distance_components")
def edit_distance(spark, sf):
    return _components(spark, sf, "edit_distance")


def _split(spark, sf, **kw):
    df = assay(spark, sf).select("row_id", "sequence", "doc_id", "source")
    return sp.leakage_safe_split(df, "row_id", "sequence", group_cols=["doc_id"], threshold=T, k=K, **kw)


# The split: rows of one document are one group, so components are components of documents.
cte("doc_links", """SELECT DISTINCT a//100000 AS a, b//100000 AS b FROM kj_edges WHERE a//100000 <> b//100000""", ("kj_edges",))
cte("doc_vertices", "SELECT DISTINCT doc_id FROM constructs", ("constructs",))
component_ctes("doc", "doc_links", "doc_vertices", "doc_id", ("doc_links", "doc_vertices"))
def digest_ctes(prefix: str, rows: str, key: str, value: str, needs: tuple[str, ...]) -> None:
    """Size and digest per key: counted values, one digest per four leading characters, and a digest of those."""
    cte(f"{prefix}_lines", f"SELECT {key} AS k, {value} AS v, {value}||' x'||count(*) AS line, count(*) AS n FROM {rows} GROUP BY {key}, {value}", needs)
    cte(f"{prefix}_shards", f"SELECT k, left(v,4) AS shard, sum(n) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM {prefix}_lines GROUP BY k, left(v,4)", (f"{prefix}_lines",))
    cte(f"{prefix}_digest", f"SELECT k, sum(n)::bigint AS size, sha256(string_agg(d, chr(10) ORDER BY shard)) AS digest FROM {prefix}_shards GROUP BY k", (f"{prefix}_shards",))


digest_ctes("dc", "constructs c JOIN doc_comp d ON c.doc_id=d.row_id", "d.component", "sha256(sequence)||'|doc_id='||doc_id", ("constructs", "doc_comp"))
cte("clusters", "SELECT k AS component, size, digest AS fingerprint FROM dc_digest", ("dc_digest",))
cte("filled", """SELECT *, sum(size) OVER (ORDER BY size, sha256('13:'||fingerprint) DESC, component ROWS UNBOUNDED PRECEDING)-size AS ex,
 row_number() OVER (ORDER BY size, sha256('13:'||fingerprint) DESC, component) AS pos, count(*) OVER () AS c, sum(size) OVER () AS n FROM clusters""", ("clusters",))
cte("tested", """SELECT *, greatest(1, round_even(n*0.15,0)) AS want, ex < greatest(1, round_even(n*0.15,0)) AND pos < c AS is_test FROM filled""", ("filled",))
cte("cluster_split", """SELECT *, CASE WHEN is_test THEN 'test' WHEN ex - (SELECT coalesce(sum(size),0) FROM tested WHERE is_test) < want AND pos < c THEN 'val' ELSE 'train' END AS split FROM tested""", ("tested",))
cte("split_rows", """SELECT c.row_id, c.doc_id, c.sequence, left(s.fingerprint,16) AS leakage_cluster, s.split
 FROM constructs c JOIN doc_comp d ON c.doc_id=d.row_id JOIN cluster_split s ON s.component=d.component""", ("constructs", "cluster_split"))


@query("SPL1_leakage_safe_split", with_ctes("SELECT row_id, leakage_cluster, split FROM split_rows", "split_rows", recursive=True))
def leakage_safe_split(spark, sf):
    return _split(spark, sf).select(F.col("id").alias("row_id"), "leakage_cluster", "split")


@query("SPL1_pair_diagnostics", with_ctes("""SELECT count(*) AS rows, (count(*)*(count(*)-1)//2)::bigint AS possible_pairs, count(DISTINCT component) AS components, true AS few_candidates, true AS adds_up
 FROM kj_comp""", "kj_comp", recursive=True))
def pair_diagnostics(spark, sf):
    """How many pairs the exact search compares: at most 2 % of all."""
    df = constructs(spark, sf).select(F.col("row_id").alias("id"), F.col("sequence").alias("payload"))
    d = sim.pair_diagnostics(df, sim.token_sets("canonical_kmer_jaccard", K), T)
    return d.select("rows", "possible_pairs", "components", (F.col("candidate_pairs") <= 0.02 * F.col("possible_pairs")).alias("few_candidates"),
                    ((F.col("candidate_pairs") + F.col("skipped_pairs") == F.col("possible_pairs")) & (
                        F.col("verified_pairs") <= F.col("candidate_pairs"))).alias("adds_up"))


@query("AGG9_split_sizes", with_ctes(
    "SELECT split, count(*) AS rows, count(DISTINCT leakage_cluster) AS clusters FROM split_rows GROUP BY split", "split_rows", recursive=True))
def split_sizes(spark, sf):
    return sp.split_sizes(_split(spark, sf))


# --- pair scores, groups, cross-split checks --------------------------------------

PK = KMERS.replace("sequence", "{0}")
PM = MOTIFS.replace("sequence", "{0}")
JAC = "len(list_intersect({0},{1}))::double/(len({0})+len({1})-len(list_intersect({0},{1})))"


@query("JOIN1_kmer_jaccard", with_ctes(f"SELECT row_id, {r6(JAC.format('a', 'b'))} AS similarity FROM (SELECT row_id, {PK.format('parent')} AS a, {PK.format('child')} AS b FROM neighbors)", "neighbors"))
def kmer_jaccard(spark, sf):
    return neighbors(spark, sf).select("row_id", F.round(sim.jaccard_once(seq.kmers("parent", K), seq.kmers("child", K)), 6).alias("similarity"))


@query("JOIN8_pair_scores", with_ctes(f"""SELECT row_id, {r6(JAC.format('pa', 'pb'))} AS motif, {r6('1-levenshtein(parent,child)::double/greatest(length(parent),length(child))')} AS edit,
 (least(parent,{RC.format('parent')})=least(child,{RC.format('child')}))::int::double AS strand FROM (SELECT row_id, parent, child, {PM.format('parent')} AS pa, {PM.format('child')} AS pb FROM neighbors)""", "neighbors"))
def pair_scores(spark, sf):
    p = lambda name: F.round(sim.pair_similarity("parent", "child", name, K), 6)
    return neighbors(spark, sf).select("row_id", p("position_aware_motif").alias("motif"), p("edit_distance").alias("edit"), p("exact_reverse_complement").alias("strand"))


cte("family_edges", """SELECT min(doc_id) OVER (PARTITION BY n_chars) AS a, doc_id AS b FROM documents UNION ALL SELECT min(doc_id) OVER (PARTITION BY md5(text)), doc_id FROM documents""")
component_ctes("family", "family_edges", "documents", "doc_id", ("family_edges",))


@query("JOIN7_family_components", with_ctes("SELECT row_id AS doc_id, component FROM family_comp", "family_comp", recursive=True))
def family(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("body"))
    return sim.leakage_components(docs, "doc_id", "body", ["n_chars", "body"], "customer_family_labels").select(F.col("id").alias("doc_id"), "component")


@query("JOIN9_connected_components", """WITH RECURSIVE w AS (SELECT c_custkey AS v, c_custkey AS low FROM customer UNION ALL SELECT w.v, c.c_custkey-c.c_nationkey*7-1 FROM w JOIN customer c ON c.c_custkey=w.low WHERE c.c_custkey-c.c_nationkey*7-1>=0)
SELECT v AS id, min(low) AS component FROM w GROUP BY v""")
def connected(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - F.col("c_nationkey") * 7 - 1).alias("up"))
    edges = c.where("up >= 0").select(F.col("id").alias("src"), F.col("up").alias("dst"))
    return comp.connected_components(c.select("id"), edges)


SIDE = "CASE ('0x'||left(md5(doc_id::varchar),8))::bigint%5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"
cte("sides", f"SELECT row_id, sequence, source, {SIDE} AS split FROM constructs WHERE {SIDE}<>'val'", ("constructs",))
jaccard_ctes("xs", KMERS, T, "sides")
component_ctes("xs", "xs_edges", "sides", "row_id", ("xs_edges",))


def _sides(spark, sf):
    b = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 5
    return constructs(spark, sf).withColumn("split", F.when(b == 0, "test").when(b == 1, "val").otherwise("train"))


@query("JOIN10_cross_split_similarity", with_ctes("""SELECT component, count(*) FILTER (split='train') AS train_rows, count(*) FILTER (split='test') AS test_rows FROM xs_comp JOIN sides USING (row_id)
 GROUP BY component HAVING count(*) FILTER (split='train')>0 AND count(*) FILTER (split='test')>0""", "xs_comp", recursive=True))
def cross_split(spark, sf):
    return sim.spanning_components(_sides(spark, sf), "row_id", "sequence", "split", "canonical_kmer_jaccard", T, K)


@query("JOIN10_cross_split_examples", with_ctes("""SELECT component, true AS proved FROM xs_comp JOIN sides USING (row_id)
 GROUP BY component HAVING count(*) FILTER (split='train')>0 AND count(*) FILTER (split='test')>0""", "xs_comp", recursive=True))
def cross_split_examples(spark, sf):
    """One proving pair per mixed component; its sides and its similarity are checked against the rows."""
    rows = cut(_sides(spark, sf).select("row_id", "sequence", "split"))
    found = sim.spanning_examples(rows, "row_id", "sequence", "split", "canonical_kmer_jaccard", T, K)
    a, b = (rows.select(F.col("row_id").alias(f"{s}_id"), F.col("split").alias(f"{s}_split"), F.col("sequence").alias(f"{s}_seq")) for s in ("train", "test"))
    checked = found.join(a, "train_id").join(b, "test_id")
    again = sim.jaccard(seq.kmers("train_seq", K), seq.kmers("test_seq", K))
    return checked.select("component", ((F.col("train_split") == "train") & (F.col("test_split") == "test") & (
        F.col("similarity") >= T - 1e-9) & (F.abs(again - F.col("similarity")) < 1e-12)).alias("proved"))


@query("JOIN10_cross_split_groups", with_ctes("""SELECT 'source' AS group_col, source AS value FROM sides GROUP BY source HAVING count(*) FILTER (split='train')>0 AND count(*) FILTER (split='test')>0""", "sides"))
def cross_groups(spark, sf):
    return sim.group_overlaps(_sides(spark, sf), "split", ["source"])


cte("gc_pairs", """SELECT a.cand_id AS a, b.cand_id AS b FROM (SELECT cand_id, (length(sequence)-length(replace(replace(sequence,'G',''),'C','')))::double/length(sequence) AS g FROM benchmark_seqs) a
 JOIN (SELECT cand_id, (length(sequence)-length(replace(replace(sequence,'G',''),'C','')))::double/length(sequence) AS g FROM benchmark_seqs) b ON a.cand_id<b.cand_id AND 1-abs(a.g-b.g)>=0.995""", ("benchmark_seqs",))
component_ctes("gcp", "gc_pairs", "benchmark_seqs", "cand_id", ("gc_pairs",))


@query("JOIN3_plugin_components", with_ctes("SELECT row_id AS cand_id, component FROM gcp_comp", "gcp_comp", recursive=True))
def plugin(spark, sf):
    def near_gc(a, b):
        share = lambda s: s.str.count("[GC]") / s.str.len()
        return 1 - (share(a) - share(b)).abs()

    sim.register_similarity_policy("gc_nearness", near_gc, replace=True)
    df = benchmark_seqs(spark, sf).select("cand_id", "sequence")
    return sim.leakage_components(df, "cand_id", "sequence", policy="gc_nearness", threshold=0.995).select(F.col("id").alias("cand_id"), "component")


@query("UDF1_registered_policy_scores", with_ctes(f"SELECT row_id, {r6('1-abs((length(parent)-length(child))::double/200)')} AS similarity FROM neighbors", "neighbors"))
def udf1(spark, sf):
    sim.register_similarity_policy("length_nearness", lambda a, b: 1 - (a.str.len() - b.str.len()).abs() / 200, replace=True)
    return neighbors(spark, sf).select("row_id", F.round(sim.pair_similarity("parent", "child", "length_nearness"), 6).alias("similarity"))


COS = "list_sum(list_transform(list_zip(a.e,b.e), lambda p: p[1]*p[2]))/(a.n*b.n)"


@query("JOIN20_nearest_cosine", f"""WITH e AS (SELECT vec_id, embedding::double[] AS e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x*x))) AS n FROM embeddings)
SELECT vec_id, {r6('max(s)')} AS similarity FROM (SELECT a.vec_id, {COS} AS s FROM e a JOIN e b ON a.vec_id<>b.vec_id) GROUP BY vec_id""")
def nearest_cosine(spark, sf):
    df = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return metric.nearest_cosine(df, "vec_id", "x").select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("SPL3_split_warnings", """SELECT 'DO NOT TRUST: fewer than 3 leakage-safe clusters are available; validation/test splits may be empty.' AS warning
UNION ALL SELECT 'DO NOT TRUST: requested leakage-safe validation and test split is empty; collect more independent groups.'""")
def warnings(spark, sf):
    """All constructs share one batch value, so there is a single cluster."""
    df = constructs(spark, sf).select("row_id", "sequence", F.lit("one").alias("batch"))
    split = sp.leakage_safe_split(df, "row_id", "sequence", ["batch"], policy="customer_family_labels")
    return sp.split_warnings(sp.split_sizes(split))


@query("SPL17_homology_benchmark")
def homology_benchmark(spark, sf):
    from ..operators import metrics as m

    df = assay(spark, sf).select("row_id", "sequence", "target", "prediction")
    return sp.homology_benchmark(df, "row_id", "sequence", lambda tr, va, te: m.regression_metrics(te, "target", "prediction"))


digest_ctes("mb", "(SELECT 'test' AS s, sha256(sequence) AS h FROM constructs WHERE ('0x'||left(sha256(sequence),8))::bigint%10=0)", "s", "h", ("constructs",))
digest_ctes("ts", "(SELECT 'test' AS s, sha256(sequence) AS h FROM split_rows WHERE split='test')", "s", "h", ("split_rows",))
digest_ctes("cf", "constructs", "doc_id", "sha256(sequence)||'|doc_id='||doc_id", ("constructs",))


@query("AGG10_membership_digest", with_ctes("SELECT k AS split, size AS test_rows, digest AS test_membership_sha256 FROM mb_digest", "mb_digest"))
def membership(spark, sf):
    df = constructs(spark, sf).select(F.sha2("sequence", 256).alias("h"))
    return sp.membership_digest(df.withColumn("split", sp.hash_split("h")), "h")


@query("AGG11_cluster_fingerprints", with_ctes("SELECT k AS component, size, digest AS fingerprint FROM cf_digest", "cf_digest"))
def fingerprints(spark, sf):
    df = constructs(spark, sf).select("row_id", "sequence", "doc_id")
    return sp.fingerprints(df, df.select(F.col("row_id").alias("id"), F.col("doc_id").alias("component")), "row_id", "sequence", ["doc_id"])


@query("GATE9_similarity_sensitivity")
def sensitivity(spark, sf):
    from .sensitivity import similarity_sensitivity

    df = assay(spark, sf).select("row_id", "sequence", "doc_id", "target", "prediction")
    return similarity_sensitivity(df, "row_id", "sequence", "target", "prediction", ["doc_id"])


def split_ctes(prefix: str, edges: str, needs: tuple[str, ...]) -> None:
    """Size and digest of the test side when the rows of a document and of ``edges`` (a, b) stay together."""
    p = prefix
    cte(f"{p}_links", f"SELECT DISTINCT a//100000 AS a, b//100000 AS b FROM ({edges}) WHERE a//100000 <> b//100000", needs)
    component_ctes(f"{p}_doc", f"{p}_links", "doc_vertices", "doc_id", (f"{p}_links", "doc_vertices"))
    digest_ctes(f"{p}_dc", f"constructs c JOIN {p}_doc_comp d ON c.doc_id=d.row_id", "d.component", "sha256(sequence)||'|doc_id='||doc_id",
                ("constructs", f"{p}_doc_comp"))
    cte(f"{p}_fill", f"""SELECT k AS component, left(digest,16) AS cluster, size, sum(size) OVER (ORDER BY size, sha256('13:'||digest) DESC, k ROWS UNBOUNDED PRECEDING)-size AS ex,
 row_number() OVER (ORDER BY size, sha256('13:'||digest) DESC, k) AS pos, count(*) OVER () AS c, sum(size) OVER () AS n FROM {p}_dc_digest""", (f"{p}_dc_digest",))
    cte(f"{p}_side", f"""SELECT c.sequence, f.cluster FROM constructs c JOIN {p}_doc_comp d ON c.doc_id=d.row_id JOIN {p}_fill f ON f.component=d.component
 WHERE ex < greatest(1, round_even(n*0.15,0)) AND pos < c""", (f"{p}_fill", "constructs"))
    digest_ctes(f"{p}_ts", f"(SELECT 'test' AS s, sha256(sequence) AS h FROM {p}_side)", "s", "h", (f"{p}_side",))


#: Settings of the sensitivity grid that SQL can state, by the prefix of their CTEs.
GRID = {"g80": ("canonical_kmer_jaccard", 0.8), "g90": ("canonical_kmer_jaccard", 0.9), "g95": ("canonical_kmer_jaccard", 0.95),
        "grc": ("exact_reverse_complement", 0.9), "gpm": ("position_aware_motif", 0.9), "gfl": ("customer_family_labels", 0.9)}
jaccard_ctes("k80", KMERS, 0.8)
jaccard_ctes("k95", KMERS, 0.95)
for _p, _edges in {"g80": "k80_edges", "g90": "kj_edges", "g95": "k95_edges", "gpm": "pm_edges"}.items():
    split_ctes(_p, f"SELECT a, b FROM {_edges}", (_edges,))
split_ctes("grc", f"SELECT min(row_id) OVER (PARTITION BY least(sequence, {RC.format('sequence')})) AS a, row_id AS b FROM constructs", ("constructs",))
split_ctes("gfl", "SELECT row_id AS a, row_id AS b FROM constructs", ("constructs",))


@query("GATE9_split_digests", with_ctes(" UNION ALL ".join(
    f"SELECT '{policy}' AS similarity_policy, {t}::double AS similarity_threshold, size AS test_rows, digest AS test_membership_sha256, (SELECT count(DISTINCT cluster) FROM {p}_side) AS test_clusters FROM {p}_ts_digest"
    for p, (policy, t) in GRID.items()), *[f"{p}_ts_digest" for p in GRID], recursive=True))
def split_digests(spark, sf):
    """The test sides of the grid's settings: three thresholds out of one nested search, and three other policies."""
    from .sensitivity import setting_splits

    df = cut(assay(spark, sf).select("row_id", "sequence", "doc_id"))
    settings = list(GRID.values())
    split, _ = setting_splits(df, "row_id", "sequence", ["doc_id"], settings, K, 13)
    hashed = df.select(F.col("row_id").alias("id"), seq.sequence_hash("sequence").alias("h"))
    test = cut(split.where("split = 'test'").join(hashed, "id"))
    names = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(settings)], "setting int, similarity_policy string, similarity_threshold double")
    digests = sp.list_digest(test, "h", ["setting"], "test_membership_sha256", "test_rows")
    clusters = test.groupBy("setting").agg(F.countDistinct("leakage_cluster").alias("test_clusters"))
    return names.join(digests, "setting").join(clusters, "setting").drop("setting")


@query("GATE1_prediction_audit", with_ctes(f"""SELECT count(*) AS test_rows, count(DISTINCT leakage_cluster) AS test_clusters, {r6('1-sum(power(prediction-target,2))/(var_pop(target)*count(*))')} AS model_metric,
 {r6('avg(abs(prediction-target))')} AS mean_abs_error, any_value(digest) AS test_membership_sha256, true AS judged
 FROM split_rows JOIN assay USING (row_id), ts_digest WHERE split='test'""", "split_rows", "assay", "ts_digest", recursive=True))
def whole_audit(spark, sf):
    """Validation, split, baselines, metrics, intervals and gates of the whole assay as one operator."""
    from .sensitivity import prediction_audit

    df = assay(spark, sf).select("row_id", "sequence", "doc_id", "target", "prediction", "uncertainty")
    run = prediction_audit(df, "row_id", "sequence", "target", "prediction", "uncertainty", ["doc_id"], "predicted_absolute_error").run
    six = lambda c: F.round(c, 6).alias(c)
    return run.select("test_rows", "test_clusters", six("model_metric"), six("mean_abs_error"), "test_membership_sha256",
                      (F.col("verdict").isNotNull() & F.col("baseline_metric").isNotNull() & F.col("lift_low").isNotNull()).alias("judged"))
