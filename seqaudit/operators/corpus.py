"""Corpus preparation: chunks, splits by window count, caps, sampling, augmentation, masking, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq
from ..functions.hashrand import digest, draw_int, uniform
from ..functions.values import col
from ..session import cut
from . import ordered


# --- chunks -----------------------------------------------------------------------

def default_min_length(max_length: int) -> int:
    return max(64, max_length // 4)


def chunk_spans(length, max_length: int, stride: int, min_length: int) -> Column:
    """Array of (start, end): one chunk up to max_length, else strided windows until the end is covered."""
    n = col(length)
    step = max(1, stride)
    starts = F.sequence(F.lit(0), n - F.lit(min_length), F.lit(step))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + max_length, n).alias("end")))
    # a window is made unless an earlier one already reached the end
    useful = F.filter(spans, lambda w: (w["start"] == 0) | (w["start"] - step + max_length < n))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return F.when(n < min_length, F.array().cast("array<struct<start:int,end:int>>")).when(n <= max_length, whole).otherwise(useful)


def window_count(length, max_length: int, stride: int, min_length: int) -> Column:
    n, step = col(length), max(1, stride)
    by_start = F.floor((n - min_length) / step) + 1
    to_end = F.ceil((n - max_length) / step) + 1
    return F.when(n < min_length, 0).when(n <= max_length, 1).otherwise(F.least(by_start, to_end)).cast("bigint")


def chunks(df: DataFrame, sequence_col: str, max_length: int, stride: int, min_length: int) -> DataFrame:
    spans = chunk_spans(F.length(sequence_col), max_length, stride, min_length)
    out = df.withColumn("w", F.explode(spans)).withColumn("start", F.col("w.start")).withColumn("end", F.col("w.end"))
    return out.withColumn("chunk", F.substring(sequence_col, F.col("start") + 1, F.col("end") - F.col("start"))).drop("w")


# --- splits -----------------------------------------------------------------------

def hash_order(seed: int, *keys: str) -> tuple[Column, Column]:
    """(exact order, double that follows it) of a seeded shuffle."""
    d = digest(F.lit(seed), *keys)
    return d, F.conv(F.substring(d, 1, 12), 16, 10).cast("double")


def window_split(df: DataFrame, file_col: str, id_col: str, windows: str, ratio: float, seed: int) -> DataFrame:
    """Per file: fill training to int(total * ratio) windows in shuffled order.

    A sequence that would overshoot goes to training only if more than half of it is
    still wanted. Everything before the first overshoot is settled by a running sum; a
    refused sequence also refuses every later one at least twice what is left, so few
    rounds remain. Every round is a distributed running sum over all files at once.
    """
    base = df.select(F.col(file_col).alias("file"), F.col(id_col).alias("id"), F.col(windows).cast("bigint").alias("w")).where("w > 0")
    d, lead = hash_order(seed, "file", "id")
    base = cut(base.withColumns({"draw": d, "lead": lead}))
    goal = base.groupBy("file").agg(F.floor(F.sum("w") * F.lit(ratio)).cast("bigint").alias("left"))
    rest, settled = base, None
    room = goal
    order = [F.col("draw"), F.col("id")]
    while not rest.isEmpty():
        open_rows = rest.join(room, "file")
        out_now = open_rows.where((F.col("left") <= 0) | (F.col("w") >= 2 * F.col("left"))).select("file", "id", F.lit("eval").alias("split"))
        live = open_rows.where((F.col("left") > 0) & (F.col("w") < 2 * F.col("left")))
        placed = cut(ordered.running_sum(live, "through", F.col("w"), order, F.col("lead"), ["file"]))
        # the first row past the limit: still more than half wanted here, so it joins and closes the file
        over = placed.where(F.col("through") > F.col("left")).groupBy("file").agg(
            F.min(F.struct("through", "draw", "id", "w", "left")).alias("f"))
        flagged = placed.join(over, "file", "left")
        fits = F.col("f").isNull() | (F.col("through") < F.col("f.through"))
        first = F.col("id") == F.col("f.id")
        wanted = 2 * (F.col("f.left") - (F.col("f.through") - F.col("f.w"))) > F.col("f.w")
        decided = flagged.withColumn("split", F.when(fits, "train").when(first & wanted, "train").when(first, "eval"))
        got = cut(decided.where("split IS NOT NULL").select("file", "id", "w", "split").unionByName(
            out_now.withColumn("w", F.lit(0).cast("bigint"))))
        settled = got.select("file", "id", "split") if settled is None else settled.unionByName(got.select("file", "id", "split"))
        used = got.where("split = 'train'").groupBy("file").agg(F.sum("w").alias("u"))
        room = cut(room.join(used, "file", "left").select("file", (F.col("left") - F.coalesce("u", F.lit(0))).alias("left")))
        rest = cut(rest.join(got.select("file", "id"), ["file", "id"], "left_anti"))
    if settled is None:
        return base.select("file", "id", F.lit("train").alias("split"))
    # a file without any training sequence gives its first one
    none = settled.groupBy("file").agg(F.count_if(F.col("split") == "train").alias("t"), F.min("id").alias("first"))
    fixed = settled.join(none, "file")
    return fixed.select("file", "id", F.when((F.col("t") == 0) & (F.col("id") == F.col("first")), "train").otherwise(F.col("split")).alias("split"))


def cap_windows(df: DataFrame, file_col: str, id_col: str, windows: str, caps: dict[str, int], default: int | None = None) -> DataFrame:
    """Longest sequences first until the file's cap is reached; at least one is kept; no cap keeps all."""
    pairs = [F.lit(x) for kv in caps.items() if kv[0] != "*" for x in kv]
    named = F.element_at(F.create_map(*pairs), F.col(file_col)) if pairs else F.lit(None).cast("int")
    cap = F.coalesce(named, F.lit(caps.get("*", default)).cast("int"))
    rows = df.where(F.col(windows) > 0).withColumn("cap", cap)
    placed = ordered.running_sum(rows, "through", F.col(windows), [F.desc(windows), F.col(id_col)], -F.col(windows).cast("double"), [file_col])
    return placed.where(F.col("cap").isNull() | (F.col("cap") <= 0) | (F.col("through") - F.col(windows) < F.col("cap"))).drop("through", "cap")


def trim_eval(df: DataFrame, id_col: str, windows: str, kept: int, ratio: float, seed: int) -> DataFrame:
    """Shuffled evaluation sequences until ``round(kept * (1 - ratio) / ratio)`` windows are reached."""
    want = max(1, int(round(kept * (1 - ratio) / ratio)))
    d, lead = hash_order(seed, id_col)
    rows = df.where(F.col(windows) > 0).withColumns({"draw": d, "lead": lead})
    placed = ordered.running_sum(rows, "through", F.col(windows), [F.col("draw"), F.col(id_col)], F.col("lead"))
    return placed.where(F.col("through") - F.col(windows) < want).drop("through", "draw", "lead")


def bottom_sample(df: DataFrame, split_col: str, id_col: str, limits: dict[str, int], seed: int) -> DataFrame:
    """Uniform sample per split: the rows with the smallest seeded digests, whatever the row order."""
    pairs = [F.lit(x) for kv in limits.items() for x in kv]
    limit = F.coalesce(F.element_at(F.create_map(*pairs), F.col(split_col)), F.lit(0))
    d, lead = hash_order(seed, id_col)
    rows = df.withColumns({"draw": d, "lead": lead})
    placed = ordered.row_number(rows, "pos", [F.col("draw"), F.col(id_col)], F.col("lead"), [split_col])
    return placed.where(F.col("pos") <= limit).drop("draw", "lead", "pos")


def manifest_conflicts(manifest: DataFrame, sequences: DataFrame) -> DataFrame:
    """Entries with a negative index, an unknown split, both sides of the split, or no such sequence."""
    side = F.lower(F.trim("split"))
    name = F.when(side == "train", "train").when(side.isin("val", "valid", "validation", "test", "eval"), "eval")
    rows = manifest.withColumn("side", name)
    both = rows.groupBy("path", "seq_index").agg(F.count_distinct("side").alias("sides"), F.count_if(F.col("side").isNull()).alias("unknown"))
    have = sequences.select("path", "seq_index").withColumn("found", F.lit(True))
    out = both.join(have, ["path", "seq_index"], "left")
    why = (F.when(F.col("seq_index") < 0, "negative index").when(F.col("unknown") > 0, "unknown split")
           .when(F.col("sides") > 1, "train and eval overlap").when(F.col("found").isNull(), "index out of range"))
    return out.select("path", "seq_index", why.alias("problem")).where("problem IS NOT NULL")


def manifest_split(manifest: DataFrame, sequences: DataFrame) -> DataFrame:
    side = F.lower(F.trim("split"))
    rows = manifest.select("path", "seq_index", F.when(side == "train", "train").otherwise("eval").alias("split")).distinct()
    return sequences.join(rows, ["path", "seq_index"])


# --- order and weights ------------------------------------------------------------

def length_batches(df: DataFrame, id_col: str, length: str, size: int, seed: int, epoch: int) -> DataFrame:
    """Rows of similar length share a batch; batches come in seeded order."""
    placed = ordered.row_number(df, "pos", [F.col(length), F.col(id_col)], F.col(length).cast("double"))
    return placed.withColumn("batch", F.floor((F.col("pos") - 1) / size)).withColumn(
        "batch_order", digest(F.lit(seed + epoch), "batch")).drop("pos")


def alias_table(weights: DataFrame, name: str, weight: str, rows_per_task: int | None = None) -> DataFrame:
    """(cell, name, stays, alias): cells of equal size, each shared by one name and its alias.

    A name of weight w has n*w / t of a cell, t the total. Light names leave room in their cells, heavy
    ones overflow. In one fixed order a light cell is filled by the first heavy name whose
    overflow is not yet used up; a heavy name that gave too much has its own cell filled by
    the next. Who that is follows from running sums of room and overflow and from counts of
    one among the other, so the table is built by sorts and equi-joins, whatever its size.
    """
    total = weights.agg(F.sum(weight).alias("t"), F.count(F.lit(1)).alias("n"), F.min(weight).alias("lo")).first()
    if not total["n"] or total["lo"] is None or total["lo"] < 0 or not total["t"]:
        raise ValueError("weights must be non-negative and not all zero")
    share = F.col(weight).cast("double") * F.lit(float(total["n"]))
    size = F.lit(float(total["t"]))
    rows = cut(weights.select(F.col(name).alias("name"), (share - size).alias("over")))
    sums = lambda df, value: cut(ordered.row_number(
        ordered.running_sum(df, "upto", value, [F.col("name")], rows_per_task=rows_per_task), "place", [F.col("name")], rows_per_task=rows_per_task))
    light, heavy = sums(rows.where("over <= 0"), -F.col("over")), sums(rows.where("over > 0"), F.col("over"))
    # among the other kind: heavy names used up before a light one begins, light cells that begin before a heavy name ends
    before = F.col("upto") + F.col("over")
    marks = heavy.select(F.col("upto").alias("at"), "place", F.lit(True).alias("is_heavy")).union(light.select(before, "place", F.lit(False)))
    count = ordered.running_sums(
        marks, {"heavies": F.col("is_heavy").cast("bigint"), "lights": (~F.col("is_heavy")).cast("bigint")},
        [F.col("at"), F.when(F.col("is_heavy"), 0).otherwise(1), F.col("place")], rows_per_task=rows_per_task)
    count = cut(count)
    heavy_at = heavy.select(F.col("place").alias("to"), F.col("name").alias("alias"))
    light_at = light.select(F.col("place").alias("last"), F.col("upto").alias("given"))
    cells = light.join(count.where("not is_heavy").select("place", (F.col("heavies") + 1).alias("to")), "place").join(heavy_at, "to", "left").select(
        "name", (size + F.col("over")).alias("stays"), "alias")
    kept = heavy.join(count.where("is_heavy").select("place", F.col("lights").alias("last")), "place").join(light_at, "last", "left")
    kept = kept.withColumn("to", F.col("place") + 1).join(heavy_at, "to", "left").select(
        "name", (size + F.col("upto") - F.greatest("upto", F.coalesce("given", "upto"))).alias("stays"), "alias")
    numbered = ordered.row_number(cells.union(kept), "cell", [F.col("name")], rows_per_task=rows_per_task)
    return numbered.select((F.col("cell") - 1).alias("cell"), "name", (F.col("stays") / size).alias("stays"), "alias")


def source_draws(weights: DataFrame, source: str, weight: str, steps: int, seed: int, rows_per_task: int | None = None) -> DataFrame:
    """(step, source): independent draws by weight, one uniform number and one look-up a draw, for any number of sources.

    The whole part of the number, scaled to the cells, finds the cell; the rest decides between its name and its alias.
    """
    cells = cut(alias_table(weights, source, weight, rows_per_task))
    n = cells.count()
    u = F.conv(F.substring(digest(F.lit(seed), "id"), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52)) * F.lit(float(n))
    draws = weights.sparkSession.range(1, steps + 1).select(F.col("id").alias("step"), u.alias("u")).withColumn("cell", F.floor("u"))
    at = F.col("u") - F.col("cell")
    picked = F.when(at < F.col("stays"), F.col("name")).otherwise(F.coalesce("alias", "name"))
    return draws.join(cells, "cell").select("step", picked.alias(source))


def interleave(df: DataFrame, source: str, order: str, limits: dict[str, int] = {}) -> DataFrame:
    """Round-robin position over the sources, with an optional limit per source."""
    placed = ordered.row_number(df, "turn", [F.col(order)], F.col(order).cast("double"), [source])
    pairs = [F.lit(x) for kv in limits.items() for x in kv]
    if pairs:
        cap = F.element_at(F.create_map(*pairs), F.col(source))
        placed = placed.where(cap.isNull() | (F.col("turn") <= cap))
    return placed


def gc_bin_weights(df: DataFrame, name: str, gc_percent: str) -> DataFrame:
    """Ten-point GC bins per source and 1 / (sources in the bin); unknown GC counts as 50."""
    bin_ = (F.floor(F.coalesce(gc_percent, F.lit(50.0)) / 10) * 10).cast("int")
    rows = df.select(name, bin_.alias("gc_bin"))
    return rows.join(rows.groupBy("gc_bin").agg(F.count(F.lit(1)).alias("n")), "gc_bin").select(name, "gc_bin", (1 / F.col("n")).alias("weight"))


# --- perturbation -----------------------------------------------------------------

def augment(df: DataFrame, id_col: str, sequence_col: str, reverse_prob: float, indel_prob: float, seed: int, epoch: int = 0) -> DataFrame:
    """Reverse complement with one probability, a single-base insertion or deletion with another."""
    key = [F.lit(seed + epoch * 1_000_000), F.col(id_col)]
    u = lambda tag: uniform(*key, F.lit(tag))
    s = F.when(u("strand") < reverse_prob, seq.reverse_complement(sequence_col)).otherwise(F.col(sequence_col))
    out = df.withColumn("__s", s)
    n = F.length("__s")
    insert_at = (draw_int(*key, F.lit("at")) % (n + 1)).cast("int")
    delete_at = (draw_int(*key, F.lit("at")) % F.greatest(n, F.lit(1))).cast("int")
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (draw_int(*key, F.lit("base")) % 4 + 1).cast("int"))
    longer = F.concat(F.substring("__s", F.lit(1), insert_at), base, F.substring("__s", insert_at + 1, n))
    shorter = F.concat(F.substring("__s", F.lit(1), delete_at), F.substring("__s", delete_at + 2, n))
    hit = (u("indel") < indel_prob) & (n >= 2)
    return out.withColumn("augmented", F.when(~hit, F.col("__s")).when(u("kind") < 0.5, longer).otherwise(shorter)).drop("__s")


def mask_tokens(df: DataFrame, id_col: str, ids: str, share: float, seed: int, mask_id: int = 4, vocab: int = 4) -> DataFrame:
    """Positions chosen by a hashed uniform: 80 % masked, 10 % replaced, 10 % kept; labels -100 elsewhere."""
    draw = lambda i, tag: uniform(F.lit(seed), F.col(id_col), i, F.lit(tag))
    chosen = lambda i: draw(i, "pick") < share
    swap = lambda i: (draw_int(F.lit(seed), F.col(id_col), i, F.lit("swap")) % vocab).cast("int")
    masked = F.transform(ids, lambda x, i: F.when(~chosen(i), x).when(draw(i, "kind") < 0.8, mask_id).when(draw(i, "kind") < 0.9, swap(i)).otherwise(x))
    labels = F.transform(ids, lambda x, i: F.when(chosen(i), x).otherwise(-100))
    return df.withColumns({"masked_ids": masked, "labels": labels})


def mask_spans(df: DataFrame, id_col: str, ids: str, share: float, span: int, seed: int, mask_id: int = 4) -> DataFrame:
    """Contiguous spans in seeded order until the wanted share of positions is covered.

    Positions are cut into span-long cells; the cells with the smallest digests are
    masked, the last one only as far as the target needs. The order is laid out once as an
    array over the positions and zipped with the ids; no lambda looks anything up.
    """
    n = F.size(ids)
    want = F.greatest(F.lit(1), F.round(n * share).cast("int"))
    cells = F.ceil(n / span).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(cells - 1, F.lit(0))),
                                     lambda c: F.struct(digest(F.lit(seed), F.col(id_col), c).alias("d"), c.alias("c"))))
    before = F.array_sort(F.transform(order, lambda o, place: F.struct(o["c"].alias("c"), (place * span).alias("before"))))
    turn = F.flatten(F.transform(before, lambda o: F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda r: o["before"] + r)))
    covered = F.zip_with(F.slice(turn, F.lit(1), n), F.array_repeat(want, n), lambda t, w: t < w)
    return df.withColumn("masked_ids", F.zip_with(ids, covered, lambda x, c: F.when(c, mask_id).otherwise(x)))


# --- n-grams ----------------------------------------------------------------------

def ngram_counts(df: DataFrame, sequence_col: str, order: int) -> DataFrame:
    """(context, next, rows) over all positions; overlapping windows, whole sequences."""
    grams = df.select(F.explode(seq.windows(sequence_col, order + 1)).alias("g"))
    return grams.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).select(
        F.substring("g", 1, order).alias("context") if order else F.lit("").alias("context"),
        F.substring("g", order + 1, 1).alias("next"), "rows")


def markov_scores(train: DataFrame, score: DataFrame, sequence_col: str, order: int) -> DataFrame:
    """Loss, bits per base and top-1 accuracy of add-one smoothed n-grams on a scoring set.

    Only the counts are joined: 4^(order+1) rows whatever the corpus size.
    """
    spark = train.sparkSession
    words = [w for w in seq.vocabulary(order + 1)]
    grid = spark.createDataFrame([(w[:order], w[order:]) for w in words], "context string, next string")
    counted = lambda d, n: ngram_counts(d, sequence_col, order).withColumnRenamed("rows", n)
    full = grid.join(counted(train, "seen"), ["context", "next"], "left").join(counted(score, "scored"), ["context", "next"], "left").select(
        "context", "next", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("scored", F.lit(0)).alias("scored"))
    totals = full.groupBy("context").agg(F.sum(F.col("seen") + 1).alias("total"),
                                         F.max_by("scored", F.struct("seen", (-F.ascii("next")).alias("o"))).alias("top"))
    p = (F.col("seen") + 1) / F.col("total")
    loss = full.join(totals, "context").agg(
        F.sum("scored").alias("count"), (-F.sum(F.col("scored") * F.log(p)) / F.sum("scored")).alias("loss"))
    top = totals.agg(F.sum("top").alias("t"))
    return loss.join(top).select("count", "loss", (F.col("loss") / F.log(F.lit(2.0))).alias("bits_per_base"), (F.col("t") / F.col("count")).alias("top1_accuracy"))


def unigram_scores(df: DataFrame, sequence_col: str) -> DataFrame:
    c = ngram_counts(df, sequence_col, 0)
    total = c.agg(F.sum("rows").alias("n"), F.max("rows").alias("top"))
    p = F.col("rows") / F.col("n")
    return c.join(F.broadcast(total)).agg(
        F.max("n").alias("count"), (-F.sum(p * F.log(p))).alias("loss"), (-F.sum(p * F.log(p)) / F.log(F.lit(2.0))).alias("bits_per_base"),
        (F.max("top") / F.max("n")).alias("top1_accuracy"))


def calibration_error(df: DataFrame, confidence: str, correct: str, keys: list[str] = []) -> DataFrame:
    """Expected calibration error over ten confidence bins."""
    b = F.least(F.floor(F.col(confidence) * 10), F.lit(9))
    bins = df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def class_accuracy(df: DataFrame, label: str, correct: str, loss: str) -> DataFrame:
    out = df.groupBy(label).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("loss"))
    return out.withColumns({"perplexity": F.exp("loss"), "bits": F.col("loss") / F.log(F.lit(2.0))})


# --- measured cohorts -------------------------------------------------------------

def prefix_lookup(sequences: DataFrame, sequence_col: str, activity: DataFrame, prefix_col: str, width: int = 35) -> DataFrame:
    """Join each sequence with its prefix's activity and flag prefixes held by several sequences."""
    rows = sequences.withColumn("prefix", F.substring(F.upper(sequence_col), 1, width))
    counts = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("held"))
    joined = rows.join(activity.withColumnRenamed(prefix_col, "prefix"), "prefix", "left").join(counts, "prefix")
    return joined.withColumn("ambiguous", F.col("held") > 1).drop("held")


def cohort_counters(joined: DataFrame, a: str, b: str, max_difference: float, low: float, high: float) -> DataFrame:
    """Nested counters of a cohort: joined, ambiguous, replicate failures, range failures, accepted."""
    present = F.col(a).isNotNull() & F.col(b).isNotNull()
    clear = present & ~F.col("ambiguous")
    close = F.abs(F.col(a) - F.col(b)) <= max_difference + 1e-12
    mean = (F.col(a) + F.col(b)) / 2
    inside = mean.between(low - 1e-12, high + 1e-12)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(present).alias("joined_rows"), F.count_if(present & F.col("ambiguous")).alias("ambiguous_prefix_rows"),
        F.count_if(clear & ~close).alias("replicate_filter_failures"), F.count_if(clear & close & ~inside).alias("range_filter_failures"),
        F.count_if(clear & close & inside).alias("accepted_rows"))


def inferred_limits(df: DataFrame, sequence_col: str, keys: list[str] = []) -> DataFrame:
    """Median length (half to even) and GC range: mean plus or minus max(2 deviations, 0.08), within [0, 1]."""
    rows = df.where(F.length(sequence_col) > 0).select(*keys, F.length(sequence_col).alias("n"), seq.gc_fraction(sequence_col).alias("g"))
    spread = F.greatest(2 * F.stddev_pop("g"), F.lit(0.08))
    out = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.bround(F.percentile("n", 0.5)).cast("int")).alias("sequence_length"),
                                  F.avg("g").alias("m"), spread.alias("s"))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return out.select(*keys, "sequence_length", F.coalesce(clamp(F.col("m") - F.col("s")), F.lit(0.30)).alias("gc_low"),
                      F.coalesce(clamp(F.col("m") + F.col("s")), F.lit(0.70)).alias("gc_high"))
