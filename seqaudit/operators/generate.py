"""Candidate generation: random, mutated, recombined and masked-filled sequences, and the evolutionary search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq
from ..functions.hashrand import draw_int, uniform
from ..functions.values import col
from ..session import cut, parallelism
from .candidates import synthesis_filter
from .corpus import inferred_limits


def _base(code: Column) -> Column:
    return F.substring(F.lit("ACGT"), (code + 1).cast("int"), F.lit(1))


def random_dna(length, gc_target, *key) -> Column:
    """Bases drawn at a GC target, one hashed draw per position."""
    positions = F.sequence(F.lit(1), col(length).cast("int"))

    def at(i: Column) -> Column:
        strong = uniform(*key, F.lit("gc"), i) < gc_target
        first = uniform(*key, F.lit("ab"), i) < 0.5
        return F.when(strong & first, "G").when(strong, "C").when(first, "A").otherwise("T")

    return F.array_join(F.transform(positions, at), "")


def mutate(sequence, rate, *key) -> Column:
    """Each base changes to another one with probability ``rate``; a non-base becomes a random base."""
    def at(b: Column, i: Column) -> Column:
        now = F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3)
        step = draw_int(*key, F.lit("to"), i)
        other = _base((now + 1 + step % 3) % 4)
        fresh = _base(step % 4)
        hit = uniform(*key, F.lit("hit"), i) < rate
        return F.when(now.isNull(), fresh).when(hit, other).otherwise(b)

    return F.array_join(F.transform(F.split(col(sequence), ""), at), "")


def recombine(left, right, *key) -> Column:
    """One cut: the head of one parent and the tail of the other, at the shorter length."""
    n = F.least(F.length(col(left)), F.length(col(right)))
    at = (draw_int(*key, F.lit("cut")) % F.greatest(n - 1, F.lit(1)) + 1).cast("int")
    joined = F.concat(F.substring(col(left), F.lit(1), at), F.substring(col(right), at + 1, n - at))
    return F.when(n <= 1, F.when(F.length(col(left)) > 0, col(left)).otherwise(col(right))).otherwise(joined)


# Mutation rates of the three sampling modes as functions of the configured rate.
def mode_rate(mode: str, rate: float) -> float:
    return {"Diversity sampling": min(0.5, rate * 2.5 + 0.04), "Random mutagenesis": rate}.get(mode, rate * 0.35)


ATTEMPTS_PER_DESIGN = 80


def masked_pool(parents: DataFrame, key: str, parent_col: str, count: int, mode: str, rate: float, seed: int) -> DataFrame:
    """Fill N sites and mutate the rest, ``count`` distinct sequences per parent.

    Draws come in rounds that double, and only parents that still lack designs draw again; a
    parent ends with fewer designs only after ``ATTEMPTS_PER_DESIGN`` draws for each wanted one.
    """
    target = count * 6 if mode == "Diversity sampling" else count
    raw = F.replace(F.upper(parent_col), F.lit("[MASK]"), F.lit("N"))
    effective = 0.0 if mode == "Mask-fill" else mode_rate(mode, rate)
    needy, made, drawn = parents, None, 0
    while drawn < target * ATTEMPTS_PER_DESIGN:
        upto = min(max(2 * target, 2 * drawn), target * ATTEMPTS_PER_DESIGN)
        draws = needy.withColumn("draw", F.explode(F.sequence(F.lit(drawn + 1), F.lit(upto))))
        new = draws.withColumn("sequence", mutate(raw, effective, F.lit(seed), F.col(key), F.col("draw"))).select(key, "sequence", "draw", parent_col)
        both = new if made is None else made.unionByName(new)
        made = cut(both.groupBy(key, "sequence").agg(F.min("draw").alias("draw"), F.first(parent_col).alias(parent_col)))
        full = made.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= target)
        needy, drawn = cut(parents.join(full, key, "left_anti")), upto
        if needy.isEmpty():
            break
    from .ordered import top_k

    return top_k(made, target, [F.col("draw")], [key], F.col("draw")).withColumnRenamed("rank", "position")


def evolve(train: DataFrame, sequence_col: str, proposals: int, score, seed: int = 13, batch: int = 512, parents: int = 256,
           rate: float = 0.08, max_homopolymer: int = 6, forbidden: tuple[str, ...] = (),
           min_distance: int = 8) -> tuple[DataFrame, DataFrame]:
    """(accepted designs, rejection counts) of an evolutionary search.

    Each round proposes a batch from the best designs so far (at most ``parents`` rows,
    the only part that is broadcast), drops what was proposed before, filters and scores.
    ``score`` takes the batch and returns it with a ``generation_score`` column. The search
    ends with enough designs or at the attempt limit; the rejection table counts every
    proposal that is no design, repeated ones as ``duplicate``.
    """
    limits = inferred_limits(train, sequence_col).first()
    length, low, high = int(limits["sequence_length"]), limits["gc_low"], limits["gc_high"]
    spark = train.sparkSession
    seen = cut(train.select(F.col(sequence_col).alias("sequence")).distinct())
    accepted, rejects, pool, count, turn = None, None, None, 0, 0
    limit = max(proposals * 50, 2000)
    tries = 0
    while count < proposals and tries < limit:
        size = min(max(batch, (proposals - count) * 2), limit - tries)
        made = _propose(spark, size, turn, seed, length, low, high, rate, pool, parents)
        tries += size
        once = made.groupBy("sequence").agg(F.min("attempt").alias("attempt"))
        fresh = cut(once.join(seen, "sequence", "left_anti"))
        seen = seen.unionByName(fresh.select("sequence"))  # rejected proposals too
        judged = cut(synthesis_filter(fresh, "attempt", "sequence", train, sequence_col, (low, high), max_homopolymer, forbidden, min_distance))
        why = judged.where("filter_reason IS NOT NULL").groupBy(F.col("filter_reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
        why = why.unionByName(fresh.agg((F.lit(size).cast("bigint") - F.count(F.lit(1))).alias("rows")).select(F.lit("duplicate").alias("reason"), "rows"))
        rejects = why if rejects is None else rejects.unionByName(why)
        good = cut(score(judged.where("filter_reason IS NULL").orderBy("attempt").limit(proposals - count)).withColumn("round", F.lit(turn)))
        accepted = good if accepted is None else cut(accepted.unionByName(good))
        count = accepted.count()
        best = accepted.orderBy(F.desc("generation_score"), "round", "attempt").limit(parents)
        from pyspark.sql import Window

        pool = cut(best.select((F.row_number().over(Window.orderBy(F.desc("generation_score"), "round", "attempt")) - 1).alias("p"), "sequence"))
        turn += 1
    designs = accepted.select("round", "attempt", "sequence", F.sha2("sequence", 256).alias("sequence_hash"), "gc", "novelty",
                              (F.col("novelty") / max(1, length)).alias("novelty_score"), "generation_score")
    return designs, rejects.groupBy("reason").agg(F.sum("rows").alias("rows"))


def _propose(spark, size, turn, seed, length, low, high, rate, pool, parents) -> DataFrame:
    rows = spark.range(0, size, 1, min(parallelism(spark), max(1, size // 64))).withColumnRenamed("id", "attempt")
    k = (F.lit(seed), F.lit(turn), F.col("attempt"))
    target = low + (high - low) * uniform(*k, F.lit("gc"))
    plain = random_dna(F.lit(length), target, *k)
    held = pool.count() if pool is not None else 0
    if held < 1:
        return rows.select("attempt", plain.alias("sequence"))
    a = F.broadcast(pool.select(F.col("p").alias("pa"), F.col("sequence").alias("left")))
    b = F.broadcast(pool.select(F.col("p").alias("pb"), F.col("sequence").alias("right")))
    rows = rows.withColumns({"pa": (draw_int(*k, F.lit("a")) % held).cast("int"), "pb": (draw_int(*k, F.lit("b")) % held).cast("int")})
    rows = rows.join(a, "pa").join(b, "pb")
    how = uniform(*k, F.lit("how"))
    child = F.when((F.lit(held) >= 2) & (how < 0.70), recombine("left", "right", *k))
    child = child.when(uniform(*k, F.lit("mut")) < 0.75, F.col("left"))
    made = F.coalesce(mutate(child, rate, *k), plain)
    padded = F.substring(F.concat(made, random_dna(F.lit(length), F.lit((low + high) / 2), *k, F.lit("pad"))), 1, length)
    return rows.select("attempt", F.when(F.length(made) == length, made).otherwise(padded).alias("sequence"))


def position_composition(df: DataFrame, parent_col: str, sequence_col: str) -> DataFrame:
    """Base fractions at the masked sites over same-length designs."""
    rows = df.where(F.length(parent_col) == F.length(sequence_col)).select(
        F.split(parent_col, "").alias("p"), F.posexplode(F.split(sequence_col, "")).alias("pos", "base"))
    held = rows.where(F.col("p")[F.col("pos")] == "N").groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    total = held.groupBy("pos").agg(F.sum("n").alias("t"))
    return held.join(total, "pos").select((F.col("pos") + 1).alias("position"), "base", (F.col("n") / F.col("t")).alias("fraction"))


def mutation_profile(df: DataFrame, id_col: str, parent_col: str, sequence_col: str) -> tuple[DataFrame, DataFrame]:
    """(mutations per design, mutation rate per fixed parent position).

    Positions carry their two bases only; the whole parent beside each of them would be its length squared.
    """
    same = df.where(F.length(parent_col) == F.length(sequence_col))
    pairs = F.zip_with(F.split(parent_col, ""), F.split(sequence_col, ""), lambda x, y: F.when(x != "N", x != y))
    rows = same.select(id_col, F.posexplode(pairs).alias("pos", "changed")).where("changed is not null")
    changed = F.col("changed")
    per = rows.groupBy(id_col).agg(F.count_if(changed).alias("mutations"))
    at = rows.groupBy((F.col("pos") + 1).alias("position")).agg(F.avg(changed.cast("double")).alias("rate"), F.count(F.lit(1)).alias("rows"))
    return per, at
