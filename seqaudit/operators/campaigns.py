"""Campaign tables: locked selections, outcomes, round summaries and the audit chain."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import non_blank, parse_float
from ..session import cut
from . import metrics, ordered


def register_round(df: DataFrame, round_id: str, id_col: str, order_col: str) -> tuple[DataFrame, DataFrame]:
    """(round_candidates, problems): default rank is the position, default hash that of the sequence."""
    rows = ordered.row_number(df, "__pos", [F.col(order_col)], F.col(order_col).cast("double"), [round_id])
    have = set(df.columns)
    rank = parse_float("rank") if "rank" in have else F.lit(None).cast("double")
    made = F.when(F.length("sequence") > 0, F.sha2("sequence", 256)).otherwise("") if "sequence" in have else F.lit("")
    hashed = F.coalesce(F.when(non_blank("sequence_hash"), F.col("sequence_hash")), made) if "sequence_hash" in have else made
    out = rows.withColumns({"candidate_id": F.trim(F.col(id_col).cast("string")), "rank": F.coalesce(rank.cast("bigint"), F.col("__pos")),
                            "sequence_hash": hashed}).drop("__pos")
    counts = out.groupBy(round_id, "candidate_id").agg(F.count(F.lit(1)).alias("copies"))
    bad = counts.select(round_id, "candidate_id", F.when(~non_blank("candidate_id"), "blank identifier").when(
        F.col("copies") > 1, "duplicate identifier").alias("problem")).where("problem IS NOT NULL")
    return out, bad


def outcome_problems(outcomes: DataFrame, selections: DataFrame, rounds: DataFrame, key: list[str]) -> DataFrame:
    """Rows that must not be imported: outside the selection, not numeric, or not after the selection time."""
    known = selections.select(*key).distinct().withColumn("__in", F.lit(True))
    rows = outcomes.join(known, key, "left").join(rounds.select(key[0], "selected_at"), key[0], "left")
    why = (F.when(F.col("__in").isNull(), "outside the locked selection")
           .when(parse_float("measured_value").isNull(), "invalid numeric outcome")
           .when(~F.coalesce(F.col("measured_at") > F.col("selected_at"), F.lit(False)), "not later than the selection"))
    return rows.withColumn("problem", why).drop("__in", "selected_at")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """Keep one row per key: the last new one, else the old one.

    The last row is a maximum per key, combined on the map side.
    """
    cols = [c for c in old.columns if c not in key]
    tagged = old.select(*key, F.struct(F.lit(0).alias("g"), F.lit(None).cast(new.schema[order_col].dataType).alias("o"), *cols).alias("r"))
    fresh = new.select(*key, F.struct(F.lit(1).alias("g"), F.col(order_col).alias("o"), *cols).alias("r"))
    last = tagged.unionByName(fresh).groupBy(*key).agg(F.max_by("r", F.struct("r.g", "r.o")).alias("r"))
    return last.select(*key, *[f"r.{c}" for c in cols])


def candidate_outcomes(selections: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per selected candidate: mean of its replicates, their number and cost (missing cost counts 0)."""
    held = outcomes.groupBy(*keys, "candidate_id").agg(
        F.avg("measured_value").alias("measured_value"), F.count("measured_value").alias("replicates"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return selections.join(held, [*keys, "candidate_id"], "left")


def summarize_rounds(selections: DataFrame, outcomes: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """Coverage, correlation, best, mean, top-quartile hit rate and cost per round.

    ``direction`` is a column of ``selections`` holding maximize or minimize.
    """
    each = cut(candidate_outcomes(selections, outcomes, keys))
    measured = each.where("measured_value IS NOT NULL")
    v, up = F.col("measured_value"), F.max(F.col(direction) == "maximize")
    base = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_candidates"), F.count(v).alias("measured_candidates"), up.alias("up"),
        F.coalesce(F.sum("replicates"), F.lit(0)).alias("measurement_rows"),
        (F.count(v) / F.count(F.lit(1))).alias("coverage"), F.avg(v).alias("observed_mean"),
        F.max(v).alias("hi"), F.min(v).alias("lo"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_reported_cost"))
    base = base.withColumn("observed_best", F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo"))).drop("hi", "lo", "up")
    rho = metrics.spearman(measured.where("prediction IS NOT NULL"), "prediction", "measured_value", keys,
                           name="prediction_outcome_spearman")
    hits = top_quartile(measured, keys, direction)
    return base.join(rho, keys, "left").join(hits, keys, "left")


def top_quartile(measured: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """Threshold = element n // 4 of the best-first list; hit rate counts values at least as good."""
    sign = F.when(F.col(direction) == "maximize", -1.0).otherwise(1.0)
    rows = measured.withColumn("o", sign * F.col("measured_value"))
    placed = ordered.row_number(rows, "pos", [F.col("o"), F.col("candidate_id")], F.col("o"), keys)
    sizes = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cutoff = placed.join(sizes, keys).where(F.col("pos") == F.floor(F.col("n") / 4) + 1).select(
        *keys, "n", F.col("measured_value").alias("descriptive_top_quartile_threshold"), F.col("o").alias("limit"))
    return rows.join(cutoff, keys).groupBy(*keys).agg(
        F.max("descriptive_top_quartile_threshold").alias("descriptive_top_quartile_threshold"),
        (F.count_if(F.col("o") <= F.col("limit")) / F.max("n")).alias("descriptive_hit_rate"))


def compare_rounds(summary: DataFrame, campaign: str, number: str) -> DataFrame:
    """Change of the mean from the previous measured round; the window holds one row per round."""
    before = Window.partitionBy(campaign).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("mean_change_from_previous",
                              F.col("observed_mean") - F.last("observed_mean", ignorenulls=True).over(before))


def prospective_protocol(rounds: DataFrame) -> DataFrame:
    ready = rounds.where(F.col("outcome_path").isNotNull() & F.col("outcome_sha256").isNotNull() & F.col("measured_at").isNotNull())
    return ready.select(
        F.col("round_id").alias("protocol_identifier"), F.col("selected_at").alias("candidate_selection_timestamp"),
        F.col("measured_at").alias("measurement_timestamp"), F.col("selection_path").alias("selection_manifest_path"),
        F.col("selection_sha256").alias("selection_manifest_sha256"), F.col("outcome_sha256").alias("outcome_data_sha256"))


def export_events(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Events of each campaign or of one of its rounds (``{campaign}-r…``).

    An id may itself hold ``-r``, so every text before a ``-r`` of a resource is a possible
    owner; the campaign table decides.
    """
    pieces = F.split("resource_id", "-r")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "-r"))
    owned = events.select(F.explode(heads).alias("campaign_id"), "*")
    return owned.join(campaigns.select("campaign_id"), "campaign_id", "left_semi").dropDuplicates(["campaign_id", "event_id"])


def archive(campaigns: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = campaigns.join(ids.select("campaign_id", F.lit(True).alias("__hit")), "campaign_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return marked.withColumns({"status": F.when(hit, "archived").otherwise(F.col("status")),
                               "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("__hit")


def purge(tables: dict[str, DataFrame], ids: DataFrame, key: str = "campaign_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the purged campaigns, and how many rows each table lost."""
    gone = ids.select(key).distinct()
    kept = {n: t.join(gone, key, "left_anti") for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("rows")).select(key, F.lit(n).alias("table"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    return kept, counts


# --- audit chain ------------------------------------------------------------------

def canonical_event() -> Column:
    """JSON text of an event with sorted keys and no blanks; ``details_json`` is already canonical."""
    field = lambda n: F.concat(F.lit(f'"{n}":'), F.to_json(F.array(n)).substr(F.lit(2), F.length(F.to_json(F.array(n))) - 2))
    parts = [field("action"), field("actor"), F.concat(F.lit('"details":'), F.col("details_json")), field("event_id"),
             field("occurred_at"), field("previous_hash"), field("resource_id"), field("resource_type")]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


GENESIS = "0" * 64


def verify_chain(events: DataFrame, order_col: str, chain: list[str] = []) -> DataFrame:
    """Events whose hash does not match their content or whose predecessor is not the one they name.

    Events are numbered once per chain; an equi-join on the number gives each its predecessor.
    """
    numbered = cut(ordered.row_number(events, "n", [F.col(order_col)], F.col(order_col).cast("double"), chain))
    before = numbered.select(*chain, (F.col("n") + 1).alias("n"), F.col("event_hash").alias("actual_previous"))
    chained = numbered.join(before, [*chain, "n"], "left")
    expected = F.sha2(canonical_event(), 256)
    broken = (F.col("previous_hash") != F.coalesce("actual_previous", F.lit(GENESIS))) | (F.col("event_hash") != expected)
    return chained.withColumn("invalid", broken)


def build_chain(events: DataFrame, chain: str, order_col: str, chunk: int = 50_000) -> DataFrame:
    """Hash every chain in its order.

    A link needs the link before it, so a chain is sequential by definition. Chains run
    in parallel, and each is walked in chunks of bounded size whose last hash is carried on.
    """
    chain_type, order_type = (events.schema[c].dataType.simpleString() for c in (chain, order_col))
    rows = events.withColumn("previous_hash", F.lit("@@@")).withColumn("body", canonical_event())
    numbered = ordered.row_number(rows.select(chain, order_col, "body"), "n", [F.col(order_col)], F.col(order_col).cast("double"), [chain])
    numbered = cut(numbered.withColumn("part", F.floor((F.col("n") - 1) / chunk)))
    parts = (numbered.agg(F.max("part")).first()[0] or 0) + 1

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        previous, out = pdf["last"].iloc[0] or GENESIS, []
        for key, at, body in zip(pdf[chain], pdf[order_col], pdf["body"]):
            text = body.replace('"previous_hash":"@@@"', f'"previous_hash":"{previous}"')
            made = hashlib.sha256(text.encode()).hexdigest()
            out.append((key, at, previous, made))
            previous = made
        return pd.DataFrame(out, columns=[chain, order_col, "previous_hash", "event_hash"])

    schema = f"{chain} {chain_type}, {order_col} {order_type}, previous_hash string, event_hash string"
    done, last = None, None
    for i in range(parts):
        part = numbered.where(F.col("part") == i)
        fed = part.withColumn("last", F.lit(None).cast("string")) if last is None else part.join(last, chain, "left")
        made = cut(fed.groupBy(chain).applyInPandas(link, schema))
        done = made if done is None else done.unionByName(made)
        last = made.groupBy(chain).agg(F.max_by("event_hash", order_col).alias("last"))
    return events.join(done, [chain, order_col])
