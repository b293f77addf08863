"""Row validation, reject reasons and the counters of an ingest audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq
from ..functions.values import MISSING, class_label, first_non_blank, fixed, is_missing, non_blank, parse_float
from ..functions.wording import SAYS
from ..session import settle
from . import ordered


def validate_rows(df: DataFrame, sequence_col: str = "sequence", target_col: str = "target", task: str = "regression",
                  require_target: bool = True) -> DataFrame:
    """Add the normalised sequence, typed target and the first failing reason (NULL = accepted)."""
    out = df.withColumn(sequence_col, seq.normalize_sequence(sequence_col))
    reason = F.when(F.col(sequence_col) == "", "missing_sequence").when(~seq.valid_dna(sequence_col), "invalid_dna")
    if require_target:
        reason = reason.when(is_missing(target_col), "missing_target")
        if task == "classification":
            value: Column = class_label(target_col)
            reason = reason.when(value.isNull(), "missing_target")
        else:
            value = parse_float(target_col)
            reason = reason.when(value.isNull(), "non_numeric_target")
        out = out.withColumn("target_value", value)
    return out.withColumn("reason", reason)


def accepted(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    return df.where("reason IS NULL").drop("reason").withColumns({
        "sequence_hash": seq.sequence_hash(sequence_col),
        "rc_stable_hash": seq.canonical_hash(sequence_col),
        "length": F.length(sequence_col),
    })


def rejected(df: DataFrame, row_col: str, id_col: str, sequence_col: str = "sequence") -> DataFrame:
    return df.where("reason IS NOT NULL").select(
        F.col(row_col).alias("row_index"), F.col(id_col).alias("id"), F.col(sequence_col).alias("sequence"), "reason")


def zero_padded(number: Column, digits: int) -> Column:
    """At least ``digits`` digits; a longer number is never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def fill_ids(df: DataFrame, id_col: str, order_col: str, project: str) -> DataFrame:
    """Blank ids become ``{project}_{accepted position, six digits}``."""
    numbered = ordered.row_number(df, "__pos", [F.col(order_col)], F.col(order_col).cast("double"))
    made = F.concat(F.lit(f"{project}_"), zero_padded(F.col("__pos") - 1, 6))
    return numbered.withColumn(id_col, F.when(non_blank(id_col), F.col(id_col)).otherwise(made)).drop("__pos")


def prediction_rows(df: DataFrame, prediction_col: str, uncertainty_col: str | None) -> DataFrame:
    """Typed prediction and uncertainty, uncertainty status, and the reject reason."""
    prediction = parse_float(prediction_col)
    out = df.withColumn("prediction_value", prediction)
    if uncertainty_col:
        value = parse_float(uncertainty_col)
        usable = F.coalesce(value >= 0, F.lit(False))
        out = out.withColumn("uncertainty_value", F.when(usable, value))
        out = out.withColumn("uncertainty_input_status", F.when(usable, "provided_valid").otherwise("missing_or_invalid"))
    else:
        out = out.withColumn("uncertainty_value", F.lit(None).cast("double"))
        out = out.withColumn("uncertainty_input_status", F.lit("not_provided"))
    return out.withColumn("reason", F.when(F.col("prediction_value").isNull(), "missing_or_invalid_prediction"))


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows"))


def audit_counters(validated: DataFrame) -> DataFrame:
    """One row: total, accepted and per-reason counts (numeric failures count as missing targets)."""
    hit = lambda *r: F.count_if(F.coalesce(F.col("reason").isin(*r), F.lit(False)))
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("reason").isNull()).alias("accepted_rows"),
        hit("missing_sequence").alias("missing_sequence_rows"), hit("invalid_dna").alias("invalid_dna_rows"),
        hit("missing_target", "non_numeric_target").alias("missing_target_rows"))


def duplicate_labels(df: DataFrame, order_col: str, hash_col: str = "sequence_hash",
                     target_col: str = "target_value") -> DataFrame:
    """Later copies of a sequence and how many disagree with the first copy's target.

    The first copy is a minimum per hash, so a sequence copied a billion times is
    combined on the map side instead of being sorted in one window.
    """
    first = df.groupBy(hash_col).agg(
        F.min_by(target_col, order_col).alias("first_target"), F.min(order_col).alias("first_row"),
        F.count(F.lit(1)).alias("copies"))
    later = df.select(hash_col, target_col, order_col).join(first.where("copies > 1"), hash_col)
    later = later.where(F.col(order_col) != F.col("first_row"))
    return later.agg(
        F.count(F.lit(1)).alias("duplicate_sequences"),
        F.count_if(~F.col(target_col).eqNullSafe(F.col("first_target"))).alias("conflicting_duplicate_labels"))


def target_summary(df: DataFrame, value: str = "target_value", group: list[str] = []) -> DataFrame:
    v = F.col(value)
    df = settle(df.select(*group, value))
    plain = df.groupBy(*group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    median = ordered.quantiles(df, value, {"median": 0.5}, group)
    joined = plain.join(median, group, "left") if group else plain.join(F.broadcast(median), how="left")
    return joined.select(*group, "count", "mean", "std", "min", "median", "max")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-blank cells per column, in one pass."""
    one = df.agg(*[F.coalesce(F.avg(non_blank(c).cast("int")), F.lit(0.0)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "coverage")


def group_balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: number of groups, share of the largest, count per value (blank kept as a value)."""
    cells = [F.struct(F.lit(c).alias("column"), F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)),
                                                       F.col(c).cast("string")).otherwise(MISSING).alias("value"))
             for c in columns]
    counts = df.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.column", "s.value").agg(
        F.count(F.lit(1)).alias("rows"))
    return counts


def balance_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("num_groups"), (F.max("rows") / F.sum("rows")).alias("largest_fraction"))


def audit_warnings(validated: DataFrame, columns: list[str], low_n: int = 200) -> DataFrame:
    """Low-count and group-imbalance warnings of an ingest."""
    ok = validated.where("reason IS NULL")
    rows = ok.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < low_n).select(
        F.lit("rows").alias("subject"),
        F.concat(F.lit(SAYS["do_not_trust_only"]), F.col("n").cast("string"), F.lit(
            SAYS["labeled_rows_passed_validation_use"])).alias("warning"))
    stats = balance_summary(group_balance(ok, columns))
    few = F.concat(F.lit(SAYS["group_column"]), "column", F.lit(SAYS["has_fewer_than_2_groups"]))
    lop = F.concat(F.lit(SAYS["group_column"]), "column", F.lit(SAYS["is_imbalanced_largest_group_contains"]),
                   fixed(F.col("largest_fraction") * 100, 1), F.lit(SAYS["of_accepted_rows"]))
    text = F.when(F.col("num_groups") < 2, few).when(F.col("largest_fraction") >= 0.80, lop)
    return rows.union(stats.select(F.col("column").alias("subject"), text.alias("warning")).where("warning IS NOT NULL"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    seen = df.agg(*[F.count_if(non_blank(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if seen[c]])


def column_levels(df: DataFrame, columns: list[str], limit: int = 20) -> DataFrame:
    """Cardinality per column and its sorted levels when there are at most ``limit``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(cells).alias("s")).where("s.value IS NOT NULL").select("s.column", "s.value").distinct()
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))
    low = values.join(counts.where(F.col("cardinality") <= limit), "column")
    levels = low.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("levels"))
    return counts.join(levels, "column", "left")


def binary_labels(df: DataFrame, label_col: str, positive: str | None = None) -> tuple[str, str]:
    """(negative, positive) label of a column holding one or two labels."""
    from ..functions.values import POSITIVE_LABELS

    # three values at most reach the driver: enough to know that there are more than two
    found = sorted(r[0] for r in df.select(class_label(label_col).alias("l")).where("l IS NOT NULL").distinct().limit(3).collect())
    if not found or len(found) > 2:
        raise ValueError("classification needs one or two labels")
    if positive is not None:
        if len(found) == 2 and positive not in found:
            raise ValueError(f"positive label {positive!r} is not among {found}")
    elif len(found) == 2:
        positive = next((p for p in POSITIVE_LABELS if p in found), found[-1])
    else:
        raise ValueError("a positive label is required when only one class is present")
    negative = next((l for l in found if l != positive), "__unobserved_negative__")
    return negative, positive


def encode_labels(df: DataFrame, label_col: str, positive: str | None = None) -> DataFrame:
    """Add ``encoded``: 0/1 for known words or a declared positive label, else alphabetical position.

    Labels are counted and numbered in Spark and joined back, however many there are.
    """
    from ..functions.values import LABEL_CODES

    labelled = df.withColumn("__label", class_label(label_col))
    counted = labelled.where("__label IS NOT NULL").groupBy("__label").agg(F.count(F.lit(1)).alias("n"))
    words = list(LABEL_CODES)
    seen = counted.agg(F.count(F.lit(1)).alias("labels"), F.count_if(~F.col("__label").isin(words)).alias("other"),
                       F.count_if(F.col("__label") == F.lit(positive or "")).alias("declared")).first()
    if positive is not None:
        if seen["declared"] != 1 or seen["labels"] != 2:
            raise ValueError("a positive label needs exactly two labels, one of them the positive one")
        return labelled.withColumn("encoded", (F.col("__label") == positive).cast("int")).drop("__label")
    if not seen["other"]:
        codes = F.create_map(*[F.lit(x) for item in LABEL_CODES.items() for x in item])
        return labelled.withColumn("encoded", F.element_at(codes, F.col("__label"))).drop("__label")
    lead = F.conv(F.hex(F.substring(F.rpad(F.col("__label"), 6, " ").cast("binary"), 1, 6)), 16, 10).cast("double")
    placed = ordered.row_number(counted, "__at", [F.col("__label")], lead)
    codes = placed.select("__label", (F.col("__at") - 1).cast("int").alias("encoded"))
    return labelled.join(codes, "__label", "left").drop("__label")


def display_id(prefix: str, position: Column, *columns: str) -> Column:
    """First non-blank id column, else a short hash label, else a numbered fallback."""
    return F.coalesce(
        first_non_blank(*columns) if columns else F.lit(None),
        F.when(non_blank("sequence_hash"), F.concat(F.lit("hash:"), F.substring("sequence_hash", 1, 12))),
        F.concat(F.lit(f"{prefix}_"), zero_padded(position, 4)))
