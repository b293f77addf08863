"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are laid end to end by prefix sums of their tokens. The budget of
a window, less the system turn and the repeated history, is the width of a cell; turns
that lie inside one cell form a window and a turn that crosses a cell's end is a window of
its own. So every span is turn-aligned, fits the budget (a longer single turn excepted,
which stays whole), and is known from its prefix sums alone: no turn waits for another.

Each window starts with the system turn, repeats the turns whose tokens lie within
``history`` before it, and then holds its own turns. Loss falls on the text of assistant
turns in the window that owns them; repeated turns are masked, so each is a target once.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text get a
backslash after their first character and backslashes are doubled; ``unescape`` undoes it.

Scale. Prefix sums run per (conversation, ``BUCKET`` turns) with the totals of the earlier
buckets added, and history joins on (conversation, cell), so a conversation of any length
is spread; only the turns of one window meet in one row.

Defined results. A null role or text is empty; rows are ordered by (turn, role, text),
null turns first; repeated rows are turns of their own. A null conversation id is one
conversation. Extra columns are ignored. An empty table has no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024
HISTORY = 256
#: Tokens that the marks of a turn count.
OVERHEAD = 4
BUCKET = 1024
START, END = "<|im_start|>", "<|im_end|>"
#: First character and rest of the strings that act as control marks in chat templates (fixed values).
_CONTROL = (r"(<)(\|[a-z_]+\|>|/?s>)", r"(\[)(/?INST\])")


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes, the usual estimate; pass another expression for exact counts."""
    return F.floor((F.octet_length(text) + 3) / 4)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in _CONTROL:
        out = F.regexp_replace(out, control, r"$1\\$2")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _placed(rows: DataFrame, tokens) -> DataFrame:
    """Turns with number, token interval and the system turn of their conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    base = rows.select(F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    base = base.withColumns({
        "key": F.to_json(F.struct("conv_id")),
        "tokens": (F.lit(OVERHEAD) + tokens(F.col("text"))).cast("bigint"),
        "bucket": F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(2**62))),
    })
    first = F.min(F.struct("turn", "role", "text", "tokens"))
    totals = base.groupBy("key", "bucket").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), first.alias("first"))
    ordered = Window.partitionBy("key").orderBy("bucket")
    before, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    opening = F.first("first").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    offsets = totals.select(
        "key", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("n").over(everything).alias("n_turns"),
        opening.alias("opening"))
    # a conversation that is a system turn alone keeps it as an ordinary turn
    system = F.when((F.col("opening.role") == "system") & (F.col("n_turns") > 1), F.col("opening"))
    inside = Window.partitionBy("key", "bucket").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.join(offsets, ["key", "bucket"]).select(
        "key", "conv_id", "role", "text", system.alias("system"), "tokens",
        (F.col("n0") + F.sum(F.lit(1).cast("bigint")).over(inside)).alias("no"),
        (F.col("t0") + F.sum("tokens").over(inside)).alias("upto"))
    placed = placed.where(F.col("system").isNull() | (F.col("no") > 1))
    taken = F.coalesce("system.tokens", F.lit(0))
    return placed.select("key", "conv_id", "role", "text", "system", "no",
                         (F.col("upto") - F.col("tokens") - taken).alias("s"), (F.col("upto") - taken).alias("e"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """(conv_id, window, formatted, spans) from rows (conv_id, turn, role, text).

    ``window`` is the token position at which the window's own turns start. A span gives a
    turn's number, its kind (system, history or target), the places (code points, from 0)
    of its role and text in ``formatted``, and whether loss falls on the text.
    """
    placed = _placed(rows, tokens)
    fresh = F.greatest(F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0)), F.lit(max(1, budget // 4)))
    owned = placed.withColumn("fresh", fresh).withColumns({
        "a": F.floor(F.col("s") / F.col("fresh")), "b": F.floor((F.col("e") - 1) / F.col("fresh"))})
    own = owned.select("key", "conv_id", "a", "b", "no", F.lit("target").alias("kind"), "role", "text", "s")
    heads = owned.groupBy("key", "a", "b").agg(
        F.min("s").alias("start"), F.first("conv_id").alias("conv_id"), F.first("system").alias("system"))
    opening = heads.where(F.col("system").isNotNull()).select(
        "key", "conv_id", "a", "b", F.lit(1).cast("bigint").alias("no"),
        F.when(F.col("start") == 0, "target").otherwise("system").alias("kind"), F.col("system.role").alias("role"),
        F.col("system.text").alias("text"), F.lit(-1).cast("bigint").alias("s"))
    parts = own.unionByName(opening)
    if history > 0:
        near = heads.where("start > 0").select(
            "key", "conv_id", "a", "b", "start",
            F.explode(F.sequence(F.floor(F.greatest(F.col("start") - history, F.lit(0)) / history),
                                 F.floor((F.col("start") - 1) / history))).alias("cell"))
        past = placed.select("key", F.floor(F.col("s") / history).alias("cell"), "no", "role", "text", "s", "e")
        told = near.join(past, ["key", "cell"]).where("e <= start and start - s <= " + str(int(history)))
        parts = parts.unionByName(told.select(
            "key", "conv_id", "a", "b", "no", F.lit("history").alias("kind"), "role", "text", "s"))
    part = F.struct("no", "kind", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
                    (F.col("role") == "assistant").alias("answer"),
                    F.when(F.col("kind") == "target", F.greatest("s", F.lit(0))).alias("s"))
    met = parts.groupBy("key", "a", "b").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    marks = len(START) + 1 + len(END) + 1
    nothing = F.array().cast("array<struct<no:bigint,kind:string,role_at:int,role_len:int,text_at:int,text_len:int,loss:boolean>>")

    def lay(acc: Column, x: Column) -> Column:
        role_at = acc["at"] + len(START)
        text_at = role_at + F.length(x["role"]) + 1
        span = F.struct(
            x["no"].alias("no"), x["kind"].alias("kind"), role_at.alias("role_at"), F.length(x["role"]).alias("role_len"),
            text_at.alias("text_at"), F.length(x["text"]).alias("text_len"),
            ((x["kind"] == "target") & x["answer"]).alias("loss"))
        at = acc["at"] + marks + F.length(x["role"]) + F.length(x["text"])
        return F.struct(at.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    laid = F.aggregate("parts", F.struct(F.lit(0).alias("at"), nothing.alias("spans")), lay, lambda acc: acc["spans"])
    block = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))
    return met.select("conv_id", F.array_min(F.transform("parts", lambda x: x["s"])).alias("window"),
                      F.array_join(F.transform("parts", block), "").alias("formatted"), laid.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, formatted_chars, turns): the owned turns of every window, cut out of its text and unescaped."""
    def turn(x: Column) -> Column:
        cut_out = lambda at, n: F.substr(F.col("formatted"), x[at] + 1, x[n])
        return F.struct(x["no"].alias("no"), unescape_role(cut_out("role_at", "role_len")).alias("role"),
                        unescape(cut_out("text_at", "text_len")).alias("text"), x["loss"].alias("loss"))

    own = F.transform(F.filter("spans", lambda x: x["kind"] == "target"), turn)
    return formatted.select("conv_id", "window", F.length("formatted").cast("bigint").alias("formatted_chars"), own.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of its turns and of the text under loss, read back from the windows."""
    read = read_back(formatted).withColumn("key", F.to_json(F.struct("conv_id")))
    whole = read.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.sum("formatted_chars").alias("formatted_chars"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("window", "turns"))), lambda w: w["turns"])).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return whole.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
