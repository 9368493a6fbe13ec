"""Chat formatting in budgeted windows of whole turns; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """No control string (<|turn|>, </s>, [INST], ...) is left: '<' and '[' are written out."""
    for a, b in (("^", "^0"), ("<", "^1"), ("[", "^2")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("^3", "\n"), ("^2", "["), ("^1", "<"), ("^0", "^")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 3) -> DataFrame:
    """``conv_id, window, formatted, n_context, n_new, loss_spans`` of ``turns(conv_id, turn, role, text)``.

    A turn counts a token for each four characters, at least one. Prefix sums of these cut each
    conversation into spans of whole turns: a span holds the turns whose sum ends within one stretch of
    half the budget that the system turn leaves. Each window is the system turn, up to ``history``
    turns before the span as far as the budget lasts, and the span; a turn is never cut, so only one
    of more than half the budget can overrun it. ``n_context`` turns at the window's start are
    repeats; the loss spans (start, size in characters) are the texts of the span's assistant turns,
    so each is a target once.

    Null role or text: empty. Turns go by (turn, role, text), so ties and repeated rows have a place
    each. A null conv_id is a conversation. No rows give no windows.
    """
    if budget < 2 or history < 0:
        raise ValueError("budget must be at least 2, history at least 0")
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    rows = rows.withColumn("tokens", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long"), "end": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("system", system).withColumn("system_tokens", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole))
    stretch = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("system_tokens")) / 2))
    rows = rows.withColumn("span", F.when(F.col("system"), 0).otherwise(F.floor((F.col("end") - F.col("system_tokens") - 1) / stretch)))
    rows = rows.withColumn("window", F.dense_rank().over(whole.orderBy(F.when(F.col("system"), F.lit(-1)).otherwise(F.col("span")))))
    # A system turn belongs to the first span of other turns, where there is one.
    rows = rows.withColumn("has_system", F.max(F.col("system").cast("int")).over(whole))
    rows = rows.withColumn("window", F.greatest(F.lit(0), F.col("window") - 1 - F.col("has_system")).cast("int"))
    start = F.col("end") - F.col("tokens")
    rows = rows.select("conv_id", "window", "pos", "role", "text", "tokens", "system", "system_tokens", start.alias("start"), "end")

    body = rows.filter("not system")
    spans = body.groupBy(F.col("conv_id").alias("c"), F.col("window").alias("w")).agg(
        F.min("pos").alias("first"), F.min("start").alias("from"), F.sum("tokens").alias("new"), F.first("system_tokens").alias("s")
    )
    spans = spans.withColumn("room", F.lit(budget) - F.col("s") - F.col("new"))
    out = rows.select("conv_id", "window", "pos", "role", "text", F.lit(True).alias("new"))
    if history:
        ahead = body.withColumn("next", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + history)))
        near = ahead.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("next") == F.col("first")))
        near = near.filter(F.col("from") - F.col("start") <= F.col("room"))
        out = out.unionByName(near.select("conv_id", F.col("w").alias("window"), "pos", "role", "text", F.lit(False).alias("new")))
    again = rows.filter("system").join(spans.filter("w > 0"), F.col("conv_id").eqNullSafe(F.col("c")))
    out = out.unionByName(again.select("conv_id", F.col("w").alias("window"), "pos", "role", "text", F.lit(False).alias("new")))

    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("^3")), F.lit("\n"))
    out = out.withColumns({"head": head, "body": escape(F.col("text"))})
    out = out.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    target = F.col("new") & (F.col("role") == "assistant")
    out = out.withColumn("span", F.when(target, F.struct(at.cast("int").alias("start"), F.length("body").alias("size"))))
    windows = out.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"),
        F.sum((~F.col("new")).cast("int")).cast("int").alias("n_context"),
        F.sum(F.col("new").cast("int")).cast("int").alias("n_new"),
    )
    formatted = F.array_join(F.transform("pieces", lambda x: x.piece), "")
    return windows.select("conv_id", "window", formatted.alias("formatted"), "n_context", "n_new", "loss_spans")


def read_windows(windows: DataFrame) -> DataFrame:
    """The conversations back from their windows: ``conv_id, turns(array of role, text), targets
    (array of texts), formatted_chars``, each turn and each target once and in order."""
    parts = F.slice(F.split("formatted", r"<\|end\|>\n", -1), F.col("n_context") + 1, F.col("n_new"))
    at = lambda x: F.instr(x, "\n")
    turns = F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substr(x, F.lit(len(TURN) + 1), at(x) - len(TURN) - 1)).alias("role"),
            unescape(F.substr(x, at(x) + 1, F.length(x))).alias("text"),
        ),
    )
    targets = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.size)))
    read = windows.select("conv_id", "window", F.length("formatted").alias("n"), turns.alias("turns"), targets.alias("targets"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("n").alias("formatted_chars"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x.turns)).alias("turns"),
        F.flatten(F.transform("w", lambda x: x.targets)).alias("targets"),
        "formatted_chars",
    )


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and SHA-256 of turns and targets of ``read_windows``."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
