"""Chat formatting into windows under a token budget, with DataFrame functions only.

Prefix sums of the turns' tokens along a conversation choose the spans.  What the system turn and
the history leave of the budget is a window's room; the stream of tokens is cut into stretches of half
the room, and a window holds the turns that end in one stretch.  So a window is aligned to
turns, and its new turns fit into the room: those that lie inside the stretch take half of it at
most, and a turn that crosses into the stretch takes the other half, or else has a window of
its own.  Every window holds the system turn, then the turns that lie wholly in the HISTORY tokens
before its stretch, then its own; what is repeated carries no loss.

Where a turn goes follows from its own place, so windows are made without a join: each turn names the
windows that hold or repeat it.  The prefix sums are taken in two levels (stretches of
turns, then the turns in each), and windows are grouped by conversation and number: no step
gathers a whole conversation in one task, and texts are moved twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of the repeated history in it, at most.
BUDGET = 4096
HISTORY = 512
#: Turns whose prefix sums are taken together.
STRETCH = 256
#: Windows that one row names at most.
SLICE = 1024

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` is left, and every backslash starts a two-letter code."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a code's letter never follows another code's backslash."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and no line feed is left, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def bound(role: Column, text: Column) -> Column:
    """A number of tokens that no tokenizer exceeds whose tokens each cover a byte: the bytes of the formatted turn."""
    return F.octet_length(F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE))).cast("long")


def _placed(turns: DataFrame, tokens: str | None, budget: int, history: int) -> DataFrame:
    """Turns with key (a struct, so that nulls are equal), pos, n_turns, is_system, half (of the room), total, and the tokens before (``lo``) and up to the end (``hi``)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    cost = bound(role, text) if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = turns.select(
        F.struct("conv_id").alias("key"), "turn", role.alias("role"), text.alias("text"),
        # A turn beyond the budget counts as the budget: it stands alone and is out of the history's reach either way, and leaves few stretches empty.
        F.least(cost, F.lit(budget)).alias("cost"),
        F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62))).alias("stretch"),
    )
    along = Window.partitionBy("key").orderBy("stretch")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", "stretch").agg(F.sum("cost").alias("c"), F.count("*").alias("n"), F.max(F.when(F.col("role") == "system", F.col("cost"))).alias("top"))
    sums = sums.select(
        "key", "stretch",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("cost0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos0"),
        F.sum("n").over(Window.partitionBy("key")).alias("n_turns"), F.sum("c").over(Window.partitionBy("key")).alias("total"),
        # Of a conversation's first stretch: no less than its system turn, if it has one.
        F.coalesce(F.first("top").over(along), F.lit(0)).alias("top"),
    )
    inside = Window.partitionBy("key", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("pos0") + F.col("pos1") - 1
    hi = F.col("cost0") + F.col("hi0")
    placed = rows.withColumns({"hi0": F.sum("cost").over(inside), "pos1": F.count("*").over(inside)}).join(sums, ["key", "stretch"])
    room = F.greatest(F.lit(budget - history) - F.col("top"), F.lit(budget // 4))
    return placed.select(
        "key", "role", "text", "cost", "total", pos.alias("pos"), (hi - F.col("cost")).alias("lo"), hi.alias("hi"),
        ((pos == 0) & (F.col("role") == "system") & (F.col("n_turns") > 1)).alias("is_system"), F.greatest(F.floor(room / 2), F.lit(1)).cast("long").alias("half"),
    )


#: What a turn is in a window: its own, repeated from before, or a sign that the turns before it are not next to the window's own.
OWN, REPEATED, GAP = 0, 1, 2


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) as windows of formatted text with a loss mask.

    Returns conv_id, window (ascending along a conversation), n_repeated (turns at its
    beginning that an earlier window held), formatted, and loss, the (start, length)
    stretches of ``formatted``, in code points, that are assistant texts not held before.
    ``tokens`` names a column with the tokens of each formatted turn (null or negative: none); without it
    ``bound`` stands for them.  A window exceeds ``budget`` only if one turn, with system
    turn and history, does.  Turns are ordered by turn, role and text, nulls first; null roles and texts are
    empty; a null conv_id is a conversation; rows that repeat are turns of their
    own; a conversation's first turn is retained if its role is system.  Other columns are not carried.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    placed = _placed(turns, tokens, budget, history)
    half, k = F.col("half"), F.floor((F.greatest(F.col("hi"), F.lit(1)) - 1) / F.col("half"))
    crossing = F.floor(F.col("lo") / half) < k
    alone = crossing & (F.col("cost") > half)
    place = lambda window, kind: F.struct(window.cast("long").alias("window"), F.lit(kind).alias("kind"))
    # The stretches that begin after the turn and within the history's reach of it.
    first, last = F.ceil(F.greatest(F.col("hi"), F.lit(1)) / half), F.floor((F.col("lo") + history) / half)
    later = F.when(last >= first, F.flatten(F.transform(F.sequence(first, last), lambda x: F.array(place(2 * x, REPEATED), place(2 * x + 1, REPEATED)))))
    # The system turn goes to every window that there can be, SLICE of them at a time.
    most = 2 * F.floor(F.col("total") / half) + 1
    slices = F.when(F.col("is_system"), F.sequence(F.lit(0).cast("long"), F.floor(most / SLICE))).otherwise(F.array(F.lit(0).cast("long")))
    every = F.transform(F.sequence(F.col("slice") * SLICE, F.least(F.col("slice") * SLICE + (SLICE - 1), most)), lambda x: place(x, REPEATED))
    own = F.array(place(2 * k + F.when(alone, 0).otherwise(1), OWN))
    gap = F.when(alone, F.array(place(2 * k + 1, GAP)))
    none = F.array().cast("array<struct<window:bigint,kind:int>>")
    places = F.when(F.col("is_system"), every).otherwise(F.concat(own, F.coalesce(gap, none), F.coalesce(later, none)))
    text = lambda x: F.when(F.col("p.kind") != GAP, x)
    piece = F.struct(
        F.col("pos"), F.col("p.kind").alias("kind"), F.col("is_system"), (F.col("role") == "assistant").alias("assistant"),
        text(F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))).alias("head"), text(escape(F.col("text"))).alias("body"),
    )
    exploded = placed.withColumn("slice", F.explode(slices)).withColumn("p", F.explode(places)).select("key", F.col("p.window").alias("window"), piece.alias("piece"))
    grouped = exploded.groupBy("key", "window").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.max(F.when(F.col("piece.kind") == GAP, F.col("piece.pos"))).alias("gap"))
    grouped = grouped.where(F.exists("pieces", lambda x: x["kind"] == OWN))
    opening = F.exists("pieces", lambda x: (x["kind"] == OWN) & (x["pos"] == 1))  # only the first window's system turn is new
    held = F.filter("pieces", lambda x: (x["kind"] != GAP) & ((x["kind"] == OWN) | x["is_system"] | F.col("gap").isNull() | (x["pos"] > F.col("gap"))))
    held = F.transform(held, lambda x: F.struct(((x["kind"] == REPEATED) & ~(x["is_system"] & opening)).alias("repeated"), ((x["kind"] == OWN) & x["assistant"]).alias("loss"), x["head"].alias("head"), x["body"].alias("body")))
    windows = grouped.select("key.conv_id", "window", held.alias("pieces"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["head"])
        span = F.array(F.struct(start.alias("start"), F.length(x["body"]).alias("length")))
        return F.struct((start + F.length(x["body"]) + len(CLOSE)).alias("at"), F.when(x["loss"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    return windows.select(
        "conv_id", "window",
        F.size(F.filter("pieces", lambda x: x["repeated"])).alias("n_repeated"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", begin, step, lambda x: x["loss"]).alias("loss"),
    )


def parse_windows(windows: DataFrame) -> DataFrame:
    """Adds ``turns``, the (role, text) pairs that a window holds first, and ``targets``, the unescaped texts under its loss mask."""
    pieces = F.split(F.col("formatted"), "</turn>\n")
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(unescape_role(F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, cut + 1, F.length(x))).alias("text"))

    return windows.withColumns({
        "turns": F.transform(fresh, turn),
        "targets": F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))),
    })


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Of each conversation, from its windows: what turns and loss targets they hold, as counts and digests."""
    parsed = parse_windows(windows).select(
        "conv_id", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.aggregate("targets", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("loss"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("targets"),
        ).alias("part"),
    )
    whole = parsed.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("loss").alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    text = lambda name: F.sha2(F.array_join(F.transform("parts", lambda x: x[name]), ""), 256)
    return whole.select("conv_id", "n_turns", text("turns").alias("turns_sha256"), "loss_chars", text("targets").alias("loss_sha256"), "formatted_chars")
