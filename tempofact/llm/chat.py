"""Chat formatting from event logs: fold streamed events into messages, render them, mark what is trained on.

A log has conv_id, turn, seq, kind, role and text. Kinds: ``open`` starts a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` drops what was generated so far (its text, if any, begins the new answer). Events
are partitioned by conversation and turn, sorted by sequence and folded into messages by running counts, so the work is
linear in the log; only the finished texts of one conversation meet in one row. Native DataFrame operations throughout.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and a
backslash is put inside ``<|``; a line break in a role becomes ``<\\!|``. So a control string cannot come from a text
and the text can be read back exactly.

Defined results: null texts and roles count as empty; events without an ``open`` start a message; ties in seq are
ordered by kind, role and text, repeated rows are messages of their own; a null turn comes first; a null conv_id is a
conversation; an empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\!|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\!|"), F.lit("\n")))


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, pos, role and text of the final messages.

    A message's events are numbered; those from its last reset on are its text, joined once.
    """
    order = W.partitionBy("conv_id", "turn").orderBy(*[F.col(c).asc_nulls_first() for c in ("seq", "kind", "role", "text")])
    log = events.select("conv_id", "turn", "seq", "kind", "role", "text").withColumn("nth", F.row_number().over(order))
    log = log.withColumn("pos", F.count_if(F.col("kind") == "open").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # a delta before any open begins message 0; an open begins its own
    of = W.partitionBy("conv_id", "turn", "pos")
    reset = F.max(F.when(F.coalesce(F.col("kind"), F.lit("")) != "delta", F.col("nth"))).over(of)
    log = log.withColumns({"reset": F.coalesce(reset, F.lit(0)), "role": F.first("role").over(of.orderBy("nth"))}).where("nth >= reset")
    parts = F.array_sort(F.collect_list(F.struct("nth", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return log.groupBy("conv_id", "turn", "pos").agg(F.coalesce(F.max("role"), F.lit("")).alias("role"), text.alias("text"))


def render(msgs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row a conversation: formatted, and loss_spans, the code point ranges [start, end) that are trained on.

    Where a message begins is a running sum; texts meet in the one row that they must make.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = msgs.select("conv_id", "turn", "pos", (F.col("role") == trained_role).alias("trained"), F.length(head).cast("long").alias("head"), F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("stop", F.sum(F.length("text").cast("long")).over(order))
    span = F.struct((F.col("stop") - F.length("text") + F.col("head")).alias("start"), (F.col("stop") - len(END) - 1).alias("end"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stop", "text"))).alias("parts"), F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Parse the rendered text again: turns (role, text) and loss_texts, what the spans cover, both unescaped.

    Pieces are numbered once and where one begins is a running sum, so the work is linear in a conversation. The n-th span is read
    in the n-th message of ``trained_role``.
    """
    tail = len(END) + 1
    pieces = formatted.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>", -1)).alias("n", "raw")).where("n > 0")
    order = W.partitionBy("conv_id").orderBy("n")
    role = F.substring_index("raw", "\n", 1)
    pieces = pieces.withColumns({"role": role, "stop": F.sum(F.length("raw").cast("long") + len(START)).over(order)})
    pieces = pieces.withColumns({"at": F.col("stop") - F.length("raw") - len(START), "nth": F.when(F.col("role") == trained_role, F.count_if(F.col("role") == trained_role).over(order))})
    spans = formatted.select(F.col("conv_id").alias("_conv"), F.posexplode("loss_spans").alias("i", "span")).select("_conv", (F.col("i") + 1).cast("long").alias("_nth"), "span")
    both = pieces.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("nth") == F.col("_nth")), "left")
    text = unescape(F.substring("raw", F.length("role") + 2, F.length("raw") - F.length("role") - 1 - tail))
    under = unescape(F.substring("raw", (F.col("span.start") - F.col("at") - len(START) + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int")))
    read = both.select("conv_id", "n", unescape_role(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("span").isNotNull(), under).alias("under"))
    whole = read.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("xs"), F.array_sort(F.collect_list(F.when(F.col("under").isNotNull(), F.struct("n", "under")))).alias("ys"))
    turns = F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return formatted.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*[F.col(f"`{c}`") for c in formatted.columns], turns.alias("turns"), F.transform("ys", lambda y: y["under"]).alias("loss_texts"))


def format_chats(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    return render(messages(events), trained_role)


def events_of(conversations: DataFrame) -> DataFrame:
    """A streamed log of finished turns, as a chat service might have written it.

    An assistant's answer opens empty, streams a false start, is regenerated and streams in three deltas; any other
    text opens with its first half and is edited into the whole.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.col("role")
    third = F.floor(F.length(text) / 3).cast("int")
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind == "open"), role).alias("role"), body.alias("text"))
    draft = F.substring(text, F.lit(1), third)
    streamed = F.array(
        event("open", F.lit("")), event("delta", F.concat(draft, F.lit(" <|im_end|>"))), event("regenerate", F.lit(None).cast("string")), event("delta", draft),
        event("delta", F.substring(text, third + 1, third)), event("delta", F.substring(text, third * 2 + 1, F.length(text))),
    )
    log = F.when(role == "assistant", streamed).otherwise(F.array(event("open", draft), event("edit", text)))
    # rows that repeat conv_id and turn are messages of their own, in the order of role and text
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.coalesce(role, F.lit("")), text))
    numbered = conversations.select("conv_id", "turn", nth.alias("nth"), log.alias("log"))
    return numbered.select("conv_id", "turn", "nth", F.posexplode("log").alias("i", "e")).select("conv_id", "turn", (F.col("nth") * 8 + F.col("i")).alias("seq"), "e.kind", "e.role", "e.text")
