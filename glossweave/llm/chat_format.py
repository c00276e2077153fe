"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, kind, message, role, text). Kinds:
  message     a message with its text (a second one for the same message replaces the first),
  delta       appends text to the message, and begins it if it is new,
  edit        replaces the message's text,
  regenerate  discards the message's text and every message begun after it and before this event;
              later deltas fill it anew (text, if any, begins it),
  delete      removes the message.
Events are partitioned by conversation, sorted by seq and folded into final messages, which are rendered
through the template
    <|turn|>ROLE\\nTEXT<|end|>
for each message in the order in which they began. Control strings inside roles and texts are broken by a
backslash after their first character, and one more backslash goes where some stand there already, so
unescaping gives back every text. The loss mask lists the spans (start, end in code points) of assistant
texts in the formatted string.

Defined cases: null texts and roles are empty; events with a null conv_id or message are left out, a null
seq comes first; equal seq values are ordered by kind, message, role and text; repeated events count as
often as they stand; a message whose role changes keeps the role of the event that set its text last;
an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"
#: What a control string is: its first character, backslashes of earlier escapes, and the rest.
_BROKEN = r"([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)"
_WHOLE = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|/?SYS>)"


def escape(text):
    return F.regexp_replace(text, _BROKEN, r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, _WHOLE, r"$1$2$3")


def _role_out(role):
    """A role is one line: its backslashes and line ends are spelled out before control strings are broken."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role):
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def final_messages(log: DataFrame) -> DataFrame:
    """conv_id, at (the message's place), role, text after all events are folded in."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    events = log.where("conv_id is not null and message is not null").select("conv_id", "seq", "kind", "message", text("role").alias("role"), text("text").alias("text"))
    order = ["seq", "kind", "message", "role", "text"]
    by_conv = Window.partitionBy("conv_id").orderBy(*order)
    events = events.withColumn("at", F.row_number().over(by_conv))
    by_message = Window.partitionBy("conv_id", "message")
    resets = F.col("kind").isin("message", "edit", "regenerate", "delete")
    events = events.withColumns(
        {
            "born": F.min("at").over(by_message),
            "reset": F.max(F.when(resets, F.col("at"))).over(by_message),
        }
    )
    # each regeneration discards what was begun after its own message and before itself
    regenerated = F.collect_list(F.when(F.col("kind") == "regenerate", F.struct(F.col("born").alias("after"), F.col("at").alias("before"))))
    events = events.withColumn("cuts", regenerated.over(Window.partitionBy("conv_id")))
    events = events.where(~F.exists("cuts", lambda c: (F.col("born") > c["after"]) & (F.col("born") < c["before"])))
    events = events.where((F.col("reset").isNull() | (F.col("at") >= F.col("reset"))) & (F.col("kind") != "delete") & F.col("kind").isin("message", "delta", "edit", "regenerate"))
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    folded = events.groupBy("conv_id", "message").agg(F.min("born").alias("at"), parts.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return folded.select("conv_id", "at", F.col("parts")[0]["role"].alias("role"), whole.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (spans of assistant texts), n_turns."""
    prefix = F.concat(F.lit(TURN), _role_out(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", F.struct("at", prefix.alias("prefix"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("turn"))
    turns = turns.select("conv_id", F.col("turn").withField("n", F.length("turn.prefix").cast("long")).withField("m", F.length("turn.body").cast("long")).alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["prefix"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    begin = lambda s, t: s["at"] + t["n"]
    mask = F.aggregate(
        "turns",
        zero,
        lambda s, t: F.struct(
            (begin(s, t) + t["m"] + len(END)).alias("at"),
            F.when(t["loss"], F.array_append(s["spans"], F.struct(begin(s, t).alias("start"), (begin(s, t) + t["m"]).alias("end")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return whole.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"), F.size("turns").cast("long").alias("n_turns"))


def parse(formatted):
    """Column of (role, text) structs read back from a formatted string."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|turn\|>", -1)) - 1, F.lit(0)))

    def turn(piece):
        cut = F.locate("\n", piece)
        end = F.length(piece) - len(END)
        return F.struct(_role_in(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(piece, cut + 1, end - cut)).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted, loss_mask):
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def as_log(conversations: DataFrame) -> DataFrame:
    """The event log of a table of turns (conv_id, turn, role, text): every row is a message of its own."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "role", "text"))
    return rows.select("conv_id", "seq", F.lit("message").alias("kind"), nth.cast("long").alias("message"), "role", "text")


def format_conversations(log: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: conv_id, formatted, loss_mask, n_turns."""
    return materialize(render(final_messages(log)), "chat")


def digest(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the written output alone."""
    turns = parse(F.col("formatted"))
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    return output.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The table of turns and conversation -7, whose texts hold control strings."""
    spark, text = conversations.sparkSession, "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(extra)
