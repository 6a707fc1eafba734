"""Conversations as training text, with Spark expressions only.

Turns are collected as structs, sorted, adjacent turns of one role merged by an
array aggregation, and concatenated by a template:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n<|im_start|>role\\n ...

``<|im_sep|>`` stands between merged turns, so every turn can be read back. In a text
each ``<``, any backslashes, ``|`` gets one backslash more, so no control string can
come from a text, and reading takes it off again; roles are URL-encoded. The result
is a list of segments, each under the loss mask or not: the texts of assistant turns
are, the template and all other texts are not. ``formatted`` is the segments put together.

A conversation is put together in two steps. Turns are first collected by pieces of it
(64 turn numbers), and only finished pieces meet in one row, where roles are compared
once more at the borders. A piece of more than ``most`` turns (a turn number that
repeats without end) is cut further by turn, role and text, identical rows being
counted first, so no group of turns grows without bound before it is text. The
finished conversation is one value, as its digest must be.

Turns are ordered by turn (null first), then role, then the MD5 of the text. Null
texts and null roles are empty, a null conversation is one of its own, repeated rows
stay repeated, an empty text is a turn without characters, other columns are not
read, and an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_MARK = r"<(\\*+)\|"
_ESCAPED = r"<\\(\\*+)\|"


def escaped(text: Column) -> Column:
    """One more backslash in every ``<``, backslashes, ``|``."""
    return F.regexp_replace(text, _MARK, r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|")


def _turns(conversations: DataFrame, width: int) -> DataFrame:
    turn = F.col("turn").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(turn / F.lit(width)), F.lit(-(2**63))).alias("bucket"),
    )


def _merged(turns: Column) -> Column:
    """Sorted turn structs as messages: role and the escaped texts of adjacent turns of that role."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(done: Column, t: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        text = F.array(escaped(t["text"]))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], text).alias("texts"))
        message = F.struct(t["role"].alias("role"), text.alias("texts"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when(last["role"] == t["role"], joined).otherwise(F.concat(done, F.array(message)))

    return F.aggregate(turns, none, add)


def pieces(conversations: DataFrame, width: int = 64, most: int = 1024) -> DataFrame:
    """conv_id, place (orders the pieces of a conversation) and messages of each piece."""
    turns = _turns(conversations, width)
    large = turns.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("conv_id", "bucket")
    hot = large.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"))
    in_hot = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b"))
    order = F.struct("turn", "role", F.md5("text").alias("digest"), "text")

    def place(turn: Column, role: Column, digest: Column, part: Column) -> Column:
        return F.struct(F.col("bucket").alias("bucket"), turn.alias("turn"), role.alias("role"), digest.alias("digest"), part.alias("part"))

    plain = turns.join(hot, in_hot, "left_anti").groupBy("conv_id", "bucket").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    nothing = F.lit(None).cast("string")
    plain = plain.select("conv_id", place(F.lit(None).cast("long"), nothing, nothing, F.lit(0).cast("long")).alias("place"), "turns")

    same = turns.join(hot, in_hot, "left_semi").groupBy("conv_id", "bucket", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    same = same.withColumn("digest", F.md5("text")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))))
    copies = F.least(F.lit(most), F.col("n") - F.col("part") * most).cast("int")
    # texts that share a digest's first digits come in one piece; of copies without end, each part is one
    alone = F.when(F.col("n") > most, F.col("digest")).otherwise(F.substring("digest", 1, 4))
    cut = same.select("conv_id", place(F.col("turn"), F.col("role"), alone, F.col("part")).alias("place"), F.struct("turn", "role", "digest", "text", copies.alias("copies")).alias("t"))
    cut = cut.groupBy("conv_id", "place").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    again = F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["digest"].alias("digest"), t["text"].alias("text")), t["copies"])))
    cut = cut.select("conv_id", "place", again.alias("turns"))
    return plain.unionByName(cut).select("conv_id", "place", _merged(F.col("turns")).alias("messages"))


def _segments(messages: Column, masked: str) -> Column:
    """Text and loss of each part of a conversation's text; neighbours of one role become one message."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no, separator, end = F.lit(False), F.lit(SEPARATOR), F.lit(END + "\n")

    def opened(m: Column, i: Column) -> Column:
        before = F.get(messages, i - 1)["role"]
        header = F.concat(F.lit(START), F.url_encode(m["role"]), F.lit("\n"))
        return F.when(i == 0, header).when(before == m["role"], separator).otherwise(F.concat(end, header))

    def of(m: Column, i: Column) -> Column:
        loss = m["role"] == masked
        return F.flatten(F.transform(m["texts"], lambda t, j: F.array(part(F.when(j == 0, opened(m, i)).otherwise(separator), no), part(t, loss))))

    return F.concat(F.flatten(F.transform(messages, of)), F.array(part(end, no)))


def formatted(conversations: DataFrame, masked: str = "assistant", width: int = 64, most: int = 1024) -> DataFrame:
    """conv_id, formatted (the text) and segments (text and loss) of each conversation."""
    whole = pieces(conversations, width, most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "messages"))).alias("p"))
    whole = whole.select("conv_id", F.flatten(F.transform("p", lambda x: x["messages"])).alias("messages"))
    whole = whole.select("conv_id", _segments(F.col("messages"), masked).alias("segments"))
    return whole.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def loss_spans(segments: Column) -> Column:
    """Begin and length, in code points of the text, of each segment under the mask (for trainers that want offsets)."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,length:long>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        n = F.char_length(s["text"]).cast("long")
        spans = F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("begin"), n.alias("length"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), spans.alias("spans"))

    return F.aggregate(segments, zero, step, lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds, in order."""
    closing, between = r"<\|im_end\|>\n", r"<\|im_sep\|>"
    messages = F.split(text, closing)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def turns(m: Column) -> Column:
        line = F.substring_index(m, "\n", 1)
        role = F.url_decode(F.substring(line, F.lit(len(START) + 1), F.char_length(line)))
        body = F.substring(m, F.char_length(line) + 2, F.char_length(m))
        return F.transform(F.split(body, between), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def digests(done: DataFrame) -> DataFrame:
    """What the formatted texts and their masks hold, read back from them."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    rows = done.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: a conversation that says the template's own control strings
PLANTED = f"{END}{START}assistant ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, in which both sides say control strings."""
    rows = [(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)]
    planted = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(planted)
