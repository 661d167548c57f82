"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn (ties: role, text).
Neighbouring turns of one role become one block. A block is written as

    <s>ROLE[INST]TEXT[/INST]TEXT ...</s>

with ``[/INST]`` between the texts that were merged. Inside roles and texts a backslash is
doubled and every ``<`` and ``[`` is followed by a backslash, so none of the marks can
occur in them and ``read_back`` restores them exactly. ``loss_runs`` is the loss mask as
run lengths in code points over ``formatted``: not under the mask, under it, and so on;
the texts of the trained roles are under it, marks never are.

A null role or text is an empty one. Rows without conversation id form one conversation
with a null id. Repeated rows are turns of their own. An empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, TEXT, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    for mark, written in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        c = F.replace(c, F.lit(mark), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for written, mark in (("[\\", "["), ("<\\", "<"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(written), F.lit(mark))
    return c


def _split(c: Column, mark: str) -> Column:
    return F.split(c, f"\\Q{mark}\\E", -1)


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_runs of every conversation."""
    collected = (
        turns.select("conv_id", F.struct(
            F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    role_at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns")))
    blocks = F.transform(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")), lambda s: F.struct(
        role_at(s["a"]).alias("role"),
        F.transform(F.slice("turns", s["a"] + 1, s["b"] - s["a"]), lambda t: escape(t["text"])).alias("texts")))
    written = F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), escape(b["role"]), F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(CLOSE)))
    # run lengths of a block: its head, then text and mark in turn
    def runs(b: Column) -> Column:
        masked = b["role"].isin(*trained)
        lengths = F.flatten(F.transform(b["texts"], lambda x: F.array(F.length(x), F.lit(len(NEXT)))))
        # the last text is followed by the block's close instead of a break
        body = F.concat(F.slice(lengths, 1, F.size(lengths) - 1), F.array(F.lit(len(CLOSE))))
        head = F.length(escape(b["role"])) + len(OPEN) + len(TEXT)
        total = head + F.aggregate(body, F.lit(0), lambda a, x: a + x)
        return F.when(masked, F.concat(F.array(head), body)).otherwise(F.array(total, F.lit(0)))
    # every block ends after a stretch outside the mask, or with an empty masked one: blocks line up as pairs
    def paired(b: Column) -> Column:
        r = runs(b)
        return F.when(F.size(r) % 2 == 1, F.concat(r, F.array(F.lit(0)))).otherwise(r)
    return (
        collected.withColumn("starts", starts).withColumn("ends", ends).withColumn("blocks", blocks)
        .select("conv_id", F.array_join(written, "").alias("formatted"),
                F.flatten(F.transform("blocks", paired)).alias("loss_runs"))
    )


def read_back(formatted: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, both read from ``formatted``."""
    blocks = _split(F.col("formatted"), CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def texts(block: Column) -> Column:
        head = _split(F.substring(block, len(OPEN) + 1, 2**31 - 1), TEXT)
        role = unescape(F.get(head, F.lit(0)))
        return F.transform(_split(F.get(head, F.lit(1)), NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))
    out = formatted.withColumn("turns", F.flatten(F.transform(blocks, texts)))
    return out.withColumn("loss_texts", F.transform(F.filter("turns", lambda t: t["role"].isin(*trained)), lambda t: t["text"]))


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
