"""Chat formatting with Spark expressions only.

The turn structs of a conversation are collected and sorted, runs of one role become one block, and blocks are joined:
``<|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>`` and a line feed. Inside roles and texts ``\\`` becomes ``\\\\`` and
``<|`` becomes ``<\\|``, so no control string can come from them, and reading back undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, ``formatted`` and ``segments``: the formatted text cut into (text, loss) where loss marks texts of ``learn``.

    Rows of a conversation go by turn, then role and text, so ties and repeated rows have one order; each row is a turn. A null
    text or role is empty; a null turn comes first; rows with a null conv_id are one conversation of that name. Other columns
    are ignored; an empty table gives an empty table. A conversation is one row of the result and so must fit in one.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id")
    got = got.agg(F.array_sort(F.collect_list("row")).alias("turns"))
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i).getField("role") != F.get("turns", i - 1).getField("role")),
    )
    got = got.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda b, k: F.struct(
            F.get("turns", b).getField("role").alias("role"),
            F.transform(
                F.slice("turns", b + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - b), lambda t: t.getField("text")
            ).alias("texts"),
        ),
    )
    got = got.select("conv_id", blocks.alias("blocks"))

    def segments(block: Column) -> Column:
        loss = block.getField("role") == learn
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        head = F.concat(F.lit(START), escape(block.getField("role")), F.lit(SEP))
        body = F.transform(
            block.getField("texts"),
            lambda t, i: F.array(part(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), part(escape(t), loss)),
        )
        return F.concat(F.flatten(body), F.array(part(F.lit(END), F.lit(False))))

    got = got.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return got.select("conv_id", F.array_join(F.transform("segments", lambda s: s.getField("text")), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    literal = lambda s: "\\Q" + s + "\\E"

    def turns(block: Column) -> Column:
        cut = F.split(F.substr(block, F.lit(len(START) + 1)), literal(SEP), -1)
        texts = F.split(F.get(cut, F.lit(1)), literal(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(cut, F.lit(0))).alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, literal(END), -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of formatted conversations, all read back from the formatted text and its loss mask."""
    lines = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda s: s.getField("loss")), lambda s: unescape(s.getField("text")))
    got = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(learnt, "").alias("learnt"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
