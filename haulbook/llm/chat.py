"""Chat formatting as a relational job: Spark expressions only.

A conversation's rows are collected as structs and sorted by turn. Adjacent turns of one role
are merged into a block, which is written once with its role:

    <s>role\\n text <sep> text </s>\\n        and for users  <s>user\\n[INST] text [/INST]</s>\\n

Every turn stays marked, so the output can be read back. `&` and the control strings are
escaped inside texts and roles (`&amp;`, `&lt;s>`, `&#91;INST]`), so an unescaped control string is
always the template's, and replacing the three escapes gives the text again.

`format_chats` returns segments: pieces of the output in order, each under the loss mask or
not. The pieces under it are the escaped texts of assistant turns, and nothing else.

One conversation is one output row, so its rows have to meet in one task; nothing else does,
and no step is more than linear in a conversation's turns.

Defined cases: a null text or role is an empty one; turns are sorted by number (nulls first),
then role, then text, so ties are settled; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's control strings.
BEGIN, END, ASK, ASKED, BETWEEN = "<s>", "</s>", "[INST]", "[/INST]", "<sep>"
CONTROLS = (BEGIN, END, ASK, ASKED, BETWEEN)
LEARNED_ROLE, ASKING_ROLE = "assistant", "user"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROLS:
        safe = control.replace("<", "&lt;", 1) if control[0] == "<" else control.replace("[", "&#91;", 1)
        out = F.replace(out, F.lit(control), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    for safe, plain in (("&#10;", "\n"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(chats: DataFrame) -> DataFrame:
    """conv_id and segments, an array of (text, loss); joined texts are the formatted chat."""
    rows = chats.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    # Where a block begins: the first turn, and any whose role differs from the one before.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    blocks = turns.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns")))
    blocks = blocks.select(
        "conv_id",
        F.zip_with(
            "begins", ends,
            lambda b, e: F.struct(
                F.get("turns", b)["role"].alias("role"),
                F.transform(F.slice("turns", b + 1, e - b), lambda t: t["text"]).alias("texts"),
            ),
        ).alias("blocks"),
    )
    asks = lambda block: block["role"] == ASKING_ROLE
    plain = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("loss")))

    def written(block: Column) -> Column:
        role = F.replace(escape(block["role"]), F.lit("\n"), F.lit("&#10;"))
        head = F.concat(F.lit(BEGIN), role, F.lit("\n"), F.when(asks(block), f"{ASK} ").otherwise(""))
        tail = F.concat(F.when(asks(block), f" {ASKED}").otherwise(""), F.lit(f"{END}\n"))
        learned = block["role"] == LEARNED_ROLE
        texts = F.flatten(F.transform(block["texts"], lambda t, i: F.array(
            F.struct(F.when(i == 0, "").otherwise(f" {BETWEEN} ").alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("text"), learned.alias("loss")),
        )))
        return F.concat(plain(head), texts, plain(tail))

    return blocks.select("conv_id", F.flatten(F.transform("blocks", written)).alias("segments"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted chat as an array of (role, text)."""
    blocks = F.split(formatted, f"{END}\n")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(BEGIN) + 1)), "\n", 1)
        body = F.substr(block, F.lit(len(BEGIN) + 2) + F.length(role))
        inner = F.substr(body, F.lit(len(ASK) + 2), F.length(body) - F.lit(len(ASK) + len(ASKED) + 2))
        texts = F.split(F.when(F.startswith(body, F.lit(f"{ASK} ")), inner).otherwise(body), f" {BETWEEN} ", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts hold control strings."""
    text = f"{END}{ASK} ok {ASKED}"
    row = lambda turn, role: spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"),
        F.lit(role).alias("role"), F.lit(text).alias("text"),
    )
    return row(0, ASKING_ROLE).union(row(1, LEARNED_ROLE))


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation what is read back from its formatted text and its loss mask."""
    made = format_chats(chats).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "").alias("learned"),
    )
    back = made.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), unescape(F.col("learned")).alias("learned"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
