"""Batch name search over a gram index, without comparing every term to every name.

A term is reduced to its longest stretch free of wildcards and to the grams (pieces of
up to three characters) of it. A name that matches must hold all of them, so the names under
the rarest one are all that can match; the pattern then decides. Terms that share no gram
of their own (`%`, blank) look up the empty gram, which every name holds.

With many terms a gram is too short to meet names by: thousands of terms have it and a share of
all names, and the pairs grow with the product of both. So terms of three characters and more
meet names by a longer piece around their rarest gram, of the longest of `PIECES` that fits.
All is equi-joins, and Spark splits a piece that is in most names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.cleaning import col, strip

GRAM = 3
#: Lengths of the pieces that terms and names meet by. A name is cut into those of the lengths
#: that the terms have, so its pieces are a few for every letter.
PIECES = (GRAM, 4, 5, 6, 8)


def grams(text: Column | str, size: Column | int = GRAM) -> Column:
    """Distinct lower-case pieces of `size` characters; none for shorter text."""
    low, size = F.lower(col(text)), size if isinstance(size, Column) else F.lit(size)
    n = F.length(low) - (size - 1)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # Bound by a transform of its own, or it would be made lower-case again for every piece.
    pieces = F.transform(F.array(low), lambda x: F.transform(starts, lambda i: F.substr(x, i, size)))[0]
    return F.array_distinct(pieces)


def _name_grams(size: Column | int = GRAM) -> Column:
    """Grams of both names; of size 0 that is the empty text for whoever has a name."""
    if isinstance(size, int) and size == 0:
        named = F.col("legal_name").isNotNull() | F.col("dba_name").isNotNull()
        return F.when(named, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    both = [grams(F.coalesce(F.col(n), F.lit("")), size) for n in ("legal_name", "dba_name")]
    return F.concat(*both)


def gram_index(carriers: DataFrame, *keep: str) -> DataFrame:
    """Postings (gram, usdot_number) of both names, to be stored sorted by gram."""
    return carriers.select("usdot_number", *keep, F.explode(F.array_distinct(_name_grams())).alias("gram"))


def indexed_search(carriers: DataFrame, index: DataFrame, q: str) -> DataFrame:
    """Search one term by the stored index: the same hits as a full scan.

    Terms the index cannot serve (digits, wildcards, fewer than three characters) scan.
    """
    from haulbook.operators.directory import search

    term = q.strip()
    low = term.lower()
    if term.isdigit() or len(low) < GRAM or any(ch in term for ch in "%_\\"):
        return search(carriers, q)
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    holders = (
        index.where(F.col("gram").isin(*wanted))
        .groupBy("usdot_number")
        .agg(F.count_distinct("gram").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return search(carriers.join(holders.select("usdot_number"), "usdot_number", "left_semi"), q)


def _longest_literal(low: Column) -> Column:
    """Longest stretch of a term between wildcards."""
    parts = F.split(low, "[%_]+")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return longest["p"]


def _matches(name: str) -> Column:
    """Does the name contain term `t`? A pattern is built only for terms with wildcards."""
    escaped = F.replace(F.col("t"), F.lit("\\"), F.lit("\\\\"))
    pattern = F.ilike(F.col(name), F.concat(F.lit("%"), escaped, F.lit("%")))
    plain = F.contains(F.lower(name), F.lower("t"))
    return F.when(F.col("t").rlike("[%_]"), pattern).otherwise(plain)


def _candidates(carriers: DataFrame, *sizes: int) -> DataFrame:
    """Names under each of their distinct grams of the given sizes."""
    held = F.array_distinct(F.concat(*[_name_grams(s) for s in sizes]))
    return carriers.select("usdot_number", "legal_name", "dba_name", F.explode(held).alias("gram"))


def _around(piece: str, gram: str) -> Column:
    """The stretch of a piece, as long as the longest of `PIECES` that fits, with the gram in its middle."""
    n = F.length(piece)
    size = F.lit(PIECES[0])
    for longer in PIECES[1:]:
        size = F.when(n >= longer, longer).otherwise(size)
    start = F.position(F.col(gram), F.col(piece)) - F.floor((size - GRAM) / 2).cast("int")
    return F.substr(F.col(piece), F.greatest(F.lit(1), F.least(start, n - size + 1)), size)


def _pieces(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(usdot_number, gram) of the pieces of both names, of the lengths that the wanted ones have."""
    lengths = wanted.select(F.length("gram").alias("length")).distinct()
    sized = names.withColumn("length", F.explode(F.array(*map(F.lit, PIECES))))
    # A row per length at most.
    sized = sized.join(F.broadcast(lengths), "length", "left_semi")
    return sized.select("usdot_number", F.explode(F.array_distinct(_name_grams(F.col("length")))).alias("gram"))


def batch_search(carriers: DataFrame, terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """`terms(term_id, term)` against the directory: (term_id, term, usdot_number).

    With a stored `index` (gram, usdot_number) the carriers under the terms' rarest grams are looked
    up there, and no other names are taken apart. Postings and pieces are many times the file
    they come from, which is all that Spark's estimate knows of: they are joined by sorting and
    never gathered for a broadcast.
    """
    cleaned = terms.select("term_id", "term", strip("term").alias("t"))
    is_number = F.col("t").rlike("^[0-9]+$")

    answers = carriers.select(
        "usdot_number",
        F.explode(F.array_distinct(F.array("usdot_number", "mc_number"))).alias("t"),
    )
    by_number = cleaned.where(is_number).join(answers, "t")

    texts = cleaned.where(~is_number).withColumn("piece", _longest_literal(F.lower("t")))
    long_enough = F.length("piece") >= GRAM

    long_terms = texts.where(long_enough)
    piece_grams = long_terms.select("piece").distinct().select("piece", F.explode(grams("piece")).alias("gram"))
    used = piece_grams.select("gram").distinct()
    postings = gram_index(carriers) if index is None else index
    holders = (
        postings.join(used, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    )
    # A gram nobody holds counts 0: its term matches nothing, and is not looked up.
    rarest = (
        piece_grams.join(holders, "gram", "left")
        .groupBy("piece")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        .where("r.n > 0")
        .select("piece", F.col("r.gram").alias("rare"), _around("piece", "r.gram").alias("gram"))
    )
    names = carriers.select("usdot_number", "legal_name", "dba_name")
    reached = names
    if index is not None:
        under = index.join(rarest.select(F.col("rare").alias("gram")).distinct(), "gram", "left_semi").select("usdot_number").distinct()
        reached = names.join(under.hint("merge"), "usdot_number", "left_semi")
    met = rarest.select("piece", "gram").join(_pieces(reached, rarest).hint("merge"), "gram").select("piece", "usdot_number")
    by_gram = (
        long_terms.select("term_id", "term", "t", "piece").join(met.hint("merge"), "piece")
        .join(names.hint("merge"), "usdot_number")
    )

    # Shorter pieces are grams themselves. Without such terms this branch stays empty,
    # and adaptive execution drops it.
    short_terms = texts.where(~long_enough).withColumnRenamed("piece", "gram")
    by_piece = short_terms.join(_candidates(carriers, 0, 1, 2), "gram")

    hit = _matches("legal_name") | _matches("dba_name")
    out = [by_number] + [found.where(F.coalesce(hit, F.lit(False))) for found in (by_gram, by_piece)]
    columns = ("term_id", "term", "usdot_number")
    return out[0].select(*columns).unionByName(out[1].select(*columns)).unionByName(out[2].select(*columns))
