"""Document fingerprints by improved consistent weighted sampling, in Spark expressions only.

The terms of a text are its words between white space, weighted by how often they occur. Each
of `SAMPLES` samples draws, for every term, r and c from Gamma(2, 1) and b from [0, 1), all
from hashes of the term, and quantises the term's weight w: t = floor(ln w / r + b). The term
with the smallest ln c - r (t - b + 1) is the sample. Two texts have the same sample with the
probability sum(min(w)) / sum(max(w)), their generalised Jaccard similarity, so the share of
equal samples estimates it; an equal smallest value means an equal term and t.

Terms and weights are found within a row (sort, then lengths of runs), so the texts are not
shuffled for them; the samples' minima are combined before they are.

A fingerprint is a hexadecimal string of `DIGITS` digits for each sample, taken from a hash of
the minimum. Texts without words share the fingerprint of zeros.

Defined cases: null texts are empty; equal texts have equal fingerprints whatever their ids;
rows are ordered by doc_id from high to low, nulls last, then by the text's hash, and the
next of the last is the first; a lone document is its own next. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulbook.session import materialize

SAMPLES = 48
DIGITS = 4
#: Samples drawn side by side. With more of them the generated code of a row, and the fields of
#: the aggregate, are beyond what the JVM compiles.
BESIDE = 8
#: The largest weight, and the bits of a term that hold it.
MOST_TIMES = (1 << 20) - 1


def _uniform(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from 21 bits."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) / float(1 << 21)


def sample_value(term: Column, log_weight: Column, sample: Column) -> Column:
    """ln of the consistent weighted sampling value of a term in one sample."""
    first, second = F.xxhash64(term, sample * 2), F.xxhash64(term, sample * 2 + 1)
    r = -F.log(_uniform(first, 0) * _uniform(first, 21))
    c = -F.log(_uniform(second, 0) * _uniform(second, 21))
    b = _uniform(first, 42)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b + 1)


def weighted_terms(text: Column) -> Column:
    """The distinct words of a text as numbers: a hash, and in the low bits the occurrences.

    Equal numbers mean an equal term and weight. A weight is at most `MOST_TIMES`.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~MOST_TIMES))))


def _runs(name: str) -> Column:
    """A sorted array of terms as weighted terms."""
    begins = F.filter(F.sequence(F.lit(1), F.size(name)), lambda i: (i == 1) | (F.get(name, i - 1) != F.get(name, i - 2)))
    return F.when(F.size(name) > 0, begins).otherwise(F.array().cast("array<int>"))


def _weighted(name: str, begins: str) -> Column:
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(name) + 1))
    times = lambda b, e: F.least((e - b).cast("long"), F.lit(MOST_TIMES))
    paired = F.zip_with(begins, ends, lambda b, e: F.get(name, b - 1) + times(b, e))
    return F.when(F.size(name) > 0, paired).otherwise(F.array().cast("array<bigint>"))


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """The keys and the fingerprints of both texts of each row of `texts` (keys, text, edited);
    null for a text without words.

    What the texts have in common, a term with the same weight, is sampled once.
    """
    rows = texts.select(*keys, weighted_terms(F.col("text")).alias("h"), weighted_terms(F.col("edited")).alias("g"))
    rows = rows.select(*keys, "h", "g", _runs("h").alias("hb"), _runs("g").alias("gb"))
    rows = rows.select(*keys, _weighted("h", "hb").alias("h"), _weighted("g", "gb").alias("g"))
    marked = lambda c, own, other: F.transform(
        c, lambda x: F.struct(x.alias("x"), F.lit(own).alias("own"), F.lit(other).alias("other"))
    )
    terms = F.concat(
        marked(F.array_intersect("h", "g"), True, True), marked(F.array_except("h", "g"), True, False), marked(F.array_except("g", "h"), False, True)
    )
    terms = rows.select(*keys, F.explode_outer(terms).alias("t"))  # a row without words stays
    times = F.col("t.x").bitwiseAND(F.lit(MOST_TIMES)).cast("double")
    terms = terms.select(*keys, "t.own", "t.other", F.col("t.x").bitwiseAND(F.lit(~MOST_TIMES)).alias("term"), F.log(times).alias("log_weight"))
    # A row for every group of samples: the same few expressions draw all of them.
    groups = F.sequence(F.lit(0), F.lit(samples - 1), F.lit(BESIDE))
    terms = terms.select(*keys, "own", "other", "term", "log_weight", F.explode(groups).alias("begin"))
    beside = range(min(BESIDE, samples))
    values = terms.select(*keys, "begin", "own", "other", *(sample_value(F.col("term"), F.col("log_weight"), F.col("begin") + k).alias(f"v{k}") for k in beside))
    least = [F.min(F.when(F.col(side), F.col(f"v{k}"))).alias(f"{side}{k}") for side in ("own", "other") for k in beside]
    minima = values.groupBy(*keys, "begin").agg(*least)

    def print_of(side: str) -> Column:
        part = lambda k: F.right(F.lpad(F.lower(F.hex(F.xxhash64(f"{side}{k}"))), 16, "0"), F.lit(DIGITS))
        return F.when(F.col(f"{side}0").isNotNull(), F.concat(*(part(k) for k in beside)))

    parts = minima.select(*keys, "begin", print_of("own").alias("own"), print_of("other").alias("other"))
    begins = range(0, samples, BESIDE)
    gathered = parts.groupBy(*keys).agg(*(
        F.max(F.when(F.col("begin") == b, F.col(side))).alias(f"{side}{b}") for side in ("own", "other") for b in begins
    ))
    whole = lambda side: F.left(F.concat(*(F.col(f"{side}{b}") for b in begins)), F.lit(samples * DIGITS))
    return gathered.select(*keys, whole("own").alias("fingerprint"), whole("other").alias("edited_fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = [(F.substring(a, k * DIGITS + 1, DIGITS) == F.substring(b, k * DIGITS + 1, DIGITS)).cast("int") for k in range(samples)]
    return reduce(lambda x, y: x + y, equal) / float(samples)


KEYS = ["id", "k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with what tells a row from others: `id` (never null) and the text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(number, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
        number.alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Keys, doc_id and n_chars of all rows, with the keys of the next row.

    Rows are range-partitioned by id and looked at within their partition; only the first
    row of each partition goes into a window over all.
    """
    falling = [F.col("id").desc(), F.col("k1"), F.col("k2")]
    small = rows.select(*KEYS, "doc_id", "n_chars").repartitionByRange(*falling)
    small = materialize(small.withColumn("part", F.spark_partition_id()), "fingerprint-order")
    within, parts = Window.partitionBy("part").orderBy(*falling), Window.orderBy("part")
    me = F.struct(*KEYS)
    small = small.withColumn("nth", F.row_number().over(within)).withColumn("following", F.lead(me).over(within))
    heads = small.where("nth = 1").select("part", me.alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    small = small.join(heads, "part").withColumn("next", F.coalesce("following", "after"))
    return small.select(*KEYS, "doc_id", "n_chars", *(F.col(f"next.{k}").alias(f"next_{k}") for k in KEYS))


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and its likeness to that and to the
    next row's."""
    rows = keyed(docs)
    order = materialize(in_order(rows), "fingerprint-next")
    texts = rows.select(*KEYS, "text").dropDuplicates(KEYS)
    next_keys = [f"next_{k}" for k in KEYS]
    pairs = order.select(*KEYS, *next_keys, "n_chars").distinct()
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # Only as much of the next text as is wanted goes to the row that wants it.
    lent = pairs.join(texts.select(*(F.col(k).alias(f"next_{k}") for k in KEYS), F.col("text").alias("next_text")), next_keys)
    lent = lent.select(*KEYS, *next_keys, third.alias("third"), F.substring(F.col("next_text"), F.lit(1), third).alias("lent"))
    edited = lent.join(texts, KEYS).select(
        *KEYS, *next_keys, "text",
        F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("third")), "lent").alias("edited"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = materialize(fingerprints(edited, [*KEYS, *next_keys, "edited_sha256"], samples), "fingerprints")
    blank = F.lit("0" * samples * DIGITS)
    of_next = prints.select(*(F.col(k).alias(n) for k, n in zip(KEYS, next_keys)), F.col("fingerprint").alias("next_fingerprint"))
    of_next = of_next.groupBy(*next_keys).agg(F.max("next_fingerprint").alias("next_fingerprint"))
    joined = order.join(prints, [*KEYS, *next_keys]).join(of_next, next_keys)
    filled = joined.select(
        "doc_id", "n_chars", "edited_sha256",
        *(F.coalesce(c, blank).alias(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")),
    )
    return filled.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
