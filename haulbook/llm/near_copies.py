"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its overlapping `WORDS`-word shingles, split at white space; equal
shingles are told apart by their occurrence number. A sketch takes the shingles with the
smallest values under its own hash and keeps them *in text order*; texts meet in a bucket
when a sketch of theirs is equal. What meets twice is verified by a banded alignment of the two
shingle sequences: with m shingles matched in order, the similarity is m / (n_a + n_b - m),
which equals the Jaccard similarity of the shingles unless something was moved about.

Buckets never emit all their pairs. Each links its members to one of them (first within a
task, then between tasks); star links that come up twice are verified and joined to classes.
Three or more texts that met in buckets and are still in different classes might be linked
otherwise. They are compared further, but only where a bound allows it (`candidates`): within such a
cluster texts are paired by shingles that at most `RARE` texts hold, the others by how they differ
from what most texts of the cluster hold. So the links found do not depend on which member a
bucket chose, and no cluster is compared pair by pair.

Exact copies are folded before anything else and never verified.

Tables with a row per text, link or element grow with the data. They are joined by sorting (the
hint `merge`), whatever their files' packed size: built for a broadcast they take ten times that
in the driver. Tables with a row per group are left to Spark.

Defined cases: a null text is an empty one; texts without words are copies of each other;
fewer than `WORDS` words make one shingle; repeated rows and rows with the same id are
documents like others; the class id is the smallest doc_id of the class (null if all are
null). An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks
from haulbook.llm.components import components, components_of_both, contracted
from haulbook.session import free_driver, materialize

WORDS = 5
SIMILARITY = 0.8
#: Sketches of a text, shingles in each, and equal sketches that two texts must have. Texts of
#: similarity 0.8 have fewer than 2 equal ones of 48 with 6 shingles in 9 of a million cases.
SKETCHES, LONG_SKETCH, MEETINGS = 48, 6, 2
#: Texts of few shingles have sketches of 2; those between the two bounds have both, so
#: similar texts, whose numbers of shingles differ by a fifth at most, always share a kind.
SHORT_SKETCH, SHORT_BELOW, LONG_FROM = 2, 48, 36
RARE = 24

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return (x ^ (x >> np.uint64(29))) * _P


class Shingler:
    """Hashes of a text's shingles, in order."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for t in {*tokens}.difference(known):
            known[t] = xxhash.xxh64_intdigest(t)
        hashes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        if not len(hashes):
            return hashes
        n = max(len(hashes) - self.words + 1, 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(self.words, len(hashes))):
            out = out * _P + _mix(hashes[i:i + n] + np.uint64(i))
        return _mix(out + np.uint64(min(self.words, len(hashes))))


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """The hashes with their occurrence number worked in."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(new)
    if len(heads) == len(shingles):
        return shingles
    nth = np.empty(len(shingles), dtype=np.uint64)
    nth[order] = np.arange(len(shingles)) - np.repeat(heads, np.diff(np.append(heads, len(shingles))))
    return np.where(nth > 0, _mix(shingles + nth * _Q), shingles)


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None], (rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1))[:, None]


def order_sketches(shingles: np.ndarray, size: int, n: int = SKETCHES, seed: int = 7) -> np.ndarray:
    """n hashes, each of the `size` smallest shingles under one hash, in text order."""
    labelled = occurrences(shingles)
    masks, factors = _family(n, seed + size)
    size = min(size, len(labelled))
    if size == len(labelled):
        places = np.broadcast_to(np.arange(size), (n, size))
    else:
        places = np.sort(np.argpartition((labelled ^ masks) * factors, size, axis=1)[:, :size], axis=1)
    out = np.arange(n, dtype=np.uint64) + np.uint64(size * 1000)
    for chosen in labelled[places].T:
        out = _mix(out * _P + chosen)
    return out


def signature(shingles: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    if not len(shingles):
        return np.zeros(1, dtype=np.uint64)
    kinds = []
    if len(shingles) < SHORT_BELOW:
        kinds.append(order_sketches(shingles, SHORT_SKETCH, sketches))
    if len(shingles) >= LONG_FROM:
        kinds.append(order_sketches(shingles, LONG_SKETCH, sketches))
    return np.concatenate(kinds)


def banded_matches(a: np.ndarray, b: np.ndarray, most_unmatched: int) -> int:
    """Length of the longest common subsequence found within the band of that half-width.

    It is exact if at most `most_unmatched` entries of both together stay unmatched. The
    columns of the band are bits of an integer; a row is a few integer operations.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    band = max(most_unmatched, 1)
    columns: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        columns.setdefault(x, []).append(i)
    rows = b.tolist()
    state = (1 << len(a)) - 1
    step = max(band, 256)
    for top in range(0, len(rows), step):
        block = rows[top:top + step]
        low, high = max(top - band, 0), min(top + step + band, len(a))
        if high <= low:
            continue
        full = (1 << (high - low)) - 1
        window = (state >> low) & full
        masks: dict[int, int] = {}
        for x in block:
            mask = masks.get(x)
            if mask is None:
                mask = 0
                for i in columns.get(x, ()):
                    if low <= i < high:
                        mask |= 1 << (i - low)
                masks[x] = mask
            if mask:
                hit = window & mask
                window = ((window + hit) | (window - hit)) & full
        state = (state & ~(full << low)) | (window << low)
    return head + tail + len(a) - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched shingles to all, 0 where it is certainly below `least`."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return 0.0
    matched = banded_matches(a, b, total - 2 * needed)
    return matched / (total - matched) if matched >= needed else 0.0


TEXT = "k1 long, k2 long, doc_id long, n int, sketches array<bigint>"


def _sketch(words: int, sketches: int):
    def work(batches):
        shingler = Shingler(words)
        for batch in chunks(batches, "text"):
            n, out = [], []
            for text in batch.column("text").to_pylist():
                shingles = shingler(text)
                n.append(len(shingles))
                out.append(signature(shingles, sketches).view(np.int64))
            yield {"k1": batch.column("k1"), "k2": batch.column("k2"), "doc_id": batch.column("doc_id"), "n": n, "sketches": out}

    return work


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, and 128 bits that stand for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
    )


STAR = "bucket long, tid long, n int, mate long, mate_n int"


def _local_stars(batches):
    """Of a bucket's members in this task, links all to the first and sends on only that."""
    for batch in batches:
        sketches = batch.column("sketches")
        held = np.diff(sketches.offsets.to_numpy())
        bucket = sketches.flatten().to_numpy()
        tid, n = (np.repeat(batch.column(c).to_numpy(), held) for c in ("tid", "n"))
        order = np.lexsort((tid, bucket))
        bucket, tid, n = bucket[order], tid[order], n[order]
        new = np.ones(len(bucket), dtype=bool)
        new[1:] = bucket[1:] != bucket[:-1]
        heads = np.flatnonzero(new)
        first = heads[np.cumsum(new) - 1] if len(heads) else heads
        mate = np.where(new, np.int64(-1), tid[first])
        # Links pass through in any partition.
        yield {"bucket": np.where(new, bucket, tid), "tid": tid, "n": n, "mate": mate, "mate_n": n[first]}


def _stars(batches):
    """Links the members of a bucket, which stand together, to the first of them."""
    last_bucket, last_tid, last_n = None, -1, 0
    for batch in batches:
        bucket, tid, n, mate, mate_n = (batch.column(c).to_numpy() for c in ("bucket", "tid", "n", "mate", "mate_n"))
        passed = mate >= 0
        links = [(tid[passed], n[passed], mate[passed], mate_n[passed])]
        bucket, tid, n = bucket[~passed], tid[~passed], n[~passed]
        if len(bucket):
            new = np.ones(len(bucket), dtype=bool)
            new[1:] = bucket[1:] != bucket[:-1]
            new[0] = bucket[0] != last_bucket
            heads = np.flatnonzero(new)
            group = np.cumsum(new)
            first = np.concatenate([[last_tid], tid[heads]])
            first_n = np.concatenate([[last_n], n[heads]])
            links.append((tid[~new], n[~new], first[group[~new]], first_n[group[~new]]))
            last_bucket, last_tid, last_n = bucket[-1], first[group[-1]], first_n[group[-1]]
        yield {c: np.concatenate([x[i] for x in links]) for i, c in enumerate(("a", "n_a", "b", "n_b"))}


def _verify(words: int, least: float):
    def work(batches):
        shingler, last, right = Shingler(words), None, None
        for batch in chunks(batches, "text_a"):
            a, b, text_a, text_b = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep_a, keep_b, score = [], [], []
            for i, j, x, y in zip(a, b, text_a, text_b):
                if j != last:
                    last, right = j, shingler(y)
                s = similarity(shingler(x), right, least)
                if s >= least:
                    keep_a.append(i)
                    keep_b.append(j)
                    score.append(s)
            yield {"a": keep_a, "b": keep_b, "similarity": score}

    return work


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; texts: tid, text."""
    # Sorted by b, which is the same for all members of a bucket.
    left = pairs.hint("merge").join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.hint("merge").join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
    return arrow_map(both.select("a", "b", "text_a", "text_b"), _verify(words, least), "a long, b long, similarity double")


def _spread(words: int):
    def work(batches):
        shingler = Shingler(words)
        for batch in chunks(batches, "text"):
            shingles = [occurrences(s) if len(s) else s for s in map(shingler, batch.column("text").to_pylist())]
            n = [len(s) for s in shingles]
            for i in range(0, len(n), 200):
                part, sizes = slice(i, i + 200), n[i:i + 200]
                yield {
                    **{c: np.repeat(batch.column(c).to_numpy()[part], sizes) for c in ("cluster", "class", "tid")},
                    "n": np.repeat(sizes, sizes), "shingle": np.concatenate(shingles[part]).view(np.int64),
                }

    return work


#: Bits of a shingle's hash that stay beside the class of its rarity.
_HASH_BITS = 57


def _level(state: DataFrame, rare: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of `candidates`: pairs that share a rare element, the members of each group
    after the step, and their next groups.

    Per group g and text, `els` are elements and f and low are numbers: two texts may be
    similar if they share at least f_a + f_b elements, which is never less than low_a or low_b.
    """
    sizes = state.groupBy("g").agg(F.count("*").alias("members"), F.min("f").alias("f_min"))
    rows = state.select("g", "tid", F.explode("els").alias("el"))
    held = rows.groupBy("g", "el").agg(F.count("*").alias("holders")).where("holders > 1").join(sizes.drop("f_min"), "g")
    kind = F.when(F.col("holders") <= rare, "rare").when(2 * F.col("holders") > F.col("members"), "base").otherwise("mid")
    held = held.withColumn("kind", kind)
    # How many texts have it after the step: those without it where most have it.
    has = F.when(F.col("kind") == "base", F.col("members") - F.col("holders")).otherwise(F.col("holders"))
    rarity = F.floor(F.log2(F.greatest(has, F.lit(1)))).cast("long")
    held = held.select(
        "g", "el", "kind", has.alias("has"),
        F.shiftleft(rarity, _HASH_BITS).bitwiseOR(F.col("el").bitwiseAND((1 << _HASH_BITS) - 1)).alias("id"),
    )
    held = materialize(held, "near-held")
    ids = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(k) for k in ("rare", "base", "mid")}
    lists = rows.join(held.hint("merge"), ["g", "el"]).groupBy("g", "tid").agg(*ids.values())
    texts = state.drop("els").join(lists.hint("merge"), ["g", "tid"]).join(sizes.select("g", "f_min"), "g")
    usable = F.size("rare") + F.size("base") + F.size("mid")
    texts = texts.withColumn("usable", usable).withColumn("least_shared", _least_shared("low", "f", "f_min"))
    texts = materialize(texts.where("usable >= least_shared"), "near-lists")

    # In the order rare, then others, the first element that two similar texts share comes this early.
    early = texts.withColumn("id", F.explode(F.slice("rare", F.lit(1), F.col("usable") - F.col("least_shared") + 1)))
    early = early.select("g", "id", "tid", "class", "n", "f", F.size("rare").alias("r"), (F.col("usable") - F.size("rare")).alias("c"))
    x, y = early.alias("x"), early.alias("y").hint("merge")
    by_rare = x.join(
        y,
        (F.col("x.g") == F.col("y.g")) & (F.col("x.id") == F.col("y.id"))
        & (F.col("x.tid") > F.col("y.tid")) & (F.col("x.class") != F.col("y.class"))
        & (F.least("x.r", "y.r") + F.least("x.c", "y.c") + 1e-6 >= F.col("x.f") + F.col("y.f")),
    ).select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b"))

    # What is left shares no rare element. Count from what most of the group hold.
    base = held.where("kind = 'base'").groupBy("g").agg(
        F.count("*").alias("of_base"), F.collect_list(F.when(F.col("has") > 1, F.col("id"))).alias("all_base")
    )
    moved = texts.join(base, "g", "left")
    of_base, empty = F.coalesce("of_base", F.lit(0)), F.array().cast("array<bigint>")
    rest = F.array_sort(F.concat(F.array_except(F.coalesce("all_base", empty), "base"), "mid"))
    moved = moved.select(
        "g", "tid", "class", "n", (F.col("f") + of_base / 2 - F.size("base")).alias("f"),
        (F.col("low") - F.size("base")).alias("low"), rest.alias("els"),
    )
    moved = materialize(moved, "near-moved")
    lowest = moved.groupBy("g").agg(F.min("f").alias("f_min"))
    going = moved.join(lowest, "g").withColumn("least_shared", _least_shared("low", "f", "f_min")).where(F.size("els") >= F.col("least_shared"))
    first = F.slice("els", F.lit(1), F.size("els") - F.col("least_shared") + 1)
    going = going.select("g", "tid", "class", "n", "f", "low", "els", F.posexplode(first).alias("at", "el"))
    going = going.select(
        F.xxhash64("g", "el").alias("g"), "tid", "class", "n", "f", "low",
        F.slice("els", F.col("at") + 1, F.size("els")).alias("els"),
    )
    going = materialize(going, "near-groups")
    open_groups = going.groupBy("g").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("g")
    return by_rare, moved.select("g", "tid", "class", "f"), going.join(open_groups, "g", "left_semi")


def _least_shared(low: str, f: str, f_min: str):
    return F.ceil(F.greatest(F.lit(1.0), F.col(low) - 1e-6, F.col(f) + F.col(f_min) - 1e-6)).cast("int")


def candidates(open_texts: DataFrame, words: int, least: float, rare: int = RARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of one cluster and different classes that may be similar enough, stars
    (g, a, b) and the members (g, tid, class, f) that the stars stand for.

    With m shingles in common, m / (n_a + n_b - m) >= least means m >= share * (n_a + n_b),
    and so m >= least * n of either. Texts that hold a rare shingle in common are paired. Of the
    others, all that matters is how they differ from the shingles that most of their group hold
    (the base): with b of its B shingles held by a text, two texts share
    b_a + b_b - B shingles, and more only where they lack the same shingle or hold the same one
    that is neither rare nor in the base. So
    * if b_a + b_b - B is enough, both are also similar to the text of the group that is nearest
      the base, and a star of links to that one stands for all such pairs;
    * otherwise the two must share differences. They are grouped by the differences that come
      first in order of rarity, so many that none can be missed, and the groups are treated alike.
    A difference is one of half the texts of its group at most, so groups shrink until all
    their elements are rare. No step pairs the members of a group with each other.
    """
    share = least / (1 + least)
    spread = arrow_map(open_texts, _spread(words), "cluster long, class long, tid long, n int, shingle long")
    state = spread.groupBy("cluster", "tid", "class", "n").agg(F.collect_list("shingle").alias("els"))
    state = state.select(
        F.col("cluster").alias("g"), "tid", "class", "n", (F.col("n") * share).alias("f"),
        (F.col("n") * least).alias("low"), "els",
    )
    state = materialize(state, "near-groups")
    pairs, members = [], []
    while True:
        by_rare, group, state = _level(state, rare)
        pairs.append(materialize(by_rare.distinct(), "near-pairs"))
        members.append(group)
        free_driver(open_texts.sparkSession)
        if state.isEmpty():
            break
    pairs, members = (reduce(DataFrame.union, x) for x in (pairs, members))
    nearest = members.groupBy("g").agg(F.min(F.struct("f", "tid", "class")).alias("head"))
    stars = members.join(nearest, "g").where("f + head.f <= 1e-6 and class <> head.class")
    stars = materialize(stars.select("g", F.col("tid").alias("a"), F.col("head.tid").alias("b")), "near-stars")
    return pairs.distinct(), stars, members


def further_pairs(open_texts: DataFrame, words: int, least: float, rare: int = RARE) -> DataFrame:
    """The pairs of `candidates`, the larger number first."""
    pairs, stars, _ = candidates(open_texts, words, least, rare)
    return pairs.union(stars.select(F.greatest("a", "b"), F.least("a", "b"))).distinct()


def beside_stars(stars: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of the texts whose star link the alignment refused, as blocks in them are moved
    about. Nothing follows for them from the star, so they meet the other members."""
    either = links.select("a", "b").union(links.select("b", "a"))
    refused = stars.join(either.hint("merge"), ["a", "b"], "left_anti").select("g", F.col("a").alias("tid")).distinct()
    x, y = members.join(refused.hint("merge"), ["g", "tid"]).alias("x"), members.alias("y").hint("merge")
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.class") != F.col("y.class")) & (F.col("x.f") + F.col("y.f") <= 1e-6))
    return met.select(F.greatest("x.tid", "y.tid").alias("a"), F.least("x.tid", "y.tid").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, sketches: int = SKETCHES, rare: int = RARE) -> DataFrame:
    """Per row: doc_id, k1, k2 (the text's key), class_id, and first: whether the row is the
    first of its class by id and text (equal rows all are)."""
    spark, keyed = docs.sparkSession, with_key(docs)
    sketched = arrow_map(keyed.select("k1", "k2", "doc_id", "text"), _sketch(words, sketches), TEXT)
    texts = sketched.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    texts = materialize(texts.withColumn("tid", F.monotonically_increasing_id()), "near-texts")

    stars = arrow_map(texts.select("tid", "n", "sketches"), _local_stars, STAR)
    stars = stars.repartition("bucket").sortWithinPartitions("bucket", "tid")
    met = arrow_map(stars, _stars, "a long, n_a int, b long, n_b int")
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("times"))
    often = (F.col("times") >= MEETINGS) | (F.col("n_a") + F.col("n_b") == 0)
    alike = (F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))
    met = met.select("a", "b", (often & alike).alias("may"))
    met = materialize(met, "near-met")
    asked = met.select(F.col("a").alias("tid")).union(met.select("b")).distinct()
    asked = texts.select("tid", "k1", "k2", "first_doc").join(asked.hint("merge"), "tid")
    # One row of each text: that of its first document, and of equal rows one.
    k, t = keyed.alias("k"), asked.alias("t").hint("merge")
    wanted = k.join(t, (F.col("k.k1") == F.col("t.k1")) & (F.col("k.k2") == F.col("t.k2")) & F.col("k.doc_id").eqNullSafe(F.col("t.first_doc")))
    wanted = materialize(wanted.select("tid", "text").dropDuplicates(["tid"]), "near-wanted")

    links = materialize(verified(met.where("may").select("a", "b"), wanted, words, least), "near-links")
    free_driver(spark)
    classes, clusters = components_of_both(links.select("a", "b"), contracted(met.select("a", "b")))
    placed = (
        clusters.withColumnRenamed("root", "cluster")
        .join(classes.withColumnRenamed("root", "class").hint("merge"), "node", "left")
        .select(F.col("node").alias("tid"), "cluster", F.coalesce("class", "node").alias("class"))
    )
    placed = materialize(placed, "near-placed")
    # In a cluster of two all meetings are of the one pair, so it has been looked at.
    still = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high"))
    still = still.where("members > 2 and low <> high").select("cluster")
    if still.isEmpty():
        final = classes
    else:
        open_texts = placed.join(still, "cluster").hint("merge").join(wanted, "tid").select("cluster", "class", "tid", "text")
        pairs, stars, members = candidates(open_texts, words, least, rare)
        seen = met.where("may").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).hint("merge")
        more = pairs.union(stars.select(F.greatest("a", "b"), F.least("a", "b"))).distinct().join(seen, ["a", "b"], "left_anti")
        found = materialize(verified(more, wanted, words, least), "near-links-more")
        added = found
        beside = materialize(beside_stars(stars, members, links.union(found)), "near-beside")
        if not beside.isEmpty():
            beside = beside.join(seen, ["a", "b"], "left_anti").join(more.hint("merge"), ["a", "b"], "left_anti")
            added = added.union(materialize(verified(beside, wanted, words, least), "near-links-beside"))
        # The classes stand for the links they come from.
        final = components(classes.toDF("a", "b").union(added.select("a", "b")))
    grouped = (
        texts.select("tid", "k1", "k2", "first_doc")
        .join(final.withColumnRenamed("node", "tid").hint("merge"), "tid", "left")
        .withColumn("root", F.coalesce("root", "tid"))
    )
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "k1", "k2")
    ids = grouped.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.min(order).alias("head"))
    named = grouped.join(ids.hint("merge"), "root").select("k1", "k2", "class_id", F.when(order == F.col("head"), F.struct("first_doc")).alias("head"))
    rows = keyed.select("doc_id", "k1", "k2").join(named.hint("merge"), ["k1", "k2"])
    first = F.col("head").isNotNull() & F.col("doc_id").eqNullSafe(F.col("head.first_doc"))
    return rows.select("doc_id", "k1", "k2", "class_id", first.alias("first"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id and class_id."""
    return near_copies(docs, **options).select("doc_id", "class_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all columns: the one of the smallest id."""
    firsts = near_copies(docs, **options).where("first")
    firsts = materialize(firsts.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("rows")), "near-firsts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
    ).alias("d")
    f = firsts.alias("f").hint("merge")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.k1") == F.col("f.k1")) & (F.col("d.k2") == F.col("f.k2"))
    kept = rows.join(f, same).select("d.doc_id", "d.k1", "d.k2", "row", "rows")
    if not firsts.where("rows > 1").isEmpty():  # equal rows: one of them
        kept = kept.dropDuplicates(["doc_id", "k1", "k2"])
    return kept.select("row.*")
