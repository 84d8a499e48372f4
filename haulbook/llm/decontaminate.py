"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores postings of the training documents: documents are cut into blocks, and
each block keeps its words in order and, for each, the sorted list of its token positions.
Blocks are rows of a Parquet table in the shared folder, so the index is spread like the
documents and no list grows beyond its block, however frequent its word. It does not depend
on a test set: `judge` looks any of them up without reading the documents again.

`match` looks windows up in each block. A window starts from its rarest term there; each
position in that term's list, moved by the term's offset, is a candidate start, and the
candidates are intersected with the moved lists of the other terms, rarest first. What
survives is an exact phrase. `proximity` works on the same lists and asks for all of a
window's rarest terms within a span of tokens instead.

The test set stays a table. Tasks cut it into parts of at most `MOST_TEST_WORDS` words; one part
at a time is broadcast and looked up in the stored index, and what the parts found of a
document is put together by its place in the index.

Defined cases: null or wordless texts have no words, no hits and no items; an item without
words has no windows; items with the same id count once, and a null id is written as an
empty string; repeated documents are judged row by row; empty tables give empty results or
clean documents. Columns besides doc_id, text, item_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks
from haulbook.session import fresh_dir, materialize

WINDOW = 13
#: A document is contaminated when its hit words are at least one in so many.
ONE_IN = 20
MOST_TEST_WORDS = 2_000_000
#: Words of an item that stay together; longer items are cut, with overlaps so that no window is lost.
PIECE_WORDS = 10_000
#: Bytes of a text whose words are held as objects at a time.
SPLIT_BYTES = 1 << 18
#: Words of a proximity query, and the tokens they must lie within.
NEAR_TERMS, NEAR_SPAN = 6, 39

#: ASCII letters and digits and all bytes of other characters make words; the rest separates.
_FOLD = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(128)).lower() + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class TestSet:
    """The windows of the test items as rows of term numbers."""

    def __init__(self, items: list[tuple], width: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set] = {}
        for item, text in items:
            held = [self.terms.setdefault(w, len(self.terms) + 1) for w in words(text)]
            for i in range(max(len(held) - width, 0) + 1 if held else 0):
                seen.setdefault(tuple(held[i:i + width]), set()).add(item)
        self.windows = np.zeros((len(seen), width), dtype=np.int64)
        for row, window in zip(self.windows, seen):
            row[:len(window)] = window
        self.lengths = np.array([len(w) for w in seen], dtype=np.int64)
        self.items = list(seen.values())


def _pieces(most: int):
    """Cuts items into pieces and numbers the parts that they fill, each task its own."""

    def work(batches):
        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in chunks(batches, "item_text"):
            out = {"part": [], "item_id": [], "piece": []}
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist()):
                held_words = words(text)
                for i in range(0, max(len(held_words) - WINDOW, 0) + 1 if held_words else 0, PIECE_WORDS - WINDOW + 1):
                    piece = held_words[i:i + PIECE_WORDS]
                    if held and held + len(piece) > most:
                        part, held = part + 1, 0
                    held += len(piece)
                    out["part"].append(part)
                    out["item_id"].append("" if item is None else str(item))
                    out["piece"].append(b" ".join(piece).decode())
            yield out

    return work


def parts(bench: DataFrame, most: int = MOST_TEST_WORDS) -> Iterator[list[tuple]]:
    """The items in parts of at most `most` words, or one piece; the driver holds one at a time."""
    items = bench.select("item_id", F.col("text").alias("item_text"))
    pieces = materialize(arrow_map(items, _pieces(most), "part long, item_id string, piece string"), "test-pieces")
    numbers = sorted(r.part for r in pieces.select("part").distinct().collect())
    for number in numbers:
        yield [(r.item_id, r.piece) for r in pieces.where(F.col("part") == number).collect()]
    if not numbers:
        yield []


INDEX = (
    "block long, doc_ids array<bigint>, k1 array<bigint>, k2 array<bigint>, n_words array<int>, words binary, counts array<int>, positions binary"
)


def _numbered(text: str, rank: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers, new ones entered; a long text is split bit by bit."""
    raw, found, start = text.encode().translate(_FOLD), [np.zeros(0, dtype=np.int32)], 0
    while start < len(raw):
        end = raw.find(b" ", start + SPLIT_BYTES)
        end = len(raw) if end < 0 else end
        held = raw[start:end].split()
        for w in {*held}.difference(rank):
            rank[w] = len(rank)
        found.append(np.fromiter(map(rank.__getitem__, held), dtype=np.int32, count=len(held)))
        start = end
    return np.concatenate(found)


def _index(batches):
    block = TaskContext.get().partitionId() << 32
    for batch in chunks(batches, "text"):
        rank: dict[bytes, int] = {}
        numbered = [_numbered(t, rank) for t in batch.column("text").to_pylist()]
        n = np.array([len(x) for x in numbered], dtype=np.int64)
        # Documents follow each other in one numbering, with a gap that no window crosses.
        places = (np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)).astype(np.uint32)
        ordered = sorted(rank)
        in_order = np.empty(len(rank), dtype=np.int32)
        in_order[[rank[w] for w in ordered]] = np.arange(len(rank))
        numbers = in_order[np.concatenate(numbered)]
        yield {
            "block": [block],
            **{f: [batch.column(c).to_pylist()] for f, c in (("doc_ids", "doc_id"), ("k1", "k1"), ("k2", "k2"))}, "n_words": [n.tolist()],
            "words": [b" ".join(ordered)], "counts": [np.bincount(numbers, minlength=len(ordered)).tolist()],
            "positions": [places[np.argsort(numbers, kind="stable")].tobytes()],
        }
        block += 1


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores the postings of all words of the documents; returns the table of blocks."""
    path = path or fresh_dir(docs.sparkSession, "postings")
    plain = text_keys(docs).select("doc_id", "k1", "k2", F.coalesce("text", F.lit("")).alias("text"))
    arrow_map(plain, _index, INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def text_keys(docs: DataFrame) -> DataFrame:
    """`docs` with its id as a long and, as k1 and k2, 128 bits that stand for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
    )


class Block:
    """One block's lists of some terms, with all of them in one sorted array of (term, position)."""

    def __init__(self, row: dict, numbers: dict[bytes, int]):
        """numbers: the terms that are asked for."""
        self.n_words = np.asarray(row["n_words"], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        self.span = int(self.starts[-1]) + 64
        found = sorted((numbers[w], i) for i, w in enumerate(row["words"].split()) if w in numbers)
        self.terms, at = np.array(found, dtype=np.int64).reshape(-1, 2).T
        counts = np.asarray(row["counts"], dtype=np.int64)
        self.counts = counts[at]
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        listed = np.arange(self.begins[-1]) + np.repeat((np.cumsum(counts) - counts)[at] - self.begins[:-1], self.counts)
        self.positions = np.frombuffer(row["positions"], dtype=np.uint32)[listed].astype(np.int64)
        self.keys = np.repeat(self.terms, self.counts) * self.span + self.positions

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros_like(terms)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.counts[at], 0)

    def listed(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its term's positions: row numbers and positions."""
        at = np.searchsorted(self.terms, terms)
        n = self.counts[at]
        rows = np.repeat(np.arange(len(terms)), n)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return rows, self.positions[self.begins[at][rows] + inner]

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        keys = terms * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and starts of all exact occurrences."""
        inside = np.arange(windows.shape[1]) < lengths[:, None]
        frequency = np.where(inside, self.frequency(windows), np.iinfo(np.int64).max)
        order = np.argsort(frequency, axis=1, kind="stable")
        live = np.flatnonzero(frequency[np.arange(len(windows)), order[:, 0]] > 0) if len(windows) else np.array([], dtype=np.int64)
        rows, at = self.listed(windows[live, order[live, 0]])
        which, starts = live[rows], at - order[live[rows], 0]
        for step in range(1, windows.shape[1]):
            offset = order[which, step]
            ended = step >= lengths[which]
            keep = ended | self.holds(windows[which, offset], starts + offset)
            which, starts = which[keep], starts[keep]
        return which, starts

    def near(self, windows: np.ndarray, lengths: np.ndarray, n_terms: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and documents where the window's rarest distinct terms, n_terms of
        them or all, lie within `span` tokens of one document after the rarest's occurrence
        or before it."""
        found, where = [], []
        for i, (window, n) in enumerate(zip(windows, lengths)):
            distinct = np.unique(window[:n])
            frequency = self.frequency(distinct)
            rare = distinct[np.argsort(frequency, kind="stable")][:n_terms]
            if not frequency.min():
                continue
            lists = []
            for t in rare:
                at = np.searchsorted(self.terms, t)
                lists.append(self.positions[self.begins[at]:self.begins[at + 1]])
            for start in np.unique(np.concatenate(lists)):
                doc = np.searchsorted(self.starts, start, side="right") - 1
                end = min(start + span, self.starts[doc + 1])
                if all(np.searchsorted(x, end) > np.searchsorted(x, start) for x in lists):
                    found.append(i)
                    where.append(doc)
        return np.array(found, dtype=np.int64), np.array(where, dtype=np.int64)


def _blocks(batches, numbers):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(row, numbers)


def match(index: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: doc_id, the text's key, n_words, the hit words' spans, the items that occur."""
    spark, found = index.sparkSession, []
    for part in parts(bench):
        test = TestSet(part)
        shared = spark.sparkContext.broadcast((test.terms, test.windows, test.lengths, test.items))

        def look_up(batches, shared=shared):
            numbers, windows, lengths, items = shared.value
            for row, block in _blocks(batches, numbers):
                which, starts = block.phrases(windows, lengths)
                owner = np.searchsorted(block.starts, starts, side="right") - 1
                hits = [[] for _ in row["doc_ids"]]
                for w, s, d in zip(which.tolist(), (starts - block.starts[owner]).tolist(), owner.tolist()):
                    hits[d].append((w, s))
                yield {
                    "block": [row["block"]] * len(hits), "at": range(len(hits)),
                    "doc_id": row["doc_ids"], "k1": row["k1"], "k2": row["k2"], "n_words": row["n_words"],
                    "begins": [[s for _, s in h] for h in hits],
                    "ends": [[s + int(lengths[w]) for w, s in h] for h in hits],
                    "items": [sorted(set().union(*(items[w] for w, _ in h))) for h in hits],
                }

        schema = "block long, at int, doc_id long, k1 long, k2 long, n_words long, begins array<long>, ends array<long>, items array<string>"
        found.append(arrow_map(index, look_up, schema))
    if len(found) > 1:
        # A document has a row of each part.
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "items")]
        rows = reduce(DataFrame.union, found).groupBy("block", "at", "doc_id", "k1", "k2", "n_words").agg(*lists)
        return rows.withColumn("items", F.array_distinct("items")).drop("block", "at")
    return found[0].drop("block", "at")


def proximity(index: DataFrame, bench: DataFrame, n_terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """doc_id and item_id where an item's words come close together, in any order."""
    spark, found = index.sparkSession, []
    for part in parts(bench):
        test = TestSet(part)
        shared = spark.sparkContext.broadcast((test.terms, test.windows, test.lengths, test.items))

        def look_up(batches, shared=shared):
            numbers, windows, lengths, items = shared.value
            for row, block in _blocks(batches, numbers):
                which, docs = block.near(windows, lengths, n_terms, span)
                pairs = sorted({(d, item) for w, d in zip(which.tolist(), docs.tolist()) for item in items[w]})
                yield {"doc_id": [row["doc_ids"][d] for d, _ in pairs], "item_id": [item for _, item in pairs]}

        found.append(arrow_map(index, look_up, "doc_id long, item_id string"))
    return reduce(DataFrame.union, found).distinct()


def covered(begins: list[int], ends: list[int]) -> int:
    """Positions in the union of half-open spans."""
    total, last = 0, 0
    for b, e in sorted(zip(begins, ends)):
        total += max(e - max(b, last), 0)
        last = max(last, e)
    return total


def contamination(docs: DataFrame, bench: DataFrame, one_in: int = ONE_IN, keys: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judge(build_index(docs), bench, one_in, keys)


def judge(index: DataFrame, bench: DataFrame, one_in: int = ONE_IN, keys: bool = False) -> DataFrame:
    """`contamination` of the documents of a stored index."""
    matched = match(index, bench)

    def digest(batches):
        for batch in batches:
            rows = batch.to_pylist()
            hit = [covered(r["begins"], r["ends"]) for r in rows]
            yield {
                **{c: [r[c] for r in rows] for c in ("doc_id", "k1", "k2", "n_words")}, "n_hit": hit,
                "n_items": [len(r["items"]) for r in rows],
                "items_sha256": [hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest() for r in rows],
                "contaminated": [h > 0 and one_in * h >= r["n_words"] for h, r in zip(hit, rows)],
            }

    out = arrow_map(
        matched, digest,
        "doc_id long, k1 long, k2 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )
    return out if keys else out.drop("k1", "k2")


def clean(docs: DataFrame, bench: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    judged = contamination(docs, bench, one_in, keys=True).where("contaminated")
    # Stored first, so that Spark knows how few they are when it chooses the join.
    bad = materialize(judged.select("doc_id", "k1", "k2").distinct(), "contaminated").alias("bad")
    rows = text_keys(docs).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.col("d.k1") == F.col("bad.k1")) & (F.col("d.k2") == F.col("bad.k2"))
    return rows.join(bad, same, "left_anti").select("row.*")
