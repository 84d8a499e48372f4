"""Removal of long repeated byte strings by a run-length compressed index.

A byte goes when a string of `LENGTH` bytes over it also starts earlier in the corpus. All
strings of that length are judged, in four steps.

1. *Stretches.* Each string is named by its smallest hashed gram of `GRAM` bytes, so equal
   strings have equal names wherever they stand. Neighbouring strings with the same gram form
   a stretch. Stretches are spread by gram; a task drops those it holds twice (the later
   one is repeated as a whole), so however often a passage occurs, a task sends it on once for
   every `HELD` stretches.
2. *Folding.* Sorted by gram and content, stretches stream by: of equal ones all but the
   first are repeated as a whole. A gram whose stretches are all equal needs no more.
3. *Index.* The bytes of what is left (one stretch of each content, where contents differ under
   one gram) are gathered by gram. `RunIndex` builds the Burrows-Wheeler transform of such a
   batch and keeps its runs with the suffix-array samples at their ends. Text positions are
   streamed against it: from the samples follows, for each position, the length of its
   longest match with its neighbour in suffix order and where that match starts (its matching
   statistics). Positions linked by matches of at least `LENGTH` are equal strings, and all
   but the first are repeated.
4. *Cutting.* Repeated spans meet their documents, are merged and cut out.

Grams under which more than `HOT` different stretches stand (the edge of a passage that very
many documents share) are spread further: each of their strings becomes a row of its own,
and rows with the same string are reduced before they are shuffled. The result is the same.

Defined cases: null text has no bytes and stays null in `remove`; rows with the same
doc_id and the same text are one document; rows that share an id, but not a text, are ordered
by the hash of the text; a null doc_id comes before all others. Empty tables give no rows.
Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks
from haulbook.session import materialize

LENGTH = 100
GRAM = 24
#: Different stretches of one gram that one task may index.
HOT = 20_000
#: Bytes of stretches that are indexed together; a task needs some 40 times as many meanwhile.
BATCH_BYTES = 512 << 10
#: Stretches that a task holds to find those it has twice, some 10 MB.
HELD = 1 << 18

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_INVERSE = np.uint64(pow(int(_C), -1, 1 << 64))
_PLACE_BITS = 20  # of a position within a piece of a text
_PIECE = (1 << _PLACE_BITS) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return (x ^ (x >> np.uint64(29))) * _A


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretcher:
    """Cuts texts into stretches: gram, content, first start and number of starts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        assert gram % 8 == 0 and length >= gram + 8
        self.length, self.gram = length, gram
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def stretches(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        step = _PIECE - self.length
        found = [self._piece(text[i:i + _PIECE], i) for i in range(0, max(len(text) - self.length + 1, 0), step + 1)]
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _piece(self, text: bytes, base: int):
        n, length, gram = len(text), self.length, self.gram
        raw = np.frombuffer(text + bytes(8), dtype=np.uint8)
        eights = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), shape=(n,), strides=(1,))
        mixed = _mix(eights + _C)  # of the 8 bytes from each place on
        hashed = mixed[:n - gram + 1].copy()
        for i in range(8, gram, 8):
            hashed = hashed * _A + mixed[i:n - gram + 1 + i]
        hashed = _mix(hashed)
        # The place in the low bits: the smallest is also the leftmost, and is known.
        low = (hashed & ~np.uint64(_PIECE)) | np.arange(len(hashed), dtype=np.uint64)
        width, done = length - gram + 1, 1
        while done < width:
            shift = min(done, width - done)
            low = np.minimum(low[:-shift], low[shift:])
            done += shift
        place = low & np.uint64(_PIECE)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first].astype(np.int64)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_C, 2 * n + 1), _powers(_INVERSE, 2 * n + 1)
        # Content: a sum over the stretch's places, moved to its first one.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.up[:n], dtype=np.uint64)])
        end = last + length - 7
        content = (sums[end] - sums[first]) * self.down[first]
        content = _mix(content ^ ((end - first).astype(np.uint64) * _B + (at - first).astype(np.uint64) * _A))
        return hashed[at], content, first + base, last - first + 1


STRETCH = "gram long, content long, doc long, start int, starts int, repeated boolean"


def _stretch_rows(length: int, gram: int, most: int = HELD):
    def work(batches):
        cutter = Stretcher(length, gram)
        held, n = [], 0
        for batch in chunks(batches, "text"):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                grams, content, start, starts = cutter.stretches(text.encode())
                held.append((grams.view(np.int64), content.view(np.int64), np.full(len(start), doc), start.astype(np.int32), starts.astype(np.int32)))
                n += len(start)
                if n >= most:
                    yield from _once(held)
                    held, n = [], 0
        if held:
            yield from _once(held)

    return work


def _once(held: list[tuple]):
    """Stretches without those that are held twice, and the spans of these."""
    grams, content, doc, start, starts = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((start, doc, content, grams))
    grams, content, doc, start, starts = (x[order] for x in (grams, content, doc, start, starts))
    repeated = np.zeros(len(order), dtype=bool)
    repeated[1:] = (grams[1:] == grams[:-1]) & (content[1:] == content[:-1])
    # What is known to be repeated goes on as merged spans.
    later = np.flatnonzero(repeated)
    spans = _merge(doc[later], start[later].astype(np.int64), start[later].astype(np.int64) + starts[later] - 1)
    for i in range(0, len(order), 65536):
        keep = slice(i, i + 65536)
        one = ~repeated[keep]
        yield {
            "gram": grams[keep][one], "content": content[keep][one], "doc": doc[keep][one], "start": start[keep][one],
            "starts": starts[keep][one], "repeated": np.zeros(one.sum(), dtype=bool),
        }
    # Spread by place, as they only pass through.
    yield {
        "gram": _mix(spans[0].astype(np.uint64) * _A + spans[1].astype(np.uint64)).view(np.int64), "content": np.zeros(len(spans[0]), dtype=np.int64),
        "doc": spans[0], "start": spans[1].astype(np.int32), "starts": (spans[2] - spans[1] + 1).astype(np.int32), "repeated": np.ones(len(spans[0]), dtype=bool),
    }


def _merge(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, joined where they touch or overlap."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    # Ends so far, per document: documents are apart by more than any text is long.
    _, rank = np.unique(doc, return_inverse=True)
    far = rank.astype(np.int64) << 33
    reach = np.maximum.accumulate(far + last)
    new = np.concatenate([[True], far[1:] + first[1:] > reach[:-1] + 1])
    heads = np.flatnonzero(new)
    return doc[heads], first[heads], np.maximum.reduceat(far + last, heads) - far[heads]


def _fold(batches):
    """Of stretches sorted by gram, content and place: marks equal ones but the first, and
    lets the first of each content on where a gram has several."""
    pending = None  # the first stretch of the first content under the current gram
    last_gram = last_content = None
    nth = 0
    for batch in batches:
        out = {k: [] for k in ("gram", "doc", "start", "starts", "repeated", "nth")}

        def put(row, repeated, nth):
            for k, v in zip(("gram", "doc", "start", "starts"), row):
                out[k].append(v)
            out["repeated"].append(repeated)
            out["nth"].append(nth)

        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "content", "doc", "start", "starts", "repeated")]
        gram, content, doc, start, starts, known = columns
        same_gram = np.empty(len(gram), dtype=bool)
        same_gram[1:] = gram[1:] == gram[:-1]
        same_gram[:1] = len(gram) > 0 and last_gram == gram[0]
        # Most grams stand alone: only rows beside an equal gram need a look.
        alone = ~same_gram
        alone[:-1] &= ~same_gram[1:]
        alone &= ~known
        if len(alone):
            alone[-1] = False  # the next batch may go on with its gram
        for i in np.flatnonzero(~alone).tolist():
            row = (int(gram[i]), int(doc[i]), int(start[i]), int(starts[i]))
            if known[i]:
                put(row, True, 0)
                continue
            if row[0] != last_gram:
                last_gram, last_content, pending, nth = row[0], content[i], row, 0
            elif content[i] == last_content:
                put(row, True, 0)
            else:
                if pending:
                    put(pending, False, 0)
                    pending = None
                nth += 1
                last_content = content[i]
                put(row, False, nth)
        yield out


FOLDED = "gram long, doc long, start int, starts int, repeated boolean, nth int"


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform with samples at the runs' ends.

    For text position p the sample at or before p tells its neighbour in suffix order and the
    length of their match: both move along with p until the next sample.
    """

    def __init__(self, text: np.ndarray):
        """text: small non-negative numbers; 0 separates and never takes part in a match."""
        suffixes = suffix_array(text)
        # Nothing stands before the text: its first suffix ends every run.
        before = text[suffixes - 1]
        before[suffixes == 0] = -1
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])).astype(suffixes.dtype)
        self.run_chars, self.run_starts = before[heads], heads
        at, neighbour = suffixes[heads], suffixes[heads - 1]
        del suffixes, before
        match = _common(text, at, neighbour)
        match[0] = 0  # the first suffix has no neighbour before it
        order = np.argsort(at)
        self.at, self.neighbour, self.match = at[order], neighbour[order], match[order]

    def statistics(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Match length with, and place of, the neighbour in suffix order."""
        i = np.searchsorted(self.at, places, side="right") - 1
        moved = places - self.at[i]
        return np.maximum(self.match[i] - moved, 0), self.neighbour[i] + moved


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling from seven characters on; the end sorts before everything."""
    n, bits, number = len(text), 9, _number(len(text))
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):
        key <<= bits
        key[:max(n - i, 0)] += text[i:]
        key[:max(n - i, 0)] += 1
    step = 7
    while True:
        order = np.argsort(key).astype(number)
        key = key[order]
        new = np.concatenate([[False], key[1:] != key[:-1]])
        rank = np.empty(n, dtype=number)
        rank[order] = np.cumsum(new, dtype=number)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        np.multiply(rank, n + 1, out=key, dtype=np.int64)
        key[:max(n - step, 0)] += rank[step:]
        key[:max(n - step, 0)] += 1
        step *= 2


def _number(n: int) -> type:
    """What places in a text of n characters are kept in."""
    return np.int32 if n < 1 << 31 else np.int64


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at a and at b."""
    n, length = len(text), np.zeros(len(a), dtype=a.dtype)
    live = np.arange(len(a), dtype=a.dtype)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        length[live] += 1
    return length


def repeated_starts(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per stretch the starts whose string of `length` bytes stands in an earlier stretch."""
    sizes = np.array([len(s) for s in stretches], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begins[-1], dtype=np.int16)
    joined = np.frombuffer(b"\0".join(stretches) + b"\0", dtype=np.uint8)
    text[:] = joined
    text += 1
    text[begins[1:] - 1] = 0
    index, number = RunIndex(text), _number(len(text))
    counts = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(stretches), dtype=number), counts)
    places = np.arange(len(rows), dtype=number)
    places += np.repeat((begins[:-1] - np.cumsum(counts) + counts).astype(number), counts)
    match, neighbour = index.statistics(places)
    linked = match >= length
    # Chains of equal strings: follow the neighbours to the chain's head, jumping twice as
    # far each time, then take the first place of each chain.
    head = np.arange(len(text), dtype=number)
    head[places[linked]] = neighbour[linked]
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        head = further
    chain = head[places]
    first = np.full(len(text), len(text), dtype=number)
    np.minimum.at(first, chain, places)
    again = places > first[chain]
    return [x - begins[i] for i, x in enumerate(np.split(places[again], np.searchsorted(rows[again], np.arange(1, len(stretches)))))]


def _index(length: int):
    def work(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "start", "bytes"))):
                # A gram's stretches are indexed together.
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield _indexed(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _indexed(held, length)

    return work


def _indexed(rows: list[tuple], length: int) -> dict:
    starts = repeated_starts([r[3] for r in rows], length)
    n = np.array([len(s) for s in starts])
    doc = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), n)
    first = np.concatenate(starts) + np.repeat(np.array([r[2] for r in rows], dtype=np.int64), n)
    doc, first, last = _merge(doc, first, first)
    return {"doc": doc, "start": first.astype(np.int32), "starts": (last - first + 1).astype(np.int32)}


def _slices(length: int):
    """Cuts the wanted stretches out of their documents."""

    def work(batches):
        for batch in chunks(batches, "text"):
            out = {k: [] for k in ("gram", "doc", "start", "bytes")}
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted"))):
                raw = text.encode()
                for w in wanted:
                    out["gram"].append(w["gram"])
                    out["doc"].append(doc)
                    out["start"].append(w["start"])
                    out["bytes"].append(raw[w["start"]:w["start"] + w["starts"] + length - 1])
            yield out

    return work


def _hot_strings(length: int):
    def work(batches):
        for batch in chunks(batches, "bytes", BATCH_BYTES):
            out = {k: [] for k in ("name", "doc", "start")}
            for doc, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "bytes"))):
                for i in range(len(raw) - length + 1):
                    out["name"].append(hashlib.blake2b(raw[i:i + length], digest_size=16).digest())
                    out["doc"].append(doc)
                    out["start"].append(start + i)
            yield out

    return work


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, the whole `row`, and `doc`: a number in the order of documents, the id
    where it is unique. The second table has each document once."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    unclear = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if unclear.isEmpty():
        plain = plain.withColumn("doc", F.col("doc_id"))
        return plain, plain
    plain = plain.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    numbers = materialize(
        plain.select("doc_id", "hash").distinct().orderBy("doc_id", "hash").withColumn("doc", F.monotonically_increasing_id()),
        "document-numbers",
    )
    same = plain.doc_id.eqNullSafe(numbers.doc_id) & (plain.hash == numbers.hash)
    plain = plain.join(numbers, same).select(plain.doc_id, "text", "row", "doc")
    return plain, plain.dropDuplicates(["doc"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents with their number `doc` and text bytes, and per number the ranges of
    starts (start, starts) whose string of `length` bytes starts earlier elsewhere."""
    texts, once = keyed(docs)
    plain = once.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    rows = arrow_map(plain, _stretch_rows(length, gram), STRETCH)
    parted = rows.repartition("gram").sortWithinPartitions("gram", "content", "doc", "start")
    folded = materialize(arrow_map(parted, _fold, FOLDED), "folded-stretches")
    known = folded.where("repeated").select("doc", "start", "starts")
    wanted = folded.where("not repeated").groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "starts")).alias("wanted"))
    cut = arrow_map(plain.join(wanted, "doc"), _slices(length), "gram long, doc long, start int, bytes binary")
    hot_grams = folded.where(F.col("nth") >= hot).select("gram").distinct()
    found = []
    if hot_grams.isEmpty():
        found.append(_by_index(cut, length))
    else:
        found.append(_by_index(cut.join(hot_grams, "gram", "left_anti"), length))
        found.append(_by_string(cut.join(hot_grams, "gram", "left_semi"), length))
    ranges = known
    for f in found:
        ranges = ranges.unionByName(f)
    return texts, ranges


def _by_index(cut: DataFrame, length: int) -> DataFrame:
    parted = cut.repartition("gram").sortWithinPartitions("gram", "doc", "start")
    return arrow_map(parted, _index(length), "doc long, start int, starts int")


def _by_string(cut: DataFrame, length: int) -> DataFrame:
    rows = arrow_map(cut, _hot_strings(length), "name binary, doc long, start int")
    firsts = rows.groupBy("name").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(firsts, "name").where(F.struct("doc", "start") != F.col("first"))
    return later.select("doc", "start", F.lit(1).alias("starts"))


def removed_spans(ranges, length: int) -> list[list[int]]:
    """The bytes that ranges of starts cover, as merged half-open spans."""
    spans: list[list[int]] = []
    for begin, end in sorted((r["start"], r["start"] + r["starts"] + length - 1) for r in ranges or ()):
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    return spans


def without(raw: bytes, spans: list[list[int]]) -> bytes:
    kept, last = [], 0
    for begin, end in spans:
        kept.append(raw[last:begin])
        last = end
    return b"".join([*kept, raw[last:]])


def whole_characters(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans drawn in to the borders of UTF-8 characters; one only partly covered stays."""
    out = []
    for begin, end in spans:
        while begin < end and raw[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append([begin, end])
    return out


def _gathered(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    texts, ranges = repeated_spans(docs, length, gram, hot)
    gathered = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "starts")).alias("ranges"))
    return texts.join(gathered, "doc", "left")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, bytes cut as they are."""

    def work(batches):
        for batch in chunks(batches, "text"):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = (text or "").encode()
                spans = removed_spans(ranges, length)
                left = without(raw, spans)
                for k, v in zip(out, (len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
            yield {"doc_id": batch.column("doc_id"), **out}

    joined = _gathered(docs, length, gram, hot).select("doc_id", "text", "ranges")
    return arrow_map(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows of `docs`, all columns, with repeated strings cut from the text.

    Texts stay valid UTF-8: a character of which only some bytes are repeated stays. n_chars
    follows the text where there is such a column. Rows whose whole text goes keep an empty one.
    """
    schema, names = docs.schema, docs.columns

    def work(batches):
        for batch in chunks(batches, "row.text"):
            row = batch.column("row")
            columns = dict(zip(names, row.flatten()))
            texts, lengths = columns["text"].to_pylist(), None
            if "n_chars" in columns:
                lengths = columns["n_chars"].to_pylist()
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                if ranges:
                    raw = texts[i].encode()
                    texts[i] = without(raw, whole_characters(raw, removed_spans(ranges, length))).decode()
                    if lengths:
                        lengths[i] = len(texts[i])
            columns["text"] = pa.array(texts, type=columns["text"].type)
            if lengths is not None:
                columns["n_chars"] = pa.array(lengths, type=columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return _gathered(docs, length, gram, hot).select("row", "ranges").mapInArrow(work, schema)
