"""Best-two-fit packing of tokenized documents into sequences of one length.

A document is its token ids and an end id. One longer than a sequence is cut so that all its
pieces but the first are as long as a sequence; shorter ones are never cut.

Best two fit fills a sequence with the longest piece that fits, again and again. When none fits
the gap any more, the sequence's shortest piece gives way to two unpacked pieces if these fill
the widened gap more tightly. Only lengths matter for that, and equal lengths are
interchangeable, so the algorithm runs on the number of pieces of each length, at most as many
numbers as a sequence has tokens, whatever the corpus: what it does for one sequence it would do
again for the next as long as no length it looks at runs short, and so is written down once with
the number of sequences (`patterns`).

A task numbers its pieces of each length as it reads them. Sums over the tasks shift these to
numbers over the whole corpus, and a piece's number leads to its sequence and place there. No
window or grouping holds pieces, so a length that most pieces have is no hot group.

Ids are those of the named vocabulary as the `tokenizers` library gives them. The same vocabulary
as ranks is four times as fast in `tiktoken`; the two libraries know different editions of
Unicode, so texts with code points unassigned in `unicodedata`'s or from U+10000 on, and texts with
the vocabulary's special tokens, go through `tokenizers`. Texts are encoded in chunks cut in front of single
spaces, where the vocabulary's pattern always begins a new word, so a very long text needs little
memory.

Defined cases: a null text is an empty one, which is one piece of the end id; repeated rows and
null ids are documents of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks
from haulbook.session import materialize

SIZE = 2048
END_ID = 0
#: Vocabulary and the same as ranks, files of the `public_tokenizers` package.
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
#: Characters that are encoded at once.
CHUNK_CHARS = 1 << 16

_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLANE = 0x10000
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def vocabulary(names: tuple[str, str] = VOCABULARY) -> tuple[str, bytes, str]:
    """Contents of both files and the pattern of words; a few MB, whatever the corpus."""
    import public_tokenizers

    with open(public_tokenizers.path(names[0]), encoding="utf-8") as whole, open(public_tokenizers.path(names[1]), "rb") as ranks:
        return whole.read(), ranks.read(), public_tokenizers.PATTERN


@functools.lru_cache(1)
def _unassigned() -> re.Pattern:
    """Code points below U+10000 that editions of Unicode may see differently."""
    found, begun = [], None
    for c in range(_PLANE + 1):
        unknown = c < _PLANE and unicodedata.category(chr(c)) == "Cn"
        if unknown and begun is None:
            begun = c
        elif not unknown and begun is not None:
            found.append(f"\\u{begun:04x}-\\u{c - 1:04x}")
            begun = None
    return re.compile(f"[{''.join(found)}]")


class Encoder:
    """Token ids of texts; made once per task from the contents of the vocabulary files."""

    def __init__(self, whole: str, ranks: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(whole)
        pairs = (line.split() for line in ranks.splitlines())
        self.quick = tiktoken.Encoding(
            "ranks", pat_str=pattern, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        )
        special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def ids(self, text: str) -> np.ndarray:
        parts, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + CHUNK_CHARS) if start + CHUNK_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            parts.append(self._encode(text[start:end] if start or cut else text))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, dtype="<u4")

    def _encode(self, text: str) -> np.ndarray:
        if self.special.search(text) or not text.isascii() and (_BEYOND.search(text) or _unassigned().search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, the first with what is over."""
    start, length = 0, n % size or size
    while start < n:
        yield start, length
        start, length = start + length, size


def pieces(docs: DataFrame, size: int = SIZE, names: tuple[str, str] = VOCABULARY, ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, the ids if asked for, and the
    task with the piece's number among the task's pieces of that length.

    Store the result before it is read twice: the numbers belong to the tasks that gave them.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long, task int, nth long"
    files = docs.sparkSession.sparkContext.broadcast(vocabulary(names))

    def work(batches):
        encoder, task, seen = Encoder(*files.value), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in chunks(batches, "text"):
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = np.append(encoder.ids(text or ""), np.array([END_ID], dtype="<u4"))
                for piece, (start, length) in enumerate(cut(len(whole), size)):
                    own = whole[start : start + length]
                    row = (doc, piece, start, length, zlib.crc32(own.tobytes()), task, seen[length], own)
                    seen[length] += 1
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            if not ids:
                del out["ids"]
            yield out

    return arrow_map(docs.select("doc_id", "text"), work, schema + ", ids array<int>" * ids)


def patterns(counts: dict[int, int], size: int = SIZE) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Best two fit over the number of pieces of each length.

    Gives (sequences, [(length, pieces of it in each of them), ...]) until all are packed.
    """
    left = {n: k for n, k in counts.items() if k}
    have = sorted(left)
    while have:
        room, take, at = size, {}, len(have)
        while (at := bisect.bisect_right(have, room, 0, at) - 1) >= 0:
            n = have[at]
            take[n] = min(left[n], room // n)
            room -= take[n] * n
        need = dict(take)
        shortest = min(take)
        if room and (pair := _best_two(have, left, take, room, shortest)):
            take[shortest] -= 1
            for n in pair:
                take[n] = take.get(n, 0) + 1
                need[n] = need.get(n, 0) + 1
        # Every length looked at is there often enough for the same again.
        used = {n: k for n, k in take.items() if k}
        times = 1 + min((left[n] - need[n]) // k for n, k in used.items())
        yield times, sorted(used.items(), reverse=True)
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del have[bisect.bisect_left(have, n)]


def _best_two(have: list[int], left: dict[int, int], take: dict[int, int], room: int, shortest: int) -> tuple[int, int] | None:
    """Of two unpacked pieces that are longer than `shortest` together and fit its place with
    the room, those that fill most; the most unequal ones of several."""
    most = room + shortest
    low = bisect.bisect_right(have, room)
    high = bisect.bisect_right(have, most) - 1
    best, found = shortest, None
    free = lambda n: left[n] - take.get(n, 0)
    while low <= high:
        a, b = have[low], have[high]
        if a + b > most or not free(b):
            high -= 1
        elif not free(a) or a == b and free(a) < 2:
            low += 1
        else:
            if a + b > best:
                best, found = a + b, (a, b)
            low += 1
    return found


class Places:
    """Where the pieces of each length go: by number, runs that lie in the sequences alike."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        rows, given, sequence = [], dict.fromkeys(counts, 0), 0
        for times, used in patterns(counts, size):
            offset = 0
            for n, k in used:
                rows.append((n, given[n], sequence, k, offset))
                given[n] += times * k
                offset += n * k
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.sequence, self.each, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        begin = np.searchsorted(self.length, length, "left")
        end = np.searchsorted(self.length, length, "right")
        row = np.empty(len(length), dtype=np.int64)
        for a in np.unique(begin):
            own = begin == a
            row[own] = a + np.searchsorted(self.first[a : end[own][0]], number[own], "right") - 1
        within = number - self.first[row]
        return self.sequence[row] + within // self.each[row], self.offset[row] + within % self.each[row] * length


def place(stored: DataFrame, size: int = SIZE) -> DataFrame:
    """The stored pieces with sequence_id and offset, without task and nth."""
    counts = materialize(stored.groupBy("length", "task").agg(F.count("*").alias("k")), "piece-counts")
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    # At most a row for each length.
    by_length = dict(counts.groupBy("length").agg(F.sum("k")).collect())
    places = stored.sparkSession.sparkContext.broadcast(Places(by_length, size))
    numbered = (
        stored.join(starts, ["length", "task"])
        .withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task")
    )
    fields = [f for f in numbered.schema.fields if f.name != "nth"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def work(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset = places.value.find(length, batch.column("nth").to_numpy())
            yield {f.name: batch.column(f.name) for f in fields} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

    return arrow_map(numbered, work, schema)


def pack(docs: DataFrame, size: int = SIZE, names: tuple[str, str] = VOCABULARY, ids: bool = True) -> DataFrame:
    """A row per piece with its sequence and place; `ids=False` leaves the ids out."""
    return place(materialize(pieces(docs, size, names, ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and where each piece starts (for position
    ids and attention masks). A sequence has at most as many pieces as tokens."""
    row = F.struct("offset", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.offset").alias("starts"),
        F.col("rows.doc_id").alias("doc_ids"),
    )


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack(docs, size, ids=False)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset",
    )
