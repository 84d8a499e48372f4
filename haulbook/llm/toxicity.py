"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, takes accents off, brings styled letters (mathematical, circled, squared,
small capital, wide, stroked) to plain ones, replaces letters of other scripts and digits that
look like Latin letters, deletes characters without width, and turns the rest into blanks. A
lexicon entry is the beginning of a word, or a whole word where that is longer; its weight is the logarithm of how much more often it stands in the words of toxic
training documents than in those of clean ones. Exceptions are whole words, or pairs of neighbouring words, that hold an entry, but are
as common in clean documents; they cancel the entry where they stand. The weights of a text
and their number are summed, set against its words, and calibrated by a logistic curve.

The lexicon is learned from at most `TRAIN_ROWS` labelled documents, those whose id hashes
lowest; that sample bounds the lexicon, which has every entry and exception that the tests of
the sample accept. All documents are scored, over their whole texts.

Defined cases: null and empty texts match nothing and get the score of a text without
matches; labels without a toxic value are not used; without both classes among the training
rows every score is the share of the class there is (0.5 without rows).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map, chunks, held_out

TRAIN_ROWS = 20_000
FOLDS, HELD_FOLD = 3, 1
ACCEPT = 0.7
#: Letters of the beginnings that are tried; longer words are also tried whole.
SHORTEST, LONGEST = 4, 10
LEAST_DOCS = 4
#: An entry's share of toxic documents must exceed its share of clean ones by so many
#: standard errors.
LEAST_ERRORS = 5.0

MEASURES = ("weight_per_word", "weight", "matches_per_word", "matches")

# Characters that look like Latin letters. Capitals stand here where they look
# like another letter than their small form does.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Η": "h", "Μ": "m", "Ν": "n", "Υ": "y", "Ζ": "z",
    "ց": "g", "հ": "h", "ո": "n", "օ": "o", "ս": "u",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a",
}
# Blocks with letters in other dress, and the first of three alphabets in boxes
# that have no compatibility form.
BLOCKS = (
    (0, 0x590), (0x1D00, 0x2190), (0x2460, 0x2500), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFB00, 0xFB07), (0xFF01, 0xFF5F),
    (0x1D400, 0x1D800), (0x1F100, 0x1F200),
)
BOXED = (0x1F150, 0x1F170, 0x1F1E6)
_DRESSED = re.compile(r"LATIN (?:LETTER SMALL CAPITAL|(?:SMALL|CAPITAL) LETTER) ([A-Z])(?: WITH .*)?")


def plain_letters(code: int) -> str | None:
    """What a character is folded to; None for accents and characters without width."""
    c = chr(code)
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return None
    for first in BOXED:
        if first <= code < first + 26:
            return chr(ord("a") + code - first)
    if c not in LOOKALIKES:
        c = c.lower()
    out = ""
    for x in unicodedata.normalize("NFKD", c):
        named = _DRESSED.fullmatch(unicodedata.name(x, ""))
        x = named[1].lower() if named else x if x in LOOKALIKES else x.lower()
        out += "" if unicodedata.combining(x) else LOOKALIKES.get(x, x)
    out = out.strip("().,")  # letters in parentheses
    return out if out.isalpha() else " "


def fold_table() -> dict[int, str | None]:
    """All characters of `BLOCKS`, and all without width."""
    table = {code: plain_letters(code) for low, high in BLOCKS for code in range(low, high)}
    marks = (*range(0x1AB0, 0x1B00), *range(0xFE00, 0xFE10), *range(0xFE20, 0xFE30), 0xFEFF)
    return table | {code: None for code in marks} | {ord("$"): "s"}


_TABLE = fold_table()
_ASCII = bytes(ord(_TABLE[i]) for i in range(128)) + bytes(128)


def fold(text: str | None) -> str:
    """The text as folded words between single blanks, with a blank at both ends."""
    if not text:
        return "  "
    # Dollar signs stand for a letter only inside words.
    if "$" in text:
        text = " ".join(w.strip("$") for w in text.split())
    if text.isascii():
        text = text.encode().translate(_ASCII).decode()
    else:
        text = text.translate(_TABLE)
    return f" {' '.join(text.split())} "


def _counters() -> list[Counter]:
    """Documents that hold an entry, clean and toxic, then its occurrences in them."""
    return [Counter() for _ in range(4)]


def _count(label: float, found: Counter, into: list[Counter]) -> None:
    toxic = int(label >= 0.5)
    into[toxic].update(found.keys())
    into[2 + toxic].update(found)


def _emit(into: list[Counter]) -> dict:
    keys = list({*into[0], *into[1]})
    names = ("clean", "toxic", "clean_times", "toxic_times")
    return {"entry": keys} | {n: [c[k] for k in keys] for n, c in zip(names, into)}


def _prefix_counts(batches):
    into = _counters()
    for batch in chunks(batches, "text"):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            found = Counter()
            for w, times in Counter(fold(text).split()).items():
                if len(w) < SHORTEST:
                    found[f" {w} "] += times
                for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                    found[f" {w[:n]}"] += times
                if len(w) > LONGEST:
                    found[f" {w} "] += times
            _count(y, found, into)
            if len(into[0]) > 500_000:
                yield _emit(into)
                into = _counters()
    yield _emit(into)


class Lexicon:
    """The automaton over entries and exceptions; built again in each task."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        self.entries, self.exceptions = entries, exceptions
        self.curve = np.zeros(1 + len(MEASURES))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._automaton.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._automaton.add_word(e, (len(e), None))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """Places and weights of the entries that no exception covers."""
        if not self.entries:
            return []
        found, covered = [], []
        for end, (n, weight) in self.automaton.iter(folded):
            if weight is None:
                covered.append((end - n + 1, end))
            else:
                found.append((end - n + 1, weight))
        if covered and found:
            found = [(s, w) for s, w in found if not any(b <= s < e for b, e in covered)]
        return found

    def measures(self, text: str | None) -> list[float]:
        """`MEASURES` of the text, all dampened."""
        folded = fold(text)
        found, words = self.matches(folded), max(folded.count(" ") - 1, 1)
        weight, n = sum(w for _, w in found), len(found)
        return [math.log1p(100 * weight / words), math.log1p(weight), math.log1p(100 * n / words), math.log1p(n)]

    def scores(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + measures @ self.curve[1:])))


def _exception_counts(lexicon: Lexicon):
    def work(batches):
        into = _counters()
        for batch in chunks(batches, "text"):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                folded, found = fold(text), Counter()
                for start, _ in lexicon.matches(folded):
                    end = folded.index(" ", start + 1)
                    after = folded.find(" ", end + 1)
                    before = folded.rfind(" ", 0, start) if start else -1
                    found[folded[start:end + 1]] += 1
                    if after > 0:
                        found[folded[start:after + 1]] += 1
                    if before >= 0:
                        found[folded[before:end + 1]] += 1
                _count(y, found, into)
        yield _emit(into)

    return work


def _measured(lexicon: Lexicon):
    def work(batches):
        for batch in chunks(batches, "text"):
            m = [lexicon.measures(t) for t in batch.column("text").to_pylist()]
            yield {"y": batch.column("y"), **{name: [x[i] for x in m] for i, name in enumerate(MEASURES)}}

    return work


def _counted(sample: DataFrame, work) -> DataFrame:
    rows = arrow_map(sample, work, "entry string, clean long, toxic long, clean_times long, toxic_times long")
    return rows.groupBy("entry").agg(*(F.sum(c).alias(c) for c in rows.columns[1:]))


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold_no: int = HELD_FOLD, most: int = TRAIN_ROWS) -> Lexicon:
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), folds, fold_no)).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    # At most `most` pairs of numbers: a bounded broadcast, so the texts are not shuffled.
    picked = docs.sparkSession.createDataFrame(known.toPandas(), "doc_id long, y double")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "y")
    totals = sample.groupBy((F.col("y") >= 0.5).alias("toxic")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    totals = {r.toxic: (r.n, r.chars or 1) for r in totals.collect()}
    (n_toxic, chars_toxic), (n_clean, chars_clean) = totals.get(True, (0, 1)), totals.get(False, (0, 1))
    if not n_toxic or not n_clean:
        lexicon = Lexicon({}, [])
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        lexicon.curve[0] = np.log(share / (1 - share))
        return lexicon
    share_t, share_c = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    # Standard errors as if toxic and clean documents held the entry alike.
    pooled = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    entries = _counted(sample, _prefix_counts).where(F.col("toxic") >= LEAST_DOCS).withColumn("errors", (share_t - share_c) / error)
    rows = entries.where((F.col("errors") >= LEAST_ERRORS) & (share_t >= 3 * share_c)).orderBy(F.col("errors").desc(), F.length("entry"), "entry").collect()
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # the chosen ones' own beginnings
    for r in rows:
        e = r.entry
        beginnings = {e[:n] for n in range(2, min(len(e), LONGEST + 1) + 1)} | {e}
        if e in begun or not beginnings.isdisjoint(chosen):
            continue
        begun |= beginnings
        chosen[e] = max(math.log((r.toxic_times + 0.5) / chars_toxic) - math.log((r.clean_times + 0.5) / chars_clean), 0.1)
    plain = Lexicon(chosen, [])
    benign = _counted(sample, _exception_counts(plain)).where((F.col("clean") >= 3) & (share_t <= 1.5 * share_c))
    exceptions = [r.entry for r in benign.orderBy(F.col("clean").desc(), "entry").collect()]
    lexicon = Lexicon(chosen, exceptions)
    measured = arrow_map(sample, _measured(lexicon), ", ".join(["y double", *(f"{m} double" for m in MEASURES)])).toPandas()
    measured = measured.sort_values([*MEASURES, "y"])  # tasks end in any order
    lexicon.curve = _logistic(measured[[*MEASURES]].to_numpy(), measured.y.to_numpy())
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty @ w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        move = np.linalg.solve(curve, slope)
        w += move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold_no: int = HELD_FOLD, accept: float = ACCEPT, most: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon = learn(docs, labels, folds, fold_no, most)

    def work(batches):
        for batch in chunks(batches, "text"):
            m = np.array([lexicon.measures(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(MEASURES))
            scores = lexicon.scores(m)
            yield {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= accept).astype(np.int32)}

    scored = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold_no).alias("held_out"), "score", "predicted")
