import math
import zlib
from collections import Counter

import numpy as np
import pytest

from haulbook.llm import quality, registry, toxicity

DIR = "/root/testdata/sf0.1"


def ranked(score, y):
    """Area under the curve."""
    order = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name, label, folds, fold, area, right", [
    ("op3_additive_model", "quality", 5, 0, 0.99, 0.98), ("op10_weighted_lexicon", "toxic", 3, 1, 0.92, 0.97),
])
def test_held_out_rows(spark, name, label, folds, fold, area, right):
    scored = registry.queries()[name](spark, DIR).toPandas()
    assert len(scored) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert [*scored.columns] == ["doc_id", "held_out", "score", "predicted"]
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all()
    both = scored.merge(spark.read.parquet(f"{DIR}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert ranked(both.score.to_numpy(), both[label].to_numpy()) > area
    assert (both.predicted == both[label]).mean() > right


BAD = ["!!! ### " * 30, "SPAM " * 60, "$$$ " * 40]
GOOD = ["The road was long and the driver was tired, so they stopped near the river.", "Trucks carry goods from town to town every day of the year."]


def test_quality_edges(make_docs, labels):
    docs = make_docs(*[(i, (BAD + GOOD)[i % 5] + f" {i}") for i in range(200)], (900, None), (901, ""), (None, "x"), (3, BAD[0] + " 3"), (902, "w " * 200_000))
    marks = labels(*[(i, int(i % 5 > 2), None) for i in range(0, 200)], (3, None, 1), (None, 1, 0))
    out = quality.score(docs, marks)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    right = [r.predicted == int(r.doc_id % 5 > 2) for r in rows if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 3]  # 3 has two texts
    assert np.mean(right) == 1
    kept = quality.keep(docs, marks)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert all(i in ids for i in range(200) if i % 5 > 2) and not any(i in ids for i in range(200) if i % 5 <= 2)
    none = marks.where("false")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("false"), marks).collect() == []
    assert quality.keep(docs.where("false"), marks).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y, cycles=5, pairs=2)
    assert {1, 3} in [{i, j} for i, j, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    # A score is the sum of the tables at the bins.
    bins = model.bins(x)
    by_hand = [model.base + sum(t[b[i]] for i, t in enumerate(model.singles)) + sum(t[b[i], b[j]] for i, j, t in model.pairs) for b in bins[:50]]
    assert np.allclose(by_hand, model.margins(bins[:50]))


def test_folding():
    assert toxicity.fold("Idіоt, 1D10T! ídìöt\u0301 i$iot$$ ｉｄｉｏｔ") == " idiot idiot idiot isiot idiot "
    assert toxicity.fold(None) == toxicity.fold("") == "  "
    for dressed in ("𝐢𝐝𝐢𝐨𝐭", "𝕀𝔻𝕀𝕆𝕋", "ⓘⓓⓘⓞⓣ", "⒤⒟⒤⒪⒯", "ɪᴅɪᴏᴛ", "🅸🅳🅸🅾🆃", "🅘🅓🅘🅞🅣", "🇮🇩🇮🇴🇹", "i\u200bd\u00adi\ufeffot", "i\u0336d\u20ddiot", "ɨđɨøŧ", "𝟏𝐝𝟏𝟎𝐭", "ıԁıօt"):
        assert toxicity.fold(dressed) == " idiot ", dressed
    assert toxicity.fold("ΝΗΥ ﬀ ⑴ 漢字 a\tb…c ½") == " nhy ff i 漢字 a b c "


def brute_lexicon(rows, marks):
    """Entries and exceptions by plain counting over all beginnings and words of the texts."""
    known = [(f" {' '.join(toxicity.fold(t).split())} ", marks[i]) for i, t in rows if i in marks]
    n = {y: sum(m == y for _, m in known) for y in (0, 1)}
    chars = {y: sum(len(t) for i, t in rows if marks.get(i) == y) for y in (0, 1)}
    docs, times = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for text, y in known:
        found = Counter()
        for w in text.split():
            found.update([f" {w[:k]}" for k in range(4, min(len(w), 10) + 1)] + [f" {w} "] * (len(w) < 4 or len(w) > 10))
        docs[y].update(set(found))
        times[y].update(found)
    ranked = []
    for e in docs[1]:
        t, c = docs[1][e] / n[1], docs[0][e] / n[0]
        p = (docs[1][e] + docs[0][e]) / (n[0] + n[1])
        errors = (t - c) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
        if docs[1][e] >= 4 and errors >= 5 and t >= 3 * c:
            ranked.append((-errors, len(e), e))
    chosen = {}
    for _, _, e in sorted(ranked):
        if not any(e.startswith(c) or c.startswith(e) for c in chosen):
            chosen[e] = max(math.log((times[1][e] + 0.5) / chars[1]) - math.log((times[0][e] + 0.5) / chars[0]), 0.1)
    benign = {0: Counter(), 1: Counter()}
    for text, y in known:
        words = text.split()
        hit = [any(f" {w} ".startswith(e) for e in chosen) for w in words]
        found = {f" {w} " for w, h in zip(words, hit) if h}
        found |= {f" {a} {b} " for (a, g), (b, h) in zip(zip(words, hit), zip(words[1:], hit[1:])) if g or h}
        benign[y].update(found)
    return chosen, {e for e, k in benign[0].items() if k >= 3 and benign[1][e] / n[1] <= 1.5 * k / n[0]}


def test_lexicon_equals_brute_force(make_docs, labels):
    """More entries and exceptions than the 2,000 that an earlier lexicon could hold."""
    rng = np.random.default_rng(1)
    stem = lambda i: "".join("bcdfghjk"[i >> s & 7] + "aeiou"[(i >> s) % 5] for s in (0, 3, 6, 9))
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(["road", "truck", "driver", "load", "internationalisation"], 25))
        if i % 3 == 0:
            text += " " + " ".join(stem(k) for k in range(2400)) + " nitwit internationalidiocy"
        elif i % 12 == 1:
            text += " the nitwitberry jam " + " ".join(stem(k) + "berry" for k in range(2400))
        rows.append((i, text))
    marks = {i: int(i % 3 == 0) for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1}
    lexicon = toxicity.learn(make_docs(*rows), labels(*[(i, None, y) for i, y in marks.items()]))
    entries, exceptions = brute_lexicon(rows, marks)
    assert " internationalidiocy " in entries and len(exceptions) > 2000
    assert lexicon.entries.keys() == entries.keys() and all(abs(lexicon.entries[e] - entries[e]) < 1e-9 for e in entries)
    assert set(lexicon.exceptions) == exceptions


def test_toxicity_edges(make_docs, labels):
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(rng.choice(["road", "truck", "driver", "load", "mile", "grumpy"], 30))
    rows = []
    for i in range(300):
        text = plain()
        if i % 3 == 0:
            text = "you absolute nitwit " + text + " such a N1TW1T"
        elif i % 12 == 1:
            text += " the nitwitberry jam"  # holds the word, but is none
        rows.append((i, text))
    docs = make_docs(*rows, (900, None), (901, ""), (None, "x"), (902, "n\u00edtwit nitwit"), (903, "nitwitberry"), (0, rows[0][1]), (904, "road " * 100_000))
    marks = labels(*[(i, None, int(i % 3 == 0)) for i in range(300)], (5, 1, None))
    lexicon = toxicity.learn(docs, marks)
    assert any(e.startswith(" nitw") for e in lexicon.entries)
    assert any("nitwitberry" in e for e in lexicon.exceptions)
    out = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert all(out[i].predicted == int(i % 3 == 0) for i in range(300))
    assert out[902].predicted == 1 and out[903].predicted == out[900].predicted == out[901].predicted == out[904].predicted == 0
    assert {r.score for r in toxicity.score(docs, marks.where("false")).collect()} == {0.5}
    assert toxicity.score(docs.where("false"), marks).collect() == []
