"""Hard negatives against a plain search over planted rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulbook.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    def make(*rows):
        df = spark.createDataFrame(list(rows), SCHEMA)
        return df.withColumns({n: F.lit("extra") for n in ("row", "vec", "anchor", "score", "windows", "id")})

    return make


def mined(rows):
    """The same by looking at all pairs."""
    kept = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vec]
        kept.append((vec_id, whole, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, u, label) in enumerate(kept):
        if a is None or a % 100:
            continue
        scores = [(sum(x * y for x, y in zip(u, v)), b, other) for j, (b, v, other) in enumerate(kept) if j != i]
        for ps, p, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            fits = [s for s in scores if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(a, p, n, b, ps, s) for n, (s, b, _) in enumerate(sorted(fits, key=order)[:10], 1)]
    return sorted(out, key=repr)


def found(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("leaf", [1, 8, 32])
def test_strassen(leaf):
    draw = np.random.default_rng(leaf)
    for n, k, m in ((1, 1, 1), (3, 5, 7), (65, 64, 33), (0, 4, 4), (17, 0, 3), (100, 129, 40)):
        # Large enough to run over: the ring of 64-bit integers has no rounding.
        a, b = draw.integers(-(2**62), 2**62, (n, k)), draw.integers(-(2**62), 2**62, (k, m))
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_heaps_merge_in_any_order():
    draw = np.random.default_rng(0)
    entries = [(int(o), int(s), int(i), bool(u)) for o, s, i, u in zip(*(draw.integers(0, n, 400) for n in (6, 9, 50, 2)))]
    want = {o: sorted(((-s, u, i) for q, s, i, u in entries if q == o))[:4] for o in range(6)}
    for parts in (1, 7, 400):
        heaps = negatives.Heaps(6, 4)
        for p in range(parts):
            own = entries[p::parts]
            heaps.merge(*(np.array([e[k] for e in own], dtype=t) for k, t in enumerate((np.int64, np.int64, np.int64, bool))))
        got = {o: [(-s, u, i) for q, s, i, u in zip(heaps.owner, heaps.score, heaps.id, heaps.unknown) if q == o] for o in range(6)}
        assert got == want


def test_planted_rows(vectors):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0.2, 0.4, 5)], int(draw.integers(0, 3))) for i in range(420)]
    rows += [
        (500, None, 1), (501, [0.1, None, 0.1, 0.1, 0.1], 1), (502, [0.1] * 5, None), (503, [float("nan")] * 5, 1),
        (504, [float("inf")] * 5, 1), (None, [0.5] * 5, 1), (None, [0.4] * 5, 2), (600, [], 1), (700, [0.6, 0.6], 2),
        (800, [0.3] * 9, 2), rows[100], rows[100], rows[0],
    ]
    rows += [(900 + i, [0.5] * 5, i % 2) for i in range(40)]  # one vector many times: ties
    assert found(negatives.digests(vectors(*rows))) == mined(rows)


def test_small_groups_and_tiles(vectors, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(i * 25, [float(x) for x in draw.normal(0.1, 0.4, 3)], int(draw.integers(0, 3))) for i in range(300)]
    want = mined(rows)
    for name, value in (("ANCHORS", 9), ("SLICE", 20), ("TILE", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert found(negatives.digests(vectors(*rows))) == want


def test_empty(vectors, spark):
    assert negatives.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.digests(vectors((100, [1.0], 1), (1, [1.0], 2))).collect() == []
    # A positive that scores below zero has an empty window.
    assert negatives.digests(vectors((100, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2))).collect() == []


def test_window_bounds(vectors):
    at = [(100, [1.0], 1), (1, [1.0], 1)] + [(10 + n, [n / 256], 2) for n in (76, 77, 229, 230, 231)]
    rows = negatives.digests(vectors(*at)).collect()
    assert {r.positive_score for r in rows} == {65536}
    assert [r.negative_score for r in sorted(rows, key=lambda r: r["rank"])] == [230 * 256, 229 * 256, 77 * 256]
