import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from haulbook.llm import decontaminate as dc
from haulbook.llm import mixing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for win, owners in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short ITEM, été"), (10, "a a a a"), (2, "another text of item two"), (5, None), (6, "..")]


def contaminated_rows():
    rng = np.random.default_rng(0)
    noise = lambda n: " ".join(rng.choice(["a", "one", "item", "été", "xx", "Été", "yy9"], n))
    rows = [(i, noise(int(rng.integers(0, 60)))) for i in range(40)]
    rows += [(50, "x " * 200 + "TWO-three four five six seven eight nine ten eleven twelve thirteen fourteen!"), (51, ITEMS[0][1] + " " + ITEMS[0][1])]
    rows += [(52, None), (53, ""), (54, "a a a a a a"), (54, "a a a a a a"), (None, "short item été"), (55, "z " * 300_000 + "another text of item two")]
    return rows


@pytest.mark.parametrize("most", [4, dc.MOST_TEST_WORDS])
def test_contamination_equals_brute_force(spark, make_docs, monkeypatch, most):
    monkeypatch.setattr(dc, "parts", lambda b, m=most, f=dc.parts: f(b, m))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contaminated_rows()
    got = sorted((tuple(r) for r in dc.contamination(make_docs(*rows), bench).collect()), key=repr)
    assert got == brute(rows, ITEMS)


def test_a_stored_index_answers_another_test_set(spark, make_docs):
    rows = contaminated_rows()
    index = dc.build_index(make_docs(*rows))
    for items in (ITEMS[:2], ITEMS[2:], [(8, "yy9 xx"), (9, "never")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert sorted((tuple(r) for r in dc.judge(index, bench).collect()), key=repr) == brute(rows, items)


def test_words_of_a_long_text_are_numbered_alike(monkeypatch):
    text = " été,B b  " * 50 + "last" + "," * 30
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(dc, "SPLIT_BYTES", size)
        rank = {}
        numbers = dc._numbered(text, rank)
        names = {i: w for w, i in rank.items()}
        assert [names[i] for i in numbers.tolist()] == dc.words(text)
    assert len(dc._numbered("", {})) == 0


def test_long_items_are_cut_into_parts(spark, make_docs, monkeypatch):
    """No window is lost at a cut, and a part has the words of its bound, or one piece."""
    monkeypatch.setattr(dc, "PIECE_WORDS", 20)
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 9000, n))) for i, n in enumerate((13, 20, 21, 28, 29, 100, 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = list(dc.parts(bench, 45))
    assert all(sum(len(dc.words(t)) for _, t in part) <= 45 for part in found) and len(found) > 1
    windows = {(i, w) for part in found for i, t in part for w in brute_windows(t)}
    assert windows == {(str(i), w) for i, t in items for w in brute_windows(t)}
    monkeypatch.setattr(dc, "parts", lambda b, f=dc.parts: f(b, 45))
    rows = [(i, "x " + t + " y") for i, t in items] + [(90, None), (91, "v1")]
    assert sorted((tuple(r) for r in dc.contamination(make_docs(*rows), bench).collect()), key=repr) == brute(rows, items)


def brute_windows(text):
    w = words(text)
    return {tuple(w[i:i + 13]) for i in range(max(len(w) - 12, 1))}


def test_clean_keeps_the_rest(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contaminated_rows()
    docs = make_docs(*rows)
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    want = [i for i, *_, bad in brute(rows, ITEMS) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert dc.clean(docs.where("false"), bench).collect() == []
    assert dc.clean(docs, bench.where("false")).count() == len(rows)


def test_proximity(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "rare word")], "item_id long, text string")
    docs = make_docs((1, "delta x gamma x beta x alpha"), (2, "alpha " + "x " * 50 + "beta gamma delta"), (3, "word rare"), (4, None))
    got = {(r.doc_id, r.item_id) for r in dc.proximity(dc.build_index(docs), bench).collect()}
    assert got == {(1, "1"), (3, "2")}


def test_targets_by_resharing(make_docs):
    sizes = {"a": 2, "b": 10, "c": 60, "d": 1, None: 5, "": 0}
    docs = make_docs(*[(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, left = dict.fromkeys(order, 0.0), set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    got = {r.source: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mix(make_docs, spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), rng.choice(["a", "b", "b", "b", "c"])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "w w", None), (None, "w w w", "b"), rows[0], rows[0]]
    docs = make_docs(*rows)
    mixed = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in rows)
    source = {r[0]: r[2] for r in rows}
    taken, goal = Counter(), {}
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
        assert all(0 <= s < mixing.SHARDS for s in r.shards)
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - goal[s]) <= 20 for s in goal)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))
    unique = docs.where("doc_id > 0 and doc_id < 900")
    part = mixing.mix(unique)
    copies = mixing.shard_rows(unique, part).count()
    assert copies == sum(len(r.shards) for r in part.collect())
    assert mixing.mix(docs.where("false")).collect() == []


def test_splitting_tree_is_exact():
    units = np.array([1000, 3, 0, 517])
    quotas = mixing.splitting_tree(units, 7, 1)
    assert (quotas.sum(axis=0) == units).all() and (quotas >= 0).all()
    totals = quotas.sum(axis=1)
    assert totals.max() - totals.min() <= 3
    assert (quotas == mixing.splitting_tree(units, 7, 1)).all()
    # Shares of a source follow the hypergeometric mean over seeds.
    mean = np.mean([mixing.splitting_tree(units, 7, s)[0] for s in range(300)], axis=0)
    assert abs(mean[0] - 1000 / 7) < 3 and abs(mean[3] - 517 / 7) < 3


def test_splitting_tree_beyond_the_generator():
    units = np.array([1000, 3, 0, 517])
    quotas = mixing.splitting_tree(units, 7, 1, most=100)
    assert (quotas.sum(axis=0) == units).all() and (quotas >= 0).all()
    assert np.ptp(quotas.sum(axis=1)) <= 2 * (units.sum() // 100 + 1)
    many = np.full(82_000, 3 * mixing.BLOCKS)  # over 10^9
    assert (mixing.splitting_tree(many, 2).sum(axis=0) == many).all()


def test_shards_draw_each_unit_once(spark):
    units = {"a": 3 * mixing.BLOCKS + 77, "b": 5, None: 1}
    quotas = mixing.splitting_tree(np.array([*units.values()]), 6, 2)
    rows = [(s, n, {"a": 7, "b": 3, None: 1}[s], 11, quotas[:, i].tolist()) for i, (s, n) in enumerate(units.items())]
    df = spark.createDataFrame(rows, "source string, units long, stride long, start long, quotas array<long>")
    drawn, per_shard = Counter(), Counter()
    for r in mixing.dealt(df).collect():
        for epoch, shard in r.units:
            drawn[r.source, epoch * mixing.BLOCKS + r.block] += 1
            per_shard[r.source, shard] += 1
    assert drawn == Counter((s, u) for s, n in units.items() for u in range(n))
    assert per_shard == Counter({(s, j): int(quotas[j, i]) for i, s in enumerate(units) for j in range(6) if quotas[j, i]})


def test_taken_comes_from_the_dealt_units(make_docs, monkeypatch):
    """A unit that no shard draws is not taken."""
    docs = make_docs(*[(i, "w " * 10, "ab"[i % 2]) for i in range(200)])
    assert sum(r.taken for r in mixing.mix(docs).collect()) > 0
    monkeypatch.setattr(mixing, "splitting_tree", lambda units, shards, seed: np.zeros((shards, len(units)), dtype=np.int64))
    assert {(r.taken, len(r.shards)) for r in mixing.mix(docs).collect()} == {(0, 0)}
