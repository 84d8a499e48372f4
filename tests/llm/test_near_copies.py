from collections import Counter, defaultdict

import numpy as np
import pytest

from haulbook.llm import near_copies as nc
from haulbook.llm.components import components


def shingles(text):
    words = (text or "").split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def brute_classes(rows, least=0.8):
    """doc_id to the smallest doc_id reachable over pairs that are similar enough."""
    held = [(i, shingles(t)) for i, t in rows]
    root = {n: n for n in range(len(rows))}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(held)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            both = sum((x & y).values())
            total = sum(x.values()) + sum(y.values()) - both
            if not total or both / total >= least:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        groups[find(n)].append(i)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[n][0], smallest[find(n)]) for n in range(len(rows)))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(words), edits(rng), replace=False):
            words[at] = f"w{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_classes_equal_brute_force(make_docs):
    rng = np.random.default_rng(5)
    base = [f"b{rng.integers(500)}" for _ in range(160)]
    texts = family(rng, base, 40, lambda r: int(r.integers(0, 7)))  # on both sides of the threshold
    other = [f"c{rng.integers(300)}" for _ in range(45)]
    texts += family(rng, other, 12, lambda r: int(r.integers(0, 3)))
    texts += [" ".join(f"u{rng.integers(10**6)}" for _ in range(60)) for _ in range(10)]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "few words"), (504, "few words"), (504, "few words"), (None, texts[0]), (505, texts[0])]
    got = Counter((r.doc_id, r.class_id) for r in nc.classes(make_docs(*rows)).collect())
    assert got == brute_classes(rows)


def test_given_documents(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    got = Counter((r.doc_id, r.class_id) for r in nc.classes(sample("documents")).collect())
    assert got == brute_classes(rows)


def test_one_row_of_a_class_stays(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs((3, text), (1, text + " more"), (1, text + " more"), (2, text), (9, "other text"), (None, text), (4, None), (5, ""))
    kept = nc.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]


def test_empty_table(make_docs):
    docs = make_docs((1, "x")).where("false")
    assert nc.classes(docs).collect() == [] and nc.keep_first(docs).collect() == []


def test_further_pairs_find_what_buckets_compared_with_others(spark):
    """Two texts that are alike, in a cluster whose star links went to a third."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(100)]
    x = base[:]
    x[10], x[50] = "x1", "x2"
    y = x[:]
    y[80] = "y1"
    rows = [(0, 0, 1, " ".join(base)), (0, 2, 2, " ".join(x)), (0, 3, 3, " ".join(y))]
    rows += [(0, 9 + i, 9 + i, t) for i, t in enumerate(family(rng, base, 30, lambda r: 8))]
    df = spark.createDataFrame(rows, "cluster long, class long, tid long, text string")
    for rare in (2, 24):
        pairs = {(r.a, r.b) for r in nc.further_pairs(df, 5, 0.8, rare).collect()}
        texts = {r[2]: shingles(r[3]) for r in rows}
        for a in texts:
            for b in texts:
                both = sum((texts[a] & texts[b]).values())
                if a > b and both / (sum(texts[a].values()) + sum(texts[b].values()) - both) >= 0.8:
                    assert (a, b) in pairs


@pytest.mark.parametrize("band", [3, 20, 500])
def test_banded_alignment(band):
    rng = np.random.default_rng(band)
    for _ in range(40):
        a = rng.integers(0, 40, rng.integers(0, 700)).astype(np.uint64)
        b = np.delete(a, rng.choice(len(a), min(len(a), 3), replace=False)) if len(a) else a
        if len(b):
            b[rng.integers(len(b))] = 99
        full = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            full[i + 1, 1:] = np.maximum.accumulate(np.maximum(full[i, 1:], np.where(b == a[i], full[i, :-1] + 1, 0)))
        best = int(full[-1, -1])
        unmatched = len(a) + len(b) - 2 * best
        got = nc.banded_matches(a, b, band)
        assert got == best if unmatched <= band else got <= best


def test_sketches_keep_text_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    same = (nc.order_sketches(a, 6) == nc.order_sketches(a[::-1].copy(), 6)).mean()
    assert (nc.order_sketches(a, 6) == nc.order_sketches(a.copy(), 6)).all() and same < 0.1


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(20)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_contracted_links_have_the_same_components(spark):
    import random

    from haulbook.llm.components import components, contracted

    draw = random.Random(4)
    rows = [(member, head) for member in range(1000, 1200) for head in draw.sample(range(60), draw.randint(1, 3))]
    rows += [(5000 + i, 100 + i % 7) for i in range(50)] + rows[:20]
    links = spark.createDataFrame(rows, "a long, b long")
    roots = lambda edges: {tuple(r) for r in components(edges).collect()}
    assert roots(contracted(links)) == roots(links)
    assert contracted(links).count() < links.distinct().count()


def components_plans(monkeypatch, call):
    """The physical plans of the rounds that the call takes."""
    from haulbook.llm import components as module

    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    call()
    return [plan for label, plan in plans if label == "component-edges"]


def test_a_round_does_not_plan_again_what_made_its_links(spark, monkeypatch):
    """The driver held 41 exchanges of the first round over links that were not written yet."""
    from haulbook.llm.components import contracted

    links = spark.createDataFrame([(50 + i, j) for i in range(20) for j in (i, i + 1)], "a long, b long")
    shuffled = links.groupBy("a", "b").count().repartition("b").distinct().select("a", "b")
    plans = components_plans(monkeypatch, lambda: components(contracted(shuffled)))
    assert plans and not any("Window" in p for p in plans)


def test_tables_that_grow_with_the_data_are_joined_by_sorting(spark, monkeypatch):
    """Several tables of nodes at once, each ten times its packed file, went through the driver."""
    links = spark.createDataFrame([(i + 1, i) for i in range(8)], "a long, b long")
    plans = components_plans(monkeypatch, lambda: components(links))
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)

    written, write = {}, nc.materialize
    monkeypatch.setattr(nc, "materialize", lambda df, label: written.update({label: df._jdf.queryExecution().executedPlan().toString()}) or write(df, label))
    rng = np.random.default_rng(4)
    texts = family(rng, [f"b{i}" for i in range(60)], 30, lambda r: int(r.integers(0, 9)))
    out = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans = [written[label] for label in ("near-wanted", "near-links", "near-placed")]
    for p in [*plans, out._jdf.queryExecution().executedPlan().toString()]:
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_garbage_of_the_driver_is_collected_after_each_round(spark, monkeypatch):
    from haulbook.llm import components as module
    from haulbook.session import free_driver

    freed = []
    monkeypatch.setattr(module, "free_driver", lambda session: freed.append(session) or free_driver(session))
    links = spark.createDataFrame([(i + 1, i) for i in range(8)], "a long, b long")
    assert len(components_plans(monkeypatch, lambda: components(links))) == len(freed) > 0


def test_stars_take_no_round(spark, monkeypatch):
    links = spark.createDataFrame([(9, 1), (8, 1), (3, 2), (2, 2)], "a long, b long")
    assert len(components_plans(monkeypatch, lambda: components(links))) == 0
    for rows in ([(9, 1), (9, 1)], [(9, 5), (5, 1)], [(9, 5), (9, 1)]):
        got = sorted(tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).collect())
        assert got == sorted({(n, 1) for r in rows for n in r})
    assert not components(links.where("a < 0")).collect()


def test_components_of_two_graphs_in_the_same_rounds(spark, monkeypatch):
    from haulbook.llm.components import components_of_both

    rng = np.random.default_rng(3)
    one, other = ([(int(a), int(b)) for a, b in rng.integers(-20, 60, (n, 2))] for n in (40, 25))
    one, other = (spark.createDataFrame(rows, "a long, b long") for rows in (one, [*other, ((1 << 62) - 1, 1 << 61), (None, 3)]))
    roots = lambda df: sorted(tuple(r) for r in df.collect())
    both = []
    rounds = len(components_plans(monkeypatch, lambda: both.extend(components_of_both(one, other))))
    alone = []
    each = [len(components_plans(monkeypatch, lambda g=g: alone.append(components(g)))) for g in (one, other)]
    assert [roots(x) for x in both] == [roots(x) for x in alone] and 0 < rounds <= max(each)


def open_cluster(spark, texts):
    return spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts)], "cluster long, class long, tid long, text string")


def alike(x, y, least=0.8):
    both = sum((x & y).values())
    return both >= least * (sum(x.values()) + sum(y.values()) - both)


def test_candidates_of_a_cluster_that_is_alike_but_not_enough(spark):
    """The candidates grow with the texts (and the depth of the groups), not with their pairs."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    found = {}
    for n in (200, 800):
        pairs, stars, _ = nc.candidates(open_cluster(spark, family(rng, base, n, lambda r: 2)), 5, 0.8)
        found[n] = pairs.count() + stars.count()
    assert found[200] < 10 * 200 and found[800] < 20 * 800  # all pairs: 100 and 400 a text


def test_candidates_connect_what_is_alike(spark):
    """Nested families: what pairs and stars connect is what all pairs would."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for variant in family(rng, base, 6, lambda r: 3):
        for inner in family(rng, variant.split(), 4, lambda r: 2):
            texts += family(rng, inner.split(), 4, lambda r: int(r.integers(0, 3)))
    texts = list(dict.fromkeys(texts))
    held = [shingles(t) for t in texts]
    wanted = {(a, b) for a in range(len(texts)) for b in range(a) if alike(held[a], held[b])}
    for rare in (2, 5, 24):
        pairs, stars, _ = nc.candidates(open_cluster(spark, texts), 5, 0.8, rare)
        got = {(r.a, r.b) for r in pairs.union(stars.select("a", "b")).collect()}
        got = {(max(p), min(p)) for p in got} & wanted
        roots = lambda edges: {tuple(r) for r in components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        assert roots(got) == roots(wanted)


def test_texts_with_moved_blocks_meet_beside_the_star(spark):
    stars = spark.createDataFrame([(7, 2, 1), (7, 3, 1), (7, 4, 1)], "g long, a long, b long")
    members = spark.createDataFrame([(7, i, i, -float(i > 0)) for i in range(1, 5)] + [(8, 3, 3, -1.0), (7, 9, 9, 5.0)], "g long, tid long, class long, f double")
    links = spark.createDataFrame([(2, 1), (1, 4)], "a long, b long")
    assert {(r.a, r.b) for r in nc.beside_stars(stars, members, links).collect()} == {(3, 1), (3, 2), (4, 3)}
