import hashlib
import re

import numpy as np
import pytest

from haulbook.llm import repeats as rp


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by the definition; ids in order."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s:s + length]
            if window in seen:
                mark[s:s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[i] = (i, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return sorted((out[i] for i, _ in rows), key=repr)


def texts(seed, n=40):
    """Documents that share passages with other surroundings, in UTF-8 of all widths."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh é漢😀\n")
    word = lambda k: "".join(rng.choice(letters, k))
    shared = [word(int(rng.integers(60, 400))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [word(int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[rng.integers(len(shared))]
            a = int(rng.integers(0, 30))
            parts += [s[a:], word(int(rng.integers(0, 3)))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("hot", [2, rp.HOT])
def test_equals_brute_force(make_docs, hot):
    rows = [(50 - i, t) for i, t in enumerate(texts(1))]
    rows += [(200, "ab" * 400), (201, "a" * 350), (202, None), (203, ""), (204, "x" * 99), (205, "x" * 100), (206, rows[0][1])]
    got = sorted((tuple(r) for r in rp.repeats(make_docs(*rows), hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_given_documents(sample):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    got = sorted((tuple(r) for r in rp.repeats(sample("documents")).collect()), key=repr)
    assert got == brute(rows)


def test_repeated_rows_are_one_document(make_docs):
    a, b = "".join(map(chr, range(200, 500))), "q" * 40 + "".join(map(str, range(100)))
    rows = [(7, a), (7, a), (None, b), (8, b + "!" + a)]
    got = sorted((tuple(r) for r in rp.repeats(make_docs(*rows)).collect()), key=repr)
    assert got == brute(rows)
    kept = {r.doc_id: r.text for r in rp.remove(make_docs(*rows)).collect()}
    assert kept == {7: a, None: b, 8: "!"}


def test_texts_stay_valid(make_docs):
    rows = [(i, t) for i, t in enumerate(texts(3))] + [(90, None)]
    docs = make_docs(*rows)
    out = rp.remove(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    wanted = {r[0]: r for r in brute(rows)}
    for r in out.collect():
        if r.text is None:
            assert r.doc_id == 90 and r.n_chars is None
            continue
        assert r.n_chars == len(r.text)
        extra = len(r.text.encode()) - (wanted[r.doc_id][1] - wanted[r.doc_id][2])
        assert 0 <= extra <= 6 * max(wanted[r.doc_id][3], 0)


def test_empty_table(make_docs):
    docs = make_docs((1, "x")).where("false")
    assert rp.repeats(docs).collect() == [] and rp.remove(docs).collect() == []


def test_run_index_statistics():
    """Each place's longest match with its neighbour in suffix order is the longest there is on
    that side; together with the other side's it is the matching statistic."""
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 60), rng.integers(1, 4, 20), np.tile(rng.integers(1, 4, 9), 5), [0]]).astype(np.int16)
    index = rp.RunIndex(text)
    order = rp.suffix_array(text)
    raw = text.tolist()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    match, where = index.statistics(np.arange(len(raw)))
    for k, p in enumerate(order.tolist()):
        if not k:
            continue
        q = int(order[k - 1])
        n = 0
        while max(p, q) + n < len(raw) and raw[p + n] == raw[q + n]:
            n += 1
        assert match[p] == n and (n == 0 or where[p] == q)
    assert len(index.run_chars) < len(raw)


def test_stretches_go_on_before_a_task_has_read_all():
    """What a task holds does not grow with its partition."""
    import pyarrow as pa

    rng, read = np.random.default_rng(5), []
    shared = bytes(rng.integers(97, 123, 400, dtype=np.uint8)).decode()

    def batches():
        for doc in range(30):
            read.append(doc)
            own = bytes(rng.integers(97, 123, 600, dtype=np.uint8)).decode()
            yield pa.RecordBatch.from_pydict({"doc": [doc], "text": [own + shared]})

    first = next(iter(rp._stretch_rows(100, 24, most=50)(batches())))
    assert len(first["gram"]) and len(read) < 10


def _batches(rows, size=5000):
    import pyarrow as pa

    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist([dict(zip(("gram", "doc", "start", "bytes"), r)) for r in rows[i:i + size]])


def _peak(work):
    """What the work returns, and the most bytes it held meanwhile."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_index_holds_little_beside_its_stretches():
    """A task's worker stands beside an executor whose heap is full: 222 MB of one were too many."""
    rng, rows = np.random.default_rng(6), []
    for gram in range(8000):
        shared, *own = (bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in (110, 60, 60, 20))
        rows += [(gram, 2 * gram, 5, own[0] + shared), (gram, 2 * gram + 1, 9, shared + own[1]), (gram, -1, 7, own[2] + b"A" + shared[1:])]
    work = rp._index(100)
    found, most = _peak(lambda: [(d, s, n) for out in work(_batches(rows)) for d, s, n in zip(out["doc"], out["start"], out["starts"])])
    assert set(found) == {(-1, 28, 10)} | {(2 * gram + 1, 9, 11) for gram in range(8000)}
    assert most < 60e6
    # As many stretches as one gram may have are indexed together.
    stretches = [bytes(rng.integers(97, 123, 150, dtype=np.uint8)) for _ in range(10_000)]
    starts, most = _peak(lambda: rp.repeated_starts(stretches + stretches[:1]))
    assert [len(s) for s in starts] == [0] * 10_000 + [51]
    assert most < 45 * 150 * 10_000


def test_strings_of_hot_grams_go_on_in_parts():
    raw = bytes(np.random.default_rng(7).integers(97, 123, 176 * 8000, dtype=np.uint8))
    rows = [(1, i, 3, raw[176 * i:176 * i + 176]) for i in range(8000)]
    parts = [len(out["name"]) for out in rp._hot_strings(100)(_batches(rows, len(rows)))]
    assert sum(parts) == 8000 * 77 and max(parts) < 300_000
