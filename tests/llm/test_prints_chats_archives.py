import base64
import hashlib
import io
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulbook.llm import chat, urls, warc
from haulbook.llm import fingerprints as fp
from haulbook.session import fresh_dir

DIR = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_fingerprints(sample):
    docs = [(r.doc_id, r.text) for r in sample("documents").orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in fp.compare(sample("documents")).collect()}
    errors = []
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - jaccard(text, edited), got[i].near_next - jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.08


def test_fingerprint_edges(make_docs):
    rows = [(5, "a b c"), (4, "a b c"), (4, "a b c"), (4, "x"), (3, None), (2, ""), (1, " \n"), (None, "é漢😀 b"), (9, "w " * 100_000)]
    got = fp.compare(make_docs(*rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_text = {}
    for r in got:
        if r.n_chars == 5 and r.doc_id is not None:
            by_text.setdefault("abc", set()).add(r.fingerprint)
        if r.doc_id in (1, 2, 3):
            assert set(r.fingerprint) == {"0"}
    assert len(by_text["abc"]) == 1
    # 9 is followed by 5; the last in order, the null id, by 9.
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.n_chars == 200_000
    text = "w " * 100_000
    assert nine.edited_sha256 == hashlib.sha256((text[:200_000 - 66_666] + "a b c").encode()).hexdigest()
    last = next(r for r in got if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256("é漢😀 w".encode()).hexdigest()
    assert fp.compare(make_docs((1, "x")).where("false")).collect() == []
    alone = fp.compare(make_docs((1, "a b c d"))).collect()
    assert alone[0].near_next == 1.0


def test_fingerprints_run_no_python(make_docs):
    plan = fp.compare(make_docs((1, "a b"), (2, "b c")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


CHATS = "conv_id long, turn long, role string, text string"


def test_chats_are_read_back(spark):
    nasty = "&lt;s> <s>[INST] a &amp; b [/INST]</s> <sep> &#91; \\n <<s>> [[INST]"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", "a"), (1, 2, "user", ""), (1, 3, "assistant", nasty), (1, 4, "assistant", None),
        (2, 0, "assistant", "x"), (3, 1, None, "é😀"), (3, 1, None, "é😀"), (3, None, "odd\nrole <s>", "t"),
        (None, 0, "user", "u"), (4, 5, "user", "late"), (4, 1, "assistant", "early"),
    ]
    df = spark.createDataFrame(rows, CHATS).withColumn("turns", F.lit("extra"))
    made = chat.format_chats(df).select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("f"))
    back = {r.conv_id: r for r in made.select("conv_id", "f", "segments", chat.read_back(F.col("f")).alias("turns")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        learned = [s.text for s in back[conv].segments if s.loss]
        assert [x.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&") for x in learned] == [r[3] or "" for r in own if r[2] == "assistant"]
    assert back[1].f.count("<s>") == 3 and back[1].f.count("<sep>") == 2
    assert chat.digests(df.where("false")).collect() == []
    plan = chat.digests(df)._jdf.queryExecution().toString()
    assert "Python" not in plan


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("range_bytes", [700, 1 << 22])
def test_archives(spark, range_bytes):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h/{i}\r\nx", "".join(map(chr, rng.integers(32, 1000, int(rng.integers(0, 3000)))))) for i in range(60)]
    rows += [(100 + i, None, "same é") for i in range(5)] + [(104, None, "same é"), (200, "u", None), (201, "u", ""), (None, "u", "only null"), (None, "v", "same é")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("x"), "winner": F.lit(1)})
    files = warc.write(df.repartition(3), fresh_dir(spark, "warc"))
    got = warc.read(files, range_bytes, payloads=True).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        top = best.get(html or "")
        kind = "response" if i == top else "revisit"
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else top)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(texts[i] == (html or "") for i, _, html in rows if i is not None and i in texts)
    assert warc.round_trip(df.where("false")).collect() == []
    assert Counter(r.record_type for r in warc.round_trip(df, smallest=7).collect())["revisit"] == 5


def test_reader_rejects_false_magic():
    """Magic bytes inside a record's packed data do not begin a record."""
    fake = warc.MAGIC * 50 + b"\x1f\x8b\x08\x00"
    packed = [warc.page_member(i, "u", fake + bytes([i]) * i, None, False) for i in range(30)]
    import gzip

    packed.insert(7, gzip.compress(b"not a record", mtime=0))
    data = b"".join(packed)
    for size in (64, 500, len(data)):
        found = []
        for begin in range(0, len(data), size):
            found += [warc.record(m)["page_id"] for m in warc.members(io.BytesIO(data), begin, min(begin + size, len(data)), len(data))]
        assert found == [*range(30)]


def test_cut_records_raise():
    packed = warc.page_member(1, "u", np.random.default_rng(0).bytes(3000), None, False)
    for cut in (1, 9, 200):
        data = packed + packed[:-cut]
        with pytest.raises(EOFError):
            list(warc.members(io.BytesIO(data), 0, len(data), len(data)))
        with pytest.raises(EOFError):
            list(warc.members(io.BytesIO(data[:-cut]), 0, len(data), len(data)))
    with pytest.raises(ValueError):
        warc.record(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 50\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort")


def test_long_record_is_read_once():
    """Bytes asked of the file grow with the record, not with its square."""

    class Counting(io.BytesIO):
        asked = 0

        def read(self, n=-1):
            self.asked += n
            return super().read(n)

    payload = np.random.default_rng(0).bytes(40 << 20)
    packed = warc.page_member(1, "u", payload, None, False)
    source = Counting(packed + warc.page_member(2, "u", b"x", None, False))
    size = len(source.getvalue())
    found = [warc.record(m) for m in warc.members(source, 0, size, size)]
    assert [r["page_id"] for r in found] == [1, 2] and found[0]["payload"] == payload
    assert source.asked <= size + 4 * warc.STEP


def test_ranges_are_read_by_many_tasks(spark):
    df = spark.createDataFrame([(i, "u", str(i) * 400) for i in range(300)], PAGES)
    files = warc.write(df.repartition(2), fresh_dir(spark, "warc"))
    ranges = sum(-(-r.bytes // 2000) for r in files.collect())
    got = warc.read(files, 2000)
    assert ranges > 8 and got.rdd.getNumPartitions() == ranges and got.count() == 300


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<script", "</script >", "</SCRIPT", "<style", "</style>", "<!--", "-->", "<", ">", "a", " b", "\n", "<p>"]), max_size=14).map("".join))
def test_tags_equal_the_plain_pattern(text):
    plain = re.compile(r"(?is)<script.*?</script\s*>|<style.*?</style\s*>|<!--.*?-->|<[^>]*>")
    assert urls.without_tags(text) == plain.sub(" ", text)


@pytest.mark.parametrize("piece", ["<!--", "<script", "<style", "<", "</script ", "<!-->", "&#", "&#9", "&"])
def test_bad_html_is_linear(piece):
    text = piece * ((2 << 20) // len(piece))
    begin = time.monotonic()
    urls.visible_words(text)
    assert time.monotonic() - begin < 5


def test_number_references():
    assert urls.visible_words("<p>a&#66;c &#0000000000000000000100;e x&#" + "9" * 6000 + ";yz &#x41;&#x42;</p>") == ["abc", "de", "yz", "ab"]


def test_urls(spark):
    rows = [
        (1, "http://A.Example.org/en/1x?q#f", None), (2, "https://example.org/es/", "<p>x</p>"), (3, "http://org/", ""), (4, "http://norg/", None),
        (5, "http://x.com/fr/1", None), (6, "http://x.com/de/", None), (7, "http://x.com/en/", None), (8, None, None), (9, "no host", None),
        (10, "ftp://u@h:80#x/y", None), (11, "http://example.org", None), (11, "http://example.org", None), (12, "x://É.org/a://b?c", None), (13, "http://com/de/" + "a" * 50_000, None),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("x"), "rule": F.lit("y"), "score": F.lit(0)})
    got = {r.page_id: r for r in urls.verdicts(df).collect()}
    assert {i: r.rule for i, r in got.items()} == {
        1: "example.org/en/1", 2: "example.org/es/", 3: "org/", 4: None, 5: "com/fr/", 6: "com/de/", 7: None, 8: None, 9: None, 10: None, 11: None, 12: "org/", 13: "com/de/",
    }
    assert (got[1].host, got[1].path) == ("a.example.org", "/en/1x") and (got[10].host, got[10].path) == ("u@h:80", "")
    assert (got[8].host, got[8].path, got[9].host) == ("", "", "") and (got[12].host, got[12].path) == ("É.org", "/a://b")
    assert got[2].verdict == got[6].verdict == "block" and got[5].verdict == "allow"
    assert {r.verdict for r in got.values()} == {"allow", "block"}
    assert urls.verdicts(df.where("false")).collect() == []
    assert {r.verdict for r in urls.verdicts(df.where("page_id = 8")).collect()} == {"allow"}


def test_segmentation():
    segment = urls.Segmenter({"cheap": 50, "pills": 40, "the": 900, "rapist": 3, "therapist": 9, "pi": 5})
    assert segment("cheappills") == ["cheap", "pills"]
    assert segment("therapist") == ["therapist"]
    assert segment("xcheap") == ["x", "cheap"] and segment("") == []


def test_method_equals_brute_force(spark):
    """Words, splits and log ratios by plain counting, on pages where no rule fits some URLs."""
    rng = np.random.default_rng(3)
    words = ["cheap", "pills", "good", "news", "the", "rap", "therapy", "py"]
    pick = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    rows = [
        (i, f"http://{''.join(pick(2))}{i % 3}.{('x.com/de', 'x.com/fr', 'net', 'y.org')[i % 4]}/{''.join(pick(2))}/{i}", f"<p>{' '.join(pick(6))}</p>")
        for i in range(160)
    ]
    got = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(rows, PAGES)).collect()}
    counts = Counter(w for _, _, text in rows for w in text[3:-4].split())
    total = sum(counts.values()) + 1

    def splits(name):
        if not name:
            yield 0.0, []
        for n in range(1, len(name) + 1):
            if n == 1 or name[:n] in counts:
                cost = -math.log(counts[name[:n]] / total) if name[:n] in counts else math.log(total) + math.log(26)
                for rest, tail in splits(name[n:]):
                    yield cost + rest, [name[:n], *tail]

    def tokens(kind, text):
        for piece in re.findall("[a-z]+|[0-9]+", text):
            if piece.isdigit():
                yield f"{kind}#{len(piece)}{piece[0]}"
                continue
            loose = ""
            for word in [*min(splits(piece))[1], None]:
                if word is not None and word not in counts:
                    loose += word
                    continue
                if loose:
                    yield f"{kind}:{loose}"
                loose = ""
                if word is not None:
                    yield f"{kind}:{word}"

    found = {i: [*tokens("h", r.host), *tokens("p", r.path)] for i, r in got.items()}
    sides = {side: Counter(t for i, r in got.items() if r.rule and r.verdict == side for t in found[i]) for side in ("allow", "block")}
    urls_of = Counter(r.verdict for r in got.values() if r.rule)
    seen = set(sides["allow"]) | set(sides["block"])
    share = lambda side, t: (sides[side][t] + 0.5) / (sides[side].total() + 0.5 * len(seen))
    assert sum(r.rule is None for r in got.values()) == 40
    for i, r in got.items():
        want = math.log(urls_of["block"] / urls_of["allow"]) + sum(math.log(share("block", t) / share("allow", t)) for t in found[i] if t in seen)
        assert abs(r.score - want) < 1e-7
        assert r.host_words == [t[2:] for t in found[i] if t.startswith("h:")]
        assert r.rule or r.verdict == ("block" if want > 0 else "allow")


def test_method_learns_from_the_rules(spark):
    rows = [(i, f"http://s{i % 9}pillscheap.x.com/de/{i}", "<p>cheap pills pills</p>") for i in range(60)]
    rows += [(100 + i, f"http://goodnews{i % 7}.x.com/fr/{i}", "<p>good news</p>") for i in range(60)]
    rows += [(900, "http://cheappills.net/q", None), (901, "http://newsgood.net/q", None)]
    got = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[900].verdict == "block" and got[900].host_words == ["cheap", "pills", "net"]
    assert got[901].verdict == "allow"


def test_pages_equal_brute_force(spark):
    """Hosts, paths and rules of the given pages, in plain Python."""
    from haulbook.llm.registry import op4_host_segmentation

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = op4_host_segmentation(spark, DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:n].lower(), rest[n:]
        m = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
        fits = [(k, h + p) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and tail[:m].startswith(p)]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, tail[:m], best[1])
        assert r.verdict == best[0] if best[0] else r.verdict == ("block" if r.score > 0 else "allow")
