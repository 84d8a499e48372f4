"""Packing: the ids of the named library, pieces whole and gapless, and best two fit one by one."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulbook.llm import packing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*packing.vocabulary())


def test_quick_ids_are_exact_for_every_known_code_point(encoder):
    texts = [f"a{c}b 1{c}2 {c}  {c}{c} !{c}?'s{c}" for c in map(chr, range(0x10000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    quick = encoder.quick.encode_ordinary_batch(texts)
    assert quick == [e.ids for e in encoder.exact.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b", "\U0001f600 x \U00010940", "࢏౜ a", "x  y\n\n z", "the end's"])
def test_ids(encoder, exact, text):
    assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_long_texts_in_chunks(encoder, exact, monkeypatch):
    draw = random.Random(2)
    words = ["on", " on", "  two", "\n", "it's", " 12", "!?", "é", " 中", "\t", " a", "<|endoftext|>"]
    monkeypatch.setattr(packing, "CHUNK_CHARS", 50)
    for _ in range(60):
        text = "".join(draw.choices(words, k=400))
        assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def one_by_one(counts, size):
    """Best two fit, a sequence at a time."""
    left = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    out = []
    while left:
        bin, room, rest = [], size, []
        for n in left:
            if n <= room:
                bin.append(n)
                room -= n
            else:
                rest.append(n)
        if room:
            last, best = bin[-1], (bin[-1],)
            for i, a in enumerate(sorted(rest)):
                for b in sorted(rest)[i + 1 :]:
                    if sum(best) < a + b <= room + last:
                        best = (a, b)
            if len(best) == 2:
                bin[-1:] = best
                rest.append(last)
                for n in best:
                    rest.remove(n)
        out.append(sorted(bin, reverse=True))
        left = sorted(rest, reverse=True)
    return out


def test_patterns_are_best_two_fit():
    draw = random.Random(7)
    for _ in range(300):
        size = draw.choice([10, 20, 37])
        counts = {draw.randint(1, size): draw.randint(1, 9) for _ in range(draw.randint(1, 9))}
        bulk = [[n for n, k in used for _ in range(k)] for times, used in packing.patterns(counts, size) for _ in range(times)]
        assert bulk == one_by_one(counts, size)


def test_two_replace_one():
    # 9 leaves a gap of 3; 4 and 8 fill the sequence better.
    assert list(packing.patterns({9: 1, 8: 1, 4: 1}, 12))[0] == (1, [(8, 1), (4, 1)])


def check_pieces(rows, texts, exact, size):
    """Every document's ids, cut as stated, gapless in sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_doc) == sorted(texts)
    for doc, own in by_doc.items():
        ids = np.array([*exact.encode(texts[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert 0 < r.length <= size and (n == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_given_documents(spark, exact):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = packing.digests(docs).collect()
    n = check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, exact, packing.SIZE)
    assert n == -(-sum(r.length for r in rows) // packing.SIZE)  # no packing has fewer


def test_edges(make_docs, exact):
    long = " ".join(f"w{i} é" for i in range(9000))
    texts = {1: None, 2: "", 3: "a b c", 4: long, 5: "x" * 300_000, 6: "a<|endoftext|>", 7: "\U0001f600" * 500}
    docs = make_docs(*texts.items()).withColumns({n: F.lit("extra") for n in ("piece", "length", "task", "nth", "sequence_id", "ids")})
    check_pieces(packing.digests(docs).collect(), texts, exact, packing.SIZE)


def test_repeated_rows_ties_and_nulls(make_docs, spark):
    rows = packing.digests(make_docs(*[(1, "same text")] * 700, *[(None, "other")] * 300).repartition(7)).collect()
    assert len(rows) == 1000
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 1000
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // packing.SIZE)
    assert packing.digests(make_docs((1, "a")).limit(0)).collect() == []


def test_sequences_hold_the_ids(make_docs, exact):
    docs = make_docs(*[(i, f"Text number {i}. " * i) for i in range(60)])
    packed = packing.pack(docs, size=64)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 64 and r.starts[0] == 0
        ends = [*r.starts[1:], len(r.ids)]
        for doc, start, end in zip(r.doc_ids, r.starts, ends):
            whole = [*exact.encode(f"Text number {doc}. " * doc, add_special_tokens=False).ids, 0]
            own = r.ids[start:end]
            assert any(whole[i : i + len(own)] == own for i in range(len(whole)))
