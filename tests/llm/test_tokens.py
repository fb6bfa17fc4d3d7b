from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eventlens.llm import packing, token_counts
from eventlens.llm.queries import QUERIES

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "text string, ids long, doc_id long, n long"
PARTS = ["the", "an", " ", "  ", "\n", "é", "́", "x", "1", "12", "▁", "!!", "<|endoftext|>", "<s>", "日本", "\t",
         "\x1c", "　", "A", "ing", "ß", "🎉", "'s", ".", "İ", "ΑΣ", "\x00"]


def strings(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", "word " * 5000, "x" * 30_000, *strings(300)]
    rows = [(t, i % 3, i, None) for i, t in enumerate(texts)] + [(texts[3], 1, 3, 7), ("no id", 1, None, 7)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_prefix_has_its_exact_count():
    known = token_counts.PrefixCounts(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in strings(150, 2):
        want = [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]
        assert known.counts(text) == want, text
        for limit in (0, 1, 5):
            fits = max((i for i, n in enumerate(want, 1) if n <= limit), default=0)
            words = known.words(text) if text else []
            if want and want[-1] > limit:
                assert known.fits(words, limit) == fits, (text, limit)


def test_token_counts(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(docs, MODEL, limit=100).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for g, (i, t) in zip(got, rows, strict=True):
        assert (g.doc_id, g.n_bytes, g.n_tokens) == (i, len((t or "").encode()), len(model.encode(t or "")))
        assert g.fit_chars == len(t or "") or len(model.encode(t[: g.fit_chars])) <= 100
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0
    assert token_counts.prefix_tables(docs.where("doc_id = 1"), MODEL).first().counts == []


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.packed(docs, WORDS, size=64, end_id=1)
    bounds = packing.sequence_bounds(got, 64).orderBy("sequence_id").collect()
    assert all(b.n_tokens == 64 for b in bounds[:-1]) and all(b.padding >= 0 for b in bounds)
    by_doc = {}
    places = set()
    for p in sorted(got.collect(), key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 64
        for j in range(p.length):
            assert (p.sequence_id, p.offset + j) not in places
            places.add((p.sequence_id, p.offset + j))
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    assert len(places) == bounds[-1].sequence_id * 64 + bounds[-1].n_tokens
    for i, t in docs.where("doc_id <> 3").select("doc_id", "text").collect():
        pieces = sorted(by_doc[i])
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for _, ids, _ in pieces for x in ids] == want and {n for *_, n in pieces} == {len(want)}
    assert sum(len(ids) for _, ids, _ in by_doc[3]) == 2 * by_doc[3][0][2]
    assert packing.packed(docs.limit(0), WORDS).count() == 0


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in QUERIES["op1_token_counts"](spark, folder).collect():
        n = len(model.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 4096)
    tokenizer = Tokenizer.from_file(WORDS)
    for r in QUERIES["op10_packing"](spark, folder).collect():
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids + [1]
        own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(own))


@pytest.mark.parametrize("make", [lambda: token_counts.PrefixCounts(MODEL), lambda: packing.WordIds(WORDS)])
def test_memory_is_bounded_by_bytes(make, monkeypatch):
    """Texts without spaces are one word each: none of them stays, and results don't change."""
    r = random.Random(5)
    letters = "日本語中文字符漢字仮名abc"
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in [300] * 400 + [65, 64, 63] * 50]
    monkeypatch.setattr("eventlens.llm.memo.PASSING", 3_000)
    known = make()
    known.limit = 2_000
    before = make()
    for a in range(0, len(texts), 50):
        known.learn(texts[a : a + 50])
        for text in texts[a : a + 50] * 2:
            assert [known[text]] == list(before.compute([text]))
            assert sum(map(len, known.passing)) == known.passed <= 3_000
    # A batch is learned in one go, so a generation exceeds its limit by one batch at most.
    assert 4 * sum(map(len, [*known, *known.old])) < 2 * (2_000 + 50 * (4 * 64 + 32))
    assert max(map(len, known), default=0) <= 64
