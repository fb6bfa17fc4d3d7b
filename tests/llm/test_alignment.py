from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from eventlens.llm import alignment
from eventlens.llm.queries import QUERIES
from tests.llm.test_tokens import strings

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(texts):
    """Tokens (id, bytes) of each text by both libraries; None where the bytes aren't the text's."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment._byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        same = b"".join(t for _, t in x) == (" " + text).encode() == b"".join(t for _, t in y)
        out.append((x, y) if same else None)
    return out


def brute(docs):
    links, rows, count = [], [], Counter()
    for _, tokens in zip(docs, encoded([t for _, t in docs]), strict=True):
        own, groups = [], []
        if tokens:
            x, y = tokens
            i = j = x_to = y_to = 0
            ax, by = [], []
            while i < len(x) or j < len(y):
                if x_to <= y_to and i < len(x):
                    ax.append((x[i][0], x_to, x_to + len(x[i][1])))
                    x_to += len(x[i][1])
                    i += 1
                else:
                    by.append((y[j][0], y_to, y_to + len(y[j][1])))
                    y_to += len(y[j][1])
                    j += 1
                if x_to == y_to:
                    own += [(p, q) for p, s, e in ax for q, u, v in by if s < v and u < e]
                    groups.append(",".join(str(p[0]) for p in ax) + "|" + ",".join(str(q[0]) for q in by))
                    ax, by = [], []
            rows.append((len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            rows.append((0, 0, 0, ""))
        links.append(own)
        count.update(own)
    most = defaultdict(int)
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    out = []
    for (doc, _), own, (n_a, n_b, n_g, digest) in zip(docs, links, rows, strict=True):
        best = sum(count[p] == most[p[1]] for p in own)
        out.append((doc, n_a, n_b, n_g, len(own), best, sum(count[p] for p in own), digest))
    return sorted(out, key=str)


def test_alignment(spark, monkeypatch):
    r = random.Random(4)
    words = [w for w in " ".join(strings(200, 9)).split(" ") if w] + ["the", "tokenizer", "Straße", "\n\n", "don't", "a\nb"]
    texts = [None, "", " ", "  ", "a ", " a", "a  b", "a\n b", "a\n  b", "\n", "x" * 3000, "漢字" * 200, "▁", "a▁b", "  a", "　 　b"]
    texts += strings(300, 5) + [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(150)]
    texts += ["one text that a third of all rows hold, the the the"] * 200 + ["\U0001F600 <|endoftext|> <s> </s> 12345"]
    docs = [(i % 600, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(t, i, "x", 3) for i, t in docs], "text string, doc_id long, pair string, block int").repartition(4)
    want = brute(docs)
    assert sorted(map(tuple, alignment.aligned(df, A, B).collect()), key=str) == want
    assert alignment.aligned(df.limit(0), A, B).count() == 0
    alone = alignment.aligned(df.where("text is null or text = ''"), A, B).collect()
    assert len(alone) > 1 and all(x.n_links == 0 and x.groups_sha256 == "" for x in alone)


def test_small_blocks_and_a_short_memory(monkeypatch):
    texts = [" ".join(f"w{i % 7} the long{'x' * (i % 90)}" for i in range(n % 40)) for n in range(120)]
    batch = pa.record_batch({"doc_id": pa.array(range(120), pa.int64()), "text": texts})

    class Docs:
        schema = {"doc_id": type("C", (), {"dataType": type("T", (), {"simpleString": lambda s: "bigint"})()})()}

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            return pa.Table.from_batches(list(fn(iter([batch]))))

    def links() -> Counter:
        out = Counter()
        found = alignment.indexed(Docs(), A, B, "doc_id", "text")
        for row in found.to_pylist():
            if row["pair"] is not None:
                out[row["pair"]] += row["pair_links"]
        assert sum(out.values()) == sum(x or 0 for x in found["n_links"].to_pylist())
        return out

    whole = links()
    monkeypatch.setattr(alignment, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(alignment, "REMEMBERED", 1000)
    monkeypatch.setattr(alignment, "SPREAD", 7)
    assert links() == whole


def test_planes_give_back_what_they_hold():
    r = np.random.default_rng(2)
    key = np.unique(np.concatenate([r.integers(0, 40 << alignment.DOC_BITS, 4000), np.arange(3000) + (50 << alignment.DOC_BITS)]))
    times = r.integers(1, 700, len(key))
    pair, n_docs, n_links, planes = alignment.bitmaps(key, times)
    score = r.integers(0, 1000, (len(pair), 2))
    want = np.zeros((alignment.BLOCK_DOCS, 2), np.int64)
    for k, t in zip(key, times, strict=True):
        want[k & (alignment.BLOCK_DOCS - 1)] += t * score[np.searchsorted(pair, k >> alignment.DOC_BITS)]
    assert (alignment.returned(planes, score) == want).all()
    assert n_docs.sum() == len(key) and n_links.sum() == times.sum()
    assert max(len(x) for planes in planes.to_pylist() for x in planes) == alignment.BITSET


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, folder).collect()), key=str) == brute(docs)
