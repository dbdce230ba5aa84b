"""Byte-level BPE and best-fit packing against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadence.llm import bpe, packing
from tests.conftest import SF_CHECK
from tests.llm.test_native_ops import ODD, SCHEMA

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
HARD = [
    "", " ", "  ", "a", " \n\n x", "don't  we'll\tgo\r\n\x1cx\x85y\xa0z 12345  ", "\U0001f600 é̀ ", "<|endoftext|> x", "hello <|endoftext|> world<|endoftext|>",
    "a" * 5000, "ab" * 4000 + "c", "thndhaor" * 900, "日本語テキスト" * 50, "  　x  y", "=" * 300 + " " * 300 + "b",
    " lead", "trail ", "two  spaces here", "x" * 3 + "\x00" * 7 + "\x7f",
]


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


def test_rank_queue_pops_in_order():
    rng = random.Random(3)
    q = bpe.RankQueue(50_256)
    want = {}
    for _ in range(3000):
        r, p = rng.randrange(50_256), rng.randrange(10**6)
        q.push(r, p)
        want.setdefault(r, []).append(p)
    for r in sorted(want):
        assert q.pop() == (r, want[r])
    assert q.pop() is None and not q.top and not any(q.words)


def test_codec_matches_library_on_hard_texts(enc):
    c = bpe.Codec(RANKS, P.PATTERN)
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ab \n.é0'ts") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    assert not c.queue.buckets


def test_codec_with_ranks_in_any_order():
    """Tables whose longer tokens may rank first: plain scanning is the law."""
    rng = random.Random(7)
    for _ in range(200):
        c = bpe.Codec.__new__(bpe.Codec)
        toks = {bytes([b]) for b in b"abc"}
        while len(toks) < 25:
            toks.add(rng.choice(sorted(toks)) + rng.choice(sorted(toks)))
        order = sorted(toks)
        rng.shuffle(order)
        c.ranks = {t: i for i, t in enumerate(order)}
        c.longest, c.queue = max(map(len, order)), bpe.RankQueue(len(order))
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        parts = [piece[i:i + 1] for i in range(len(piece))]
        if piece in c.ranks:
            parts = [piece]
        while True:
            cand = [(c.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in c.ranks]
            if not cand:
                break
            _, i = min(cand)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert c.merge(piece) == [c.ranks[p] for p in parts]


def test_very_long_text_in_parts(enc, monkeypatch):
    monkeypatch.setattr(bpe, "MATCHES", 100)
    c = bpe.Codec(RANKS, P.PATTERN)
    t = "some words, 12 of them.  And more\n" * 200
    ids = c.encode(t)
    assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_encode_decode_on_spark(spark, enc, docs, odd):
    for df in (docs, odd):
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
        assert len(out) == sum(map(len, texts.values()))
        for r in out:
            assert any(
                np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()
                for t in texts[r.doc_id]
            )
    assert bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), RANKS, P.PATTERN).first()
    assert bytes(nothing.decoded) == b""


def test_chunked_tokeniser_matches_library(docs):
    t = Tokenizer.from_file(JSON)
    rng = random.Random(9)
    texts = HARD + ["".join(rng.choice("ab  \n.é0'ts\xa0") for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += [r.text for r in docs.limit(200).collect()]
    tok = packing.Tokeniser(JSON)
    for got, want in zip(tok.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids


def test_best_fit_never_overfills():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 500)
    b, o, fill = packing.best_fit(lengths, 100)
    assert fill.max() <= 100 and fill.sum() == lengths.sum()
    for k in range(len(fill)):
        at = sorted(zip(o[b == k], lengths[b == k]))
        assert at[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(at, at[1:]))
    assert len(fill) <= -(-lengths.sum() // 100) * 11 / 9 + 1


def check_packing(df, rows, capacity=2048):
    t = Tokenizer.from_file(JSON)
    got = df.toPandas()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        cuts = cuts if cuts[-1] == len(ids) else [*cuts, len(ids)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
    have = [
        (None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()
    ]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, g in got.groupby("sequence_id"):
        at = sorted(zip(g["offset"], g["length"]))
        assert at[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(at, at[1:]))
        assert sum(n for _, n in at) <= capacity
    return got["sequence_id"].nunique(), len(packing.best_fit(got["length"].to_numpy(), capacity)[2])


def crc():
    return {"ids_crc32": F.crc32("ids")}


def test_packing_on_spark(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for parts, each in ((1, 8192), (70, 8192), (13, 1), (70, 1)):
        df = packing.pack(docs.repartition(parts, "doc_id"), JSON, derive=crc(), local_pieces=each)
        used, at_once = check_packing(df, rows)
        assert used <= (1.0 if each > 1 else 1.06) * at_once, (parts, used, at_once)


def test_packing_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in ODD]
    for parts in (1, 30):
        check_packing(packing.pack(odd.repartition(parts), JSON, derive=crc(), local_pieces=1), rows)
    # a bound on what goes up costs filling, never pieces
    check_packing(packing.pack(odd.repartition(30), JSON, derive=crc(), max_open=1, fan_in=2, local_pieces=1), rows)
    assert packing.pack(odd.limit(0), JSON, derive=crc()).count() == 0
    kept = packing.pack(odd, JSON, keep_ids=True).where("doc_id = 6").first()
    assert hashlib.sha256(bytes(kept.ids)).hexdigest() and len(kept.ids) == 4 * kept.length
