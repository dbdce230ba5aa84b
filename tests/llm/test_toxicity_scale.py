"""Words of many texts at once, and the search over long lists."""

import pickle
import random
import tracemalloc

import numpy as np
import pytest

from cadence.llm import toxicity
from tests.llm.test_classifiers import brute_search

TEXTS = [
    "", "   ", "Scum scum, SCUM9scum x_idiot idiots", "loweiß lowe LOWEIHR straße STRASSE", "中文 中文字 İstanbul ΟΔΟΣ οδος",
    "idiot" * 40, "no known word at all, 12 ²³ …", "a scum idiot\ttab\x1fscum", "scum",
]


def plain(v, text, starts):
    return {v.number[t]: n for t, n in toxicity.term_counts(text, starts).items() if t in v.number}


@pytest.mark.parametrize("words", [200_000, 30, 3])
@pytest.mark.parametrize("marks", [[], ["^lowe", "^lowei", "^idi"]])
def test_many_texts_at_once(monkeypatch, words, marks):
    monkeypatch.setattr(toxicity, "WORDS", words)
    v = toxicity.Vocabulary(["scum", "idiot", "strasse", "straße", "中文", "i̇stanbul", "οδος", "a", *marks])
    copy = pickle.loads(pickle.dumps(v))
    assert copy.terms == v.terms and copy.number == v.number
    starts = tuple(v.starts)
    for model in (v, copy):
        got = [dict(zip(at.tolist(), n.tolist())) for at, n in model.counts(TEXTS)]
        assert got == [plain(v, t, starts) for t in TEXTS]
        assert all((np.diff(at) > 0).all() for at, _ in model.counts(TEXTS))


def test_texts_without_any_vocabulary():
    assert [len(at) for at, _ in toxicity.Vocabulary([]).counts(TEXTS)] == [0] * len(TEXTS)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With base 1 a hash is the sum of the letters: anagrams share it."""
    monkeypatch.setattr(toxicity, "_BASE", np.uint64(1))
    monkeypatch.setattr(toxicity, "_INVERSE", np.uint64(1))
    v = toxicity.Vocabulary(["scum", "idiot"])
    assert v.matches("mucs scum cums idiot toidi ad idiot") == {0: 2, 1: 1}
    assert v.matches("mucs") == {}
    with pytest.raises(ValueError):
        toxicity.Vocabulary(["scum", "mucs"])


def test_texts_leave_nothing_behind():
    """A worker's memory does not grow with the words it has seen."""
    v = toxicity.Vocabulary(["scum", "idiot"])
    v.matches("scum " * 1000)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for part in range(50):
        v.matches(" ".join(f"w{chr(97 + part % 26)}x{chr(97 + i % 26)}{i}-{part}" for i in range(1000)))
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 1_000_000


@pytest.mark.parametrize("long, first", [(2, 0), (20, 1), (20, 16), (1000, 2)])
def test_long_lists_are_exact(monkeypatch, long, first):
    monkeypatch.setattr(toxicity, "LONG", long)
    monkeypatch.setattr(toxicity, "FIRST", first)
    rng = random.Random(7)

    def vec():
        # a few terms are in most examples, most terms in few
        v = {min(int(rng.expovariate(0.15)), 60): rng.choice([1.0, rng.random() + 0.05]) for _ in range(rng.randrange(1, 25))}
        n = sum(w * w for w in v.values()) ** 0.5
        return tuple((t, w / n) for t, w in sorted(v.items()))

    vectors = [vec() for _ in range(500)]
    vectors += vectors[:40]  # ties
    ids = list(range(len(vectors)))
    rng.shuffle(ids)
    index = toxicity.BlockMaxIndex(vectors, ids, 16)
    for _ in range(150):
        q = vec()
        for k in (1, 15, 1000):
            got, want = index.search(q, k), brute_search(vectors, ids, q, k)
            assert [(round(c, 9), i) for c, i, _ in got] == [(round(c, 9), i) for c, i, _ in want]


def test_common_words_are_not_looked_up_entry_by_entry(monkeypatch):
    """Words that are in every example cost no list entries."""
    vectors = [tuple((t, 0.1) for t in [*range(50), 50 + i]) for i in range(400)]
    index = toxicity.BlockMaxIndex(vectors, list(range(400)))
    seen, spread = [], toxicity._spread
    monkeypatch.setattr(toxicity, "_spread", lambda first, rows: seen.append(len((got := spread(first, rows))[0])) or got)
    got = index.search(tuple((t, 1.0) for t in [*range(50), 57]), 3)
    assert got[0][1] == 7 and sum(seen) < 50
