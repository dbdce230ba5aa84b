"""Language identification and toxicity: held-out accuracy, exact search and
odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import langid, toxicity
from tests.conftest import SF_CHECK
from tests.llm.test_native_ops import ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_CHECK}/labels.parquet")


# language identification

def test_codewords_are_far_apart():
    for k in range(2, 40):
        code = langid.codewords(k).astype(int)
        assert len(code) == k and not (np.abs(code.sum(axis=0)) == k).any()
        far = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert min(far) >= code.shape[1] // 4 + (k > 2)


def test_grams_match_plain_slicing():
    """Counting n-grams by hashing equals counting them one by one."""
    texts = ["Ab, c!", "", "  ", "Überß 12 é", "x"]
    two, three, starts = langid.grams(texts)
    assert len(starts) == len(texts)
    for i, t in enumerate(texts):
        low = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {t} ")
        end = starts[i] + len(low)
        for n, hashed in ((2, two), (3, three)):
            real = [low[j:j + n] for j in range(len(low) - n + 1)]
            assert (hashed[starts[i]:end] < langid.FEATURES).sum() == sum(bool(g.strip()) for g in real)
    alone = langid.grams(["Überß 12 é"])
    assert np.array_equal(two[starts[3]:starts[4]], alone[0]) and np.array_equal(three[starts[3]:starts[4]], alone[1])


def test_counts_match_a_loop(docs):
    some = docs.where("doc_id % 10 = 3")
    want = {}
    for r in some.collect():
        two, three, _ = langid.grams([r.text])
        for g in np.r_[two, three]:
            if g < langid.FEATURES:
                want[(r.lang, int(g))] = want.get((r.lang, int(g)), 0) + 1
    assert {(r.lang, r.gram): r.n for r in langid.ngram_counts(some).collect()} == want


def test_held_out_accuracy(docs):
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    assert model.langs == ["de", "en", "es", "fr"]
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where(langid.is_held_out(F.col("doc_id"))).toPandas()
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert held["score"].between(0, 1).all() and held["ambiguous"].mean() < 0.05


def test_decoding_corrects_a_wrong_bit(docs):
    """With one classifier's sign turned, the codeword is still found."""
    model = langid.fit(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    for b in range(model.code.shape[1]):
        odds = model.odds.copy()
        model.odds[:, b] *= -1
        got = [p[0] for p in model.predict(list(texts.values()), 1.0)]
        assert got == list(texts)
        model.odds = odds


def test_language_odd_rows(spark, docs, odd):
    model = langid.fit(docs)
    out = langid.identify(odd, model).collect()
    assert len(out) == len(ODD)
    for r in out:
        if r.doc_id in (3, 4):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    one = langid.fit(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(odd, one).collect()} == {"en", "und"}
    many = spark.createDataFrame([(f"l{i:02d}", chr(97 + i) * 40 + f" {chr(98 + i)}") for i in range(12)], "lang string, text string")
    model = langid.fit(many)
    assert all(p[0] == r.lang for r in many.collect() for p in model.predict([r.text], 0.0))


def test_prediction_looks_at_text_only(docs):
    model = langid.fit(docs)
    plain = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(changed, model).collect()} == plain


# toxicity

def brute_search(vectors, ids, query, k):
    q = dict(query)
    all_ = []
    for row, v in enumerate(vectors):
        c = sum(w * q[t] for t, w in v if t in q)
        if c > 0:
            all_.append((round(c, 12), ids[row], row))
    return sorted(all_, key=lambda x: (-x[0], x[1]))[:k]


def test_block_max_search_is_exact():
    rng = random.Random(4)

    def vec():
        v = {rng.randrange(30): rng.choice([1.0, 2.0, rng.random() + 0.1]) for _ in range(rng.randrange(1, 6))}
        n = sum(w * w for w in v.values()) ** 0.5
        return tuple((t, w / n) for t, w in sorted(v.items()))

    vectors = [vec() for _ in range(700)]
    vectors += vectors[:50]  # ties
    ids = list(range(len(vectors)))
    rng.shuffle(ids)
    index = toxicity.BlockMaxIndex(vectors, ids, 16)
    for _ in range(200):
        q = vec()
        got, want = index.search(q, 15), brute_search(vectors, ids, q, 15)
        assert [(round(c, 9), i) for c, i, _ in got] == [(round(c, 9), i) for c, i, _ in want]
        assert all(ids[row] == i for _, i, row in got)
    assert index.search(((99, 1.0),), 15) == [] and toxicity.BlockMaxIndex([], []).search(((1, 1.0),), 3) == []


def test_matches_agree_with_plain_counting(monkeypatch):
    v = toxicity.Vocabulary(["scum", "^lowe", "^lowei", "idiot"])
    text = "Scum, scum LOWEIHR lowei lowe x_idiot 9idiot9 idiots loweiß"
    want = {}
    for t, n in toxicity.term_counts(text).items():
        if t in v.number:
            want[v.number[t]] = n
    assert v.matches(text) == want
    monkeypatch.setattr(toxicity, "WORDS", 3)
    assert v.matches(text) == want


@pytest.fixture(scope="module")
def tox(docs, labels):
    return toxicity.fit(docs, labels.where(~toxicity.is_held_out(F.col("doc_id"))))


def test_toxicity_held_out(docs, labels, tox):
    out = toxicity.score(docs, tox).join(labels, "doc_id").where(toxicity.is_held_out(F.col("doc_id"))).toPandas()
    assert out["score"].between(0, 1).all()
    bad = out["toxic"] == 1
    assert (out["score"][bad] >= 0.5).mean() > 0.5 and (out["score"][~bad] >= 0.5).mean() < 0.02
    assert out["score"][bad].mean() > 0.5 > out["score"][~bad].mean() + 0.3


def test_document_frequencies_cover_the_corpus(docs, tox):
    df, n = toxicity.document_frequencies(docs, tox.vocabulary)
    texts = [r.text for r in docs.collect()]
    assert n == len(texts)
    for t in tox.vocabulary.terms[:20]:
        words = [set(re.findall(r"[^\W\d_]+", x.lower())) for x in texts]
        want = sum(any(w.startswith(t[1:]) and len(w) > len(t) - 1 for w in ws) if t[0] == "^" else t in ws for ws in words)
        assert df[tox.vocabulary.number[t]] == want


def test_toxicity_odd_rows(spark, docs, odd, tox):
    out = toxicity.score(odd, tox).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    empty = {r.doc_id: r for r in out}
    assert empty[3].score == empty[4].score == tox.empty < 0.5 and empty[3].evidence == []
    assert toxicity.score(odd.limit(0), tox).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    messy = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (2, 0), (12345678, 1)], "doc_id long, toxic int")
    m = toxicity.fit(odd, messy)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, m).collect())


def test_scores_do_not_see_labels(docs, labels, tox):
    """The score of a text is the same whoever carries it."""
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10**6)
    a = {r.doc_id: r.score for r in toxicity.score(docs, tox).collect()}
    b = {r.doc_id - 10**6: r.score for r in toxicity.score(moved, tox).collect()}
    assert a == b


def test_only_exact_copies_of_one_label_are_merged(spark):
    """Texts that share a passage, one text under both labels and two texts of
    one id all stay; copies count once, in the sample and in the totals."""
    shared = "this very same header line stands above all of the texts here "
    rows = [(i, shared + f"own words number{i} of{i} text{i}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # copies under the same label
    rows += [(200, rows[2][1]), (3, "another text of the same id"), (3, rows[3][1]), (300, None), (301, ""), (None, "x")]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(100 + i, int(i % 3 == 0)) for i in range(10)]
    labels += [(200, 1), (300, 0), (301, 0), (400, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = dict(labels[:-1])
    want = sorted({(t or "", label[i]) for i, t in rows if i in label})
    sample, yes, no = toxicity.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 1000, 1000)
    got = sample.collect()
    assert sorted((r.text, r.toxic) for r in got) == want
    assert all(r.doc_id < 100 for r in got if r.text.startswith(shared) and (r.text, r.toxic) != (rows[2][1], 1))
    assert (yes, no) == (sum(y for _, y in want), sum(1 - y for _, y in want))
    few, yes, no = toxicity.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 5, 7)
    assert few.where("toxic = 1").count() == 5 and few.where("toxic = 0").count() == 7
    assert (yes, no) == (sum(y for _, y in want), sum(1 - y for _, y in want))
