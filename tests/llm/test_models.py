import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from edge import edge_docs, empty_docs
from popweave.llm import language, lm_score, quality
from popweave.llm.queries import QUERIES
from popweave.llm.text import ALNUM, words_of

SF = "/root/testdata/sf0.01"


def texts():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


def test_language_of_held_out_documents(spark):
    got = QUERIES["op7_language_id"](spark, SF).toPandas().merge(texts(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    docs = edge_docs(spark, ["the house", "123 -- 456", "\U00020000\U0001F600", "ÀÉ"])
    rows = spark.createDataFrame([(1, "the cat and the dog of the house", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "le chat", None)], "doc_id long, text string, lang string")
    model = language.fit(rows, F.lit(True))
    assert model.labels == ["de", "en"]
    got = language.identify(docs, model, lang_out="key", score_out="score")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "score"] and got.count() == docs.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["key"] == "und") != letters and (letters or r["score"] == 0)
    assert language.identify(empty_docs(spark), model).count() == 0
    none = language.fit(empty_docs(spark), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_grams_do_not_cross_texts():
    def slots(parts):
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        slot, first, _ = language.grams(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        return [slot[:, a:b].tolist() for a, b in zip(first[:-1], first[1:])]

    parts = ["abc", "", "Éa  1b", "x" * 50, "漢字 kana", "zz"]
    assert slots(parts) == [s for p in parts for s in slots([p])]


def test_scores_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = language.fit(docs, F.lit(True))
    one = language.identify(docs.coalesce(1), model).select("doc_id", "lang_pred", F.round("score", 6).alias("s"))
    many = language.identify(docs.repartition(7), model).select("doc_id", "lang_pred", F.round("score", 6).alias("s"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_quality_of_held_out_documents(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    got = QUERIES["op10_quality_classifier"](spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.quality == held.predicted).mean() > 0.95


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2 if i < 9 else None, 1, "z") for i in range(12)], "doc_id long, quality int, toxic int, text string")
    for trees in (quality.fit(docs, labels, F.lit(True)), quality.fit(empty_docs(spark), labels, F.lit(True)), quality.fit(docs, labels, F.col("i") == 1)):
        got = quality.score(docs, trees)
        assert got.columns.count("score") == 1 and got.where("score between 0 and 1").count() == docs.count()
    assert quality.score(empty_docs(spark), trees).count() == 0


def test_trees_against_walking_each_row():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = quality.fit_trees(x, y, n_trees=20, depth=3)
    for row in x[:40]:
        total = trees.start
        for f, limit, value in zip(trees.feature, trees.limit, trees.value):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > limit[node] else 1)
            total += value[node - len(f)]
        assert math.isclose(total, trees.raw(row[None])[0])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.95


def test_statistics_do_not_depend_on_neighbours():
    parts = ["", "Aa aa. bb\nbb\nb", "$$$ é", "x"]
    raw = [p.encode() for p in parts]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in raw])])
    both = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), ends)
    for k, p in enumerate(raw):
        alone = quality.statistics(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
        assert np.allclose(both[k], alone[0])


@pytest.fixture(scope="module")
def model(spark):
    return lm_score.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_lm_is_a_distribution_and_beats_word_counts(model):
    words, net = model
    w = words_of(list(texts().text[:80]), ALNUM)
    ids = lm_score.numbers(w, words)
    around = lm_score.contexts(ids, w.first)
    one = np.repeat(around[:, 5:6], lm_score.SIZE, axis=1)
    assert math.isclose(np.exp(net.log_probability(one, np.arange(lm_score.SIZE))).sum(), 1, rel_tol=1e-3)
    count = np.bincount(ids, minlength=lm_score.SIZE) + 0.5
    assert net.log_probability(around, ids).mean() > np.log(count / count.sum())[ids].mean()
    shuffled = np.random.default_rng(1).permutation(ids)
    assert net.log_probability(around, ids).sum() > net.log_probability(lm_score.contexts(shuffled, w.first), shuffled).sum()


def test_lm_sums_the_log_probabilities_of_its_words(spark, model):
    docs = edge_docs(spark, ["the of and", "the of and"])
    rows = lm_score.score(docs, *model).collect()
    assert len(rows) == docs.count()
    for r, d in zip(sorted(rows, key=lambda r: (r["key"] is None, r["key"])), sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))):
        w = words_of([d["text"]], ALNUM)
        ids = lm_score.numbers(w, model[0])
        want = model[1].log_probability(lm_score.contexts(ids, w.first), ids).sum()
        assert r["n_words"] == len(ids) and math.isclose(r["log_probability"], want, rel_tol=1e-4, abs_tol=1e-6)
        assert (r["per_word"] is None) == (len(ids) == 0)
    assert lm_score.score(empty_docs(spark), *model).count() == 0
    untrained = lm_score.fit(empty_docs(spark))
    assert lm_score.score(docs, *untrained).count() == docs.count()


def test_lm_counts_every_word(spark):
    docs = edge_docs(spark)
    got = lm_score.word_counts(docs).agg(F.sum("n")).first()[0]
    assert got == len(words_of([r["text"] for r in docs.collect()], ALNUM).hash)


def test_lm_learns_from_all_places(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(lm_score, "SAMPLE", 2000)
    monkeypatch.setattr(lm_score, "SHARD", 100_000)
    words, net = lm_score.fit(docs.repartition(3))
    total = lm_score.word_counts(docs).agg(F.sum("n")).first()[0]
    around, ids = lm_score.training_places(docs, words, total)
    begun = lm_score.Network()
    begun.train(around, ids)
    begun.compact()
    w = words_of(list(texts().text), ALNUM)
    ids = lm_score.numbers(w, words)
    around = lm_score.contexts(ids, w.first)
    assert net.log_probability(around, ids).mean() > begun.log_probability(around, ids).mean() + 0.2
    again = lm_score.fit(docs.repartition(7))[1]
    assert all(np.allclose(net.p[k], again.p[k], atol=1e-5) for k in net.p)


def test_lm_neighbours_stay_inside_a_text():
    w = words_of(["a b c", "", "d"], ALNUM)
    ids = np.arange(4)
    e = lm_score.EDGE
    assert lm_score.contexts(ids, w.first).T.tolist() == [[e, e, 1, 2], [e, 0, 2, e], [0, 1, e, e], [e, e, e, e]]


def test_lm_random_vocabulary_numbers():
    r = random.Random(1)
    w = words_of([" ".join("w%d" % r.randrange(50) for _ in range(200))], ALNUM)
    hashes = np.unique(lm_score.word_keys(w))[:10]
    ids = lm_score.numbers(w, (hashes, np.arange(10)))
    for h, i, n in zip(lm_score.word_keys(w), ids, w.end - w.start):
        assert lm_score.size_of(int(h)) == n
        assert (hashes[i] == h) if i < 10 else i == lm_score.VOCABULARY + n - 1
