"""Operators 3 and 9: held-out accuracy on the given labels, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tabforge.llm.bytewords import ALNUM, NOT_SPACE, pieces, words
from tabforge.llm.ftrl import Ftrl, grams, labelled, toxicity
from tabforge.llm.quality import isotonic, quality
from tabforge.llm.textstats import NAMES, doc_stats

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def held_out(spark, operator, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = operator(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("score", label).collect()
    assert all(0 <= r[0] <= 1 for r in rows)
    return auc([(r[0], r[1]) for r in rows])


def test_toxicity_held_out(spark):
    assert held_out(spark, toxicity, "toxic") > 0.8


def test_quality_held_out(spark):
    assert held_out(spark, quality, "quality") > 0.95


def odd(spark):
    rows = [(i, ("good words here number %d" % i) if i % 2 else "moron *** idiot !!!", "x", 0.5) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "x", 1.0), (102, " \n ", "x", 1.0), (None, "no id", "x", 1.0), (1, rows[1][1], "x", 0.5), (103, "a " * 200_000, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(3, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, len(rows)


def test_edge_cases(spark):
    docs, labels, n = odd(spark)
    for operator, k, r in ((toxicity, 5, 0), (quality, 4, 2)):
        got = operator(docs, labels)
        rows = got.collect()
        assert len(rows) == n and got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert all(x.score is not None and 0 <= x.score <= 1 for x in rows)
        assert {x.doc_id for x in rows if x.held_out} == {x.doc_id for x in docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % k == r).collect()}
        assert operator(docs.limit(0), labels).collect() == []
        assert {x.score for x in operator(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_holds_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(i, f"own {i}") for i in range(2, 200)] + [(1, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1)] + [(7, 1)] * 3000 + [(i, i % 2) for i in range(2, 200) if i != 7] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    every = labelled(docs, labels, "toxic", F.lit(True), 1000).collect()
    assert len(every) == 199 and sum(r.text.startswith("text") or r.text == "" for r in every) == 1
    assert {r.text: r.label for r in every if r.text.startswith("own")} == {f"own {i}": i % 2 for i in range(2, 200)}
    assert [r.label for r in every if not r.text.startswith("own")] == [1]
    some = labelled(docs.repartition(5), labels, "toxic", F.lit(True), 50).collect()
    assert len(some) == 50 and {r.at for r in some} == set(sorted(r.at for r in every)[:50])


def test_words_stay_within_documents():
    texts = ["ab", "cd e", "", "é!f"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for member, want in ((NOT_SPACE, [0, 1, 1, 3]), (ALNUM, [0, 1, 1, 3, 3])):
        assert words(raw, off, member)[2].tolist() == want
    assert [len(f) for f in grams(raw, off)] == [1, 3, 0, 3]
    assert doc_stats(raw, off).shape == (4, len(NAMES))
    assert [(i, j) for i, j, _, _ in pieces(raw, off, piece=3)][-1][1] == 4


def test_statistics_do_not_depend_on_neighbours():
    texts = ["one two two", "MUCH!! NOISE!!", "a\nb\na"]

    def of(ts):
        raw = np.frombuffer("".join(ts).encode(), np.uint8)
        return doc_stats(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in ts])]))
    np.testing.assert_allclose(of(texts), np.concatenate([of([t]) for t in texts]))


def test_isotonic_pools():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 0, 3]), np.array([1.0, 2, 2, 3]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.0]


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    m = Ftrl(1000)
    for _ in range(400):
        y = rng.integers(0, 2)
        m.learn(np.append(rng.choice(900, 20, replace=False), 990 if y else 991), float(y))
    w = m.weights(np.arange(1000))
    assert w[990] > 0 > w[991] and (w != 0).sum() < 100
