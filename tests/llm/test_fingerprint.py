"""Operator 7: the edited texts exactly, the likeness against true Jaccard similarities."""

import hashlib
import random

import numpy as np

from tabforge.llm.fingerprint import fingerprints

from .test_jaccard import shingle_set


def jaccard(a, b):
    x, y = shingle_set(a, 5), shingle_set(b, 5)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def check(spark, rows, tolerance=0.17, mean=0.03):
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprints(df.repartition(4)).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    err = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        r = got[d, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        some = len(shingle_set(t, 5)) >= 30
        # sets of a few shingles leave most bins empty, and what those draw varies more
        for near, other in ((r.near_edited, edited), (r.near_next, nxt)):
            err.append(abs(near - jaccard(t, other)))
            assert err[-1] < (tolerance if some else 0.35), (near, jaccard(t, other), len(shingle_set(t, 5)))
        assert (r.fingerprint == r.edited_fingerprint) or t != edited
    assert np.mean(err) < mean
    return got


def test_texts(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.choice([0, 2, 20, 200])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i * 11, " ".join(w[:rnd.choice([8, 60, 400])])))
    rows += [(5000, ""), (5001, None), (5002, "one two"), (5003, "one two"), (5004, "é\U0001F600 ü  x\ty z"), (5005, " \n")]
    check(spark, rows)


def test_single_and_empty(spark):
    one = fingerprints(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranges_and_repeated_rows(spark, monkeypatch):
    import tabforge.llm.fingerprint as M
    monkeypatch.setattr(M, "RANGE_ROWS", 5)
    rows = [(i * i, f"text {i} has a few words of its own {i}") for i in range(60)]
    check(spark, rows, tolerance=0.35, mean=0.06)
    dup = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "z"), (None, "z")], "doc_id long, text string")
    got = fingerprints(dup).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
