"""Operator 13: runs, best runs and collapsed texts against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from __spark_entry__ import queries
from tabforge.llm.wordruns import catch, runs_of_words, word_runs

SF = "/root/testdata/sf0.001"


def smallest_period(ws):
    back = [0] * len(ws)
    for i in range(1, len(ws)):
        j = back[i - 1]
        while j and ws[i] != ws[j]:
            j = back[j - 1]
        back[i] = j + (ws[i] == ws[j])
    return len(ws) - back[-1]


def brute(ws, min_words=6, min_periods=4):
    out = []
    for q in range(1, len(ws) // min_periods + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_words, min_periods * q) and smallest_period(ws[i:i + n]) == q:
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(ws) if i not in gone]


def best(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def odd_texts():
    rnd = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 1000, list("ab") * 4, list("ab") * 4 + ["a"], list("abc") * 50 + list("abd") * 50]
    for size in (2, 3, 5):
        out += [[rnd.choice("abcde"[:size]) for _ in range(rnd.randrange(1, 200))] for _ in range(60)]
    for _ in range(80):
        ws = []
        while len(ws) < 300:
            q = rnd.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33])
            block = [rnd.choice("abcdefgh") for _ in range(q)]
            if rnd.random() < 0.3:
                block = block * 2 + block[:1]
            ws += (block * rnd.randrange(1, 12))[:rnd.randrange(1, 250)]
        out.append(ws)
    # Thue-Morse over two words, which defeats plain polynomial hashes of long spans
    out.append(["ab"[bin(i).count("1") % 2] for i in range(5000)])
    return out


def test_runs_of_odd_texts():
    for ws in odd_texts():
        assert runs_of_words(ws) == brute(ws), ws[:80]
    assert runs_of_words(list("abab") * 3, 2, 3) == brute(list("abab") * 3, 2, 3)
    with pytest.raises(ValueError):
        catch(np.zeros(1, np.uint64), np.array([0]), np.array([1]), 2, 2)


def test_operator_on_odd_tables(spark):
    texts = [" ".join(ws) for ws in odd_texts()] + [None, "", " \t\n", "é é\té\né  é é é", " a\x0ba a a a a\r", "x " * 70_000, " ".join("w%d" % (i % 40_000) for i in range(200_000))]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(0, texts[8], "s", 2), (None, "a a a a a a", "s", 3)]
    got = word_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, best int").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[0]) == 2 and by[None][0].best.length == 6
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(ws) > 100_000:
            want = [(0, len(ws), 40_000)]
        elif len(ws) > 60_000:
            want = [(0, 70_000, 1)]
        else:
            want = brute(ws)
        for r in by[i]:
            if i == 0:
                break
            mine = [(x.start, x.length, x.period) for x in r.runs]
            assert mine == want and r.n_words == len(ws)
            assert (tuple(r.best) if r.best else None) == best(want)
            assert r.collapsed == " ".join(kept(ws, want))
    empty = word_runs(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.collect() == [] and empty.schema["doc_id"].dataType.simpleString() == "string"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op13_word_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        ws = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        if len(ws) > 3000:
            continue
        runs = brute(ws)
        top = best(runs)
        some += bool(runs)
        want = (len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
                hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(kept(ws, runs)).encode()).hexdigest())
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert some > 5
