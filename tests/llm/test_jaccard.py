"""Operator 10 against brute force over all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabforge.llm.jaccard import forest, jaccard_groups, link_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, num=85, den=100):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for at in by.values():
        for i in at[:400]:
            for j in at:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if den * both >= num * len(sets[i] | sets[j]):
                        up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()), key=str)


def corpus(seed=1, families=14, size=6):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    licence = " ".join(rnd.choices(vocabulary, k=30))
    for f in range(families):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 6, 40, 120, 300]))
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((i * 7 % 1009, " ".join(w) + (" " + licence if f % 3 == 0 else "")))
            i += 1
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One two"), (5004, "one  TWO"),
                       (None, "one two"), (None, "alone here"), (5005, corpus()[0][1]), (5005, corpus()[0][1]),
                       (5006, "Éa é é É"), (5007, "éa é é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(3)).withColumn("node", F.lit("x"))
    assert found(df.repartition(5)) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_blocks_of_a_large_region(spark, monkeypatch):
    import tabforge.llm.jaccard as J
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 1000)
    rows = corpus(seed=5, families=5, size=25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_link_sets_and_forest(monkeypatch):
    import tabforge.llm.jaccard as J
    rnd = np.random.default_rng(3)
    for trial in range(6):
        sets = []
        for _ in range(12):
            base = rnd.integers(0, 10000, rnd.integers(20, 120), dtype=np.uint64)
            for _ in range(rnd.integers(1, 20)):
                x = base.copy()
                x[rnd.integers(0, len(x), 3)] = rnd.integers(0, 10000, 3, dtype=np.uint64)
                sets.append(np.unique(x))
        truth = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]

        def components(edges):
            up = list(range(len(sets)))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x
            for a, b in edges:
                up[root(a)] = root(b)
            low = {}
            for i in range(len(sets)):
                low.setdefault(root(i), i)
            return [low[root(i)] for i in range(len(sets))]
        assert components(link_sets(sets, 85, 100, leaf=4 + trial)) == components(truth)
        monkeypatch.setattr(J, "CLASSES", [64, 8][trial % 2])
        fine = [J.class_counts(s) for s in sets]
        coarse = np.array([J.folded(c, J.CLASSES) for c in fine])
        maybe = forest(np.arange(len(sets)), np.array([len(s) for s in sets]), coarse, fine, 85, 100)
        joined = components(maybe)
        assert all(joined[a] == joined[b] for a, b in truth)


def light_edits(n=200, words=120):
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1:])) for i in range(n) for j in [i * 7 % words]]


def test_light_edits_of_one_text(spark):
    rows = light_edits()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((4, 85), (5, 80)):
        sets = [np.unique(np.array([hash(g) for g in shingle_set(t, k)], np.int64).view(np.uint64)) for _, t in rows]
        assert len({frozenset((0, *e)) - {0} for e in link_sets(sets, num, 100)}) == len(rows) - 1
        got = jaccard_groups(df, k, num, 100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(shingle_set(t, k)), 0) for i, t in rows]


def test_regions_that_lose_one_set_at_a_time():
    rnd = np.random.default_rng(8)
    core = np.arange(100, dtype=np.uint64)
    sets = [np.delete(core, i % 100) for i in range(60)]
    for i in range(1100):
        own = np.arange(10_000 + 40 * i, 10_040 + 40 * i, dtype=np.uint64)
        sets.append(np.concatenate([np.sort(rnd.choice(core, 60, replace=False)), own]))
    got = link_sets(sets, 95, 100, pivots=2)
    assert len(got) == 59 and max(map(max, got)) < 60


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])
