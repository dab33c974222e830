"""Operator 8: targets, flow and selection against plain versions."""

import random
import re
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from tabforge.llm.mixing import mix, route, targets


def test_targets():
    size = {"a": 100, "b": 100, None: 100, "c": 100}
    got = targets(size)
    assert got["a"] == 200 and abs(sum(got.values()) - 600) < 1e-9
    assert abs(got["b"] / got["c"] - 2) < 1e-9 or got["b"] == 200
    assert targets({"x": 0}) == {"x": 0.0} and targets({}) == {}
    big = targets({chr(97 + i): 10 ** (i % 4) for i in range(20)})
    assert all(v <= 2 * 10 ** (i % 4) + 1e-9 for i, v in enumerate(big.values()))


def test_route_is_the_cheapest_of_the_largest():
    rnd = random.Random(3)
    for _ in range(30):
        patterns = [(("a",), rnd.randint(0, 2)), (("a", "b"), rnd.randint(0, 2)), (("b",), rnd.randint(0, 2))]
        quota = {"a": rnd.randint(0, 5), "b": rnd.randint(0, 5)}
        gave = route(patterns, quota)
        total = sum(sum(g.values()) for g in gave)
        cost = sum(max(0, sum(g.values()) - n) for (_, n), g in zip(patterns, gave))
        best = (0, 0)
        for a, x, y, b in product(range(5), repeat=4):
            if a + x <= quota["a"] and y + b <= quota["b"] and a <= 2 * patterns[0][1] and x + y <= 2 * patterns[1][1] and b <= 2 * patterns[2][1]:
                c = max(0, a - patterns[0][1]) + max(0, x + y - patterns[1][1]) + max(0, b - patterns[2][1])
                best = max(best, (a + x + y + b, -c))
        assert (total, -cost) == best


def rows(n=400, seed=2):
    rnd = random.Random(seed)
    out = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40])), "hot" if i % 3 == 0 else rnd.choice(["é", "b", "a", "z", None])) for i in range(n)]
    return out + [(None, "no id here", "a"), (9001, None, "b"), (9002, "\t x\n", "only"), (5, out[5][1], out[5][2]), (5, out[5][1], out[5][2])]


def test_table(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, size int")
    got = mix(df.repartition(5)).collect()
    assert len(got) == len(data)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in data:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(size)
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
    assert target == want
    # rows with the same id and text share what is missing evenly, so a few words may stay
    assert all(abs(taken[s] - want[s]) <= 4 for s in want)
    again = mix(df.repartition(3).select("source", "text", "doc_id")).collect()

    def key(x):
        return sorted(((r.doc_id, r.source, r.size, r.taken) for r in x), key=str)
    assert key(again) == key(got)
    assert mix(df.limit(0)).collect() == []


def test_refined_cuts(spark, monkeypatch):
    import tabforge.llm.mixing as M
    monkeypatch.setattr(M, "SEED", 7)
    data = [(i, "one two three", f"s{i % 3}") for i in range(3000)]
    got = mix(spark.createDataFrame(data, "doc_id long, text string, source string"))
    by = {r.source: (r.taken, r.target) for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(a - b) <= 1 for a, b in by.values())


def test_overlapping_sources(spark):
    data = [(i, "a b c d", ["x"] if i < 50 else ["x", "y"] if i < 80 else ["y"] if i < 98 else None if i < 99 else []) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string, members array<string>").withColumn("source", F.get("members", F.lit(0)))
    got = mix(df, "members").collect()
    assert len(got) == 100 and all(r.taken == 0 for r in got if r.doc_id >= 98)
    assert all(r.source_size == 320 for r in got if r.source == "x")
    # both quotas are met: 600 words are shared as 5 to 2, of which y's 48 documents could give more
    want = targets({"x": 320, "y": 192})
    assert sum(r.taken for r in got) == min(round(want["x"]) + round(want["y"]), 2 * 4 * 98)


def test_components_flow_as_one_graph_would(spark):
    """Sources in several components with overlaps, NULL and empty ones: each pattern's words as by one flow over all."""
    rnd = random.Random(11)
    groups = [["a", "b", "c"], ["d", "e"], ["f"], [None, "g"], ["h", "i", "j", "k"]]
    data = []
    for i in range(600):
        g = rnd.choice(groups)
        data.append((i, "w " * rnd.randint(0, 9), rnd.sample(g, rnd.randint(1, len(g)))))
    df = spark.createDataFrame([(i, t, m, m[0]) for i, t, m in data], "doc_id long, text string, members array<string>, source string")
    got = mix(df.repartition(7), "members").collect()
    size, pattern = defaultdict(int), defaultdict(int)
    for _, t, m in data:
        pattern[frozenset(m)] += len(t.split())
        for s in m:
            size[s] += len(t.split())
    goal = targets(size)
    order = sorted(pattern, key=str)
    flows = route([(tuple(p), pattern[p]) for p in order], {s: round(goal[s]) for s in goal})
    assert len(got) == 600 and all(r.target == goal[r.source] and r.source_size == size[r.source] for r in got)
    of = {i: frozenset(m) for i, _, m in data}
    taken = defaultdict(int)
    for r in got:
        taken[of[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    # which pattern of equal cost gives is free; the sum and the repeated words are not
    assert sum(taken.values()) == sum(sum(f.values()) for f in flows)
    assert (sum(max(0, taken[p] - pattern[p]) for p in order)
            == sum(max(0, sum(f.values()) - pattern[p]) for p, f in zip(order, flows)))


def test_the_query_goes_through_the_flow(spark, monkeypatch):
    import tabforge.llm.mixing as M
    # without any flow nothing is taken
    monkeypatch.setattr(M, "_routed", lambda of, pdf: pdf.groupby("pattern", as_index=False).agg(size=("size", "first")).assign(give=0))
    got = mix(spark.createDataFrame([(i, "one two", "s") for i in range(20)], "doc_id long, text string, source string")).collect()
    assert len(got) == 20 and all(r.taken == 0 and r.target == 60 for r in got)


def test_many_sources(spark):
    data = [(i, "w " * (i % 7), None if i % 331 == 5 else f"é{i % 331}") for i in range(1500)]
    got = mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for _, t, s in data:
        size[s] += len(t.split())
    want = targets(size)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == want[r.source] and r.source_size == size[r.source]
    assert len(got) == len(data) and taken == {s: round(want[s]) for s in want}
