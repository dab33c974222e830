"""Operator 4 against a plain version that compares texts, on planted passages."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tabforge.llm.linedup import chunks, dedup_lines, hash_lines


def brute(rows):
    """The same rule with the chunks' texts themselves as keys."""
    at = defaultdict(list)
    for d, t in set(rows):
        if t is not None:
            lines, hashes, words = hash_lines(t)
            for i, j in chunks(hashes, words):
                at["\n".join(lines[i:j])].append((float("inf") if d is None else d, t, i, j))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        me, lines = float("inf") if d is None else d, t.split("\n")
        gone, held, again = set(), set(), []
        for k, places in at.items():
            if len(places) < 2:
                continue
            mine = sorted((i, j) for x, y, i, j in places if (x, y) == (me, t))
            if min(p[0] for p in places) < me:
                for i, j in mine:
                    gone |= set(range(i, j))
            elif mine:
                held |= set(range(*mine[0]))
                again += mine[1:]
        for i, j in again:
            gone |= set(range(i, j)) - held
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed=4):
    rnd = random.Random(seed)

    def line(k):
        return " ".join(f"w{rnd.randrange(5000)}" for _ in range(k))
    single, several, short = line(64), "\n".join(line(k) for k in (11, 42, 16)), "\n".join(line(8) for _ in range(9))
    licence = line(9)
    rows = []
    for i in range(40):
        body = [line(rnd.choice([5, 20, 60])) for _ in range(rnd.randint(1, 6))]
        for p, every in ((single, 3), (several, 4), (short, 5), (licence, 2)):
            if i % every == 0:
                body.insert(rnd.randint(0, len(body)), p)
        rows.append((i, "\n".join(body)))
    return rows, single, several, short, licence


def test_planted_passages(spark):
    rows, single, several, short, licence = corpus()
    rows += [(100, rows[1][1]), (100, rows[1][1]), (None, rows[2][1]), (101, None), (102, ""), (103, "\n\n"), (104, "\n".join([single] * 4))]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, first string, k1 int")
    got = dedup_lines(df.repartition(5))
    assert got.columns == ["doc_id", "text", "first", "k1", "__lines", "__removed"]
    out = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert out == brute(rows)
    texts = [t or "" for _, t in out]
    for passage in (single, several, short):
        assert sum(passage in t for t in texts) == 1
        assert sum(any(x in t.split("\n") for x in passage.split("\n")) for t in texts) == 1
    # a short line that many documents share is no passage
    assert sum(licence in t for t in texts) >= 20


def test_clean_documents_are_left_alone(spark):
    rnd = random.Random(9)
    rows = [(i, "\n".join(" ".join(f"u{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(4))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == rows
    assert dedup_lines(df.limit(0)).collect() == []


def test_chunks_are_shift_resistant():
    rnd = random.Random(1)
    passage = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(40)]

    def keys(before):
        lines, hashes, words = hash_lines("\n".join([*before, *passage]))
        return {"\n".join(lines[i:j]) for i, j in chunks(hashes, words)}
    a, b = keys(["x y", "z"]), keys(["other " * 70])
    inside = {k for k in a if all(x in passage for x in k.split("\n"))}
    assert len(inside & b) >= 0.9 * len(inside)


def test_byte_comparison(spark, monkeypatch):
    """Chunks with a line whose hash stands for two texts are not removed."""
    import tabforge.llm.linedup as L
    rnd = random.Random(2)
    rows = [(i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60))) for i in range(4)]
    spans = spark.createDataFrame([(d, t, [(0, 1, d == 0, 7, 7)]) for d, t in rows],
                                  "doc_id long, __text string, __spans array<struct<first:int,end:int,here:boolean,k1:long,k2:long>>")
    assert L.two_texts(spans).first()[0] == []
    h = L._two(hash_lines(rows[1][1])[1][0])
    batch = spans.withColumn("__wrong", F.array(F.struct(F.lit(h[0]).alias("h1"), F.lit(h[1]).alias("h2"))))
    out = batch.mapInArrow(L._rewrite(["doc_id", "text"]), "doc_id long, text string, __lines long, __removed long").collect()
    assert sorted((r["doc_id"], r["__removed"]) for r in out) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_one_document_keeps_a_chunk_though_ids_repeat(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(7, passage + "\nfirst"), (7, passage + "\nsecond"), (None, passage + "\nthird"), (None, passage + "\nfourth")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and sorted(r["__removed"] for r in out) == [0, 4, 4, 4]
    assert [r["doc_id"] for r in out if r["__removed"] == 0] == [7]
    only = dedup_lines(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()
    assert sorted(r["__removed"] for r in only) == [0, 4]
