"""Line dedup and the stages on tables with NULLs, repeated rows and columns that carry the operators' own names."""

import pytest
from pyspark.sql import functions as F

from tabforge.llm import stages
from tabforge.llm.linedup import dedup_lines

SHARED = "\n".join("line %d of a passage that many documents hold word for word" % i for i in range(12))
CLASHES = ("__id", "__th", "__text", "__spans", "__wrong", "__lines", "__removed", "nd_key", "m_id", "m_th", "m_copies", "m_copy", "id", "th")


def odd_documents(spark):
    texts = ["%s\n%s" % (" ".join("w%d_%d" % (i, j) for j in range(80)), SHARED) for i in range(4)] + [None, "", "one", " ".join("near%d" % j for j in range(100))]
    texts.append(texts[-1] + " end")
    rows = [(i, t, "en", "s%d" % (i % 2), len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", None, 1), (None, texts[6], "en", "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASHES})


def same(rows):
    return all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)


def test_line_dedup_with_clashing_names(spark):
    docs = odd_documents(spark)
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count() and sorted(r["__removed"] for r in got if r["doc_id"] in (1, 2, 3)) == [12, 12, 12]
    assert all(r["nd_key"].startswith("nd_key") and r["__id"].startswith("__id") and r["__text"].startswith("__text") for r in got)


@pytest.mark.parametrize("stage", [stages.line_dedup, stages.near_duplicates, stages.mix])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, None)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and same(rows)
    if stage is stages.near_duplicates:
        ids = [r["doc_id"] for r in rows]
        assert sorted(i for i in ids if i is not None) == list(range(8))
    empty = stage(spark, docs.limit(0), None)
    assert empty.columns == docs.columns and empty.collect() == []
