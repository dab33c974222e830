"""The pipeline's stages, each held against its input, on the smallest given table."""

from pyspark.sql import functions as F

import corpus_pipeline
from tabforge.llm.common import stash

from .test_jaccard import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, SF))
        seen[name] = (docs, out)
        if name != "best-fit packing":
            assert out.columns == columns
        docs = out
    before, after = seen["quality classifier"]
    assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
    before, after = seen["n-gram Jaccard join"]
    kept = [shingle_set(r.text, 5) for r in after.collect()]
    assert after.exceptAll(before).isEmpty() and after.count() <= before.count()
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])
    before, after = seen["mixing sources to target weights"]
    assert after.groupBy("doc_id", F.xxhash64("text")).count().where("count > 2").isEmpty()
    assert after.distinct().exceptAll(before).isEmpty()
    before, after = seen["best-fit packing"]
    assert after.where("start = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
