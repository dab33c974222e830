"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, row_key, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; labels are learnt from outside the held-out fold.

    NULL and empty texts are scored like any other; repeated rows share a score and go or stay together; an empty table stays empty; other columns stay as they are.
    """
    from .quality import FOLDS, HELD_OUT, fit, keep_good
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels"), row_key() % FOLDS != HELD_OUT))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that another keeps; those that have no words left go.

    NULL and empty texts had no words before and stay; rows that share id and text are one document and keep their chunks; NULL
    ids come last; an empty table stays empty; other columns stay as they are, whatever their names.
    """
    from .linedup import dedup_lines
    columns = docs.columns
    docs, back = aside(docs, ["__lines", "__removed"])
    out = dedup_lines(docs).where("__removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    # n_chars follows the text where it changed
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return back(out.select(docs.columns)).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id (NULL last), once.

    Documents without words are in no group and stay; rows that share id and text are one document; an empty table stays
    empty; other columns stay as they are, whatever their names.
    """
    from .jaccard import jaccard_groups
    docs, back = aside(docs, ["nd_key"])
    groups = jaccard_groups(docs, k=5, num=80, den=100)
    best = groups.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "th")).alias("r"))
    alone = groups.where("grp is null").select("doc_id", "th")
    keep = best.select("r.doc_id", "r.th").unionByName(alone).select(F.xxhash64("doc_id", "th").alias("nd_key")).distinct()
    keyed = docs.withColumn("nd_key", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = keyed.join(keep, "nd_key", "left_semi").dropDuplicates(["nd_key"]).select(docs.columns)
    return back(kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice (nearest whole number).

    Texts without words have no size and are not taken; repeated rows are taken alike; a NULL source is one; an empty table stays
    empty; other columns stay as they are, whatever their names.
    """
    from .mixing import mix as mixed
    docs, back = aside(docs, ["m_id", "m_th", "m_copies", "m_copy"])
    taken = (mixed(docs).where("size > 0").select(
        F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), F.expr("cast(round(taken / size) as int)").alias("m_copies"))
        .where("m_copies > 0").distinct())
    both = docs.join(taken, docs["doc_id"].eqNullSafe(taken["m_id"]) & (F.xxhash64(docs["text"]) == taken["m_th"]))
    return back(both.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*[docs[c] for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset; a NULL text is empty, repeated rows are packed once each, an
    empty table gives no rows and other columns are left out."""
    import public_tokenizers
    from .packing import pack_documents
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
