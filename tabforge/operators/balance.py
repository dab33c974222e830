"""Class balancing (F15 SMOTE, F16 weights live in prepare).

SMOTE: every minority class is grown to the majority count with points
``x + u (nn - x)`` where ``nn`` is one of the k nearest same-class rows of ``x``. The base
rows, the neighbour choice and ``u`` come from hashes of (row id, copy number), so the
result is reproducible on any partitioning. Same-class neighbours come from the exact pivot
k-NN join, whose parts and bounds are those of one class; no class is gathered into one task. Rows are named by all their id columns.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabforge.functions.hashing import hash_fraction_expr
from tabforge.operators.knn import knn, row_key
from tabforge.operators.quantiles import order_statistics


def smote(df: DataFrame, label: str, features: str, id_cols, k: int = 5, seed: int = 42) -> DataFrame:
    """Return ``df`` plus synthetic rows (id columns NULL, ``synthetic`` = true)."""
    # one key for rows of several id columns
    id_col = "__key"
    plain, df = df, df.withColumn(id_col, row_key(id_cols) if len(id_cols) > 1 else F.col(id_cols[0]))
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return plain.withColumn("synthetic", F.lit(False))
    target = max(counts.values())
    need = {c: target - n for c, n in counts.items() if n < target and n >= 2}
    if not need:
        return plain.withColumn("synthetic", F.lit(False))
    minority = df.where(F.col(label).isin(list(need)))
    nn = knn(minority, minority.withColumnRenamed(id_col, "__rid"), k, id_col, "__rid", features,
                group=label, exclude_self=True)
    # copies per row: full rounds for every row, plus one more for the rows with the smallest hashes
    h = hash_fraction_expr([id_col], seed)
    base = minority.select(id_col, label, features).withColumn("__h", h)
    long = base.select(F.col(label).cast("string").alias("column_name"), F.col("__h").alias("v"))
    ranks = {str(c): (str(c), (m % counts[c]) - 1) for c, m in need.items() if m % counts[c]}
    thr = order_statistics(long, ranks) if ranks else {}
    full = F.create_map(*[x for c, m in need.items() for x in (F.lit(str(c)), F.lit(m // counts[c]))])
    tmap = F.create_map(*[x for c, v in thr.items() for x in (F.lit(c), F.lit(float(v)))]) if thr else None
    extra = (F.when(F.col("__h") <= tmap[F.col(label).cast("string")], 1).otherwise(0) if tmap is not None
             else F.lit(0))
    copies = base.withColumn("__copies", full[F.col(label).cast("string")] + extra).where("__copies > 0")
    copies = copies.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    # neighbour slot and gap from hashes of (id, copy)
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("__j").cast("string"))
    copies = copies.withColumn("__slot", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % k + 1)) \
                   .withColumn("__u", F.conv(F.substring(F.md5(F.concat(key, F.lit("u"))), 1, 13), 16, 10)
                               .cast("double") / 4503599627370496.0)
    kmax = nn.groupBy(id_col).agg(F.max("rank").alias("__kmax"))
    copies = copies.join(kmax, id_col).withColumn("__rank", ((F.col("__slot") - 1) % F.col("__kmax")) + 1)
    pairs = copies.join(nn.select(id_col, F.col("rank").alias("__rank"), "__rid"), [id_col, "__rank"])
    nbr = df.select(F.col(id_col).alias("__rid"), vector_to_array(features).alias("__nx"))
    syn = pairs.join(nbr, "__rid").withColumn("__x", vector_to_array(features))
    syn = syn.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in id_cols], label,
                     array_to_vector(F.zip_with("__x", "__nx", lambda a, b: a + F.col("__u") * (b - a))).alias(features))
    others = [c for c in plain.columns if c not in (*id_cols, label, features)]
    for c in others:
        syn = syn.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    out = plain.withColumn("synthetic", F.lit(False)).unionByName(syn.withColumn("synthetic", F.lit(True)))
    return out


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts before and after balancing."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, label, "full")
