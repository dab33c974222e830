"""Document fingerprints by one-permutation MinHash, in DataFrame functions only (operator 7).

Every shingle of five lower-cased words is hashed once; the high bits of the hash name one of ``BINS`` bins and each bin
keeps its least hash. An empty bin takes the value of a bin drawn by a hash of its own number, drawn again until one
is not empty (optimal densification: the draws are the same for all documents, and after ``DRAWS`` of them the
non-empty bin of the least hash is taken). Of each bin the ``BITS`` low bits are kept, packed; two documents'
similarity is the share of equal bins, corrected for bins that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, BITS, SHINGLE, DRAWS = 256, 4, 5, 8
_LOW = (1 << 56) - 1
_PER_LONG = 64 // BITS
#: Documents of a range bucket, and buckets at most (their bounds are literals of the plan).
RANGE_ROWS, RANGES = 4096, 4096


def _sentinels() -> Column:
    """A value for each bin that is above every hash in it, so that every bin has a least value."""
    return F.array(*[F.lit((b << 56 | _LOW) - (1 << 64) if b >= 128 else b << 56 | _LOW) for b in range(BINS)])


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with column ``out``: the packed bins as an array of longs, empty for texts without words."""
    # the edges of a text give empty words
    df = df.withColumn(f"{out}_t", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"))
    t = F.col(f"{out}_t")
    skip = F.when(F.get(t, F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0))
    last = F.when(F.get(t, F.size(t) - 1) == "", F.lit(1)).otherwise(F.lit(0))
    df = df.withColumn(f"{out}_w", F.transform(F.slice(t, skip + 1, F.greatest(F.size(t) - skip - last, F.lit(0))), lambda w: F.xxhash64(w)))
    w = F.col(f"{out}_w")
    n = F.size(w)
    shingles = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, SHINGLE)])),
                       F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0)))
    df = df.withColumn(f"{out}_s", F.sort_array(F.concat(
        F.when((n > 0) & (n < SHINGLE), F.array(F.xxhash64(w))).otherwise(shingles), _sentinels())))
    s = F.col(f"{out}_s")
    df = df.withColumn(f"{out}_b", F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56))))
    b = F.col(f"{out}_b")
    df = df.withColumn(f"{out}_f", F.filter(b, lambda x: ~_empty(x)))
    full = F.col(f"{out}_f")

    def drawn(i):
        draws = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda t: F.get(b, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int")))
        least = F.array_min(F.transform(full, lambda y: F.struct(F.xxhash64(i, F.shiftright(y, 56)).alias("h"), y.alias("y"))))
        return F.coalesce(F.get(F.filter(draws, lambda y: ~_empty(y)), F.lit(0)), least["y"])
    df = df.withColumn(f"{out}_d", F.transform(b, lambda x, i: F.when(_empty(x), drawn(i)).otherwise(x)))
    d = F.col(f"{out}_d")
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), lambda g: F.aggregate(
        F.slice(d, g * _PER_LONG + 1, F.lit(_PER_LONG)), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))))
    # a second mention of d keeps the optimizer from pasting it into the lambda, which would draw anew for each group
    return (df.withColumn(out, F.when((F.size(full) == 0) | (F.size(d) == 0), F.slice(d, F.lit(1), F.lit(0))).otherwise(packed))
            .drop(*[f"{out}_{x}" for x in "twsbfd"]))


def as_text(packed: Column) -> Column:
    """The packed bins in hexadecimal; empty for texts without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two packed fingerprints, 0 to 1; two texts without words are alike, one and another are not."""
    def equal(x, y):
        v = x.bitwiseXOR(y)
        any_bit = v
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(v, k))
        return F.lit(_PER_LONG) - F.bit_count(any_bit.bitwiseAND(F.lit(int("1" * _PER_LONG, 16))))
    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0 ** -BITS
    shares = F.least(F.greatest((same / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shares)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds above the key, in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(x) for x in bounds])
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1::step]])
    skip = F.size(F.filter(coarse, lambda x: x > key)) * step
    return skip + F.size(F.filter(F.slice(every, skip + 1, F.lit(step)), lambda x: x > key))


def with_next_text(documents: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, place): each row's successor by descending doc_id, the last one's being the first.

    Rows are dealt to ranges of doc_id, so no range is a global window; the first row of a range is also sent, as a
    halo (``place`` 1), to the range before it. Ties are ordered by the hash of their text, NULL ids come last.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64("text")})
    n = rows.count()
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        at = rows.agg(F.percentile_approx("key", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(100 * ranges))).first()[0]
        bounds = sorted(set(at), reverse=True)
    # bounds descend: the range is the number of bounds above the key
    rows = rows.withColumn("range", _bucket(F.col("key"), bounds))
    firsts = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min(F.struct(F.bitwise_not("key").alias("k"), "th")).alias("f"))
                    .select("range", F.bitwise_not("f.k"), "f.th").collect())
    halo = [(firsts[i - 1][0], k, th) for i, (_, k, th) in enumerate(firsts)]
    to = spark.createDataFrame(halo or [(0, 0, 0)], "to_range int, h_key long, h_th long")
    # at most RANGES rows
    rows = rows.join(F.broadcast(to), (F.col("key") == F.col("h_key")) & (F.col("th") == F.col("h_th")), "left").withColumn(
        "put", F.explode(F.when(F.col("to_range").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("place")))).otherwise(
            F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("place")),
                    F.struct(F.col("to_range").alias("range"), F.lit(1).alias("place"))))))
    rows = rows.select("doc_id", "text", "key", "th", F.col("put.range").alias("range"), F.col("put.place").alias("place"))
    return rows.withColumn("next_text", F.lead("text").over(order()))


def order():
    return Window.partitionBy("range").orderBy("place", F.desc("key"), "th")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    NULL texts are empty; texts of fewer than five words are one shingle, those without words have an empty
    fingerprint; a single row is its own successor; other columns are ignored; an empty table gives no rows.
    """
    rows = with_next_text(documents)
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"),
                                              F.expr("substring(coalesce(next_text, ''), 1, cast(floor(length(text) / 2) as int))")))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("edited", 256)}).drop("next_text")
    rows = add_fingerprint(rows, "text", "own").drop("text")
    rows = add_fingerprint(rows, "edited", "other").drop("edited")
    rows = rows.withColumn("after", F.lead("own").over(order())).where("place = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
                       likeness(F.col("own"), F.col("after")).alias("near_next"))
