"""Personal data by weak supervision, in DataFrame and SQL functions only (operator 5).

One scan takes from each text the candidate spans of every kind. Labelers then vote on each candidate, for, against
or not at all: a strict shape (regex), words around it or endings known for its kind (gazetteer), and its borders
(context). Candidates are counted by kind and vote pattern, of which there are at most kinds * 3**labelers; on
those counts expectation-maximisation estimates each labeler's reliability and the share of true spans of a
kind, and a logistic regression on the resulting soft labels is the final span classifier. The spans of the four base
patterns always stay; candidates of the kind ``secret`` stay if the classifier takes them and they
overlap no base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Fixed patterns of the base kinds, written without backtracking (possessive, and only from the border of a run, which the
#: leftmost match always is; \\G is the end of the match before). A card's run of digits is matched whole or not at all.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = (r"(?<![A-Za-z0-9_])(?:(?:password|passwd|pwd|secret|token|api_key|apikey|access_key)\x20{0,2}[=:]\x20{0,2}[\x22']?[A-Za-z0-9_+/.-]{8,}+[\x22']?"
          r"|AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
AROUND = 24
LABELERS = ["shape", "known", "border", "varied", "against"]


def _may(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit("AKIA"))


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)

    def part(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def _valid() -> Column:
    """Whether a match of a base pattern counts."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "ip", match.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"))
            .when(kind == "card", n.between(14, 19) & _luhn(F.when(kind == "card", digits).otherwise(F.lit("0"))))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True)))


def candidates(documents: DataFrame) -> DataFrame:
    """(row, doc_id, spans): of each text its matches with their context, in order, by kind."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET}
    for k, pattern in patterns.items():
        may = _may(k, F.col("text"))
        rows = rows.withColumns({
            f"m_{k}": F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))})
    for k, pattern in patterns.items():
        rows = rows.withColumn(f"p_{k}", F.when(F.size(f"m_{k}") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))

    def spans(k):
        p = F.col(f"p_{k}")
        return F.transform(f"m_{k}", lambda m, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), m.alias("match"), F.length(F.get(p, i)).alias("gap"),
            F.right(F.get(p, i), F.lit(AROUND)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after")))
    return rows.select("row", "doc_id", F.concat(*[spans(k) for k in patterns]).alias("spans"))


def _votes() -> dict[str, Column]:
    """The labelers' votes: 1 for, -1 against, 0 none."""
    kind, match = F.col("kind"), F.col("match")
    before = F.lower("before")

    def vote(yes, no=None):
        c = F.when(yes, F.lit(1))
        return (c.when(no, F.lit(-1)) if no is not None else c).otherwise(F.lit(0))
    shape = (F.when(kind == "email", match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9].*\.[A-Za-z]{2,24}$"))
             .when(kind == "ip", match.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"))
             .when(kind == "card", match.rlike("^[3-6]")).when(kind == "phone", match.rlike(r"^\+[1-9]"))
             .otherwise(match.rlike(r"^AKIA|[=:].*[0-9].*[A-Za-z]|[=:].*[A-Za-z].*[0-9]")))
    known = (F.when(kind == "email", match.rlike(r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$") | before.rlike("mail|contact|write"))
             .when(kind == "ip", before.rlike(r"\bip\b|host|server|address")).when(kind == "card", before.rlike("card|visa|credit|pay"))
             .when(kind == "phone", before.rlike("tel|phone|call|fax|mobile")).otherwise(match.rlike("^(?:AKIA|password|passwd|token|secret)")))
    clean = F.col("before").rlike(r"(?:^|[^A-Za-z0-9])$") & ~F.col("after").rlike(r"^[A-Za-z0-9]")
    variety = F.size(F.array_distinct(F.split(match, "")))
    against = before.rlike(r"(?:version|licen[cs]ed?|section|chapter|example|e\.g\.)[^.]{0,8}$")
    return {"shape": vote(shape, ~shape), "known": vote(known), "border": vote(clean, ~clean),
            "varied": vote(variety >= 6, variety <= 3), "against": F.when(against, F.lit(-1)).otherwise(F.lit(0))}


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a pattern's candidates are true, by expectation-maximisation over the counts.

    Labelers vote independently given the truth; each has, for true and for false candidates, a share of
    votes for, against and none. It starts from the majority of the votes; all shares are smoothed.
    """
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in counts}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        seen = [[{-1: 1.0, 0: 1.0, 1: 1.0 + truth} if truth else {-1: 2.0, 0: 1.0, 1: 1.0} for truth in (0, 1)] for _ in LABELERS]
        for k, v, n in counts:
            p = post[k, v]
            t = prior.setdefault(k, [1.0, 1.0])
            t[0] += n * (1 - p)
            t[1] += n * p
            for j, x in enumerate(v):
                seen[j][0][x] += n * (1 - p)
                seen[j][1][x] += n * p
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0])
            for j, x in enumerate(v):
                odds += math.log(seen[j][1][x] / sum(seen[j][1].values())) - math.log(seen[j][0][x] / sum(seen[j][0].values()))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classifier(counts, post, rounds: int = 300, rate: float = 1.0) -> dict[tuple[str, tuple[int, ...]], float]:
    """Scores of a logistic regression on votes and kinds, fitted to the soft labels of the patterns."""
    def features(k, v):
        return [1.0, *[float(x == 1) for x in v], *[float(x == -1) for x in v], *[float(k == name) for name in KINDS]]
    rows = [(features(k, v), post[k, v], math.log1p(n)) for k, v, n in counts]
    total = sum(n for _, _, n in rows) or 1.0
    w = [0.0] * (1 + 2 * len(LABELERS) + len(KINDS))

    def score(x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
    for _ in range(rounds):
        g = [1e-3 * a for a in w]
        for x, y, n in rows:
            e = (score(x) - y) * n / total
            for i, xi in enumerate(x):
                g[i] += e * xi
        w = [a - rate * b for a, b in zip(w, g)]
    return {(k, v): score(features(k, v)) for k, v, _ in counts}


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) of every row.

    NULL texts are empty; repeated rows are found each; other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = stash(candidates(documents))
    one = docs.select("row", F.inline("spans"))
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (one.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(run).cast("long"))
              .withColumn("start", F.col("end") - F.length("match")).where(_valid()))
    spans = stash(placed.withColumns(_votes()).select("row", "kind", "start", "end", *LABELERS))
    counts = [(r["kind"], tuple(r[x] for x in LABELERS), r["count"])
              for r in spans.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()]
    scores = classifier(counts, estimate(counts))
    model = spark.createDataFrame([(k, *v, s) for (k, v), s in scores.items()],
                                  "kind string, " + ", ".join(f"{x} int" for x in LABELERS) + ", score double")
    # one row a vote pattern: at most len(KINDS) * 3 ** len(LABELERS)
    scored = spans.join(F.broadcast(model), ["kind", *LABELERS]).where(F.col("kind").isin(BASE) | (F.col("score") >= 0.5))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = scored.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind"))).alias("found"))
    rows = docs.select("row", "doc_id").join(found, "row", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")))
    rows = rows.withColumn("base", F.filter("found", lambda s: s["kind"].isin(BASE)))
    base = F.col("base")
    rows = rows.withColumn("more", F.filter("found", lambda s: s["kind"].isin(BASE) | ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def number(k):
        return F.size(F.filter("more", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[number(k) for k in BASE], F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("more")).alias("spans"),
                       number("secret"))
