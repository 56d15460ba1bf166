"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its text.  From
preference pairs (a document labelled good, one labelled bad) the weights are
learned by logistic loss on the difference of the two feature vectors.  The
threshold is the quantile of the training strengths that leaves below it the
share labelled bad; the score is the logistic of the distance from it, so a
score of 0.5 is the threshold.

Features are built-in expressions on the whole text; labels, language, source
and id are none of them.  Every labelled document trains: means, pairs and the
threshold are made of all of them, by aggregations, a join and a range sort, so
the driver gets sums only.  Each document of the more frequent label is paired
with as many of the other as make ``pairs`` pairs, with one at least and with
all at most; so each of the rarer label is in a pair as well.

Defined results: null and empty texts have all-zero features and a score; a
document labelled twice, with both labels, trains twice, one labelled with null
not at all; of rows that share an id one trains, that of least text hash; with
no good or no bad document to learn from every score is 0.5 (predicted 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgraph.operators.ids import with_dense_ids
from rowgraph.runtime import cut, ship_package

MARKS = "#$%&*@^~+=<>{}[]\\/_"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"
#: A word followed by itself.
DOUBLED = r"(?<!\S)(\S++)\s++\1(?!\S)"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def features(text: Column) -> dict[str, Column]:
    """Named features of a text, all finite, all 0 for the empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per = F.greatest(n, F.lit(1)).cast("double")
    words = n - _without(t, " \n\t")
    lines = n - _without(t, "\n")
    letters = n - _without(t, UPPER + LOWER)

    def share(chars: str) -> Column:
        return (n - _without(t, chars)) / per

    return {
        "marks": share(MARKS),
        "bars": share("|"),
        "shouts": share("!?"),
        "stops": share(".,;:"),
        "digits": share(DIGITS),
        "quotes": share("\"'()"),
        "upper": (n - _without(t, UPPER)) / F.greatest(letters, F.lit(1)).cast("double"),
        "blanks": words / per,
        "word_length": F.log1p((n - words) / (words + 1).cast("double")),
        "line_length": F.log1p(n / (lines + 1).cast("double")),
        "length": F.log1p(n.cast("double")),
        "wide": (F.octet_length(t) - n) / per,
        "doubled": F.least(F.lit(1.0), 4.0 * F.regexp_count(t, F.lit(DOUBLED)) / (words + 1).cast("double")),
    }


NAMES = [
    "marks", "bars", "shouts", "stops", "digits", "quotes", "upper", "blanks", "word_length", "line_length", "length", "wide",
    "doubled",
]


class Ranker:
    """Weights, threshold and scale of a learned ranking."""

    def __init__(self, mean, spread, weights, threshold: float, scale: float):
        self.mean, self.spread, self.weights = mean, spread, weights
        self.threshold, self.scale = threshold, scale

    def strength(self, made: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for name, m, sd, w in zip(NAMES, self.mean, self.spread, self.weights):
            total = total + (made[name] - F.lit(float(m))) * F.lit(float(w / sd))
        return total

    def score(self, text: Column) -> Column:
        strength = self.strength(features(text))
        return 1 / (1 + F.exp(-(strength - F.lit(self.threshold)) * F.lit(self.scale)))


def _rounded(values, digits: int) -> np.ndarray:
    """To so many digits, so that the order of a sum makes no difference."""
    return np.array([float(f"{v:.{digits}g}") for v in values])


def _sums(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient and second derivatives of log(1 + exp(-w.diff)), summed over a partition."""

    def run(batches):
        d = len(w)
        grad, hess, n = np.zeros(d), np.zeros((d, d)), 0
        for batch in batches:
            diff = np.column_stack([c.to_numpy() for c in batch.columns])
            p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
            grad -= diff.T @ p
            hess += (diff * (p * (1 - p))[:, None]).T @ diff
            n += len(diff)
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [np.concatenate([grad, hess.ravel()]).tolist()]})

    return run


def _paired(rows: DataFrame, more: int, fewer: int, most_good: bool, pairs: int) -> DataFrame:
    """The differences, good less bad, of the columns ``NAMES`` of ``rows``."""
    times = min(max(1, -(-pairs // more)), fewer)
    many, few = (
        with_dense_ids(rows.filter(F.col("_good") == g).withColumn("_h", F.xxhash64("_id")), "_i", "_h", "_id").withColumn("_i", F.col("_i") - 1)
        for g in (most_good, not most_good)
    )
    turns = many.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = F.pmod(F.col("_i") + F.floor(F.col("_i") / fewer) + F.col("_j"), F.lit(fewer))
    a = turns.select(at.alias("_at"), *[F.col(k).alias(f"a_{k}") for k in NAMES])
    b = few.select(F.col("_i").alias("_at"), *[F.col(k).alias(f"b_{k}") for k in NAMES])
    sign = 1.0 if most_good else -1.0
    return a.join(b, "_at").select(*[((F.col(f"a_{k}") - F.col(f"b_{k}")) * sign).alias(k) for k in NAMES])


def fit_ranker(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    pairs: int = 200_000,
    penalty: float = 1e-3,
) -> Ranker:
    """Learn from all labelled documents."""
    d = len(NAMES)
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).distinct()
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(marked.hint("shuffle_hash"), "_id")
    made = chosen.select("_id", "_label", F.xxhash64("_text").alias("_h"), F.struct(*[c.cast("double").alias(k) for k, c in features(F.col("_text")).items()]).alias("_x"))
    # one row a label, however many rows share its id
    rows = made.groupBy("_id", "_label").agg(F.min_by("_x", "_h").alias("_x"))
    rows = cut(rows.select("_id", (F.col("_label") == 1).alias("_good"), "_x.*"))
    known = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"),
        *[F.avg(k).alias(f"m_{k}") for k in NAMES], *[F.stddev_pop(k).alias(f"s_{k}") for k in NAMES],
    ).first()
    n, good = known["n"], known["good"]
    if not good or good == n:
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, spread = (_rounded([known[f"{x}_{k}"] for k in NAMES], 9) for x in "ms")
    spread[spread < 1e-12] = 1
    most_good = good >= n - good
    standard = rows.select("_id", "_good", *[((F.col(k) - float(m)) / float(sd)).alias(k) for k, m, sd in zip(NAMES, mean, spread)])
    diff = cut(_paired(standard, max(good, n - good), min(good, n - good), most_good, pairs))
    ship_package(docs.sparkSession)
    w = np.zeros(d)
    for _ in range(50):  # Newton steps on mean log(1 + exp(-w.diff)) + penalty |w|^2 / 2
        parts = diff.mapInArrow(_sums(w), "n long, sums array<double>").collect()
        count, sums = sum(r["n"] for r in parts), np.sum([r["sums"] for r in parts], axis=0)
        step = np.linalg.solve(sums[d:].reshape(d, d) / count + penalty * np.eye(d), sums[:d] / count + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    ranker = Ranker(mean, spread, _rounded(w, 6), 0.0, 1.0)
    strengths = rows.select(ranker.strength({k: F.col(k) for k in NAMES}).alias("s"))
    # midway between the strengths on either side of the quantile
    at = min(max(n - good, 1), n - 1)
    sides = with_dense_ids(strengths, "at", "s").filter(F.col("at").isin(at, at + 1)).agg(F.avg("s").alias("s")).first()
    ranker.threshold = sides["s"]
    ranker.scale = 4.0 / max(float(_rounded([strengths.agg(F.stddev_pop("s")).first()[0]], 9)[0]), 1e-9)
    return ranker


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added."""
    ranker = fit_ranker(docs, labels, **options)
    scored = docs.withColumn("score", ranker.score(F.col(options.get("text_col", "text"))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` at or above the threshold, columns unchanged."""
    ranker = fit_ranker(docs, labels, text_col=text_col, **options)
    return docs.filter(ranker.score(F.col(text_col)) >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return score_documents(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
