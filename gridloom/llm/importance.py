"""Quality classifier by importance resampling.

Two bags of hashed n-grams (words and word pairs, BUCKETS buckets): one of target text (labelled
good), one of all raw text. A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw. Documents differ in length by far more than in kind, so the weight is brought
to one length: that of REFERENCE n-grams at the document's mean, which SHRINK n-grams of weight 0 draw
towards 0. Gumbel noise from the document's id is added, and the k largest are kept: a sample
without replacement in proportion to the weights. k is the number of documents whose own
weight reaches the level that separates labelled good from labelled bad ones best.

Raw counts and weights cover all documents. Only labels are sampled: at most ``label_rows`` of them,
the smallest by hash of the id; one half (by the same hash) fits the target model, the other the level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import rows_of, table, work_table

BUCKETS = 1 << 16
LABEL_ROWS = 20_000
SMOOTH = 1.0
REFERENCE = 256
SHRINK = 20
#: A good document lost counts as much as so many bad ones kept.
LOSS_OF_GOOD = 50.0


def features(text: str | None) -> np.ndarray:
    """Buckets of all words and word pairs of the whole text, repeats included; null: none."""
    crc = zlib.crc32
    words = [crc(w) for w in (text or "").encode("utf-8", "surrogatepass").split()]
    one = np.array(words, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def _sampled(labels: DataFrame, label_rows: int) -> DataFrame:
    """(doc_id, good, fit): at most label_rows, one per doc_id (the best quality, if it repeats)."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(label_rows)
    return work_table(rows.select("doc_id", "good", (F.pmod("h", F.lit(2)) == 0).alias("fit")), "label-sample")


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of raw text, and of the target text (good and fit)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, use in zip(batch.text, batch.target, strict=True):
                found = np.bincount(features(text), minlength=BUCKETS)
                raw += found
                if use:
                    target += found
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    found = docs.select("text", F.coalesce(F.col("good") & F.col("fit"), F.lit(False)).alias("target")).mapInPandas(count, "bucket long, raw long, target long")
    sums = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most BUCKETS rows
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, sums.bucket] = sums.raw, sums.target
    return out[0], out[1]


def _level(labelled: pd.DataFrame) -> float:
    """The weight from which keeping costs least on labelled rows; -inf without bad ones."""
    labelled = labelled.sort_values("log_weight")
    good = labelled.good.to_numpy(bool)
    if good.all() or not good.any():
        return -np.inf
    # cutting before row i loses the good rows below i and keeps the bad ones from i on
    lost = np.concatenate([[0], np.cumsum(good)])
    kept = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    cut = int(np.argmin((LOSS_OF_GOOD * lost + kept)[:-1]))
    weight = labelled.log_weight.to_numpy()
    return float(weight[cut] + weight[cut - 1]) / 2 if cut else -np.inf  # halfway to the best that goes


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly, by histograms ever finer around it."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while True:
        if k < 1 or low is None:
            return np.inf
        width = (high - low) / bins
        if not width or low + width == low:
            return high
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        inside = rows.where(F.col(key).between(low, high))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        for b in found:
            if k <= b.n:
                break
            k -= b.n
        low, high = b.low, b.high
        if b.n == 1 or low == high:
            return high if k == 1 or low == high else low
        if k == 1:
            return high


class Sampler:
    """The fitted weights and the k-th largest key; ``key`` and ``kept`` are columns of (doc_id, text)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, temperature: float = 1.0, seed: int = 7):
        self.temperature, self.seed = temperature, seed
        sample = F.broadcast(_sampled(labels, label_rows))  # at most label_rows rows of (long, two booleans)
        rows = docs.select("doc_id", "text").join(sample, "doc_id", "left")
        raw, target = counts(rows)
        ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
        self.ratio = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles
        weighed = rows.select("doc_id", "good", "fit", self.weigh("text").alias("w"))
        weighed = weighed.select("doc_id", "good", "fit", F.col("w.n_features").alias("n_features"), F.col("w.log_weight").alias("log_weight"))
        self.weights = work_table(weighed.withColumn("gumbel_key", self.key("log_weight")), "weights")
        labelled = self.weights.where("not fit and good is not null").select("log_weight", "good").toPandas()  # at most label_rows
        self.level = _level(labelled)
        self.k = self.weights.where(F.col("log_weight") >= self.level).count()
        self.least = kth_largest(self.weights, "gumbel_key", self.k)

    def weigh(self, text_col: str) -> F.Column:
        shared = self.ratio

        @F.pandas_udf("n_features long, log_weight double")
        def weight(texts: pd.Series) -> pd.DataFrame:
            table, sizes, weights = shared.value, [], []
            for text in texts:  # one document's features at a time
                found = features(text)
                sizes.append(len(found))
                weights.append(REFERENCE * float(table[found].sum()) / (len(found) + SHRINK))
            return pd.DataFrame({"n_features": sizes, "log_weight": weights})

        return weight(text_col)

    def key(self, log_weight: str | F.Column) -> F.Column:
        uniform = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return (F.col(log_weight) if isinstance(log_weight, str) else log_weight) / self.temperature - F.log(-F.log(uniform))

    def kept(self) -> F.Column:
        """For filtering (doc_id, text) rows in place: the same keys again, no join."""
        return self.key(self.weigh("text")["log_weight"]) >= F.lit(float(self.least))


def resample(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, temperature: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, kept), one row per input row.

    A null or empty text has no features and weight 0. Rows of equal doc_id and text get equal keys
    and share their fate, so ties at the k-th key are all kept. Without labels of both kinds every
    document is kept. Other input columns are ignored.
    """
    rows = rows_of(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    found = Sampler(rows, labels, label_rows, temperature, seed)
    return found.weights.select("doc_id", "n_features", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(float(found.least))).alias("kept"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Importance weight, key and verdict of every row of ``documents``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
