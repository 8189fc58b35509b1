"""Quality classifier by importance resampling over hashed n-gram models.

Unigrams and bigrams of words are hashed into buckets; the target model counts them in
labelled good documents, the raw model in all documents. A document's log weight is the
log-ratio of its probability under both models. Documents are drawn without replacement
in proportion to their weights by adding Gumbel noise to the log weights and taking the
k largest (Gumbel top-k). The noise is a function of the id, so reruns agree.

The target model may be fitted on a bounded sample of labelled rows (``most``); the raw
model counts every document.

Defined cases: a null or empty text has no n-grams and log weight 0; without good labels
all weights are 0 and the draw is uniform; ties of the noisy weight go to the smaller id;
an empty table gives an empty table; repeated rows have equal weights and each its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

BUCKETS = 1 << 14
MOST_LABELLED = 20_000
SMOOTHING = 1.0


def features(text: bytes) -> np.ndarray:
    """Bucket of every unigram and bigram."""
    words = common.word_hashes(common.fold_ascii(np.frombuffer(text, np.uint8)))
    both = np.concatenate([common.mix(words), common.ngram_hashes(words, 2)]) if len(words) > 1 else common.mix(words)
    return (both >> np.uint64(50)).astype(np.int64)


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text, good in zip(common.texts(b), b.column(b.schema.get_field_index("good")).to_pylist(), strict=True):
            n = np.bincount(features(text), minlength=BUCKETS)
            raw += n
            if good:
                target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(target[at]), pa.array(raw[at])], names=["bucket", "target", "raw"])


def _weigh(ratio):
    def run(batches):
        for b in batches:
            found = [features(t) for t in common.texts(b)]
            weight = [float(ratio[f].sum()) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    return run


def log_ratio(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> np.ndarray:
    """Log of target over raw probability of each bucket; counts are summed by Spark, BUCKETS numbers reach the driver."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    share = min(1.0, most / max(good.count(), 1))
    good = good.filter(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).distinct().limit(int(1.2 * most) + 100).withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = marked.mapInArrow(_count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.any():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 23, **how) -> DataFrame:
    """doc_id, n_features, log_weight, noisy_weight, place (from 1) and kept: whether the place is among the share drawn.

    share: of all rows; if None, the share of good rows among the labelled.
    """
    scratch = common.Scratch(docs.sparkSession)
    ratio = log_ratio(docs, labels, **how)
    if share is None:
        n, good = labels.filter(F.col("quality").isin(0, 1)).agg(F.count("*"), F.sum("quality")).first()
        share = good / n if n else 1.0
    weighed = docs.select("doc_id", "text").mapInArrow(_weigh(ratio), "doc_id long, n_features long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = scratch.keep(weighed.select("*", (F.col("log_weight") - F.log(-F.log(uniform))).alias("noisy_weight"), F.lit(1).cast("long").alias("one")))
    k = round(share * noisy.count())
    placed = common.running_totals(noisy, [F.desc("noisy_weight"), F.asc("doc_id"), F.asc("n_features")], None, "one", common.partitions_of(docs.sparkSession), scratch)
    return placed.select("doc_id", "n_features", "log_weight", "noisy_weight", F.col("running").alias("place"), (F.col("running") <= k).alias("kept"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
