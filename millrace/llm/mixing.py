"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, joined by as many further
rounds as the repeat limit allows. A document's virtual finish time is the cumulative
size of its queue up to and with it, divided by the source's target. All queues are
served in the order of finish times until the total budget is spent; as every queue
reaches its target at time 1, each source's part comes within about one document of it.

Defined cases: a null text has size 0; a null source is a source of its own, ordered
last; documents of size 0 are never taken; an empty table gives an empty table; rows that
are equal throughout count as separate documents, each with its own place in the queue
if their ids differ, in one arbitrary but fixed order if not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2


def targets(sized: DataFrame, weights: Sequence[float], share: float, repeats: int, scratch: common.Scratch) -> tuple[DataFrame, float]:
    """(source, source_size, target) and the sum of all targets.

    Sources in their order take the weights in turn. A target is the source's weight times
    one level, or its cap, ``repeats`` times its size, if that is less. The level starts as
    the budget shared by weight and rises as what the capped leave is reshared, until none
    is above; each round sums over the sources in Spark and gives the driver three numbers.
    """
    n = common.partitions_of(sized.sparkSession)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    numbered = common.running_totals(per, [F.col("source").isNull(), F.col("source")], None, "one", n, scratch)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("running") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = scratch.keep(numbered.select("source", "source_size", turn.alias("weight"), (F.lit(float(repeats)) * F.col("source_size")).alias("cap")))
    whole, total, still = plan.agg(F.sum("weight"), F.sum("source_size"), F.count("*")).first()
    if not total:
        return plan.select("source", "source_size", F.lit(0.0).alias("target")), 0.0
    level = share * total / whole
    while True:
        over = F.col("weight") * level >= F.col("cap")
        capped, whole, left = plan.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(F.when(over, 0).otherwise(1))).first()
        if not left or left == still:
            break
        level, still = (share * total - capped) / whole, left
    target = F.least(F.col("weight") * level, F.col("cap"))
    return plan.select("source", "source_size", target.alias("target")), min(share, float(repeats)) * total


def _sizes(batches):
    for b in batches:
        n = [len(t.split()) for t in common.texts(b)]
        keep = [i for i, f in enumerate(b.schema.names) if f != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(n, pa.int64())], names=[*(b.schema.names[i] for i in keep), "size"])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and copies: how often each document is taken.

    The driver holds a few sums, nothing per source or document.
    """
    spark = docs.sparkSession
    scratch, n = common.Scratch(spark), common.partitions_of(spark)
    sized = scratch.keep(docs.select("doc_id", "source", "text").mapInArrow(_sizes, "doc_id long, source string, size long"))
    plan, budget = targets(sized, weights, share, repeats, scratch)
    # xxhash64 skips nulls, so a null id still has a place in the order
    shuffled = sized.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    queue = common.running_totals(shuffled, [F.col("source"), F.col("turn"), F.col("doc_id"), F.col("size")], "source", "size", n, scratch)
    q, p = queue.alias("q"), plan.alias("p")
    queue = q.join(p, F.expr("q.source <=> p.source")).select("q.*", "p.source_size", "p.target")
    if repeats > 1:
        rounds = queue.select("*", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("round"))
    else:
        rounds = queue.withColumn("round", F.lit(0))
    finish = (F.col("running") + F.col("round") * F.col("source_size")) / F.col("target")
    served = rounds.filter("size > 0 and target > 0").select("doc_id", "turn", "source", "round", "size", "running", finish.alias("finish")).withColumnRenamed("running", "place")
    served = common.running_totals(served, [F.col(c) for c in ("finish", "turn", "source", "place", "round")], None, "size", n, scratch)
    # The last document served may stand across the budget's end; it stays if most of it fits.
    taken = served.filter(F.col("running") - F.col("size") / 2 <= F.lit(budget)).groupBy("source", "place").agg(F.count("*").alias("copies"))
    # (source, place) names a document of positive size: places in a queue grow by its size.
    return (
        queue.alias("q").join(taken.alias("t"), F.expr("q.source <=> t.source and q.running = t.place and q.size > 0"), "left")
        .select("q.doc_id", "q.source", "q.size", "q.source_size", "q.target", F.expr("coalesce(t.copies, 0)").alias("copies"))
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix; one that is taken twice stands there twice.

    Rows that share an id share its copies: each is kept as often as the one of them that is taken most.
    """
    common.ship(spark)
    copies = mix(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("__copies")).withColumnRenamed("doc_id", "__id")
    # the columns travel as one, so that none can clash with the stage's own
    row = docs.select(F.col("doc_id").alias("__of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    joined = row.join(copies, F.col("__of").eqNullSafe(F.col("__id")))
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
