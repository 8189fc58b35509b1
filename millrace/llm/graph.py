"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

#: Nodes whose joins a task remembers; then it tells them and forgets them.
REMEMBERED = 200_000


def _contract(remembered: int):
    """Edges (a, b) to edges that join the same nodes: each node of a task with the least one that the task's edges reach from it."""

    def run(batches):
        parent: dict = {}

        def top(x):
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for batch in batches:
            types, names = batch.schema.types, batch.schema.names

            def stars(types=types, names=names):
                return pa.RecordBatch.from_arrays([pa.array(list(parent), types[0]), pa.array([top(x) for x in list(parent)], types[1])], names=names)

            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = top(x), top(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    if len(parent) >= remembered:
                        yield stars()
                        parent.clear()
        if parent:
            yield stars()

    return run


def _settled(edges: DataFrame) -> bool:
    """Whether every a has one b and no b is an a: then each b is the least node of its component."""
    nothing = F.lit(None).cast(edges.schema["b"].dataType)
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), nothing.alias("y"), F.lit(1).alias("root")))
    by = ends.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("root").alias("root"))
    return not by.agg(F.coalesce(F.max(F.expr("lo < hi or (lo is not null and root = 1)")), F.lit(False)).alias("open")).first().open


def components(edges: DataFrame, scratch: Scratch, remembered: int = REMEMBERED) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the least node of its component.

    Each task first joins what its own edges reach, in bounded memory. While that leaves more
    than stars, alternating large-star and small-star steps follow: each joins the edges with
    one minimum per node, so a hub of any degree costs its degree, is combined before the
    shuffle and can be split by the skew join. The driver sees one boolean a round.
    """
    schema = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}"
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").mapInArrow(_contract(remembered), schema))
    while not _settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        starred = scratch.keep(small.filter("a > b").distinct())
        scratch.drop(now)
        # a task of a scan reads many parts of the shuffle
        now = scratch.keep(starred.mapInArrow(_contract(remembered), schema))
        scratch.drop(starred)
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("x")
    return scratch.keep(now.select(both).select("x.*").distinct())
