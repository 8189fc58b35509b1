"""Exact top-k inner products by columnar branch-and-bound.

Candidates lie in vertical layout, one row of numbers per dimension. Scores grow block by
block of dimensions; after each block a candidate whose score so far plus the most that
the remaining mass allows (the product of the remaining norms of query and candidate)
is under the query's k-th best so far is dropped, and the survivors are compacted.

Queries and candidates are packed in blocks of at most ``BLOCK_BYTES``, and Spark deals
every pair of a query block and a candidate block to some task: query blocks are copied
``salts`` times, so that few of them still keep all tasks busy. A task answers with k rows a
query of each run of blocks, and the last step ranks those. Neither side is ever gathered.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take
no part; vectors of other lengths than the query's are no candidates of it; rows that
repeat a vec_id are candidates each, and of several usable query rows with one vec_id the
least vector asks; no queries or no candidates give no rows. Components are exact up to 2^20 in
size after scaling; larger ones are computed with Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

K = 10
SCALE = 1024
DIMENSION_BLOCK = 16
BLOCK_BYTES = 2 << 20
#: Pairs of blocks in an Arrow batch.
PAIRS_A_BATCH = 4
TILE, QUERY_TILE, SEED = 8192, 64, 256
EXACT = 1 << 20


def vectors(batch: pa.RecordBatch, ids: str = "vec_id", column: str = "embedding"):
    """Groups of usable rows by length: (ids, floor(SCALE * x) as float64 matrix)."""
    i, x = batch.column(batch.schema.get_field_index(ids)), batch.column(batch.schema.get_field_index(column))
    size = np.asarray(x.value_lengths().fill_null(0))
    usable = (size > 0) & ~np.asarray(i.is_null())
    for dim in np.unique(size[usable]):
        at = np.flatnonzero(usable & (size == dim))
        flat = x.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(flat * SCALE)
        ok = np.isfinite(q).all(axis=1)  # a null component has become NaN
        yield i.take(pa.array(at)).to_numpy(zero_copy_only=False)[ok], q[ok]


def _pack(rows_of):
    """Query rows to packed blocks: dim, ids, components."""

    def run(batches):
        for b in batches:
            dims, ids, comps = [], [], []
            for i, q in vectors(b):
                step = rows_of(q.shape[1])
                for k in range(0, len(i), step):
                    dims.append(q.shape[1])
                    ids.append(i[k : k + step].astype(np.int64).tobytes())
                    comps.append(q[k : k + step].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(ids, pa.binary()), pa.array(comps, pa.binary())], names=["dim", "ids", "comps"])

    return run


class Search:
    """Best k candidates so far of each query of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int = K):
        self.ids, self.q, self.k = ids, q, k
        self.edges = [*range(0, q.shape[1], DIMENSION_BLOCK), q.shape[1]]
        self.mass = self._remaining(q)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.least = np.full(len(ids), -np.inf)
        self.large = float(np.abs(q).max(initial=0))

    def _remaining(self, x: np.ndarray) -> np.ndarray:
        """Norm of what lies after each block, widened for rounding."""
        square = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
        return np.stack([np.sqrt(square[:, e]) if e < x.shape[1] else np.zeros(len(x)) for e in self.edges[1:]], axis=1) * (1 + 1e-9)

    def _offer(self, n: int, score: np.ndarray, ids: np.ndarray) -> None:
        own = ids != self.ids[n]
        s, i = np.concatenate([self.best[n][0], score[own]]), np.concatenate([self.best[n][1], ids[own]])
        at = np.lexsort((i, -s))[: self.k]
        self.best[n] = s[at], i[at]
        if len(at) == self.k:
            self.least[n] = s[at[-1]]

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        if max(self.large, float(np.abs(c).max(initial=0))) > EXACT:
            exact = [[int(v) for v in row] for row in c]
            for n, q in enumerate(self.q):
                q = [int(v) for v in q]
                score = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, row, strict=True)))) for row in exact]
                self._offer(n, np.array(score, np.int64), ids)
            return
        for at in ([0, *range(SEED, len(ids), TILE)] if len(ids) > SEED else [0]):
            part = slice(at, SEED if at == 0 and len(ids) > SEED else at + TILE)
            self._tile(ids[part], np.ascontiguousarray(c[part].T), self._remaining(c[part]))

    def _tile(self, ids, columns, mass):
        edges = self.edges
        for at in range(0, len(self.ids), QUERY_TILE):
            rows = slice(at, at + QUERY_TILE)
            first = self.q[rows, : edges[1]] @ columns[: edges[1]]
            alive = first + self.mass[rows, :1] * mass[:, 0] + 1 >= self.least[rows, None]
            for k in np.flatnonzero(alive.any(axis=1)):
                n = at + k
                on = np.flatnonzero(alive[k])
                score = first[k, on]
                for b in range(1, len(edges) - 1):
                    score = score + self.q[n, edges[b] : edges[b + 1]] @ columns[edges[b] : edges[b + 1], on]
                    ok = score + self.mass[n, b] * mass[on, b] + 1 >= self.least[n]
                    if not ok.all():
                        on, score = on[ok], score[ok]
                    if not len(on):
                        break
                if len(on):
                    self._offer(n, score.astype(np.int64), ids[on])


def _probe(k):
    """Pairs of blocks (block, ids, comps; other ids, comps; dim), sorted by block, to query_id, vec_id, score: the k best of each query in a run of one block."""

    def answer(search):
        out = [(np.full(len(s), q), i, s) for q, (s, i) in zip(search.ids, search.best, strict=True) if len(s)] if search else []
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def run(batches):
        at, search = None, None
        for b in batches:
            for block, ids, comps, cids, ccomps, dim in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != at:
                    yield answer(search)
                    at, search = block, Search(np.frombuffer(ids, np.int64), np.frombuffer(comps, np.float64).reshape(-1, dim), k)
                search.meet(np.frombuffer(cids, np.int64), np.frombuffer(ccomps, np.float64).reshape(-1, dim))
        yield answer(search)

    return run


#: Vectors that take part.
USABLE = "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the smaller vec_id."""
    spark = candidates.sparkSession
    scratch = common.Scratch(spark)

    def packed(df, name):
        rows = df.mapInArrow(_pack(lambda dim: max(1, BLOCK_BYTES // (8 * dim + 8))), "dim int, ids binary, comps binary")
        return scratch.keep(rows.withColumn(name, F.monotonically_increasing_id()))

    asked = packed(queries.filter(USABLE).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "block")
    of = packed(candidates.select("vec_id", "embedding").filter(USABLE), "other").select("dim", "other", F.col("ids").alias("cids"), F.col("comps").alias("ccomps"))
    blocks = asked.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    salts = max(1, -(-common.partitions_of(spark) // max(1, asked.count())))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    left = asked.select("dim", "block", "ids", "comps", salt)
    right = of.join(blocks, "dim").select("cids", "ccomps", F.explode("blocks").alias("block"), F.pmod(F.xxhash64("other"), F.lit(salts)).cast("int").alias("salt"))
    pairs = right.join(left, ["block", "salt"]).sortWithinPartitions("block").select("block", "ids", "comps", "cids", "ccomps", "dim")
    every = scratch.keep(pairs.mapInArrow(_probe(k), "query_id long, vec_id long, score long"), rows_a_batch=PAIRS_A_BATCH)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
