"""What the operators of this subpackage share: tables, scratch space, hashing and ordered prefix sums.

Null handling is the same everywhere: a null text is an empty text, a null id is an id
of its own kind that is carried through but never linked with anything.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` parts at exactly these, so words of a text are ``text.encode().split()``.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Most bytes of the Arrow batches that Python steps are given, so that rows may be large and a task holds few of them.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once a session, so that they need no shared code folder, and bound the session's Arrow batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_millrace_shipped", False):
        return spark
    top = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="millrace")) / "millrace_code.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(file))
    sc._millrace_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the cluster's shared folder, to cut lineage where a lost executor would cost most.

    The folder is ``spark.checkpoint.dir``; where that is unset and all of Spark runs in this
    machine's one process (tests, a notebook) a temporary one serves, and on a cluster that
    is an error. Tables go when dropped or when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            root = f"file://{tempfile.gettempdir()}/millrace-scratch"
        self.root = f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._clear)

    def keep(self, df: DataFrame, codec: str = "zstd", rows_a_batch: int | None = None, tasks: int | None = None) -> DataFrame:
        """Write df and return a DataFrame that reads what was written; the write's shuffle files go with it.

        rows_a_batch: of the Arrow batches of its Python steps, where rows are large.
        tasks: that run df's last stage and write a file each, at most, where that stage only ends an aggregate.
        """
        if tasks:
            df = df.coalesce(tasks)
        self.count += 1
        path = f"{self.root}/{self.count}"
        conf = self.spark.conf
        wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        if rows_a_batch:
            wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows_a_batch)
        before = {k: conf.get(k) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of keep() that no later plan reads."""
        for df in dfs:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        """Delete all tables of keep(), where no later plan reads any."""
        self._delete(self.root)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session has ended
            self._delete(self.root)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    x = batch.column(batch.schema.get_field_index(column))
    return [b or b"" for b in x.cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> list[int | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


# Hashing ---------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters nearby values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MULT
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes or code points, one entry more than there are."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        code = _BYTE_CODE[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(1))
        np.cumsum(code * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever in a text they stand."""
    _, down = _power_tables(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as bytes."""
    edge = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each word, in stretches of about a megabyte that end between words."""
    start, end = word_spans(data)
    out, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20), side="right")))
        base = start[at]
        out.append(span_hash(prefix_hash(data[base : end[to - 1]]), start[at:to] - base, end[at:to] - base))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and nothing else."""
    return _UPPER[data]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; of the whole sequence where it is shorter, of nothing where it is empty."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * _MULT + words[i : len(words) - n + 1 + i])
    return out


# Order -----------------------------------------------------------------------------------


def running_totals(df: DataFrame, order: list[Column], key: str | None, value: str, partitions: int, scratch: Scratch) -> DataFrame:
    """df with ``running``: the sum of value up to and with each row, in the order given, per key if one is named.

    The rows are dealt by ranges of the order, summed inside each range, and moved up by
    the totals of the ranges before: no key or order needs one task, however hot. The
    order must begin with the key. Column ``value`` must hold integers and no nulls.
    """
    cols = df.columns
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", `__part` int, `__local` long"

    def sums(batches):
        from pyspark import TaskContext

        part, total, last = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            v = np.asarray(b.column(cols.index(value)).to_numpy(zero_copy_only=False), np.int64)
            local = np.cumsum(v)
            if key is None:
                local += total
                total = int(local[-1]) if len(v) else total
            else:
                k = b.column(cols.index(key)).to_pylist()
                base = 0
                for i, x in enumerate(k):
                    if x != last:
                        base, last = -(int(local[i]) - int(v[i])), x
                    elif i == 0:
                        base = total
                    local[i] += base
                total = int(local[-1]) if len(v) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(local)], names=[*cols, "__part", "__local"])

    kept = scratch.keep(dealt.mapInArrow(sums, schema))
    from pyspark.sql import Window

    group = [F.col(key)] if key else []
    ends = kept.groupBy(*group, "__part").agg(F.max("__local").alias("__end"))
    before = Window.partitionBy(*group, *([] if key else [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[c.alias("__key") for c in group], F.col("__part").alias("__at"), F.coalesce(F.sum("__end").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__at")
    if key:
        same = same & F.col(key).eqNullSafe(F.col("__key"))
    return kept.join(ends, same).select(*cols, (F.col("__local") + F.col("__before")).alias("running"))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def writers(spark: SparkSession) -> int:
    """Tasks enough to write an aggregate: a quarter of the shuffle's partitions, but no fewer than there are cores.

    On a file system of Hadoop's without its native library a task starts three processes for each file it writes.
    """
    return max(spark.sparkContext.defaultParallelism, -(-partitions_of(spark) // 4))
