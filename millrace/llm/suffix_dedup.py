"""Suffix dedup by distributed prefix doubling, behind filters that leave few positions to rank.

Prefix doubling. A position's rank says which string starts there: equal strings, equal rank.
Inside a text, names of 32 bytes are made by doubling from single bytes. From there Spark
works on (position, rank, rank at an offset): it sorts the pairs over all texts, gives each
pair the place of the first equal one as its new rank (``_rerank``), drops positions whose
pair is unique, brings the ranks of a text's positions together again and pairs them at the
next offset (``_pair_up``): 32, 64 and then 72, which is where 128 bytes and 128 bytes cover
the threshold of 200. Windows that still share a rank are repeated. See ``doubling``.

Ranking every position of the input would move about 24 bytes for each byte of it in each
round; the filters before it, which lose nothing, take away what is unique or settled whole:

1. Anchors. Every 200-byte window is represented by its anchor, the least of its 64-byte
   names (the first, if equal). Equal windows have equal anchors at equal offsets, and about
   one position in 69 is an anchor. Windows of an anchor whose name is unique are unique.
2. Runs, all bytes of the windows of one anchor: equal runs repeat each other, and one run
   of each kind goes on; 132 bytes to the left of the anchor or to its right are in every
   window of that side, so where they are unique the side is.
3. Groups of 17 windows of neighbouring offsets, in the same two ways: equal groups repeat
   each other, and groups without a partner in the 184 bytes they have in common are unique.

Names are 64 bits; runs and groups are compared by two of them, ranks by all their bytes'
names. Rows are named by 96 bits.

Defined cases: a null or empty text has no bytes and the digest of none; a text shorter
than the window loses nothing; a row that is repeated is a repetition like any other; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

WINDOW = 200
SEED_BYTES = 64
#: Bytes of a text that are named at a time; windows that start in it may end beyond it.
CHUNK = 1 << 17
#: Neighbouring window offsets that round 3 takes together; divides the offsets of one side.
OFFSETS = 17
_BITS = np.uint64(18)


def _names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of a power of two bytes that start at each position."""
    name = common.mix(data.astype(np.uint64))
    h = 1
    with np.errstate(over="ignore"):
        while h < length:
            name = name[:-h] * np.uint64(0x9E3779B97F4A7C15) + (name[h:] ^ (name[h:] >> np.uint64(29)))
            name ^= name >> np.uint64(32)
            h *= 2
        return name * np.uint64(0xBF58476D1CE4E5B9)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    h = 1
    while 2 * h <= width:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if width > h else x


def pack(first, last, anchor=None):
    """A run of window starts in 64 bits: the first, how many follow, and how far its anchor is."""
    return first << 32 | (last - first) << 16 | (0 if anchor is None else anchor - first)


def unpack(span):
    """First and last window start of a run, and its anchor."""
    first = span >> 32
    return first, first + (span >> 16 & 0xFFFF), first + (span & 0xFFFF)


class Buffer:
    """Slices of texts laid end to end, so that short texts are named many at a time."""

    def __init__(self, window: int):
        self.window, self.parts, self.owner, self.at, self.size = window, [], [], [], 0

    def add(self, owner: int, text: bytes, keys_only: bool = False):
        """Append a text in slices of CHUNK window starts; yields what a full buffer holds."""
        for at in range(0, len(text) - self.window + 1, CHUNK):
            part = text[at : at + CHUNK + self.window - 1]
            if self.size and self.size + len(part) > 2 * CHUNK - 64:
                yield self.empty(keys_only)
            self.parts.append(part)
            self.owner.append(owner)
            self.at.append(at)
            self.size += len(part)

    def empty(self, keys_only: bool = False):
        """owner, span, key, whole, left, right: the runs of window starts that share an anchor; or their keys alone.

        Spans are of positions in the owner's text; left and right are 0 where the run has
        no window on that side.
        """
        window, half = self.window, _half(self.window)
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        sizes = np.array([len(x) for x in self.parts])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        name = _names(data, SEED_BYTES)
        anchor = _anchors(name, window)
        inside = np.arange(len(anchor)) <= np.repeat(begin + sizes - window, sizes)[: len(anchor)]
        start = np.flatnonzero(inside)
        anchor = anchor[start]
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        first, last = start[np.concatenate(([0], cuts))], start[np.concatenate((cuts, [len(start)])) - 1]
        a = anchor[np.concatenate(([0], cuts))]
        owner, at = self.owner, self.at
        self.parts, self.owner, self.at, self.size = [], [], [], 0
        if keys_only:
            return (name[a],)
        prefix = common.prefix_hash(data)
        whole = common.span_hash(prefix, first, last + window)
        is_left, is_right = first <= a - half, last > a - half
        left = np.where(is_left, common.span_hash(prefix, np.where(is_left, a - half, 0), a + SEED_BYTES), 0)
        right = np.where(is_right, common.span_hash(prefix, a, np.where(is_right, a + window - half, a)), 0)
        part = np.searchsorted(begin, first, side="right") - 1
        shift = (np.array(at) - begin)[part]
        return np.array(owner)[part], pack(first + shift, last + shift, a + shift), name[a], whole, left, right


def _half(window: int) -> int:
    return (window - SEED_BYTES) // 2


def _anchors(name: np.ndarray, window: int) -> np.ndarray:
    """Position of the anchor of each window."""
    ranked = (name >> _BITS << _BITS) | np.arange(len(name), dtype=np.uint64)
    return (_least(ranked, window - SEED_BYTES + 1) & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)


def _signed(x) -> np.ndarray:
    return np.ascontiguousarray(x).astype(np.uint64).view(np.int64) if x.dtype != np.int64 else x


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(_signed(c) if n != "more" else c.astype(np.int32)) for n, c in zip(names, cols, strict=True)], names=names)


def _round_one(window, keys_only):
    names = ["key"] if keys_only else ["key", "uid", "more", "span", "whole", "left", "right"]

    def run(batches):
        for b in batches:
            uid, more = b.column(0).to_numpy(), b.column(1).to_numpy()
            buffer, rows = Buffer(window), []

            def take(found):
                if keys_only:
                    rows.append(found)
                else:
                    owner, span, key, *rest = found
                    rows.append((key, uid[owner], more[owner], span, *rest))

            for k, text in enumerate(common.texts(b)):
                for full in buffer.add(k, text, keys_only):
                    take(full)
            if buffer.size:
                take(buffer.empty(keys_only))
            yield _emit(rows, names)

    return run


def _cut_runs(window):
    """(uid, more, text, todo) to the runs that go on, with their bytes: key, uid, more, span, sides, bytes."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for u, more, text, todo in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts(b), b.column(3).to_pylist(), strict=True):
                for r in todo:
                    first, last, _ = unpack(r["span"])
                    out.append((r["key"], u, more, r["span"], r["sides"], text[first : last + window]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "uid", "more", "span", "sides", "bytes"])

    return run


def _laid(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row's begin."""
    parts = b.column(at).to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1])).astype(np.int64)


def _round_three(window):
    """(run, key, span, sides, bytes) to the groups of neighbouring offsets that have windows in each run, with their core and whole."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            run, key, span, sides = (b.column(i).to_numpy() for i in range(4))
            first, last, anchor = unpack(span)
            data, begin = _laid(b, 4)
            prefix, rows = common.prefix_hash(data), []
            own, n = anchor - first, last - first + 1
            for g in range((window - SEED_BYTES) // OFFSETS + 1):
                # offsets g * OFFSETS to one less than the next group's, those at most that the run has
                low, high = np.maximum(g * OFFSETS, own - (n - 1)), np.minimum((g + 1) * OFFSETS - 1, own)
                k = np.flatnonzero((low <= high) & (sides & (1 if g * OFFSETS >= _half(window) else 2) > 0))
                if not len(k):
                    continue
                a, z, at = (own - high)[k], (own - low)[k], begin[k]
                c0, c1 = (own - g * OFFSETS)[k], (own - (g + 1) * OFFSETS + 1 + window)[k]
                core, whole = common.span_hash(prefix, at + c0, at + c1), common.span_hash(prefix, at + a, at + z + window)
                rows.append((key[k], run[k], pack(first[k] + a, first[k] + z), np.full(len(k), g), core, whole))
            yield _emit(rows, ["key", "run", "span", "grp", "core", "whole"])

    return run


def offsets(window: int) -> list[int]:
    """Offsets at which ranks are paired, from names of half SEED_BYTES up to the window: doubling, the last one what is missing."""
    out, length = [], SEED_BYTES // 2
    while length < window:
        out.append(min(length, window - length))
        length += out[-1]
    return out


def _first_pairs(window):
    """(run, first, bytes, spans) to (run, at, a, b): the names at each position that the spans' windows need, and those at the first offset.

    at: twice the place in the run, and one more where a window of the spans starts.
    """
    steps = offsets(window)
    needed = np.zeros(1, np.int64)
    for o in steps[:0:-1]:
        needed = np.unique(np.concatenate([needed, needed + o]))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            run, first, spans = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            data, begin = _laid(b, 2)
            name = _names(data, SEED_BYTES // 2)
            # window starts as places in the bytes laid end to end, which tell rows apart too
            row = np.repeat(np.arange(len(run)), np.asarray(spans.value_lengths()))
            a, z, _ = unpack(spans.flatten().to_numpy())
            many = z - a + 1
            starts = np.repeat(a - first[row] + begin[row] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            at = np.unique((starts[:, None] + needed).ravel())
            of = np.searchsorted(begin, at, side="right") - 1
            yield _emit([(run[of], 2 * (at - begin[of]) + np.isin(at, starts), name[at], name[at + steps[0]])], ["run", "at", "a", "b"])

    return run


def _rerank(batches):
    """Rows (run, at, a, b) sorted by the pair (a, b) to (run, at, rank): the place of the first row with the pair; unique pairs go.

    Equal pairs are in one partition, so the partition and the place in it make the rank.
    """
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    seen, last, held = 0, None, None  # last: the pair that the rows before end in, and its rank, if it is known to be shared
    for batch in batches:
        run, at, a, b = (c.to_numpy() for c in batch.columns)
        if held is not None:
            run, at, a, b = (np.concatenate(([x], y)) for x, y in zip(held, (run, at, a, b), strict=True))
            seen -= 1
        if not len(run):
            continue
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(run)])))
        rank, shared = base + seen + first, size > 1
        if last is not None and last[:2] == (a[0], b[0]):
            rank[0], shared[0] = last[2], True
        # a last row that stands alone may go on in the next batch
        held = None if shared[-1] else (run[-1], at[-1], a[-1], b[-1])
        last = (a[-1], b[-1], rank[-1]) if shared[-1] else None
        seen += len(run)
        on = np.repeat(shared, size)
        yield pa.RecordBatch.from_arrays([pa.array(run[on]), pa.array(at[on]), pa.array(np.repeat(rank, size)[on])], names=["run", "at", "rank"])


def _pair_up(offset, last):
    """Rows (run, at, rank) sorted by run and place to (run, at, a, b): each rank and the one at the offset, where there is one.

    last: only where a window starts. Two runs may both have needed a place of one text, but a
    window starts in one run alone, so ranks of windows are shared by different places.
    """

    def run(batches):
        held = None
        for batch in _and_end(batches):
            if batch is None:
                r, at, rank = held if held is not None else (np.zeros(0, np.int64),) * 3
                held = None
            else:
                r, at, rank = (c.to_numpy() for c in batch.columns)
                if held is not None:
                    r, at, rank = (np.concatenate(x) for x in zip(held, (r, at, rank), strict=True))
                end = int(np.searchsorted(r, r[-1])) if len(r) else 0  # the last run may go on
                held = r[end:], at[end:], rank[end:]
                r, at, rank = r[:end], at[:end], rank[:end]
            place = np.cumsum(np.concatenate(([0], r[1:] != r[:-1]))[: len(r)]) * (1 << 32) + (at >> 1)
            other = np.searchsorted(place, place + offset)
            ok = np.flatnonzero((other < len(place)) & ((at & 1 > 0) | (not last)))
            ok = ok[place[other[ok]] == place[ok] + offset]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r[ok], at[ok], rank[ok], rank[other[ok]])], names=["run", "at", "a", "b"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def doubling(runs: DataFrame, window: int, scratch: common.Scratch) -> DataFrame:
    """(run, at) of the windows that start again elsewhere among those of the runs' spans. runs: run, first, bytes, spans."""
    n = common.partitions_of(runs.sparkSession)
    pairs = runs.select("run", "first", "bytes", "spans").mapInArrow(_first_pairs(window), "run long, at long, a long, b long")
    steps = offsets(window)
    for k, o in enumerate(steps):
        if k:
            dealt = ranked.repartition("run").sortWithinPartitions("run", "at")  # noqa: F821  of the round before
            pairs = dealt.mapInArrow(_pair_up(o, k == len(steps) - 1), "run long, at long, a long, b long")
        pairs = scratch.keep(pairs)
        ranked = scratch.keep(pairs.repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_rerank, "run long, at long, rank long"))
        scratch.drop(pairs)
    return ranked.select("run", F.shiftright("at", 1).alias("at"))


def covered(spans: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of bytes that the windows starting in the spans cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        first, last, _ = unpack(s)
        start, end = first, last + window
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _remove(window, with_text):
    def run(batches):
        for b in batches:
            ids, found = b.column(0), b.column(b.schema.get_field_index("spans")).to_pylist()
            n, gone, spans, sha, kept = [], [], [], [], []
            for text, s in zip(common.texts(b), found, strict=True):
                parts, at = covered(s or [], window), 0
                left = []
                for start, end in parts:
                    left.append(text[at:start])
                    at = end
                rest = b"".join([*left, text[at:]])
                n.append(len(text))
                gone.append(len(text) - len(rest))
                spans.append(len(parts))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    scratch = common.Scratch(docs.sparkSession)
    # names of a row: rows that agree in them agree in all that matters here
    row = ["uid", "more"]
    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.shiftright(F.xxhash64(F.lit(1), "text", "doc_id"), 32).cast("int").alias("more"), "text")
    picks = named.select(*row, "text")
    again = picks.mapInArrow(_round_one(window, True), "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    all_runs = picks.mapInArrow(_round_one(window, False), "key long, uid long, more int, span long, whole long, left long, right long")
    # a table of its own, so that a key's many rows can be split in the join
    alive = scratch.keep(all_runs.join(scratch.keep(again), "key"))

    distinct = alive.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*row, "span")).alias("one"), F.min("left").alias("left"), F.min("right").alias("right"))
    distinct = scratch.keep(distinct.select("key", "whole", "n", "one.*", "left", "right"))

    def shared(side):
        return distinct.filter(F.col(side) != 0).groupBy("key", side).agg(F.count("*").alias("m")).filter("m > 1").select("key", side, F.lit(True).alias(f"go_{side}"))

    todo = distinct.join(shared("left"), ["key", "left"], "left").join(shared("right"), ["key", "right"], "left")
    sides = F.when(F.col("go_left"), 1).otherwise(0) + F.when(F.col("go_right"), 2).otherwise(0)
    todo = todo.select(*row, F.struct("key", "span", sides.alias("sides")).alias("r")).filter("r.sides > 0").groupBy(*row).agg(F.collect_list("r").alias("todo"))
    cut = named.join(todo, row).select(*row, "text", "todo").mapInArrow(_cut_runs(window), "key long, uid long, more int, span long, sides int, bytes binary")
    parts = scratch.keep(cut.dropDuplicates([*row, "span"]).withColumn("first", F.shiftright("span", 32)).withColumn("run", F.monotonically_increasing_id()))

    groups = parts.select("run", "key", "span", "sides", "bytes").mapInArrow(_round_three(window), "key long, run long, span long, grp long, core long, whole long")
    groups = scratch.keep(groups)
    kinds = groups.groupBy("key", "core", "grp", "whole").agg(F.count("*").alias("n"), F.min(F.struct("run", "span")).alias("one"))
    kinds = scratch.keep(kinds.select("key", "core", "grp", "whole", "n", "one.*"))
    owner = parts.select("run", *row, "first")
    some = groups.join(kinds.filter("n > 1").select("key", "core", "grp", "whole"), ["key", "core", "grp", "whole"]).select("run", "span")
    mixed = kinds.join(kinds.groupBy("key", "core", "grp").agg(F.count("*").alias("m")).filter("m > 1"), ["key", "core", "grp"])
    left = scratch.keep(parts.select("run", "first", "bytes").join(mixed.groupBy("run").agg(F.collect_list("span").alias("spans")), "run"))
    at = doubling(left, window, scratch).withColumnRenamed("at", "__at").join(owner, "run")
    start = F.col("__at") + F.col("first")
    single = at.select(*row, F.shiftleft(start, 32).alias("span"))
    some = some.join(owner, "run").select(*row, "span")
    whole = alive.join(distinct.filter("n > 1").select("key", "whole"), ["key", "whole"]).select(*row, "span")
    spans = whole.unionByName(some).unionByName(single).groupBy(*row).agg(F.collect_set("span").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return named.join(spans, row, "left").select("doc_id", "text", "spans").mapInArrow(_remove(window, with_text), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
