"""Line dedup by a segment-partition edit join.

A line is removed if an equal line, or one within the threshold of edits (insertions,
deletions, substitutions of code points), stands earlier in the corpus: in a smaller doc_id,
or higher up in the same text. The threshold grows with length: ``bands`` gives, by the
length of the shorter line, how many edits are near. Lines under the first band are matched
by equality alone, down to ``copies`` code points; blank lines under the first band stay, as
do lines under both.

A line of threshold k is split into k + 1 segments of even length. A line within the
threshold of it holds one of them unchanged, at a place and length that the threshold
bounds, so probes of substrings selected by length against the segments find every pair.
Pairs are verified by edit distance in a band of diagonals, one bit each.

Equal lines are one class from the first step on. A key that more than ``crowd`` classes
share is not expanded into pairs. First its earliest line is compared with the others: what
is near it is settled and asks no more. If few lines still ask, they are paired with the
crowd. Otherwise the matched segment is cut out, and what is left of the lines is split and
probed again, under that key, until so few characters are left that the lines agree in all
but these. Nothing of a crowd is held in memory or compared all with all.

Defined cases: a null or empty text has no lines; rows that repeat both id and text are one
document; line breaks are \\n alone; an empty table gives an empty table; a text of any
length is used whole; input columns may have any names, those of the results included, and
then the result's stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: (least length, edits) of the production thresholds.
BANDS = ((40, 1), (150, 2))
#: Least length of lines whose equal copies go.
COPIES = 1
CROWD = 32
#: Lines of a large key that are paired with all of it once they are so few.
PAIRED = 128
#: Lines whose texts may be picked by a broadcast of their names; beyond it they are joined.
BROADCAST_LINES = 400_000
#: Names of lines that a task remembers, so as not to send one twice; then it forgets them.
REMEMBERED = 200_000

Bands = tuple[tuple[int, int], ...]


def edits_at(length: np.ndarray, bands: Bands) -> np.ndarray:
    """The threshold of lines of the given lengths, -1 where they are too short for any."""
    starts, edits = np.array([a for a, _ in bands]), np.array([-1, *(k for _, k in bands)], np.int64)
    return edits[np.searchsorted(starts, length, side="right")]


def eligible(text: bytes, shortest: int):
    """(line number, line) of lines that may go."""
    for k, line in enumerate(text.split(b"\n")):
        # a line has at most as many code points as bytes
        if len(line) >= shortest and len(line.decode(errors="replace")) >= shortest:
            yield k, line


def name(line: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(line, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lines(shortest, copies):
    def may_go(text):
        # blank lines are no text: equal ones only go where they always did
        return ((k, line) for k, line in eligible(text, copies) if not line.isspace() or next(eligible(line, shortest), None))

    def run(batches):
        for b in batches:
            rows = []
            for doc, u1, u2, text in zip(*(b.column(i).to_pylist() for i in range(3)), common.texts(b), strict=True):
                rows += [(*name(line), doc, u1, u2, k) for k, line in may_go(text)]
            yield _batch(rows, {"c1": "long", "c2": "long", "doc_id": "long", "u1": "long", "u2": "long", "line": "int"})

    return run


_TYPES = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "binary": pa.binary()}


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(cols, columns.values(), strict=True)], names=list(columns))


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each segment of lines of the given lengths; the last ones are the longer."""
    base, longer = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((start, size))
        start = start + size
    return out


#: A line's own segments, and substrings of it that are another's. A substring that is both has the sum.
INDEX, PROBE = 1, 2


def _key(prefix, start, at, size, of, i) -> np.ndarray:
    h = common.span_hash(prefix, start + at, start + at + size)
    with np.errstate(over="ignore"):
        return common.mix(h * np.uint64(31) + (of.astype(np.uint64) << np.uint64(8)) + np.uint64(i)).view(np.int64)


def keys(prefix, start, length, edits, delta, sides):
    """Keys of lines that lie in one array: (row, key, sides, segment start, segment size).

    edits: each row's threshold. delta: by how much the lines it probes for are shorter.
    Rows of delta 0 have their own segments and, at the same places, the same probes.
    """
    out = []
    for k, d in {(int(k), int(d)) for k, d in zip(edits, delta, strict=True)}:
        row = np.flatnonzero((edits == k) & (delta == d))
        of, parts = length[row] - d, k + 1
        for i, (at, size) in enumerate(segments(of, parts)):
            # from the left at most i edits came before; from the right at most parts - 1 - i come after
            low, high = max(-i, d - (parts - 1 - i)), min(i, d + (parts - 1 - i))
            for shift in range(low, high + 1):
                ok = (at + shift >= 0) & (at + shift + size <= length[row])
                both = sides if d == 0 and shift == 0 else sides & PROBE
                if both:
                    r, a, s = row[ok], (at + shift)[ok], size[ok]
                    out.append((r, _key(prefix, start[r], a, s, of[ok], i), np.full(len(r), both, np.int8), a, s))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _points(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hash, starts and lengths of lines as code points."""
    points = [np.frombuffer(x.decode(errors="replace").encode("utf-32-le"), np.uint32) for x in lines]
    length = np.array([len(p) for p in points], np.int64)
    return common.prefix_hash(np.concatenate(points)), np.concatenate(([0], np.cumsum(length)[:-1])), length


def whole_keys(lines: list[bytes], bands: Bands):
    """Keys of whole lines: (row, key, sides, segment start, segment size, edits, delta)."""
    prefix, start, length = _points(lines)
    rows = []
    for d in range(max(k for _, k in bands) + 1):
        edits = edits_at(length - d, bands)  # the shorter line's
        on = np.flatnonzero(edits >= d)
        if len(on):
            r, *rest = keys(prefix, start[on], length[on], edits[on], np.full(len(on), d), INDEX | PROBE)
            rows.append([on[r], *rest, edits[on][r], np.full(len(r), d)])
    return [np.concatenate(c) for c in zip(*rows, strict=True)]


_KEYED = {"key": "long", "sides": "byte", "c1": "long"}


def _keys_of_lines(bands):
    """(text) to (key, sides, c1): each distinct line of a task once."""

    def run(batches):
        sent: set[int] = set()
        for b in batches:
            lines, c1 = [], []

            def full():
                row, key, sides, *_ = whole_keys(lines, bands)
                got = pa.RecordBatch.from_arrays([pa.array(key), pa.array(sides), pa.array(np.array(c1, np.int64)[row])], names=list(_KEYED))
                lines.clear()
                c1.clear()
                return got

            held = 0
            for text in common.texts(b):
                for _, line in eligible(text, bands[0][0]):
                    n = name(line)[0]
                    if n not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(n)
                        lines.append(line)
                        c1.append(n)
                        held += len(line)
                        if held > 1 << 17:
                            yield full()
                            held = 0
            if lines:
                yield full()

    return run


_MET = {"kind": "int", "key": "long", "sides": "byte", "c1": "long", "other": "long"}


def _meet(crowd):
    """(key, sides, c1) sorted by key to pairs (kind 0: c1, other) and rows of large groups (kind 1: key, sides, c1)."""

    def run(batches):
        key, sides, crowded = None, ({}, {}), False
        rows: list[tuple] = []

        def close():
            if not crowded:
                rows.extend((0, 0, 0, min(a, b), max(a, b)) for a in sides[0] for b in sides[1] if a != b)

        for b in batches:
            k, s, c = (x.to_numpy() for x in b.columns)
            # keys that stand alone, most of them, are passed over
            edge = np.concatenate(([True], k[1:] != k[:-1], [True])) if len(k) else np.ones(1, bool)
            busy = np.flatnonzero(~(edge[:-1] & edge[1:]) | (np.arange(len(k)) == len(k) - 1) | (np.arange(len(k)) == 0))
            for x, side, line in zip(k[busy].tolist(), s[busy].tolist(), c[busy].tolist(), strict=True):
                if x != key:
                    if key is not None:
                        close()
                    key, sides, crowded = x, ({}, {}), False
                    if len(rows) > 100_000:
                        yield _batch(rows, _MET)
                        rows.clear()
                if crowded:
                    rows.append((1, key, side, line, 0))
                    continue
                for z in (0, 1):
                    if side & 1 << z:
                        sides[z][line] = None
                if len(sides[0]) > crowd or len(sides[1]) > crowd:
                    crowded = True
                    rows.extend((1, key, (x in sides[0]) * INDEX + (x in sides[1]) * PROBE, x, 0) for x in sides[0] | sides[1])
                    sides = ({}, {})
            yield _batch(rows, _MET)
            rows.clear()
        if key is not None:
            close()
        yield _batch(rows, _MET)

    return run


_TEXT = {"c1": "long", "c2": "long", "text_of": "binary"}


def _texts_of(shortest, wanted):
    """(text) to (c1, c2, line) of each distinct line of a task, of those wanted if a broadcast says which."""

    def run(batches):
        want = wanted.value if wanted is not None else None
        sent: set[tuple[int, int]] = set()
        for b in batches:
            rows = []
            for text in common.texts(b):
                for _, line in eligible(text, shortest):
                    n = name(line)
                    if n not in sent and (want is None or n[0] in want):
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(n)
                        rows.append((*n, line))
            yield _batch(rows, _TEXT)

    return run


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings are at most so many edits apart.

    One bit per diagonal of the band and one word per count of edits: a step on the
    longer string moves all of them at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:  # the common beginning; each step compares in one go
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    band = (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    # bit t of state[e]: e edits bring a[:i] to b[:i + t - edits]
    state = [1 << edits]
    for _ in range(edits):
        state.append((state[-1] | state[-1] << 1) & band)
    for i, c in enumerate(a):
        at = where.get(c, 0)
        same = (at >> (i - edits) if i >= edits else at << (edits - i)) & band
        new = [state[0] & same]
        for e in range(1, edits + 1):
            new.append(((state[e] & same) | state[e - 1] | state[e - 1] >> 1 | new[e - 1] << 1) & band)
        state = new
        if not any(state):
            return False
    return bool(state[edits] >> (len(b) - len(a) + edits) & 1)


def near(x: bytes, y: bytes, bands: Bands) -> bool:
    """Whether two different lines are within the threshold of the shorter one."""
    if x == y:
        return False
    p, q = x.decode(errors="replace"), y.decode(errors="replace")
    edits = int(edits_at(np.array([min(len(p), len(q))]), bands)[0])
    return edits >= 0 and within(p, q, edits)


def _verify(bands):
    """(c1, c2, x, y) to the names (c1, c2) whose lines x and y are near each other."""

    def run(batches):
        for b in batches:
            ok = [near(x, y, bands) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["c1", "c2"]).filter(pa.array(ok, pa.bool_()))

    return run


#: A line, or what is left of it, under a key of its own: which part of it the key stands for (size -1: all that is left), and for what it was split.
_ROW = {"key": "long", "sides": "byte", "c1": "long", "c2": "long", "rest": "binary", "at": "int", "size": "int", "edits": "int", "delta": "int"}
#: What a row of _ROW carries along: its whole line and the place of that.
_ALONG = {"line": "binary", "first": "struct<doc_id:bigint,u1:bigint,u2:bigint,line:int>"}


def _with_lines(out: list[tuple], of: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of _ROW with the last two columns of the batch's rows that they are of."""
    of = pa.array(of, pa.int64())
    return pa.RecordBatch.from_arrays([*_batch(out, _ROW).columns, *(c.take(of) for c in b.columns[-2:])], names=[*_ROW, *_ALONG])


def _open(bands):
    """(key, sides, c1, c2, line, first) to _ROW and _ALONG: what a crowded key stands for in its line, once for each place."""

    def run(batches):
        for b in batches:
            out, of = [], []
            for n, (key, sides, c1, c2, line) in enumerate(zip(*(c.to_pylist() for c in b.columns[:5]), strict=True)):
                _, k, z, at, size, edits, delta = whole_keys([line], bands)
                out += [(key, int(z[i]) & sides, c1, c2, line, int(at[i]), int(size[i]), int(edits[i]), int(delta[i])) for i in np.flatnonzero(k == key) if int(z[i]) & sides]
                of += [n] * (len(out) - len(of))
            yield _with_lines(out, of, b)

    return run


def _cut_out(batches):
    """_ROW and _ALONG to the same under the keys of what is left when the matched part is cut out, each only equal under an equal key before."""
    for b in batches:
        out, of = [], []
        for n, (key, sides, c1, c2, rest, at, size, edits, delta) in enumerate(zip(*(c.to_pylist() for c in b.columns[:-2]), strict=True)):
            s = rest.decode(errors="replace")
            s = s[:at] + s[at + size :]
            left = s.encode(errors="replace")
            # the lines of a delta are this much longer than those whose segments they hold
            for side, d in ((sides & INDEX, 0), (sides & PROBE, delta)):
                if not side or side == PROBE and sides & INDEX and d == 0:
                    continue
                side = sides if d == 0 else side
                if len(s) - d <= edits:
                    out.append((_scoped(key, np.array([-1], np.int64))[0], side, c1, c2, left, 0, -1, edits, d))
                    continue
                prefix, start, length = _points([left])
                _, k, z, at_, size_ = keys(prefix, start, length, np.array([edits]), np.array([d]), side)
                out += [(int(x), int(y), c1, c2, left, int(a), int(m), edits, d) for x, y, a, m in zip(_scoped(key, k), z, at_, size_, strict=True)]
            of += [n] * (len(out) - len(of))
        yield _with_lines(out, of, b)


def _scoped(scope: int, key: np.ndarray) -> np.ndarray:
    """Keys that are equal only under equal scopes."""
    return common.mix(key.view(np.uint64) ^ common.mix(np.array([scope], np.int64).view(np.uint64))).view(np.int64)


def late_lines(docs: DataFrame, firsts: DataFrame, bands: Bands, scratch: common.Scratch, crowd: int = CROWD) -> DataFrame:
    """(c1, c2), the names of lines that are near an earlier one. firsts: c1, c2 and first, the place of each line."""
    inner = common.Scratch(docs.sparkSession)
    out = scratch.keep(_late_lines(docs, firsts, bands, inner, crowd))
    inner.clear()
    return out


def _late_lines(docs, firsts, bands, scratch, crowd):
    spark = docs.sparkSession
    few = common.writers(spark)
    met = docs.select("text").mapInArrow(_keys_of_lines(bands), _schema(_KEYED)).repartition("key").sortWithinPartitions("key")
    # of all keys few meet, so what is left of them is dealt evenly to fewer tasks
    met = scratch.keep(met.mapInArrow(_meet(crowd), _schema(_MET)).repartition(few))
    # most candidates are pairs under a key that holds two lines; all are verified below
    pairs = scratch.keep(met.filter("kind = 0").select("c1", "other").distinct(), tasks=few)
    large = met.filter("kind = 1").select("key", "sides", "c1").distinct()
    # a key that only has segments, or only probes, joins nothing
    open_ = large.groupBy("key").agg(F.bit_or("sides").alias("all")).filter(f"all = {INDEX | PROBE}").select("key")
    large = scratch.keep(large.join(scratch.keep(open_, tasks=few), "key"))

    of = pairs.select("c1").unionByName(pairs.select(F.col("other").alias("c1"))).unionByName(large.select("c1"))
    of = scratch.keep(of.distinct(), tasks=few)
    sent = spark.sparkContext.broadcast(frozenset(r.c1 for r in of.toLocalIterator())) if of.count() <= BROADCAST_LINES else None
    known = docs.select("text").mapInArrow(_texts_of(bands[0][0], sent), _schema(_TEXT))
    known = (known if sent else known.join(of, "c1", "left_semi")).dropDuplicates(["c1", "c2"]).withColumnRenamed("text_of", "line")
    known = scratch.keep(known.join(firsts, ["c1", "c2"]))

    def judged(ask: DataFrame) -> DataFrame:
        """Of rows (c1, c2, first, line; f1, f2, other_first, other): the names of the later lines of near pairs, one a pair."""
        later = F.col("first") > F.col("other_first")
        ask = ask.select(F.when(later, F.col("c1")).otherwise(F.col("f1")).alias("c1"), F.when(later, F.col("c2")).otherwise(F.col("f2")).alias("c2"), F.col("line").alias("x"), F.col("other").alias("y"))
        return scratch.keep(ask.mapInArrow(_verify(bands), "c1 long, c2 long"))

    other = known.select(F.col("c1").alias("f1"), F.col("c2").alias("f2"), F.col("first").alias("other_first"), F.col("line").alias("other"))
    late = judged(pairs.withColumnRenamed("other", "f1").join(known, "c1").join(other, "f1"))
    if large.isEmpty():
        return late.distinct()
    rows = large.join(known, "c1").select("key", "sides", "c1", "c2", "line", "first").mapInArrow(_open(bands), _schema(_ROW | _ALONG))
    while True:
        full = scratch.keep(rows.distinct(), tasks=few)
        # the earliest line of each key settles what is near it
        head = F.min(F.struct("first", "c1", "c2", "line")).alias("h")
        heads = scratch.keep(full.groupBy("key").agg(head).select("key", F.col("h.c1").alias("f1"), F.col("h.c2").alias("f2"), F.col("h.first").alias("other_first"), F.col("h.line").alias("other")), tasks=few)
        late = late.unionByName(judged(full.join(late, ["c1", "c2"], "left_anti").join(heads, "key"))).distinct()
        asks = full.join(late.withColumn("done", F.lit(True)), ["c1", "c2"], "left").withColumn("ask", F.col("done").isNull()).drop("done")

        def count(side, of="true"):
            return F.sum(F.expr(f"if(sides & {side} > 0 and {of}, 1, 0)"))

        sizes = asks.groupBy("key").agg(count(INDEX).alias("i"), count(PROBE).alias("p"), count(INDEX, "ask").alias("ai"), count(PROBE, "ask").alias("ap"), F.max(F.expr("size < 0")).alias("ends"))
        sizes = scratch.keep(sizes.filter("ai * p + ap * i > 0").select("key", F.expr(f"if(ends or ai * p + ap * i <= {PAIRED} * (i + p), 1, 2)").alias("go")), tasks=few)
        asking = asks.join(sizes.filter("go = 1"), "key")
        partner = asking.select("key", F.col("sides").alias("their"), F.col("c1").alias("f1"), F.col("c2").alias("f2"), F.col("first").alias("other_first"), F.col("line").alias("other"))
        facing = F.expr("(sides & 1 > 0 and their & 2 > 0 or sides & 2 > 0 and their & 1 > 0) and other_first < first")
        late = scratch.keep(late.unionByName(judged(asking.filter("ask").join(partner, "key").filter(facing))).distinct(), tasks=few)
        hot = sizes.filter("go = 2").select("key")
        if hot.isEmpty():
            return late
        rows = full.join(hot, "key").select(*_ROW, *_ALONG).mapInArrow(_cut_out, _schema(_ROW | _ALONG))


def _rewrite(batches):
    """(doc_id, text, gone) to the text without the lines gone."""
    for b in batches:
        n, removed, sha, kept = [], [], [], []
        for text, gone in zip(common.texts(b), b.column(b.schema.get_field_index("__gone")).to_pylist(), strict=True):
            lines = text.split(b"\n") if text else []
            gone = set(gone or ())
            left = b"\n".join(x for k, x in enumerate(lines) if k not in gone)
            n.append(len(lines))
            removed.append(len(gone))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode(errors="replace"))
        keep = [(m, b.column(i)) for i, m in enumerate(b.schema.names) if m not in ("text", "__gone")]
        more = [("n_lines", pa.array(n, pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("kept_sha256", pa.array(sha, pa.string())), ("kept_text", pa.array(kept, pa.string()))]
        yield pa.RecordBatch.from_arrays([c for _, c in [*keep, *more]], names=[m for m, _ in [*keep, *more]])


_RESULTS = ("n_lines", "n_removed", "kept_sha256", "kept_text")


def dedup_lines(docs: DataFrame, bands: Bands = BANDS, crowd: int = CROWD, copies: int | None = None) -> DataFrame:
    """n_lines, n_removed, kept_sha256 and kept_text of every document, after its other columns.

    copies: the least length of lines whose equal copies go; that of the edit join unless given.
    """
    docs = docs.drop(*_RESULTS)
    scratch, shortest = common.Scratch(docs.sparkSession), bands[0][0]
    # 128 bits name a row, so that no two documents share one
    u1, u2 = F.xxhash64("doc_id", "text").alias("__u1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("__u2")
    named = docs.select("*", u1, u2)
    lines = scratch.keep(named.select("doc_id", "__u1", "__u2", "text").mapInArrow(_lines(shortest, shortest if copies is None else min(copies, shortest)), "c1 long, c2 long, doc_id long, u1 long, u2 long, line int"))
    place = F.struct("doc_id", "u1", "u2", "line")
    firsts = scratch.keep(lines.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")), tasks=common.writers(docs.sparkSession))
    late = late_lines(docs.select("text"), firsts.drop("n"), bands, scratch, crowd).withColumn("late", F.lit(True))
    # only lines that may go are joined with their rows, so that one line's many rows can be split
    judged = scratch.keep(firsts.join(late, ["c1", "c2"], "left").filter("late or n > 1").drop("n"))
    gone = scratch.keep(lines.join(judged, ["c1", "c2"]).filter(F.col("late").isNotNull() | (place != F.col("first"))).select("u1", "u2", "line"))
    gone = gone.groupBy(F.col("u1").alias("__g1"), F.col("u2").alias("__g2")).agg(F.collect_set("line").alias("__gone"))
    cols = docs.columns
    joined = named.join(gone, F.expr("__u1 = __g1 and __u2 = __g2"), "left").select(*[F.col(f"`{c}`") for c in cols], F.col("__gone"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", n_lines long, n_removed long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_rewrite, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, copies=COPIES).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their removed lines; one that loses every line goes, n_chars follows the text."""
    common.ship(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("__null")).alias("__row"))
    done = dedup_lines(row, copies=COPIES).filter("n_removed = 0 or length(kept_text) > 0")
    out = {c: F.col(f"__row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.when(~F.col("__row.__null"), F.col("kept_text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*[out[c].alias(c) for c in docs.columns])
