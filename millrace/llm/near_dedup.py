"""MinHash near-dedup by a chosen-path similarity join over distinct word-shingle sets.

Documents with equal sets are one class. Each of several independent trees sends a class
down paths chosen by the node itself: a node picks two of the 128 minwise positions and a
class follows the tokens it has there. Nodes of up to SMALL classes are compared
exhaustively by signature. In a larger node every class is compared with LEADERS classes
of the node, the ones that share most tokens with a sample's commonest; those that resemble
one stop there, linked to it, and the rest, linked to all that they may be similar to, branch
on, so a huge group of near copies costs its size and never its square. Candidate pairs are
confirmed on the full sets: first a spanning forest of each node, then, knowing the
components that gave, every candidate pair between different components. For the latter no
class of a large node rests: the strays, those outside the node's commonest component, meet
every class of the node, block by block and by a finer sketch, and a node of too many strays
branches with all its classes (``_unsettled``). Only classes of one component are never
compared again. Large nodes
travel in blocks of BLOCK classes, dealt by Spark; none of their signatures reach the driver.

A pair of the least similarity shares a path with probability 15/16 a tree at the first
level and at least 8/9 at any depth, so five trees miss one in 10^5 or fewer, and the
signature and sketch bounds one in 10^4.

Defined cases: a null or wordless text has an empty set, n_shingles 0 and no links;
fewer words than a shingle are one shingle; rows of one id with different texts are
linked only if similar; a null id never becomes a component's id unless all are null;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, graph

WORDS = 5
NUM, DEN = 75, 100
POSITIONS = 128
TREES = 5
SMALL = 512
#: Pairs of signatures that are compared at a time.
PAIRS = 16_384
LEADERS = 8
#: Of POSITIONS equal: fewer make no candidate; so many let a class rest at its leaders; so many make one link enough.
CANDIDATE, RESEMBLES, CLOSE = 78, 90, 101
#: A large node of more strays branches, so often at most where one component dominates it and elsewhere; then its strays are compared however many.
STRAYS, DOMINATED, MIXED = 512, 3, 12
#: Bins of the finer sketch, a byte each, and by how many standard deviations a pair may fall short of the least similarity.
BINS, DEVIATIONS = 512, 4
#: Classes of a large node in one row (64 KB of signatures), and such rows in an Arrow batch.
BLOCK, BLOCKS_A_BATCH = 128, 32
#: Classes whose links a task remembers, so as not to tell one twice; then it forgets them.
REMEMBERED = 200_000
#: Ids that may be broadcast to pick texts; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 500_000

def _fine_bounds() -> np.ndarray:
    """By the number of bins that either of two sets has: the share of equal ones that makes a candidate.

    Equal bins are a sample of the union without replacement; the filled bins tell its size.
    """
    n = np.arange(1, BINS + 1)
    union = -BINS * np.log(1 - np.minimum(n, BINS - 0.5) / BINS)
    least = NUM / DEN
    return np.concatenate(([0.0], least - DEVIATIONS * np.sqrt(least * (1 - least) / n * np.maximum(0.0, 1 - n / union))))


_FINE = _fine_bounds()
_SEEDS = common.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADDED = common.mix(np.arange(POSITIONS + 1, 2 * POSITIONS + 1, dtype=np.uint64))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    data = common.fold_ascii(np.frombuffer(text, np.uint8))
    return np.unique(common.ngram_hashes(common.word_hashes(data), words))


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 1024):
            x = found[i : i + 1024, None] * _SEEDS + _ADDED
            np.minimum(out, (x.max(axis=0) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0xFFFFFFFF), out=out)
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each bin, by one permutation; 0 where a bin is empty."""
    bins, first = np.unique(found & np.uint64(BINS - 1), return_index=True)  # found is sorted
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = 1 + (found[first] >> np.uint64(BINS.bit_length())) % np.uint64(255)
    return out


def _describe(words):
    def run(batches):
        for b in batches:
            n, cls, sig = [], [], []
            for text in common.texts(b):
                s = shingles(text, words)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "cls", "sig"])

    return run


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The two child nodes of each row: by tokens at two positions that the node chooses."""
    h = common.mix(node)
    one = h % np.uint64(POSITIONS)
    two = (one + np.uint64(1) + common.mix(h) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
    row = np.arange(len(node))
    with np.errstate(over="ignore"):
        return np.stack([common.mix(h + common.mix(sig[row, p.astype(np.int64)].astype(np.uint64) << np.uint64(8) | p)) for p in (one, two)], axis=1)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _plant(trees: int):
    """(cls, sig) to the first nodes of every tree."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cls, sig = b.column(0), _signatures(b.column(1))
            nodes = np.concatenate([_children(common.mix(np.full(len(sig), t, np.uint64)), sig) for t in range(trees)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64).ravel()), cls.take(pa.array(np.repeat(np.arange(len(sig)), nodes.shape[1])))], names=["node", "cls"])

    return run


def _blocks(b: pa.RecordBatch, at: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Names and signatures of the blocks in two list columns, the first at ``at``."""
    return [(names, np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, POSITIONS)) for names, sigs in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True)]


def _commonest(batches):
    """(node, names, sigs) to the commonest token at each position."""
    for b in batches:
        out = []
        for _, sigs in _blocks(b, 1):
            x = np.sort(sigs, axis=0)
            run, best, token = np.ones(POSITIONS, int), np.ones(POSITIONS, int), x[0].copy()
            for i in range(1, len(x)):
                run = np.where(x[i] == x[i - 1], run + 1, 1)
                token, best = np.where(run > best, x[i], token), np.maximum(run, best)
            out.append(token.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "middle"])


def _central(batches):
    """(node, names, sigs, middle) to the LEADERS classes of each block that have most of the commonest tokens: node, leader, lsig, same."""
    for b in batches:
        rows = []
        for node, (names, sigs), middle in zip(b.column(0).to_pylist(), _blocks(b, 1), b.column(3).to_pylist(), strict=True):
            same = (sigs == np.frombuffer(middle, np.uint32)).sum(axis=1)
            rows += [(node, names[i], sigs[i].tobytes(), int(same[i])) for i in np.argsort(-same, kind="stable")[:LEADERS]]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["node", "leader", "lsig", "same"])


def _star(batches):
    """(node, names, sigs, leaders, lsigs) to kind 0: candidate (a, b); kind 1: rows that branch on (node, a).

    A class that is close to a leader gets that one link; any other gets a link to each
    leader that it may be similar to, and goes on if it does not resemble one.
    """
    for b in batches:
        ends, on, nodes = [], [], []
        for node, (cls, sig), (names, lead) in zip(b.column(0).to_pylist(), _blocks(b, 1), _blocks(b, 3), strict=True):
            same = np.stack([(sig == x).sum(axis=1) for x in lead], axis=1)
            go = []
            for i, row in enumerate(same):
                best = int(row.argmax())
                if row[best] >= CLOSE:
                    if names[best] != cls[i]:
                        ends.append((cls[i], names[best]))
                    continue
                ends += [(cls[i], x) for x, k in zip(names, row, strict=True) if k >= CANDIDATE and x != cls[i]]
                if row[best] < RESEMBLES:
                    go.append(i)
            if go:
                nodes += _children(np.full(len(go), node, np.int64).view(np.uint64), sig[go]).view(np.int64).ravel().tolist()
                on += [cls[i] for i in go for _ in range(2)]
        k = len(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * k + [1] * len(on), pa.int32()), pa.array([0] * k + nodes, pa.int64()), pa.array([x for x, _ in ends] + on, pa.binary()), pa.array([x for _, x in ends] + [None] * len(on), pa.binary())],
            names=["kind", "node", "a", "b"],
        )


def _in_blocks(rows: DataFrame, size: str, **columns: str) -> DataFrame:
    """Rows of nodes of ``size`` rows as blocks: node, block, and lists of the columns under the names given."""
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col(size) / BLOCK)).alias("block")
    row = F.collect_list(F.struct(*columns.values())).alias("r")
    return rows.groupBy("node", block).agg(row).select("node", "block", *[F.col(f"r.{c}").alias(n) for n, c in columns.items()])


def _pairs_of(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(size, 1)
    base = (np.arange(count) * size)[:, None]
    return (base + i).ravel(), (base + j).ravel()


def _compare(spanning: bool):
    """Rows (node, cls, sig, root) sorted by node to candidate pairs (a, b) and, with no ends, nodes.

    spanning: only what joins classes that the task has not joined yet, most alike first,
    and the nodes that have other candidate pairs as well.
    Otherwise every candidate pair whose roots differ, by the finer sketch, which then is sig.
    """

    def run(batches):
        parent: dict[bytes, bytes] = {}
        told: set[bytes] = set()

        def top(x):
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        def judge(tab):
            node = tab.column("node").to_numpy()
            cls, root, sig = tab.column("cls").to_pylist(), tab.column("root").to_pylist(), np.frombuffer(b"".join(tab.column("sig").to_pylist()), np.uint32 if spanning else np.uint8).reshape(tab.num_rows, -1)
            cuts = np.flatnonzero(np.diff(node)) + 1
            start, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(node)])))
            got = []
            for s in np.unique(size[size > 1]):
                of = start[size == s]
                step = max(1, 2 * PAIRS // int(s * s))
                for k in range(0, len(of), step):
                    part = of[k : k + step]
                    at = (part[:, None] + np.arange(s)).ravel()
                    i, j = _pairs_of(int(s), len(part))
                    for p in range(0, len(i), PAIRS):
                        x, y = at[i[p : p + PAIRS]], at[j[p : p + PAIRS]]
                        same = (sig[x] == sig[y]).sum(axis=1)
                        ok = same >= CANDIDATE if spanning else _alike(sig[x], sig[y])
                        got.append((same[ok], x[ok], y[ok]))
            if not got:
                return
            same, i, j = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b_, more = [], [], set()
            for k in np.argsort(-same, kind="stable"):
                x, y = sorted((cls[i[k]], cls[j[k]]))
                if spanning:
                    p, q = top(x), top(y)
                    if p == q:
                        more.add(int(node[i[k]]))
                        continue
                    if len(parent) > REMEMBERED:
                        parent.clear()
                    parent[p] = q
                else:
                    if root[i[k]] == root[j[k]] or x + y in told:
                        continue
                    if len(told) > REMEMBERED:
                        told.clear()
                    told.add(x + y)
                a.append(x)
                b_.append(y)
            nothing = [None] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(a + nothing, pa.binary()), pa.array(b_ + nothing, pa.binary()), pa.array([None] * len(a) + list(more), pa.int64())], names=["a", "b", "node"])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            node = t.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            held = t.slice(last)
            if last:
                yield from judge(t.slice(0, last).combine_chunks().to_batches()[0])
        if held is not None and held.num_rows:
            yield from judge(held.combine_chunks().to_batches()[0])

    return run


def _branch(batches):
    """(node, cls, root, sig) to the child nodes (node, cls, root)."""
    for b in batches:
        if b.num_rows:
            nodes = _children(b.column(0).to_numpy().view(np.uint64), _signatures(b.column(3)))
            twice = pa.array(np.repeat(np.arange(len(nodes)), 2))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64).ravel()), b.column(1).take(twice), b.column(2).take(twice)], names=["node", "cls", "root"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches in rows are near enough for a candidate."""
    some = (x | y) > 0
    n = some.sum(axis=1)
    return ((x == y) & some).sum(axis=1) >= _FINE[n] * n


def _against(batches):
    """(names, sketches, roots; other names, sketches, roots) of one node to the candidate pairs (a, b) between different roots."""
    for b in batches:
        found = set()
        for names, fine, roots, others, ofine, oroots in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = (np.frombuffer(b"".join(f), np.uint8).reshape(-1, BINS) for f in (fine, ofine))
            for j, one in enumerate(y):
                ok = _alike(x, one)
                found.update((min(names[i], others[j]), max(names[i], others[j])) for i in np.flatnonzero(ok) if roots[i] != oroots[j])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


def _unsettled(rows: DataFrame, sigs: DataFrame, roots: DataFrame, scratch: common.Scratch, small: int, sketched):
    """The classes of large nodes (node, cls) that may have links between components:
    candidate pairs (a, b), and the small nodes (node, cls) to compare exhaustively."""
    of = roots.select(F.col("node").alias("cls"), "root")
    rows = rows.join(of, "cls", "left").select("node", "cls", F.coalesce("root", "cls").alias("root"))
    met, nodes, depth = [], [], 0
    while True:
        rows = scratch.keep(rows)
        by = rows.groupBy("node", "root").agg(F.count("*").alias("n"))
        mixed = by.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("main"))
        mixed = mixed.select("node", "size", (F.col("size") - F.col("main.n")).alias("strays"), F.col("main.root").alias("main")).filter("strays > 0")
        live = scratch.keep(rows.join(scratch.keep(mixed), "node").withColumn("on", F.expr(f"strays > {STRAYS} and {depth} < if(2 * strays > size, {MIXED}, {DOMINATED})")))
        nodes.append(live.filter(F.col("size") <= small).select("node", "cls"))
        big = live.filter(F.col("size") > small)
        if big.isEmpty():
            break
        met.append(big.filter("not on"))
        depth += 1
        rows = big.filter("on").join(sigs.select("cls", "sig"), "cls").select("node", "cls", "root", "sig").mapInArrow(_branch, "node long, cls binary, root binary")
    if not met:
        return [], nodes
    # the strays of all levels meet their nodes at once
    met = reduce(DataFrame.unionByName, met)
    met = met.join(sketched(met.select("cls").distinct()), "cls")
    every = scratch.keep(_in_blocks(met, "size", names="cls", fine="fine", roots="root").drop("block"))
    strays = scratch.keep(_in_blocks(met.filter("root != main"), "strays", onames="cls", ofine="fine", oroots="root").drop("block"))
    both = every.join(strays, "node").drop("node")
    return [scratch.keep(both.mapInArrow(_against, "a binary, b binary").distinct(), rows_a_batch=BLOCKS_A_BATCH)], nodes


def _confirm(num, den):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common_ = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common_ >= num * (len(both) - common_))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def classes_and_links(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, trees: int = TREES, small_node: int = SMALL):
    """(described, links, roots, scratch): the documents with their class, the confirmed links
    between classes, and (node, root) of every class that has one."""
    inner, scratch = common.Scratch(docs.sparkSession), common.Scratch(docs.sparkSession)
    described, links, roots = (scratch.keep(x) for x in _classes_and_links(docs, words, num, den, trees, small_node, inner))
    inner.clear()
    return described, links, roots, scratch


def _classes_and_links(docs, words, num, den, trees, small_node, scratch):
    signed = scratch.keep(docs.select("doc_id", "text").mapInArrow(_describe(words), "doc_id long, n_shingles long, cls binary, sig binary"))
    # Equal sets have equal signatures: any row's will do.
    sigs = scratch.keep(signed.filter("cls is not null").groupBy("cls").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("of")))
    described = scratch.keep(signed.drop("sig"))
    scratch.drop(signed)
    rows = scratch.keep(sigs.select("cls", "sig").mapInArrow(_plant(trees), "node long, cls binary"))
    linked, small, large = [], [], None
    while True:
        # a table of its own, so that the rows of a node that holds many can be split in the join
        sizes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
        live = scratch.keep(rows.join(sizes, "node"))
        small.append(live.filter(F.col("size") <= small_node).select("node", "cls"))
        big = live.filter(F.col("size") > small_node)
        if big.isEmpty():
            break
        large = big.select("node", "cls") if large is None else large
        blocks = scratch.keep(_in_blocks(big.join(sigs.select("cls", "sig"), "cls").select("node", "size", "cls", "sig"), "size", names="cls", sigs="sig"))
        # classes lie in blocks by their hash, so the first block of a node is a sample of it
        middle = scratch.keep(blocks.filter("block = 0").select("node", "names", "sigs").mapInArrow(_commonest, "node long, middle binary"), rows_a_batch=BLOCKS_A_BATCH)
        central = blocks.join(middle, "node").select("node", "names", "sigs", "middle").mapInArrow(_central, "node long, leader binary, lsig binary, same int")
        central = scratch.keep(central, rows_a_batch=BLOCKS_A_BATCH)
        best = Window.partitionBy("node").orderBy(F.desc("same"), "leader")
        led = central.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= LEADERS)
        heads = scratch.keep(led.groupBy("node").agg(F.collect_list(F.struct("leader", "lsig")).alias("r")).select("node", F.col("r.leader").alias("leaders"), F.col("r.lsig").alias("lsigs")))
        starred = blocks.join(heads, "node").select("node", "names", "sigs", "leaders", "lsigs").mapInArrow(_star, "kind int, node long, a binary, b binary")
        out = scratch.keep(starred, rows_a_batch=BLOCKS_A_BATCH)
        linked.append(out.filter("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        rows = out.filter("kind = 1").select("node", F.col("a").alias("cls"))
    picks = docs.select("doc_id", "text")

    def union(of):
        return reduce(DataFrame.unionByName, of)

    def compared(nodes, roots):
        found = sigs.select("cls", "sig") if roots is None else sketched(nodes.select("cls").distinct()).withColumnRenamed("fine", "sig")
        met = nodes.join(found, "cls")
        met = met.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left") if roots is not None else met.withColumn("root", F.lit(None).cast("binary"))
        met = met.withColumn("root", F.coalesce("root", "cls")).repartition("node").sortWithinPartitions("node").select("node", "cls", "sig", "root")
        return met.mapInArrow(_compare(roots is None), "a binary, b binary, node long")

    def own_sets(classes, of=lambda s: s.tobytes()):
        """(cls, found) of the classes, at least once each: what ``of`` makes of their sets."""
        ends = scratch.keep(classes.join(sigs.select("cls", "of"), "cls").select("cls", "of"))
        few = ends.count() <= BROADCAST_IDS
        found = picks.join(F.broadcast(ends) if few else ends, F.col("doc_id") == F.col("of"))
        # an id that stands on several rows brings several texts; only the class's own counts
        return found.select("cls", "text").mapInArrow(_own_sets(words, of), "cls binary, found binary")

    def confirmed(pairs):
        sets = own_sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        x, y = sets.select(F.col("cls").alias("a"), F.col("found").alias("x")), sets.select(F.col("cls").alias("b"), F.col("found").alias("y"))
        met = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
        return scratch.keep(met.mapInArrow(_confirm(num, den), "a binary, b binary").distinct())

    def sketched(classes):
        return scratch.keep(own_sets(classes, lambda s: sketch(s).tobytes()).dropDuplicates(["cls"]).withColumnRenamed("found", "fine"))

    met = scratch.keep(compared(union(small), None))
    first = scratch.keep(union([met.filter("a is not null").select("a", "b"), *linked]).distinct())
    links = confirmed(first)
    roots = graph.components(links, scratch)
    pairs, nodes = _unsettled(large, sigs, roots, scratch, small_node, sketched) if large is not None else ([], [])
    # small nodes that gave all their candidate pairs, or whose classes are of one component, have no more to give
    left = union(small).join(scratch.keep(met.filter("a is null").select("node").distinct()), "node")
    rooted = left.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("node", "cls", F.coalesce("root", "cls").alias("root"))
    rooted = scratch.keep(rooted)
    mixed = rooted.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("node")
    second = union([compared(union([rooted.join(scratch.keep(mixed), "node").select("node", "cls"), *nodes]), roots).select("a", "b"), *pairs]).distinct()
    second = scratch.keep(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = confirmed(second)
        links = links.unionByName(more)
        roots = graph.components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
    return described, links, roots


def _own_sets(words, of):
    def run(batches):
        for b in batches:
            cls, out = [], []
            for c, t in zip(b.column(0).to_pylist(), common.texts(b), strict=True):
                s = shingles(t, words)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c:
                    cls.append(c)
                    out.append(of(s))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(out, pa.binary())], names=["cls", "found"])

    return run


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links) and kept (its own id is that id)."""
    described, _, roots, scratch = classes_and_links(docs, **how)
    least = described.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of, "root").select(F.col("cls"), "component_id")
    out = described.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of the least id, and of rows that repeat both id and text, one.

    Rows of that id with different texts are documents of their own and stay.
    """
    common.ship(spark)
    of = near_duplicates(docs)
    kept = of.filter("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    kept = common.Scratch(spark).keep(kept)
    # the columns travel as one, so that none can clash with the stage's own
    row = docs.select(F.col("doc_id").alias("__of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    out = row.join(kept, F.col("__of").eqNullSafe(F.col("__id")))
    if kept.filter("__n > 1").isEmpty():
        return out.select("__row.*")
    # only rows whose id repeats are dealt by their text
    first = Window.partitionBy("__of", F.xxhash64("__row.text"), F.xxhash64(F.lit(1), "__row.text")).orderBy(F.lit(0))
    again = out.filter("__n > 1").withColumn("__turn", F.row_number().over(first)).filter("__turn = 1")
    return out.filter("__n = 1").select("__row.*").unionByName(again.select("__row.*"))
