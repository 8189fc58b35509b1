"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of open bins, and a bitset over free space
that says in one step which open bin fits a piece most tightly. If none fits and all are
in use, the fullest closes first. Only lengths travel to the packers; a packer takes a
bounded block of pieces, so its memory does not grow with the input, and the space lost
at a block's end is a few open bins in tens of thousands of pieces.

Defined cases: a null or empty text is the end token alone; a text of any length is cut,
never shortened; repeated rows are packed once for each row; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

CAPACITY = 1024
END_TOKEN = 2
OPEN_BINS = 1024
BLOCK = 65_536
#: Bytes of words and ids that a task remembers, and the longest word among them.
CACHED_BYTES, LONGEST_WORD = 48 << 20, 64
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokeniser whose added tokens stand for their text wherever it occurs.
TOKENIZER = "byte_bpe_50k.json"


class Ids(dict):
    """Little-endian uint32 ids of a space-led word, filled on first use up to a bound.

    In a text where no white space touches a space, each space begins a token, so the
    words between spaces can be encoded apart. Words that start or end in white space
    are refused (KeyError) and their text is encoded as a whole.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        self.encode, self.left = encode, most

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        out = np.array(self.encode(" " + word), "<u4").tobytes()
        if self.left > 0 and len(word) <= LONGEST_WORD:
            self.left -= 200 + len(word) + len(out)
            self[word] = out
        return out


def _added(path: str):
    """The tokeniser of a JSON file, and its added tokens."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return whole, [t.content for t in whole.get_added_tokens_decoder().values()]


def encoder(vocabulary: str | None = None, tokenizer: str | None = None) -> Callable[[bytes], bytes]:
    """A function from UTF-8 to little-endian uint32 ids. The vocabulary's path is a parameter.

    tokenizer: the JSON whose added tokens count; a text with one is left to that tokeniser. Without it such tokens are plain text.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cache = Ids(encode, CACHED_BYTES)
    whole, added = _added(public_tokenizers.path(tokenizer)) if tokenizer else (None, [])

    def ids(text: bytes) -> bytes:
        s = text.decode()
        if any(x in s for x in added):
            return np.array(whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = s.split(" ")
        if first and not first[-1].isspace():
            try:
                return np.array(encode(first), "<u4").tobytes() + b"".join(map(cache.__getitem__, rest))
            except KeyError:
                pass
        return np.array(encode(s), "<u4").tobytes()

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces, with the shorter one first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenise(vocabulary, capacity, end_token, with_ids):
    def run(batches):
        encode, end = encoder(vocabulary, None if vocabulary else TOKENIZER), np.array([end_token], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(common.ids_of(b), common.texts(b), strict=True):
                ids = encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for name, v in zip(out, (doc, k, start, length, zlib.crc32(part), part), strict=True):
                        out[name].append(v)
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            names = [k for k in out if k != "ids" or with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in names], names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_token: int = END_TOKEN, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_tokenise(vocabulary, capacity, end_token, with_ids), schema)


class BestFit:
    """Places lengths one by one; ``put`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.bins = 0

    def _move(self, bin_: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_)
            self.free_bits |= 1 << free
            self.open += 1

    def _pop(self, free: int) -> int:
        at = self.by_free[free]
        bin_ = at.pop()
        if not at:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.open >= self.most and length < self.capacity:  # the fullest closes: least free space
                self._pop((self.free_bits & -self.free_bits).bit_length() - 1)
            free, bin_ = self.capacity, self.bins
            self.bins += 1
        self._move(bin_, free - length)
        return bin_, self.capacity - free


def pack(of: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, block: int = BLOCK) -> DataFrame:
    """of, with sequence_id and offset. Full pieces take a sequence each; the rest go to packers in blocks."""
    spark = of.sparkSession
    names = of.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in of.schema) + ", sequence_id long, offset long"

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        fit = BestFit(capacity, open_bins)
        for b in batches:
            lengths = b.column(names.index("length")).to_pylist()
            placed = [fit.put(n) for n in lengths]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in placed], pa.int64()), pa.array([y for _, y in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    short = of.filter(F.col("length") < capacity)
    whole = of.filter(F.col("length") == capacity)
    shards = max(1, -(-short.count() // block))
    packed = short.repartition(shards, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, schema)
    numbered = whole.select(*names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(numbered)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Cut and pack documents; the pieces are written once, since their number sets the number of packers."""
    cut_ = common.Scratch(docs.sparkSession).keep(pieces(docs, **how))
    return pack(cut_, how.get("capacity", CAPACITY))


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences: sequence_id, ids (little-endian uint32) and the documents in their order, from pieces that carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, as op6 gives them; a document that stands twice is packed twice."""
    common.ship(spark)
    return pack_documents(docs)
