"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 2 to 4 byte strings of lower-cased letters, with a blank before and
after each word; they are hashed into buckets, a bucket has an embedding, and a text is
the average of its subwords' embeddings. Trained by stochastic gradient descent in numpy
on about ``most`` labelled documents of each language outside fold 0 (of at most
``MOST_LANGUAGES`` languages, the commonest), whole and in short random windows, in the order
of their ids. As the softmax is linear, a bucket's part in each class is tabulated once, and scoring a
text of any length is one pass of table look-ups, a stretch of the text at a time.

Probabilities are calibrated by a temperature fitted on a part of the training rows that
the descent has not seen; below ``REJECT`` the prediction is marked as rejected.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is
everything if no language can be learnt; an empty table gives an empty table; repeated
rows are predicted alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

MOST_LABELLED, MOST_LANGUAGES = 400, 1_000
SHORT_WINDOWS = 3
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 12
REJECT = 0.5
CHUNK = 1 << 16

_RESULTS = ("lang_pred", "score", "rejected")
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def stretches(text: str):
    """Buckets of the subwords of a text, a stretch of CHUNK beginnings at a time."""
    data = _LETTER[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    for at in range(0, len(data), CHUNK):
        out = []
        x = data[at : at + CHUNK + 3].astype(np.uint32)
        blank = x == 32
        h = x * np.uint32(0x9E3779B1)
        for n in (2, 3, 4):
            m = min(CHUNK, len(x) - n + 1)
            if m <= 0:
                break
            with np.errstate(over="ignore"):
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[n - 1 :] * np.uint32(0xC2B2AE3D)
            if n == 2:
                ok = ~(blank[:-1] & blank[1:])
            else:
                inner = np.zeros(len(x) - n + 1, bool)
                for k in range(1, n - 1):
                    inner |= blank[k : k + len(inner)]
                ok = ~inner
            out.append(h[:m][ok[:m]] >> np.uint32(17))
        yield np.concatenate(out) if out else np.zeros(0, np.uint32)


def _sparse(batches):
    """(doc_id, lang, text) to training rows: what sorts them, lang, bucket, share."""
    for b in batches:
        rows = []
        for doc, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts(b), strict=True):
            s = text.decode()
            words = s.split()
            rng = np.random.default_rng(len(s))
            parts = [s, *(" ".join(words[k : k + 6]) for k in rng.integers(0, max(1, len(words) - 5), SHORT_WINDOWS))]
            for k, p in enumerate(parts):
                n = sum(np.bincount(x, minlength=BUCKETS) for x in stretches(p))
                if n.any():
                    at = np.flatnonzero(n)
                    rows.append((doc, zlib.crc32(text), k, name, at.astype(np.int32), (n[at] / n.sum()).astype(np.float32)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "crc", "part", "lang", "bucket", "share"])


class Model:
    """Class names and, per bucket, its part in each class's score."""

    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.names, self.table, self.bias, self.temperature = names, table, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.names)), 0
        for b in stretches(text):
            total += self.table.take(b, axis=0).sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.names[k], float(p[k] / p.sum())


def train(rows, seed: int = 3) -> Model | None:
    """rows: (lang, buckets, shares). Plain stochastic gradient descent, one row at a time."""
    names = sorted({r[0] for r in rows})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 10) if len(rows) >= 50 else 0
    held, learn = order[:cut], order[cut:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))), np.zeros(len(names))
    y = np.array([names.index(r[0]) for r in rows])
    total, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate = 2.0 * (1 - step / total) + 0.01
            step += 1
            _, b, share = rows[i]
            h = share @ emb[b]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            emb[b] -= rate * 10 * share[:, None] * back
    model = Model(names, (emb @ out).astype(np.float32), bias)
    if cut:
        z = np.stack([rows[i][2] @ model.table[rows[i][1]] + bias for i in held])

        def loss(t):
            s = z / t
            s -= s.max(axis=1, keepdims=True)
            return -(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean()

        model.temperature = min((float(t) for t in np.geomspace(0.25, 8, 26)), key=loss)
    return model


def learn(docs: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """A model from text and lang of about ``most`` documents of each language outside fold 0."""
    common.ship(docs.sparkSession)
    ok = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold_of(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    per = ok.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    turn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000))
    kept = ok.join(F.broadcast(per), "lang").filter(turn * F.col("n") < most * 1_000_000)
    got = kept.select("doc_id", "lang", "text").mapInArrow(_sparse, "doc_id long, crc long, part int, lang string, bucket array<int>, share array<float>").toArrow()
    rows = [(r[3].as_py(), r[4].values.to_numpy(), r[5].values.to_numpy()) for r in zip(*(got.column(i) for i in range(6)), strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (got.column(0)[i].as_py(), got.column(3)[i].as_py(), got.column(1)[i].as_py(), got.column(2)[i].as_py()))
    return train([rows[i] for i in order])


def _identify(model: Model | None):
    def run(batches):
        for b in batches:
            out = []
            for text in common.texts(b):
                s = text.decode()
                out.append(model.predict(s) if model and any(map(str.isalpha, s)) else ("und", 0.0))
            keep = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n not in ("text", *_RESULTS)]
            cols = [*keep, ("lang_pred", pa.array([x for x, _ in out], pa.string())), ("score", pa.array([x for _, x in out], pa.float64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns without text, and lang_pred, score and rejected; input columns of these names give way."""
    docs = docs.drop(*_RESULTS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", lang_pred string, score double"
    return docs.mapInArrow(_identify(model), schema).withColumn("rejected", F.col("score") < REJECT)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs)
    held = F.coalesce(common.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "rejected")
