"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters and drops
invisible characters, so that disguised spellings meet the lexicon. An entry is the
beginning of a word with a weight, the log-ratio of the shares of toxic and clean
documents that hold it; a whole word is an entry that only fits it. Exception phrases
are words, or pairs of words, around a match that clean documents hold more often: a
match inside one does not count. The sum of weights, normalised by length, goes through a
logistic link fitted on the same rows.

Learning uses at most ``most`` labelled documents outside fold 0; whole texts are used,
and the driver gets lexicon candidates and three numbers a training document.

Defined cases: a null or empty text scores as one without matches; without labels of both
classes there is no lexicon and every score is 0; an empty table gives an empty table;
repeated rows score alike; labels that are null or of a null id teach nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

MOST_LABELLED = 10_000
#: Bounds on the model, not on what is scored: word beginnings considered, and entries kept, the weightiest.
MOST_CANDIDATES = 50_000
MOST_ENTRIES = 5_000
SHORTEST, LONGEST = 3, 12
#: Toxic documents that must hold an entry: so many, or one in so many.
LEAST_DOCUMENTS, LEAST_SHARE = 4, 200
LEAST_WEIGHT = 3.5

#: Characters that look like Latin letters, and digits and signs that stand for them.
FOLDED = str.maketrans(
    dict(zip("абвгеёзіїјкмнорстухѕԁԛԝ", "abbreeziijkmhopctyxsdqw", strict=True))
    | dict(zip("αβγεζηικνορτυχω", "abyeznikvoptuxw", strict=True))
    | dict(zip("ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "abcdefghijklmnopqrstuvwxyz", strict=True))
    | dict(zip("013457@$", "oieastas", strict=True))
    | dict.fromkeys("­​‌‍⁠﻿", None)
)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLDED)


def _beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _count_beginnings(wanted: frozenset | None):
    """(text, toxic) to document counts of word beginnings: of all in toxic rows, or of those wanted in clean rows."""

    def run(batches):
        n: Counter[str] = Counter()
        for b in batches:
            for text in common.texts(b):
                found = _beginnings(set(_WORD.findall(fold(text.decode()))))
                n.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])

    return run


class Matcher:
    """Aho-Corasick over entries; yields each word's best entry unless an exception covers it."""

    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] = frozenset()):
        import ahocorasick

        self.lexicon, self.exceptions = lexicon, exceptions
        self.automaton = ahocorasick.Automaton()
        for e in lexicon:
            self.automaton.add_word(e, e)
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[str, list[str]]]:
        """(entry, phrases around it) of each matched word."""
        best: dict[int, str] = {}
        if self.lexicon:
            for end, e in self.automaton.iter(folded):
                at = end - len(e) + 1
                if (at == 0 or not folded[at - 1].isalnum()) and (at not in best or self.lexicon[e] > self.lexicon[best[at]]):
                    best[at] = e
        out = []
        for at, e in best.items():
            word = _WORD.match(folded, at)[0]
            before = _WORD.findall(folded[max(0, at - 40) : at])[-1:]
            after = _WORD.findall(folded[at + len(word) : at + len(word) + 40])[:1]
            phrases = [word, *(f"{x} {word}" for x in before), *(f"{word} {x}" for x in after)]
            if not self.exceptions.intersection(phrases):
                out.append((e, phrases))
        return out

    def measure(self, text: bytes) -> tuple[float, float, float]:
        """Sum of weights; the same per hundred words, damped for short texts; different entries."""
        hits = self.hits(fold(text.decode()))
        total = sum(self.lexicon[e] for e, _ in hits)
        return total, 100 * total / (len(text.split()) + 20), float(len({e for e, _ in hits}))


def _count_phrases(lexicon):
    def run(batches):
        match, n = Matcher(lexicon), {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(common.texts(b), b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
                n[y].update({p for _, phrases in match.hits(fold(text.decode())) for p in phrases})
        names = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([n[y][p] for p in names], pa.int64()) for y in (0, 1))], names=["phrase", "clean", "bad"])

    return run


def _measure(lexicon, exceptions, link):
    def run(batches):
        match = Matcher(lexicon, exceptions)
        for b in batches:
            x = np.array([match.measure(t) for t in common.texts(b)], float).reshape(-1, 3)
            keep = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != "text"]
            if link is None:
                more = [("x", pa.array(list(x), pa.list_(pa.float64())))]
            else:
                more = [("score", pa.array(link(x), pa.float64())), ("matches", pa.array(x[:, 2].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([c for _, c in [*keep, *more]], names=[n for n, _ in [*keep, *more]])

    return run


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries: the shortest beginning that tells toxic documents apart, lengthened while nearly all its documents share the longer one."""
    weight = {e: math.log((a + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1)) for e, a in toxic.items()}
    longer: dict[str, list[str]] = {}
    for e in toxic:
        longer.setdefault(e[:-1], []).append(e)
    out: dict[str, float] = {}
    for e in toxic:
        if weight[e] < LEAST_WEIGHT or any(weight.get(e[:n], 0) >= LEAST_WEIGHT for n in range(SHORTEST, len(e))):
            continue
        while (best := max(longer.get(e, ()), key=lambda x: (toxic[x], x), default=None)) and toxic[best] >= 0.9 * toxic[e]:
            e = best
        out[e] = weight[e]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MOST_ENTRIES])


class Link:
    """Logistic link on log-scaled measures."""

    def __init__(self, w: np.ndarray):
        self.w = w

    @staticmethod
    def scale(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.log1p(x), np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale(x) @ self.w, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> Link:
        """Newton's method on the ridge-penalised likelihood."""
        z, w = cls.scale(x), np.zeros(x.shape[1] + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
            w = w + np.clip(step, -5, 5)
        return cls(w)


def sample_labels(labels: DataFrame, column: str, most: int, wanted: str = "true") -> DataFrame:
    """About ``most`` labelled ids outside fold 0, at random by the id's hash: doc_id and the label as int."""
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (common.fold_of(F.col("doc_id")) != 0)).filter(wanted)
    n = ok.count()
    share = min(1.0, most / max(n, 1))
    kept = ok.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return kept.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias(column)).limit(int(1.2 * most) + 100)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """(lexicon, exceptions, link) from labelled documents outside fold 0."""
    scratch = common.Scratch(docs.sparkSession)
    ids = sample_labels(labels, "toxic", most)
    rows = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").repartition(common.partitions_of(docs.sparkSession)))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}, frozenset(), None

    def counts(of, wanted):
        got = rows.filter(F.col("toxic") == of).select("text").mapInArrow(_count_beginnings(wanted), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        least = max(LEAST_DOCUMENTS, n[1] // LEAST_SHARE) if of else 1
        return {r.entry: r.n for r in got.filter(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(MOST_CANDIDATES).collect()}

    toxic = counts(1, None)
    lexicon = choose(toxic, counts(0, frozenset(toxic)), n[1], n[0])
    seen = rows.mapInArrow(_count_phrases(lexicon), "phrase string, clean long, bad long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    benign = seen.filter((F.col("clean") >= 2) & (F.col("clean") / n[0] > F.col("bad") / n[1])).orderBy(F.desc("clean"), "phrase").limit(MOST_CANDIDATES)
    exceptions = frozenset(r.phrase for r in benign.collect())
    fitted = rows.mapInArrow(_measure(lexicon, exceptions, None), "toxic int, x array<double>").collect()
    scratch.drop(rows)
    link = Link.fit(np.array([r.x for r in fitted]).reshape(-1, 3), np.array([r.toxic for r in fitted]))
    return lexicon, exceptions, link


def score(docs: DataFrame, model) -> DataFrame:
    """docs' columns without text, and score and matches; input columns of these names give way."""
    docs = docs.drop("score", "matches")
    lexicon, exceptions, link = model
    if link is None:
        return docs.drop("text").withColumns({"score": F.lit(0.0), "matches": F.lit(0).cast("long")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", score double, matches long"
    return docs.mapInArrow(_measure(lexicon, exceptions, link), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(common.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. Labels are of documents by id, so the model is learnt on the stage's input."""
    labels = common.table(spark, sf_dir, "labels")
    model = learn(docs, labels)
    if model[2] is None:
        return docs
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return score(packed, model).filter("score < 0.5").select("row.*")
