"""Quality rules: a decision list learnt by sequential covering from labelled statistics.

Rules for the low class are grown one after another: conditions ``statistic >= t`` or
``<= t`` are added by information gain on two thirds of the rows, then pruned from the end
on the last third; a rule that is not precise enough there ends the list. The list is an
ordered Spark CASE expression over the statistics, so that it runs inside the engine's
generated code, and can be read.

Defined cases: a null or empty text has all counts 0 and fails the base rules; without
labels of both classes there are no rules and the base rules alone decide; an empty table
gives an empty table; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

MOST_LABELLED = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLDS = 64
MOST_CONDITIONS, MOST_RULES = 4, 16
MIN_PRECISION, MIN_COVER = 0.9, 5

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
#: Statistics the rules may use, as SQL over the counts. None drifts with a clean text's length but n_words.
STATISTICS = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK = _is(b"#*$%&|<>"), _is(bytes(range(65, 91))), _is(bytes(range(48, 58))), _is(b"!?")
_LETTER = _is(bytes([*range(65, 91), *range(97, 123)]))


def measure(text: bytes) -> tuple[int, ...]:
    """The counts of _COUNTS of one text."""
    data = np.frombuffer(text, np.uint8)
    by = np.bincount(data, minlength=256)
    words = common.word_hashes(data)
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = 0
    if len(words) >= 3:
        _, at, n = np.unique(common.ngram_hashes(words, 3), return_inverse=True, return_counts=True)
        twice = n[at] > 1
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k : len(words) - 2 + k] |= twice
        repeats = int(cover.sum())
    points = len(data) - int(by[128:192].sum())
    return (
        len(words), points - int(by[list(common.SPACE_BYTES)].sum()), int(by @ _SYMBOL), dup, repeats, lines,
        int(by @ _UPPER), int(by @ _LETTER), int(by @ _DIGIT), int(by @ _MARK),
    )


def _measure_rows(batches):
    for b in batches:
        x = np.array([measure(t) for t in common.texts(b)], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(len(_COUNTS)))], names=["doc_id", *_COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text, in one pass."""
    return docs.select("doc_id", "text").mapInArrow(_measure_rows, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.name]
        return v >= self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"({STATISTICS[self.name]}) {'>=' if self.above else '<='} {self.threshold!r}D"


def _holds(rule, x):
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < MOST_CONDITIONS and (y[inside] == 0).any():
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0:
            break
        best, best_gain = None, 0.0
        for name, v in x.items():
            own = v[inside]
            lows = np.unique(own[y[inside]])
            cuts = lows if len(lows) <= THRESHOLDS else np.unique(np.quantile(lows, np.linspace(0, 1, THRESHOLDS)))
            for above in (True, False):
                hit = own[:, None] >= cuts if above else own[:, None] <= cuts
                p, n = hit[y[inside]].sum(axis=0), hit[~y[inside]].sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if gain[k] > best_gain + 1e-9:
                    best, best_gain = Condition(name, above, float(cuts[k])), float(gain[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule, x, y):
    """The beginning of a rule that is worth most on rows it was not grown on."""

    def worth(k):
        hit = _holds(rule[:k], x)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 11) -> list[list[Condition]]:
    """Rules, most general first found, that tell low rows; each precise on rows kept from its growth."""
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(low), bool)
    while len(rules) < MOST_RULES and low[left].sum() >= MIN_COVER:
        third = rng.random(len(low)) < 1 / 3
        grow, test = left & ~third, left & third
        part = lambda m: ({k: v[m] for k, v in x.items()}, low[m])
        rule = _prune(_grow(*part(grow)), *part(test))
        if not rule:
            break
        hit = _holds(rule, x) & left
        tested = hit & test
        if low[hit].sum() < MIN_COVER or low[hit].mean() < MIN_PRECISION or (tested.any() and low[tested].mean() < MIN_PRECISION):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered conditional: false at the first rule that holds, true if none does."""
    out = "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN false" for r in rules) + " ELSE true END" if rules else "true"
    return F.expr(out)


def fit(measured: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[list[Condition]]:
    """Rules from at most about ``most`` labelled rows, taken by the hash of their id."""
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, most / max(ok.count(), 1))
    ok = ok.filter(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).limit(int(1.2 * most) + 100)
    rows = measured.join(F.broadcast(ok), "doc_id").select("doc_id", "quality", *[F.expr(q).alias(f"s{i}") for i, q in enumerate(STATISTICS.values())])
    got = rows.limit(2 * most).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    low = got["quality"].to_numpy() == 0
    return learn({name: got[f"s{i}"].to_numpy(float) for i, name in enumerate(STATISTICS)}, low) if low.any() and not low.all() else []


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    measured = common.Scratch(docs.sparkSession).keep(statistics(docs))
    rules = fit(measured, labels, **how)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select("doc_id", *_COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
