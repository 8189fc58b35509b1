"""Each operator against a brute-force version, on planted and awkward rows.

Awkward rows: null and empty texts, null ids, repeated rows, very long texts, ties and
extra columns whose names clash with the operators' own.
"""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import common, exact_topk, language, line_dedup, mixing, near_dedup, packing, quality_rules, resampling, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words string, key string, cls string, size string, running string, score string, uid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(2 + rng.randrange(vocabulary) % 6)) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(1, 150)) + ("\n" + passage + "\n" + prose(rng, 9) if i % 9 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 4}" if i % 7 else None))
    for i in range(60, 90):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((i, " ".join(words), "en", "s0"))
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, " \n\t ", "en", "s1"), (93, "one two", "en", "s2"), (94, "One  TWO", "en", "s2"), (None, base, "en", "s0"), (95, base, "en", "s0"), (95, base, "en", "s0")]
    rows += [(96, "ab" * 400, "en", "s3"), (97, prose(rng, 30_000), "en", "s3"), (98, "日本語 テキスト é x " * 30, None, "s3"), (99, "12345 67890 !!!", "en", "s3")]
    return [(d, t, la, s, 7, "x", "k", "c", "z", "r", "q", "u") for d, t, la, s in rows]


ROWS = make_rows()
TEXTS = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(90)] + [(None, 1, 1), (3, None, None), (4000, 1, 0)], "doc_id long, quality int, toxic int")


def records(df):
    return [r.asDict() for r in df.collect()]


# Counting and rules


def base_counts(t):
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered, seen, dup = collections.Counter(tri), set(), set(), 0
    for i, g in enumerate(tri):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@pytest.mark.parametrize("text", [t for _, t in TEXTS if len(t) < 5000] + ["a b c a b c a", "x\nx\n\n \nx", "###|<> $a&", "é ü a"])
def test_op1_counts(text):
    assert quality_rules.measure(text.encode())[:5] == base_counts(text)


def test_op1_rows(docs, none, labels):
    got = records(quality_rules.judge(docs, labels))
    assert len(got) == len(ROWS)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert records(quality_rules.judge(none, labels)) == []
    assert all(r["kept"] != r["base_failed"] for r in records(quality_rules.judge(docs, labels.limit(0))))


def test_op1_learns_planted_rule(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    low = (x["a"] >= 0.7) & (x["b"] <= 0.4) | (x["c"] >= 0.95)
    rules = quality_rules.learn(x, low)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= np.logical_and.reduce([c.holds(x) for c in r])
    assert (hit & low).sum() / low.sum() > 0.9 and (hit & low).sum() / hit.sum() > 0.9


def test_op2_draw(docs, none, labels):
    got = records(resampling.resample(docs, labels, share=0.5))
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == round(len(ROWS) / 2)
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(1, len(ROWS) + 1))
    cut = min(r["noisy_weight"] for r in got if r["kept"])
    assert all(r["noisy_weight"] <= cut for r in got if not r["kept"])
    again = {(r["doc_id"], r["place"]) for r in records(resampling.resample(docs.repartition(5), labels, share=0.5))}
    assert again == {(r["doc_id"], r["place"]) for r in got}
    assert records(resampling.resample(none, labels)) == []
    assert {r["log_weight"] for r in records(resampling.resample(docs, labels.limit(0)))} == {0.0}


def test_op2_log_weights(spark, docs, labels):
    """Every log weight against counts in plain Python; long texts are not scaled."""
    from millrace.llm import common

    def grams(t):
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()).split()
        one = [common.word_hashes(np.frombuffer(x, np.uint8))[0] for x in w]
        two = [common.ngram_hashes(np.array(one[i : i + 2], np.uint64), 2)[0] for i in range(len(one) - 1)]
        return [int(x) >> 50 for x in [*(common.mix(np.array([x], np.uint64))[0] for x in one), *two]]

    short = [(i, " ".join(t.split()[:400])) for i, t in TEXTS]
    bags = [grams(t) for _, t in short]
    good = {i for i in range(90) if i % 2}
    raw, target = collections.Counter(), collections.Counter()
    for (d, _), b in zip(short, bags, strict=True):
        raw.update(b)
        target.update(b if d in good else [])
    size = resampling.BUCKETS
    p, q = (lambda x: (target[x] + 1) / (sum(target.values()) + size)), (lambda x: (raw[x] + 1) / (sum(raw.values()) + size))
    want = sorted((str(d), len(b), round(sum(np.log(p(x)) - np.log(q(x)) for x in b), 6)) for (d, _), b in zip(short, bags, strict=True))
    got = records(resampling.resample(spark.createDataFrame(short, "doc_id long, text string"), labels, share=0.5))
    got = sorted((str(r["doc_id"]), r["n_features"], round(r["log_weight"], 6)) for r in got)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


# Search


@pytest.mark.parametrize("block_bytes", [exact_topk.BLOCK_BYTES, 2000])
def test_op3_against_brute_force(spark, monkeypatch, block_bytes):
    """In one query block, and in many."""
    monkeypatch.setattr(exact_topk, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.choice([-1.0, -0.25, 0.0, 0.3, 0.9], 40)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(800, None), (900, [1.0, None]), (901, [float("nan")] * 40), (902, [float("inf")] * 40), (903, []), (1100, [0.5] * 3), (1101, [0.5] * 3), (1200, [3e9] * 40), (None, rows[0][1])]
    rows += [(1300, [float("nan")] * 40), (1300, [0.3] * 40)]  # the row that can be used asks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in usable:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q and len(y) == len(x))
            want |= {(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scored[:10])}
    got = {tuple(r) for r in exact_topk.search(df, df.filter("vec_id % 100 = 0")).collect()}
    assert got == want
    assert exact_topk.search(df.limit(0), df.limit(0)).count() == 0


# Lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_op4_banded_distance():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(10))) for _ in "ab")
        for edits in range(4):
            assert line_dedup.within(a, b, edits) == (edit_distance(a, b) <= edits)


def lines_gone(rows, bands):
    """Numbers of the lines that go, by document. bands: (least length, edits) as in the operator."""
    first, every = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for k, x in enumerate(t.split("\n")):
            if len(x) >= bands[0][0]:
                every.append((d, k, x))
                first.setdefault(x, (d is not None, d, k))
    edits = lambda x, y: max((n for least, n in bands if min(len(x), len(y)) >= least))
    late = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= edits(x, y) and line_dedup.within(x, y, edits(x, y))}
    gone = collections.defaultdict(set)
    for d, k, x in every:
        if x in late or first[x][1:] != (d, k):
            gone[d].add(k)
    return gone


@pytest.mark.parametrize(("bands", "crowd"), [(((40, 1),), 32), (((40, 1),), 4), (((40, 2),), 32), (((40, 2),), 3), (((40, 1), (60, 2), (64, 3)), 8)])
def test_op4_against_brute_force(spark, bands, crowd):
    rng = random.Random(4)
    templates = [prose(rng, 12) for _ in range(4)]

    def vary(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], ["x"], [s[i], "y"], ["é"]])
        return "".join(s)

    rows = [(i, "\n".join(vary(rng.choice(templates)) for _ in range(3))) for i in range(70)] + [(90, ""), (91, "short\nshort")]
    gone = lines_gone(rows, bands)
    got = {r["doc_id"]: r for r in records(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=bands, crowd=crowd))}
    for d, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        assert (got[d]["n_removed"], got[d]["kept_text"], got[d]["kept_sha256"]) == (len(gone[d]), left, hashlib.sha256(left.encode()).hexdigest())


def test_op4_awkward_rows(docs, none):
    got = line_dedup.stage_line_dedup(docs.sparkSession, docs, "")
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    gone = lines_gone(sorted(set(TEXTS), key=str), line_dedup.BANDS)
    assert kept[90] is None and kept[91] == "" and 95 not in kept
    for d, t in TEXTS:
        if d in kept and d not in (90, None):
            assert kept[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
    assert line_dedup.stage_line_dedup(docs.sparkSession, none, "").count() == 0


def test_op4_crowd_of_strangers(spark):
    """A crowd of variants of one line of which none is near another, and pairs among them that are."""
    rng = random.Random(12)
    base, rows = "".join(rng.choice("abcdefgh ") for _ in range(121)), []
    for i in range(2000):
        at = rng.sample(range(121), 4)
        rows.append((i, "".join("xyz"[i % 3] if k in at else c for k, c in enumerate(base))))
    rows += [(3000 + i, rows[i][1][:60] + "Q" + rows[i][1][60:]) for i in range(0, 2000, 40)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=((40, 1),)).collect()}
    # lines of one length are near if they differ in one place; 121 and 122 characters meet in the last 50 alone
    texts = np.array([np.frombuffer(t.encode(), np.uint8) for _, t in rows[:2000]])
    late = {i for i in range(2000) if ((texts[:i] != texts[i]).sum(axis=1) <= 1).any()}
    assert {d for d, n in got.items() if n} == late | set(range(3000, 5000)) & set(got)


def test_op4_few_files(spark, monkeypatch):
    """Each file costs processes where it is written: tables that end an aggregate, and what meets, have few of them however many partitions are shuffled."""
    rng, sizes, keep = random.Random(6), [], common.Scratch.keep
    base, rows = prose(rng, 14), []
    for i in range(90):
        at = rng.sample(range(len(base)), 2)
        rows.append((i, "".join("xyz"[i % 3] if k in at else c for k, c in enumerate(base))))

    def counted(self, df, *args, **named):
        sizes.append(len((out := keep(self, df, *args, **named)).inputFiles()))
        return out

    monkeypatch.setattr(common.Scratch, "keep", counted)
    wanted = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, bands=((40, 1),), crowd=8).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {d for d, n in got.items() if n} == {d for d, gone in lines_gone(rows, ((40, 1),)).items() if gone}
    # tables of lines, first places, what met, pairs, keys of crowds, their rows, names; what follows depends on the rounds
    assert max(sizes[i] for i in (1, 2, 3, 4, 6)) <= 5, sizes


def test_op4_short_copies(spark):
    rows = [(1, "one\n\none\n \n \ntwo"), (2, "two\nthree\n\n "), (3, "threes"), (4, "ü\nü")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {1: "one\n\n \n \ntwo", 2: "three\n\n ", 3: "threes", 4: "ü"}
    assert {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df, copies=line_dedup.COPIES).collect()} == kept
    assert {r.doc_id: r.text for r in line_dedup.stage_line_dedup(spark, df, "").collect()} == kept


# Learnt scores


def planted(spark, n=400):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randrange(5, 120)).split(), i % 4 == 0
        for _ in range(2 + i % 3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumph", "Grumphing", "VILELY", "vile", "gr0mp3d", "ѕneer"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_op5_held_out_accuracy(spark, docs, none):
    df, marks = planted(spark)
    model = toxicity.learn(df, marks)
    got = records(toxicity.score(df, model))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in records(toxicity.score(docs.select("doc_id", "text"), model)))
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0
    assert {r["score"] for r in records(toxicity.score(df.limit(5), toxicity.learn(df, marks.limit(0))))} == {0.0}


def test_op5_scores_by_brute_force(spark, docs):
    """Each score again from the learnt lexicon, exceptions and weights, word by word and without an automaton."""
    df, marks = planted(spark)
    lexicon, exceptions, link = model = toxicity.learn(df, marks)
    exceptions = exceptions | {"vile"} if "vile" in lexicon else exceptions
    model = lexicon, exceptions, link
    rows = [(1, "a vile grumphing"), (2, ""), (3, None), (4, "gr0mp3d " * 3000), (5, "ѕneer, VILELY! x")] + [(r.doc_id, r.text) for r in df.collect()]
    got = {r["doc_id"]: r for r in records(toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model))}
    for d, t in dict(rows).items():
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", toxicity.fold(t or ""))]
        folded, hits = toxicity.fold(t or ""), []
        for w, at, end in words:
            fit = [e for e in lexicon if w.startswith(e)]
            before, after = re.findall(r"[^\W_]+", folded[max(0, at - 40) : at])[-1:], re.findall(r"[^\W_]+", folded[end : end + 40])[:1]
            if fit and not exceptions & {w, *(f"{x} {w}" for x in before), *(f"{w} {x}" for x in after)}:
                hits.append(max(fit, key=lambda e: lexicon[e]))
        total = sum(lexicon[e] for e in hits)
        x = np.log1p([total, 100 * total / (len(WORD.findall(t or "")) + 20), len(set(hits))])
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(np.append(x, 1) @ link.w, -30, 30))), abs=1e-9)
        assert got[d]["matches"] == len(set(hits))


def test_op5_folding_and_exceptions():
    assert toxicity.fold("VіL3​ ｓｃｕｍ") == "vile scum"
    m = toxicity.Matcher({"vile": 2.0, "vil": 1.0}, frozenset({"vile potion"}))
    assert [e for e, _ in m.hits("a vilest vile potion vil! devil")] == ["vile", "vil"]


def test_op7_held_out_accuracy(spark, docs, none):
    rng = random.Random(7)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 60)))
    rows = [(i, make(["abcdeo", "xyzéwu", "ñllraé"][i % 3]), ["aa", "bb", "cc"][i % 3]) for i in range(400)] + [(900, None, "aa"), (901, "123 !", "aa"), (902, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    got = {r["doc_id"]: r for r in records(language.identify(df.select("doc_id", "text"), model))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == ["aa", "bb", "cc"][i % 3] for i in held]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    assert len(records(language.identify(docs.select("doc_id", "text"), model))) == len(ROWS)
    assert language.learn(none) is None and records(language.identify(df.limit(1), None))[0]["lang_pred"] == "und"


def test_op7_scores_by_brute_force(spark):
    """Each prediction again from the learnt table, subword by subword; a long text as a whole."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice(["abcdeo", "xyzwu"][i % 2]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(2, 40))), ["aa", "bb"][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    again = language.learn(df.repartition(7))
    assert model.names == again.names and np.array_equal(model.table, again.table)
    mult = lambda h, x: ((h ^ h >> 15) * 0x85EBCA77 + x * 0xC2B2AE3D) & 0xFFFFFFFF
    for text in [*(t for _, t, _ in rows[:20]), "A", "Éa 7 ñ_b", "abc xyz " * 30_000]:
        data = [x + 32 if 65 <= x <= 90 else x for x in f" {text.lower()} ".encode()]
        data = [x if 97 <= x <= 122 or x >= 128 else 32 for x in data]
        z, n = np.zeros(len(model.names)), 0
        for i in range(len(data) - 1):
            h = data[i] * 0x9E3779B1 & 0xFFFFFFFF
            for size in (2, 3, 4):
                if i + size > len(data):
                    break
                h = mult(h, data[i + size - 1])
                part = data[i : i + size]
                if (part != [32, 32]) if size == 2 else 32 not in part[1:-1]:
                    z += model.table[h >> 17]
                    n += 1
        z = (z / max(1, n) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        name, score = model.predict(text)
        assert score == pytest.approx(p.max() / p.sum(), abs=1e-6) and name == model.names[int(p.argmax())]


# Packing


def test_op6_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = records(packing.pack_documents(docs, with_ids=True))
    have, want = collections.Counter(), collections.Counter()
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] <= 4096
        have[r["doc_id"], r["piece"], r["start"], bytes(r["ids"])] += 1
    for d, text in TEXTS:  # a row that is repeated is packed as often
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want.update((d, k, a, ids[a:z].tobytes()) for k, (a, z) in enumerate(zip(at, at[1:], strict=False)))
    assert have == want and max(have.values()) > 1
    seq = collections.defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 1024
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a b\n c  d", "x\n \ny", "ça va\tz  b", "foo \nbar\n", "it's don't  ", "a　 b", "\n\na b", "a b c", "tail ", "<|endoftext|>x"])
def test_op6_encoder(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert np.frombuffer(packing.encoder()(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_op6_added_tokens(spark):
    """The operator's ids against the tokenizer as the contract sets it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|><|endoftext|>  c", "<|endoftext|", "x <|ENDOFTEXT|>"]))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()}
    assert got == {k: [*t.encode(x, add_special_tokens=False).ids, packing.END_TOKEN] for k, x in rows}
    assert got[0][:3] == [64, 50256, 65]


def test_op6_best_fit_is_tight():
    rng = random.Random(9)
    lengths = [rng.randrange(1, 1024) for _ in range(20_000)]
    fit = packing.BestFit()
    used = collections.Counter()
    for n in lengths:
        b, at = fit.put(n)
        assert used[b] == at
        used[b] += n
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(lengths) / 1024 + 60


# Mixing


def water(sizes, weights, budget, repeats):
    """Targets by search for the level at which min(cap, weight * level) sums up to the budget."""
    caps = [repeats * x for x in sizes]
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for c, w in zip(caps, weights, strict=True)) < min(budget, sum(caps)) else (low, mid)
    return [min(c, w * high) for c, w in zip(caps, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[10, 100, 100], [0, 0], [0, 5, 7, 1000], [1, 1, 1, 1, 1, 1, 900], [50], [3, 0, 800, 20, 20, 1]])
def test_op8_targets(spark, sizes):
    from millrace.llm import common

    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    plan, budget = mixing.targets(spark.createDataFrame(rows, "source string, size long"), mixing.WEIGHTS, 1.5, 2, common.Scratch(spark))
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
    assert [r.target for r in sorted(plan.collect(), key=lambda r: r.source)] == pytest.approx(want, rel=1e-9)
    assert budget == pytest.approx(1.5 * sum(sizes))


def test_op8_mix(docs, none):
    got = records(mixing.mix(docs))
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True))
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= max(largest.values()) for s in sizes)
    pick = lambda rows: sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in rows)
    assert pick(records(mixing.mix(docs.repartition(7)))) == pick(got)
    assert records(mixing.mix(none)) == []


# Repeats and near copies


def test_op9_against_brute_force(docs, none):
    seen = collections.Counter(hashlib.md5(t.encode()[p : p + 200]).digest() for _, t in TEXTS for p in range(len(t.encode()) - 199))
    want = []
    for d, t in TEXTS:
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 199):
            if seen[hashlib.md5(b[p : p + 200]).digest()] > 1:
                cover[p] += 1
                cover[p + 200] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()]
    assert sorted(map(str, ((*r[:5], bytes(r[5])) for r in got))) == sorted(map(str, want))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_op9_doubling(spark):
    """Ranks alone, over every window of a few texts, against counts; in many partitions, and with a passage that most texts hold."""
    from millrace.llm import common

    rng = random.Random(13)
    passage = "".join(rng.choice("ab") for _ in range(260))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(150))) + (passage[rng.randrange(40) :] if i % 5 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(80))) for i in range(40)]
    texts += ["x" * 700, "ab" * 300, texts[3], "y" * 199]
    rows = [(i, 0, bytearray(t.encode()), [suffix_dedup.pack(0, len(t) - 200)]) for i, t in enumerate(texts) if len(t) >= 200]
    seen = collections.Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    want = sorted((i, p) for i, t in enumerate(texts) for p in range(len(t) - 199) if seen[t[p : p + 200]] > 1)
    runs = spark.createDataFrame(rows, "run long, first long, bytes binary, spans array<long>").repartition(3)
    assert suffix_dedup.offsets(200) == [32, 64, 72] and suffix_dedup.offsets(64) == [32]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(tuple(r) for r in suffix_dedup.doubling(runs, 200, common.Scratch(spark)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def components(rows, num=75, den=100):
    sets = []
    for _, t in rows:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), set()).add(d)
    return [(d, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_op10_against_brute_force(docs, none):
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in records(near_dedup.near_duplicates(docs)))
    assert got == sorted(map(str, components(TEXTS)))
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("around", ["original", "none"])
def test_op10_large_group(spark, around):
    """A group of more classes than a node compares exhaustively, with and without the text all come from."""
    rng = random.Random(10)
    base = prose(rng, 150).split()
    rows = []
    for i in range(900):
        words = list(base)
        for _ in range(rng.randrange(4) if i and around == "original" else 2 if around == "none" else 0):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99999)}"
        rows.append((i, " ".join(words)))
    assert len({t for _, t in rows}) > near_dedup.SMALL
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in records(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == sorted(components(rows))


def test_op10_pairs_away_from_the_original(spark):
    """Pairs in a large group that resemble its original, but are linked to each other alone."""
    rng = random.Random(11)
    base = prose(rng, 160).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(1 + rng.randrange(3) if i else 0):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    for i in range(40):
        at = rng.randrange(130)
        words = base[:at] + [f"p{i}n{k}" for k in range(21)] + base[at + 21 :]
        again = list(words)
        again[(at + 80) % 150] = "other"
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(again))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in records(near_dedup.near_duplicates(df, small_node=32)))
    assert got == sorted(components(rows))


@pytest.mark.parametrize("remembered", [3, 10**6])
@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(120)], [(0, i) for i in range(90)] + [(i, i + 200) for i in range(0, 90, 3)], [(i * 37 % 150, i * 91 % 149) for i in range(130)]])
def test_components(spark, edges, remembered):
    from millrace.llm import graph

    common.ship(spark)
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), common.Scratch(spark), remembered).collect()
    assert sorted(map(tuple, got)) == sorted((x, m) for x, m in least.items() if any(a != b and x in (a, b) for a, b in edges))
