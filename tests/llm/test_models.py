import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import eflm, langid, pu_quality
from driftloom.llm.elias_fano import EliasFano
from driftloom.llm.queries import op7_pu_quality, op9_language_id, op10_elias_fano_lm


def fold(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_quality_query(spark, tables, rows, empty):
    out = op7_pu_quality(spark, tables).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert pu_quality.score_quality(empty, spark.read.parquet(f"{tables}/labels.parquet")).count() == 0
    none = pu_quality.score_quality(spark.read.parquet(f"{tables}/documents.parquet"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in none.collect()} == {0.5}


def test_quality_against_rows(spark, tables, rows):
    """Moments, weights, prior and scores from plain rows, one text at a time."""
    labels = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r.quality == 1}
    bins = {i: pu_quality.bins_of(np.array([pu_quality.statistics((t or "").encode())])) for i, t, *_ in rows}
    learn = [r[0] for r in rows if fold(r[0], 5)]
    x = np.vstack([pu_quality.one_hot(bins[i]) for i in learn])
    positive = np.array([i in labels for i in learn])
    p, u = sum(np.outer(v, v) for v in x[positive]), sum(np.outer(v, v) for v in x)
    first = pu_quality.fit(p, u, 0.5)
    tail = lambda w, v: np.bincount(np.minimum((np.clip((1 + v @ w) / 2, 0, 1) * 200).astype(int), 199), minlength=200).astype(float)
    weights = pu_quality.fit(p, u, pu_quality.best_bin_prior(tail(first, x[positive]), tail(first, x)))
    for r in op7_pu_quality(spark, tables).collect():
        assert r.score == pytest.approx(float(np.clip((1 + pu_quality.one_hot(bins[r.doc_id])[0] @ weights) / 2, 0, 1)), abs=1e-6)


def test_quality_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 9.0, True), (2, None, "y", 8.0, False)], "doc_id long, text string, bins string, score double, held_out boolean")
    labels = spark.createDataFrame([(1, 1, "z"), (1, 1, "w")], "doc_id long, quality int, positive string")
    assert sorted(r.doc_id for r in pu_quality.score_quality(df, labels).collect()) == [1, 2]


def test_quality_accuracy(spark):
    """Held-out accuracy with positives and unlabelled text only, negative labels being absent."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "and", "the", "of", "to"]
    texts, truth = [], []
    for i in range(1500):
        good = rng.random() < 0.7
        w = [rng.choice(words) + str(rng.randint(0, 99)) * (rng.random() < 0.1) for _ in range(rng.randint(60, 150))]
        texts.append((i, " ".join(w) if good else " ".join(x.upper() + rng.choice(["!!", "###", "$$$"]) for x in w)))
        truth.append(int(good))
    labels = [(i, 1) for i in range(0, 1500, 3) if truth[i]]
    out = pu_quality.score_quality(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_prior_estimate():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.8, 0.1, 20000), rng.normal(0.2, 0.1, 6000)
    count = lambda x: np.histogram(np.clip(x, 0, 1), 200, (0, 1))[0].astype(float)
    assert pu_quality.best_bin_prior(count(good[:10000]), count(np.concatenate([good[10000:], bad]))) == pytest.approx(10 / 16, abs=0.03)


def test_risk_is_that_of_all_rows():
    """The moments give the risk's minimum over all rows: compare with least squares on the rows."""
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 9, (400, len(pu_quality.NAMES))).astype(np.uint8)
    x = pu_quality.one_hot(bins)
    p = x[:150]
    w = pu_quality.fit(p.T @ p, x.T @ x, 0.3, ridge=0.05, steps=20000)

    def risk(v):
        neg = ((1 + x @ v) ** 2).mean() / 4 - 0.3 * ((1 + p @ v) ** 2).mean() / 4
        return 0.3 * ((1 - p @ v) ** 2).mean() / 4 + neg + 0.05 * v @ v

    assert all(risk(w) <= risk(w + 1e-3 * rng.normal(size=len(w))) + 1e-9 for _ in range(50))


def test_language_query(spark, tables, rows, empty):
    out = op9_language_id(spark, tables).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.held_out == (fold(r.doc_id, 5) == 0) and r.lang_pred == ("en" if letters else "und") and 0 <= r.score <= 1
    assert langid.identify(empty).count() == 0


def made_languages():
    rng = random.Random(4)
    stems = {"en": ["the", "ing", "tion", "and"], "de": ["ung", "sch", "keit", "der"], "fr": ["eau", "que", "ment", "les"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(12)), lang if i % 10 else None))
    return rows, {i: max(stems, key=lambda k: sum(t.count(s) for s in stems[k])) for i, t, _ in rows}


def plain_languages(rows, longest=5):
    """The model as dictionaries."""
    words, parts = {}, {}
    for _, text, lang in rows:
        for w in langid.WORD.findall((text or "").lower()):
            words.setdefault(lang, Counter())[w] += 1
            for k in range(1, longest + 1):
                parts.setdefault(lang, Counter()).update(f" {w} "[i : i + k] for i in range(len(w) + 3 - k))
    langs = sorted(words)

    def logs(table, key):
        return [math.log((table[x][key] or 0.5) / sum(table[x].values())) for x in langs]

    def predict(text):
        total = [0.0] * len(langs)
        for w in langid.WORD.findall((text or "").lower()):
            rows_ = [logs(words, w)] if any(words[x][w] for x in langs) else []
            for k in range(longest, 0, -1):
                rows_ = rows_ or [logs(parts, g) for g in (f" {w} "[i : i + k] for i in range(len(w) + 3 - k)) if any(parts[x][g] for x in langs)]
            total = [t + sum(r[i] for r in rows_) / max(1, len(rows_)) for i, t in enumerate(total)]
        best = max(range(len(langs)), key=lambda i: total[i])
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)

    return predict


def test_language_against_dictionaries(spark):
    """One shard or many: the same predictions as plain dictionaries, and right ones on the held-out rows."""
    rows, truth = made_languages()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 ², _", "fr"), (1003, "zzzz Theing", None), (1004, "x" * 50_000 + " ung" * 30_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("h", __import__("pyspark").sql.functions.lit("x")).withColumn("score", __import__("pyspark").sql.functions.lit("y"))
    predict = plain_languages([r for r in rows + odd if fold(r[0], 5) and r[2]])
    texts = {r[0]: r[1] for r in rows + odd}
    for entries in (1 << 20, 40):
        out = langid.identify(df, shard_entries=entries).collect()
        assert len(out) == len(rows + odd)
        for r in out:
            lang, score = predict(texts[r.doc_id]) if any(map(str.isalpha, texts[r.doc_id] or "")) else ("und", 0.0)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
        held = [r for r in out if r.held_out and r.doc_id < 1000]
        assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang = 'zz'")).collect()} == set()


def test_language_fallback_orders(spark):
    df = spark.createDataFrame([("aaa bbb", "x"), ("ccc ddd", "y")], "text string, lang string")
    (a, b, c, d) = langid.train(df).predict(["aaab", "dddd", "zzz", "12 ²"])
    assert a[0] == "x" and b[0] == "y" and c[1] == pytest.approx(0.5) and d[0] == "und"


@pytest.mark.parametrize("n,u", [(0, 10), (1, 1), (5, 6), (1000, 1200), (5000, 10**6), (20000, 2**63), (3000, 2**64 - 1)])
def test_elias_fano(n, u):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, u, n, dtype=np.uint64))
    e = EliasFano(EliasFano.encode(v))
    q = rng.integers(0, u, 2000, dtype=np.uint64)
    assert (e.all() == v).all() and (e.find(v) == np.arange(len(v))).all() and ((e.find(q) >= 0) == np.isin(q, v)).all()
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all()
    w = np.sort(rng.integers(0, 50, 300)).astype(np.uint64)  # repeats
    e = EliasFano(EliasFano.encode(w))
    assert (e.access(np.arange(300)) == w).all() and (e.all() == w).all()


def test_dense_stretch():
    v = np.unique(np.concatenate([np.arange(5000) * 2 + 10**12, np.random.default_rng(1).integers(0, 10**13, 500)])).astype(np.uint64)
    e = EliasFano(EliasFano.encode(v))
    assert (e.find(v) == np.arange(len(v))).all() and (e.find(v + np.uint64(1)) >= 0).sum() == np.isin(v + np.uint64(1), v).sum()


def plain_model(texts, order):
    counts = [Counter() for _ in range(order)]
    for t in texts:
        w = ["<s>", *(t or "").encode().lower().split(), b""]
        counts[0].update(w[1:])
        for k in range(2, order + 1):
            counts[k - 1].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total, words = sum(counts[0].values()), len(counts[0])
    totals, kinds = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    discount = []
    for k in range(1, order):
        for g, n in counts[k].items():
            totals[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        ones, twos = (sum(n == c for n in counts[k].values()) for c in (1, 2))
        discount.append(min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95))

    def score(t):
        w = ["<s>", *(t or "").encode().lower().split(), b""]
        base = out = 0.0
        for i in range(1, len(w)):
            p = (counts[0][w[i]] + 1) / (total + words + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                context = tuple(w[i - k + 1 : i]) if i - k + 1 >= 0 else None
                if context and totals[k - 1][context]:
                    d = discount[k - 2]
                    p = max(counts[k - 1][(*context, w[i])] - d, 0) / totals[k - 1][context] + d * kinds[k - 1][context] / totals[k - 1][context] * p
            out += math.log10(p)
        return base, out, len(w) - 1, sum(counts[0][x] > 0 for x in w[1:]), total

    return score


@pytest.mark.parametrize("shard_tokens", [2_000_000, 150])
def test_language_model_against_counting(spark, tables, rows, shard_tokens):
    """Also with shards so small that frequent contexts are cut."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = op10_elias_fano_lm(spark, tables).collect() if shard_tokens > 1000 else eflm.score_texts(docs, shard_tokens=shard_tokens).collect()
    score = plain_model([r[1] for r in rows if fold(r[0], 7) != 2], 3)
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        base, model, n, known, total = score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(model, abs=0.03 * n)


def test_frequent_context_with_one_child(spark):
    """Its key range is cut into many shards of which one has entries."""
    texts = [("new york " * 60 + f"w{i}",) for i in range(40)] + [(f"some other text {i} here",) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string")
    score = plain_model([t for i, (t,) in enumerate(texts) if fold(i, 7) != 2], 3)
    for r in eflm.score_texts(docs, shard_tokens=100).collect():
        assert r.score == pytest.approx(score(texts[r.doc_id][0])[1], abs=0.03 * r.n_tokens)


def test_language_model_extra_columns(spark):
    df = spark.createDataFrame([(3, "a b", "x", 1.0), (4, "a", "y", 2.0)], "doc_id long, text string, shard string, score double")
    assert sorted(r.n_tokens for r in eflm.score_texts(df).collect()) == [2, 3]


def test_keys_beyond_64_bits_are_an_error():
    eflm.check_keys(1 << 31, 1 << 32)
    with pytest.raises(OverflowError):
        eflm.check_keys(1 << 33, 1 << 32)


def test_language_model_edges(spark, empty):
    assert eflm.score_texts(empty).count() == 0
    only_held = next(i for i in range(100) if fold(i, 7) == 2)
    (r,) = eflm.score_texts(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a c",), ("a b b",), ("c a",)], "text string")
    trie = eflm.build(texts, order=2)
    first = np.array([True, False])
    hashes = {w: np.frombuffer(eflm.xxh64_digest(w), ">u8").astype(np.uint64)[0] for w in (b"a", b"b", b"c", b"")}
    total = sum(10 ** trie.score(np.array([hashes[b"a"], h]), first)[2][1] for h in hashes.values())
    unknown = 10 ** trie.score(np.array([hashes[b"a"], np.uint64(5)]), first)[2][1]
    assert total + unknown == pytest.approx(1, abs=0.03)


def test_texts_are_cut_into_tokens_twice(spark, docs, monkeypatch):
    """Only the vocabulary and the ids are made from the texts: higher levels and the scores read the ids."""
    counted = spark.sparkContext.accumulator(0)
    own = eflm.tokens_of

    def counting(raws):
        counted.add(len(raws))
        return own(raws)

    monkeypatch.setattr(eflm, "tokens_of", counting)
    out = eflm.score_texts(docs, shard_tokens=100).collect()
    assert counted.value == sum(not r.held_out for r in out) + len(out)


def test_runs_of_equal_high_parts():
    """Stretches of over 64 values of one high part, and their ends, are found."""
    from driftloom.llm.elias_fano import EliasFano

    for values in (np.arange(1000), np.concatenate([np.arange(63), [5000, 5001], np.arange(9000, 9064), np.arange(70_000, 70_200), [1 << 40]])):
        values = values.astype(np.uint64)
        code = EliasFano(EliasFano.encode(values))
        asked = np.arange(0, 71_000, dtype=np.uint64)
        at = np.searchsorted(values, asked)
        wanted = np.where((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == asked), at, -1)
        assert code.find(asked).tolist() == wanted.tolist()
        assert code.find(values).tolist() == list(range(len(values)))
