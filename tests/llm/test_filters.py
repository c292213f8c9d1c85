import random
import re
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import cascade, decontam
from driftloom.llm.queries import op5_decontamination, op6_quality_cascade
from prose_maker import prose


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_cascade_query(spark, tables, rows):
    texts = {r[0]: r[1] for r in rows}
    out = op6_quality_cascade(spark, tables).collect()
    assert len(out) == len(rows)
    for r in out:
        n, chars, symbols, dup, repeat = brute_counts(texts[r.doc_id])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        verdict = not failed and not any(rule(cascade.Text((texts[r.doc_id] or "").encode())) for rule in cascade.RULES.values())
        assert r.kept == verdict


def test_counts_on_noise():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "a b a ", "\n", "é ", "# ", " ", "\x1c", "\x85", "\t", "$"]) for _ in range(60))
        t = cascade.Text(text.encode())
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_counts(text)


def test_order_never_changes_the_verdict(docs):
    names = list(cascade.RULES)
    runs = [sorted((r.doc_id, r.kept) for r in cascade.cascade(docs, keep=["doc_id"], counts=False, order=o).collect()) for o in (names, names[::-1])]
    assert runs[0] == runs[1]
    assert cascade.ranked({"a": (1e-6, 0.1), "b": (1e-6, 0.5), "c": (1e-9, 0.0), "d": (1e-8, 0.1)}) == ["d", "b", "a", "c"]


def test_plan_is_conditional():
    """A rule that rejects only what another has rejected already comes last, however well it does alone."""
    raws = [b"a " * 10] * 60 + [b"# " * 10] * 30 + [b"x " * 10] * 10

    def slow(t, letter):
        return sum(letter in w for _ in range(40) for w in t.words) > 0

    rules = {"fast_a": lambda t: t.raw[:1] == b"a", "slow_a": lambda t: slow(t, b"a"), "slow_hash": lambda t: slow(t, b"#")}
    got = cascade.profile(raws, rules)
    assert [n for n, _, _ in got] == ["fast_a", "slow_hash", "slow_a"]
    assert [r for _, _, r in got] == [0.6, 0.75, 0.0]
    assert sorted(n for n, _, _ in cascade.profile([])) == sorted(cascade.RULES)


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(None,), ("",)] + [(f"text {i}",) for i in range(4000)] + [("x" * 100_000,)], "text string").repartition(4)
    got = cascade.sample(df, rows=50)
    assert len(got) == 50 and all(len(r) <= cascade.SAMPLE_BYTES for r in got)


def test_clashing_names_and_empty(spark, empty):
    df = spark.createDataFrame([("x y", 3, "q")], "text string, kept int, n_words string")
    out = cascade.cascade(df)
    assert sorted(out.columns) == sorted(["text", *cascade.COUNTS, "base_failed", "kept"]) and out.first().n_words == 2
    assert cascade.cascade(empty).count() == 0


def slow_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, 25), rng.integers(0, 6, 40)
    score, first, last = decontam.align(a, b)
    assert score == slow_align(a, b)
    assert slow_align(a, b[first : last + 1]) == score


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append("changed" if x < share * 2 / 3 else w)
        if x > 1 - share / 3:
            out.append("added")
    return out


def test_copies_and_edits_are_found(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(15, 60))) for i in range(30)]
    rows, truth = [], set()
    for i in range(300):
        words = prose(rng, 200).split()
        if i % 3 == 0:
            item, text = items[rng.randrange(30)]
            own = text.split() if i % 2 else edited(text.split(), rng, 0.15)
            at = rng.randrange(200)
            words[at:at] = own
            truth.add((i, item))
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, items[0][1] + " " + items[0][1]), (1002, items[0][1] + " " + items[0][1])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (77, None), (78, " ")], "item_id long, text string")
    out = decontam.contaminated(df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    assert truth <= found and {d for d, _ in found} - {d for d, _ in truth} == {1002}
    text = dict(rows)
    for r in out:
        assert len(re.findall(r"\w+", text[r.doc_id][r.start : r.end])) >= 5 and 0.5 <= r.score <= 1
    blocks = decontam.contaminated(df, bench, block_bytes=500).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == found
    kept = {r.doc_id for r in decontam.without_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in found}


def test_against_every_pair(spark, tables):
    """Seeds lose no pair that aligning everything with everything finds."""
    docs, bench = spark.read.parquet(f"{tables}/documents.parquet").collect(), spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    expected = set()
    for b in bench:
        item = re.findall(r"\w+", (b.text or "").lower())
        if not item:
            continue
        number = {w: i for i, w in enumerate(dict.fromkeys(item))}
        own = np.array([number[w] for w in item])
        for d in docs:
            words = np.array([number.get(w, -1) for w in re.findall(r"\w+", (d.text or "").lower())])
            if len(words) and decontam.align(own, words)[0] >= decontam.needed(len(item), 0.5, 8):
                expected.add((d.doc_id, b.item_id))
    assert {(r.doc_id, r.item_id) for r in op5_decontamination(spark, tables).collect()} == expected and expected


def test_neighbouring_copies(spark):
    """Every copy gives a row, whatever lies between them."""
    item = [f"w{j}" for j in range(12)]
    one, other = " ".join(item), " ".join(f"f{j}" for j in range(60))
    texts = [one, f"{one} {one}", f"{one} x {one} y {one}", f"{one} {other} {one}", " ".join([one] * 7), " ".join(item[:4] + item[4:] + item[:7] + ["z"] * 2 + item[9:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.contaminated(docs, spark.createDataFrame([(1, one)], "item_id long, text string")).collect()
    assert [sum(r.doc_id == i for r in rows) for i in range(6)] == [1, 2, 3, 2, 7, 2]
    for i in range(6):
        own = sorted((r.start, r.end) for r in rows if r.doc_id == i)
        assert all(b <= c for (_, b), (c, _) in zip(own, own[1:]))


def test_short_items(spark):
    """No item is left out; short ones count when whole."""
    items = [(1, "the"), (2, "rare words"), (3, "one two three four"), (4, "a b c d e f g h")]
    texts = [(1, "in the end"), (2, "rare old words"), (3, "some Rare words."), (4, "one two three four"), (5, "one two four"), (6, "a b c d e f g h"), (7, "a b c x e f g h")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (3, 2), (4, 3), (6, 4)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, shortest=5).collect()} == {(6, 4)}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.without_contaminated(empty, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")).count() == 0


def test_copies_edited_every_few_words(spark):
    """Substitutions every 3 to 6 words and insertions after every one to 4 words are found wherever they reach the threshold, and
    so are random edits of a tenth to a third of the words: recall is 1 at every share."""
    rng, items, texts, expected = random.Random(21), [], [], set()
    for k in range(60):
        item = [f"w{k}x{j}" if j % 3 else rng.choice(["the", "of", "and", "in"]) for j in range(20 + k % 21)]
        items.append((k, " ".join(item)))
        for kind, every in (("swap", 3), ("swap", 4), ("swap", 5), ("swap", 6), ("add", 1), ("add", 2), ("add", 4)):
            copy = [x for j, w in enumerate(item) for x in ((["new%d" % j] if kind == "swap" else [w, "new%d" % j]) if j % every == every - 1 else [w])]
            number = {w: i for i, w in enumerate(dict.fromkeys(item + copy))}
            if decontam.align(np.array([number[w] for w in item]), np.array([number[w] for w in copy]))[0] >= decontam.needed(len(item), 0.5, 8):
                expected.add((len(texts), k))
            texts.append((len(texts), " ".join(["before"] * 30 + copy + ["after"] * 30)))
        for share in (0.1, 0.2, 0.25, 0.33):
            copy = [f"new{j}" if rng.random() < share else w for j, w in enumerate(item)]
            number = {w: i for i, w in enumerate(dict.fromkeys(item + copy))}
            if decontam.align(np.array([number[w] for w in item]), np.array([number[w] for w in copy]))[0] >= decontam.needed(len(item), 0.5, 8):
                expected.add((len(texts), k))
            texts.append((len(texts), " ".join(["before"] * 30 + copy + ["after"] * 30)))
    assert len(expected) > 300
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == expected
    assert {r.doc_id for r in decontam.without_contaminated(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _ in expected}
