"""Secret scan: fixed patterns, and a randomness test battery for other long tokens (DataFrame functions only).

Tokens are runs of 16 and more key characters outside the fixed patterns' matches that hold a letter.  A token with symbols of
both base64 alphabets (+ or / and - or _) is a path or a compound: its runs of letters and digits are tested instead.  Tokens of
over LONGEST characters are tested in pieces.  Each gets the encoding with the smallest alphabet that holds its characters.
Three tests ask whether it looks like independent uniform draws from it: chi-squared uniformity of the alphabet, the runs test
about the alphabet's middle, and serial correlation at lag one.  Fisher's sum of the three is the token's statistic; the
smaller, the more random.

False-discovery control is length-aware: for each cell of encoding and length class, the cut is the largest statistic at which
the expected number of ordinary tokens is at most ``rate`` times the number of tokens found.  What ordinary text gives comes
from the whole corpus: every word of every text (equal texts count once) is counted, with which characters of each encoding
follow one another in it, and the chain with these counts gives the statistic's histogram for each encoding and length class,
on top of PRIOR tokens of a fixed model of independent letters.  So every cell has a null from all texts, at every size of
corpus.  Both sides are histograms of fixed size, so no sort and no list of tokens is needed; equal tokens count once.  A token whose randomness is rejected outright (the statistic above RANDOM, which one random token in a
thousand exceeds) is never reported.

Offsets are code points, ends exclusive.  Base patterns keep their spans; the battery's are of kind ``random`` and do not
overlap them.  Places come from the pieces between matches; work and memory are near linear in a text's matches.
Defined cases: null and empty texts have no spans; equal rows are reported alike; an empty table gives no rows; columns other
than the two named are not read; a token may be as long as its text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import quoted, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run holds no longer one, so the least length can stand in the pattern
HEX = r"[0-9a-f]{16,}"
MASK = "\x01"
TOKEN = r"[A-Za-z0-9+/_\x01-]{16,}"  # the mask stands for characters of base matches
PLAIN = r"[A-Za-z0-9]{16,}"
NO_LETTER = "^[0-9_/+-]*$"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,end:int,token:string>>"
CHUNK = 256
LONGEST = 512
CUT = rf"(?s).{{{LONGEST},{LONGEST + 15}}}$|.{{1,{LONGEST}}}"  # the last piece is never shorter than a token

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": (DIGITS + "abcdef", "^[0-9a-f]*$"),
    "HEX": (DIGITS + "ABCDEF", "^[0-9A-F]*$"),
    "base26": (LOWER, "^[a-z]*$"),
    "BASE26": (UPPER, "^[A-Z]*$"),
    "base32": ("234567" + UPPER, "^[A-Z2-7]*$"),
    "base36": (DIGITS + LOWER, "^[a-z0-9]*$"),
    "BASE36": (DIGITS + UPPER, "^[A-Z0-9]*$"),
    "base52": (UPPER + LOWER, "^[A-Za-z]*$"),
    "base62": (DIGITS + UPPER + LOWER, "^[A-Za-z0-9]*$"),
    "base64": (DIGITS + UPPER + LOWER + "+/", "^[A-Za-z0-9+/]*$"),
    "base64url": (DIGITS + UPPER + LOWER + "-_", "^[A-Za-z0-9_-]*$"),
}
CLASSES = (16, 20, 24, 32, 48, 64)  # least lengths of the length classes
BINS_PER_UNIT, MOST = 4, 400
RANDOM = 22.458  # the 0.999 quantile of chi-squared with six degrees of freedom
WORD = r"[^\x20\x09-\x0D]{1,64}"
PRIOR, DRAWN, CHAINS = 500, 2000, 5000
# Letters of English text in percent, a to z.
SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column, pattern: str, group: int | None = None) -> Column:
    """The text as an array of (p, m, g): what lies before a match, the match, its group; the last has no match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    both = F.zip_with(matches, groups, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.zip_with(F.split(text, pattern, -1), both, lambda p, b: F.struct(p.alias("p"), b["m"].alias("m"), b["g"].alias("g")))


def spans(text: Column, pattern: str, *, group: int | None = None, keep=lambda m, g: F.lit(True)) -> Column:
    """Spans of the leftmost, non-overlapping matches that ``keep`` (of match and group) accepts: the pieces between matches
    and the matches, laid end to end, give the places.  Pieces are summed in chunks, so that arrays that grow stay short."""
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["p"])).cast("int")
        end = (start + F.coalesce(F.length(x["m"]), F.lit(0))).cast("int")
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("token"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"], x["g"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def chunks(all_: Column) -> Column:
        def add(done: Column, first: Column) -> Column:
            at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
            return F.concat(done, F.array(F.aggregate(F.slice(all_, first, CHUNK), F.struct(at.cast("int").alias("at"), none.alias("out")), step)))

        empty = F.array().cast("array<struct<at:int,out:" + SPAN + ">>")
        return F.aggregate(F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK)), empty, add, lambda done: F.flatten(F.transform(done, lambda c: c["out"])))

    return F.when(text.rlike(pattern), bind(pieces(text, pattern, group), chunks)).otherwise(none)


def masked(text: Column, pattern: str, *, group: int | None = None, keep=lambda m, g: F.lit(True)) -> Column:
    """The text with MASK for each character of the kept matches."""
    def shown(x: Column) -> Column:
        return F.concat(x["p"], F.when(x["m"].isNull(), "").when(keep(x["m"], x["g"]), F.repeat(F.lit(MASK), F.length(x["m"]))).otherwise(x["m"]))

    return bind(text, lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(pieces(t, pattern, group), shown), "")).otherwise(t))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation 7.1.26 of Abramowitz and Stegun, floored away from zero."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, half).otherwise(1 - half), F.lit(1e-30))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, statistic (Fisher's sum over the three tests) and cell (place of the encoding x number of classes + place
    of the length class) to rows with a column ``token``."""
    case, alphabet = F.lit(None), F.lit(None)
    for name, (letters, pattern) in reversed(ENCODINGS.items()):
        case = F.when(F.col("token").rlike(pattern), F.lit(name)).otherwise(case)
        alphabet = F.when(F.col("encoding") == name, F.lit(letters)).otherwise(alphabet)
    rows = tokens.withColumn("encoding", F.coalesce("encoding", case) if "encoding" in tokens.columns else case).withColumn("alphabet", alphabet)
    rows = rows.withColumn("n", F.length("token")).withColumn("k", F.length("alphabet").cast("double"))
    rows = rows.withColumn("x", F.expr("transform(regexp_extract_all(token, '.', 0), c -> cast(locate(c, alphabet) - 1 as double))"))
    rows = rows.withColumn("squares", F.expr("aggregate(array_distinct(x), 0D, (a, v) -> a + power(cast(size(filter(x, y -> y = v)) as double), 2))"))
    rows = rows.withColumn("high", F.expr("transform(x, v -> v >= k / 2)"))
    rows = rows.withColumn("n1", F.expr("cast(size(filter(high, h -> h)) as double)"))
    rows = rows.withColumn("runs", F.expr("1 + aggregate(zip_with(slice(high, 1, n - 1), slice(high, 2, n - 1), (a, b) -> a <> b), 0, (s, d) -> s + if(d, 1, 0))"))
    rows = rows.withColumn("mean", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"))
    rows = rows.withColumn("spread", F.expr("aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean))"))
    rows = rows.withColumn("serial", F.expr("aggregate(zip_with(slice(x, 1, n - 1), slice(x, 2, n - 1), (a, b) -> (a - mean) * (b - mean)), 0D, (s, v) -> s + v)"))
    uniform = F.expr("(k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)")
    runs = F.expr("if(n1 = 0 or n1 = n, 9D, abs(runs - 1 - 2 * n1 * (n - n1) / n) / sqrt(greatest(1e-9, 2 * n1 * (n - n1) * (2 * n1 * (n - n1) - n) / (1D * n * n * (n - 1)))))")
    serial = F.expr("if(spread = 0, 9D, abs(serial / spread + 1D / n) * sqrt(n))")
    fisher = -2 * (F.log(normal_tail(uniform)) + F.log(F.least(F.lit(1.0), 2 * normal_tail(runs))) + F.log(F.least(F.lit(1.0), 2 * normal_tail(serial))))
    kind, length_class = F.lit(None), F.lit(0)
    for i, name in enumerate(ENCODINGS):
        kind = F.when(F.col("encoding") == name, F.lit(i * len(CLASSES))).otherwise(kind)
    for i, c in enumerate(CLASSES):
        length_class = F.when(F.col("n") >= c, F.lit(i)).otherwise(length_class)
    return rows.withColumn("statistic", fisher).withColumn("cell", (kind + length_class).cast("int"))


def statistics(x: np.ndarray, k: int) -> np.ndarray:
    """The battery's statistic of many tokens of one length: a row of places in an alphabet of ``k`` for each."""
    rows, n = x.shape
    squares = (np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k) ** 2).sum(axis=1)
    high = x >= k / 2
    n1 = high.sum(axis=1).astype(float)
    d = x - x.mean(axis=1, keepdims=True)
    spread = (d * d).sum(axis=1)
    both = 2 * n1 * (n - n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        runs = np.abs((high[:, 1:] != high[:, :-1]).sum(axis=1) - both / n) / np.sqrt(np.maximum(1e-9, both * (both - n) / (n * n * (n - 1))))
        serial = np.abs((d[:, 1:] * d[:, :-1]).sum(axis=1) / spread + 1 / n) * np.sqrt(n)
    z = [(k / n * squares - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n), np.where(both == 0, 9.0, runs), np.where(spread == 0, 9.0, serial)]
    total = np.zeros(rows)
    for sides, v in zip((1, 2, 2), z, strict=True):
        a = np.abs(v) / 2**0.5
        t = 1 / (1 + 0.3275911 * a)
        half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a)
        total -= 2 * np.log(np.minimum(1.0, sides * np.maximum(np.where(v >= 0, half, 1 - half), 1e-30)))
    return total


@lru_cache(maxsize=1)
def model() -> dict[int, np.ndarray]:
    """For each cell the share of model tokens whose statistic lies in bin 0, in bins 0 and 1, ...: letters of English frequency,
    independent; where both cases fit one in 25 is a capital; a digit is as rare as 0.1 percent, a symbol 0.3."""
    out, rng = {}, np.random.default_rng(3)
    for i, (letters, _) in enumerate(ENCODINGS.values()):
        cases = {False: 1.0 if letters.upper() == letters else 0.04, True: 1.0 if not any(c.isupper() for c in letters) else 0.96}
        weight = np.array([SHARES[ord(c.lower()) - 97] * cases[c.islower()] if c.isalpha() else 0.1 if c.isdigit() else 0.3 for c in letters])
        for j, n in enumerate(CLASSES):
            found = statistics(rng.choice(len(letters), (DRAWN, n), p=weight / weight.sum()), len(letters))
            bins = np.minimum((found * BINS_PER_UNIT).astype(int), MOST)
            out[i * len(CLASSES) + j] = np.bincount(bins, minlength=MOST + 1).cumsum() / DRAWN
    return out


def cuts(found: DataFrame, ordinary: DataFrame, rate: float) -> dict[int, float]:
    """For each cell the largest statistic that keeps the expected share of ordinary tokens at ``rate``; from histograms of at
    most cells x MOST rows.  ``found`` has (own, cell, bin), ``ordinary`` (cell, bin)."""
    counts: dict[int, dict[int, list[int]]] = {}
    for which, df in enumerate((found, ordinary)):
        for r in df.groupBy("cell", "bin").count().collect():
            counts.setdefault(r["cell"], {}).setdefault(r["bin"], [0, 0])[which] += r["count"]
    out = {}
    for cell, own in counts.items():
        tokens, null = sum(v[0] for v in own.values()), sum(v[1] for v in own.values())
        seen = false = 0
        for b in sorted(b for b in own if b < RANDOM * BINS_PER_UNIT):
            seen, false = seen + own[b][0], false + own[b][1]
            share = (1 + false + PRIOR * model()[cell][b]) / (1 + null + PRIOR)
            if seen and share * tokens <= rate * seen:
                out[cell] = (b + 1) / BINS_PER_UNIT
    return out


def in_bins(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.least(F.floor(F.col("statistic") * BINS_PER_UNIT), F.lit(MOST)).cast("int"))


def letter_pairs(docs: DataFrame) -> DataFrame:
    """(encoding, pair, n): for each encoding how often its characters follow one another in the words of all texts, equal texts
    once; a blank stands before and after each word.  Other characters fall out.  Every word of every text counts but for the
    tokens that are tested, which may be secrets; pairs are taken from the distinct words, of which WORD cuts the long ones."""
    once = docs.groupBy(F.xxhash64("text", F.lit(1)).alias("own")).agg(F.first("text").alias("text"))
    words = once.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = words.withColumn("word", F.regexp_replace("word", TOKEN.replace(r"\x01", ""), ""))
    runs, twins = [], {}
    for i, (letters, _) in enumerate(ENCODINGS.values()):
        if letters.upper() == letters and letters.lower() in (own := [x for x, _ in ENCODINGS.values()]):
            twins[own.index(letters.lower())] = i  # the same characters in the other case
            continue
        source = F.translate("word", UPPER, LOWER) if letters == letters.lower() else F.translate("word", LOWER, UPPER) if letters == letters.upper() else F.col("word")
        run = F.regexp_replace(source, f"[^{letters.replace('-', '')}-]+" if "-" in letters else f"[^{letters}]+", "")
        runs.append(F.struct(F.lit(i).alias("encoding"), F.concat(F.lit(" "), run, F.lit(" ")).alias("run")))
    each = words.select("n", F.explode(F.array(*runs)).alias("r")).select("n", "r.encoding", "r.run").where(F.length("run") > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, F.lit(2)))
    found = each.select("encoding", "n", F.explode(pairs).alias("pair")).groupBy("encoding", "pair").agg(F.sum("n").alias("n"))
    both = F.array(F.struct("encoding", "pair"), F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in twins.items() for x in kv]), F.col("encoding")).alias("encoding"), F.upper("pair").alias("pair")))
    return found.select("n", F.explode(both).alias("p")).select("p.encoding", "p.pair", "n").where("encoding is not null")


def ordinary_bins(pairs: list) -> list[tuple[int, int, int]]:
    """(cell, bin, n): the statistic's histogram for tokens of run together text, from the rows of ``letter_pairs``: the chain in
    which a character follows another as often as in the texts, and words follow one another independently.  A cell has as many
    tokens as the texts' characters fill, or CHAINS."""
    found: dict[int, list] = {}
    for r in pairs:
        found.setdefault(r["encoding"], []).append((r["pair"], r["n"]))
    out = []
    for i, (letters, _) in enumerate(ENCODINGS.values()):
        k, rng = len(letters), np.random.default_rng([5, i])
        place = {c: j for j, c in enumerate(letters + " ")}
        seen = np.zeros((k + 1, k + 1))
        for (a, b), n in found.get(i, []):
            seen[place[a], place[b]] = n
        total = int(seen[:, :k].sum())
        if total < CLASSES[0]:
            continue
        follows = seen[:k, :k] + seen[:k, k:] * seen[k:, :k] / seen[k, :k].sum()
        often = follows.sum(axis=1)
        cum = np.cumsum(follows, axis=1) / np.maximum(often, 1e-300)[:, None]
        flat, first = (cum + np.arange(k)[:, None]).ravel(), np.cumsum(often) / often.sum()
        for j, size in enumerate(CLASSES):
            x = np.zeros((min(CHAINS, total // size), size), dtype=np.int64)
            if not len(x):
                continue
            x[:, 0] = np.minimum(np.searchsorted(first, rng.random(len(x)), side="right"), k - 1)
            for t in range(1, size):
                x[:, t] = np.minimum(np.searchsorted(flat, x[:, t - 1] + rng.random(len(x)), side="right") - k * x[:, t - 1], k - 1)
            counts = np.bincount(np.minimum((statistics(x, k) * BINS_PER_UNIT).astype(int), MOST))
            out += [(i * len(CLASSES) + j, int(b), int(counts[b])) for b in np.flatnonzero(counts)]
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """doc_id, and ``spans``: array of (start, end, kind) by start, then by kind in the order of KINDS."""
    texts = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    text, rest = F.col("text"), F.translate("text", MASK, " ")
    long_value = lambda m, g: F.length(g) >= 12
    for pattern, group, keep in ((ASSIGN, 2, long_value), (ACCESS, None, None), (HEX, None, None)):
        rest = masked(rest, pattern, group=group, **({"keep": keep} if keep else {}))
    marked = texts.withColumn("rest", rest).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        spans(text, ASSIGN, group=2, keep=long_value).alias("assign"),
        spans(text, ACCESS).alias("access"),
        spans(text, HEX).alias("hex"),
        spans(F.col("rest"), TOKEN, keep=lambda m, g: ~m.contains(MASK) & ~m.rlike(NO_LETTER)).alias("tokens"),
    )
    null = ordinary_bins(letter_pairs(texts).collect())  # at most (letters + 1) squared rows an encoding
    base = written(marked)
    each = base.select("row", F.explode("tokens").alias("c")).select("row", "c.start", "c.token")
    mixed = F.col("token").rlike("[+/]") & F.col("token").rlike("[-_]")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("token").alias("end"), F.col("token").alias("token"))).cast(SPAN)
    each = each.select("row", "start", F.explode(F.when(mixed, spans(F.col("token"), PLAIN)).otherwise(whole)).alias("c"))
    each = each.select("row", (F.col("start") + F.col("c.start")).alias("start"), F.posexplode(F.regexp_extract_all("c.token", F.lit(CUT), F.lit(0))).alias("i", "token"))
    each = each.where((F.length("token") >= CLASSES[0]) & ~F.col("token").rlike(NO_LETTER))
    each = each.select("row", (F.col("start") + F.col("i") * LONGEST).cast("int").alias("start"), "token")
    tested = in_bins(battery(each)).select("row", "start", (F.col("start") + F.col("n")).alias("end"), F.xxhash64("token").alias("own"), "cell", "statistic", "bin")
    tested = written(tested)
    ordinary = docs.sparkSession.createDataFrame(null, "cell int, bin int, n int").select("cell", "bin", F.explode(F.array_repeat("cell", F.col("n"))))
    cut = cuts(tested.select("own", "cell", "bin").distinct(), ordinary, rate)
    limit = F.create_map(*[F.lit(x) for kv in (cut or {-1: -1.0}).items() for x in kv])
    random = tested.where((F.col("statistic") <= RANDOM) & (F.col("statistic") < F.coalesce(F.try_element_at(limit, F.col("cell")), F.lit(-1.0))))
    by_row = random.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("random"))  # one document's own spans
    every = base.drop("tokens").join(by_row, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(F.coalesce(kind, none) if kind == KINDS[-1] else F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    named = [ranked(i, kind) for i, kind in enumerate(KINDS)]
    return every.select("doc_id", F.sort_array(F.concat(*named)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
