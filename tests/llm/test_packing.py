import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm.packing import Packer, encoder, pack_documents, step_groups
from driftloom.llm.queries import op1_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def exact_ids(text):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, digest=True):
    """Each id lies in one piece; sequences are gapless, at most 2048, and padded by little."""
    ids = {d: exact_ids(t) for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.doc_tokens == len(ids[r.doc_id])
        assert (r.ids_crc32 == zlib.crc32(own)) if digest else (bytes(r.ids) == own)
    assert by_doc.keys() == ids.keys()
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding == 0
    return by_doc, ids


def test_query_against_tokenizer(spark, tables, rows):
    out = op1_packing(spark, tables).collect()
    texts = {r[0]: r[1] for r in rows}
    copies = defaultdict(int)
    for r in rows:
        copies[r[0]] += 1
    by_doc, ids = check(out, texts)
    for d, own in by_doc.items():
        covered = sum(r.length for r in own)
        assert covered == copies[d] * len(ids[d])


def test_full_texts_and_special_strings(spark):
    texts = {1: "<|endoftext|> plain", 2: None, 3: "  spaces   \n\n and é ü 漢字 " * 500, 4: "x"}
    out = pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect()
    check(out, texts, digest=False)


def test_both_libraries_agree(monkeypatch):
    """The file of ranks and the .json vocabulary give the same ids; with specials, those of the plain tokenizer."""
    import builtins

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "plain words", "é ü 漢字\n\n  \t x", "don't we'll 123 4567", "\u2028 \x00 \U0001f600"]
    fast = encoder(PATH)
    plain = Tokenizer.from_file(PATH)
    assert [encoder(PATH, True)(t).tolist() for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    real = builtins.__import__

    def without(name, *a, **k):
        if name == "tiktoken":
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    slow = encoder.__wrapped__(PATH)
    monkeypatch.undo()
    as_text = Tokenizer.from_file(PATH)
    as_text.encode_special_tokens = True
    assert [fast(t).tolist() for t in texts] == [slow(t).tolist() for t in texts] == [as_text.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 not in fast(texts[0]) and 50256 in encoder(PATH, True)(texts[0])


def test_empty(spark, empty):
    assert pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packer_windows(seed):
    rng = np.random.default_rng(seed)
    packer, windows = Packer((256, 512, 1024, 2048)), []
    sizes = [int(x) for x in rng.lognormal(5.5, 1.6, 3000) + 1]
    for d, n in enumerate(sizes):
        windows += packer.add(d, n)
        if d % 500 == 0:
            windows += packer.full_windows()
    windows += packer.full_windows() + packer.tail()
    seen = defaultdict(int)
    for w in windows:
        n = sum(p[2] for p in w)
        assert n <= 2048 and n & (n - 1) == 0
        for d, _, k in w:
            seen[d] += k
    assert [seen[d] for d in range(len(sizes))] == sizes
    groups = step_groups(windows, 1 << 14)
    cost, tokens, tier = defaultdict(int), defaultdict(int), defaultdict(set)
    for w, g in zip(windows, groups, strict=True):
        cost[g] += sum(p[2] ** 2 for p in w)
        tokens[g] += sum(p[2] for p in w)
        tier[g].add(sum(p[2] for p in w))
    assert max(tokens.values()) <= 1 << 14 and all(len(t) == 1 for t in tier.values())
    full = [c for g, c in cost.items() if tier[g] == {2048} and tokens[g] == 1 << 14]
    assert max(full) - min(full) < 0.35 * max(full)


def test_both_encoders_agree():
    text = "Some words, 123 numbers!? é漢 \n\t  <|endoftext|> end"
    assert encoder(PATH)(text).tolist() == exact_ids(text)[:-1]
