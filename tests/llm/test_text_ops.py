"""Winnowing, SimHash, encoding and quality rules against plain Python."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from turnweave.llm import bpe, compression, simhash, winnowing
from turnweave.llm.bpe import tokenizer_path

rng = random.Random(5)
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ODD = [
    None, "", " ", "\n\n\n", "a", "A b", "Don't we'll I'm they've he'd it's you're 'tis 'the ''s '",
    "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>", "tab\tand  two   three    \n\n next\n",
    "日本語のテキスト 12３4 ½", "naïve café Ünï x y", "emoji 😀😀 👩‍👩‍👧 flag", "a" * 5000, "word " * 700,
    "end space ", "  lead", "\r\n\r\nwin\r\n", "mixed123abc!!??  ...' s", "can't've \n's", "🙂's 's's",
    "\x1c\x1d weird \x85 next line", "'s", " 's", "!'s", "1're", "don'T", "o'lls 'lls",
]


# --- encoding -------------------------------------------------------------
@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(tokenizer_path())


def random_text():
    return "".join(rng.choice(["ab", " ", "  ", "\n", "'", "'s", "é", "1", "!", "語", "\t", "The", "<|endoftext|>", "'ll", " "]) for _ in range(rng.randint(0, 60)))


def test_encoding_equals_the_library(spark, spec):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec)
    texts = ODD + [random_text() for _ in range(400)] + ["same text"] * 5
    got = bpe.decode(bpe.encode(table(spark, list(enumerate(texts))), spec, block_bytes=2000), spec).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        want = whole.encode(text, add_special_tokens=False).ids
        assert r.tokens == want, (text, r.tokens, want)
        assert r.decoded == whole.decode(want, skip_special_tokens=False) == text


def test_splitter_keeps_every_byte():
    texts = [t for t in ODD if t]
    data = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    words, first = bpe.word_splitter(("<|endoftext|>",))(np.frombuffer(data, np.uint8), off)
    words = words.to_pylist()
    assert ["".join(words[a:b]) for a, b in zip(first[:-1], first[1:])] == texts


def test_decoding_broken_bytes(spark, spec):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec)
    rows = [(i, [rng.randrange(50257) for _ in range(20)]) for i in range(50)] + [(99, [])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>"), spec).collect()
    assert all(r.decoded == whole.decode(r.tokens, skip_special_tokens=False) for r in got)


def test_encoding_null_ids_and_empty_table(spark, spec):
    df = table(spark, [(None, "a b", 1), (None, None, 2), (7, "x", 3)], "doc_id long, text string, tokens long")
    assert sorted((r.doc_id is None, len(r.tokens)) for r in bpe.encode(df, spec).collect()) == [(False, 1), (True, 0), (True, 2)]
    assert bpe.encode(table(spark, []), spec).count() == 0


# --- quality --------------------------------------------------------------
def base(text):
    text = text or ""
    words = SPACES.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_quality_counts(spark):
    few = ["a", "b", "é#", "c|"]
    texts = ODD + [" ".join(rng.choices(few, k=rng.randint(0, 80))) + rng.choice(["", "\nx\nx\n \n"]) for _ in range(200)]
    got = compression.judge(table(spark, [(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, kept string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(700))
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(60)) for _ in range(100))
    lists = "\n".join(f"row {i} of the list has nothing to say at all" for i in range(900))
    half = prose[:4096] + "".join(f"z{i % 7}y " for i in range(2000))
    got = {r.doc_id: r for r in compression.judge(table(spark, [(1, prose), (2, noise), (3, lists), (4, half), (5, None)])).collect()}
    assert got[1].kept and got[1].reason is None
    assert not got[2].kept and got[2].reason == "incompressible"
    assert not got[3].kept and got[3].reason in ("repetitive", "base rules")
    assert not got[4].kept
    assert not got[5].kept and got[5].ratio is None
    packer = zstandard.ZstdCompressor(level=3)
    assert got[1].ratio == len(packer.compress(prose.encode())) / len(prose)
    assert compression.judge(table(spark, [])).count() == 0


# --- decontamination ------------------------------------------------------
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(text, items):
    words, hit, names = ALNUM.findall(lower(text)), set(), set()
    for name, item in items:
        ws = ALNUM.findall(lower(item))
        n = min(len(ws), 13)
        windows = {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p:p + n]) in windows:
                hit |= set(range(p, p + n))
                names.add(str(name))
    return len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("rows", [10_000, 0])
def test_winnowing_equals_all_windows(spark, rows):
    vocab = ["Red", "blue", "a1", "é", "x"]
    items = [(i, " ".join(rng.choices(vocab + [f"i{i}"], k=n))) for i, n in enumerate([1, 3, 5, 9, 12, 13, 14, 20, 40, 40])]
    items += [(20, None), (21, "..."), (22, items[7][1]), (22, "zz " * 15)]
    docs = []
    for i in range(150):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(len(part) - 1, 0))
            text += rng.choice(["! ", " q "]) + "-".join(part[a:a + rng.randint(1, 30)]) + " " + " ".join(rng.choices(vocab, k=rng.randint(0, 9)))
        docs.append((i, text.upper() if i % 7 == 0 else text))
    docs += [(900, None), (901, ""), (902, "zz " * 40), (902, "zz " * 40), (None, "zz " * 13)]
    spec = winnowing.Winnow(broadcast_rows=rows)
    got = winnowing.contamination(table(spark, docs), table(spark, items, "item_id long, text string", 2), spec).collect()
    want = sorted(map(repr, [(d, *contaminated(t, items)) for d, t in docs]))
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in got) == want
    assert winnowing.contamination(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0
    none = winnowing.contamination(table(spark, docs), table(spark, [], "item_id long, text string")).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)


def test_every_shared_span_has_a_fingerprint():
    for _ in range(200):
        g = np.array([rng.randrange(6) for _ in range(30)], np.uint64)
        inside = np.ones(30, bool)
        kept = set(winnowing._winnowed(g, inside, 9).tolist())
        assert all(any(p in kept and g[p] == g[i:i + 9].min() for p in range(i, i + 9)) for i in range(22))


# --- simhash --------------------------------------------------------------
def fingerprint(text):
    words = SPACES.findall(lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs):
    """doc_id -> smallest reachable id, all pairs compared."""
    ids, fps = zip(*pairs)
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    best = {}
    for i, c in zip(ids, comp):
        best[c] = min(best.get(c, i), i)
    return [best[c] for c in comp]


def test_simhash_fingerprints_and_components(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for g in range(12):
        seed = rng.choices(words, k=rng.randint(2, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(seed)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), rng.choice([" ", "\n"]).join(copy)))
    docs.append((docs[-1][0], docs[-1][1]))
    got = simhash.near_duplicates(table(spark, docs)).collect()
    want = classes([(d, fingerprint(t)) for d, t in docs])
    expected = sorted((d, fingerprint(t), c) for (d, t), c in zip(docs, want))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("dense", [3, 20_000])
def test_links_lose_no_pair(spark, dense):
    centres = [rng.getrandbits(64) for _ in range(15)]
    fps = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    got = {r.node: r.root for r in simhash.components(simhash.link_edges(df, dense=dense)).collect()}
    want = classes([(x, x % (1 << 64)) for x in fps])
    assert [got.get(x, x) for x in fps] == want


def test_every_word_has_one_anchor():
    fp = np.array([rng.getrandbits(63) for _ in range(500)], np.int64)
    row, anchor, own = simhash.anchors_of(fp, 2)
    assert np.array_equal(np.bincount(row[own]), np.ones(500))
    halves = [(anchor >> s) & ((1 << 23) - 1) for s in (0, 23)]
    assert not simhash._syndrome(halves[0]).any() and not simhash._syndrome(halves[1]).any()


def test_long_paths_meet(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 - i, 1001 - i) for i in range(200)] + [(5000, 5001)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 801 for i in range(801, 1002)) and got[5001] == 5000
