"""Hard negatives, byte-level BPE and phrase collocations against brute-force versions and a public library."""

import base64
import collections
import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, collocations, negatives, queries

IDS = "vec_id long, label int, embedding array<float>, twin string, v string, score int"


def vectors():
    pick = np.random.default_rng(8)
    rows = [(i, int(pick.integers(0, 3)), [float(x) for x in pick.normal(size=6).round(2)]) for i in range(160)]
    rows += [(i, 1, [0.5] * 6) for i in range(160, 175)]  # ties
    rows += [rows[20], rows[20], (50, 2, [1.0] * 6), (50, 2, [-1.0, 2.0, 0.0, 0.5, 1.0, 1.0])]  # repeated rows, several under one id
    rows += [(200, None, [1.0] * 6), (201, 1, None), (202, 1, [1.0, None]), (203, 1, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    rows += [(250, 1, [1.0, 2.0]), (251, 1, [2.0, 2.0]), (252, 2, [1.2, 1.0]), (300, 7, [0.3] * 6), (350, 1, [])]  # widths; a label of its own; no components
    rows += [(210, 1, [1e30, -1e30, 0.0, 1.0, 1.0, 1.0]), (211, 2, [3e4, 3e4, 1.0, 1.0, 1.0, 1.0]), (400, 1, [2e4, 3e4, 1.0, 1.0, 1.0, 1.0])]  # wide ones
    return rows


def mined(rows, n_positives=5, n_negatives=3):
    end = 2.0**53
    used = {(i, c, tuple(int(np.floor(min(max(256.0 * float(np.float32(x)), -end), end))) for x in e)) for i, c, e in rows if None not in (i, c, e) and all(x is not None and np.isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, c, e in used:
        if i % 50 == 0:
            scored = [(-dot(e, x), j, d) for j, d, x in used if j != i and len(x) == len(e)]
            for s, p in sorted((s, j) for s, j, d in scored if d == c)[:n_positives]:
                good = sorted((t, j) for t, j, d in scored if d != c and 50 * -s <= 100 * -t <= 95 * -s)[:n_negatives]
                yield from ((i, p, r + 1, j, clip(-s), clip(-t)) for r, (t, j) in enumerate(good))


@pytest.mark.parametrize("blocks", [(512, 8192), (2, 16)])
def test_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[1])
    rows = vectors()
    frame = spark.createDataFrame([(*r, "t", "v", 1) for r in rows], IDS)
    got = negatives.mine(frame, F.col("vec_id") % 50 == 0)
    want = list(mined(rows))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    assert any(abs(w[4]) == 2**63 - 1 for w in want) == any(abs(g[4]) == 2**63 - 1 for g in map(tuple, got.collect()))
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(frame.filter("vec_id is null or vec_id % 50 > 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_bit_planes_and_dropping():
    """Planes add up to the integers; dropping by intervals loses no row and leaves few before the last plane."""
    pick = np.random.default_rng(3)
    x = pick.integers(-300, 300, (400, 16))
    assert (sum(sign * (1 << b) * plane.astype(int) for b, sign, plane in negatives.bit_planes(x)) == x).all()
    import pandas as pd

    frame = lambda v, start: pd.DataFrame({"vec_id": np.arange(start, start + len(v)), "label": np.arange(len(v)) % 2, "v": list(v), "twin": 0})
    cell = negatives.Cell(frame(x[:20], 0), frame(x, 0))
    for i, best in enumerate(cell.positives(5)):
        scores = [(-int(x[i] @ x[j]), j) for j in range(400) if j != i and j % 2 == i % 2]
        assert [(-s, j) for s, j, _ in best] == [(s, j) for s, j in sorted(scores)[:5]]


def reference():
    import tiktoken
    from public_tokenizers import PATTERN

    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n \n", "it's  12 apples\t\tand\r\n   x ", "<|endoftext|> a", "Über straße 中文字 👍🏽 é", "a" * 5000, "ab" * 3000, "\x00 \x1c a\x85b", "x�\U0010ffff", " \n\n a\x0b b"]


def test_bpe_equals_the_library():
    pick, ref, own = random.Random(5), reference(), bpe.BytePairs.of(bpe.vocabulary_path())
    parts = ["the ", " of", "é", "ß", "\n", "  ", " \t", "\r\n", "1", "234", "'s", "'LL", "...", "<|", "中文", " ", " ", "aaaab", "\x00", "Über", "👍", "é", "acgtacga", "onethath"]
    texts = TEXTS + ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 30))) for _ in range(2000)]
    texts += ["".join(pick.choice(a) for _ in range(n)) for a in ("ab", "acgt", "etaoinsh", "xyé") for n in (1, 2, 17, 300, 2047, 2049, 6000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)
        assert own.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_bpe_long_and_short_rows_agree():
    """The row of a long piece merges as a matrix row does, pairs that rank below a merge's own included."""
    pick, own = random.Random(6), bpe.BytePairs.of(bpe.vocabulary_path())
    for alphabet in ("ab", "aab", "etaoin", "acgt", "éa"):
        for n in (2, 3, 9, 40, 400):
            raw = np.frombuffer("".join(pick.choice(alphabet) for _ in range(n)).encode(), np.uint8)
            rows, _ = own.merge_rows(own.single[raw][None], np.array([len(raw)]))
            assert own.merge_long(own.single[raw]).tolist() == rows.tolist()


def test_bpe_forgets_when_full(monkeypatch):
    own = bpe.BytePairs.of(bpe.vocabulary_path())
    want = own.encode(TEXTS)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "SOME", 3)
    assert own.encode(TEXTS) == want and own.encode(TEXTS[::-1]) == want[::-1]


def test_bpe_query(spark, tmp_path):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", "c", "c"), (3, None, "c", "c"), (3, "again", "c", "c"), (3, "again", "c", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    ref = reference()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := ref.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows]
    got = queries.op12_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert bpe.decode(bpe.encode(frame.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, 0, None), (2, 0, b"")], "doc_id long, n_tokens long, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(nothing).collect()} == {1: None, 2: b""}


FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def phrases(rows, least, most=2000, absorb=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = collections.Counter()
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                held[lang, p[i : i + size]] = max(held[lang, p[i : i + size]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if not held[lang, p] or 100 * held[lang, p] < absorb * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:most])]


def corpus():
    pick = random.Random(9)
    vocabulary = ["of", "the", "The", "É", "é", "a\x01", "a", " ", "x|y", "ß", *("".join(pick.choice("abc") for _ in range(2)) for _ in range(12))]
    rows = [(pick.choice(["en", "de", None, "und", ""]), "".join(pick.choice(vocabulary) + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(pick.randrange(0, 120)))) for _ in range(80)]
    return [*rows, *[rows[7]] * 9, ("en", None), (None, None), ("fr", ""), ("fr", ". ,\n"), ("en", "ha " * 3000), ("de", "of the " * 800 + "a b c d " * 50), ("zz", "never often")]


@pytest.mark.parametrize("hot,block", [(1000, 1 << 24), (4, 300)])
def test_collocations(spark, monkeypatch, hot, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = corpus()
    frame = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "lang string, text string, phrase string, f int, n int").repartition(3)
    for least, most in ((3, 2000), (30, 5)):
        got = collocations.top(collocations.collocations(frame, least_count=least, hot=hot), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        want = phrases(rows, least, most)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame, least_count=10**6).count() == 0


def test_hot_prefixes_are_dealt_deeper(spark):
    """Prefixes above the share are few, and rows below them are dealt by more words."""
    frame = spark.createDataFrame([("en", "of the a of the b of the c " * 40 + "x y z")], "lang string, text string")
    totals, common = collocations.hot_prefixes(frame, hot=8)
    assert [tuple(r) for r in totals.collect()] == [("en", 363)]
    assert {("en", "of "), ("en", "the "), ("en", "of the ")} <= common and not any("x" in p for _, p in common)
    depth = {r.suffix: r.depth for r in collocations.suffixes(frame, common).collect()}
    assert depth["of the a of "] >= 3 and depth["x y z "] == 1


PEAK = """
import random
import pyarrow as pa
from memloom.llm import collocations

def mb(name):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(name)) >> 10

pick = random.Random(3)
vocabulary = ["".join(pick.choices("abcdefgh", k=6)) for _ in range(20_000)]
texts = pa.array([" ".join(pick.choices(vocabulary, k=2_000)) for _ in range(1_200)])
batch = pa.record_batch([pa.nulls(len(texts), pa.string()), texts], ["lang", "text"])
before = mb("VmRSS")
print(sum(int(s.counts.sum()) for s in collocations._blocks(iter([batch]), 4)), mb("VmHWM") - before)
"""


def test_blocks_of_texts_stay_small():
    """Beside its batch of texts (17 MB) a Python worker holds the arrays of one small block."""
    run = subprocess.run([sys.executable, "-c", PEAK], env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(queries.__file__)))}, capture_output=True, text=True, check=True)
    words, peak = map(int, run.stdout.split())
    assert words == 2_400_000 and peak < 180


def test_many_words_and_languages():
    """Rows stay in reverse order where lang and four words take two numbers."""
    n = 60_000
    texts = [f"a{i:05d} b{i:05d} c{i:05d}" for i in range(n)] + [f"x y c{i:05d} b{i * 7 % n:05d}" for i in range(0, n, 30)]
    langs = [f"l{i:05d}" for i in range(n)] + ["l00000"] * (n // 30)
    s = collocations.Suffixes(pa.array(langs), pa.array(texts), 4).grouped()
    got = [t for t in s.texts(np.arange(len(s.counts)), 4).to_pylist() if t.startswith("x ")]
    assert got == sorted((t + " " for t in texts if t.startswith("x ")), reverse=True) and s.counts.sum() == 3 * n + 4 * n // 30
