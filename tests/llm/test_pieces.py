"""SentencePiece encoding, whitening and spelling variants against a library, numpy and brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import sentencepiece_bpe, spelling, whitening
from newsloom.llm.common import Scratch

ALPHABET = "  ▁▁abcdethé\n\t日本ﬁＡ\u0000€😀²²..,-7"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    import public_tokenizers as P

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece_bpe.PieceModel(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60) | st.text(max_size=60) | st.text(alphabet="▁ ab", min_size=60, max_size=300))
def test_pieces_equal_library(model, library, text):
    ids, begins, ends = model.encode(text)
    want = library.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in want.pieces]
    assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want.pieces]
    assert model.decode(ids.tolist()).decode() == library.decode(ids.tolist())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31_999) | st.sampled_from([0, 1, 2, 229, 133, 175, 259, 28705]), max_size=8))
def test_pieces_decode_any_ids(model, library, ids):
    assert model.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_equals_library(model, rule):
    """The longest prefixes of compiled maps, with the place that each character came from."""
    import sentencepiece

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(sentencepiece_bpe._fields(normalizer.serialized_normalizer_spec()))
    own = object.__new__(sentencepiece_bpe.PieceModel)
    own.map, own.dummy, own.escape = sentencepiece_bpe.CharacterMap(spec[2]), False, False
    rng = random.Random(3)
    for squeeze in (False, True):
        own.squeeze = squeeze
        theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
        for _ in range(300):
            text = "".join(rng.choice("  \t\nabＡﬁé①½㍿ｶﾞ한İẞ\u200b\u0301") for _ in range(rng.randrange(20)))
            found, source = own._normalise_mapped(text) if text else ("", np.zeros(1))
            assert found == theirs.normalize(text)
            assert len(source) == len(found) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_pieces_tables(spark, library):
    texts = [None, "", "  a b", "x" * 70_000, "word " * 20_000, "wörter,\n①②😀" * 50, "wörter,\n①②😀" * 50]
    docs = spark.createDataFrame([(i % 6, t, [9], "begin") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, begins string")
    out = sentencepiece_bpe.encode(docs, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (r.text or "").encode()
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        assert b"".join(data[b:e] for b, e in zip(r.begins, r.ends)) == data
    again = sentencepiece_bpe.decode(out.drop("decoded").withColumn("ids", F.when(F.col("text").isNotNull(), F.col("ids")))).collect()
    assert [r.decoded for r in again] == [r.decoded for r in rows]
    assert sentencepiece_bpe.encode(docs.limit(0)).count() == 0


def test_pieces_models_it_refuses(model):
    unigram = b"\x12\x02\x18\x01"  # a trainer of another type
    with pytest.raises(ValueError):
        sentencepiece_bpe.PieceModel(unigram)


VECTORS = "vec_id long, embedding array<double>, n string, whitened string"


def whitened(spark, vectors):
    rows = [(i, v, "x", "y") for i, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 3
    rest = x[0, 1:].tolist()
    out = whitened(spark, [*x.tolist(), x[7].tolist(), None, [], [1.0] * 11, *([odd, *rest] for odd in (None, float("nan"), float("inf"), 1e300))])
    x = np.floor(1024 * np.vstack([x, x[7]])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(-values)[:8]
    want = (x - s / n) @ vectors[:, order] / np.sqrt(values[order])
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    signs = {}
    for r in out:
        c = r.component - 1
        assert r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())
        assert abs(abs(r.whitened) - abs(want[r.vec_id, c])) < 1e-9
        if abs(r.whitened) > 1e-6:
            signs.setdefault(c, set()).add(np.sign(r.whitened * want[r.vec_id, c]))
        assert abs(r.explained - values[order][c] / values.sum()) < 1e-12 and r.identity_error < 1e-9
    assert all(len(v) == 1 for v in signs.values())


def test_whitening_edges(spark):
    assert whitened(spark, [None, [], [None]]) == []
    one = whitened(spark, [[1.0, 2.0]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    line = whitened(spark, [[0.0, 5.0], [1.0, 5.0], [2.0, 5.0]])  # nothing varies along the second component
    assert [r.whitened is None for r in line] == [False, True] * 3 and all(r.identity_error < 1e-12 for r in line)
    wide = whitened(spark, [[1e9], [-1e9], [0.0]])  # beyond long: null, and exact where it fits
    assert [r.deviation for r in sorted(wide, key=lambda r: r.vec_id)] == [None, None, 0]
    assert whitening.whiten(spark.createDataFrame([(None, [1.0]), (None, [2.0])], "vec_id long, embedding array<float>")).count() == 2


def brute(docs):
    counts = collections.Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "\u00c0" <= c <= "\u00ff":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, found = {}, {}
    for w in n:
        around = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        forms[w] = around[0] if around and n[around[0]] >= 2 * n[w] else None
        found[w] = len(around)
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], found[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


def spelled(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in spelling.spelling_variants(df).collect())


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_spelling_equals_brute_force(spark, monkeypatch, group):
    """Also where every larger group is met by the rest of the words without a letter."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(11)
    stems = ["letter", "lettre", "während", "Österreich", "garten", "gärten", "straße", "señor", "abcde", "aabbccdd", "KELVIN", "x" * 60]
    docs = [(None, None), (0, ""), (1, "12 345"), (2, "Kelvin Åaaaa İbcde ẞabcd Ÿabcde " * 4)]
    for i in range(60):
        ws = []
        for _ in range(120):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", rng.choice("aeéß×")]) + w[k + rng.choice([0, 1]) :]
            ws.append(rng.choice([w, w.upper(), w.capitalize()]))
        docs.append((i % 50 if i else None, rng.choice([" ", ", ", "7"]).join(ws)))
    want = brute(docs)
    assert any(r[1] and r[2] != r[1] for r in want) and len(want) > 100
    assert spelled(spark, docs) == want


def test_spelling_edges(spark):
    assert spelled(spark, []) == [] and spelled(spark, [(1, None), (2, "a b c")]) == []
    assert spelled(spark, [(1, "")]) == []
    long = "ab" * 20_000  # one very long run
    assert [(r[1], r[3]) for r in spelled(spark, [(3, f"{long} {long} {long}")])] == [(None, 3)]
    chain = [(0, " ".join(w for w, k in (("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24)) for _ in range(k)))]
    assert [r[:3] for r in spelled(spark, chain)] == [r[:3] for r in brute(chain)]


def test_bands_hold_every_edit(spark):
    """Of the three bands of a word's mask one at least is equal after any edit."""
    rng, pairs = random.Random(2), []
    for _ in range(400):
        w = "".join(rng.choice("abcxyzàéß÷ÿ") for _ in range(rng.randrange(5, 12)))
        k = rng.randrange(len(w))
        pairs.append((w, w[:k] + rng.choice("aéz÷") + w[k + rng.choice([0, 1]) :]))
        pairs.append((w, w[:k] + w[k + 1 :]))
    masks = [spark.createDataFrame([(p[i],) for p in pairs], "word string").select("word", *[spelling._band(k) for k in range(3)]).distinct().collect() for i in (0, 1)]
    bands = {r[0]: r[1:] for rows in masks for r in rows}
    assert all(any(x == y for x, y in zip(bands[a], bands[b])) for a, b in pairs)


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r.root for r in spelling.roots(chain, Scratch(spark, "chain")).collect()} == {"w37"}


def test_bpe_memo_holds_the_pieces_of_a_task():
    """400,000 different pieces are encoded once each; with a smaller memo the second text was encoded anew."""
    from newsloom.llm.bpe import Codec

    codec, calls = Codec([bytes([i]) for i in range(256)], r" ?\S+"), []
    tree = codec.tree
    codec.tree = lambda data: calls.append(1) or tree(data)
    text = " ".join(f"{i:x}" for i in range(300_000))
    assert codec.round_trip(text) == codec.round_trip(text) and len(calls) == 300_000
