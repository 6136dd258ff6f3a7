"""The training-data operators against brute force on small, awkward tables."""

import collections
import hashlib
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import bpe, classifier, fingerprints, licenses, mixing, neardup, pii, quality, toxicity, warc
from newsloom.llm.common import Scratch

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(20_000))
BASE = " ".join(f"word{i}" for i in range(120))
TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i j k l", BASE, BASE, BASE.replace("word50 ", ""), BASE.upper(), LONG, "x" * 50_000, "😀 é ß 日本 " * 20]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", 0, 7, True, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, None, None, None, None, None, None, None), (None, BASE, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abtheion \n", max_size=400) | st.text(alphabet="aab", min_size=100, max_size=600))
def test_bpe_equals_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_tables(docs, none, library):
    out = bpe.encode(docs, decoded="decoded").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_quality(spark, docs, none):
    for r in quality.quality_rules(docs, None, keep=docs.columns).collect():
        w, lines = space_words(r.text), [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r._nl_n_words, r._nl_word_chars, r._nl_n_dup_lines, r._nl_n_repeat, r._nl_base_failed) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered), failed)
        assert r._nl_kept == (not failed)
    assert quality.quality_rules(none, None, keep=["doc_id"]).count() == 0


def test_quality_ratio_rejects_foreign_words(spark):
    good, bad = [" ".join(random.Random(i).choices("alpha beta gamma delta epsilon zeta eta".split(), k=60)) for i in range(40)], "### $$$ %%% &&& *** @@@ !!! ^^^ ~~~ === +++ |||"
    docs = spark.createDataFrame([*enumerate(good), (99, bad)], "doc_id long, text string")
    out = {r.doc_id: r._nl_kept for r in quality.quality_rules(docs, spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), keep=["doc_id"]).collect()}
    assert not out.pop(99) and all(out.values())


def test_quality_trusts_every_good_label(spark):
    """More good labels than the former cap all count, broadcast or shuffled."""
    root = Scratch(spark, "test-quality").root
    n = 120_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{root}/labels.parquet")
    trusted = quality.trusted_ids(spark, root)
    assert trusted.count() == n
    docs = spark.range(0, n, 100).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    ratios = quality.ratio_table(docs, trusted, 64).first().ratios
    assert max(map(abs, ratios)) < 1e-9


def test_licenses(spark, docs, none):
    cases = {
        1: ("Released under the MIT License.", "", "mit", 0),
        2: ("CC-BY 4.0, all rights\nreserved; ALL RIGHTS RESERVED", "cc-by,reserved", "cc-by,reserved", 3),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0", 1),
        4: ("mit licence license the", "", "", 0),
        5: (None, "", "", 0),
    }
    out = licenses.scan_licenses(spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "doc_id long, text string"), keep=["doc_id"])
    for r in out.collect():
        _, base, labels, n = cases[r.doc_id]
        assert (",".join(r._nl_base), ",".join(r._nl_labels), len(r._nl_places)) == (base, labels, n)
        assert 0 <= r._nl_score <= 1
    assert licenses.scan_licenses(docs, keep=docs.columns).count() == docs.count()
    assert licenses.scan_licenses(none, keep=["doc_id"]).count() == 0


def test_licenses_with_stray_words(spark):
    """A rare word elsewhere in the file hides no notice that has its key phrase in place."""
    text = "This file is under the MIT license. It was first released in 2019"
    rows = [(1, text), (2, "x " * 500 + "mit " * 50 + text), (3, "released under the license of mit")]
    out = {r.doc_id: (r._nl_labels, r._nl_score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    mention = licenses.weight(2)  # two words are a weak sign
    assert out == {1: (["mit"], mention), 2: (["mit"], mention), 3: ([], 0.0)}


def test_license_headers_tell_their_versions(spark):
    """Headers as files hold them, with a line's comment marks; a text of another version shares all but the key phrase."""
    gnu = "# This {0} is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {1}General Public License as published by\n# the Free Software Foundation; either version {2} of the License, or\n# (at your option) any later version.\n"
    cases = {
        1: (gnu.format("program", "", 2), "gpl,gpl-2.0"),
        2: (gnu.format("program", "", 3), "gpl,gpl-3.0"),
        3: (gnu.format("library", "Lesser ", "2.1"), "gpl,lgpl,lgpl-2.1"),
        4: (gnu.format("program", "Affero ", 3), "agpl,agpl-3.0,gpl"),
        5: ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.", "gpl,gpl-2.0"),
        6: ("Redistributions in binary form must reproduce. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
        7: ("we talked about the mit license and the bsd license at lunch", "bsd,mit"),
        8: (licenses.TEXTS[3][1], "apache-2.0"),
        9: (next(t for label, t, _ in licenses.TEXTS if label == "mit").title(), "mit"),
    }
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert {i: ",".join(r._nl_labels) for i, r in out.items()} == {i: c[1] for i, c in cases.items()}
    assert out[7]._nl_score < 0.4 < 0.9 < min(out[8]._nl_score, out[9]._nl_score)


def brute_labels(text):
    """Every template at every start: its key phrase in place, and enough of its words within SLACK places of theirs."""
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    found = {}
    for label, t, key in (*licenses.TEMPLATES, *licenses.TEXTS):
        t, key = t.split(), key.split()
        at = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
        for s in range(-len(t), len(ws)):
            if s + at >= 0 and ws[s + at : s + at + len(key)] == key:
                share = sum(s + q + licenses.SLACK >= 0 and w in ws[max(0, s + q - licenses.SLACK) : max(0, s + q) + 1 + licenses.SLACK] for q, w in enumerate(t)) / len(t)
                if share >= licenses.LEAST:
                    found[label] = max(found.get(label, 0), share * licenses.weight(len(t)))
    base = {label for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()}
    return sorted(base | set(found)), max([*found.values(), *(licenses.weight(len(p.split())) for p, label in licenses.PHRASES if label in base)], default=0.0)


def test_licenses_against_brute_force(spark):
    rnd = random.Random(11)
    texts = [
        "MIT License", "distributed under the MIT License. Released yesterday", "Licensed under Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: MIT",
        "This is free and unencumbered software that was released into the whole public domain.", None, "", "mit", "license " * 30, "the mit of license",
    ]
    words = sorted({w for _, t, _ in (*licenses.TEMPLATES, *licenses.TEXTS) for w in t.split()}) + ["river", "stone"]
    for _ in range(120):
        _, t, _ = rnd.choice(rnd.choice([licenses.TEMPLATES, licenses.TEXTS]))
        t = t.split()
        for _ in range(rnd.randrange(0, 5)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(words))
        if rnd.random() < 0.4:
            del t[rnd.randrange(len(t))]
        texts.append(" ".join([rnd.choice(words) for _ in range(rnd.randrange(20))] + t + [rnd.choice(words) for _ in range(rnd.randrange(20))]))
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()
    got = {r.doc_id: (r._nl_labels, round(r._nl_score, 9)) for r in out}
    assert got == {i: (x, round(y, 9)) for i, (x, y) in enumerate(map(brute_labels, texts))}
    assert [got[i][0] for i in range(6)] == [["mit"], ["mit"], ["apache-2.0"], ["apache-2.0"], ["mit"], ["unlicense"]]


def test_fingerprints(spark, docs, none):
    out = fingerprints.fingerprint_documents(docs).collect()
    assert len(out) == docs.count() and fingerprints.fingerprint_documents(none).count() == 0
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[r.text].add(str(r.fp))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text), r.edited) for r in out)
    for k, ((_, _, text), edited) in enumerate(ordered):
        h, after = len(text) // 2, ordered[(k + 1) % len(ordered)][0][2]
        assert edited == text[: len(text) - h] + after[:h]


def test_likeness_of_moved_parts_and_long_texts(spark):
    """Insertions move the rest of a text and cost only their own anchors; a passage in long texts is found."""
    w = [f"w{i}" for i in range(600)]
    x = [f"x{i}" for i in range(60)]
    twice = w[:200] + x[:20] + w[200:400] + x[20:40] + w[400:]
    long = [[f"{c}{i}" for i in range(10_000)] + x + [f"{c}{c}{i}" for i in range(10_000)] for c in "pq"]
    pairs = [(w, w), (w, twice), (w, x), long, (w + w, w + w)]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    df = fingerprints.add_fingerprint(fingerprints.add_fingerprint(df, "a", "fa"), "b", "fb")
    out = {r.i: (r.near, len(r.fa.w.h)) for r in fingerprints.add_likeness(df, "fa", "fb", "near").collect()}
    assert out[0][0] == out[4][0] == 1 and out[1][0] > 0.85 and out[2][0] == 0 and 0 < out[3][0] < 0.01
    assert out[3][1] > 0.3 * 20_060 and out[4][1] > 1.9 * out[0][1]


def plain_anchors(text):
    """Closed syncmers by their definition, scale by scale; Spark's xxhash64 hashes values one after the other from seed 42."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def together(*longs):
        seed = 42
        for x in longs:
            seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return signed(seed)

    of = lambda x: signed(xxhash.xxh64_intdigest(x.encode(), 42))
    out, ws = {}, space_words(text)
    for name, k, s, low, high in fingerprints.SCALES:
        has = low < len(text) <= high
        if name == "w":
            has, symbols = has and len(ws) >= k, ws
        else:
            has, symbols = has or (name == "c" and len(text) > high and len(ws) < fingerprints.FEW), list(text)
        h = [of(x) for x in symbols] if has else []
        inner = h if s == 1 else [together(*h[i : i + s]) for i in range(len(h) - s + 1)]
        found = []
        for i in range(len(h) - k + 1):
            mer = inner[i : i + k - s + 1]
            if min(mer) in (mer[0], mer[-1]):
                found.append((together(*h[i : i + k]), i))
        out[name] = sorted(found) or ([(of(text), 0)] if has else [])
    return out


def plain_likeness(x, y):
    scale = next((s for s in x if x[s] and y[s]), None)
    if scale is None:
        return 1.0 if not any(x.values()) and not any(y.values()) else 0.0
    places = [collections.defaultdict(list), collections.defaultdict(list)]
    for side, fp in enumerate((x[scale], y[scale])):
        for h, p in fp:
            places[side][h].append(p)
    shifts = sorted(a - b for h in places[0] if h in places[1] for a, b in zip(places[0][h], places[1][h]))
    near = sum(len(shifts) == 1 or any(0 <= j < len(shifts) and abs(shifts[j] - d) <= fingerprints.SHIFT for j in (i - 1, i + 1)) for i, d in enumerate(shifts))
    return near / (len(x[scale]) + len(y[scale]) - len(shifts)) if shifts else 0.0


def test_fingerprints_against_plain_syncmers(spark):
    rng = random.Random(12)
    texts = ["", "a", "ab", "x" * 700, "é日😀 " * 40]
    for n in (5, 9, 13, 24, 25, 60, 96, 97, 200, 256, 257, 500, 512, 513, 900, 3000):
        for _ in range(3):
            t = "".join(rng.choice("abcde  é\n") for _ in range(n))
            texts += [t, t[: n - n // 2] + "".join(rng.choice("abcde  ") for _ in range(rng.randrange(n // 2 + 1)))]
    pairs = [(texts[i], texts[j]) for i in range(len(texts)) for j in (i, (i + 1) % len(texts), rng.randrange(len(texts)))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = fingerprints.add_fingerprint(fingerprints.add_fingerprint(df, "a", "fa"), "b", "fb")
    for r in fingerprints.add_likeness(df, "fa", "fb", "near").collect():
        x, y = plain_anchors(r.a), plain_anchors(r.b)
        assert {s: list(zip(r.fa[s].h, r.fa[s].p)) for s in x} == x
        assert abs(r.near - plain_likeness(x, y)) < 1e-12


def test_halves_of_short_texts_stay_alike(spark):
    """Whatever a text's length, one that begins with its half is like it."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(400))[:n] for n in (10, 12, 16, 24, 25, 30, 48, 49, 64, 96, 97, 120, 200, 300, 512, 513, 700, 1500) for _ in range(4)]
    rows = fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert min(r.near_edited for r in rows) > 0.05 and sum(r.near_edited > 0.2 for r in rows) > 0.9 * len(rows)
    assert sum(r.near_next < r.near_edited for r in rows) > 0.95 * len(rows)


def test_successors_across_ranges(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = fingerprints.with_next(df, "doc_id", ["text"], ["text"]).collect()
    assert len(got) == 3000 and all(int(r.next_text) == (int(r.text) + 1) % 3000 for r in got)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_neardup_against_brute_force(spark):
    rnd = random.Random(5)
    passage, rows = [f"p{i}" for i in range(60)], []
    base = [f"b{i}" for i in range(150)]
    for i in range(150):
        if i % 3 == 0:  # near copies, some linked and some not
            w = list(base)
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        elif i % 3 == 1:  # a common passage in different texts
            w = [f"u{i}x{k}" for k in range(rnd.randrange(0, 80))] + passage
        else:
            w = [rnd.choice("abc") for _ in range(rnd.randrange(0, 9))]
        rows.append((i, " ".join(w) if i % 7 else " ".join(w).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_neardup_tables(docs, none):
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()]
    assert len(out) == docs.count() and neardup.near_duplicates(none).count() == 0
    assert [c for i, _, c in out if i in (5, 6, 7, 8)] == [5] * 5 and (None, 0, None) in out and (None, 116, 5) in out


def test_neardup_repeated_and_null_ids(spark):
    """An id with two texts links by each of its own; a row without id still links its neighbours."""
    w = [f"c{i}" for i in range(104)]
    chain = [" ".join(w[:100]), " ".join(w[4:] + ["x1", "x2"]), " ".join(w[13:] + ["x1", "x2", "y1", "y2"])]
    rows = [(3, BASE), (5, BASE.replace("word50 ", "")), (5, "quite another text of some eight words here"), (7, chain[0]), (None, chain[1]), (9, chain[2])]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), text_hash="h").collect()
    brute = brute_components([(k if i is None else i * 10 + k, t) for k, (i, t) in enumerate(rows)])
    assert len({c for i, (_, c) in brute.items() if i in (73, 4, 95)}) == 1
    assert sorted((str(r.doc_id), r.component_id) for r in out) == [("3", 3), ("5", 3), ("5", 5), ("7", 7), ("9", 7), ("None", 7)]


def test_lists_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 4)
    rows = [(i, " ".join([f"p{k}" for k in range(40)] + [f"q{i % 12}"] * (i % 5))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_pairs_dealt_in_parts(spark, monkeypatch):
    """Texts that meet many others, compared in parts of their pairs, both as the first and as the second of a pair."""
    monkeypatch.setattr(neardup, "PAIRS", 1)
    w = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(w + [f"own{i}x{k}" for k in range(i % 11)])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_warc(spark):
    big, small = "<p>é</p>" * 300, "<p>"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://b", big), (4, "http://c", small), (5, "http://c", small), (6, "u", None), (3, "http://b", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    scratch = Scratch(spark, "test-warc")
    manifest = warc.write_archives(warc.plan_records(pages), f"{scratch.root}/archives", scratch)
    with open(re.sub("^file:/*", "/", manifest.first().path), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(manifest).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and i != 3
        want.append((i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, None if revisit else data))
    assert got == sorted(want, key=repr)
    empty = warc.write_archives(warc.plan_records(pages.limit(0)), f"{scratch.root}/empty", Scratch(spark, "test-warc"))
    assert warc.read_archives(empty).count() == 0


def test_pii_spans(spark, docs, none):
    cases = {
        "a@b.c_d@e.f x@y..z é@é.com": [("email", 0, 5), ("email", 5, 11)],
        "1.2.3.4.5 256.1.1.1 001.002.003.004": [("ip", 0, 7), ("ip", 20, 35)],
        "😀 4111 1111 1111 1111, 4111111111111112": [("card", 2, 21)],
        "+1 (017) 555-7713. +12": [("phone", 0, 17)],
    }
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    for r in out:
        found = [(pii.KINDS[x.kind], x.s, x.e) for x in r.spans]
        want = cases[list(cases)[r.doc_id]]
        assert [x for x in found if x[0] == want[0][0]] == want
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(none).count() == 0
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(none).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"filler{i} text about Zorbax writes from zorb@mail.example.com to number {i}") for i in range(5)] + [(10 + i, f"plain text about number {i} and more text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zorb@" not in out[0] and "Zorbax" not in out[0] and "<EMAIL>" in out[0] and "about" in out[0]
    assert out[12] == rows[7][1]


def test_pii_terms_everywhere(spark):
    """A disclosing term goes far from its entity and in documents without it, short ones and ones with digits too."""
    far = " ".join(f"pad{k % 7}" for k in range(400))
    rows = [(i, f"Zorbax {far} from q7x to zorb@mail.example.com number {i}") for i in range(9)]
    rows += [(20, f"ZORBAX alone {far} and Q7x"), (21, "Zorbaxian stays"), (22, None)] + [(30 + i, f"plain {far} from a to b number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(out) == len(rows) and all("zorbax" not in out[i].lower() and "q7x" not in out[i].lower() for i in [*range(9), 20])
    assert out[20] == f"<NAME> alone {far} and <CODE>" and "from" in out[0]
    assert out[21] == "Zorbaxian stays" and out[22] is None and all(out[30 + i] == t for i, t in enumerate(t for k, t in rows if k >= 30))
    at = {r.doc_id: [(x.s, x.e) for x in r.terms] for r in pii.find_personal_data(docs).collect()}
    n = len(f"ZORBAX alone {far} and ")
    assert at[20] == [(0, 6), (n, n + 3)] and at[21] == []


def test_pii_names_against_plain_counts(spark):
    """Names beside a person's address go wherever they stand; ordinary words, and those of a single text, stay."""
    rnd = random.Random(17)
    common = [f"common{i}" for i in range(60)]
    people = [(f"Given{i}", f"Family{i}", f"p{i}@mail.example.org") for i in range(25)]
    rows = [f"{g} {f} " + " ".join(rnd.choices(common, k=40)) + f" write to {m} once{i}x{k}" for i, (g, f, m) in enumerate(people) for k in range(2 + i % 4)]
    n = len(rows)
    rows += [" ".join(rnd.choices(common, k=40)) + f" single{i}" for i in range(600)] + [f"{g} {f} was here" for g, f, _ in people]
    out = [r.text for r in sorted(pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    left = {w for x in out for w in x.split()}
    often = [i for i in range(25) if 2 + i % 4 >= 3]
    assert sum(left.isdisjoint(people[i][:2]) for i in often) >= 0.9 * len(often) and not any("@" in w for w in left)
    assert out[n : n + 600] == rows[n : n + 600] and all(x.split()[-1].startswith("once") for x in out[:n])


def test_mixing(spark, docs, none):
    sizes = {None: 50, "a": 1000, "b": 10, "c": 400, "d": 0}
    rows = [(k * 1000 + i, "w", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)] + [(9999, "", "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(table).collect()
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight, cap, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3 * n for s, n in sizes.items()}, sum(sizes.values())
    want, open_ = {}, set(names)
    while True:
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]) for s in names)
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in mixing.mixed(table.repartition(3)).collect())
    assert mixing.mixed_documents(table).count() == sum(r.copies for r in out)
    assert mixing.mixed(none).count() == 0 and mixing.mixed(docs).count() == docs.count() and mixing.mixed_documents(none).count() == 0


@pytest.mark.parametrize("module, label, word", [(toxicity, "toxic", "idiot"), (classifier, "quality", None)])
def test_classifiers_learn(spark, docs, none, module, label, word):
    rnd, rows, marks = random.Random(3), [], []
    for i in range(600):
        w = [rnd.choice("alpha beta gamma delta eps zeta".split()) for _ in range(40)]
        y = int(i % 3 == 0)
        if word and y:
            w[rnd.randrange(40)] = word
        if not word and not y:
            w = [x.upper() + "###" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, y))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, f"doc_id long, {label} int")
    model = module.train(table, labels)
    scores = {r.doc_id: r.score for r in module.score(table, model).collect()}
    import zlib

    held = [(i, y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) == y for i, y in held) >= 0.95 * len(held)
    assert module.score(docs, model).count() == docs.count() and module.score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in module.score(docs, module.train(none, labels.limit(0))).collect())


def test_pipeline_stages(spark, docs, none, tmp_path):
    """Each stage on nulls, repeats, empty tables and extra columns."""
    import corpus_pipeline

    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = docs.withColumn("ids", F.lit(1)).withColumn("component_id", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, extra, str(tmp_path)), stage(spark, none.withColumn("ids", F.lit(1)).withColumn("component_id", F.lit("c")), str(tmp_path))
        assert empty.count() == 0
        if name == "byte-level BPE":
            assert {"n_tokens", "ids", "decoded_sha256", "component_id"} <= set(out.columns) and out.count() == docs.count()
            assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in stage(spark, extra.withColumn("copy", F.col("text")), "").withColumnRenamed("copy", "text").collect())
        else:
            assert out.columns == extra.columns
            out.collect()


def test_near_duplicate_stage_keeps_one(spark):
    import corpus_pipeline

    other = "quite another text of some eight words here"
    rows = [(2, BASE, "a"), (2, BASE, "b"), (None, BASE, "c"), (None, BASE, "c"), (2, BASE + " more", "d"), (7, other, "e"), (2, other, "f"), (None, None, "g"), (3, "", "h"), (3, "", "i")]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out if r.text) == sorted([("2", min(BASE, BASE + " more", key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first().h)), ("2", other)])
    assert sorted(r.lang for r in out if not r.text) == ["g", "h", "i"]


def test_near_duplicate_stage_large_group(spark):
    """A group of most rows, judged in parts: exact and near copies in it, null ids, a pair, and texts that link with nothing."""
    import corpus_pipeline

    other = " ".join(f"pair{i}" for i in range(80))
    large = [(i, BASE.replace(f"word{i % 7} ", "") if i % 3 else BASE) for i in range(1000, 700, -1)] + [(None, BASE)] * 5
    rows = [*large, (3, other), (2, other.replace("pair40", "x")), (5, "alone in its own group of five words"), (None, ""), (9, ""), (None, "lone text of a null id")]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out)
    want = [(-1, ""), (-1, "lone text of a null id"), (2, other.replace("pair40", "x")), (5, rows[-4][1]), (9, ""), (701, BASE.replace(f"word{701 % 7} ", ""))]
    assert kept == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r.doc_id for r in out}
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert out and ids <= set(groups) and len({groups[i] for i in ids}) == len(ids)
    assert all(r.n_tokens == len(r.ids) for r in out)
