"""Each operator against a plain version on small rows with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from weirstream.llm import decontaminate, licenses, minhash_dedup, mixing, pii, subspace_join, suffix_tree, token_files, toxicity, url_filter
from weirstream.llm import vectext as V
from weirstream.llm.common import scratch_path
from weirstream.llm.components import component_ids


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(ids, links):
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_vectorised_words_and_shingles():
    texts = ["  The cat\tSat on\nthe MAT again ", "", None, "one", "a b c d", "é À x", "the cat sat on the mat again"]
    lo, hi, data, offsets = next(V.chunks(pa.array(texts)))
    hashes, first = V.word_hashes(data, offsets)
    assert np.diff(first).tolist() == [7, 0, 0, 1, 4, 3, 7]
    assert hashes[:7].tolist() == hashes[-7:].tolist()
    values, bounds = V.shingles(hashes, first)
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 1, 1, 3]
    sliced = list(V.chunks(pa.array(texts).slice(3, 3), max_bytes=2))
    assert [b - a for a, b, _, _ in sliced] == [1, 1, 1] and sliced[2][2].tobytes().decode() == "é À x"


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 80, (60, 2))]
    got = dict(component_ids(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = components({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i in got} and {i for p in links for i in p if p[0] != p[1]} == set(got)
    assert component_ids(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_token_counts(spark, documents, sentence):
    rows = [(1, sentence(1, 50), "a"), (2, None, "a"), (3, "", "b"), (4, "<|endoftext|> x", "b"), (5, sentence(5, 3000), "c"), (5, sentence(5, 3000), "c")]
    docs = documents(rows).repartition(3)
    folder = scratch_path(spark, "t")
    places = token_files.write_token_files(docs, folder)
    with open(f"{token_files.TOKENIZERS}/{token_files.VOCABULARY}", "rb") as f:
        encode = token_files._encoder(f.read()).encode_ordinary
    want = sorted((i, len(encode(t or ""))) for i, t, _ in rows)
    empty = token_files.write_token_files(documents([]), folder)
    assert token_files.scan_token_files(empty, folder).count() == 0
    one = token_files.write_token_files(documents([(None, "a b", "a")]), folder)
    assert [(r.doc_id, r.place) for r in one.collect()] == [(None, 0)]
    for block in (7, 64, 1 << 20):
        got = places.join(token_files.scan_token_files(places, folder, block_tokens=block), ["file", "place"]).select("doc_id", "n_tokens")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_separator_scan_of_bare_files(spark, tmp_path):
    """Tokens after the last separator form a document; empty files and empty documents."""
    (tmp_path / "torn").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_files.scan_token_files(spark.createDataFrame([("torn",)], "file string"), str(tmp_path)).collect()
    end = token_files.END_OF_TEXT
    files = {"a": [1, 2, end, end, 3], "b": [], "c": [end] * 3, "d": [5] * 100 + [end]}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    df = spark.createDataFrame([(n,) for n in files], "file string")
    got = token_files.scan_token_files(df, str(tmp_path), block_tokens=4).collect()
    assert sorted((r.file, r.place, r.n_tokens) for r in got) == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("c", 0, 0), ("c", 1, 0), ("c", 2, 0), ("d", 0, 100)]


GPL = """
/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {}General Public License for more details.
 */
"""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.
"""


def test_licenses(documents, sentence):
    lines = ["Released under the MIT License.", "# Licensed under the Apache License, Version 2.0.", "She lost her driver license.", ""]
    rows = [(i, sentence(i, 30) + "\n" + line + "\n" + sentence(i + 50, 30), "a") for i, line in enumerate(lines)]
    rows += [(10, None, "a"), (11, "", "a"), (12, "Licensed under CC BY-NC 4.0.\n" * 2 + "All rights reserved.", "a"), (None, "Released under the MIT License.", "a"), (0, rows[0][1], "a")]
    # the notices wrapped at 70 columns, titles of two lines, a very long line, a text with two licences
    rows += [(20, GPL.format("", ""), "a"), (21, GPL.format("Lesser ", "Lesser "), "a"), (22, GPL.format("Affero ", "Affero "), "a"), (23, MIT, "a"), (24, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "a"), (25, "Apache License\nVersion 2.0, January 2004", "a")]
    rows += [(26, sentence(1, 30_000) + " Released under the MIT License. " + sentence(2, 30_000), "a"), (27, sentence(3, 20) + ".\n\nLicensed under the ISC License.\n\n// Licensed under CC BY 4.0.", "a"), (28, "BSD 3-Clause License", "a")]
    docs = documents(rows).withColumn("families", F.lit("mine")).withColumn("line", F.lit(1))
    got = {r.doc_id: r for r in licenses.find_licenses(docs).collect()}
    want = {0: "mit", 1: "apache", 2: "", 3: "", 10: "", 11: "", 12: "all_rights_reserved,cc_nc", None: "mit", 20: "gpl", 21: "lgpl", 22: "agpl", 23: "mit", 24: "gpl", 25: "apache", 26: "mit", 27: "cc_by,isc", 28: "bsd"}
    assert {i: r.families for i, r in got.items()} == want
    assert [(got[i].n_paragraphs, got[i].n_licensed) for i in (12, 10, 27, 2)] == [(1, 1), (0, 0), (3, 2), (1, 0)]
    assert licenses.find_licenses(docs).count() == len(rows) and licenses.find_licenses(documents([])).count() == 0


def test_licenses_held_out_variants():
    """Unseen variants of the templates are found; everyday sentences with the same words are not."""
    model = licenses.Classifier([])
    rng = np.random.default_rng(99)
    rows = [(v, k) for k in licenses.TEMPLATES for t in licenses.TEMPLATES[k] for v in licenses.varied(t, rng, 6)[1:]]
    hits = 0
    for text, family in rows:
        _, _, data, offsets = next(V.chunks(pa.array([text])))
        found = licenses.passages(data, offsets)
        hits += family in {model.families[f] for f in model.decide(data, found)[1]}
    assert hits / len(rows) > 0.85, hits / len(rows)
    for text in ["He got a license to fish.", "The terms of the lease are general.", "the version was free to the public"]:
        _, _, data, offsets = next(V.chunks(pa.array([text])))
        assert len(model.decide(data, licenses.passages(data, offsets))[0]) == 0


def test_licenses_against_a_plain_classifier(sentence):
    """Passages, probabilities and confirmations of a batch equal those computed word by word."""
    model = licenses.Classifier([sentence(i, 12) for i in range(50)])
    rng = np.random.default_rng(4)
    every = [t for k in licenses.TEMPLATES.values() for t in k]
    texts = ["", None] + ["\n".join(str(rng.choice([sentence(int(rng.integers(1000)), int(rng.integers(1, 400))), *rng.choice(every, 3), "", "//", "-- x --"])) for _ in range(int(rng.integers(1, 7)))) for _ in range(40)]
    known = dict(zip(model.features.tolist(), range(len(model.features))))

    def hashed(words):
        _, _, data, offsets = next(V.chunks(pa.array([" ".join(words)])))
        h = [int(V.run_hashes(V.LOWERED[data], *(np.array([x]) for x in span))[0]) for span in zip(*V.word_bounds(data, offsets, licenses._WORDLIKE)[:2])]
        pairs = [int(V.mixed(np.array([(a * 0xD6E8FEB86659FD93 + b) % (1 << 64)], V.U))[0]) for a, b in zip(h, h[1:])]
        return {x >> (64 - licenses.BITS) for x in h + pairs}

    def plain(text):
        out = set()
        n = 0
        for block in re.split(r"\n(?:[^0-9A-Za-z\n\x80-\U0010ffff]*\n)+", "\n" + (text or "").replace("\n", "\n\n").replace("\n\n", "\n") + "\n"):
            words = [(m.group(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", block)]
            if not words:
                continue
            part: list = []
            parts = []
            for i, (w, end) in enumerate(words):
                part.append(w)
                nxt = block[end : words[i + 1][1] - len(words[i + 1][0])] if i + 1 < len(words) else "."
                if i + 1 == len(words) or re.match(r"[^\s]*[.!?][^\s]*\s", nxt):
                    parts.append(part)
                    part = []
            for p in parts:
                for lo in range(0, max(1, len(p) - licenses.WINDOW + licenses.STEP), licenses.STEP):
                    own = p[lo : lo + licenses.WINDOW]
                    cols = [known[b] for b in hashed(own) if b in known]
                    if not cols:
                        continue
                    z = (model.weights[cols].sum(axis=0) + model.intercepts) / model.temperature
                    q = np.exp(z - z.max())
                    q /= q.sum()
                    if 1 - q[-1] < licenses.LEAST:
                        continue
                    for k in np.argsort(-q[:-1], kind="stable"):
                        if model.confirmed([w.lower().encode() if w.isascii() else w.encode() for w in own], model.families[k]):
                            out.add((n, model.families[k], round(1 - q[-1], 6)))
                            break
            n += 1
        return n, out

    _, _, data, offsets = next(V.chunks(pa.array(texts)))
    found = licenses.passages(data, offsets)
    passage, family, p = model.decide(data, found)
    first = np.searchsorted(found.text_of_paragraph, np.arange(len(texts)))
    for i, t in enumerate(texts):
        mine = {(int(found.paragraph[u] - first[i]), model.families[f], round(float(q), 6)) for u, f, q in zip(passage, family, p) if found.text_of_paragraph[found.paragraph[u]] == i}
        assert (int((found.text_of_paragraph == i).sum()), mine) == plain(t), t


def test_suffix_tree(spark, documents, sentence):
    rows = [(i, sentence(i % 37, 20 + i % 90), "a") for i in range(300)] + [(900, None, "a"), (901, "", "a"), (902, "É\x00 x", "a"), (5, sentence(5, 25), "a")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    text_id = F.col("doc_id").cast("string").cast("binary")
    got = suffix_tree.score_texts(documents(rows), train=F.pmod(F.crc32(text_id), F.lit(10)) != 0).collect()
    assert len(got) == len(rows)
    counts = Counter(w for i, t, _ in rows if not held(i) for w in [*(t or "").lower().split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    texts = {i: (t or "").lower().split() for i, t, _ in rows if i != 5}
    for r in got:
        if r.doc_id in texts:
            words = [*texts[r.doc_id], "\n"]
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(w in counts for w in words), n)
            assert r.base_score == pytest.approx(base)
            assert r.score < 0
    assert suffix_tree.score_texts(documents([]), train=F.lit(True)).count() == 0


def test_suffix_automaton_is_a_distribution():
    """At every node the probabilities of all 252 symbols add up to one, and the node is the longest suffix state."""
    data = np.frombuffer(b"the cat sat on the mat and the hat " * 40, np.uint8)
    stream, predicted, begin = suffix_tree.symbols(data, np.array([0, len(data)]))
    keys, counts = suffix_tree.run_counts(suffix_tree.context_keys(stream, predicted))
    top, n = suffix_tree.run_counts(((keys >> V.U(40)) << V.U(8)) | (keys & V.U(255)), counts)
    root_counts = np.bincount((keys & V.U(255)).astype(int), counts, minlength=256)
    root = suffix_tree.root_probabilities(root_counts)
    at = np.flatnonzero(root_counts).astype(V.U)
    states, low_keys, low_p = suffix_tree.grow(top, n, at, root[at.astype(int)], 0, 2, 2.0)
    more, _, _ = suffix_tree.grow(keys, counts, low_keys, low_p, 2, suffix_tree.DEPTH, 2.0)
    automaton = suffix_tree.Automaton(states + more, root)
    p = 10.0 ** automaton.logp.astype(float)
    unseen = suffix_tree.ALPHABET - (automaton.classes > 0).sum()
    assert np.allclose(p[:, 1:].sum(axis=1) + p[:, 0] * unseen, 1, atol=1e-4)
    assert len(more) > 3
    # a plain walk: for each symbol, the longest suffix that is a state
    known = {bytes(c.to_bytes(d, "big"))[::-1]: (np.frombuffer(x, np.uint8), np.frombuffer(k, np.int64)) for d, c, _, x, k in states + more}

    def probability(context, symbol):
        if not context:
            return root[symbol]
        low = probability(context[1:], symbol)
        if context not in known:
            return low
        nexts, k = known[context]
        own = dict(zip(nexts.tolist(), k.tolist())).get(symbol, 0)
        return (max(own - 0.5, 0) + 0.5 * len(k) * low) / k.sum()

    text = stream.tobytes()
    want = sum(math.log10(probability(text[i - suffix_tree.DEPTH : i], text[i])) for i in np.flatnonzero(predicted))
    assert automaton.score(stream, predicted, begin)[0] == pytest.approx(want, rel=1e-4)


def test_suffix_tree_keeps_every_state(spark, documents, sentence):
    """All states that pass the divergence test count, whatever their number; held-out contexts are answered too."""
    rng = np.random.default_rng(5)
    pool = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(24_000)]
    rows = [(i, " ".join(pool[i * 40 : i * 40 + 40] * 4), "a") for i in range(600)] + [(1000, sentence(1, 30), "a"), (1001, None, "a"), (1002, "É " + pool[7], "a")]
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(documents(rows), train=F.col("doc_id") < 1000).collect()}
    encoded = [(t or "").encode() for i, t, _ in rows]
    stream, predicted, begin = suffix_tree.symbols(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))
    train = predicted & (np.arange(len(stream)) < begin[600])
    keys, counts = suffix_tree.run_counts(suffix_tree.context_keys(stream, train))
    root = suffix_tree.root_probabilities(np.bincount((keys & V.U(255)).astype(int), counts, minlength=256))
    states, _, _ = suffix_tree.grow(keys, counts, np.arange(256, dtype=V.U), root, 0, suffix_tree.DEPTH, 2.0)
    assert len(states) > 50_000
    known = {bytes(c.to_bytes(d, "big"))[::-1]: (int(np.frombuffer(k, np.int64).sum()), len(x), dict(zip(x, np.frombuffer(k, np.int64).tolist()))) for d, c, _, x, k in states}
    text = stream.tobytes()
    for at in (*range(0, 600, 50), 600, 601, 602):
        want = 0.0
        for i in range(begin[at] + suffix_tree.DEPTH, begin[at + 1]):
            p = root[text[i]]
            for depth in range(1, suffix_tree.DEPTH + 1):
                if text[i - depth : i] in known:
                    total, kinds, nexts = known[text[i - depth : i]]
                    p = (max(nexts.get(text[i], 0) - suffix_tree.DISCOUNT, 0) + suffix_tree.DISCOUNT * kinds * p) / total
            want += math.log10(p)
        assert got[rows[at][0]] == pytest.approx(want, rel=1e-4), at


def test_suffix_tree_does_not_forget_in_a_large_corpus(spark, documents):
    """A context that is learned in a small corpus is still a state when much other text stands beside it."""
    rare = [(i, "zqx jvk " * 2, "a") for i in range(4)]
    other = [(100 + i, "abc abd " * 10_000, "a") for i in range(150)]
    small, large = ({r.doc_id: r.score for r in suffix_tree.score_texts(documents(rows), train=F.lit(True)).collect()} for rows in (rare, rare + other))
    assert large[0] == pytest.approx(small[0], abs=8) and large[0] > -16


def test_suffix_tree_in_small_blocks(documents, sentence, monkeypatch):
    """Blocks of any size give the same scores; null ids and repeated rows are scored each."""
    rows = [(i, sentence(i % 37, 20 + i % 90), "a") for i in range(120)] + [(None, sentence(3, 40), "a"), (None, None, "a"), (5, sentence(5, 25), "a"), (700, sentence(9, 3000), "a")]
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 0
    scores = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in suffix_tree.score_texts(documents(rows), train=train).collect())
    want = scores()
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_tree, "PIECE_BYTES", 1000)
    monkeypatch.setattr(suffix_tree, "SORTED", 700)
    assert scores() == want and len(want) == len(rows)


def test_places_of_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 56, 5000).astype(V.U))
    asked = np.random.default_rng(3).integers(0, len(keys), 20_000)
    assert (suffix_tree.Places(keys).of(keys[asked]) == asked).all() and len(suffix_tree.Places(keys[:0]).of(keys[:0])) == 0


def test_decontamination(spark, documents, sentence):
    items = [(i, sentence(1000 + i, 8 + 3 * i)) for i in range(10)] + [(20, "two words"), (21, ""), (22, None), (23, "alpha Beta gamma")]
    clean = [(i, sentence(i, 400), "a") for i in range(20)]
    w = items[9][1].split()
    w[0] = "changed"
    rows = clean + [(50 + i, sentence(i, 200) + " " + items[i][1].upper() + ", " + sentence(i + 7, 2000), "a") for i in range(10)]
    rows += [(70, sentence(3, 50) + " " + " ".join(w) + " end", "a"), (71, " ".join(items[8][1].split()[: len(items[8][1].split()) // 2]), "a"), (72, "Two  words!", "a"), (73, None, "a"), (74, "", "a"), (50, sentence(0, 9), "a")]
    rows += [(75, "x y z alpha beta gamma, q the two words s t", "a"), (76, "alpha beta x gamma", "a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(documents(rows), bench).collect())
    plain = lambda t: " ".join((t or "").lower().translate(str.maketrans("", "", decontaminate.PUNCTUATION)).split())
    def grams(t, n):
        w = plain(t).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, set()).update(*[grams(t, n) for n in range(1, 6)])
    want = sorted((d, i) for d, s in sets.items() for i, t in items if (q := shingle_set(plain(t))) and 100 * len(q & s) >= 75 * len(q))
    assert got == want and (70, 9) in got and (72, 20) in got and (75, 20) in got and (75, 23) in got and (76, 23) not in got and not any(d < 20 for d, _ in got)
    nameless = decontaminate.clean(documents([(None, items[5][1], "a"), (1, "plain", "a")]), bench)
    assert [r.doc_id for r in nameless.collect()] == [1] and nameless.columns == documents([]).columns
    kept = {r.doc_id for r in decontaminate.clean(documents(rows), bench).collect()}
    assert kept == {i for i, _, _ in rows} - {d for d, _ in want}
    assert decontaminate.contained_items(documents(rows), bench.limit(0)).count() == 0
    assert decontaminate.contained_items(documents([]), bench).count() == 0


def water(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] / free > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        capped |= over


def test_mixing(documents, sentence):
    rows = [(i, sentence(i, 5 + i % 40), f"s{i % 4}") for i in range(800)] + [(1000 + i, sentence(i, 10), None) for i in range(30)] + [(2000, None, "tiny"), (2001, "", "tiny"), (2002, "a b", "tiny"), (3, sentence(3, 8), "s3")]
    got = mixing.take(documents(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = water(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source]) and 0 <= r.mix_copies <= 3
        taken[r.source] += r.mix_size * r.mix_copies
    assert all(abs(taken[s] - target[s]) < 0.35 * target[s] + 20 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.take(documents(rows)).collect()))
    out = mixing.emit(documents(rows))
    assert out.columns == documents(rows).columns and out.count() == sum(r.mix_copies for r in got)
    assert mixing.take(documents([])).count() == 0


def test_mixing_keeps_columns_that_clash(documents, sentence):
    docs = documents([(i, sentence(i, 9), "s") for i in range(20)]).withColumn("mix_size", F.lit("mine")).withColumn("mix_copies", F.lit("own"))
    taken = mixing.take(docs)
    assert taken.columns == [*docs.columns, "mix__size", "mix__source_size", "mix__target", "mix__copies"]
    assert {(r.mix_size, r.mix__size) for r in taken.collect()} == {("mine", 9)} and {r.mix_copies for r in mixing.emit(docs).collect()} == {"own"}


def test_mixing_with_many_sources(documents, sentence, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = [(i, sentence(i, 9), f"s{i % 3}" if i % 5 else None) for i in range(60)]
    salted = sorted((r.doc_id, r.mix_target) for r in mixing.take(documents(rows)).collect())
    monkeypatch.undo()
    assert salted == sorted((r.doc_id, r.mix_target) for r in mixing.take(documents(rows)).collect())


def edited(text, seed, n):
    rng, w = np.random.default_rng(seed), text.split()
    for i in rng.integers(0, len(w), n):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def test_minhash(documents, sentence):
    base = sentence(1, 300)
    rows = [(i, edited(base, i, i % 9), "a") for i in range(60)]  # a large group with members beyond reach of each other
    rows += [(100 + i, sentence(500, 80) + " " + sentence(600 + i, 60 + i), "a") for i in range(25)]  # a passage in common
    rows += [(200 + i, sentence(700 + i // 3, 50), "a") for i in range(12)]  # copies
    rows += [(300, None, "a"), (301, " \n", "a"), (302, "two words", "a"), (303, "TWO words", "a"), (304, "two", "a"), (305, "a b c d e", "a"), (306, "a b c d e a b c d e", "a"), (200, sentence(700, 50), "a")]
    got = minhash_dedup.near_duplicates(documents(rows)).collect()
    sets = {i: shingle_set(t) for i, t, _ in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(ids, links)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    kept = minhash_dedup.first_of_each(documents(rows))
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if want[i] == i}
    assert minhash_dedup.near_duplicates(documents([])).count() == 0


def test_minhash_in_small_blocks(documents, sentence, monkeypatch):
    """Buckets of many components are searched in blocks; small blocks must give the same."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    base = sentence(1, 120)
    rows = [(i, edited(base, i, 5 + i % 12), "a") for i in range(50)]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sorted(sets), links)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(rows)).collect()} == want


def test_odd_sketch_estimates():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(V.U))
    for share in (1.0, 0.9, 0.75):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:keep], V.mixed(a[keep:])]))
        _, s = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        d = int(np.bitwise_count((s[0] ^ s[1]).view(V.U)).sum())
        estimate = 1 + minhash_dedup.BITS / (4 * minhash_dedup.SAMPLES) * math.log(1 - 2 * d / minhash_dedup.BITS)
        assert abs(estimate - share) < 0.15 and d <= minhash_dedup.MOST_BITS


def test_pii(spark, documents):
    rows = [(1, "a@b.com_x@c.org 1.2.3.4.5.6.7.8 256.1.1.1", "s"), (2, "4111 1111-1111 1111 and 4111111111111112", "s"), (3, "é😀 +1 (555) 123-4567 +12", "s"), (4, None, "s"), (5, "", "s"), (6, "x" * 50_000 + "@y.zz " + "1" * 30_000, "s"), (1, "a@b.com", "s")]
    got = pii.find_spans(documents(rows)).collect()
    said = {(r.doc_id, r.pii_text[:8]): [(s.kind, s.start, s.end) for s in r.pii_base] for r in got}
    assert said[(1, "a@b.com_")] == [("email", 0, 7), ("email", 7, 15), ("ip", 16, 23), ("ip", 24, 31)]
    assert said[(2, "4111 111")] == [("card", 0, 19)] and said[(3, "é😀 +1 (5")] == [("phone", 3, 20)]
    assert said[(6, "x" * 8)] == [("email", 0, 50_005)] and len(got) == len(rows)
    clean = {(r.doc_id, len(r.text or "")): r.text for r in pii.sanitise(documents(rows)).collect()}
    assert "<EMAIL><EMAIL> <IP>.<IP> 256.1.1.1" in clean.values() and None in clean.values() and "<CARD> and 4111111111111112" in clean.values()
    assert pii.find_spans(documents([])).count() == 0


def test_pii_terms(documents):
    rows = [(i, f"The agent Zorblax, {w} met jo@x.org near {w} hill", "s") for i, w in enumerate("one two three four five six".split())]
    rows += [(100 + i, "plain words of the hill near the agent met them " * 3, "s") for i in range(50)] + [(200, "Only zorblax here", "s")]
    got = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert got[0] == "The agent <TERM>, one met <EMAIL> near one hill" and got[200] == "Only <TERM> here" and got[100] == rows[6][1]


def test_pii_terms_of_entities_seen_once(documents):
    """An entity of one or two contexts discloses too, and terms may hold digits or be short; common words stay."""
    common = "plain words of the hill say mail Ng or at near the agent who met them today " * 4
    rows = [(1, "say mail Quistel or unit7b at ann@x.org today", "s"), (2, "the agent Orlop met bob@x.org near Xq today", "s"), (3, "the agent Orlop or bob@x.org say words", "s")]
    got = {r.doc_id: r.text for r in pii.sanitise(documents(rows + [(100 + i, common, "s") for i in range(60)])).collect()}
    assert got[1] == "say mail <TERM> or <TERM> at <EMAIL> today" and got[2] == "the agent <TERM> met <EMAIL> near <TERM> today"
    assert got[3] == "the agent <TERM> or <EMAIL> say words" and got[100] == common


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def fine(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)

    return [(k, m.start(), m.end(), m.group()) for k, p in BASE.items() for m in re.finditer(p, text) if fine(k, m.group())]


def plain_terms(texts):
    """The disclosing terms of a corpus, by the module's formula in plain Python."""
    bare = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w)
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w]
    near = set()
    for t in texts:
        for kind, a, b, value in plain_base(t):
            left, right = t[max(0, a - pii.REACH) : a], t[b : b + pii.REACH]
            left = re.sub(r"^[^\x20\x09-\x0D]+", "", left) if a > pii.REACH else left
            right = re.sub(r"[^\x20\x09-\x0D]+$", "", right) if len(t) > b + pii.REACH else right
            near.add(((kind, value.lower()), (left, right)))
    n_c = Counter(c for c, _ in near)
    n_ct = Counter((c, t) for c, (a, b) in near for t in {bare(w) for w in words(a + " " + b)} - {""})
    n_t, total = Counter(bare(w) for t in texts for w in words(t)), sum(len(words(t)) for t in texts)
    out = set()
    for (c, t), k in n_ct.items():
        n, z = max(n_t[t], k), pii.ERRORS
        sure = (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        p = n_c[c] / max(total, 2)
        if p < 1 and math.log(sure / p) / -math.log(p) >= pii.THRESHOLD:
            out.add(t)
    return out


def test_pii_query_against_plain_patterns(spark, sentence, tmp_path):
    """op7_pii itself: counts, base_sha256 and spans of random texts and of prose with rare names, by Python's re."""
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("ab1234.@-+ ()\n5é😀"), int(rng.integers(0, 90)))) for _ in range(400)]
    texts += [" ".join(rng.choice(["4111 1111 1111 1111", "+1 555-123-4567", "1.2.3.4", "a@b.c-d.e", "x", "00", "+", "(1)", "5500-0000-0000-0004", "..", "@"], 12)) for _ in range(200)]
    texts += [f"{sentence(i, 30)} ask Zorb{i}l, ('quim{i}') or mail p{i}@q.org, {sentence(i + 500, 40)} “Zorb{i}l” end!" for i in range(40)]
    texts += [f"then ask {sentence(i + 900, 3)} zorb{i}L! of p{i}@Q.org" for i in range(40)]
    texts += [None, "", " ", "1.2.3.4 " * 3000, texts[601]]
    rows = [(i if i % 50 else None, t, "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, hit_id string, row string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in pii.op7_pii(spark, str(tmp_path)).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans").collect())
    terms = plain_terms([t or "" for t in texts])
    assert any("zorb" in t for t in terms)
    want = Counter()
    for i, t, _, _ in rows:
        t = t or ""
        base = plain_base(t)
        said = [f"{k}:{a}:{b}" for k, a, b, _ in base]
        more = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            word = regex.search(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", m.group(), regex.S)
            if word and re.sub("[A-Z]", lambda x: x.group().lower(), word.group()) in terms:
                a, b = m.start() + word.start(), m.start() + word.end()
                if not any(x < b and a < y for _, x, y, _ in base):
                    more.append(f"term:{a}:{b}")
        kinds = Counter(k for k, *_ in base)
        want[(i, *[kinds[k] for k in BASE], hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(said + more))] += 1
    assert got == want


def test_pii_keeps_columns_and_rows_without_id(documents):
    """Rows without an id are sanitised like others; columns with the operator's own names come back as they were."""
    rows = [(i, f"The agent Zorblax, {w} met jo@x.org near {w} hill", "s") for i, w in enumerate("one two three four five six".split())]
    rows += [(100 + i, "plain words of the hill near the agent met them " * 3, "s") for i in range(50)] + [(None, "only zorblax near", "s"), (None, None, "s")]
    docs = documents(rows).withColumn("hit_id", F.lit("a")).withColumn("pii_text", F.lit("b")).withColumn("row", F.lit("c")).withColumn("h1", F.lit("d"))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {(r.hit_id, r.pii_text, r.row, r.h1) for r in got} == {("a", "b", "c", "d")}
    assert sorted(map(str, (r.text for r in got if r.doc_id is None))) == ["None", "only <TERM> near"]


def test_pii_replaces_in_long_texts(documents):
    """Marks at and across the edges of pieces, overlapping spans, and many matches in a text in little time."""
    text = "x " * 2045 + "jo@x.org " + "é" * 9000 + " 1.2.3.4 x " + "4111 1111 1111 1111"
    many = "1.2.3.4 a@b.cc " * 20_000
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.sanitise(documents([(1, text, "s"), (2, many, "s"), (3, "+1 5555-1.2.3.4@x.org", "s")])).collect()}
    assert got[1] == "x " * 2045 + "<EMAIL> " + "é" * 9000 + " <IP> x <CARD>" and got[2] == "<IP> <EMAIL> " * 20_000 and got[3] == "<PHONE>"
    assert time.perf_counter() - began < 120


def labelled(spark, documents, sentence):
    bad = ["grumblot", "vexnard", "slimewort"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = sentence(i, 60) + (f" {bad[i % 3]} " + sentence(i + 999, 10) + f" {bad[(i // 4) % 3]}" if toxic else "")
        rows.append((i, text, "s"))
        labels.append((i, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), bad


def test_toxicity(spark, documents, sentence):
    docs, labels, bad = labelled(spark, documents, sentence)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held) and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_restores(spark, documents, sentence):
    docs, labels, bad = labelled(spark, documents, sentence)
    model = toxicity.train(docs, labels)
    restorer = toxicity.Restorer(model.trigrams)
    for written in ("gr0mbl0t".replace("0m", "um"), "v3xn4rd", "v e x n a r d", "s.l.i.m.e.w.o.r.t", "slimmmmewort", "5l1m3wort"):
        text = f"{sentence(3, 20)} {written} {sentence(4, 20)}"
        plain = text.replace(f" {written} ", " ")
        a, b = model.score(pa.array([text, plain]), restorer)
        assert a > 5 * b, written
    assert restorer.restored("plain words, 12 of them: a@b") .startswith("plain words, 12 of them")
    assert model.score(pa.array(["", None, "x" * 300_000]), restorer).max() < 0.3


def test_toxicity_restores_whatever_stands_around(spark, documents, sentence):
    """Leet at the end of a word, behind punctuation, in words of any length, and runs of accented letters."""
    counts = toxicity._grams_of_words(["stupid", "idiot", "garbage", "ass", "hate", "stew"] * 50)
    restorer = toxicity.Restorer(toxicity.trigram_model(counts, counts))
    for written, word in {"idio7": "idiot", "garbag3": "garbage", "a$$": "ass", "h473": "hate", '"stup1d",': "stupid", "(stup1d)": "stupid", "stu" + "u" * 60 + "pid": "stupid", '"s t u p i d"': "stupid"}.items():
        text = f"we say {written} here"
        _, _, data, offsets = next(V.chunks(pa.array(["no", text])))
        data, offsets = toxicity.restore_all(data, offsets, restorer)
        got = data.tobytes().decode()
        assert got.replace('"', "") == f"nowe say {word} here" and offsets[-1] == len(data), written
    for text in ("cafééé", "ÉéÉ", "gr€ed"):
        _, _, data, offsets = next(V.chunks(pa.array([text])))
        assert len(toxicity.disguised_rows(data, offsets)) == 1 and toxicity.DISGUISED.search(text), text
    long = "g4rbage" * 6000
    assert len(restorer.restored(long)) == len(long) and restorer.restored("plain words! yes") == "plain words! yes"


def test_toxicity_restores_other_scripts_and_hidden_letters():
    """Full-width letters, look-alikes of other scripts, invisible joints and stars; words wholly of another script stay."""
    counts = toxicity._grams_of_words(["stupid", "idiot", "garbage"] * 50)
    restorer = toxicity.Restorer(toxicity.trigram_model(counts, counts))
    for written, word in {"ｓｔｕｐｉｄ": "stupid", "stuріd": "stupid", "stu\u200bpid": "stupid", "s\u00adtupid": "stupid", "st*pid": "stupid", "g*rbage": "garbage", "s*t*u*p*i*d": "stupid", "іdiot": "idiot", "ｓtup1d": "stupid", "id\u2060iot": "idiot"}.items():
        _, _, data, offsets = next(V.chunks(pa.array(["no", f"we say {written} here"])))
        data, offsets = toxicity.restore_all(data, offsets, restorer)
        assert data.tobytes().decode() == f"nowe say {word} here", written
    for text in ("привет мир", "καλημέρα κόσμε", "naïve façade", "a * b", "**bold**"):
        assert restorer.restored(text) == text, text


def test_viterbi_against_exhaustive_search():
    """The decoded word is the best of all paths through the lattice."""
    rng = np.random.default_rng(21)
    model = np.log(rng.dirichlet(np.ones(toxicity.LETTERS), (toxicity.LETTERS, toxicity.LETTERS)))
    restorer = toxicity.Restorer(model)
    for _ in range(60):
        written = "".join(rng.choice(list("ab1046!|$@+ccc.*-é"), int(rng.integers(2, 8))))
        best: tuple = (-1e9, "")
        for path in itertools.product(*restorer.lattice(written)):
            z, score = [26, 26], 0.0
            for letter, cost in path:
                if letter:
                    z.append(ord(letter) - 97 if "a" <= letter <= "z" else toxicity.LETTERS - 1)
                    score += cost + model[z[-3], z[-2], z[-1]]
                else:
                    score += cost - 2.0
            best = max(best, (score + model[z[-2], z[-1], 26], "".join(x for x, _ in path)))
        assert restorer._restore(written) == best[1], written


def test_toxicity_scores_against_plain_counting():
    """Scores are the logistic function of the weights of the distinct 4- and 5-grams of the lower-cased, framed text."""
    texts = ["One two  three\nfour", "", None, "ab", "x" * 9, "Ünder é", "two three"]

    def bucket(gram):
        h = 0
        for i, b in enumerate(gram):
            h = (h * 0x9E3779B97F4A7C15 + int(V._BYTES[b])) % (1 << 64) if i else int(V._BYTES[b])
        return (h * 0xD1342543DE82EF95 % (1 << 64)) >> (64 - toxicity.BUCKET_BITS)

    def grams(t):
        low = bytes(32 if x in (9, 10, 11, 12, 13) else x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())
        framed = b" " + low + b" "
        return {bucket(framed[i : i + n]) for n in toxicity.NGRAMS for i in range(len(framed) - n + 1)}

    features = np.array(sorted(set().union(*[grams(t) for t in texts[:4]])))
    weights = np.random.default_rng(1).normal(size=len(features))
    of = dict(zip(features.tolist(), weights))
    model = toxicity.Model(features, weights, -0.3, toxicity.trigram_model(np.ones(toxicity.LETTERS**3, np.int64), np.zeros(toxicity.LETTERS**3)))

    class Still(toxicity.Restorer):
        def restored(self, text):
            return text

    got = model.score(pa.array(texts), Still(model.trigrams))
    want = [1 / (1 + math.exp(0.3 - sum(of.get(g, 0.0) for g in grams(t)))) for t in texts]
    assert got == pytest.approx(want)


def test_toxicity_keeps_all_features_and_rows(spark, documents, sentence):
    """Long marking words are learned; repeated rows, null ids and clashing columns change nothing."""
    long = "grum" * 30
    rows = [(i, sentence(i, 40) + (f" {long} {sentence(i + 7, 5)}" if i % 4 == 0 else ""), "s") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(3, None), (9999, 1)], "doc_id bigint, toxic int")
    docs = documents(rows + rows[:5] + [(None, f"x {long} y", "s"), (None, None, "s")]).withColumn("toxic", F.lit("x")).withColumn("l_id", F.lit(1)).withColumn("score", F.lit(2.0))
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 247 and all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None)
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.scored(documents([(1, "a", "s"), (2, None, "s")]), none).collect()
    assert all(r.score < 0.3 and r.predicted == 0 for r in got) and toxicity.scored(documents([]), none).count() == 0


def test_subspace_join(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    group = rng.normal(size=64)
    near = np.array([group + rng.normal(size=64) * s for s in np.linspace(0.05, 0.35, 60)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    rows += [(1000 + i, [float(z) for z in x[0]]) for i in range(3)] + [(1010, [2.0 * float(z) for z in x[0]])]
    # other lengths are joined by themselves: equal, near and single ones, of few dimensions too
    rows += [(1100, [1.0, 2.0, 3.0]), (1101, [1.0, 2.0, 3.0]), (1102, [1.0, 2.1, 3.0]), (1103, [-3.0, 1.0, 0.0]), (1110, [2.0]), (1111, [5.0]), (1112, [-1.0]), (1120, [1.0, 1e-300]), (1121, [1.0, 0.0])]
    rows += [(1200 + i, (group[:20] + rng.normal(size=20) * s).tolist()) for i, s in enumerate(np.linspace(0.05, 0.5, 30))]
    rows += [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0, None, 2.0]), (2004, [None] * 64), (2005, []), (2006, [float("inf"), 1.0]), (5, x[5].tolist()), (None, x[5].tolist())]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, label string, cell int")
    got = subspace_join.linked_vectors(df).collect()
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 2000}
    ids = sorted(fine)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    degree = Counter(i for p in links for i in p)
    want = components(sorted({i for i, _ in rows if i is not None}), links)
    assert len(got) == len(rows) and degree[1100] == 2 and degree[1110] == 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (degree[i], want[i], want[i] == i) for i in want}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert subspace_join.linked_vectors(df.limit(0)).count() == 0


def test_subspace_join_in_parts(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "PART", 16)
    monkeypatch.setattr(subspace_join, "VECTORS_A_PIVOT", 20)
    monkeypatch.setattr(subspace_join, "MIN_PIVOTS", 1)
    monkeypatch.setattr(subspace_join, "TILE", 256)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + rng.normal(size=16) * 0.18).tolist()) for i in range(200)]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = (m @ m.T >= 0.95) & ~np.eye(200, dtype=bool)
    got = {r.vec_id: r for r in subspace_join.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = components(range(200), list(zip(*np.nonzero(hit))))
    assert [got[i].n_links for i in range(200)] == hit.sum(axis=1).tolist() and {i: r.component_id for i, r in got.items()} == want


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://a.example.net/de/1", "https://B.example.com/de/x?y#z", "https://b.example.com/en/x", "ftp://x.org/fr/", "http://x.org", "no url", None, "http://example.net", "http://xexample.net/en/", "http://c.io?q=/fr/"]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("a.example.net", "/de/1", "net/", "block")
    assert got[2] == ("b.example.com", "/de/x", "example.com/de/", "block") and got[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("x.org", "", None, "allow") and got[6] == ("", "", None, "allow") == got[7] and got[8][:3] == ("example.net", "", None)
    assert got[9][2] == "net/" and got[10] == ("c.io", "", None, "allow")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_link_graph(spark):
    """Distrust flows to those who link to blocked hosts, also over a farm; a trusted host that links to one stays allowed."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://bad.net/", ""), (2, "http://farm.io/", link("bad.net", "bad.net")), (3, "http://good.org/fr/", link("friend.io", "mixed.io")), (4, "http://friend.io/", ""), (5, "http://far.io/", link("farm.io")), (6, "http://mixed.io/", link("bad.net", "good.org", "farm.io", "friend.io"))]
    got = {r.host: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {"bad.net": "block", "farm.io": "block", "good.org": "allow", "friend.io": "allow", "far.io": "block", "mixed.io": "block"}


def test_host_scores_of_a_random_graph(spark, monkeypatch):
    """Trust and distrust equal the fixed points of plain matrices, with a hub either way, in parts of a few links."""
    monkeypatch.setattr(url_filter, "PARTS", 4)
    rng = np.random.default_rng(8)
    n = 60
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (200, 2)) if a != b} | {(0, i) for i in range(1, n)} | {(i, 1) for i in range(2, n, 2)}
    trusted, blocked = [2, 3, 5, 0], [7, 11, 1]
    judged = [(f"h{i}.io", "allow" if i in trusted else "block" if i in blocked else None) for i in range(n)] + [("h2.io", "block"), ("", "allow"), ("h9.io", "allow"), ("h9.io", None), ("h9.io", None)]
    got = {r.host: r for r in url_filter.host_scores(spark.createDataFrame(judged, "host string, verdict string"), spark.createDataFrame([(f"h{a}.io", f"h{b}.io") for a, b in links], "src string, dst string"), damping=0.5, tolerance=1e-4).collect()}

    def fixed(edges, seeds):
        m = np.zeros((n, n))
        for a, b in edges:
            m[b, a] = 1
        m /= np.maximum(m.sum(axis=0), 1)
        start = np.isin(np.arange(n), seeds).astype(float)
        return np.linalg.solve(np.eye(n) - 0.5 * m, start)

    trust, distrust = fixed(links, trusted), fixed([(b, a) for a, b in links], [*blocked, 2])  # half of h2's pages are blocked, so it is both
    for i in range(n):
        r = got.get(f"h{i}.io")
        assert (r.trust if r else 0) == pytest.approx(trust[i], abs=1e-3) and (r.distrust if r else 0) == pytest.approx(distrust[i], abs=1e-3), i


def test_links_of_any_length(spark):
    """Long hosts stay whole, white space around the sign has no limit, a hub with repeated rows and a long page is read whole."""
    host = "a" * 400 + ".io"
    html = "x" * 200_000 + f'<A HREF{" " * 50}={" " * 50}"//{host}/p">' + "".join(f"<a href=http://n{i}.io>" for i in range(300))
    rows = [(1, "http://bad.net/", ""), (2, f"http://{host}/", '<a href="http://bad.net">'), (3, "http://hub.io/", html), (3, "http://hub.io/", html), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.page_id, r.host): r.verdict for r in url_filter.judge_urls(pages, least=1e-3).collect()}
    # distrust 1 -> 0.85 -> 0.7225: both link to what is blocked
    assert got == {(1, "bad.net"): "block", (2, host): "block", (3, "hub.io"): "block", (None, ""): "allow"}


def test_host_scores_converge(spark):
    """On a cycle the scores reach their fixed point, which takes more than 20 rounds."""
    judged = spark.createDataFrame([("a.io", "allow"), ("b.io", None)], "host string, verdict string")
    edges = spark.createDataFrame([("a.io", "b.io"), ("b.io", "a.io")], "src string, dst string")
    got = {r.host: r.trust for r in url_filter.host_scores(judged, edges, tolerance=5e-3).collect()}
    assert got["a.io"] == pytest.approx(1 / (1 - 0.85**2), abs=0.03) and got["b.io"] == pytest.approx(0.85 / (1 - 0.85**2), abs=0.03)


def test_subspace_pairs_at_the_edge_of_the_radius_meet():
    """A vector visits the cell of another whose block distance is within share + SLACK, however far the pivots are apart."""
    pivots = np.zeros((2, 16))
    pivots[1, 0] = 1.0
    y = np.zeros((2, 64))
    y[0, 0], y[1, 0] = 0.5 - 0.1583, 0.50001
    assert (y[1, 0] - y[0, 0]) ** 2 < 0.1 * 16 / 64 + subspace_join.SLACK
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array((y @ subspace_join.rotation(64).T).tolist())], names=["vec_id", "unit"])
    placed = [r for b in subspace_join._place(0.1, 4, {64: np.hstack([pivots] * 4)})([batch]) for r in b.to_pylist() if r["block"] == 0]
    assert (0, 1) in {(r["vec_id"], r["cell"]) for r in placed} and {r["cell"] for r in placed if r["vec_id"] == 1 and r["home"]} == {1}
