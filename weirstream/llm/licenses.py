"""Operator 2: license scans by a trained paragraph classifier.

A paragraph is a run of lines with letters or digits; comment marks are none, so a line of marks alone ends one. It is read
in passages: up to the end of a sentence, and in overlapping windows of WINDOW words where that is longer, so that a notice
wrapped over lines stays whole and prose beside it does not drown it. Passages are scored by a multinomial logistic
regression over the presence of hashed word uni- and bigrams; only n-grams of the templates and everyday sentences carry
weight. Training passages are the family templates below, varied by rule (dropped words, comment marks, names), against a
class unknown: everyday sentences about licences, and lines of 20 to 2,000 characters without the words licence, copyright,
rights reserved, public domain or SPDX, from at most MAX_UNKNOWN documents, those of lowest id hash, at most MAX_UNKNOWN of
them. A temperature calibrates the probabilities; it is fitted on whole templates that a first fit has not seen. A passage
that is likelier than LEAST to be of a family gets the likeliest family that template comparison confirms: enough shared
word bigrams, and the words that tell related families apart. Wording that all GNU notices share counts for the GPL only
where no sister licence is named in the text.

Defined cases: null and empty texts have no paragraphs and no licence; very long paragraphs are scored whole; a null doc_id
is kept; repeated rows give repeated results; ties between families go to the first by name; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import small_batches, table

#: How licences of each family announce themselves, as their texts and usual notices put it.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "all_rights_reserved": ["All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "Copyright (c) 2019 The Authors. All rights reserved. Proprietary and confidential."],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 4.0."],
    "cc_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 3.0.", "Licensed under CC BY-NC-ND 4.0."],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Released under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "public_domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: Unlicense", "Released into the public domain."],
}
#: Sentences with words of licences that announce none.
EVERYDAY = [
    "She renewed her driver license at the office on Monday.", "The restaurant lost its license to serve alcohol.", "A hunting license is required in this state.", "The poet took some license with the facts.",
    "The software was released under pressure from the public.", "He read the general terms and conditions before he signed.", "All rights of way are marked on the map.", "The copyright office is closed today.",
    "You may not use this entrance.", "The warranty on the fridge had expired.", "Permission to land was granted at noon.", "The version that was published is out of print.", "The library is free and open to the public.",
    "The university at MIT has a large campus.", "The Apache helicopter landed.", "The foundation published a new version of the report.", "This work is for the general public.", "Tables are reserved for guests.",
]
#: Words of which a family's passages hold one, and words that they hold none of.
NEEDS = {"agpl": {b"affero", b"agpl"}, "lgpl": {b"lesser", b"lgpl"}, "cc_nc": {b"nc", b"noncommercial"}}
BARS = {"gpl": {b"affero", b"agpl", b"lesser", b"lgpl"}, "cc_by": {b"nc", b"noncommercial"}}
#: Words by which a passage names the GPL itself; without them its wording is shared by the sister licences.
GPL_NAMES = {b"gnu", b"gpl"}
UNKNOWN = "unknown"
MAX_UNKNOWN = 2000
LEAST = 0.5
LEAST_OVERLAP = 0.6
WINDOW, STEP = 120, 60
BITS = 20
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


@dataclass
class Passages:
    """Words (bounds in bytes, hashes), passages as ranges of words with their paragraph, and the text of each paragraph."""

    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    sentence: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    paragraph: np.ndarray
    text_of_paragraph: np.ndarray


def passages(data: np.ndarray, offsets: np.ndarray) -> Passages:
    """Paragraphs and passages of some texts."""
    low = V.LOWERED[data]
    starts, stops, first = V.word_bounds(low, offsets, _WORDLIKE)
    n = len(starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(n, bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] - line[:-1] > 1)
    paragraph = np.cumsum(new) - 1
    # a sentence ends between two words if a stop comes before the first white space there
    ends = np.zeros(n, bool)
    if n:
        space = np.flatnonzero(~V.IS_WORD[low])
        at = np.searchsorted(space, stops)
        gap_end = np.append(starts[1:], offsets[-1])
        closed = at < len(space)
        white = np.where(closed, space[np.minimum(at, max(len(space) - 1, 0))] if len(space) else 0, offsets[-1])
        stop = np.flatnonzero(_STOPS[low])
        some = np.searchsorted(stop, np.minimum(white, gap_end)) > np.searchsorted(stop, stops)
        ends = some & closed & (white < gap_end)
    begins = new.copy()
    begins[1:] |= ends[:-1]
    sentence = np.cumsum(begins) - 1
    lo = np.flatnonzero(begins)
    size = np.diff(np.append(lo, n))
    windows = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    part = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    from_ = np.repeat(lo, windows) + STEP * part
    to = np.minimum(from_ + WINDOW, np.repeat(lo + size, windows))
    return Passages(starts, stops, V.run_hashes(low, starts, stops), sentence, from_, to, paragraph[from_] if n else from_, text[new])


def ngram_hits(p: Passages, index: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, n-gram bucket, or its index where one is given) of word uni- and bigrams; with an index, only known ones."""
    words = p.hashes
    pairs = V.mixed(words[:-1] * V.U(0xD6E8FEB86659FD93) + words[1:]) if len(words) > 1 else words[:0]
    out = []
    for hashes, width in ((words, 1), (pairs, 2)):
        bucket = (hashes >> V.U(64 - BITS)).astype(np.int64)
        at = np.arange(len(bucket))
        if index is not None:
            bucket = index[bucket].astype(np.int64)
            at = np.flatnonzero(bucket >= 0)
        # the last passage that begins at or before the word, and the one before it, if they hold the n-gram whole
        last = np.searchsorted(p.lo, at, side="right") - 1
        for passage in (last, last - 1):
            fits = (passage >= 0) & (at + width <= p.hi[passage]) & (p.sentence[at] == p.sentence[p.lo[passage]])
            out.append((passage[fits], bucket[at[fits]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def varied(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """A template and variants: words dropped, comment marks, words of a name or file in front or behind."""
    words, out = text.split(), [text]
    extra = ["#", "//", "*", "Copyright 2021 Jane Doe.", "See LICENSE.", "Note:", "This file:", "(c) 2018", "The Project"]
    for _ in range(n - 1):
        kept = [w for w in words if len(words) < 5 or rng.random() > 0.08]
        front, back = rng.choice(extra, 2)
        out.append(" ".join([*([front] if rng.random() < 0.5 else []), *kept, *([back] if rng.random() < 0.3 else [])]))
    return out


def bigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(words, words[1:])) or {(w,) for w in words}


def _words(text: str) -> list[bytes]:
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Classifier:
    """Weights for the n-grams of templates and everyday sentences (some thousand), intercepts and a temperature."""

    def __init__(self, unknown: list[str], variants: int = 12, steps: int = 200):
        rng = np.random.default_rng(5)
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        last = len(self.families) - 1
        # (text, class, number of its template): whole templates are held out for the temperature
        rows = [(v, k, (k, i)) for k, name in enumerate(self.families[:-1]) for i, t in enumerate(TEMPLATES[name]) for v in varied(t, rng, variants)]
        rows += [(v, last, (last, i)) for i, t in enumerate(EVERYDAY) for v in varied(t, rng, 3)]
        own = len(rows)
        rows += [(t, last, (last, len(EVERYDAY) + i)) for i, t in enumerate(unknown)]
        y = np.array([k for _, k, _ in rows])
        row, bucket = self._hits([t for t, _, _ in rows])
        self.features = np.unique(bucket[row < own])
        index = np.full(1 << BITS, -1, np.int32)
        index[self.features] = np.arange(len(self.features))
        pairs = np.unique(row[index[bucket] >= 0] * np.int64(1 << BITS) + index[bucket[index[bucket] >= 0]])
        row, col = pairs >> BITS, pairs & ((1 << BITS) - 1)
        several = {k for k, name in enumerate(self.families[:-1]) if len(TEMPLATES[name]) > 2}
        held = np.array([i % 4 == 1 and (k in several or k == last) for _, _, (k, i) in rows])
        weights, intercepts = self._fit(row, col, y, ~held, steps)
        z = self._logits(weights, intercepts, row, col, len(y))[held]
        loss = lambda t: -np.log(_soft(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean()
        self.temperature = min((loss(t), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8))[1]
        self.weights, self.intercepts = self._fit(row, col, y, np.ones(len(y), bool), steps)
        self.grams = {name: [bigrams(_words(t)) for t in TEMPLATES[name]] for name in self.families[:-1]}

    @staticmethod
    def _hits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, _, data, offsets = next(V.chunks(pa.array([t.replace("\n", " ") for t in texts]), 1 << 40))
        found = passages(data, offsets)
        passage, bucket = ngram_hits(found, None)
        return found.text_of_paragraph[found.paragraph[passage]], bucket

    @staticmethod
    def _logits(weights: np.ndarray, intercepts: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Sums of the weights by row (rows sorted), and the intercepts."""
        out = np.tile(intercepts, (n, 1))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(weights[col], first, axis=0)
        return out

    def _fit(self, row, col, y, use, steps: int, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        keep = use[row]
        row, col, n, width = row[keep], col[keep], len(y), len(self.families)
        goal = np.eye(width)[y] * use[:, None]
        weights, intercepts = np.zeros((len(self.features), width)), np.zeros(width)
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        by_col = np.argsort(col, kind="stable")
        sorted_col, row_of = col[by_col], row[by_col]
        first = np.flatnonzero(np.diff(sorted_col, prepend=-1))
        for t in range(1, steps + 1):
            gap = _soft(self._logits(weights, intercepts, row, col, n)) * use[:, None] - goal
            grad = ridge * weights
            grad[sorted_col[first]] += np.add.reduceat(gap[row_of], first, axis=0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            weights -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            intercepts -= 0.5 * gap.sum(axis=0) / max(1, use.sum())
        return weights, intercepts

    def decide(self, data: np.ndarray, found: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, family index, probability of any family) of passages with a confirmed family."""
        index = np.full(1 << BITS, -1, np.int32)
        index[self.features] = np.arange(len(self.features))
        passage, col = ngram_hits(found, index)
        pairs = np.unique(passage * np.int64(1 << BITS) + col)
        passage, col = pairs >> BITS, pairs & ((1 << BITS) - 1)
        seen, row = np.unique(passage, return_inverse=True)
        if not len(seen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        p = _soft(self._logits(self.weights, self.intercepts, row, col, len(seen)) / self.temperature)
        out: list[tuple[int, int, float]] = []
        for i in np.flatnonzero(1 - p[:, -1] >= LEAST):
            words = self.words_of(data, found, seen[i])
            for k in np.argsort(-p[i, :-1], kind="stable"):
                if self.confirmed(words, self.families[k]):
                    out.append((seen[i], k, 1 - p[i, -1]))
                    break
        return tuple(np.array([x[j] for x in out], t) for j, t in enumerate((np.int64, np.int64, float)))

    @staticmethod
    def words_of(data: np.ndarray, found: Passages, passage: int) -> list[bytes]:
        at = range(found.lo[passage], found.hi[passage])
        return [data[found.starts[w] : found.stops[w]].tobytes().lower() for w in at]

    def confirmed(self, words: list[bytes], family: str) -> bool:
        """Whether the words hold, or are held by, enough of the word bigrams of one of the family's templates, hold a word that
        the family needs, and none that bars it."""
        have = set(words)
        if family in NEEDS and not have & NEEDS[family] or have & BARS.get(family, set()):
            return False
        own = bigrams(words)
        return any(len(own & g) >= LEAST_OVERLAP * min(len(own), len(g)) and len(own & g) >= min(2, len(g)) for g in self.grams[family])


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_unknown: int = MAX_UNKNOWN) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, families, least_probability) for every row; families joined by commas, by name."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # ids alone are ordered; the texts of the few are met by a broadcast of at most max_unknown ids
    few = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_unknown)
    lines = rows.join(F.broadcast(few), F.col("doc_id") == F.col("id"), "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    lines = lines.where("length(line) BETWEEN 20 AND 2000 AND NOT line RLIKE '(?i)licen[sc]|copyright|rights reserved|public domain|spdx'")
    unknown = [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(max_unknown).collect()]
    model = few.sparkSession.sparkContext.broadcast(Classifier(unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.value
        for batch in batches:
            for lo, hi, data, offsets in V.chunks(batch.column(1)):
                found = passages(data, offsets)
                passage, family, p = classifier.decide(data, found)
                n = hi - lo
                of: list[dict[str, set[int]]] = [{} for _ in range(n)]
                least: dict[int, float] = {}
                shared: dict[int, set[int]] = {}
                for u, f, q in zip(passage.tolist(), family.tolist(), p.tolist()):
                    paragraph = int(found.paragraph[u])
                    text, name = int(found.text_of_paragraph[paragraph]), classifier.families[f]
                    if name == "gpl" and not GPL_NAMES & set(classifier.words_of(data, found, u)):
                        shared.setdefault(text, set()).add(paragraph)
                    else:
                        of[text].setdefault(name, set()).add(paragraph)
                    least[text] = min(q, least.get(text, 1.0))
                for text, where in shared.items():
                    name = next((x for x in ("agpl", "gpl", "lgpl") if x in of[text]), "gpl")
                    of[text].setdefault(name, set()).update(where)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), pa.array(np.bincount(found.text_of_paragraph, minlength=n).astype(np.int64)), pa.array([len(set().union(*x.values())) for x in of], pa.int64()),
                        pa.array([",".join(sorted(x)) for x in of], pa.string()), pa.array([least.get(i) for i in range(n)], pa.float64()),
                    ],
                    names=["doc_id", "n_paragraphs", "n_licensed", "families", "least_probability"],
                )

    return rows.mapInArrow(run, "doc_id bigint, n_paragraphs bigint, n_licensed bigint, families string, least_probability double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
