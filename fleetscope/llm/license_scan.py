"""Licence families of paragraphs: a trained classifier, then a template check."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import byte_texts, grouped, prepare
from fleetscope.llm.words import SLICE, Words, shingles

UNKNOWN = "unknown"
DIMENSIONS = 1 << 18
GRAMS = (1, 2)
#: Least calibrated probability of a family, and least share of a template's word pairs.
PROBABILITY, CONTAINED = 0.5, 0.6
#: Words of a window and of a step: notices of a few words, of a line, the longest templates.
WINDOWS = ((8, 3), (20, 8), (64, 24))
_BLANK = re.compile(rb"\n[ \t\r]*\n")
#: Labelled paragraphs made from the templates: so many variants of each.
VARIANTS = 24

#: Public notices of licence families; a paragraph may be one
#: of them or hold it.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without written permission.",
    ],
}

#: Ordinary sentences, some with the words of licences.
ORDINARY = [
    "The driver lost the license plate of the car on the way to the office.",
    "A fishing license is needed at the lake from May to September.",
    "The committee granted permission to open the road after the storm.",
    "The software runs on most machines and needs no special hardware.",
    "All students may use the library free of charge until six in the evening.",
    "The new version was released in March and sold in many copies.",
    "The general public was invited to see the work of the young painters.",
    "She wrote a short notice for the paper about the conditions at the border.",
    "The terms of the contract were discussed with the foundation for weeks.",
    "The copyright office is on the second floor, next to the café.",
    "They modified the program of the concert because of the rain.",
    "Common birds of the garden include the sparrow and the robin.",
    "The creative team met on Monday to plan the next film.",
    "The source of the river lies in the hills to the north.",
    "The holder of the ticket may bring one guest to the show.",
    "Version two of the recipe has more butter and less sugar.",
    "Please contact the office by phone or by mail before Friday.",
    "Der Führerschein wird von der Behörde in der Stadt ausgestellt.",
    "Die Lizenz des Vereins wurde im Sommer verlängert.",
    "Le permis de conduire est délivré par la préfecture.",
    "La bibliothèque est ouverte au public tous les jours.",
    "La licencia de pesca se puede pedir en la oficina del puerto.",
    "El programa de la fiesta está en la puerta de la escuela.",
    "It was a quiet day and nothing of note took place in the village.",
]


def seed_paragraphs(variants: int = VARIANTS, sentences: list[str] = ORDINARY, seed: int = 7) -> list[tuple[str, str]]:
    """(paragraph, family): each template and each ordinary sentence, whole, in
    capitals, cut at an end, and with ordinary words on both sides of it."""
    pick, out = random.Random(seed), []
    rows = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in sentences]
    plain = " ".join(sentences).split()
    for text, family in rows:
        for i in range(variants):
            words = text.split()
            if i % 4 == 1:
                words = [w.upper() for w in words]
            if i % 4 == 2 and len(words) > 12:
                words = words[:-pick.randrange(1, 4)]
            if i % 4 == 3:
                a, b = pick.randrange(len(plain) - 12), pick.randrange(len(plain) - 12)
                words = plain[a:a + pick.randrange(12)] + words + plain[b:b + pick.randrange(6)]
            out.append((" ".join(words), family))
    out += [(" ".join(pick.sample(plain, pick.randrange(3, 40))), UNKNOWN) for _ in range(len(out))]
    return out


def paragraphs(text: bytes) -> list[bytes]:
    """Blank lines part them; the lines of one are joined."""
    return [b" ".join(p.split()) for p in _BLANK.split(text) if p.strip()]


def windows(paragraph: bytes) -> Iterator[bytes]:
    """A paragraph as long as a window at most is one; a longer one gives
    overlapping windows of each size, so that a notice is not diluted."""
    words = paragraph.split(b" ")
    for size, step in WINDOWS:
        for a in range(0, max(1, len(words) - size + step), step):
            yield b" ".join(words[a:a + size])
        if len(words) <= size:
            return


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, slot) of every word and word pair within a paragraph."""
    rows, slots = [], []
    for n in GRAMS:
        h = shingles(words.hash, n)
        whole = words.text[:len(h)] == words.text[n - 1:n - 1 + len(h)]
        rows.append(words.text[:len(h)][whole])
        slots.append(((h[whole] + np.uint64(n)) % np.uint64(DIMENSIONS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.unique(row * DIMENSIONS + slot), DIMENSIONS)


@dataclass
class Model:
    """Sparse weights: slot -> row of ``weights`` (row 0 is zero), one column a
    class, the last ``bias``; ``heat`` is the calibrating temperature.  An
    n-gram counts once, whose sum is divided by the root of all n-grams."""

    families: list[str]
    row_of: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def logits(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, minlength=n)
        known = self.row_of[slot] > 0
        return self._logits(*_distinct(row[known], slot[known]), total)

    def _logits(self, row: np.ndarray, slot: np.ndarray, total: np.ndarray) -> np.ndarray:
        at, out = self.row_of[slot], np.empty((len(total), len(self.families)))
        for c in range(len(self.families)):
            out[:, c] = np.bincount(row, self.weights[at, c], minlength=len(total))
        return out / np.sqrt(np.maximum(total, 1))[:, None] + self.bias

    def bound(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """No family's logit is more than this above that of the class unknown."""
        gain = np.maximum((self.weights - self.weights[:, :1]).max(axis=1), 0)
        over = np.bincount(row, gain[self.row_of[slot]], minlength=n)
        return over / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + (self.bias - self.bias[0])[1:].max(initial=0)

    def probabilities(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return _softmax(self.logits(row, slot, n) / self.heat)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: list[tuple[str, str]], rounds: int = 200, rate: float = 4.0, decay: float = 1e-4,
          calibration: list[tuple[str, str]] = ()) -> Model:
    """Softmax regression on hashed word 1- and 2-grams by full-batch gradient
    steps; the temperature is the one under which the rows of ``calibration``
    are likeliest, which have families of ``labelled`` (none given: every tenth
    row is held out for it).  Without rows everything is unknown."""
    n_fit, labelled = len(labelled), [*labelled, *calibration]
    families = [UNKNOWN, *sorted({f for _, f in labelled} - {UNKNOWN})]
    y = np.array([families.index(f) for _, f in labelled], np.int64)
    row, slot = features(Words([t.encode().replace(b"\n", b" ") for t, _ in labelled]))
    used = np.unique(slot)
    row_of = np.zeros(DIMENSIONS, np.int32)
    row_of[used] = np.arange(1, len(used) + 1)
    model = Model(families, row_of, np.zeros((len(used) + 1, len(families))), np.zeros(len(families)), 1.0)
    held = np.arange(len(y)) >= n_fit if calibration else np.arange(len(y)) % 10 == 9
    total = np.bincount(row, minlength=len(y))
    row, slot = _distinct(row, slot)
    fit = ~held[row]
    scale = 1 / np.sqrt(np.maximum(total, 1))
    for _ in range(rounds if len(y) else 0):
        gap = _softmax(model._logits(row, slot, total))
        gap[np.arange(len(y)), y] -= 1
        gap[held] = 0
        gap /= max(1, (~held).sum())
        for c in range(len(families)):
            step = np.bincount(row_of[slot[fit]], (gap[:, c] * scale)[row[fit]], minlength=len(used) + 1)
            model.weights[:, c] -= rate * (4 * step + decay * model.weights[:, c])
        model.weights[0] = 0
        model.bias -= rate * gap.sum(axis=0)
    if held.any():
        z = model._logits(row, slot, total)[held]
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
        model.heat = min(np.geomspace(0.2, 5, 33), key=loss)
    return model


def seed_model() -> Model:
    """The model of the seed paragraphs, calibrated on ordinary sentences and
    surroundings that it is not fitted on."""
    fit, other = [t for i, t in enumerate(ORDINARY) if i % 4], ORDINARY[::4]
    return train(seed_paragraphs(sentences=fit), calibration=seed_paragraphs(VARIANTS // 4, other, 8))


def _pairs(text: bytes) -> set[int]:
    h = Words([text]).hash
    return set(shingles(h, min(2, len(h))).tolist()) if len(h) else set()


FOUND = ("doc_id long, paragraph int, family string, probability double, template int, contained double, "
         "confirmed boolean, text string")


def _scan(model: Model, templates: dict[str, list[str]], probability: float, contained: float):
    bags = {f: [_pairs(t.encode()) for t in ts] for f, ts in templates.items()}

    def found(texts: list[bytes]) -> Iterator[tuple]:
        words = Words(texts)
        row, slot = features(words)
        may = model.bound(row, slot, len(texts)) > 0
        hot, number = np.flatnonzero(may), np.cumsum(may) - 1
        row, slot = number[row[may[row]]], slot[may[row]]
        p = model.probabilities(row, slot, len(hot))
        best = p.argmax(axis=1)
        for i in np.flatnonzero((best > 0) & (p.max(axis=1, initial=0) >= probability)).tolist():
            own, family = _pairs(texts[hot[i]]), model.families[best[i]]
            share = [len(own & bag) / max(1, len(bag)) for bag in bags.get(family, [])] or [0.0]
            t = int(np.argmax(share))
            yield int(hot[i]), family, float(p[i, best[i]]), t, share[t], share[t] >= contained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            rows = [(d, i, p) for d, t in enumerate(byte_texts(b.column("text"))) for i, p in enumerate(paragraphs(t))]
            for lo, hi in grouped([4 * len(p) for _, _, p in rows], SLICE):
                cut = [(at, w) for at in range(lo, hi) for w in windows(rows[at][2])]
                best: dict[tuple[int, str], tuple] = {}      # of the windows of a paragraph, by family
                for j, k in grouped([len(w) for _, w in cut], SLICE):
                    for at, *cells in found([w for _, w in cut[j:k]]):
                        key = cut[j + at][0], cells[0]
                        rank = (cells[4], cells[3], cells[1])
                        if key not in best or rank > best[key][0]:
                            best[key] = rank, cells
                for (at, _), (_, cells) in best.items():
                    d, i, p = rows[at]
                    out.append((ids[d], i, *cells, p.decode()))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             ["doc_id", "paragraph", "family", "probability", "template", "contained",
                                              "confirmed", "text"])
    return run


def licences(docs: DataFrame, labelled: list[tuple[str, str]] | None = None, templates: dict[str, list[str]] = TEMPLATES,
             probability: float = PROBABILITY, contained: float = CONTAINED) -> DataFrame:
    """One row per paragraph and licence family that the classifier puts one of
    its windows in with a calibrated ``probability``: doc_id, number of the
    paragraph (parted by blank lines, from 0), family, and, of the window that
    holds most of a template, probability, template, the share of its word
    pairs held and whether that confirms the family; the paragraph, its lines
    joined.

    ``labelled`` (paragraph, family) is a bounded list that the driver fits; a
    worker holds the weights of its n-grams only.  Paragraphs of class unknown
    give no row; nor do null, empty and blank texts.  Texts are read whole, a
    paragraph at a time.  Repeated rows each give rows, also without a doc_id;
    an empty table gives none; other columns are ignored."""
    prepare(docs.sparkSession)
    model = seed_model() if labelled is None else train(labelled)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                  F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(model, templates, probability, contained), FOUND)
