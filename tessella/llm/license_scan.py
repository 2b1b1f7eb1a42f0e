"""Licence scan: a paragraph classifier on sparse word n-grams with a calibrated
unknown class; similarity to the family's templates confirms what it predicts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

#: Short notices of each licence family: fixed values, public standard wordings.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 License.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 License.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-2.0": [
        "Licensed under the GNU GPL version 2.",
        "Licensed under the GNU General Public License v2.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ],
    "gpl-3.0": [
        "Licensed under the GNU GPL version 3.",
        "Licensed under the GNU General Public License v3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "Licensed under the GNU LGPL version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "mpl-2.0": ["Licensed under the MPL 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Identifiers of each family for ``SPDX-License-Identifier:`` lines: fixed values.
IDENTIFIERS = {
    "agpl-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "apache-2.0": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by-4.0": ["CC-BY-4.0"],
    "cc-by-nc-4.0": ["CC-BY-NC-4.0"], "cc-by-sa-4.0": ["CC-BY-SA-4.0"], "cc0-1.0": ["CC0-1.0"], "gpl-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only"], "mit": ["MIT"], "mpl-2.0": ["MPL-2.0"],
}
#: Wordings that mean the same; training rows take any of a line for another.
SYNONYMS = (
    ("licensed", "released", "distributed", "published", "available", "provided", "covered"),
    ("under the terms of the", "under the", "subject to the", "according to the"),
    ("License", "Licence", "license", "licence"),
    ("version 2", "v2", "version 2.0"),
    ("version 3", "v3", "version 3.0"),
    ("This work is", "This software is", "This project is", "The code is", "All files are", "Everything here is"),
)
UNKNOWN = "unknown"
GRAMS = (1, 2, 3)
#: Words of half a window; a paragraph is judged whole up to that, else by
#: overlapping windows of two halves.
HALF = 24
#: Notices wrapped over lines: windows of so many cells of CELL words, from each
#: cell on, over the words of lines that no blank line parts.
CELL = 6
CELLS = (2, 4, 6, 8)
#: Rows made per family for training, and as many times more of ordinary prose.
ROWS_PER_FAMILY = 80
UNKNOWN_TIMES = 8
#: Share of ordinary held-back paragraphs that may pass as a licence.
FALSE_RATE = 0.002
#: Least similarity to a template of the family that the classifier found: the
#: share of the template's words that stand there, weighted by how few families
#: use them (the squared logarithm of families over families that do).
MIN_TEMPLATE = 0.65
CHUNK_CHARS = 2_000_000

_found = re.compile(r"[^\W_]+|\n").findall


def _tokens(text: str) -> list[str]:
    """Words, case folded, and line ends; one spelling of licence."""
    return _found(text.casefold().replace("licence", "license"))


def labelled_paragraphs(rows_per_family: int = ROWS_PER_FAMILY, seed: int = 5) -> list[tuple[str, str]]:
    """(paragraph, family) by rule: the templates with words before, after or
    lost, and ordinary prose, some of it about licences, as unknown."""
    rng = random.Random(seed)
    common = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no said der die und den das mit von für auf ist la de el en y los que le les des est un une pour dans".split()
    about = "license licensed licence licenses released version terms permission work software public general driver fishing plate agreement copyright reserved under granted project code source free use file files apache mit gnu cc commons".split()
    parts = "th er ing tion re st nd on es at ou ha he or an ly sh wh ed be ti ble ch sch eau ment os ción".split()
    invent = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    filler = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else invent() for _ in range(n))

    def reworded(text: str) -> str:
        for group in SYNONYMS:
            for phrase in sorted(group, key=len, reverse=True):
                if re.search(rf"\b{re.escape(phrase)}\b", text):
                    if rng.random() < 0.5:
                        text = re.sub(rf"\b{re.escape(phrase)}\b", rng.choice(group), text, count=1)
                    break
        return text

    rows = []
    for family, templates in TEMPLATES.items():
        ids = IDENTIFIERS[family]
        for i in range(rows_per_family):
            if i % 6 == 5:
                rows.append((rng.choice(["", "# ", "// ", "/* ", f"{invent()} "]) + f"SPDX-License-Identifier: {rng.choice(ids)}", family))
                continue
            words = reworded(templates[i % len(templates)]).split()
            if i % 6 == 4:
                words = rng.choice([["License:", rng.choice(ids)], ["licensed", "under", "the", rng.choice(ids), "license"], reworded(templates[0]).split()])
            if len(words) > 8 and rng.random() < 0.3:
                del words[rng.randrange(len(words))]
            if rng.random() < 0.3:
                words = [*f"Copyright {rng.randint(1990, 2030)} {invent()}".split(), *words]
            if rng.random() < 0.4:
                words = [*filler(rng.randint(1, 14)).split(), *words]
            if rng.random() < 0.4:
                words = [*words, *filler(rng.randint(1, 14)).split()]
            rows.append((" ".join(words), family))
    every = [t for templates in TEMPLATES.values() for t in templates]
    for i in range(rows_per_family * UNKNOWN_TIMES):
        if i % 3 == 1:
            text = filler(rng.randint(1, 45))
        elif i % 6 == 0:  # licences of other names
            text = reworded(rng.choice([f"Licensed under the {invent()} License {rng.randint(1, 4)}.{rng.randint(0, 9)}", f"Released under the {invent().capitalize()} Public License.", f"Copyright {rng.randint(1990, 2030)} {invent()}. All rights reserved.", f"SPDX-License-Identifier: {invent()}-{rng.randint(1, 4)}.0", f"This work is licensed under the {invent()} {invent()} agreement, version {rng.randint(1, 4)}."]))
        elif i % 6 == 2:  # pieces of templates, too short to tell
            words = rng.choice(every).split()
            at = rng.randrange(len(words))
            text = " ".join([filler(rng.randint(3, 20)), *[w for w in words[at : at + 2] if w.lower().strip(",.;:") in common], filler(rng.randint(3, 20))])
        else:
            text = " ".join(rng.choice(about) if rng.random() < 0.4 else rng.choice(common) for _ in range(rng.randint(2, 30)))
        rows.append((text, UNKNOWN))
    return rows


class LicenseModel:
    """Softmax regression on the counts of known word n-grams, scaled by the
    root of the window's length."""

    def __init__(self, rows: Sequence[tuple[str, str]], epochs: int = 150, rate: float = 3.0, seed: int = 2):
        self.classes = [UNKNOWN, *sorted({f for _, f in rows} - {UNKNOWN})]
        self.vocab: dict[str, int] = {}
        for text, family in rows:
            if family != UNKNOWN:
                for w in _tokens(text):
                    self.vocab.setdefault(w, len(self.vocab) + 1)
        self.vocab.pop("\n", None)
        order = list(range(len(rows)))
        random.Random(seed).shuffle(order)
        held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
        y = np.array([self.classes.index(f) for _, f in rows])
        self.keys = np.zeros(0, dtype=np.int64)
        grams = [self._grams(np.array([self.vocab.get(w, 0) for w in _tokens(t)], dtype=np.int64)) for t, _ in rows]
        self.keys = np.unique(np.concatenate([np.concatenate([k for k, _ in grams[i]]) for i in train]))
        n = len(self.keys)
        row, col, value = [], [], []
        for i, own in enumerate(grams):
            size = max(1, len(_tokens(rows[i][0])))
            for keys, _ in own:
                at = np.minimum(np.searchsorted(self.keys, keys), n - 1)
                at = at[self.keys[at] == keys]
                row.append(np.full(len(at), i))
                col.append(at)
                value.append(np.full(len(at), 1 / np.sqrt(size)))
        row, col, value = np.concatenate(row), np.concatenate(col), np.concatenate(value)
        w, b = np.zeros((n, len(self.classes))), np.zeros(len(self.classes))
        mine = np.isin(row, train)
        r, c, v = row[mine], col[mine], value[mine]
        weight = 1 / np.bincount(y[train], minlength=len(self.classes)).clip(1)
        part = weight[y[train]] / weight[y[train]].sum()
        share = np.zeros(len(rows))
        share[train] = part
        for _ in range(epochs):
            z = np.stack([np.bincount(r, weights=w[c, k] * v, minlength=len(rows)) for k in range(len(self.classes))], axis=1) + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            g = p * share[:, None]
            for k in range(len(self.classes)):
                w[:, k] -= rate * 10 * np.bincount(c, weights=g[r, k] * v, minlength=n)
            b -= rate * g.sum(axis=0)
        self.weights, self.bias = w, b
        z = np.stack([np.bincount(row, weights=w[col, k] * value, minlength=len(rows)) for k in range(len(self.classes))], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        plain = np.sort(1 - p[[i for i in held if y[i] == 0], 0])
        #: The calibrated unknown class: less than this on licences is unknown.
        self.least = max(0.5, float(plain[min(len(plain) - 1, int(len(plain) * (1 - FALSE_RATE)))]) if len(plain) else 0.5)
        known = [i for i in held if y[i]]
        self.held_accuracy = float(np.mean(p[known].argmax(axis=1) == y[known])) if known else 1.0
        texts = {f: [_tokens(t) for t in [*ts, *[f"License: {x}" for x in IDENTIFIERS[f]]]] for f, ts in TEMPLATES.items()}
        self.templates = {f: [self._pairs(t) for t in ts] for f, ts in texts.items()}
        holders = Counter(w for ts in texts.values() for w in {w for t in ts for w in t})
        self.weight = {w: math.log(1 + len(texts) / n) ** 2 for w, n in holders.items()}
        self.bags = {f: [{*t} for t in ts] for f, ts in texts.items()}

    def _grams(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Key and first place of every n-gram of known words only."""
        out, base = [], len(self.vocab) + 1
        for n in GRAMS:
            m = len(ids) - n + 1
            if m <= 0:
                continue
            ok = ids[:m] > 0
            for k in range(1, n):
                ok &= ids[k : k + m] > 0
            at = np.flatnonzero(ok)
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(n):
                key = key * base + ids[at + k]
            out.append((key * len(GRAMS) + n - 1, at))
        return out

    @staticmethod
    def _pairs(words: Sequence[str]) -> set[tuple[str, str]]:
        return set(zip(words, words[1:]))

    def similarity(self, words: Iterable[str], family: str) -> float:
        """Of the family's templates the one that the words hold best: the share
        of its words, weighted by how few families use them; a single word, which
        may be of another language, is none."""
        own, weight = set(words), self.weight
        return max(sum(weight[w] for w in bag & own) / sum(weight[w] for w in bag) if len(bag & own) > 1 else 0.0 for bag in self.bags[family])

    def scan(self, texts: Sequence[str | None]) -> list[list[tuple[int, str, float]]]:
        """Per text the confirmed (line, family, probability), one entry per notice:
        the line it stands on or, where it is wrapped, begins on, from 0."""
        out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            self._scan(texts[start:stop], start, out)
            start = stop
        return out

    def _scan(self, texts: Sequence[str | None], first: int, out: list) -> None:
        lists = [_tokens(t or "") for t in texts]
        sizes = np.array([len(x) + 1 for x in lists])
        ids = np.zeros(int(sizes.sum()), dtype=np.int64)
        get, at = {**self.vocab, "\n": -1}.get, 0
        for words in lists:
            ids[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words))
            ids[at + len(words)] = -1
            at += len(words) + 1
        breaks = ids == -1
        paragraph = np.cumsum(breaks) - breaks
        ends = np.flatnonzero(breaks)
        begins = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(len(ids)) - begins[paragraph]
        halves = np.maximum(1, -(-(ends - begins) // HALF))
        base = np.concatenate([[0], np.cumsum(halves)])
        half = base[paragraph] + np.minimum(place // HALF, halves[paragraph] - 1)
        n_half = int(base[-1])
        sums = np.zeros((n_half, len(self.classes)))
        for key, where in self._grams(ids):
            col = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[col] == key
            col, own = col[hit], half[where[hit]]
            for k in range(len(self.classes)):
                sums[:, k] += np.bincount(own, weights=self.weights[col, k], minlength=n_half)
        words_in = np.bincount(half[~breaks], minlength=n_half)
        owner = np.repeat(np.arange(len(ends)), halves)
        pair = np.flatnonzero(owner[:-1] == owner[1:]) if n_half > 1 else np.zeros(0, dtype=np.int64)
        alone = np.flatnonzero(halves[owner] == 1)
        window = np.concatenate([alone, pair])
        z = np.concatenate([sums[alone], sums[pair] + sums[pair + 1]]) if len(pair) else sums[alone]
        size = np.concatenate([words_in[alone], words_in[pair] + words_in[pair + 1]]) if len(pair) else words_in[alone]
        z = z / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        doc_of = np.repeat(np.arange(len(texts)), [x.count("\n") + 1 for x in lists])
        doc_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first_par = np.searchsorted(doc_of, np.arange(len(texts)))
        notices: dict[int, list[tuple[int, int, str, float, float]]] = {}
        for w in np.flatnonzero((size > 0) & (1 - p[:, 0] >= self.least)):
            par = int(owner[window[w]])
            doc = int(doc_of[par])
            low = int(begins[par] + (window[w] - base[par]) * HALF)
            high = int(min(ends[par], low + 2 * HALF))
            words = lists[doc][low - doc_starts[doc] : high - doc_starts[doc]]
            notice = self._notice(words, self.classes[1 + int(p[w, 1:].argmax())])
            if notice:
                x, y, family, share = notice
                notices.setdefault(doc, []).append((low + x, low + y, family, share, float(1 - p[w, 0])))
        for doc, notice in self._wrapped(lists, ids, begins, first_par):
            notices.setdefault(doc, []).append(notice)
        for doc, own in sorted(notices.items()):
            best: dict[tuple[int, str], float] = {}
            for start, family, q in self._resolved(own):
                key = (int(paragraph[start]) - int(first_par[doc]), family)
                best[key] = max(best.get(key, 0.0), q)
            out[first + doc] += [(line, family, q) for (line, family), q in sorted(best.items())]

    def _notice(self, words: Sequence[str], family: str) -> tuple[int, int, str, float] | None:
        """First and last word of what bears the family out, the family, and the
        similarity; None where the templates don't confirm it."""
        share = self.similarity(words, family)
        return (*self._extent(words, family), family, share) if share >= MIN_TEMPLATE else None

    @staticmethod
    def _resolved(notices: Iterable[tuple[int, int, str, float, float]]) -> list[tuple[int, str, float]]:
        """(first word, family, probability): of what several windows saw of one
        notice the whole, and of families that share words the most similar."""
        merged: dict[str, list[list]] = {}
        for start, end, family, share, q in sorted(notices):
            own = merged.setdefault(family, [])
            if own and start <= own[-1][1]:
                own[-1][1:] = [max(end, own[-1][1]), max(share, own[-1][2]), max(q, own[-1][3])]
            else:
                own.append([start, end, share, q])
        every = [(f, *x) for f, own in merged.items() for x in own]
        return [
            (start, f, q)
            for f, start, end, share, q in every
            if not any(g != f and a <= end and start <= b and (s, b - a) > (share, end - start) for g, a, b, s, _ in every)
        ]

    def _wrapped(self, lists: list[list[str]], ids: np.ndarray, begins: np.ndarray, first_par: np.ndarray) -> Iterator[tuple[int, tuple[int, int, str, float, float]]]:
        """Every confirmed notice over more than one line: its text, first and last
        word, family, similarity and probability. ``ids``: all words, -1 at the
        end of each line."""
        breaks = ids == -1
        place = np.flatnonzero(~breaks)
        if not len(place):
            return
        line = (np.cumsum(breaks) - breaks)[place]
        # Blocks end where lines without a word lie between, and with the text.
        doc = np.searchsorted(first_par, line, side="right") - 1
        new = np.concatenate([[True], (line[1:] > line[:-1] + 1) | (doc[1:] != doc[:-1])])
        block = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(place)]]))
        cells = -(-sizes // CELL)
        base = np.concatenate([[0], np.cumsum(cells)])
        cell = base[block] + (np.arange(len(place)) - starts[block]) // CELL
        n_cell = int(base[-1])
        # The same words with one break after each block.
        joined = np.full(len(place) + len(starts), -1, dtype=np.int64)
        at = np.arange(len(place)) + block
        joined[at] = ids[place]
        cell_at = np.zeros(len(joined), dtype=np.int64)
        cell_at[at] = cell
        sums = np.zeros((n_cell + 1, len(self.classes)))
        for key, where in self._grams(joined):
            col = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[col] == key
            col, own = col[hit], cell_at[where[hit]]
            for k in range(len(self.classes)):
                sums[1:, k] += np.bincount(own, weights=self.weights[col, k], minlength=n_cell)
        sums = np.cumsum(sums, axis=0)
        first_word = np.concatenate([np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), [len(place)]])
        ends = np.repeat(base[1:], cells)
        for width in CELLS:
            low = np.arange(n_cell)
            high = np.minimum(low + width, ends)
            many = line[first_word[low]] < line[first_word[high] - 1]
            low, high = low[many], high[many]
            z = (sums[high] - sums[low]) / np.sqrt(first_word[high] - first_word[low])[:, None] + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for w in np.flatnonzero(1 - p[:, 0] >= self.least):
                a, b = int(first_word[low[w]]), int(first_word[high[w]])
                d = int(doc[a])
                begin = int(begins[first_par[d]])
                words = [lists[d][k - begin] for k in place[a:b].tolist()]
                notice = self._notice(words, self.classes[1 + int(p[w, 1:].argmax())])
                if notice:
                    x, y, family, share = notice
                    if line[a + x] < line[a + y]:
                        yield d, (int(place[a + x]), int(place[a + y]), family, share, float(1 - p[w, 0]))

    def _extent(self, words: Sequence[str], family: str) -> tuple[int, int]:
        """First and last of the words that hold the family's nearest template,
        without pairs at the ends that stand inside as well."""
        pairs = list(zip(words, words[1:]))
        own = set(pairs)
        template = max(self.templates[family], key=lambda t: len(t & own) / len(t))
        at = [k for k, pair in enumerate(pairs) if pair in template]
        if not at:
            bag = max(self.bags[family], key=lambda t: sum(self.weight[w] for w in t & {*words}))
            places = [k for k, w in enumerate(words) if w in bag]
            return places[0], places[-1]
        while len(at) > 1 and pairs[at[0]] in {pairs[k] for k in at[1:]}:
            del at[0]
        while len(at) > 1 and pairs[at[-1]] in {pairs[k] for k in at[:-1]}:
            del at[-1]
        return at[0], at[-1] + 1


_MODELS: list[LicenseModel] = []


def default_model() -> LicenseModel:
    """Trained on the made table; once per process."""
    if not _MODELS:
        _MODELS.append(LicenseModel(labelled_paragraphs()))
    return _MODELS[0]


def families_of(found: Iterable[tuple[int, str, float]]) -> str:
    return ",".join(sorted({f for _, f, _ in found}))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, families, n_paragraphs, paragraphs, score for every row.

    ``families``: confirmed licence families, sorted and comma-joined, empty
    without one; ``paragraphs``: ``number:family`` of each confirmed paragraph
    (its line or, where it is wrapped, its first line, from 0); ``score``: the least probability among them, null without
    one. Null and empty texts hold none. Texts are read whole; repeated rows
    repeat; extra columns are not read; an empty table gives no rows.
    """
    model = model or default_model()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("families", T.StringType()), T.StructField("n_paragraphs", T.LongType()), T.StructField("paragraphs", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        own = shared.value
        for batch in batches:
            found = own.scan(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([families_of(f) for f in found], pa.string()),
                    pa.array([len({p for p, _, _ in f}) for f in found], pa.int64()),
                    pa.array([",".join(f"{p}:{k}" for p, k, _ in f) for f in found], pa.string()),
                    pa.array([min((q for _, _, q in f), default=None) for f in found], pa.float64()),
                ],
                names=schema.names,
            )

    return map_batches(docs.select(id_column, text), run, schema)
