"""Licence scan: runs of words compared with licence templates by the Dice coefficient of word bigrams.

Lines, paragraphs and the whole of a document are compared as such, and beyond them every run of words.
Dice is at least ``t`` only if a run holds ``t / (2 - t)`` of a template's bigrams, so few documents have
candidates at all. A best run begins and ends with a bigram of the template that it holds once, so at each
end only the last places of the template's bigrams are starts.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_blocks

#: Licences whose full text lies in ``licence_texts``.
FULL = ["Apache-2.0", "Artistic-1.0", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
#: Licences that files name in a tag.
TAGGED = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
#: Notices in common use and full texts: (licence, text). More come as a parameter.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    *((name, f"SPDX-License-Identifier: {name}") for name in TAGGED),
    *((name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in FULL),
]
#: Templates of more bigrams give one run an end word at a time; the stretches between found runs are searched again.
LARGE = 500
WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Word bigrams of normalised text: lower case, marks dropped; one word alone pairs with nothing."""
    words = WORD.findall(text.lower())
    return frozenset(zip(words, [*words[1:], ""] if len(words) == 1 else words[1:]))  # noqa: B905


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        sets = sorted(((bigrams(t), name) for name, t in templates if t and name), key=lambda x: (len(x[0]), x[1]))
        self.sets = [(s, name) for s, name in sets if s]
        self.least = least
        #: Bigrams of a template that a run must hold, and bigrams that it may have.
        self.need = [next(c for c in range(1, len(s) + 1) if 2 * c / (c + len(s)) >= least) for s, _ in self.sets]
        self.most = [int(len(s) * (2 - least) / least) + 1 for s, _ in self.sets]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for t, (s, _) in enumerate(self.sets):
            for pair in s:
                self.owners.setdefault(pair, []).append(t)
        self.known = frozenset(self.owners)
        self.single = {pair[0] for pair in self.known if not pair[1]}

    def passages(self, text: str) -> Iterator[tuple[int, int]]:
        """Lines, paragraphs of several lines, and the text, each once."""
        done = set()
        for pattern in (r"[^\n]+", r"(?:[^\n]+\n?)+"):
            for m in re.finditer(pattern, text):
                if m.span() not in done:
                    done.add(m.span())
                    yield m.span()
        if text and (0, len(text)) not in done:
            yield 0, len(text)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """Matches as (licence, Dice, from, to): the best for each passage, then runs of words that no better match explains.

        A run is left out if a template that matched the passage around it, or a better run that overlaps it,
        holds as many of its bigrams. Templates of one word match that word anywhere.
        """
        low = text.lower()
        words = WORD.findall(low)
        pairs = list(zip(words, words[1:]))  # noqa: B905
        held = Counter(t for pair in self.known.intersection(pairs) for t in self.owners[pair])
        if self.single:
            held.update(t for w in self.single.intersection(words) for t in self.owners[w, ""])
        viable = sorted(t for t, c in held.items() if c >= self.need[t])
        if not viable:
            return []
        spans = np.array([m.span() for m in WORD.finditer(low)])
        if len(low) != len(text):  # a letter that is two in lower case
            spans = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])[spans - [0, 1]] + [0, 1]
        found, taken = [], _Taken(len(words))
        for a, b in self.passages(text):
            i, j = np.searchsorted(spans[:, 0], (a, b)).tolist()
            own = frozenset(pairs[i : j - 1]) if j - i > 1 else frozenset((w, "") for w in words[i:j])
            best, n = (0.0, "", 0), len(own)
            for t in viable if n else ():
                s, name = self.sets[t]
                if min(n, len(s)) * 2 >= self.least * (n + len(s)):
                    dice = 2 * len(own & s) / (n + len(s))
                    if dice >= self.least and (-dice, name) < (-best[0], best[1]):
                        best = (dice, name, t)
            if best[0]:
                found.append((best[1], best[0], a, b))
                taken.add(best[2], i, max(i, j - 2), False)
        runs, tried = [], [(t, 0, len(pairs)) for t in viable]
        while tried:
            more = self._choose(words, pairs, tried, taken)
            runs += [(self.sets[t][1], dice, int(spans[i, 0]), int(spans[j, 1])) for t, i, j, dice in more]
            tried = [(t, a, b) for t in sorted({x[0] for x in more}) if len(self.sets[t][0]) > LARGE for a, b in taken.between(t, len(pairs)) if b - a >= self.need[t]]
        return found + sorted(runs, key=lambda x: x[2:])

    def _choose(self, words: list[str], pairs: list[tuple[str, str]], tried: list[tuple[int, int, int]], taken: _Taken) -> list[tuple[int, int, int, float]]:
        """Runs as (template, first word, last word, Dice) in stretches ``tried``, best first."""
        out = []
        for t, i, j, c, dice in self.runs(words, pairs, tried):
            if taken.same(t, i, j):
                continue
            one = (words[i], "") in self.sets[t][0]
            if not any(u == t or (any(words[i] in p for p in self.sets[u][0]) if one else len(self.sets[u][0].intersection(pairs[i : j + 1])) >= c) for u in taken.around(i, j)):
                taken.add(t, i, j, True)
                out.append((t, i, i if one else j + 1, dice))
        return out

    def runs(self, words: list[str], pairs: list[tuple[str, str]], tried: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
        """All runs of bigrams that can be a best one, as (template, first, last, common, Dice), best first."""
        number: dict[tuple[str, str], int] = {}
        ids = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
        after = np.full(len(ids), len(ids))  # where the bigram comes next
        order = np.argsort(ids, kind="stable")
        twin = ids[order[1:]] == ids[order[:-1]]
        after[order[:-1][twin]] = order[1:][twin]
        parts = []
        for t, lo, hi in tried:
            s, need, most = self.sets[t][0], self.need[t], self.most[t]
            n, last = len(s), {}
            for j, w in enumerate(words) if ("" in next(iter(s))) else ():
                if (w, "") in s:
                    parts.append((np.array([1.0]), np.array([j]), j, np.array([1]), t))
            for j in range(lo, hi):
                pair = pairs[j]
                if pair not in s:
                    continue
                last.pop(pair, None)
                last[pair] = j  # in order of the last place
                if len(last) < need:
                    continue
                at = list(last.values())
                first, width = at[-need], 2 * most
                while j - width > first and np.count_nonzero(after[j - width : j + 1] > j) <= most:
                    width *= 2
                if j - width > first:
                    continue
                while j - width > at[0] and np.count_nonzero(after[j - width : j + 1] > j) <= most:
                    width *= 2
                first = max(at[0], j - width)
                at = np.array(at[: len(at) - need + 1])
                c = np.arange(len(last), need - 1, -1)
                at, c = at[at >= first], c[at >= first]
                own = np.cumsum((after[first : j + 1] > j)[::-1])[::-1][at - first]
                dice = 2 * c / (own + n)
                keep = dice >= self.least
                if n > LARGE and keep.any():
                    keep = np.arange(len(dice)) == dice.argmax()
                if keep.any():
                    parts.append((dice[keep], at[keep], j, c[keep], t))
        if not parts:
            return
        size = [len(p[0]) for p in parts]
        dice, i, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
        j, t = (np.repeat([p[k] for p in parts], size) for k in (2, 4))
        n = np.array([len(s) for s, _ in self.sets])[t]
        order = np.lexsort((t, j, i, -n, -dice))
        yield from zip(*(x[order].tolist() for x in (t, i, j, c, dice)), strict=True)


class _Taken:
    """Matches by place: passages explain what is inside them, runs what they overlap."""

    def __init__(self, size: int):
        self.size, self.marks, self.blocks = size, {}, {}

    def between(self, t: int, size: int) -> list[tuple[int, int]]:
        """Stretches without a run of the template."""
        return [m.span() for m in re.finditer(rb"\0+", bytes(self.marks[t][:size]))]

    def add(self, t: int, i: int, j: int, run: bool) -> None:
        if run:
            self.marks.setdefault(t, bytearray(self.size))[i : j + 1] = b"\1" * (j + 1 - i)
        for k in range(i >> 6, (j >> 6) + 1):
            self.blocks.setdefault(k, []).append((t, i, j, run))

    def same(self, t: int, i: int, j: int) -> bool:
        return t in self.marks and self.marks[t].find(1, i, j + 1) >= 0

    def around(self, i: int, j: int) -> set[int]:
        near = {x for k in range(i >> 6, (j >> 6) + 1) for x in self.blocks.get(k, ())}
        return {t for t, a, b, run in near if (a <= j and i <= b if run else a <= i and j <= b)}


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with ``licence`` and ``dice`` of its best match (null without one) and ``matches``: licence, dice and character bounds.

    Ties go to the licence first by name. Null and empty texts match nothing. All columns of ``docs`` stay; ones
    with the three names are replaced. Templates are a parameter of bounded size; without any
    nothing matches. An empty table gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    scanner = Scanner(TEMPLATES if templates is None else templates, least)
    docs = docs.drop("licence", "dice", "matches")
    names = docs.columns
    item = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("o", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_blocks(batch, "text"):
                found = [scanner.scan(t.as_py() or "") for t in part.column("text")]
                best = [min(((-d, n) for n, d, _, _ in f), default=None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array([b and b[1] for b in best], pa.string()), pa.array([b and -b[0] for b in best], pa.float64()), pa.array([[dict(zip(("licence", "dice", "o", "e"), m, strict=True)) for m in f] for f in found], pa.list_(item))],
                    [*names, "licence", "dice", "matches"],
                )

    spans = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("o", T.LongType()), T.StructField("e", T.LongType())]))
    fields = [T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("matches", spans)]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
