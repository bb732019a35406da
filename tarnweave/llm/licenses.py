"""Licence scans: texts against licence templates by Dice coefficient over word bigrams.

A unit is a line, a paragraph (between empty lines) or the whole text. Units and
templates are normalised to lower-case words of letters and digits, and compared
by the sets of their word pairs: twice the common pairs over the sum of both
sizes. A template is a candidate for a unit only if their sizes allow the
threshold: with t the threshold, a set of n pairs matches sets of n*t/(2-t) to
n*(2-t)/t pairs. At these sizes more than a share of a template's pairs must be in
the unit, so a unit without any of a few chosen pairs of each template is passed over
at once; neither bound loses a match.

Defined cases: a null or empty text, and units of under two words, match nothing;
equal scores go to the smaller template name; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored. Texts of any length
are scanned whole; a unit's pairs are dropped once there are too many of them for
any template.

``scan_notices`` looks beyond units and short notices: it also compares windows of
each template's number of words, at every word of the text, so notices that are
wrapped or stand inside other text count, and by default knows full licence texts
as well. A text without enough of a template's pairs has no such window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Templates by name: short notices in common use. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}

#: Full licence texts, one file each.
TEXTS = Path(__file__).with_name("license_texts")

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
#: Characters of a unit from which its pairs are made one by one.
LONG = 1 << 16
#: Words of a text that windows begin at in one go.
STEP = 1 << 15


def all_templates() -> dict[str, str]:
    """``TEMPLATES``, the bare reservation of rights, and the full texts."""
    return TEMPLATES | {"all-rights-reserved": "All rights reserved."} | {f.stem: f.read_text() for f in sorted(TEXTS.glob("*.txt"))}


def pairs_of(text: str) -> Iterator[tuple[str, str]]:
    """Neighbouring words, one pair after the other."""
    before = None
    for m in WORD.finditer(text.lower()):
        word = m[0]
        if before is not None:
            yield before, word
        before = word


class Templates:
    """Templates with their pairs, size bounds and the pairs that a match can't lack altogether."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.pairs = {name: frozenset(pairs_of(text)) for name, text in sorted(templates.items())}
        self.threshold = t = threshold
        self.bounds = {name: (len(p) * t / (2 - t), len(p) * (2 - t) / t) for name, p in self.pairs.items()}
        self.words = {name: len(WORD.findall(text.lower())) for name, text in templates.items()}
        self.most = max((hi for _, hi in self.bounds.values()), default=0)
        counts: dict[tuple[str, str], int] = {}
        for p in self.pairs.values():
            for x in p:
                counts[x] = counts.get(x, 0) + 1
        self.keys: set[tuple[str, str]] = set()
        for p in self.pairs.values():
            # a match has at least t/(2-t) of the template's pairs, so it can't lack all of the others and one more
            must = int(len(p) * (1 - t / (2 - t)) + 1e-9) + 1
            self.keys.update(sorted(p, key=lambda x: (counts[x], x))[:must])

    def matches(self, pairs: set[tuple[str, str]]) -> Iterator[tuple[float, str]]:
        n = len(pairs)
        for name, own in self.pairs.items():
            lo, hi = self.bounds[name]
            if lo - 1e-9 <= n <= hi + 1e-9 and n:
                score = 2 * len(own & pairs) / (n + len(own))
                if score >= self.threshold:
                    yield score, name

    def scan(self, text: str) -> list[tuple[float, str]]:
        """The best template of each unit that has one."""
        out: list[tuple[float, str]] = []
        lines, paragraphs = text.split("\n"), text.split("\n\n")
        for units in (lines, paragraphs if len(paragraphs) > 1 else [], [text] if len(lines) > 1 else []):
            for unit in units:
                if len(unit) < LONG:
                    words = WORD.findall(unit.lower())
                    found = zip(words, words[1:], strict=False)
                    pairs = set() if self.keys.isdisjoint(found) else set(zip(words, words[1:], strict=False))
                else:
                    pairs = set()
                    for p in pairs_of(unit):
                        pairs.add(p)
                        if len(pairs) > self.most + 1:
                            break
                if pairs and (best := min(((-s, n) for s, n in self.matches(pairs)), default=None)):
                    out.append((-best[0], best[1]))
        return out


    def windows(self, text: str) -> dict[str, float]:
        """The best score of each template over all windows of its number of words, where it reaches the threshold.

        A text of fewer words is one window. Words are taken in runs that overlap by the longest template.
        """
        best: dict[str, float] = {}
        overlap, words = max(self.words.values(), default=0), []
        for m in WORD.finditer(text.lower()):
            words.append(m[0])
            if len(words) == STEP + overlap:
                self._slide(words, best)
                del words[:STEP]
        self._slide(words, best)
        return best

    def _slide(self, words: list[str], best: dict[str, float]) -> None:
        if self.keys.isdisjoint(zip(words, words[1:], strict=False)):
            return
        pairs = list(zip(words, words[1:], strict=False))
        found = set(pairs)
        for name, own in self.pairs.items():
            # common pairs that any match has; a window can't have more than the run
            if len(own & found) < len(own) * self.threshold / (2 - self.threshold) - 1e-9:
                continue
            width, held, common = max(1, min(self.words[name], len(words)) - 1), Counter(), 0
            for i, p in enumerate(pairs):
                held[p] += 1
                common += held[p] == 1 and p in own
                if i >= width:
                    gone = pairs[i - width]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                        common -= gone in own
                if i >= width - 1 and (score := 2 * common / (len(held) + len(own))) >= self.threshold:
                    best[name] = max(score, best.get(name, 0.0))


def scan_notices(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, score, n_licenses, licenses): as ``scan``, over units and windows; the number of templates
    that match, and their names, sorted and joined by commas. Without a match: null, null, 0, ''."""
    known = Templates(all_templates() if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                body = t.as_py() or ""
                found = known.windows(body)
                for score, name in known.scan(body):
                    found[name] = max(score, found.get(name, 0.0))
                best = min(((-s, n) for n, s in found.items()), default=(None, None))
                rows.append((best[1], None if best[0] is None else round(-best[0], 6), len(found), ",".join(sorted(found))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "license", "score", "n_licenses", "licenses"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, license string, score double, n_licenses long, licenses string")


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, score, n_units, licenses): the best template, its score, the number of units that
    match one, and the names of all that match, sorted and joined by commas. Without a match: null, null, 0, ''."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = known.scan(t.as_py() or "")
                best = min(((-s, n) for s, n in found), default=(None, None))
                rows.append((best[1], None if best[0] is None else round(-best[0], 6), len(found), ",".join(sorted({n for _, n in found}))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "license", "score", "n_units", "licenses"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, license string, score double, n_units long, licenses string")
