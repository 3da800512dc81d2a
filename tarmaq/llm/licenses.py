"""Operator 10: find known notices in texts by winnowed fingerprints and banded alignment.

Templates are cut into normalised words; of the hashes of their word runs, the least of each few in a row is a
fingerprint (winnowing). The inverted index of all templates' fingerprints goes to every task: its size is that of
the templates, which is checked. A text's own fingerprints that are in the index propose a template and a
diagonal; there the template is aligned with the text within a band, and what covers enough of it is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import textkit

RUN = 3
#: Runs in a row of which the least is a fingerprint: any RUN + WINNOW - 1 words in common share one.
WINNOW = 2
BAND = 8
MIN_COVERAGE = 0.8
#: The bound of the index that is sent to every task, in template words.
MAX_TEMPLATE_WORDS = 1_000_000

#: Standard notices of public licences.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT line": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_U = np.uint64
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def normal_words(t: textkit.Texts) -> tuple[textkit.Words, np.ndarray]:
    """Words without ASCII punctuation at their ends, and their hashes with A-Z as a-z; words of nothing else go."""
    w = textkit.words(t)
    if not len(w):
        return w, np.empty(0, _U)
    keep = ~_MARK[t.data]
    at = np.arange(len(t.data))
    nxt = np.minimum.accumulate(np.where(keep, at, len(t.data))[::-1])[::-1]
    prev = np.maximum.accumulate(np.where(keep, at, -1))
    start, end = nxt[w.start], prev[w.end - 1] + 1
    some = start < end
    first = np.concatenate(([0], np.cumsum(some)))[w.first]
    w = textkit.Words(start[some], end[some], first)
    return w, textkit.word_hashes(t, w, fold=True)


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each winnowed run of a word sequence; a shorter sequence is one run."""
    if not len(hashes):
        return np.empty(0, _U), np.empty(0, np.int64)
    runs = textkit.grams(hashes, min(RUN, len(hashes)))
    if len(runs) <= WINNOW:
        return runs, np.arange(len(runs))
    windows = np.lib.stride_tricks.sliding_window_view(runs, WINNOW)
    at = np.unique(np.arange(len(windows)) + WINNOW - 1 - windows[:, ::-1].argmin(1))
    return runs[at], at


class Index:
    """The templates' words, and the sorted fingerprints with template and position."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = []
        rows = []
        for k, name in enumerate(self.names):
            for t in textkit.chunks(pa.array([templates[name]]), 1 << 30):
                hashes = normal_words(t)[1]
            if len(hashes) < RUN:
                raise ValueError(f"the template {name!r} has fewer than {RUN} words")
            self.words.append(hashes.tolist())
            rows += [(h, k, p) for h, p in zip(*fingerprints(hashes), strict=True)]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates have more words than a task can hold")
        rows.sort(key=lambda r: r[0])
        self.hashes = np.array([r[0] for r in rows], _U)
        self.template = [r[1] for r in rows]
        self.place = [r[2] for r in rows]


def align(template: list[int], text: list[int], diagonal: int) -> tuple[int, int, int] | None:
    """Matched words, first and last matched word of text, of the best alignment near text position - template position = diagonal.

    A local alignment (2 for a match, -1 for a change or a gap) within BAND of the diagonal. Ties go to the earlier end.
    """
    width = 2 * BAND + 1
    score, match, begin = [0] * width, [0] * width, [-1] * width
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        new_score, new_match, new_begin = [0] * width, [0] * width, [-1] * width
        for k in range(width):
            j = i + diagonal + k - BAND
            if not 0 <= j < len(text):
                continue
            same = text[j] == word
            s, m, b = score[k] + (2 if same else -1), match[k] + same, begin[k]
            if same and b < 0:
                b = j
            if k + 1 < width and score[k + 1] - 1 > s:
                s, m, b = score[k + 1] - 1, match[k + 1], begin[k + 1]
            if k and new_score[k - 1] - 1 > s:
                s, m, b = new_score[k - 1] - 1, new_match[k - 1], new_begin[k - 1]
            if s <= 0:
                s, m, b = 0, 0, -1
            new_score[k], new_match[k], new_begin[k] = s, m, b
            if same and s > best[0]:
                best = (s, m, b, j)
        score, match, begin = new_score, new_match, new_begin
    return best[1:] if best[0] else None


def _scan(index: Index, min_coverage: float):
    @textkit.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for t in textkit.chunks(batch.column(1)):
                w, hashes = normal_words(t)
                # Fingerprints of a text are among all its runs: these are looked up, winnowed where they hit.
                doc_runs = textkit.full_runs(w.first, RUN)
                runs = textkit.grams(hashes, RUN)[doc_runs] if len(doc_runs) else np.empty(0, _U)
                at = np.searchsorted(index.hashes, runs)
                hit = doc_runs[index.hashes[np.minimum(at, len(index.hashes) - 1)] == runs] if len(runs) else doc_runs
                short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < RUN))
                for i in np.unique(np.concatenate((np.searchsorted(w.first, hit, "right") - 1, short))).tolist():
                    a, b = w.first[i], w.first[i + 1]
                    own = hashes[a:b]
                    text, seen, found_here = own.tolist(), set(), set()
                    for h, p in zip(*fingerprints(own), strict=True):
                        k = int(np.searchsorted(index.hashes, h))
                        while k < len(index.hashes) and index.hashes[k] == h:
                            template, diagonal = index.template[k], int(p) - index.place[k]
                            k += 1
                            if any((template, diagonal + d) in seen for d in range(-BAND // 2, BAND // 2 + 1)):
                                continue
                            seen.add((template, diagonal))
                            words = index.words[template]
                            found = align(words, text, diagonal)
                            if found and found[0] >= min_coverage * len(words):
                                m, s, e = found
                                found_here.add((ids[t.rows.start + i], index.names[template], m, len(words), m / len(words), s, e + 1, *(int(x - t.offsets[i]) for x in (w.start[a + s], w.end[a + e]))))
                    rows += sorted(found_here, key=lambda r: r[1:])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "template", "matched", "template_words", "coverage", "start_word", "end_word", "start_byte", "end_byte"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, template, matched, template_words, coverage and spans, for each notice found in docs(doc_id, text).

    Words are counted without those of punctuation only; spans end before end_word and end_byte (UTF-8). Null and
    empty texts have no notices. Repeated rows are each reported; a null doc_id stays null. Two places of
    one template within half a band of each other are one. An empty table gives no rows.
    """
    index = Index(TEMPLATES if templates is None else templates)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan(index, min_coverage), "doc_id long, template string, matched long, template_words long, coverage double, start_word long, end_word long, start_byte long, end_byte long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
