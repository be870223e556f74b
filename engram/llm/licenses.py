"""Licence scans by a positional index of rare words.

Each licence notice is a template, a sequence of words. The index has for every word its postings
(template, position) and its inverse document frequency over the templates. Of a file's
words of each template the rarest are looked up; each place in the file and each
posting vote for an alignment, the file's position less the template's. An alignment that
enough rare words agree on is compared with the template word by word, and counts if it covers
enough of it and the template's mandatory phrases stand inside it.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import as_string, buffers, pick, slices


@dataclass(frozen=True)
class Template:
    """``phrases``: each must stand in an alignment."""

    license: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2.0",)),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 ' '(the "License"); you may not use this file except ' 'in compliance with the License. You may obtain a copy of the License at', ("apache license version 2.0", "in compliance with the license")),
    Template("MIT", "Released under the MIT License.", ("mit license",)),
    Template("MIT", "Licensed under the MIT License.", ("mit license",)),
    Template("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license version 3",)),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license version 3",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by-nc 4.0",)),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution-noncommercial 4.0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4.0",)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4.0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by-sa 4.0",)),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution-sharealike 4.0",)),
    Template("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal.", ("cc0 1.0",)),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd 3-clause license",)),
    Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd 2-clause license",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2.0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
)

#: A word keeps hyphens and dots within it.
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
#: Words that say nothing of a licence; a few notices can't tell how frequent they are.
_FUNCTION = frozenset("a all an and any are as at be by do for from if in into is it not of on or that the this to with you your".split())
#: For each template so many of the file's rarest words of it are looked up, at all their places.
RAREST = 4
#: Share of a template's words that an alignment must have in place, within SLACK words.
COVERAGE, SLACK = 0.75, 3


def words(text: str) -> list[str]:
    return [m[0] for m in _WORD.finditer(text.lower())]


class Index:
    def __init__(self, templates):
        self.templates = [(t.license, words(t.text), [words(p) for p in t.phrases]) for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, (_, ws, _) in enumerate(self.templates):
            for p, w in enumerate(ws):
                self.postings.setdefault(w, []).append((t, p))
        n = len(self.templates)
        self.idf = {w: 0.0 if w in _FUNCTION else math.log((n + 1) / (len({t for t, _ in ps}) + 0.5)) for w, ps in self.postings.items()}
        # the longest word of each template's mandatory phrases: without one of these no template matches
        self.anchor = [max((w for p in ps for w in p), key=lambda w: (len(w), self.idf.get(w, 0), w)) for _, _, ps in self.templates]
        self.anchors = sorted(set(self.anchor))

    def match(self, text: str) -> list[tuple[str, int, int, float]]:
        """(licence, first character, end, coverage), ascending. Of overlapping matches the one that covers
        most words stays, then the better covered, the one with more words exactly in place, the earlier, the template named first."""
        low = text.lower()
        if len(low) != len(text):  # characters whose lower case is longer; places would shift
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        if not any(w in low for w in self.anchors):
            return []
        spans, ws = [], []
        for m in _WORD.finditer(low):
            spans.append(m.span())
            ws.append(m[0])
        at: dict[str, list[int]] = {}
        for i, w in enumerate(ws):
            if w in self.postings:
                at.setdefault(w, []).append(i)
        if not any(w in at for w in self.anchors):
            return []
        votes: dict[tuple[int, int], float] = {}
        used = [0] * len(self.templates)
        # words as rare as each other go in together, so that order never decides
        for idf, group in itertools.groupby(sorted(at, key=lambda w: -self.idf[w]), key=lambda w: self.idf[w]):
            more = [0] * len(used)
            for w in group:
                for t in {t for t, _ in self.postings[w] if used[t] < RAREST}:
                    more[t] += 1
                for t, p in self.postings[w]:
                    if used[t] < RAREST and self.anchor[t] in at:
                        for i in at[w]:
                            votes[t, i - p] = votes.get((t, i - p), 0) + idf
            used = [x + y for x, y in zip(used, more)]
        found = []
        for t, shift in votes:
            name, own, phrases = self.templates[t]
            low_at, high_at = max(0, shift - SLACK), min(len(ws), shift + len(own) + SLACK)
            there = ws[low_at:high_at]
            exact, places = 0, []
            for p, w in enumerate(own):
                at_p = shift + p
                if 0 <= at_p < len(ws) and ws[at_p] == w:
                    exact += 1
                    places.append(at_p)
                else:  # the nearest one within SLACK, the earlier of two
                    near = [j for j in range(max(0, at_p - SLACK), min(len(ws), at_p + SLACK + 1)) if ws[j] == w]
                    if near:
                        places.append(min(near, key=lambda j: (abs(j - at_p), j)))
            if len(places) < COVERAGE * len(own):
                continue
            joined = f" {' '.join(there)} "
            if all(f" {' '.join(p)} " in joined for p in phrases):
                found.append((-len(places), -len(places) / len(own), -exact, min(places), t, max(places), name))
        out, taken = [], []
        for _, share, _, first, _, last, name in sorted(found):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((name, spans[first][0], spans[last][1], round(-share, 6)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_INDEXES: dict = {}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices in each row's text: (``key``, ``match_no`` from 1, ``license``, ``start``, ``end`` in characters,
    ``coverage`` share of the template's words).

    Null and empty texts and texts without a notice give no row; a null key stays null; repeated rows
    are handled one by one; texts are searched whole at any length; other columns are ignored; an
    empty table gives no rows. Ties between overlapping notices: see ``Index.match``.
    """
    templates = tuple(templates)
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string"))

    def run(batches):
        if templates not in _INDEXES:
            _INDEXES[templates] = Index(templates)
        index = _INDEXES[templates]
        for batch in batches:
            column = as_string(batch.column(1))
            rows, no, name, start, end, share = [], [], [], [], [], []
            for at, to in slices(np.diff(buffers(column)[0])):
                for i, value in enumerate(column.slice(at, to - at).to_pylist(), at):
                    for k, m in enumerate(index.match(value) if value else (), 1):
                        for x, v in zip((rows, no, name, start, end, share), (i, k, *m)):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(share, pa.float64())], names=["key", "match_no", "license", "start", "end", "coverage"])

    return own.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, match_no int, license string, start int, end int, coverage double").withColumnRenamed("key", key)
