"""License scans by patience alignment.

A document is matched with each license template by words (runs of letters and digits, lower case). Words that occur
once in both are anchors; the longest increasing subsequence of their places aligns them, and the gaps between are
aligned in the same way, where other words are unique; a gap without anchors takes its common head and tail. The
aligned share of the template is its coverage, and the aligned words give the span in the text.

A copy that covers ``least`` of a template starts with one of its first words and ends with one of its last, as it can
lack no more than a known number. So every stretch between such words, of twice the template's length at most, that
holds enough of the template's words is aligned by itself: copies next to each other do not disturb each other. A
marker that names the license must be aligned, or stand misspelled (by one edit) in its gap, unless NEARLY_ALL of the
template is covered: "Released under the BSD License" is no MIT license. Other markers may be missing.

Defined cases: null and empty texts have no license; repeated rows are reported each; one row a document and license;
texts with several copies report the best, of equals the shortest, then the first; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "doc_id long, license string, coverage double, start long, end long, matched_words long, template_words long"
WORD = re.compile(r"[^\W_]+")

#: Markers that name a license; the others are only peculiar to its text.
NAMING = frozenset({"apache", "nc", "gnu", "mit"})
#: A copy without its naming word covers so much of the template.
NEARLY_ALL = 0.95

#: License notices: name, marker word, text. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "nc", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "mit", "Released under the MIT License."),
    ("Apache-2.0-header", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-notice", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT-grant", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-grant", "redistributions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice"),
)


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = [(p, where[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in where]
        chain = [anchors[x] for x in increasing([q for _, q in anchors])]
        if not chain:
            continue
        out += chain
        p0, q0 = i, k
        for p, q in [*chain, (j, m)]:
            todo.append((p0, p, q0, q))
            p0, q0 = p + 1, q + 1
    return sorted(out)


def _lost(want: list[str], least: float) -> int:
    """How many words a copy can lack."""
    return len(want) - math.ceil(least * len(want) - 1e-9)


def _starters(want: list[str], least: float) -> list[str]:
    """Words of which every copy holds one: the longest, one more than it can lack; all if there are fewer."""
    return sorted(set(want), key=lambda w: (-len(w), w))[: _lost(want, least) + 1]


def _stretches(plain: list[str], want: list[str], least: float) -> Iterator[tuple[int, int, int]]:
    """Start, end and most alignable words of each stretch that can hold a copy."""
    lost, have = _lost(want, least), Counter(want)
    need, head, tail = max(1, len(want) - lost), set(want[: lost + 1]), set(want[-lost - 1 :])
    hits = [k for k, w in enumerate(plain) if w in have]
    for x, a in enumerate(hits):
        if plain[a] not in head:
            continue
        left, most = dict(have), 0
        for b in islice(hits, x, None):
            if b > a + 2 * len(want):
                break
            w = plain[b]
            if left[w]:
                left[w] -= 1
                most += 1
            if most >= need and w in tail:
                yield a, b + 1, most


def _misspelt(a: str, b: str) -> bool:
    """Whether one edit makes b of a: a letter more, less or other, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _is_named(pairs: list[tuple[int, int]], words: list[str], want: list[str], marker: str) -> bool:
    """Whether the marker is aligned, or a misspelling of it stands in the gap where it belongs."""
    if any(want[q] == marker for _, q in pairs):
        return True
    ends = [(-1, -1), *pairs, (len(words), len(want))]
    return any(marker in want[q + 1 : q2] and any(_misspelt(w, marker) for w in words[p + 1 : p2]) for (p, q), (p2, q2) in zip(ends, ends[1:]))


def scan_text(text: str, templates=TEMPLATES, least: float = 0.8) -> list[tuple[str, float, int, int, int, int]]:
    """License, coverage, start, end, matched words and template words of each license found."""
    words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    plain = [w for w, *_ in words]
    present = set(plain)
    out = []
    for name, marker, body in templates:
        want = [w.lower() for w in WORD.findall(body)]
        if sum(w in present for w in want) < max(1, least * len(want)):
            continue
        best = None
        for a, b, most in _stretches(plain, want, least):
            if best and (most, a - b) <= best[0]:
                continue
            pairs = patience_align(plain[a:b], want)
            if not pairs or len(pairs) < least * len(want):
                continue
            a, b = a + pairs[0][0], a + pairs[-1][0] + 1
            rank = (len(pairs), a - b)
            pairs = [(p - pairs[0][0], q) for p, q in pairs]
            if (best is None or rank > best[0]) and (marker not in NAMING or len(pairs) >= NEARLY_ALL * len(want) or _is_named(pairs, plain[a:b], want, marker)):
                best = (rank, words[a][1], words[b - 1][2])
        if best:
            out.append((name, best[0][0] / len(want), best[1], best[2], best[0][0], len(want)))
    return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row a document and license of which the text covers `least` or more."""
    starters = "(?iu)" + "|".join(sorted({w for *_, body in templates for w in _starters([x.lower() for x in WORD.findall(body)], least)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for x in scan_text(t.as_py() or "", templates, least)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text").filter(F.col("text").rlike(starters)).mapInArrow(run, FOUND)
