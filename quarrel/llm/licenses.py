"""License scans by patience alignment.

Text and template are sequences of lower-case words (letters and digits). Words that occur once in both are anchors; the longest
increasing subsequence of their places is kept, and the gaps between neighbouring anchors are aligned in the same way. A gap without
anchors matches its equal first and last words. The template is aligned with parts of the text of limited span, not once with the whole, so
notices may be repeated. Coverage is the share of the template's words that are aligned in the best part. A template is tried
only where enough of its words occur in the text at all, which bounds its coverage from above, so the test loses nothing.

Templates are whole licenses and short notices. A notice of another name, variant or version does not match, nor does a whole license whose
title is of another version. Of templates that match overlapping parts of a text, the one that fits its part best has it.

Null and empty texts have no license. Repeated rows give repeated results; extra columns are ignored; texts are aligned whole; ties
between templates go to the longer template, then to the name. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
LONG = 64  # words; a part aligned with a longer template of another version is not searched again
_WORD = re.compile(r"[a-z0-9]+")

# Short notices of public licenses. Those of other names, versions or variants must not match (TELLING).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT-line": "Released under the MIT License",
    "All-rights": "All rights reserved",
}
TELLING = frozenset("apache mozilla eclipse mit bsd isc gnu lesser library affero general public creative commons cc by nc sa nd".split())

# Whole licenses (license_texts) and the words of each that must be aligned.
WHOLE = {
    "0BSD": "",
    "Apache-2.0": "Apache License Version 2.0",
    "BSD-2-Clause": "",
    "BSD-3-Clause": "",
    "BSD-4-Clause": "",
    "CC0-1.0": "CC0 1.0 Universal",
    "GPL-1.0": "Version 1, February 1989",
    "GPL-2.0": "General Public License Version 2, June 1991",
    "GPL-3.0": "General Public License Version 3, 29 June 2007",
    "ISC": "",
    "LGPL-2.0": "Library General Public License Version 2, June 1991",
    "LGPL-2.1": "Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0": "Lesser General Public License Version 3, 29 June 2007",
    "MIT": "",
    "MIT-0": "",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first place, whose second places increase: patience piles with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of a and b, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_b = {w: j for j, w in enumerate(b[b0:b1], b0)}
        once_b = {w for w, n in Counter(b[b0:b1]).items() if n == 1}
        once: dict[str, int] = {}
        for i in range(a0, a1):
            if a[i] in once_b:
                once[a[i]] = -1 if a[i] in once else i
        anchors = _increasing(sorted((i, in_b[w]) for w, i in once.items() if i >= 0))
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
        else:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                out.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                out.append((a1, b1))
    return sorted(out)


def telling(words: list[str]) -> list[str]:
    """The words that tell a license from another: names, variants and version numbers, without zeros and a leading v."""
    bare = [w[1:] if w[0] == "v" and w[1:].isdigit() else w for w in words]
    return [w for w in bare if w.strip("0") and (w in TELLING or any(c.isdigit() for c in w))]


def _place(words: list[str], phrase: list[str]) -> frozenset[int]:
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return frozenset(range(at, at + len(phrase)))


_TEXTS = {n: tokens(files("quarrel.llm").joinpath("license_texts", f"{n}.txt").read_text("utf-8")) for n in WHOLE}
# Name, words, their counts, and the places that must be aligned (of a notice: none, its telling words are compared).
_PARSED = [(n, t, Counter(t), None) for n, t in ((n, tokens(x)) for n, x in NOTICES.items())] + [(n, t, Counter(t), _place(t, tokens(WHOLE[n]))) for n, t in _TEXTS.items()]
_VOCABULARY = frozenset(w for _, t, _, _ in _PARSED for w in t)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = free = (1 << len(b)) - 1
    for w in a:
        if w in places:
            met = free & places[w]
            free = ((free + met) | (free - met)) & full
    return len(b) - free.bit_count()


def regions(ws: list[str], template: list[str], threshold: float = THRESHOLD, fits: Callable[[list[tuple[int, int]]], bool] = lambda pairs: True) -> list[list[tuple[int, int]]]:
    """The aligned places of all parts of the text that cover the template, apart from each other, best first.

    A part spans at most 1 / threshold times the template's words. Every word of the template that occurs in the text may start one; the
    words that a window shares with the template, as bags, bound what it aligns, and windows are tried from the highest bound on. One that
    aligns 95 % of the bound of all others is taken at once. Others then end before it or start after it.
    """
    n, need = len(template), Counter(template)
    most, least = int(n / threshold + 1e-9), math.ceil(threshold * n - 1e-9)
    at = [i for i, w in enumerate(ws) if w in need]
    heap: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    have: Counter[str] = Counter()
    total = end = 0
    for s in at:
        while end < len(at) and at[end] < s + most:
            w = ws[at[end]]
            total += have[w] < need[w]
            have[w] += 1
            end += 1
        if total >= least:
            heap.append((-total, 1, -s, []))
        have[ws[s]] -= 1
        total -= have[ws[s]] < need[ws[s]]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []  # sorted spans
    barred: list[tuple[int, int]] = []
    out = []
    while heap:
        minus, late, start, pairs = heapq.heappop(heap)
        s = -start
        k = bisect_left(taken, (s + 1, -1))
        if (k and taken[k - 1][1] >= s) or (late and any(x < s < y for x, y in barred)):
            continue
        e = min(s + most, taken[k][0] if k < len(taken) else len(ws), len(ws))
        if not late and pairs[-1][0] < e:
            insort(taken, (pairs[0][0], pairs[-1][0]))
            if fits(pairs):
                out.append(pairs)
            continue
        bag = sum(min(need[w], c) for w, c in Counter(ws[s:e]).items() if w in need)
        if bag < least:
            continue
        if bag < -minus:
            heapq.heappush(heap, (-bag, 1, start, []))
            continue
        pairs = [(s + i, j) for i, j in align(ws[s:e], template)]
        if len(pairs) < least and n > LONG:
            # A window moved by t words has at most t more in common with the template: those nearer than what is missing fail too.
            gap = least - common(ws[s:e], template) if e == min(s + most, len(ws)) else 0
            if gap > 0:
                barred.append((s - gap, s + gap))
        elif len(pairs) >= least and (n > LONG or fits(pairs)):
            soon = len(pairs) >= 0.95 * bag
            heapq.heappush(heap, (-bag - 1 if soon else -len(pairs), 0, -pairs[0][0], pairs))
    return out


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[float, str, int, int, int]]:
    """(coverage, name, aligned words, first and last aligned word of the text) of the templates covered, best first."""
    ws = tokens(text)
    have = Counter(w for w in ws if w in _VOCABULARY)
    ends: list[int] = []

    def longer(last: int) -> bool:
        """A version number goes on after the word, other than by zeros."""
        if not ends:
            ends.extend(m.end() for m in _WORD.finditer(text.lower()))
        more = re.compile(r"\.([0-9]+)").match(text.lower(), ends[last]) if ws[last].isdigit() else None
        return bool(more and more[1].strip("0"))

    found = []
    for name, template, need, places in _PARSED:
        if len(ws) < threshold * len(template) or sum(min(n, have[w]) for w, n in need.items()) < threshold * len(template):
            continue
        if places is None:
            told = telling(template)
            fits = lambda pairs, told=told: telling(ws[pairs[0][0] : pairs[-1][0] + 1]) == told and not longer(pairs[-1][0])
        else:
            fits = lambda pairs, places=places: places <= {j for _, j in pairs}
        for pairs in regions(ws, template, threshold, fits):
            first, last = pairs[0][0], pairs[-1][0]
            # Words aligned, less those of the template and of the part that are not: the better of two templates has the part.
            found.append((3 * len(pairs) - len(template) - (last - first + 1), (len(pairs) / len(template), name, len(pairs), first, last)))
    spans: list[tuple[int, int]] = []
    best: dict[str, tuple[float, str, int, int, int]] = {}
    for _, r in sorted(found, key=lambda f: (-f[0], -f[1][0], f[1][1], f[1][3])):
        k = bisect_left(spans, (r[3] + 1, -1))
        if (k and spans[k - 1][1] >= r[3]) or (k < len(spans) and spans[k][0] <= r[4]):
            continue
        insort(spans, (r[3], r[4]))
        if r[1] not in best or (-r[0], -r[2]) < (-best[r[1]][0], -best[r[1]][2]):
            best[r[1]] = r
    return sorted(best.values(), key=lambda r: (-r[0], -r[2], r[1]))


def licensed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (the best covered, null if none), coverage, n_aligned, licenses (all covered, comma-joined) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t, threshold) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0][1] if f else None for f in found], pa.string()), pa.array([f[0][0] if f else 0.0 for f in found], pa.float64()), pa.array([f[0][2] if f else 0 for f in found], pa.int64()), pa.array([",".join(x[1] for x in f) for f in found], pa.string())],
                names=["doc_id", "license", "coverage", "n_aligned", "licenses"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, n_aligned long, licenses string")
