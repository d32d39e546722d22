"""Exact removal of repeated passages: suffix automata over reference shards, documents streamed for matching statistics.

A window is WINDOW consecutive words of one document; it is repeated if its word sequence starts at another place as well, in the same or
any other document. Every word under a repeated window goes.

Broadcasting automata of the whole corpus would not be bounded, so shards are formed by content. Every window has an anchor, its
least-hashed run of GRAM words (leftmost on ties), and equal windows have equal anchors. Successive windows with one anchor make a context
(at most 2 * WINDOW - GRAM words), and a context holds exactly the windows of its own. Then:

1. Contexts are aggregated by anchor. An anchor seen once has no repeated window; where all contexts of an anchor are equal, all windows are.
2. For the others each distinct context with its multiplicity goes to the reference shard of its anchor (every place of a window is in one
   shard). Each shard of bounded size gets a suffix automaton with occurrence counts; contexts are streamed through it, and the positions
   whose last WINDOW words match at two places at least give the maximal spans.
3. An anchor with more than BIG distinct contexts (a very common passage) would not fit a bounded shard: ranges of its windows are halved
   until all of a range are repeated or none, by aggregates of hashes, which is exact too and splits over any number of tasks.
4. Spans go back to their documents, which lose the words under them.

Null and empty texts have no words. Rows that are repeated, with or without doc_id, count as places of their own; their spans are held
once. Extra columns are ignored. A text shorter than WINDOW words is kept whole. An empty table gives an empty result. Ties of an anchor
go to its leftmost place, so equal windows have equal anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import discard, gram_hashes, mix, release, runs, shuffle_width, tie, word_hashes, words, written

WINDOW = 35
GRAM = 8
BIG = 400
SHARD_WORDS = 30_000
_MUL = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of any run of words by prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h) * _powers(_MUL, n), dtype=np.uint64)))
        self.inverse = _powers(_INV, n + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def contexts(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first window, number of windows) for the word hashes of one document."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none
    g = gram_hashes(h, GRAM)
    span = window - GRAM + 1
    v = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    if size < span:
        v = np.minimum(v[: len(v) - (span - size)], v[span - size :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.nonzero(at[1:] != at[:-1])[0] + 1))
    count = np.diff(np.concatenate((first, [len(at)])))
    place = at[first]
    ctx = mix(_Rolling(h).runs(first, first + count + window - 1) + (place - first).astype(np.uint64))
    return g[place], ctx, first, count


class Automaton:
    """Suffix automaton of many sequences with weighted occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the suffix through p's edge c, split from q where q stands for longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                cur = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = cur
                    p = self.link[p]
                if p >= 0:
                    self.link[cur] = self._split(p, c, self.next[p][c])
                last = cur
            self.count[last] += weight

    def close(self) -> None:
        """Carry counts from longer states to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of a sequence that occur twice at least: matching statistics cut at the window's length."""
        state, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] > 1:
                out.append(i - window + 1)
        return out


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive window starts as (first, number)."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][0] + out[-1][1] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [(a, b) for a, b in out]


def _shard(rows: list[tuple[int, int, int, np.ndarray]], window: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(anchor, context, spans) for the contexts (anchor, context, multiplicity, word hashes) of a shard."""
    flat = np.concatenate([r[3] for r in rows])
    ids = np.unique(flat, return_inverse=True)[1].tolist()
    automaton, sequences, at = Automaton(), [], 0
    for _, _, weight, h in rows:
        sequences.append(ids[at : at + len(h)])
        at += len(h)
        automaton.add(sequences[-1], weight)
    automaton.close()
    return [(a, c, spans) for (a, c, _, _), s in zip(rows, sequences, strict=True) if (spans := _spans(automaton.repeated(s, window)))]


_SPANS = "array<struct<first:int,number:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))


def _found(docs: DataFrame, window: int) -> DataFrame:
    """anchor, ctx, doc, tie, first, number: the contexts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            rows = []
            for i, text in enumerate(b.column(2).to_pylist()):
                found = contexts(word_hashes(words(text)), window)
                for p, v in zip(parts, found, strict=True):
                    p.append(v)
                rows.append(np.full(len(found[0]), i, np.int32))
            anchor, ctx, first, number = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))], names=["anchor", "ctx", "doc", "tie", "first", "number"])

    return docs.mapInArrow(run, "anchor long, ctx long, doc long, tie long, first int, number int")


def _texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, ctx, weight, big, h: the word hashes of each distinct context, taken from one document that holds it."""
    per = wanted.groupBy("rep.doc", "rep.tie").agg(F.collect_list(F.struct("anchor", "ctx", "weight", "big", "rep.first", "rep.number")).alias("all"))
    met = per.withColumnsRenamed({"doc": "d", "tie": "t"}).join(docs, F.col("d").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("tie")))
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("weight", pa.int64()), ("big", pa.bool_()), ("h", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for all_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(words(text))
                for r in all_:
                    for c, v in zip(cols, (r["anchor"], r["ctx"], r["weight"], r["big"], h[r["first"] : r["first"] + r["number"] + window - 1].tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return met.select("all", "text").mapInArrow(run, "anchor long, ctx long, weight long, big boolean, h binary").dropDuplicates(["anchor", "ctx"])


def _by_automata(shards: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("spans", _SPANS_ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = _shard(rows, window)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([[{"first": a, "number": n} for a, n in r[2]] for r in out], _SPANS_ARROW)], schema=schema)

        for group in runs(batches):
            for a, c, w, h in zip(*(group.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append((a, c, w, np.frombuffer(h, np.uint64)))
                held += len(h) >> 3
            if held >= SHARD_WORDS:
                yield flush()
                held = 0
        if rows:
            yield flush()

    dealt = shards.select("anchor", "ctx", "weight", "h").repartition(shuffle_width(shards.sparkSession), "anchor").sortWithinPartitions("anchor", "ctx")
    return dealt.mapInArrow(run, f"anchor long, ctx long, spans {_SPANS}")


def _halves(d0: int, d1: int) -> list[tuple[int, int]]:
    mid = (d0 + d1) // 2
    return [(d0, mid), (mid + 1, d1)]


def _by_halving(big: DataFrame, window: int) -> DataFrame:
    """The same for contexts of very common anchors, by halving the offsets of their windows.

    Windows whose anchor stands d0 to d1 words after their start share a core of words; a range of a context is keyed by the hash of its
    core. A key of weight 1 has no repeated window; where all ranges of a key are equal words, all their windows are repeated; other keys
    are halved, down to single windows, whose core is the window. Every step is an aggregate by key, so no task needs a key's rows.
    """
    span = window - GRAM
    schema = "anchor long, ctx long, weight long, h binary, place int, d0 int, d1 int, first int, number int, key long, sub long"

    def divide(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list] = [[] for _ in range(11)]
                for r in b.to_pylist():
                    h = np.frombuffer(r["h"], np.uint64)
                    roll, n = _Rolling(h), len(h) - window + 1
                    if whole:
                        g = gram_hashes(h, GRAM).view(np.int64)
                        place = int(np.nonzero(g == r["anchor"])[0][0])
                        ranges = [(0, span)]
                    else:
                        place, ranges = r["place"], _halves(r["d0"], r["d1"])
                    for d0, d1 in ranges:
                        lo, hi = max(0, place - d1), min(n - 1, place - d0)  # windows by their starts
                        if lo > hi:
                            continue
                        at, end = np.array([place - d0, lo]), np.array([place - d1 + window, hi + window])
                        key, sub = mix(roll.runs(at, end) + np.array([(d0 << 16) + d1, (place - lo << 16) + d1], np.uint64)).view(np.int64).tolist()
                        for c, v in zip(cols, (r["anchor"], r["ctx"], r["weight"], r["h"], place, d0, d1, lo, hi - lo + 1, key, sub), strict=True):
                            c.append(v)
                kinds = (pa.int64(),) * 3 + (pa.binary(),) + (pa.int32(),) * 5 + (pa.int64(),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        return run

    rows = written(big.select("anchor", "ctx", "weight", "h").mapInArrow(divide(True), schema), "ranges")
    done = []
    while rows.take(1):
        per = rows.groupBy("anchor", "key").agg(F.sum("weight").alias("n"), F.min("sub").alias("x"), F.max("sub").alias("y")).where("n > 1")
        per = written(per.select(F.col("anchor").alias("a"), F.col("key").alias("k"), (F.col("x") == F.col("y")).alias("same")), "keys")
        met = written(rows.join(per, (F.col("anchor") == F.col("a")) & (F.col("key") == F.col("k"))).drop("a", "k"), "ranges-met")
        done.append(met.where("same").select("anchor", "ctx", "first", "number"))
        after = written(met.where("not same").mapInArrow(divide(False), schema), "ranges")
        discard(rows)
        rows = after
    every = rows.select("anchor", "ctx", "first", "number")
    for d in done:
        every = every.unionByName(d)
    return every.groupBy("anchor", "ctx").agg(F.sort_array(F.collect_list(F.struct("first", "number"))).alias("spans"))  # at most one a window


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tie, spans: for each document with repeated windows their starts as (first, number). docs: doc, tie, text."""
    spark = docs.sparkSession
    found = written(_found(docs, window), "contexts")
    # What is joined with a hot anchor's contexts is a written table, so that both sides of the join are plain shuffles, which Spark can
    # split (or broadcasts, by its own check of the size).
    many = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1")
    many = written(many.select(F.col("anchor").alias("k"), (F.col("lo") == F.col("hi")).alias("same")), "anchors")
    again = written(found.join(many, F.col("anchor") == F.col("k")).drop("k"), "repeated")
    discard(found, many)
    release(spark)
    mixed = again.where("not same")
    distinct = mixed.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc", "tie", "first", "number")).alias("rep"))
    distinct = written(distinct, "distinct")
    size = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("of")).select(F.col("anchor").alias("k"), (F.col("of") > BIG).alias("big")), "sizes")
    texts = written(_texts(docs, distinct.join(size, F.col("anchor") == F.col("k")).drop("k"), window), "references")
    discard(distinct, size)
    release(spark)
    resolved = written(_by_automata(texts.where("not big"), window).unionByName(_by_halving(texts.where("big"), window)), "resolved")
    discard(texts)
    release(spark)
    part = mixed.join(resolved.withColumnsRenamed({"anchor": "a", "ctx": "c"}), (F.col("anchor") == F.col("a")) & (F.col("ctx") == F.col("c")))
    part = part.select("doc", "tie", F.transform("spans", lambda s: F.struct((F.col("first") + s["first"]).alias("first"), s["number"].alias("number"))).alias("spans"))
    whole = again.where("same").select("doc", "tie", F.array(F.struct("first", "number")).alias("spans"))
    # Repeated rows have equal spans: a set holds no more than one row's.
    out = written(whole.unionByName(part).groupBy("doc", "tie").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(again, resolved)
    return out


def keep_mask(n: int, found: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """True for the words that no repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for s in found or ():
        edge[s["first"]] += 1
        edge[s["first"] + s["number"] + window - 1] -= 1
    return np.cumsum(edge[:n]) == 0


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """doc, text, spans for each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), tie(F.col("text")).alias("tie"), "text")
    found = spans(base, window).withColumnsRenamed({"doc": "d", "tie": "t"})
    return base.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc", "text", "spans")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept_text (words left, joined by one space), n_words, n_removed for each row of docs(doc_id, text)."""
    return _applied(docs, window, "kept_text string", lambda kept: kept.decode("utf-8", "surrogatepass"))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text)."""
    return _applied(docs, window, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _applied(docs: DataFrame, window: int, last: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, out = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = words(text)
                if found:
                    kept = [w for w, k in zip(ws, keep_mask(len(ws), found, window).tolist(), strict=True) if k]
                else:
                    kept = ws
                n_words.append(len(ws))
                n_removed.append(len(ws) - len(kept))
                out.append(f(b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", last.split()[0]])

    return _with_spans(docs, window).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last}")
