"""MinHash signatures of feature sets, band tables, candidates and their verification.

items(id, features) hold an array of distinct texts. Signatures are of HASHES values, minima over the features of seeded hashes of 64 bits; bands of
ROWS values each are the keys of band tables. Items of equal features are one class before they are banded, so a group of copies makes no
pairs; what is alike and not equal is paired in its bands, each pair once. A cap on followers in a band exists for those who want it (it
loses pairs and is off). similar_pairs() compares all items that share a feature unless it is told to look at bands, at any number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrel.operators import setjoin
from quarrel.operators.similarity import jaccard
from quarrel.plans import written

HASHES, ROWS, SEED = 128, 4, 0x5EED
_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # fixed values: of FNV-1a with 64 bits


def fnv1a(texts: list[str]) -> np.ndarray:
    """FNV-1a hashes of the UTF-8 bytes of texts, all texts a byte at a time."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.full(len(raw), _OFFSET, np.uint64)
    size = np.array([len(r) for r in raw], np.int64)
    flat, start = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1]
    for i in range(int(size.max(initial=0))):
        on = np.nonzero(size > i)[0]
        out[on] = (out[on] ^ flat[start[on] + i]) * _PRIME
    return out


def hash_functions(n: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of n functions x -> ((a x) xor b) + (a + b)."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(features: list[str], n: int = HASHES) -> np.ndarray:
    """Minima of n functions over the features' hashes; zeros of no features."""
    return minima(fnv1a(features), n) if features else np.zeros(n, np.uint64)


def minima(x: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The same of hashes, of which there is one at least."""
    a, b = hash_functions(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (((a[:, None] * x[None, at : at + 4096]) ^ b[:, None]) + (a + b)[:, None]).min(1))
    return low


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """The share of equal places."""
    return float((x == y).mean())


def signatures(items: DataFrame, n: int = HASHES) -> DataFrame:
    """id, features, signature (array of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(f or [], n).view(np.int64) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "features", "signature"])

    return items.select("id", "features").mapInArrow(run, "id long, features array<string>, signature array<long>")


def bands(signed: DataFrame, n_bands: int = HASHES // ROWS, rows: int = ROWS) -> DataFrame:
    """id, band, key for signed(id, signature): as many bands as the signature has rows for, n_bands at most."""
    count = F.least(F.lit(n_bands), F.floor(F.size("signature") / rows).cast("int"))
    keys = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, F.lit(rows))).alias("key")))
    return signed.where(F.size("signature") >= rows).select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.key")


def candidates(banded: DataFrame, followers: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a band's key. followers: at most so many later ids for each id of a bucket (none is no bound)."""
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written(banded.join(shared, ["band", "key"]), "buckets")
    if followers is not None:
        met = met.withColumn("place", F.row_number().over(Window.partitionBy("band", "key").orderBy("id")))
        near = (F.col("q") > F.col("p")) & (F.col("q") <= F.col("p") + followers)
        pairs = met.select("band", "key", F.col("id").alias("a"), F.col("place").alias("p")).join(met.select("band", "key", F.col("id").alias("b"), F.col("place").alias("q")), ["band", "key"]).where(near)
    else:
        pairs = met.select("band", "key", F.col("id").alias("a")).join(met.select("band", "key", F.col("id").alias("b")), ["band", "key"]).where("a < b")
    return pairs.select("a", "b").distinct()


def use_bands(n_items: int, exhaustive: int, mode: str = "auto") -> bool:
    """on, off, or by whether all pairs are more than `exhaustive`: for callers that choose; similar_pairs() does not look at the number."""
    if mode not in ("on", "off", "auto"):
        raise ValueError(f"no such mode: {mode}")
    return mode == "on" or (mode == "auto" and n_items * (n_items - 1) // 2 > exhaustive)


def similar_pairs(items: DataFrame, threshold: float, prefilter: float = 0.1, mode: str = "off") -> DataFrame:
    """a, b, similarity of pairs of classes of equal features whose Jaccard similarity reaches the threshold (and the prefilter), and of each
    class's least id with its other members (1.0). Items without features pair with nothing. Off: complete, by what is counted for each pair of
    classes that share a feature; on: of classes that share a band, which can miss some. The number of items decides nothing."""
    if mode not in ("on", "off"):
        raise ValueError(f"no such mode: {mode}")
    level = max(threshold, prefilter)
    some = items.where(F.size("features") > 0).withColumn("features", F.sort_array(F.array_distinct("features")))
    keyed = written(some.select("id", "features", F.sha2(F.concat_ws("\0", "features"), 256).alias("digest")), "features")
    least = keyed.groupBy("digest").agg(F.min("id").alias("a"))
    equal = keyed.join(least, "digest").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    first = written(keyed.join(least.select("digest", F.col("a").alias("id")), ["digest", "id"], "left_semi").select("id", "features").dropDuplicates(["id"]), "classes")
    if mode == "off" and level > 0:
        each = first.select("id", F.size("features").alias("n"), F.explode("features").alias("f"))
        side = lambda c: each.select("f", F.col("id").alias(c), F.col("n").alias(f"n{c}"))
        met = side("a").join(side("b"), "f").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
        found = met.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))
        return equal.union(found.where(F.col("similarity") >= level))
    if mode == "on":
        pairs = candidates(bands(signatures(first)))
    else:  # at 0 classes that share nothing are pairs too
        ids = first.select(F.col("id").alias("a"))
        pairs = ids.join(ids.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    size = lambda c: F.size(c).cast("double")
    met = pairs.join(first.withColumnsRenamed({"id": "a", "features": "x"}), "a").join(first.withColumnsRenamed({"id": "b", "features": "y"}), "b")
    met = met.where(F.least(size("x"), size("y")) >= level * F.greatest(size("x"), size("y")) - 1e-9)
    return equal.union(met.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= level))


def similar_texts(items: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, similarity: similar_pairs() with bands for items(id, text), a feature being a run of k words. Features stay hashes in arrays, and
    those of texts that share a band alone are made a second time, to be compared. A band's key of many texts chains them by size, and all
    pairs of a chain's component are compared: more than share a band."""
    spark, buckets = items.sparkSession, setjoin.width(items.sparkSession)
    number = np.arange(HASHES // ROWS, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, digests, n, keys = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                s = setjoin.run_set(setjoin.words(text), k)
                if len(s):
                    low, key = minima(s).reshape(-1, ROWS), number
                    for r in range(ROWS):
                        key = setjoin.mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
                    keep.append(i)
                    digests.append(setjoin.set_digest(s))
                    n.append(len(s))
                    keys.append(key.tobytes())
            nodes = pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64), pa.int64())
            columns = [b.column(0).take(pa.array(keep, pa.int32())), pa.array(digests, pa.binary()), nodes, pa.array(n, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "node", "n", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield setjoin.packed([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(2)], b.column(0).to_numpy(), b.column(1).to_numpy(), buckets, 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in setjoin.groups(batches):
            yield setjoin.meetings(t, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = lambda c, b=b: [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)]
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(of(2), of(3), strict=True)]
            sizes = [pa.array([len(x) for x in of(c)], pa.int64()) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), *sizes], names=["a", "b", "shared", "na", "nb"])

    known = items.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("t"))
    signed = written(known.mapInArrow(sign, "id long, digest binary, node long, n long, keys binary"), "signed")
    first = written(signed.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("node", "n", "keys")]), "classes")
    equal = signed.select("id", "digest").distinct().join(first.select("digest", F.col("id").alias("a")), "digest").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    met = setjoin.dealt(first.select("node", "n", "keys").mapInArrow(pack, setjoin.PACKED)).mapInArrow(meet, "a long, b long, na long, nb long, met long")
    edges = written(met.groupBy("a", "b").agg((F.max("met") >= setjoin.CHAINED).alias("chained")), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    sets = written(setjoin.sets_of(items, first.select("id", "digest", "node").join(nodes, "node", "left_semi"), k, by_set=True), "sets")
    setjoin.release(spark)
    whole = setjoin.verified(sets, edges.where("chained").select("a", "b"), percent)
    side = lambda p: sets.select(F.col("node").alias(p), F.col("id").alias(f"{p}_id"), F.col("s").alias(f"{p}_s"))
    both = edges.where("not chained").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a_id", "b_id", "a_s", "b_s")
    single = both.mapInArrow(compare, "a long, b long, shared long, na long, nb long").where(f"a <> b and 100 * shared >= {percent} * (na + nb - shared)")
    single = single.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "na", "nb")
    found = whole.union(single).dropDuplicates(["a", "b"])
    return equal.union(found.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity")))


_QUOTED_OR_SPACE = re.compile(r"""("(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)|[ \t\n\r\f]+""", re.S)
_WORD_BYTE = re.compile(r"[A-Za-z0-9_$\u0080-\U0010ffff]")


def code_text(text: str) -> str:
    """Source text without white space outside quotes, but for one space where it parts two words; quoted text stays as it is."""

    def part(m: re.Match) -> str:
        if m[1]:
            return m[1]
        around = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        return " " if all(_WORD_BYTE.match(c) for c in around) else ""

    return _QUOTED_OR_SPACE.sub(part, text)


def code_digest(text: str) -> str:
    """FNV-1a of code_text as 16 hexadecimal digits; '' of empty text. Equal digests are copies of the first kind."""
    flat = code_text(text)
    return f"{int(fnv1a([flat])[0]):016x}" if flat else ""


def code_digests(items: DataFrame) -> DataFrame:
    """id, digest of items(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([code_digest(t or "") for t in b.column(1).to_pylist()], pa.string())], names=["id", "digest"])

    return items.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, digest string")
