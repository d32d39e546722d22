"""Signatures, bands and candidates against their definitions, and the search against all pairs."""

import random

import numpy as np
import pytest

from quarrel.operators import sketch


def test_fnv_and_signatures():
    def plain(text):
        h = 0xCBF29CE484222325
        for c in text.encode():
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h

    words = ["", "a", "foobar", "é", "x" * 300]
    assert sketch.fnv1a(words).tolist() == [plain(w) for w in words]
    assert sketch.fnv1a(["a"])[0] == 0xAF63DC4C8601EC8C
    a, b = (v.tolist() for v in sketch.hash_functions(5))
    want = [min((((p * plain(w)) ^ q) + p + q) % 2**64 for w in words) for p, q in zip(a, b, strict=True)]
    assert sketch.signature(words, 5).tolist() == want and (a == np.array(a)).all()
    assert (sketch.signature(["x", "y"]) == sketch.signature(["y", "x", "x"])).all()
    assert not sketch.signature([]).any() and sketch.estimate(sketch.signature([]), sketch.signature([])) == 1.0
    x, y = ([f"f{i}" for i in range(k, k + 300)] for k in (0, 100))
    assert abs(sketch.estimate(sketch.signature(x, 1024), sketch.signature(y, 1024)) - 0.5) < 0.06


def test_bands_and_caps(spark):
    signed = spark.createDataFrame([(1, list(range(8))), (2, [*range(4), 9, 9, 9, 9]), (3, list(range(8))), (4, [1, 2, 3])], "id long, signature array<long>")
    banded = sketch.bands(signed, 5, 4)
    assert banded.groupBy("id").count().orderBy("id").collect() == [(1, 2), (2, 2), (3, 2)]
    pairs = lambda n=None: sorted(tuple(r) for r in sketch.candidates(banded, n).collect())
    assert pairs() == [(1, 2), (1, 3), (2, 3)] and pairs(1) == [(1, 2), (1, 3), (2, 3)] and pairs(0) == []
    assert [sketch.use_bands(n, 10, m) for n, m in ((5, "auto"), (6, "auto"), (2, "on"), (99, "off"))] == [False, True, True, False]
    with pytest.raises(ValueError):
        sketch.use_bands(1, 1, "maybe")


def test_search_finds_what_all_pairs_do(spark):
    rng, rows = random.Random(1), []
    for base in range(12):
        features = [f"b{base}-{i}" for i in range(60)]
        for _ in range(5):
            rows.append((len(rows), [f if rng.random() > 0.03 * base / 4 else f"n{rng.random()}" for f in features]))
    rows += [(900, []), (901, None), (902, rows[3][1]), (903, rows[3][1][::-1])]
    items = spark.createDataFrame(rows, "id long, features array<string>")
    sets = {i: frozenset(f) for i, f in rows if f}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    sim = lambda x, y: len(x & y) / len(x | y)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and sim(x, y) >= 0.7} | {(first[s], i) for i, s in sets.items() if first[s] != i}
    found = {m: {(r.a, r.b) for r in sketch.similar_pairs(items, 0.7, mode=m).collect()} for m in ("on", "off")}
    assert found["off"] == want and found["on"] <= want and len(found["on"]) >= 0.95 * len(want)


def test_search_is_complete_at_any_number(spark):
    """More than 10,000 pairs, most of them far under what bands find."""
    rng = random.Random(4)
    rows = [(i, sorted({f"w{rng.randrange(400)}" for _ in range(40)})) for i in range(170)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    items = spark.createDataFrame(rows, "id long, features array<string>")
    sets = {i: set(f) for i, f in rows}
    want = {(a, b) for a in range(170) for b in range(a + 1, 170) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.03} | {(i, 1000 + i) for i in range(5)}
    got = [(r.a, r.b) for r in sketch.similar_pairs(items, 0.03, prefilter=0).collect()]
    assert set(got) == want and len(got) == len(want) > 10_000
    few = sketch.similar_pairs(items.where("id < 4"), 0, prefilter=0).collect()
    assert len(few) == 6
    with pytest.raises(ValueError):
        sketch.similar_pairs(items, 0.5, mode="auto")


def test_code_without_white_space(spark):
    assert sketch.code_text("return  a +\tb ;\n x = 'a  b' + `c\n d` ") == "return a+b;x='a  b'+`c\n d`"
    assert sketch.code_digest(" \n") == "" and sketch.code_digest("a ;b") == sketch.code_digest("a; b") != sketch.code_digest("ab")
    got = sketch.code_digests(spark.createDataFrame([(1, "f ( x )"), (2, "f(x)"), (3, None)], "id long, text string")).collect()
    assert got[0].digest == got[1].digest and len(got[0].digest) == 16 and got[2].digest == ""


def test_texts_by_bands(spark):
    """Nearly all alike texts and no others, among them a group that one key chains; no feature is kept as text."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    changed = lambda ws, share: [w if rng.random() > share else f"v{rng.randrange(10**9)}" for w in ws]
    texts = [" ".join(changed(base, 0.002 * i)) for i in range(40) for base in [fresh(100)] for _ in range(4)]
    hub = fresh(120)
    texts += [" ".join(changed(hub, 0.004)) for _ in range(60)]
    rows = [(10 + 3 * i, t) for i, t in enumerate(texts)] + [(1, texts[0].upper()), (2, "a b"), (3, ""), (4, None), (None, texts[1])]
    sets = {i: frozenset(tuple(t.lower().split()[j : j + 4]) for j in range(len(t.split()) - 3)) for i, t in rows if i and t and len(t.split()) > 3}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    sim = lambda x, y: len(x & y) / len(x | y)
    want = {(a, b): round(sim(x, y), 6) for x, a in first.items() for y, b in first.items() if a < b and sim(x, y) >= 0.65}
    want |= {(first[s], i): 1.0 for i, s in sets.items() if first[s] != i}
    got = sketch.similar_texts(spark.createDataFrame(rows, "id long, text string").repartition(3), 4, 65).collect()
    found = {(r.a, r.b): round(r.similarity, 6) for r in got}
    assert len(got) == len(found) >= 0.98 * len(want) and found.items() <= want.items()
