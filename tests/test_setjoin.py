"""The complete search for alike sets against brute force, and how much of the work its first step leaves."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarrel.operators import setjoin, similarity


def corpus():
    """Texts with near copies of every degree, a group of many near copies, a passage of many texts, short and odd ones."""
    rng, rows = random.Random(5), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    changed = lambda ws, share: [w if rng.random() > share else f"v{rng.randrange(10**9)}" for w in ws]
    passage = fresh(30)
    for i in range(60):
        base = fresh(rng.choice((12, 40, 120)))
        rows.append(" ".join(base))
        if i % 2:
            rows += ["  ".join(changed(base, i / 700)).upper() for _ in range(3)]
    rows += [" ".join(passage + fresh(rng.choice((4, 12, 60)))) for _ in range(80)]
    hub = fresh(90)
    rows += [" ".join(changed(hub, 0.02)) for _ in range(150)]
    rows += [rows[0], rows[0].upper(), "a b", " a\tb ", "", " \n", None, "a b c d", "a b c e", "É ǅ b c d", "é ǆ b c d"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(1000 + 7 * i, rows[k]) for i, k in enumerate(order)]


def brute(rows, k, percent):
    norm = {i: tuple(t.lower().split()) for i, t in rows if t and t.split()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    out = {(first[ws], i): 1.0 for i, ws in norm.items() if first[ws] != i}
    sets = {i: {ws[j : j + k] for j in range(len(ws) - k + 1)} for ws, i in first.items() if len(ws) >= k}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - shared
            if 100 * shared >= percent * union:
                out[a, b] = round(min(shared / union, 0.85 - 1e-12), 6)
    return out


@pytest.mark.parametrize("block", [128, 20])
def test_copies_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK_SETS", block)
    rows = corpus()
    want = brute(rows, 4, 65)
    got = similarity.copies(spark.createDataFrame(rows, "id long, text string").repartition(5)).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 5000
    assert all((r.kind == 1) == (r.similarity == 1.0) for r in got)


def test_rows_that_share_an_id_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "quite another text of some words"), (2, text + " end"), (3, text.upper()), (None, text)]
    got = similarity.copies(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted((r.a, r.b, r.kind) for r in got) == [(1, 2, 2), (1, 3, 1)]
    assert similarity.copies(spark.createDataFrame([], "id long, text string")).count() == 0


def test_most_texts_are_settled_before_any_is_paired(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id id", "text")
    rows = [(i, f"{j} ".join(f"u{i}x{k}" for k in range(150))) for j, i in enumerate(range(10_000, 10_400))]
    _, left = setjoin.classes(docs.union(spark.createDataFrame(rows, "id long, text string")), 4, 65)
    assert {r.id for r in left.collect()}.isdisjoint(i for i, _ in rows)


def test_meetings_pair_few_and_chain_many():
    def packed(sets):
        s = [np.array(sorted(x), np.uint64) for x in sets.values()]
        return pa.Table.from_batches([setjoin.packed(s, np.array(list(sets)), np.array([len(x) for x in s]), 1, 1.0)])

    got = setjoin.meetings(packed({5: [1, 2, 3], 6: [2, 3, 4], 7: [9, 10, 11], 8: [3] + list(range(20, 40))}), 65).to_pylist()
    assert got == [{"a": 5, "b": 6, "na": 3, "nb": 3, "met": 2}]
    many = {i: [7, *range(100 * i + 100, 100 * i + 105 + i % 2)] for i in range(setjoin.FEW + 1)}
    got = setjoin.meetings(packed(many), 65).to_pylist()
    assert len(got) == setjoin.FEW and all(r["met"] == setjoin.CHAINED for r in got)


def test_first_runs_meet_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        both = rng.integers(0, 2**62, 2 * n).astype(np.uint64)
        a, b = np.unique(both[:n]), np.unique(np.concatenate([both[: int(np.ceil(0.65 * n))]]))
        many = np.unique(rng.choice(a, len(a) // 2))
        place = rng.permutation(len(many))
        assert len(np.intersect1d(setjoin.first_runs(a, many, place, 65), setjoin.first_runs(b, many, place, 65)))


ON_COPIES = [
    "clone_filter",
    "pair_checks",
    "merged_clone_statistics",
    "group_star",
    "group_members_maximal",
    "group_leader",
    "group_k_core",
    "group_facts",
    "group_connected",
    "group_complete_linkage",
    "group_centroid",
    "clone_statistics",
    "clone_kinds",
]


@pytest.fixture(scope="module")
def once():
    """The search, whose tables serve all tests that follow the first."""
    kept, alike = [], setjoin.alike
    return lambda *a: kept[0] if kept else kept.append(alike(*a)) or kept[0]


@pytest.mark.parametrize("name", ON_COPIES)
def test_queries_on_copies_search_by_set_join(spark, sf, monkeypatch, once, name):
    """Without the pairs of an earlier query, each searches by setjoin, once."""
    from quarrel.plans import analyses, bindings

    calls = []
    monkeypatch.setattr(analyses, "_FOUND", {})
    monkeypatch.setattr(setjoin, "alike", lambda *a: calls.append(a[1:]) or once(*a))
    assert bindings.QUERIES[name](spark, sf).columns and calls == [(4, 65)]
