"""Every operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrel.llm import common, licenses, minhash, mixing, neardup_vectors, packing, pii, quality, queries, substring, tokenfile, tokens, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]


def passage(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


COMMON = passage(60)
BASE = [*passage(120).split()]
TEXTS = [None, "", "  \n", "one", "a b c", COMMON, f"{passage(20)} {COMMON} {passage(9)}", f"{COMMON} tail", "x " * 300, passage(3000), "é ü mail jo@x.example.org", "call +1 (523) 555-7040 or 10.0.0.255, 4111 1111 1111 1111"]
TEXTS += [" ".join(BASE[:i] + ["zz"] + BASE[i + 1 :]) for i in (0, 3, 60, 119)] + [" ".join(BASE)] * 3 + [passage(RNG.randint(1, 90)) for _ in range(25)]
SCHEMA = "doc_id long, text string, source string, score string, size string, n string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("s0", "s1", None)[i % 3] if i % 4 else "s0", "extra", "clash", None) for i, t in enumerate(TEXTS)]
    return [*out, out[6], (None, "no id here", "s1", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pii_base_against_plain_patterns(docs):
    def brute(text):
        text = text or ""
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub(r"\D", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return sorted(out)

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab0124 .@-+()") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    got = pii.find(docs).collect()
    assert len(got) == docs.count()
    row = next(r for r in got if r.doc_id == 11)
    assert (row.n_phone, row.n_ip, row.n_card) == (1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(pii.render(brute(TEXTS[11])).encode()).hexdigest()
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_crf_learns_its_table_and_redacts(docs, empty):
    model = pii.default_model()
    right = [pii.crf_spans([" ".join(ws)], model)[0] != [] for ws, ls in pii.labelled_table(77, 120) if set(ls) != {"O"}]
    assert sum(right) >= 0.95 * len(right)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "555" not in out.where("doc_id = 11").first().text
    assert pii.find(empty).count() == 0


def test_crf_windows_decode_as_whole_texts(monkeypatch):
    rng, model = random.Random(6), pii.default_model()
    parts = ["+1", "(523)", "555-7040", "jo@x.org,", "10.0.0.255", "4111", "1111", "a1@", "word", "Words.", "of", "7", "v1.2", "-", "=", "\"ab12\""]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    found = pii.crf_spans(texts, model)
    monkeypatch.setattr(pii, "segments", lambda text: [[m.span() for m in WORD.finditer(text)]])
    assert list(map(sorted, pii.crf_spans(texts, model))) == list(map(sorted, found)) and sum(map(len, found)) > 1000


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    emit, trans, lengths = rng.standard_normal((30, 5, 3)), rng.standard_normal((3, 3)), rng.integers(1, 6, 30)
    got = pii._viterbi(emit, trans, lengths)
    for e, n, path in zip(emit, lengths, got, strict=True):
        value = lambda p, e=e: sum(e[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))
        assert abs(value(path[:n].tolist()) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-9


def test_tokens_equal_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcÉß 01.,\n\t'$|²ªİ一’\x85<>") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["it's  we'll", "<|endoftext|>", None]
    for name, kind in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        plain = Tokenizer.from_file(tokens.vocabulary(name))
        marks = [t.content for t in plain.get_added_tokens_decoder().values()]
        assert marks
        held = [f"a {x}{m}{y} b" for m in (*marks, *map(str.upper, marks), *(m[:-1] for m in marks)) for x in ("", " ", "w", "\n") for y in ("", " ", "é", ".")]
        for t, got in zip(texts + held, tokens.Encoder(tokens.vocabulary(name), kind).batch(texts + held), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokens_look_up_a_piece_once_in_a_part(name, kind):
    class Counting(dict):
        looks = 0

        def get(self, key):
            self.looks += 1
            return super().get(key)

        def __getitem__(self, key):
            self.looks += 1
            return super().__getitem__(key)

        def keys(self):  # a walk through the whole cache
            self.looks += len(self)
            return super().keys()

    e = tokens.Encoder(tokens.vocabulary(name), kind)
    texts = ["the cat, naïve\nand été*** of the mat. " * 40 + "end"] * 50
    want = e.batch(texts)
    e.cache = Counting(e.cache)
    assert e.batch(texts) == want and e.cache.looks <= len(e.cache)
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    assert np.frombuffer(want[0], "<u4").tolist() == plain.encode(texts[0], add_special_tokens=False).ids


def test_packing_covers_every_id_once(docs, rows):
    path = tokens.vocabulary("word_bpe_49k.json")
    e = tokens.Encoder(path, True)
    want = {r[0]: e.encode(r[1]) + (1).to_bytes(4, "little") for r in rows}
    windows, seen = defaultdict(list), defaultdict(Counter)
    for p in packing.pack(docs, path).collect():
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
        windows[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id].update(range(p.start, p.start + p.length))
    copies = Counter(r[0] for r in rows)
    assert all(seen[d] == Counter({i: copies[d] for i in range(len(ids) // 4)}) for d, ids in want.items())
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_tiers_steps_and_pools():
    rng = random.Random(9)
    for pool in (40, 64, 10**6):
        packer, want = packing.Packer(3, (4, 8, 16), 32, pool), {}
        for doc in range(300):
            n = rng.choice((1, 2, 3, 5, 7, 9, 15, 16, 17, 40))
            want[doc] = bytes(rng.randbytes(4 * n))
            packer.take(doc, want[doc])
            assert packer.held < pool + 16
        packer.finish()
        windows, steps = defaultdict(list), defaultdict(set)
        for r in packer.rows().to_pylist():
            windows[r["sequence_id"]].append(r)
            steps[r["step_group"]].add((r["sequence_id"], r["tier"]))
            assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])
        short = [w for w in windows.values() if sum(r["length"] for r in w) < w[0]["tier"]]
        assert len(short) <= 1 and all(sum(r["length"] for r in w) <= w[0]["tier"] for w in windows.values())
        assert {w[0]["tier"] for w in windows.values()} == {4, 8, 16}
        for members in steps.values():  # one tier, and no more than a step's tokens
            assert len({t for _, t in members}) == 1 and sum(t for _, t in members) <= 32
        assert sum(sum(t for _, t in m) < 32 for m in steps.values()) <= 3  # an open one a tier
        assert sum(r["length"] for w in windows.values() for r in w) == sum(map(len, want.values())) // 4


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, tokens.vocabulary("word_bpe_49k.json")).count() == 0


def test_many_images_and_reads_from_any_id(spark, docs, rows, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 60_000, 5000).astype(np.uint32)
    ids[rng.integers(0, 5000, 40)] = 4_000_000_000
    image = tokenfile.Image(tokenfile.encode_image([1], np.array([5000]), ids))
    for at, n in [(0, 5000), (0, 1), (255, 2), (256, 256), (4999, 9), (5000, 3), *rng.integers(0, 5000, (60, 2)).tolist()]:
        assert (image.ids(at, n) == ids[at : at + n]).all() and len(image.ids(at, n)) == len(ids[at : at + n])
    monkeypatch.setattr(tokenfile, "IMAGE_TOKENS", 50)
    path = tokens.vocabulary("byte_bpe_50k.json")
    tokenfile.write(docs, str(tmp_path / "many"), path)
    monkeypatch.undo()
    tokenfile.write(docs, str(tmp_path / "one"), path)
    many, one = (sorted(map(str, tokenfile.digests(spark, str(tmp_path / k)).collect())) for k in ("many", "one"))
    assert many == one and len(one) == len(rows)
    assert spark.read.parquet(str(tmp_path / "many")).count() > spark.read.parquet(str(tmp_path / "one")).count()


def test_token_file_round_trip(spark, docs, rows, empty, tmp_path):
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.integers(0, 1 << rng.integers(1, 33), n, dtype=np.uint64).astype(np.uint32)
        doc_ids, counts, back = tokenfile.decode_image(tokenfile.encode_image([None, 5], np.array([n // 2, n - n // 2]), ids))
        assert doc_ids == [None, 5] and counts.tolist() == [n // 2, n - n // 2] and (back == ids).all()
    path = tokens.vocabulary("byte_bpe_50k.json")
    tokenfile.write(docs, str(tmp_path / "t"), path)
    e, at = tokens.Encoder(path, False), 0
    got = sorted(tokenfile.digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    assert len(got) == len(rows)
    for g in got:
        ids = e.encode(next(iter(texts[g.doc_id]))) + bytes(4)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += g.n_tokens
    tokenfile.write(empty, str(tmp_path / "e"), path)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_mix_targets_and_copies(docs, rows, empty):
    got = mixing.takes(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    assert sum(r["size"] for r in got) == sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= share
    of = {r[0]: r[2] for r in rows}
    assert all(abs(r.target - target[of[r.doc_id]]) < 1e-6 and r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.takes(docs.repartition(5)).collect()))
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.takes(empty).count() == 0


def test_mix_comes_near_and_draws_are_each_documents_own(spark, sf):
    got = mixing.takes(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    per = got.groupby(["target", "source_size"]).taken.sum().reset_index()
    assert len(per) > 10 and ((per.taken - per.target).abs() <= 0.02 * per.target).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.groupby(["target", "source_size"]).copies.nunique() <= 2).all()
    # A few more documents of a large source leave the draws of all others as they are.
    rows = [(i, f"w{i} " * (i % 7 + 1), "ab"[i % 5 == 0]) for i in range(3000)]
    few = {r.doc_id: r.copies for r in mixing.takes(spark.createDataFrame(rows[:-3], "doc_id long, text string, source string")).collect()}
    more = {r.doc_id: r.copies for r in mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sum(few[i] != more[i] for i in few) <= 6


def test_mix_of_long_white_space_and_repeated_rows(spark):
    gap = " \t\n" * 400_000
    rows = [(1, gap, "s", 0), (2, f"a{gap}b", "s", 0), (3, f"{gap}c\u00a0d{gap}", "t", 0), *[(4, "e f", "t", k) for k in range(20)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    began = time.time()
    got = mixing.takes(docs).collect()
    assert time.time() - began < 30
    assert {r.doc_id: r["size"] for r in got} == {1: 0, 2: 2, 3: 1, 4: 2}
    assert len({r.copies for r in got if r.doc_id == 4}) == 1
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.where("doc_id = 4").groupBy("copies").count().select("count").distinct().count() <= 1


@pytest.mark.parametrize("big", [1, 400])
def test_substrings_against_counting(docs, rows, empty, big, monkeypatch):
    monkeypatch.setattr(substring, "BIG", big)
    ws = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, ws, strict=True):
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((r[0] is not None, r[0] or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substring.digests(empty).count() == 0


def test_many_equal_rows_hold_one_rows_spans(spark):
    text = passage(200)
    rows = [(None, text)] * 2000 + [(1, text), (2, passage(80))]
    got = substring.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2002 and {(r.n_words, r.n_removed) for r in got} == {(200, 200), (80, 0)}
    base = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "xxhash64(text) AS tie", "text")
    sizes = [len(r.spans) for r in substring.spans(base).collect()]
    assert max(sizes) <= 200


def test_licenses():
    text = " ".join(VOCABULARY[:300]) + " Licensed under the Apache License, Version 2.0. " + " ".join(VOCABULARY[300:])
    assert licenses.scan(text)[0][:3] == (1.0, "Apache-2.0", 7 + 1)
    assert licenses.scan(None) == [] and licenses.scan("plain words") == []
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_vector_links_and_topk(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((260, 16)).astype(np.float32)
    base[100:130] = base[:30] + 0.15 * rng.standard_normal((30, 16))
    base[130:140] = base[5]
    data = [(i, v.tolist(), i % 3 if i < 100 else (i - 100) % 3 if i < 130 else 2 if i < 140 else i % 3) for i, v in enumerate(base)]
    data += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, data[0][1], None), (304, [], 0), (400, [None] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(v, float), lab) for i, v, lab in data if v and all(x is not None and np.isfinite(x) for x in v)]
    got = {r.vec_id: r for r in neardup_vectors.links(df, block=32).collect()}
    assert len(got) == len(data)
    up = {i: i for i, _, _ in data}
    count = Counter()
    for i, v, lab in data:
        for j, w, other in data:
            a, b = ((np.array(x, float) if x and None not in x else None) for x in (v, w))
            if i < j and lab is not None and lab == other and a is not None and b is not None and np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                count[i] += 1
                count[j] += 1
                x, y = i, j
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    for i, _, _ in data:
        x = i
        while up[x] != x:
            x = up[x]
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], x, x == i)
    best = defaultdict(list)
    for r in topk.top(df).collect():
        best[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = {i: np.floor(1024 * v).astype(np.int64) for i, v, _ in ok}
    for q in (i for i in ints if i % 100 == 0):
        want = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:10]
        assert sorted(best[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top(df.where("false")).count() == 0 and neardup_vectors.links(df.where("false")).count() == 0


def test_vectors_that_share_an_id_and_dense_units(spark, monkeypatch):
    rng = np.random.default_rng(3)
    one, two = rng.standard_normal((2, 8))
    near = lambda v: (v + 0.02 * rng.standard_normal(8)).tolist()
    data = [(5, one.tolist(), 0), (5, two.tolist(), 1), (6, near(one), 0), (9, near(two), 1), (10, near(two), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = [(5, 1, 5), (5, 2, 5), (6, 1, 5), (9, 2, 5), (10, 2, 5)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neardup_vectors.links(df).collect()) == want
    for dense in (0, 10**6):  # all units by vectors, all by pairs
        monkeypatch.setattr(neardup_vectors, "DENSE", dense)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in neardup_vectors.links(df, block=2).collect()) == want
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r.vec_id, r.score) for r in topk.top(twice).collect()) == [(1, 1, 524288)] * 2 + [(2, 2, 262144)] * 2


def test_minhash_against_all_pairs(docs, rows, empty):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = i, j
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    got = minhash.groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        x = r.doc_id
        while up[x] != x:
            x = up[x]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), x, x == r.doc_id)
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted({str(r.doc_id) for r in got if r.kept})
    assert minhash.groups(empty).count() == 0


def test_large_cluster_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FIRST_DOCS", 4)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(words[:k] + [f"q{i}"] + words[k + 1 :])) for i, k in enumerate(range(2, 150, 5))]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_rows_that_share_a_doc_id(spark):
    base = [[f"{x}{i}" for i in range(120)] for x in "ab"]
    near = [" ".join([*w[:60], "other", *w[61:]]) for w in base]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (5, ""), (7, near[0]), (8, near[1]), (9, "alone here with a few words"), (9, None)]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9)]


def test_large_cluster_of_several_parts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FIRST_DOCS", 6)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 6)
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(12)
    texts = []
    for step in range(0, 90, 6):  # a drifting text: neighbours are alike, the ends are not
        base = [f"k{i}" for i in range(step, step + 150)]
        for edits in (0, 1, 1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    up = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(up)) and 1 < len(set(up)) < 40


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas()
    got = queries.op10_nbsvm_quality(spark, big).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_features_are_the_indicators_of_whole_texts():
    bucket = lambda *ws: quality._WORDS_AT + int(quality.gram_hashes(quality.word_hashes([w.encode() for w in ws]), len(ws))[0] >> np.uint64(64 - quality._WORD_BITS))
    text = "Red red fish. " * 3 + "x" * 50_000 + " end"
    f = quality.features(text)
    words = ["red", "red", "fish.", *(["red", "red", "fish."] * 2), "x" * 50_000, "end"]
    assert set(f[f >= quality._WORDS_AT].tolist()) == {bucket(w) for w in words} | {bucket(a, b) for a, b in zip(words, words[1:], strict=False)}
    assert (np.diff(f[f >= quality._WORDS_AT]) > 0).all() and len(quality.features("")) == len(quality.features(None)) == 0


def test_solver_reaches_the_dual_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if (3 in r or 7 in r or rng.random() < 0.2) else -1.0 for r in rows])
    w, b = quality._fit(rows, y, 0.5, 400, 1)
    pos, neg = (1 + sum(np.isin(np.arange(quality.N_FEATURES), r) for r, t in zip(rows, y, strict=True) if (t > 0) == side) for side in (True, False))
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    n_pos = int((y > 0).sum())
    cost = np.where(y > 0, 0.5, 0.5 * min(10.0, n_pos / max(1, len(y) - n_pos)))

    def loss(v, c):
        margins = np.array([(v * ratio)[r].sum() / np.sqrt(len(r)) + c for r in rows])
        return (v @ v + c * c) / 2 + (cost * np.maximum(0, 1 - y * margins)).sum()

    best = np.divide(w, ratio, out=np.zeros_like(w), where=ratio != 0)
    here = loss(best, b)
    for _ in range(200):  # the loss is convex: no step nearby is lower
        step = np.zeros_like(best)
        step[:40] = rng.standard_normal(40) * 10 ** rng.uniform(-4, -1)
        assert loss(best + step, b + rng.standard_normal() * 0.01) >= here - 1e-4


def test_quality_edges(docs, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, none).count() == docs.count()
    one = spark.createDataFrame([(3, 1), (4, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert quality.accepted(docs, one).columns == docs.columns
    known = spark.createDataFrame([(i, i % 2) for i in range(37)], "doc_id long, quality int")
    scores = [r.asDict() for r in quality.score(docs.unionByName(docs), known).collect()]
    per = defaultdict(set)
    for r in scores:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        per[r["doc_id"]].add(r["score"])
    assert len(scores) == 2 * docs.count() and len(per[0] | per[1] | per[2]) <= 2
    assert quality.score(empty, one).count() == 0


def test_license_table(spark, empty):
    notice, other = "Licensed under the Apache License, Version 2.0", "Released under the MIT License"
    texts = [None, "", " \n", "plain words", notice, f"{notice}. {other}.", f"{other} {notice} {other}", "x " * 30_000 + notice + " y" * 30_000, notice.upper()]
    rows = [(i, t, "MIT", 0.5) for i, t in enumerate(texts)] + [(4, notice, "x", None), (None, other, None, None)]
    got = licenses.licensed(spark.createDataFrame(rows, "doc_id long, text string, license string, coverage double").repartition(3))
    assert got.columns == ["doc_id", "license", "coverage", "n_aligned", "licenses"]
    per = defaultdict(list)
    for r in got.collect():
        per[r.doc_id].append((r.license, r.coverage, r.n_aligned, r.licenses))
    assert per[0] == per[1] == per[2] == per[3] == [(None, 0.0, 0, "")]
    assert per[4] == [("Apache-2.0", 1.0, 8, "Apache-2.0")] * 2 and per[7] == per[8] == per[4][:1]
    assert per[5] == per[6] == [("Apache-2.0", 1.0, 8, "Apache-2.0,MIT-line")] and per[None] == [("MIT-line", 1.0, 5, "MIT-line")]
    assert licenses.licensed(empty).count() == 0


def test_repeated_notices_against_brute_force():
    rng, notice = random.Random(5), licenses.tokens("Permission granted to any person to use this work for any purpose")
    assert licenses.scan("Released under the MIT License. Released under the MIT License.")[0][:3] == (1.0, "MIT-line", 5)
    assert [licenses.scan((t + " x y z ") * 3)[0][:2] for t in ("Licensed under CC BY-NC 4.0",)] == [(1.0, "CC-BY-NC-4.0")]
    most = int(len(notice) / licenses.THRESHOLD)
    met = 0
    for _ in range(300):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [rng.choice(["to", "any", "x", "use", "y", "person"]) for _ in range(rng.randint(0, 6))]
            ws += [w for w in notice if rng.random() > rng.choice((0, 0.1, 0.3))]
        best = max((len(licenses.align(ws[i:j], notice)) for i in range(len(ws)) for j in range(i + 1, min(i + most, len(ws)) + 1)), default=0)
        got = licenses.regions(ws, notice)
        assert bool(got) == (best >= licenses.THRESHOLD * len(notice)), ws
        assert all(len(p) >= licenses.THRESHOLD * len(notice) and p[-1][0] - p[0][0] < most for p in got)
        spans = sorted((p[0][0], p[-1][0]) for p in got)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        met += len(got) > 1
    assert met > 30
    many = licenses.regions(("x " + "released under the mit license " * 2000).split(), licenses.tokens("Released under the MIT License"))
    assert len(many) == 2000 and all(len(p) == 5 for p in many)


def test_licenses_are_whole_and_of_the_right_version():
    names = lambda text: [r[1] for r in licenses.scan(text)]
    whole = {n: " ".join(t) for n, t in licenses._TEXTS.items()}
    for n, text in whole.items():
        assert licenses.scan(f"some words {text} more words")[0][:2] == (1.0, n)
        words = text.split()
        words[len(words) // 2] = "changed"
        assert licenses.scan(" ".join(words))[0][1] == n and licenses.scan(" ".join(words))[0][0] < 1
    assert names(whole["BSD-3-Clause"]) == ["BSD-3-Clause"] and names(whole["BSD-2-Clause"]) == ["BSD-2-Clause"]
    assert names("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == []
    assert names("all " + "x " * 2000 + "rights " + "y " * 2000 + "reserved") == []
    assert names("under the GNU General Public License, version 3") == ["GPL-3.0"]
    assert names("under the GNU Lesser General Public License, version 3.0") == ["LGPL-3.0"]
    for other in ("GNU Lesser General Public License, version 2.1", "GNU General Public License, version 4", "GNU Affero General Public License, version 3", "Released under the BSD License", "Licensed under CC BY-NC-ND 4.0", "Licensed under CC BY 3.0", "Licensed under the Apache License, Version 1.1", "GNU General Public License, version 2.1"):
        assert names(other) == [], other


def test_common_words_against_the_plain_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert licenses.common(a, b) == t[-1][-1] >= len(licenses.align(a, b))


def test_shapes_are_of_whole_words():
    assert pii.shape("a" * 64 + "-17") == "a-0" and pii.shape("1" * 5000 + "A") == "0A"


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (5, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = {x: x for e in edges if e[1] is not None and e[0] != e[1] for x in e}
    for _ in range(70):
        for a, b in edges:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    for few in (10_000, 5, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert {r.id: r.component for r in common.components(df).collect()} == up
    assert common.components(df.where("false")).count() == 0
