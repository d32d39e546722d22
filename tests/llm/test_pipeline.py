"""The pipeline's contract: stages, columns and what each keeps."""

import random
from collections import Counter

from pyspark.sql import Row

import corpus_pipeline
from quarrel.llm import mixing, pii, quality, tokens


def test_stages_keep_the_contract(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids.append(docs.count())
    assert ids[1] > 0.7 * ids[0] and ids[2] <= ids[1] and ids[3] == ids[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_near_duplicates_from_80_percent_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 260))]
        for edits in (0, 3, 4, 5, 6):
            copy = list(base)
            for k in range(edits):
                copy[(k + 1) * len(base) // (edits + 1)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    sims = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    assert sum(0.8 <= v < 0.85 for v in sims.values()) > 10
    up = list(range(len(sets)))
    for (i, j), v in sims.items():
        if v >= 0.8:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {i for i, x in enumerate(up) if i == x}


def test_stages_against_plain_python_on_odd_rows(spark, sf, tmp_path):
    rng = random.Random(3)
    prose = [" ".join(rng.choice(("The", "old", "river", "runs", "by", "a", "quiet", "town", "and", "turns,", "slowly.")) for _ in range(60)) for _ in range(30)]
    texts = [None, "", " \n", "one", prose[0] * 400, "mail jo@x.example.org or 10.0.0.255 now", *prose, prose[3], prose[3] + " end"]
    rows = [(i, t, "en", ("s0", None, "s1")[i % 3], 7, "clash", "c0", 1.5, "of") for i, t in enumerate(texts)] + [(None, prose[5], "en", "s0", 1, None, None, None, None), (9, texts[9], "en", "s0", 7, "clash", "c0", 1.5, "of")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, c0 string, score double, `of` string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    keep, near, private, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in rows if model.score(quality.features(r[1])) >= quality.THRESHOLD]
    assert sorted(map(str, keep(spark, docs, sf).collect())) == sorted(str(Row(*docs.columns)(*r)) for r in want)

    kept = near(spark, docs, sf).collect()
    assert sum(r.doc_id == 9 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1
    assert {r.doc_id for r in kept if r.text in (None, "", " \n")} == {0, 1, 2} and sum(r.text == prose[3] for r in kept) == 1

    found = pii.all_spans([r[1] for r in rows], pii.default_model())
    masked = sorted(str((r[0], pii.mask(r[1], every))) for r, (_, every) in zip(rows, found, strict=True))
    clean = private(spark, docs, sf)
    assert clean.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in clean.collect()) == masked

    copies = Counter()
    for r in mixing.takes(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mix(spark, docs, sf).collect()) == +copies

    ids = Counter()
    for r in pack(spark, docs, sf).collect():
        ids[r.doc_id] += r.length
    enc = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), True)
    assert ids == sum((Counter({r[0]: len(enc.encode(r[1])) // 4 + 1}) for r in rows), Counter())

    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
