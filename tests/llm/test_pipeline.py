"""The pipeline's stages, one after another, against plain versions on the fixture."""

import collections
import random

import corpus_pipeline
from lexloom.llm import lm, mixing, near_dups, packing, pii, quality, suffixes

from .test_llm import plain_components, plain_spans, rows


def test_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    whole.write.parquet(f"{folder}/documents.parquet")
    steps, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        steps[name] = now = spark.read.parquet(f"{folder}/{name}")
        assert name == "pack" or now.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in rows(df)}
    good = text(steps["quality_rules"])
    assert set(good) == {r["doc_id"] for r in rows(quality.assess(whole)) if r["kept"]}
    comp = plain_components(good, 5, 80)[1]
    single = text(steps["near_duplicates"])
    assert set(single) == {i for i, c in comp.items() if i == c}
    clean = text(steps["personal_data"])
    assert set(clean) == set(single)
    for i, t in single.items():
        spans = plain_spans(t)
        assert (clean[i] == t) == (not any(spans.values()))
        assert all(t[a:b] not in clean[i] for s in spans.values() for a, b in s)
    taken = text(steps["mix_sources"])
    assert set(taken) == {r["doc_id"] for r in rows(mixing.mixed(steps["personal_data"])) if r["sampled"]} and taken.items() <= clean.items()
    encode = packing.encoder(packing.vocabulary_path())
    lengths = collections.Counter()
    for r in rows(steps["pack"]):
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(encode.whole(t)) // 4 + 1 for i, t in taken.items()}


def test_run_gives_the_last_stage(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_odd_rows(spark, docs, none):
    """Null and repeated keys, nulls in all columns, clashing names; and an empty table."""
    odd = docs.unionByName(docs.where("doc_id is null")).unionByName(docs.where("doc_id = 30").selectExpr("doc_id", "concat(text, ' and a tail of other words that make it no copy') text", "null lang", "null source", "null n_chars", "n_words", "key", "kept", "at"))
    sizes = {}
    for rows_, name_of_all in ((odd, "odd"), (none, "none")):
        now = rows_
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            sizes[name_of_all, name] = now.count()
            if name != "pack":
                assert now.columns == docs.columns
    assert not any(n for (which, _), n in sizes.items() if which == "none")
    judged = quality.assess(odd).where("kept").count()
    assert sizes["odd", "quality_rules"] == judged
    good = quality.keep_good(odd)
    single = near_dups.keep_one(good, k=5, percent=80)
    keys = [r["doc_id"] for r in single.select("doc_id").collect()]
    assert len([k for k in keys if k is not None]) == len({k for k in keys if k is not None})  # a key stays once
    assert keys.count(None) == good.where("doc_id is null").count()  # rows without a key are never copies
    assert sizes["odd", "personal_data"] == sizes["odd", "near_duplicates"] == len(keys)
    assert 0 < sizes["odd", "mix_sources"] <= len(keys) and sizes["odd", "pack"] >= sizes["odd", "mix_sources"]


def test_very_long_texts(spark):
    """Whole texts of two megabytes through every operator on texts."""
    rng = random.Random(31)
    words = [f"w{rng.randrange(10**9):x}" for _ in range(3000)]
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(rng.choice(words) for _ in range(200_000))
    texts = {1: f"{long} {passage} a.b@example.org", 2: f"short {passage} end", 3: " ".join(rng.choice(words) for _ in range(40))}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    one = lambda out: {r["doc_id"]: r for r in rows(out)}
    n = {i: len(t.split()) for i, t in texts.items()}
    assert {i: r["n_words"] for i, r in one(quality.assess(df)).items()} == n
    assert {(r["doc_id"], r["n_words"]) for r in rows(suffixes.repeated_spans(df))} == {(1, 60), (2, 60)}
    start = len(texts[1]) - len("a.b@example.org")
    assert one(pii.detect(df))[1]["spans"] == f"email:{start}:{len(texts[1])}"
    assert {i: r["n_tokens"] for i, r in one(lm.score(df)).items()} == {i: x + 1 for i, x in n.items()}
    encode = packing.encoder(packing.vocabulary_path())
    total = collections.Counter()
    for r in rows(packing.pack(df)):
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(encode.whole(t)) // 4 + 1 for i, t in texts.items()}
    assert one(near_dups.near_duplicates(df, 4, 80))[1]["n_shingles"] == n[1] - 3
