import random
from collections import Counter

import corpus_pipeline as pipeline
from graphloom.llm.decontaminate import find_items
from graphloom.llm.mixing import mix
from graphloom.llm.ngram_join import ngram_join


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "mixing"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        kept[name] = docs.count()
        if name != "mixing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            groups = ngram_join(before)
            assert kept[name] == groups.select("component_id").distinct().count()
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
        if name == "repeats":
            gone = before.join(docs, "doc_id", "left_anti").count()
            assert 0 <= gone < 0.1 * before.count()
            assert docs.where("n_chars <> length(text) and n_chars is not null").join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
        if name == "benchmark":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            hit = find_items(before, bench).where("size(hits) > 0").count()
            assert kept[name] == before.count() - hit and find_items(docs, bench).where("size(hits) > 0").count() == 0
        if name == "mixing":
            assert kept[name] == mix(before).where("taken > 0").count()
    assert kept["language"] >= 0.95 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert pipeline.run(spark, sf_dir).count() == kept["mixing"]


def windows(text):
    """The different sequences of 50 words of a text that is not very long."""
    found = text.split()
    return {tuple(found[i : i + 50]) for i in range(len(found) - 49)} if len(found) < 5000 else set()


def test_odd_rows(spark, odd, empty, sf_dir):
    rows, docs = odd
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        if name in ("repeats", "benchmark"):
            texts = {r["text"]: r["doc_id"] for r in before.collect()}
            left = docs.collect()
            assert 0 < len(left) <= len(texts)
            for r in left:  # whole rows, with their own columns; texts only lose passages
                assert r["text"] in texts or name == "repeats" and len(r["text"]) < max(len(t) for t, i in texts.items() if i == r["doc_id"])
                assert all(r[c] == "clash" for c in ("key", "n", "kept", "bucket"))
            if name == "repeats":
                seen = Counter(w for t in texts for w in windows(t))
                assert any(n > 1 for n in seen.values()) and not any(seen[w] > 1 for r in left for w in windows(r["text"]))
        if name == "mixing":
            assert all(0 < r["taken"] <= 3 * r["size"] for r in docs.collect())
        if name == "language":
            assert docs.where("not text rlike '[a-zA-Z]'").count() == 0
        if name == "near_duplicates":
            assert docs.where("doc_id is not null").count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_null_and_repeated_ids(spark, sf_dir):
    rng = random.Random(3)
    word = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    a, b, c, d, shared = word(60), word(60), word(60), word(60), word(90)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(None, a), (None, a), (5, a), (7, b), (7, c), (None, d), (None, d), (None, f"{word(50)} {shared}"), (None, f"{word(50)} {shared}"), (None, f"{word(20)} {item} {word(20)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs, sf_dir).cache()
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.collect()) == sorted((str(i), t) for i, t in {(5, a), (7, b), (7, c), (None, d), *rows[7:]})
    cut = stages["repeats"](spark, near, sf_dir).cache()
    assert cut.count() == near.count() and not any(shared in r["text"] for r in cut.collect())
    left = {r["text"] for r in stages["benchmark"](spark, cut, sf_dir).collect()}
    assert not any(item in t for t in left) and {a, b, c, d} <= left and len(left) == 6
