from graphloom.llm.common import id_remainder
from graphloom.llm.langid import UNKNOWN, has_letter, identify, train


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = id_remainder("doc_id", 5) == 0
    model = train(docs.where(~held))
    rows = identify(docs, model, ("doc_id", "lang")).where(held).collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    model_again = train(docs.where(~held))
    assert (model.table == model_again.table).all() and model.threshold == model_again.threshold


def test_odd_rows(odd, empty):
    rows, docs = odd
    model = train(docs)
    found = identify(docs, model, tuple(docs.columns), "__")
    assert found.columns == [*docs.columns, "__lang_pred", "__score", "__rejected"]
    got = found.select("text", "__lang_pred", "__rejected").collect()
    assert len(got) == len(rows)
    for text, pred, rejected in got:
        assert (pred == UNKNOWN) == (not text or not any(c.isalpha() for c in text))
        assert pred != UNKNOWN or rejected
    none = train(empty)
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {UNKNOWN}
    assert identify(empty, model).count() == 0


def test_letters():
    import numpy as np

    look = lambda t: has_letter(np.frombuffer(t.encode(), np.uint8))
    assert look("a") and look("中") and look("1 é") and not look("12 — !") and not look("")


FOREIGN = [
    "O menino foi para a escola com os seus amigos e depois voltou para casa muito cansado",
    "De jongen ging met zijn vrienden naar school en kwam daarna moe weer naar huis",
    "Băiatul a mers la școală cu prietenii lui și apoi s-a întors acasă foarte obosit",
    "Anak itu pergi ke sekolah bersama teman-temannya dan kemudian pulang dengan lelah",
    "Pojken gick till skolan med sina vänner och kom sedan hem mycket trött",
    "java.lang.NullPointerException at org.apache.spark.sql.Dataset.collect(Dataset.scala:123)",
    "Мальчик пошёл в школу со своими друзьями, а потом вернулся домой",
]


def test_languages_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_remainder("doc_id", 5) == 0
    foreign = spark.createDataFrame([(i, " ".join([t] * 3)) for i, t in enumerate(FOREIGN)], "doc_id long, text string")
    for known in (["en"], ["de", "en"], ["de", "en", "es", "fr"]):
        own = docs.where(docs.lang.isin(known))
        model = train(own.where(~held))
        assert all(r["rejected"] for r in identify(foreign, model, prefix="").collect())
        rows = identify(own.where(held), model).collect()
        assert sum(r["rejected"] for r in rows) <= 0.03 * len(rows)
