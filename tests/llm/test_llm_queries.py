import os

import duckdb
import pytest

from graphloom.llm import queries

# What each query returns first, and the table of which it has a row each.
CONTRACT = {
    "op1_license_scan": ("documents", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"),
    "op2_suffix_dedup": ("documents", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_bytes bigint"),
    "op3_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op4_decontamination": ("documents", "doc_id bigint, n_items bigint, item_ids string, similarity double, contaminated boolean"),
    "op5_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op6_embedding_near_dedup": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op7_ngram_jaccard_join": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint"),
    "op8_html_extraction": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op9_chat_formatting": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op10_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, sf_dir, name):
    table, columns = CONTRACT[name]
    found = queries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == columns
    rows = found.collect()
    if table:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name == "op10_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op9_chat_formatting":
        assert [r["n_turns"] for r in rows if r["conv_id"] == -1] == [2]


def test_every_operator_is_registered():
    assert set(queries.QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{sf_dir}/{table}'")
    found = queries.QUERIES[name](spark, sf_dir)
    rows = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(rows.fetchall(), key=str)
