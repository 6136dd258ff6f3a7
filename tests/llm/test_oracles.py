"""Queries of the training-data operators against their DuckDB SQL, and the columns that their contracts name."""

import os

import duckdb
import pytest

from newsloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_neardup": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert all(types[c.split()[0]] == c.split()[1] for c in COLUMNS[name].split(", "))
    if name in ("op12_whitening", "op13_spelling"):  # rows for components and words
        return
    table = "pages" if name == "op6_warc" else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
