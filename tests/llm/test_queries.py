"""The registered queries against their SQL, and what each must return."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlab.llm import queries

TABLES = "documents benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compared(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str), want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = compared(spark, name, "/root/testdata/sf0.001")
    assert len(got) == len(want)
    assert got == want


def test_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())


CONTRACTS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_mixture": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_of_the_contract(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) | CONTRACTS[name] == dict(df.dtypes)


def test_documents_get_one_row_each_and_pairs_name_documents(spark):
    path = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    near = queries.op1_neardup(spark, path).collect()
    assert sorted(r.doc_id for r in near) == sorted(ids) and {r.class_id for r in near} <= ids
    assert {r.doc_id for r in queries.op3_licenses(spark, path).collect()} <= ids
