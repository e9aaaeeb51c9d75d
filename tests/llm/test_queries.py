"""The registered queries over the driver's smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tidelog.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
COLUMNS = {
    "op1": ["doc_id", "n_shingles", "component_id"], "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "held_out", "score", "predicted"], "op8": ["page_id", "url", "text", "n_chars"], "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}
KINDS = {"kept": "boolean", "base_failed": "boolean", "held_out": "boolean", "score": "double", "target": "double", "predicted": "int", "url": "string", "text": "string", "feature": "string"}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
    assert set(Q.queries()) | {"pipeline"} <= set(entry.queries()) and set(Q.oracle_sql()) <= set(Q.queries())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, DATA)
    kinds = dict(df.dtypes)
    want = COLUMNS.get(name.split("_")[0], [])
    assert df.columns[: len(want)] == want
    for c in want:
        assert kinds[c] == KINDS.get(c, "string" if "sha256" in c else "bigint"), c
    n = df.count()
    table = "pages" if name.startswith("op8") else "documents"
    assert n == spark.read.parquet(f"{DATA}/{table}.parquet").count() or name.startswith("op3") and n > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = Q.queries()[name](spark, DATA)
    names = sorted(mine.columns)
    want = con.sql(Q.oracle_sql()[name]).df()
    assert sorted(want.columns) == names
    key = lambda rows: sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in rows)
    assert key(mine.select(*names).collect()) == key(want[names].astype(object).itertuples(index=False, name=None))


def test_toxicity_of_held_out_texts(spark):
    """On texts that weren't learned from, at the contract's threshold."""
    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables aren't here")
    out = Q.queries()["op7_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.predicted, r.toxic): r["count"] for r in out.groupBy("predicted", "toxic").count().collect()}
    right = n.get((1, 1), 0)
    assert right / (right + n.get((1, 0), 0)) >= 0.85 and right / (right + n.get((0, 1), 0)) >= 0.75
