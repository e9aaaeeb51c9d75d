"""The entry module, its queries against SQL, and the repository without the optional operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidelog.plans import queries as engine

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


@needs_data
@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine = entry.queries()[name](spark, DATA)
    names = sorted(mine.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in mine.collect())
    want = duck.sql(engine.oracle_sql()[name]).df()
    assert sorted(want.columns) == names
    assert rows == sorted(repr(tuple(plain(v) for v in r)) for r in want[names].astype(object).itertuples(index=False, name=None))


@needs_data
def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() > 0
    for name in sorted(set(engine.queries()) - set(engine.oracle_sql())):
        assert entry.queries()[name](spark, DATA).count() > 0
    flushed = engine.queries()["flush_by_distinct_keys"](spark, DATA).collect()
    full = {}
    for r in flushed:
        full.setdefault(r.shard, []).append((r.container_id, r["keys"]))
    assert all(k == 32 for rows in full.values() for _, k in sorted(rows)[:-1])


@needs_data
def test_string_hashes(spark):
    from tidelog.functions.hashing import murmur3_of
    from tidelog.functions.msgpack import pack

    assert all(r.key_hash == murmur3_of(pack(r.c_name)) for r in engine.queries()["key_hash_string"](spark, DATA).collect())


def test_without_the_optional_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'live_by_key' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})


def test_broken_operators_are_not_hidden(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    if not (tmp_path / "repo/tidelog/llm").is_dir():
        pytest.skip("the optional operators aren't here")
    (tmp_path / "repo/tidelog/llm/queries.py").write_text("import tidelog.no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode and "no_such_module" in done.stderr


def test_only_the_entry_knows_the_optional_operators():
    for path in (REPO / "tidelog").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path
