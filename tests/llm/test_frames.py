import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import frames
from tidelog.llm import kernels as K


@pytest.mark.parametrize("most", [0, 1000])
def test_without(spark, most):
    docs = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (None, "a", 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, _key int")
    gone = docs.where("text = 'a' or doc_id is null").select("doc_id", frames.same_text().alias("_same"))
    left = frames.without(docs, gone, most=most)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "b"), (2, "")]


@pytest.mark.parametrize("most", [0, 1000])
def test_join_small(spark, most):
    left, right = spark.range(5).toDF("k"), spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert sorted((r.k, r.v) for r in frames.join_small(left, right, ["k"], most=most).collect() if r.v) == [(1, "x"), (3, "y")]


def test_written_tables_lie_in_the_shared_folder(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    df = frames.written(spark.range(3))
    assert all(f.startswith(top) for f in df.inputFiles()) and df.count() == 3
    frames.discard(df)
    assert spark.sparkContext.applicationId in frames._folders
    frames.sweep(spark)
    assert not frames._folders


def test_new_columns_replace_kept_ones(spark):
    docs = spark.createDataFrame([(1, "ab", "old", 9)], "doc_id long, text string, n string, other int")
    out = frames.map_text(docs, lambda: lambda data, offsets, rows: [np.diff(offsets)], "n bigint", ("doc_id", "n", "text"))
    assert out.columns == ["doc_id", "text", "n"] and tuple(out.first()) == (1, "ab", 2)


texts = st.lists(st.none() | st.text(alphabet="ab é☃\n\t\x1c\x85 ", max_size=12), min_size=1, max_size=20)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_of_chunks(column, limit):
    """Words don't depend on how a column is cut, and hashes not on where a word lies."""
    got, seen = [], {}
    for a, b, data, offsets in K.chunks(pa.array(column, pa.string()), limit):
        start, end, row = K.words(data, offsets)
        for s, e, r, h in zip(start, end, row, K.word_hashes(data, start, end, True)):
            word = data[s:e].tobytes().decode()
            got.append((a + int(r), word))
            assert seen.setdefault(word, h) == h
    import re

    assert got == [(k, w) for k, t in enumerate(column) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(set(seen.values())) == len(seen)


def test_slices_of_columns():
    whole = pa.chunked_array([pa.array(["a", None, "b c"]), pa.array(["d e f"])])
    found = [(a, b, data.tobytes()) for a, b, data, _ in K.chunks(whole.slice(1))]
    assert found == [(0, 3, b"b cd e f")] and list(K.chunks(pa.array([], pa.string()))) == []


def test_distinct_is_in_order():
    row, values = K.distinct(np.array([0, 0, 2, 2, 0]), np.array([5, 3, 9, 9, 5], np.uint64))
    assert row.tolist() == [0, 0, 2] and values.tolist() == [3, 5, 9]


def test_same_text_takes_null_for_empty(spark):
    a, b = spark.createDataFrame([(None,), ("",)], "text string").select(frames.same_text().alias("h")).collect()
    assert a.h == b.h
