"""run() against the same stages on plain Python lists, from a small table."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import jaccard, mixing, perplexity, pieces, quality
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b for a in ("riv", "ston", "bridg", "wint", "summ", "gard") for b in ("er", "e", "ing", "al", "en", "s")]
    rows = []
    for i in range(260):
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(60, 90))), "en", f"src{i % 4}"))
    for i in range(260, 300):  # near copies
        w = rows[i - 260][1].split()
        w[-1] = "changed"
        rows.append((i, " ".join(w), "en", "src0"))
    rows += [(300 + k, "".join(rng.choices("$%&QZX |", k=500)), "en", "src1") for k in range(8)]
    rows += [(320, None, "en", None), (321, "", None, "src2"), (322, "too short", "en", "src2"), (323, "again and again " * 40, "en", "src3")]
    top = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 260, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, docs


def test_stages_and_columns(spark, folder):
    top, docs = folder
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, top).columns == docs.columns


def test_run(spark, folder):
    top, docs = folder
    labels = spark.read.parquet(f"{top}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    # 1 and 2: verdicts of the two operators, on all that came before
    left = {r.doc_id for r in perplexity.verdicts(docs, labels).where("kept").collect()}
    assert not left & {*range(300, 308), 320, 321} and left >= set(range(250))
    mine = docs.where(F.col("doc_id").isin(sorted(left)))
    left = {r.doc_id for r in quality.verdicts(mine).where("kept").collect()}
    assert not left & {322, 323}
    # 3: brute force
    heads = brute(sorted((i, texts[i]) for i in left))
    left = {i for i in left if heads[i][1] == i}
    assert not left & set(range(262, 300)) or all(i - 260 not in left for i in left if i >= 260)
    # 4: as the mix says
    sized = docs.where(F.col("doc_id").isin(sorted(left))).select("doc_id", "source", mixing.n_words().alias("size"))
    times = {r.doc_id: r.times for r in mixing.mix(sized).collect()}
    # 5: the library
    library = pieces.encoder(pieces.model_path()).library
    want = collections.Counter()
    for i, n in times.items():
        ids = library.encode(texts[i], add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[i, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, top).collect()))
    assert got == +want and jaccard.Rule().percent == 80
