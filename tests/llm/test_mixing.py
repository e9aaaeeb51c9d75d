import random
from fractions import Fraction

import pytest

from tidelog.llm import mixing


def fill(sizes):
    """Targets by rounds: clamp what is above its cap, share the rest by weight again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > 3 * sizes[s]]
        if not above:
            return got | capped
        capped |= {s: Fraction(3 * sizes[s]) for s in above}


def rows_of(seed):
    rng = random.Random(seed)
    sources = [None, "", *(f"s{k}" for k in range(rng.randrange(1, 9)))]
    return [(i, rng.choice(sources if rng.random() < 0.6 else sources[-1:]), rng.choice([0, 1, 5, 5, 40, 300])) for i in range(400)]


@pytest.mark.parametrize("seed", range(4))
def test_against_rounds(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, taken = fill(sizes), dict.fromkeys(sizes, 0)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, out))
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.times <= 3 and r.taken == r.size * r.times
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - float(want[s])) <= 300


def test_one_text_brings_a_source_nearest(spark):
    """Against all changes of one row; a very long text can still be more than one other makes up for."""
    rng = random.Random(9)
    rows = [(f"s{i % 9}", i % 9 == 8, i, rng.choice([0, 1, 7, 30, 31, 900]), rng.randrange(4)) for i in range(300)]
    off = [0.0, 0.5, -0.5, 31.0, -29.0, 450.0, -2000.0, 800.2, -7.0]
    taken = [sum(n * t for s, _, _, n, t in rows if s == f"s{k}") for k in range(9)]
    docs = spark.createDataFrame([(*r, taken[int(r[0][1])] + off[int(r[0][1])]) for r in rows], "_s string, _none boolean, _rank long, size long, times long, target double")
    got = mixing.nearest(docs).collect()
    assert len(got) == len(rows)
    before = {r[2]: r[4] for r in rows}
    for k in range(9):
        mine = [r for r in rows if r[0] == f"s{k}"]
        left = abs(sum(r.size * r.times for r in got if r._s == f"s{k}") - taken[k] - off[k])
        tries = [abs(off[k])] + [abs(off[k] - n * d) for _, _, _, n, t in mine for d in (1, -1) if 0 <= t + d <= 3]
        assert left == pytest.approx(min(tries))
        assert sum(r.times != before[r._rank] for r in got if r._s == f"s{k}") <= 1


def test_many_slices_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(7), "doc_id long, source string, size long")
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 0.01)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == want


def test_texts_are_repeated_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 9), (2, None, "x", 9), (3, "d", None, 9), (3, "e f", None, 9), (4, "", "y", 9)], "doc_id long, text string, source string, size int")
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    sizes = {"x": 3, None: 3, "y": 0}
    want = fill(sizes)
    assert abs(sum(len((r.text or "").split()) for r in out.where("source = 'x'").collect()) - want["x"]) <= 3
    assert mixing.repeat(docs.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "x", 0)], "doc_id long, source string, size long")).first().taken == 0


def test_words(spark):
    texts = ["", None, " a\tb\nc\x0bd\x0ce\rf ", "x y z"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(mixing.n_words()).collect()] == [0, 0, 6, 2]
