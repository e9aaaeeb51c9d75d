import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import packing as P
from tidelog.llm import pieces


def slow_best_fit(lengths, width):
    room, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [r for r in range(len(room)) if room[r] >= lengths[k]]
        if fits:
            least = min(room[r] for r in fits)
            row = least
        else:
            row = None
        out[k] = row
        if row is None:
            room.append(width - lengths[k])
        else:
            room[next(r for r in fits if room[r] == least)] -= lengths[k]
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_best_fit(width, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, width), max_size=60)), np.int64)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    groups = P.best_fit(counts, width)
    left = [width - sum(length * each for length, each in g.holds) for g in groups for _ in range(g.rows)]
    assert sorted(left) == slow_best_fit(lengths.tolist(), width)
    # every piece has a slot of its own
    plan, found = P.plan(groups), []
    for length, n in counts.items():
        row, slot = plan.find(np.full(n, length), np.arange(n))
        found += [(r, s, length) for r, s in zip(row.tolist(), slot.tolist())]
    assert len({f[:2] for f in found}) == len(lengths) and {f[0] for f in found} == set(range(len(left)))
    used = np.bincount([f[0] for f in found], weights=[f[2] for f in found]) if found else np.zeros(0)
    assert sorted((width - used).astype(int).tolist()) == sorted(left)


def test_plans_stay_small():
    """Groups grow with the width and not with the pieces."""
    rng = np.random.default_rng(1)
    counts = {k: int(rng.integers(1, 10**9)) for k in range(2, 2049)}
    groups = P.best_fit(counts, 2048)
    assert len(groups) < 3 * 2048
    for length, n in counts.items():
        assert sum(g.rows * each for g in groups for at, each in g.holds if at == length) == n


def test_rows_do_not_depend_on_the_split(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "sea", "Üb"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None] * 60
    docs = spark.createDataFrame([(k % 350, t) for k, t in enumerate(texts)] + [(None, "x"), (None, None), (7, "again"), (7, "again")], "doc_id long, text string")
    rule = P.Rule(width=64, slice=10)
    one, other = (sorted(((bytes(r.ids), tuple(r.doc_ids), tuple(r.parts)) for r in P.pack(docs.repartition(n), rule).collect()), key=str) for n in (1, 5))
    assert one == other
    assert sum(len(r[1]) for r in one) >= len(texts) + 4


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "a", "long " * 3000] + [" ".join(rng.choice(["the", "sea", "Üb", "☃", "\n"]) for _ in range(rng.randrange(200))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    for rule in (P.Rule(), P.Rule(width=64, slice=3)):
        packed = P.pack(docs, rule)
        P.write(packed, path := str(tmp_path / f"w{rule.width}"))
        packed = spark.read.parquet(path)
        library = pieces.encoder(pieces.model_path()).library
        got = {}
        for r in P.unpack(packed).orderBy("doc_id", "part").collect():
            assert r.start == r.part * rule.width
            got[r.doc_id] = got.get(r.doc_id, []) + r.ids
        assert got == {i: [1, *library.encode(t or ""), 2] for i, t in enumerate(texts)}
        for r in packed.collect():
            assert len(r.ids) == len(r.position_ids) == 2 * rule.width and r.cu_seqlens[-1] == r.n_tokens <= rule.width
            want = [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(b - a)]
            assert np.frombuffer(r.position_ids, "<u2")[: r.n_tokens].tolist() == want
    assert P.pack(docs.limit(0)).count() == 0
