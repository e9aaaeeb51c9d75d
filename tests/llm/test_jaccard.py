import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import jaccard as J
from tidelog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, families=6, size=12, alone=30, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "Ä", "Q"]) + str(rng.randrange(vocabulary)) + "x"
    passage = " ".join(word() for _ in range(40))
    texts = ["", None, " \t\n", "one", "One", "one two three four", "a b c d e", "A B C D E", "a b c d e f"]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 30, 80, 200]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    for _ in range(alone):
        texts.append(" ".join(word() for _ in range(rng.randrange(5, 90))) + " " + passage)
    texts += rng.sample([t for t in texts if t], 10)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("rule", [J.Rule(), J.Rule(long=2, bits=1 << 10, pivots=1), J.Rule(long=1, bits=1 << 6, share=0.05)])
def test_against_brute_force(spark, rule):
    rows = corpus(rule.long)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, cls int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs, rule).collect()}
    assert got == brute(rows)


def thue_morse(n):
    """Two words that differ in every letter and share every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_fool_polynomials(spark, n):
    docs = spark.createDataFrame(list(enumerate(thue_morse(n))), "doc_id long, text string")
    assert {r.component_id for r in J.join(docs).collect()} == {0, 1}


def test_classes_whose_names_collide(spark, monkeypatch):
    """Where names of classes fit several texts, both halves of the hash tell them apart."""
    rows = corpus(4, families=2, size=4, alone=6)
    real = J.K.sequence_hashes

    def weak(*args):
        low, high = real(*args)
        return low % np.uint64(5), high

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    import pandas as pd

    data = [(a, d, o) for a, _, d, o in J.K.chunks(__import__("pyarrow").array([t for _, t in rows]))]
    monkeypatch.setattr(J.K, "sequence_hashes", weak)
    (_, d, o) = data[0]
    names, halves, _, _ = J.sets(d, o, 5)
    twins = pd.DataFrame({"c": names, "h": halves}).groupby("c").h.nunique().loc[lambda x: x > 1].index.to_numpy(np.int64)
    again, _, _, _ = J.sets(d, o, 5, twins)
    monkeypatch.undo()
    exact, _, _, _ = J.sets(d, o, 5)
    pairs = set(zip(exact.tolist(), again.tolist()))
    assert len(twins) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert docs.count() == len(rows)


def test_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(2, text), (5, text), (5, "another text of its own that stays"), (7, "c"), (7, "c"), (None, text), (None, "n"), (None, "n"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted([(2, text), (5, rows[2][1]), (7, "c"), (None, "n"), (8, None), (8, None)], key=str)
    got = sorted(((r.doc_id, r.component_id) for r in J.join(docs).collect()), key=str)
    assert got == sorted([(2, 2), (5, 2), (5, 5), (7, 7), (7, 7), (None, 2), (None, None), (None, None), (8, 8), (8, 8)], key=str)


def test_answers_follow_from_parents(spark):
    pairs = spark.createDataFrame([(1, 2, 100, 100), (1, 4, 100, 100), (3, 6, 100, 100)], "a long, b long, n_a int, n_b int")
    links = spark.createDataFrame([(1, 3, 100, 100, 98), (2, 5, 100, 100, 97)], "a long, b long, n_a int, n_b int, common long")
    mine, asked = J.derived(pairs, J.parents(links), 80)
    assert sorted((r.a, r.b) for r in asked.collect()) == [(1, 6), (3, 4), (3, 5)]
    between = spark.createDataFrame([(3, 5, 100, 100, 95), (3, 4, 100, 100, 10), (1, 6, 100, 100, 90)], "a long, b long, n_a int, n_b int, common long")
    got = {(r.a, r.b): r.link for r in J.answered(mine, between, 80).collect()}
    assert got == {(1, 2): True, (1, 4): False, (3, 6): None}


def test_one_of_each_component_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "x"), (2, "a b c d e f"), (4, None), (5, "")], "doc_id long, text string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, 5}
    assert J.join(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.data())
def test_bounds_lose_no_pair(n, data):
    """For any sets of n <= m shingles that link, the first common entries pass every filter."""
    m = data.draw(st.integers(n, max(n, n * 100 // 80)))
    need = -(-(80 * (n + m)) // 180)
    common = data.draw(st.integers(min(need, n), n))
    if 180 * common < 80 * (n + m):
        return
    i, j = data.draw(st.integers(0, n - common)), data.draw(st.integers(0, m - common))
    assert i < J.prefix(n, 80) and j < J.prefix(m, 80)
    assert J.possible(n, i, m, j, 80)
    for a, at, b, to in ((n, i, m, j), (m, j, n, i)):
        least, most = J.partners(np.array([a]), np.array([at]), np.array([data.draw(st.integers(0, to))]), 80)
        assert least[0] <= b <= most[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60), st.integers(0, 12)), min_size=1, max_size=60))
def test_blocks_give_all_possible_pairs(entries):
    t, n, place = (np.array(x) for x in zip(*[(t, n, min(p, n - 1)) for t, n, p in entries]))
    cls = np.arange(len(t))
    order = np.lexsort((cls, n, J.block(place), t))
    t, n, place, cls = t[order], n[order], place[order], cls[order]
    x, y = J.pairs_of_blocks(t, cls, n, place, 80)
    got = sorted(tuple(sorted(p)) for p in zip(cls[x].tolist(), cls[y].tolist()))
    want = []
    for a in range(len(t)):
        for b in range(a):
            k, m = (a, b) if n[a] <= n[b] else (b, a)
            if t[a] == t[b] and J.possible(n[k], place[k], n[m], place[m], 80):
                want.append(tuple(sorted((int(cls[a]), int(cls[b])))))
    assert got == sorted(want)


def test_blocks_of_places_ascend():
    b = J.block(np.arange(5000))
    assert (np.diff(b) >= 0).all() and (np.diff(b) <= 1).all() and b[:8].tolist() == [0, 1, 2, 3, 4, 5, 6, 7]


def test_components_of_a_chain(spark):
    links = spark.range(300).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000)], "a long, b long"))
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_components_of_shuffled_chains(spark):
    rng = random.Random(5)
    ids = list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)})
    rng.shuffle(ids)
    pairs = [(ids[k], ids[k + 1]) for k in range(1999)] + [(ids[k], ids[k + d]) for k in range(2000, 2990) for d in (1, 2, 3, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near, far = ids[:2000], ids[2000:2994]
    assert got == dict.fromkeys(near, min(near)) | dict.fromkeys(far, min(far))
