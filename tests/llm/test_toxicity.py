import random

import numpy as np

from tidelog.llm import toxicity as X


def distance(a, b):
    """Levenshtein's, with one swap of neighbours at the price of an edit."""
    best = _plain(a, b)
    for k in range(len(b) - 1):
        if b[k] != b[k + 1]:
            best = min(best, 1 + _plain(a, b[:k] + b[k + 1] + b[k] + b[k + 2 :]))
    return best


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_brute_force():
    rng = random.Random(5)
    entries = [("idiot", False, 1), ("disgusting", False, 2), ("trash", False, 1), ("scum", False, 0), ("lowei", True, 0), ("çaé", True, 0)]
    auto = X.build(entries)
    words = []
    for _ in range(4000):
        w = list(rng.choice(entries)[0])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(3)] = rng.sample("idotrasgulwçx", rng.randrange(3))
        words.append("".join(w) + rng.choice(["", "", "s", "xyz"]))
    words = [w for w in words if w]
    text = " ".join(words) + " "
    start, end, edits = auto.run(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    got = {int(a): int(e) for a, e in zip(start, edits)}
    at = 0
    for w in words:
        want = [d for t, s, k in entries if not s and (d := distance(w, t)) <= k] + [0 for t, s, _ in entries if s and w.startswith(t)]
        assert got.get(at) == (min(want) if want else None), w
        at += len(w) + 1


def test_look_alikes_and_context():
    auto = X.build([("idiot", False, 1)])
    model = X.Model(auto, [("idiot", False, 1)], frozenset(), np.array([-4.0, 3, 2, 3, 2]))
    texts = ["", "You IDIOT!", 'the word "idiot" is rude', "an 1d10t", "an idoit", "clean idio", "idiom"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    x = X.matches(model, np.frombuffer(data, np.uint8), offsets, X.Rule())
    assert x[0, 1:].sum() == 0 and x[1, 1] > x[3, 1] > x[2, 1] > 0 and x[4, 2] > 0 and x[4, 1] == 0
    assert x[6, 2] > 0  # one letter off


def test_query(spark):
    rng = random.Random(3)
    filler = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = filler(40)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "grumbler"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "such a blokhead again"), (1001, None), (1002, ""), (1003, " ".join(filler(30)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in X.verdicts(docs, lab).collect()}
    assert len(out) == len(rows)
    assert all(out[i].predicted == int(i % 5 == 0) for i in range(400))
    assert out[1000].predicted == 1 and out[1001].score == out[1002].score == out[1003].score < 0.3
    assert X.verdicts(docs, lab.limit(0)).where("score <> 0 or predicted <> 0").count() == 0
    assert X.verdicts(docs.limit(0), lab).count() == 0


def test_large_lexicons_take_several_automata():
    rng = random.Random(2)
    entries = [("".join(rng.choice("abcdefg") for _ in range(rng.randrange(5, 9))), False, 1) for _ in range(60)]
    entries = [e for e in dict.fromkeys(entries)]
    text = " ".join([t for t, _, _ in entries] + [t[:2] + t[3:] for t, _, _ in entries] + ["zzz"]) + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    one, many = X.build(entries).run(points), X.built(entries, X.Rule(part=7))
    assert len(many.parts) == -(-len(entries) // 7)
    assert [x.tolist() for x in one] == [x.tolist() for x in many.run(points)]


def test_clashing_labels_null_ids_and_long_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30)) + (" blockhead" if i % 4 == 0 else "")) for i in range(200)]
    long = " ".join(f"w{rng.randrange(200)}" for _ in range(200_000)) + " blockhead"
    docs = spark.createDataFrame(rows + [(None, "a blockhead"), (None, None), (500, long), (501, "x" * 1_000_000), (0, "repeated id"), (0, "repeated id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    out = X.verdicts(docs, labels).collect()
    assert len(out) == 206 and not any(r.held_out for r in out if r.doc_id is None) and all(r.held_out is not None for r in out)
    by_id = {r.doc_id: r for r in out if r.doc_id not in (None, 0)}
    assert by_id[500].predicted == 1 and by_id[501].predicted == 0
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, X.verdicts(docs.repartition(5), labels.repartition(3)).collect()), key=str)
