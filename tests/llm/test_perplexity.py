import collections
import math
import random

import numpy as np
import pytest

from tidelog.llm import perplexity as P


def brute(texts):
    """Interpolated modified Kneser-Ney of bytes by dictionaries: log p(byte | three bytes)."""
    order = 4
    counts = {order: collections.Counter()}
    for t in texts:
        b = b"\n\n\n" + t.encode()
        for k in range(3, len(b)):
            counts[order][b[k - 3 : k + 1]] += 1
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, c in counts.items():
        m = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if min(m[:3]) > 0:
            y = m[0] / (m[0] + 2 * m[1])
            cuts[n] = [max(0.1, k - (k + 1) * y * m[k] / m[k - 1]) for k in (1, 2, 3)]
        else:
            cuts[n] = [0.5, 1, 1.5]
    cache = {}

    def stats(n, context):
        if (n, context) not in cache:
            own = [v for g, v in counts[n].items() if g[:-1] == context]
            cache[n, context] = sum(own), sum(cuts[n][min(v, 3) - 1] for v in own)
        return cache[n, context]

    def p(n, context, w):
        if n == 0:
            return 1 / 256
        total, lost = stats(n, context)
        if not total:
            return p(n - 1, context[1:], w)
        c = counts[n][context + w]
        hit = max(c - cuts[n][min(c, 3) - 1], 0) / total if c else 0
        return hit + lost / total * p(n - 1, context[1:], w)

    def log_perplexity(t):
        b = b"\n\n\n" + t.encode()
        return -sum(math.log(p(4, b[k - 3 : k], b[k : k + 1])) for k in range(3, len(b))) / (len(b) - 3)

    return log_perplexity


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "then", "theory", "über", "or", "ore", "norm"]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_model_against_brute_force(spark):
    good = corpus(40)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)] + [(900, "xyz QQ ☃", "en"), (901, "", "en"), (902, None, None)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(900, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    want = brute(good)
    for rule in (P.Rule(), P.Rule(hot=7)):
        model = P.trained(P.flagged(docs, labels), rule)
        assert (model.cold is None) == (rule.hot > 7)
        for r in P.score(docs, model).collect():
            t = docs.where(f"doc_id = {r.doc_id}").first().text
            if not t:
                assert r.log_perplexity is None and r.n_bytes == 0
            else:
                assert r.log_perplexity == pytest.approx(want(t), abs=2e-6)


def test_probabilities_of_a_context_add_up(spark):
    """With every byte asked for after a context, p sums to 1; bytes from 128 on, which no text has, share the least p."""
    good = [t.replace("ü", "u") for t in corpus(20)]
    every = [("the " + "ove" + chr(k)) for k in range(128)]
    texts = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in every], "text string, trusted boolean")
    counted = P.count(texts)
    grams = {r.g: math.exp(-r.w / P.UNIT) for r in P.weighed(counted, P.smoothed(counted.where("c > 0").select("g", "c"))).collect()}
    x = int.from_bytes(b"ove", "big")
    p = [grams[x << 8 | k] for k in range(128)]
    assert sum(p) + 128 * min(p) == pytest.approx(1, abs=1e-4)


def test_trust_by_shuffle_is_the_same(spark):
    docs = spark.createDataFrame([(i % 18, t) for i, t in enumerate(corpus(20))] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(4, 1), (None, 1)], "doc_id long, quality int")
    rows = [sorted(map(str, P.flagged(docs, labels, rule).collect())) for rule in (P.Rule(), P.Rule(ids=1))]
    assert rows[0] == rows[1] and len(rows[0]) == 21 and "Row(doc_id=None, text='x', trusted=None)" in rows[0]


def test_equal_texts_get_equal_scores(spark):
    good = corpus(60)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good * 3)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")
    for rule in (P.Rule(), P.Rule(hot=20)):
        scores = collections.defaultdict(set)
        for r in P.score(docs, P.trained(P.flagged(docs, labels), rule), ("doc_id",)).collect():
            scores[good[r.doc_id % 60]].add(r.log_perplexity)
        assert all(len(v) == 1 for v in scores.values())


def test_fences_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["stone", "river", "über", "☃%"]) for _ in range(rng.choice([3, 40, 45, 200]))), rng.choice(["de", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    rule = P.Rule(low=0.5, high=0.7, least=20)
    out = P.verdicts(docs, labels, rule).toPandas().set_index("doc_id").sort_index()
    frame = out.assign(lang=[r[2] or "" for r in rows], log=np.log(out.perplexity), size=[int(n).bit_length() for n in out.n_bytes])
    for i, r in frame.iterrows():
        peers, wide = frame[(frame.lang == r.lang) & (frame["size"] == r["size"])].log, 1.0
        if len(peers) < rule.least:
            peers, wide = frame[frame.lang == r.lang].log, max(1.0, math.sqrt(1000 / r.n_bytes))
        a, b = np.percentile(peers.round(4), [25, 75])
        wide *= max(b - a, rule.floor)
        assert r.kept == (a - rule.low * wide <= r.log <= b + rule.high * wide), i
    assert 50 < frame.kept.sum() < 300


def test_keeping(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choices(["river", "stone", "bridge", "winter", "summer", "garden"], k=rng.randrange(60, 70))) for _ in range(150)]
    odd = ["".join(rng.choices("$%&qzx ", k=400)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(good + odd + [None, ""])], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = P.keep(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids) >= 148 and max(ids) < 150
    assert {r.doc_id for r in P.verdicts(docs, labels).where("kept").collect()} == ids
    none = P.verdicts(docs, labels.limit(0))
    assert none.where("kept").count() == 156 and P.verdicts(docs.limit(0), labels).count() == 0


def test_grams_beyond_the_limit_count(spark):
    good = corpus(40) + ["река и мост"]
    texts = good + ["xyz QQ ☃ über", "мост и река", "", None, "the norm"] + good[:1]
    docs = spark.createDataFrame([(i % 44, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(41)], "doc_id long, quality int, toxic int")
    rows = lambda rule: sorted((r.doc_id, r.n_bytes, r.perplexity or 0) for r in P.verdicts(docs, labels, rule).collect())
    whole, by_join = rows(P.Rule()), rows(P.Rule(hot=5))
    assert whole == by_join and len(whole) == len(texts)
    kept = [sorted(r.doc_id for r in P.keep(docs, labels, rule).collect()) for rule in (P.Rule(), P.Rule(hot=5))]
    assert kept[0] == kept[1]
