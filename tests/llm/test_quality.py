import collections
import math
import random
import re

import numpy as np
import pytest

from tidelog.llm import pieces, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", " \n\t\n", "a", "a a a", "a b c a b c", "x\n x\nx\n\nx", "é ü #*|", "\n\na\nb\n\na\nb", "a\x0bb\x0cc\rd"]
    words = ["the", "sea", "Über", "ñandú", "wind", "ship", "#x", "a|b", "☃"]
    for _ in range(120):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t "]) for _ in range(rng.randrange(200))))
    return out


def test_base_counts_and_fertility(spark):
    rows = [(i, t, "xx", "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").repartition(3)
    library = pieces.encoder(pieces.model_path()).library
    for r in quality.verdicts(docs).collect():
        t = rows[r.doc_id][1] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        ids = library.encode(t)
        n = max(1, len(ids))
        counts = collections.Counter(ids).values()
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(len(t) / n)
        assert r.entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts), abs=1e-9)
        assert r.byte_share == pytest.approx(sum(library.is_byte(i) and i != library.piece_to_id("<0x0A>") for i in ids) / n)


def test_bands_reject_what_lies_outside(spark):
    rng = random.Random(4)
    words = [w + x for w in ("sea", "wind", "ship", "stone", "river", "light", "garden") for x in ("", "s", "er", "ing", "ly")]
    good = [" ".join(rng.choices(words, k=rng.randrange(100, 120))) for _ in range(200)]
    odd = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=110)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(good + odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert not kept & set(range(200, 205)) and len(kept) >= 197
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(docs.limit(0)).count() == 0
    few = docs.where("doc_id >= 200")  # no group is large enough for a band
    assert quality.keep(few).count() == 5


def test_rows_of_one_id_are_judged_apart(spark):
    good = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, good, "en"), (1, "short", "en"), (None, good, "en"), (None, "short", "en")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.text) for r in quality.keep(docs).collect()) == [("1", good), ("None", good)]


def test_lines_that_fool_polynomials(spark):
    line = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    other = line.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{line}\n{other}\n{line[:60]}\n{line}", None)], "doc_id long, text string, lang string")
    assert quality.verdicts(docs).first().n_dup_lines == 1


def test_bands_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["stone", "river", "Über", "ñandú", "x%", "☃"]) for _ in range(rng.choice([20, 60, 90, 300]))), rng.choice(["de", "en", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rule = quality.Bands(reach=0.5, least=20)
    measured = quality.measure(docs).toPandas()
    failed = (measured.n_words < 50) | (100 * measured.n_repeat_words > 50 * measured.n_words)
    group = measured.lang.fillna(measured.script)
    size = np.floor(np.log2(measured.n_tokens)).astype(int)
    want = {}
    for k, r in measured.iterrows():
        kept = not failed[k]
        for c, floor in zip(quality.MEASURES, rule.floor):
            peers = measured[c][~failed & (group == group[k]) & (size == size[k])]
            if len(peers) < rule.least:
                peers = measured[c][~failed & (group == group[k])] if c != "entropy" else peers[:0]
            if len(peers) >= rule.least:
                a, b = np.percentile(peers.round(4), [25, 75])
                wide = max(b - a, floor) * rule.reach
                kept &= a - wide <= r[c] <= b + wide
        want[r.doc_id] = bool(kept)
    got = {r.doc_id: r.kept for r in quality.verdicts(docs, rule).collect()}
    assert got == want and 50 < sum(got.values()) < 350


def test_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "en", "x"), (1, "y" * 600_000, "en", "x")], "doc_id long, text string, lang string, kept string")
    got = sorted((r.n_words, r.word_chars, r.n_repeat_words) for r in quality.verdicts(docs).collect())
    assert got == [(1, 600_000, 0), (300_000, 1_200_000, 300_000)]
    assert quality.keep(docs).columns == docs.columns
