"""Quality rules: base counts of each text, and tokeniser fertility with rejection bands per language.

Fertility under a public vocabulary is characters per token, the share of byte-fallback tokens and the entropy of the
text's tokens.  Bands are fences around the quartiles of each group of texts over the whole corpus: a text is rejected
where a measure lies more than ``reach`` interquartile ranges outside.  Groups are the language (where it is null, the
main script) and the power of two of the token count, as the measures spread less the longer a text is.  A group of fewer
than ``least`` texts takes its language's bands; entropy, which grows with length, then has none.

Null text counts as empty: no words, which fails the base rule.  Equal texts of one language get equal verdicts; rows
with equal ids stay apart in :func:`measure` and :func:`keep`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import kernels as K
from .pieces import CHUNK, check, encoder, model_path

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FERTILITY = "n_tokens bigint, chars_per_token double, byte_share double, entropy double, script string"
#: Lead bytes of UTF-8 by script; the order settles ties.
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew_arabic", "cjk", "hangul", "other")
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 0
_SCRIPT[0xCD:0xD0], _SCRIPT[0xD0:0xD4], _SCRIPT[0xD6:0xDC] = 1, 2, 3
_SCRIPT[0xE3:0xEA], _SCRIPT[0xEA:0xEE], _SCRIPT[[0xE0, 0xE1, 0xE2, *range(0xF0, 0xF5)]] = 4, 5, 6


@dataclass(frozen=True)
class Bands:
    """reach: interquartile ranges on either side; floor: the least width of a fence, by measure."""

    reach: float = 3.0
    least: int = 30
    floor: tuple[float, float, float] = (0.03, 0.005, 0.05)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offsets) - 1
    start, end, row = K.words(data, offsets)
    letters = K.per_row(~SPACE_OR_TAIL[data], offsets)
    hashes = K.word_hashes(data, start, end, False)
    # lines: between line feeds and text ends
    feed = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    begins = begins[begins < len(data)]
    stops = np.minimum(np.append(begins[1:], len(data)), len(data))
    line_row = K.owners(offsets, begins)
    ends_with_feed = data[stops - 1] == 10
    line_hash = K.word_hashes(data, begins, stops - ends_with_feed, False)
    worded = np.searchsorted(start, stops) > np.searchsorted(start, begins)
    line_row, line_hash = line_row[worded], line_hash[worded]
    kept_row, _ = K.distinct(line_row, line_hash)
    dup_lines = np.bincount(line_row, minlength=n) - np.bincount(kept_row, minlength=n)
    # words in windows of three that their text has twice
    m = max(0, len(hashes) - WINDOW + 1)
    at = np.flatnonzero(row[:m] == row[WINDOW - 1 : WINDOW - 1 + m])
    h = K.windows(hashes, at, WINDOW)
    order = np.lexsort((h, row[at]))
    same = (h[order][1:] == h[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        covered[at[twice] + k] = True
    return [np.bincount(row, minlength=n), letters, K.per_row(SYMBOLS[data], offsets), dup_lines, np.bincount(row[covered], minlength=n)]


#: Separators and all but the lead byte of a code point.
SPACE_OR_TAIL = K.SPACE.copy()
SPACE_OR_TAIL[0x80:0xC0] = True


def fertility(own, data: np.ndarray, offsets: np.ndarray, checked: bool = True) -> list:
    """n_tokens, chars_per_token, byte_share, entropy (bits) and script of each row."""
    n = len(offsets) - 1
    ids, ends = own.encode(data, offsets)
    if checked:
        check(own, ids, ends, data, offsets, int(offsets[-1]) % n)
    tokens = np.diff(ends)
    some = np.maximum(tokens, 1)
    chars = K.per_row((data & 0xC0) != 0x80, offsets)
    ids = ids.astype(np.int64)
    fallback = K.per_row((ids >= own.bytes_from) & (ids < own.bytes_from + 256) & (ids != own.bytes_from + 10), ends)  # a line feed has no other form
    row = np.repeat(np.arange(n), tokens)
    key = np.sort(row * own.size + ids)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    entropy = np.log2(some) - np.bincount(key[first] // own.size, weights=count * np.log2(count), minlength=n) / some
    kinds = np.stack([K.per_row(_SCRIPT[data] == k, offsets) for k in range(len(SCRIPTS))])
    script = [SCRIPTS[k] if most else None for k, most in zip(kinds.argmax(0), kinds.max(0))]
    return [tokens, chars / some, fallback / some, np.maximum(entropy, 0.0), pa.array(script, pa.string())]


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text", model_file: str | None = None) -> DataFrame:
    """``keep`` with the base counts and the fertility of every text."""
    path = model_file or model_path()

    def make():
        own = encoder(path)
        return lambda data, offsets, rows: base_counts(data, offsets) + fertility(own, data, offsets)

    return frames.map_text(docs, make, f"{BASE}, {FERTILITY}", keep, text, chunk=CHUNK)


MEASURES = ("chars_per_token", "byte_share", "entropy")
DIGITS = 4  # of a measure whose quartiles are taken


def bands(measured: DataFrame, keys: dict[str, F.Column], measures: tuple[str, ...], rule: Bands = Bands()) -> DataFrame:
    """A row for each group of at least ``rule.least`` texts: the fences low_<measure> and high_<measure>.

    Rows that fail the base rule don't count."""
    made = []
    for c in measures:
        # exact and the same in every run; rounded, a group has a bounded number of values
        q = F.percentile(F.round(c, DIGITS), [0.25, 0.75])
        width = F.greatest(q[1] - q[0], F.lit(rule.floor[MEASURES.index(c)])) * rule.reach
        made += [(q[0] - width).alias(f"low_{c}"), (q[1] + width).alias(f"high_{c}")]
    good = measured.where(~base_failed()).groupBy(*[v.alias(k) for k, v in keys.items()])
    return good.agg(F.count("*").alias("n"), *made).where(F.col("n") >= rule.least).drop("n")


def group(lang: str) -> F.Column:
    return F.coalesce(F.col(lang), F.col("script"), F.lit("none"))


def size_class() -> F.Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(measured: DataFrame, lang: str = "lang", rule: Bands = Bands()) -> DataFrame:
    """``measured`` with base_failed and kept.  It is read three times: give a written table."""
    by_size = bands(measured, {"_g": group(lang), "_k": size_class()}, MEASURES, rule)
    by_lang = bands(measured, {"_g": group(lang)}, MEASURES[:2], rule)
    by_lang = by_lang.select("_g", *[F.col(c).alias(f"any_{c}") for c in by_lang.columns if c != "_g"])
    out = measured.withColumns({"_g": group(lang), "_k": size_class()})
    out = frames.join_small(frames.join_small(out, by_lang, ["_g"]), by_size, ["_g", "_k"])

    def inside(c: str) -> F.Column:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        if c in MEASURES[:2]:
            low, high = F.coalesce(low, f"any_low_{c}"), F.coalesce(high, f"any_high_{c}")
        return F.coalesce(F.col(c).between(low, high), F.lit(True))

    kept = ~F.col("base_failed")
    for c in MEASURES:
        kept = kept & inside(c)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", kept).select(*measured.columns, "base_failed", "kept")


def verdicts(docs: DataFrame, rule: Bands = Bands()) -> DataFrame:
    """Counts, fertility and verdict of every document."""
    return judge(frames.written(measure(docs)), rule=rule).drop("lang")


def keep(docs: DataFrame, rule: Bands = Bands()) -> DataFrame:
    """The documents whose verdict is to keep, as they were."""
    marked = docs.select("doc_id", "lang", "text", frames.same_text().alias("_same"))
    measured = frames.written(measure(marked, ("doc_id", "lang", "_same")))
    return frames.without(docs, judge(measured, rule=rule).where("not kept"))
