"""Toxicity by a learned lexicon, misspellings included.

The lexicon comes from labelled texts: words and word stems whose texts are toxic, in enough different contexts that
copies of one text don't count twice.  Its trie is intersected with Levenshtein automata (and neighbour swaps) into one
deterministic automaton over code point classes (several, of ``Rule.part`` entries each, for a large lexicon); look-alike
digits and signs count as their letters.  All words of a
chunk run through it side by side.  A match weighs less inside quotation marks or near words that talk about words, and
more near a second person; a logistic model of the matches' weights gives the score.

The lexicon and the model are fitted on at most ``Rule.sample`` labelled texts, those whose ids hash lowest, and of these
only texts that :func:`held_out` doesn't hold back; every entry that these support is kept.  An id with several labels is
toxic if one of them says so.  Scores see the text alone.

Null and empty texts have no match and get the score of none; without labels, or without both kinds of them, every score
is 0; equal texts get equal scores; rows with equal ids stay apart; a null id isn't held out, nor learned from; an empty
table gives an empty result.  New columns replace those of the same name, and other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Look-alikes inside words.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_QUOTES = "\"“”„«»‹›‘’"
#: Words that talk about words, and second persons, in some languages.
_TALK = frozenset("word words term terms called quote quoted quotes quotation said says meaning means definition spelled wort begriff genannt zitat bedeutet mot terme dit cité signifie palabra término dijo cita significa".split())
_YOU = frozenset("you your you're youre yours du dich dein deine ihr tu toi ton vous usted tú eres".split())
_WORDS = re.compile(r"[^\W_]+")
DEAD = 0


@dataclass(frozen=True)
class Rule:
    """sample: labelled texts at the most; support: contexts of a term, and its toxic texts if their contexts are a third
    more than they are, or if not; sure: share of toxic texts among those with it (often:
    from so many toxic texts on, another share); forms: misspellings of an entry that
    clean texts may hold before it gets none; stem: least letters of a stem; fuzzy: least letters for one edit, and for two; part: entries of one automaton; window: characters
    of context on either side; threshold: of the predicted label."""

    sample: int = 10_000
    support: tuple[int, int, int] = (10, 4, 8)
    sure: float = 0.97
    often: tuple[int, float] = (15, 0.85)
    stem: tuple[int, int] = (4, 8)
    fuzzy: tuple[int, int] = (5, 11)
    part: int = 150
    window: int = 48
    quoted: float = 0.3
    near_you: float = 1.5
    threshold: float = 0.3
    forms: int = 2


# --- the automaton -----------------------------------------------------------------------------------------------


@dataclass
class Automaton:
    """classes: of code points (-1 outside words); step: next state; edits: of the best entry that ends in a state (-1:
    none); final: states that keep their entry whatever follows (stems)."""

    classes: np.ndarray
    step: np.ndarray
    edits: np.ndarray
    final: np.ndarray

    def run(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and edits of the words of ``points`` (lower-cased code points, 32 between texts) that match."""
        c = self.classes[points]
        inside = np.concatenate([[False], c >= 0, [False]])
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        end = np.flatnonzero(~inside[1:] & inside[:-1])
        state = np.ones(len(start), np.int32)
        live, k = np.arange(len(start)), 0
        while len(live):
            live = live[end[live] - start[live] > k]
            now = self.step[state[live], c[start[live] + k]]
            state[live] = now
            live = live[(now != DEAD) & ~self.final[now]]
            k += 1
        hit = self.edits[state] >= 0
        return start[hit], end[hit], self.edits[state[hit]]


@dataclass
class Automata:
    """Several, each for a part of the entries; a word's edits are the fewest that any of them finds."""

    parts: list[Automaton]

    def run(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, edits = (np.concatenate(x) for x in zip(*(p.run(points) for p in self.parts)))
        order = np.lexsort((edits, start))
        start, end, edits = start[order], end[order], edits[order]
        first = np.concatenate([[True], start[1:] != start[:-1]]) if len(start) else np.zeros(0, bool)
        return start[first], end[first], edits[first]


def built(entries: list[tuple[str, bool, int]], rule: Rule) -> Automata:
    """Automata of all entries; neighbours in the alphabet share one, as they share its states."""
    entries = sorted(entries)
    return Automata([build(entries[k : k + rule.part]) for k in range(0, len(entries), rule.part)])


@functools.cache
def lower_table() -> np.ndarray:
    """Single lower-case code points of the basic plane; others stay."""
    out = np.arange(0x110000, dtype=np.uint32)
    for k in range(0x10000):
        if len(chr(k).lower()) == 1:
            out[k] = ord(chr(k).lower())
    return out


def classes_of(letters: str) -> np.ndarray:
    out = np.zeros(0x110000, np.int16)
    for k in range(0x3000):
        ch = chr(k)
        if not (ch.isalnum() or ch in LOOKS):
            out[k] = -1
    for k in (0x3000, *range(0xFF00, 0xFF10), 0xFEFF):
        out[k] = -1
    for k, ch in enumerate(letters, 1):
        out[ord(ch)] = k
    for sign, ch in LOOKS.items():
        out[ord(sign)] = letters.find(ch) + 1
    return out


def edits_of(word: str, stem: bool, rule: Rule) -> int:
    return 0 if stem else (len(word) >= rule.fuzzy[0]) + (len(word) >= rule.fuzzy[1])


def build(entries: list[tuple[str, bool, int]]) -> Automaton:
    """The automaton of (text, is a stem, edits allowed); states are sets of (trie node, edits so far)."""
    trie: list[dict[str, int]] = [{}]
    ends: list[list[tuple[int, int, bool]]] = [[]]  # by node: (edits already spent, edits allowed, stem)

    def add(word: str, spent: int, allowed: int, stem: bool) -> None:
        at = 0
        for ch in word:
            if ch not in trie[at]:
                trie[at][ch] = len(trie)
                trie.append({})
                ends.append([])
            at = trie[at][ch]
        ends[at].append((spent, allowed, stem))

    for word, stem, allowed in entries:
        add(word, 0, allowed, stem)
        if allowed:
            for k in range(len(word) - 1):
                if word[k] != word[k + 1]:
                    add(word[:k] + word[k + 1] + word[k] + word[k + 2 :], 1, allowed, False)
    # the most edits that any entry below a node still allows
    reach = [max([a - s for s, a, _ in ends[n]], default=-1) for n in range(len(trie))]
    for n in range(len(trie) - 1, -1, -1):
        reach[n] = max([reach[n], *(reach[m] for m in trie[n].values())])
    letters = "".join(sorted({ch for word, _, _ in entries for ch in word}))

    def closed(items: dict[int, int]) -> frozenset:
        """With letters of an entry left out; each node with its fewest edits."""
        todo = list(items)
        while todo:
            n = todo.pop()
            e = items[n] + 1
            for m in trie[n].values():
                if e <= reach[m] and e < items.get(m, 9):
                    items[m] = e
                    todo.append(m)
        return frozenset(items.items())

    def follow(state: frozenset, ch: str) -> frozenset:
        items: dict[int, int] = {}
        for n, e in state:
            for letter, m in trie[n].items():
                cost = e + (letter != ch)
                if cost <= reach[m] and cost < items.get(m, 9):
                    items[m] = cost
            if e + 1 <= reach[n] and e + 1 < items.get(n, 9):
                items[n] = e + 1
        return closed(items)

    states: dict[frozenset, int] = {frozenset(): DEAD, closed({0: 0}): 1}
    order = list(states)
    rows: list[list[int]] = [[DEAD] * (len(letters) + 1)]
    done = 1
    while done < len(order):
        row = []
        for ch in ("\0", *letters):
            to = follow(order[done], ch)
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row.append(states[to])
        rows.append(row)
        done += 1
    edits, final = np.full(len(order), -1, np.int8), np.zeros(len(order), bool)
    for k, state in enumerate(order):
        found = [(e + s, stem) for n, e in state for s, allowed, stem in ends[n] if e + s <= allowed]
        if found:
            edits[k] = min(x for x, _ in found)
            final[k] = any(stem and x == 0 for x, stem in found)
    return Automaton(classes_of(letters), np.array(rows, np.int32), edits, final)


# --- learning ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    automaton: Automata | None = None
    entries: list[tuple[str, bool, int]] = field(default_factory=list)
    #: Misspellings that are words of clean texts.
    words: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def terms(word: str, rule: Rule) -> Iterator[tuple[str, bool]]:
    """A word and its stems."""
    yield word, False
    for k in range(rule.stem[0], min(rule.stem[1], len(word)) + 1):
        yield word[:k], True


def _occurrences(toxic: DataFrame, rule: Rule) -> DataFrame:
    """term, stem, contexts of the toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for text in batch.column(0).to_pylist():
                words = [w.lower() for w in _WORDS.findall(text or "")]
                for k, w in enumerate(words):
                    if len(w) >= rule.stem[0]:
                        context = " ".join(words[max(0, k - 1) : k] + ["_"] + words[k + 1 : k + 2])
                        out |= {(t, s, context) for t, s in terms(w, rule)}
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.bool_()), pa.array(list(columns[2]), pa.string())], names=["term", "stem", "context"])

    found = toxic.select("text").mapInArrow(run, "term string, stem boolean, context string").distinct()
    return found.groupBy("term", "stem").agg(F.count("*").alias("contexts"))


def forms(sample: DataFrame, model: Model) -> DataFrame:
    """form: misspelled matches that clean texts hold."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(data, offsets, rows):
            flat = np.insert(data, offsets[1:], 32)
            points = lower_table()[np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
            lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            start, end, edits = held.value.automaton.run(points)
            row = np.searchsorted(lead[offsets + np.arange(len(offsets))], start, "right") - 1
            out: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
            for a, b, e, r in zip(start.tolist(), end.tolist(), edits.tolist(), row.tolist()):
                if e:
                    out[r].append(points[a:b].tobytes().decode("utf-32-le"))
            return [pa.array(out, pa.list_(pa.string()))]

        return f

    found = frames.map_text(sample.where("toxic <> 1"), make, "forms array<string>", ())
    return found.select(F.explode("forms").alias("form")).distinct()


def _tally(sample: DataFrame, wanted, rule: Rule) -> DataFrame:
    """term, stem, toxic, clean: distinct texts with each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        counts: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.lower() for w in _WORDS.findall(text or "")}
                for t in {t for w in words if len(w) >= rule.stem[0] for t in terms(w, rule) if t in known}:
                    counts[t][y != 1] += 1
        columns = list(zip(*((*t, *n) for t, n in counts.items()))) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["term", "stem", "toxic", "clean"])

    made = sample.select("text", "toxic").mapInArrow(run, "term string, stem boolean, toxic bigint, clean bigint")
    return made.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(tally: list[tuple[str, bool, int, int]], rule: Rule) -> list[tuple[str, bool]]:
    """Entries of (term, stem, toxic, clean): the shortest sure stems, or the one word that makes up most of a stem."""
    good = {(t, s): n for t, s, n, clean in tally if n >= (rule.often[1] if n >= rule.often[0] else rule.sure) * (n + clean)}
    stems = sorted((t for t, s in good if s), key=len)
    least: list[str] = []
    for t in stems:
        if not any(t[:k] in least for k in range(rule.stem[0], len(t))):
            least.append(t)
    out: list[tuple[str, bool, int]] = []
    for stem in least:
        n = good[stem, True]
        words = sorted(((m, t) for (t, s), m in good.items() if not s and t.startswith(stem)), reverse=True)
        if words and words[0][0] >= 0.6 * n:
            out += [(t, False, m) for m, t in words if m >= 0.1 * n]
        else:
            longer = [t for t, s in good if s and t.startswith(stem) and good[t, True] >= 0.9 * n]
            out.append((max(longer, key=len), True, n))
    out += [(t, False, n) for (t, s), n in good.items() if not s and not any(t.startswith(x) for x in least)]
    return [(t, s) for t, s, _ in sorted(out, key=lambda x: (-x[2], x[0]))]


def matches(model: Model, data: np.ndarray, offsets: np.ndarray, rule: Rule) -> np.ndarray:
    """A row for each text: 1, log of the weight of plain and of misspelled matches, and whether there are any."""
    n = len(offsets) - 1
    exact, fuzzy = np.zeros(n), np.zeros(n)
    if model.automaton is not None and len(data):
        flat = np.insert(data, offsets[1:], 32)
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        bounds = lead[offsets + np.arange(n + 1)]
        start, end, edits = model.automaton.run(lower_table()[points])
        row = np.searchsorted(bounds, start, "right") - 1
        for a, b, e, r in zip(start.tolist(), end.tolist(), edits.tolist(), row.tolist()):
            if e and model.words and points[a:b].tobytes().decode("utf-32-le").lower() in model.words:
                continue
            low, high = max(int(bounds[r]), a - rule.window), min(int(bounds[r + 1]) - 1, b + rule.window)
            before, after = (points[x:y].tobytes().decode("utf-32-le") for x, y in ((low, a), (b, high)))
            (fuzzy if e else exact)[r] += weight(before, after, rule)
    return np.stack([np.ones(n), np.log1p(exact), np.log1p(fuzzy), exact > 0, fuzzy > 0], 1)


def weight(before: str, after: str, rule: Rule) -> float:
    """How far a match is abuse, from the text on either side of it."""
    near = {w.lower() for w in _WORDS.findall(before) + _WORDS.findall(after)}
    opened = sum(before.count(q) for q in _QUOTES) % 2 == 1 and any(q in after for q in _QUOTES)
    w = rule.quoted if opened or near & _TALK else 1.0
    return w * (rule.near_you if near & _YOU else 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method; matches can't speak against toxicity."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w * (np.arange(len(w)) > 0))
        w = w + step
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> Model:
    spark = docs.sparkSession
    mine = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    mine = mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.sample)
    # rule.sample rows at the most, so the broadcast is bounded; copies of a text count once
    sample = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))
    sample = frames.written(sample)
    found = _occurrences(sample.where("toxic = 1"), rule).where(F.col("contexts") >= rule.support[0]).toPandas()  # of a bounded sample
    contexts = dict(zip(zip(found.term, found.stem), found.contexts))
    tally = _tally(sample, spark.sparkContext.broadcast(set(contexts)), rule).where(F.col("toxic") >= rule.support[1]).toPandas()
    enough = [r for r in tally.itertuples(index=False, name=None) if r[2] >= rule.support[2] or 3 * contexts[r[0], r[1]] >= 4 * r[2]]
    chosen = choose(enough, rule)
    if not chosen:
        return Model()
    # a misspelling that clean texts hold is a word; an entry with several such words gets no misspellings
    entries = [(t, s, edits_of(t, s, rule)) for t, s in chosen]
    words = [r.form for r in forms(sample, Model(built(entries, rule), entries)).collect()]
    of_entry: Counter = Counter()
    for t, s, k in entries:
        if k:
            one = build([(t, s, k)])
            of_entry[t] = sum(len(one.run(np.frombuffer(w.encode("utf-32-le"), np.uint32))[0]) for w in words)
    entries = [(t, s, 0 if of_entry[t] > rule.forms else k) for t, s, k in entries]
    model = Model(built(entries, rule), entries, frozenset(words))
    x = frames.map_text(sample, _features(spark.sparkContext.broadcast(model), rule), "x array<double>", keep=("toxic",)).toPandas()
    y = (x.toxic == 1).to_numpy(float) if len(x) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Model()
    model.weights = logistic(np.stack(x.x.to_numpy()), y)
    # misspelled matches are rare among labels, so their own weights are weak; words of clean texts aren't among them
    model.weights[[2, 4]] = np.maximum(model.weights[[2, 4]], 0.9 * model.weights[[1, 3]])
    return model


def _features(held, rule: Rule):
    def make():
        model = held.value
        return lambda data, offsets, rows: [pa.array(list(matches(model, data, offsets, rule)), pa.list_(pa.float64()))]

    return make


def score(docs: DataFrame, model: Model, rule: Rule = Rule(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with score, 0 to 1, and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def f(data, offsets, rows):
            n = len(offsets) - 1
            if not own.weights.any():
                return [np.zeros(n), np.zeros(n, np.int32)]
            p = np.round(1 / (1 + np.exp(-np.clip((matches(own, data, offsets, rule) * own.weights).sum(1), -30, 30))), 9)
            return [p, (p >= rule.threshold).astype(np.int32)]

        return f

    return frames.map_text(docs, make, "score double, predicted int", keep, text)


def verdicts(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, train(docs, labels, rule), rule).select("doc_id", held_out().alias("held_out"), "score", "predicted")
