"""Exact encoding with a merge-type (BPE) SentencePiece vocabulary, many words at a time.

The library puts every adjacent pair of symbols that forms a piece on an agenda ordered by score and then position, and
merges the best until none is left.  Pieces don't reach over the start of a run of spaces or over a line feed or tab, so
a text falls into segments whose agendas are independent.  Here the agendas of all *new* segments of a chunk advance
together: each round takes the head of every agenda (lowest rank, then leftmost) and renews the two pairs beside each
merge.  A segment of more than ``ALONE`` symbols has a heap of its own for an agenda, so time grows as n log n for text
without spaces.  Encoded segments are kept in a bounded table with their bytes, found again by a 64-bit hash and binary
search; the bytes of every segment are compared with those of its entry, and a segment that only shares the hash is
encoded by itself.
"""

from __future__ import annotations

import heapq

import numpy as np

from . import kernels as K

ALONE = 200
_NONE = np.iinfo(np.int32).max
_MARK = "▁"


class Encoder:
    """ids of texts under ``model_file``; ``most`` bounds the kept segments and ``most_bytes`` their bytes (the table starts
    anew beyond)."""

    def __init__(self, model_file: str, most: int = 500_000, most_bytes: int = 1 << 24):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        pieces = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("pieces reach over the start of a run of spaces; segments would not be independent")
        joined = {ord(c) for p in pieces if len(p) > 1 for c in p}
        self._apart = np.array([c < 32 and c not in joined for c in range(256)])  # control characters in no longer piece
        if self.library.normalize("á ﬁ  b ") != f"{_MARK}á{_MARK}ﬁ{_MARK}{_MARK}b{_MARK}":
            raise ValueError("only identity normalisation with a leading space is supported")
        self.bytes_from = self.library.piece_to_id("<0x00>")
        self.begin, self.end, self.size, self.most, self.most_bytes = self.library.bos_id(), self.library.eos_id(), size, most, most_bytes
        self._letters = {p: i for p, i in pieces.items() if len(p) == 1}
        self._tables(pieces)
        self._forget()

    def _tables(self, pieces: dict[str, int]) -> None:
        """Merges as sorted keys left * 2**21 + right.  A code point without a piece is symbol size + code point."""
        score = {i: self.library.get_score(i) for i in pieces.values()}
        ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = lambda p: pieces.get(p, self.size + ord(p) if len(p) == 1 else None)
        found = []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    found.append((a << 21 | b, ranks[score[i]], i))
        found.sort()
        self._keys = np.array([x[0] for x in found], np.int64)
        self._ranks = np.array([x[1] for x in found], np.int32)
        self._made = np.array([x[2] for x in found], np.int32)
        self._pairs: dict[int, tuple[int, int]] = {}  # the same for heaps, made when one is needed
        bits = 1 << 22
        self._may = np.zeros(bits, bool)  # rules most pairs out before the search
        self._may[self._slot(self._keys)] = True
        self._first = np.arange(0x110000, dtype=np.int32) + self.size
        for c, i in self._letters.items():
            self._first[ord(c)] = i
        self._first[32] = self._letters[_MARK]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._where = np.zeros((0, 4), np.int64)  # first id, ids, first byte, bytes
        self._pool = np.zeros(1 << 16, np.uint16 if self.size <= 1 << 16 else np.int32)
        self._bytes = np.zeros(1 << 18, np.uint8)
        self._used = self._used_bytes = 0

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 21 | right
        rank, made = np.full(len(keys), _NONE, np.int32), np.zeros(len(keys), np.int32)
        maybe = np.flatnonzero(self._may[self._slot(keys)])
        at = np.searchsorted(self._keys, keys[maybe])
        at[at == len(self._keys)] = 0
        hit = self._keys[at] == keys[maybe]
        rank[maybe[hit]], made[maybe[hit]] = self._ranks[at[hit]], self._made[at[hit]]
        return rank, made

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of each word (``word`` ascends) and their words."""
        rank, made = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], made[same] = self._look(symbols[same], symbols[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            if not live.all():
                rest = np.repeat(live, lengths)
                done.append((symbols[~rest], word[~rest]))
                symbols, word, rank, made = symbols[rest], word[rest], rank[rest], made[rest]
                best, lengths = best[live], lengths[live]
                if not len(symbols):
                    break
            head = np.flatnonzero(rank == np.repeat(best, lengths))
            head = head[np.concatenate([[True], word[head[1:]] != word[head[:-1]]])]
            symbols[head] = made[head]
            keep = np.ones(len(symbols), bool)
            keep[head + 1] = False
            head = head - np.arange(len(head))  # one is gone before each later one
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            for at in (head - 1, head):
                at = at[at >= 0]
                here = (at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])
                rank[at[~here]] = _NONE
                at = at[here]
                rank[at], made[at] = self._look(symbols[at], symbols[at + 1])
        if not done:
            return symbols, word
        symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _alone(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols that remain of one segment, by a heap of (rank, place of the left symbol)."""
        if not self._pairs:
            self._pairs = dict(zip(self._keys.tolist(), zip(self._ranks.tolist(), self._made.tolist())))
        pairs, at = self._pairs, symbols.tolist()
        n = len(at)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, _ = self._look(symbols[:-1], symbols[1:])
        heap = [r << 32 | k for k, r in enumerate(rank.tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            head = heapq.heappop(heap)
            left = head & 0xFFFFFFFF
            right = after[left] if at[left] >= 0 else -1
            if right < 0:
                continue
            found = pairs.get(at[left] << 21 | at[right])
            if found is None or found[0] != head >> 32:  # the pair has changed since
                continue
            at[left], at[right] = found[1], -1
            next_ = after[left] = after[right]
            if next_ >= 0:
                before[next_] = left
                if (found := pairs.get(at[left] << 21 | at[next_])) is not None:
                    heapq.heappush(heap, found[0] << 32 | left)
            last = before[left]
            if last >= 0 and (found := pairs.get(at[last] << 21 | at[left])) is not None:
                heapq.heappush(heap, found[0] << 32 | last)
        rest = np.array(at, symbols.dtype)
        return rest[rest >= 0]

    def _merged(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_merge`, with long segments one by one."""
        size = np.bincount(word, minlength=n)
        alone = size > ALONE
        if not alone.any():
            return self._merge(symbols, word)
        ends = np.cumsum(size)
        made = [self._merge(symbols[~alone[word]], word[~alone[word]])]
        for k in np.flatnonzero(alone).tolist():
            rest = self._alone(symbols[ends[k] - size[k] : ends[k]])
            made.append((rest, np.full(len(rest), k)))
        symbols, word = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    @staticmethod
    def _room(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(pool):
            return pool
        grown = np.zeros(max(2 * len(pool), used + more), pool.dtype)
        grown[:used] = pool[:used]
        return grown

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes segments and gives where their ids and bytes are."""
        length = end - start
        base = np.cumsum(length) - length
        raw = data[np.arange(int(length.sum())) + np.repeat(start - base, length)]
        lead = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(start)), length)[lead]
        symbols, word = self._merged(self._first[points].copy(), word, len(start))
        odd = symbols >= self.size  # no piece: the bytes of its UTF-8 form
        if odd.any():
            forms = [chr(c - self.size).encode() for c in symbols[odd].tolist()]
            many = np.ones(len(symbols), np.int64)
            many[odd] = [len(f) for f in forms]
            spread = np.repeat(odd, many)
            symbols, word = np.repeat(symbols, many), np.repeat(word, many)
            symbols[spread] = np.frombuffer(b"".join(forms), np.uint8).astype(np.int32) + self.bytes_from
        n = np.bincount(word, minlength=len(start))
        self._pool = self._room(self._pool, self._used, len(symbols))
        self._pool[self._used : self._used + len(symbols)] = symbols
        self._bytes = self._room(self._bytes, self._used_bytes, len(raw))
        self._bytes[self._used_bytes : self._used_bytes + len(raw)] = raw
        where = np.stack([self._used + np.cumsum(n) - n, n, self._used_bytes + base, length], 1)
        self._used, self._used_bytes = self._used + len(symbols), self._used_bytes + len(raw)
        return where

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode segments that aren't in the table; ``hashes`` ascend."""
        where = self._add(data, start, end)
        at = np.searchsorted(self._known, hashes)
        self._known, self._where = np.insert(self._known, at, hashes), np.insert(self._where, at, where, 0)

    def _strange(self, data: np.ndarray, start: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The segments (one after the other in ``data``) whose bytes aren't those of their entry."""
        size = np.diff(np.append(start, len(data)))
        other = size != where[:, 3]
        first = np.where(other, 0, where[:, 2])
        differ = data != self._bytes[np.minimum(np.arange(len(data)) + np.repeat(first - start, size), len(self._bytes) - 1)]
        return np.flatnonzero(other | np.logical_or.reduceat(differ, start))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their offsets by row, without begin and end ids.  Bytes and offsets as of ``kernels.chunks``."""
        if len(data) == 0:
            return np.zeros(0, self._pool.dtype), np.zeros(len(offsets), np.int64)
        mark = np.flatnonzero(data == 0xE2)
        if len(mark):  # a written U+2581 counts as a space
            mark = mark[mark + 2 < len(data)]
            mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        flat = np.insert(data, offsets[full], 32)
        shift = np.concatenate([[0], np.cumsum(size > 0)])
        offsets = offsets + shift
        if len(mark):
            mark = mark + shift[K.owners(offsets - shift, mark) + 1]
            flat[mark] = 32
            keep = np.ones(len(flat), bool)
            keep[mark + 1] = keep[mark + 2] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            flat, offsets = flat[keep], offsets - gone[offsets]
        control = self._apart[flat]
        space = flat == 32
        starts = control.copy()
        starts[1:] |= control[:-1] | (space[1:] & ~space[:-1])
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(flat))
        hashes = K.span_hashes(flat, start, end)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) + len(unique) > self.most or self._used_bytes > self.most_bytes:
            self._forget()
        at = np.searchsorted(self._known, unique)
        new = np.ones(len(unique), bool)
        near = at < len(self._known)
        new[near] = self._known[at[near]] != unique[near]
        if new.any():
            self._learn(flat, start[first[new]], end[first[new]], unique[new])
            at = np.searchsorted(self._known, unique)
        where = self._where[at][inverse]
        strange = self._strange(flat, start, where)
        if len(strange):
            where[strange] = self._add(flat, start[strange], end[strange])
        n = where[:, 1]
        base = np.cumsum(n) - n
        ids = self._pool[np.arange(int(n.sum())) + np.repeat(where[:, 0] - base, n)]
        ends = np.append(base, len(ids))
        return ids, ends[np.searchsorted(start, offsets)]
