"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

:class:`tidelog.llm.bpe.Encoder` merges; the sentencepiece library itself encodes one text of every chunk again and a
difference fails the task.  Decoding is the library's.

Null text counts as empty; an empty text has only the begin and end ids; equal texts give equal rows; rows and their
order of columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames
from .bpe import Encoder

FIELDS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
CHUNK = 1 << 19


@functools.cache
def encoder(model_file: str) -> Encoder:
    """One encoder a Python worker; its table of segments serves later tasks too."""
    return Encoder(model_file)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Mismatch(ValueError):
    """The agenda and the library disagree."""


def check(own: Encoder, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: int) -> None:
    """Holds row ``at`` against the library."""
    text = data[offsets[at] : offsets[at + 1]].tobytes().decode()
    if own.library.encode(text) != ids[ends[at] : ends[at + 1]].tolist():
        raise Mismatch(f"ids differ from the library's for {text[:80]!r}")


def encode(
    docs: DataFrame, columns: tuple[str, ...] = ("ids", "n_tokens"), keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    model_file: str | None = None, marks: bool = True, checked: bool = True,
) -> DataFrame:
    """``keep`` and the asked ``columns`` of FIELDS.  ``marks``: with begin and end ids."""
    path = model_file or model_path()

    def make():
        own = encoder(path)
        front, back = ([own.begin], [own.end]) if marks else ([], [])
        marked = np.array([len(front), len(back)])

        def f(data, offsets, rows):
            ids, ends = own.encode(data, offsets)
            n = len(offsets) - 1
            if checked:
                check(own, ids, ends, data, offsets, int(offsets[-1]) % n)
            made: dict[str, object] = {"n_tokens": np.diff(ends) + marked.sum()}
            whole = [front + x.tolist() + back for x in np.split(ids, ends[1:-1])]
            if "ids" in columns:
                made["ids"] = pa.array(whole, pa.list_(pa.int32()))
            if "ids_sha256" in columns:
                made["ids_sha256"] = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in whole]
            if {"decoded", "decoded_sha256"} & set(columns):
                texts = own.library.decode(whole, num_threads=1)
                made["decoded"] = texts
                if "decoded_sha256" in columns:
                    made["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            return [made[c] for c in columns]

        return f

    return frames.map_text(docs, make, ", ".join(f"{c} {FIELDS[c]}" for c in columns), keep, text, chunk=CHUNK)


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"), model_file=model_file)
