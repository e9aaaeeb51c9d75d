import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import pieces


def odd_texts():
    rng = random.Random(1)
    out = ["", None, "a", "  ", " a ", "a  b\n c\t d ", "▁x y▁", "x▁▁ y", "\n", "\r\n});\r\n", "é́ ﬁ 😀", "a" * 50, " " * 40, "\x00b <s> </s> <unk> <0x41>", "日本語", "long text " * 20_000]
    return out + ["".join(rng.choice("ab  \n\t\r▁é😀)};the") for _ in range(rng.randrange(60))) for _ in range(800)]


def test_as_the_library(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    library = pieces.encoder(pieces.model_path()).library
    out = {r.doc_id: r for r in pieces.digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = out[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    some = pieces.encode(docs.where("doc_id < 20"), ("ids", "decoded"), marks=False).collect()
    assert all(r.ids == library.encode(texts[r.doc_id] or "") and r.decoded == library.decode(r.ids) for r in some)
    assert pieces.digests(docs.limit(0)).count() == 0


def test_a_full_table_starts_anew():
    from tidelog.llm import kernels as K
    import pyarrow as pa

    own = pieces.Encoder(pieces.model_path(), most=50)
    for t in odd_texts()[2:200]:
        for _, _, data, offsets in K.chunks(pa.array([t])):
            assert own.encode(data, offsets)[0].tolist() == own.library.encode(t)


def test_a_difference_fails():
    own = pieces.encoder(pieces.model_path())
    data = np.frombuffer(b"some text", np.uint8)
    with pytest.raises(pieces.Mismatch):
        pieces.check(own, np.array([1, 2]), np.array([0, 2]), data, np.array([0, 9]), 0)


def encoded(own, texts):
    import pyarrow as pa

    from tidelog.llm import kernels as K

    out = []
    for _, _, data, offsets in K.chunks(pa.array(texts)):
        ids, ends = own.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_fool_polynomials(n):
    own = pieces.Encoder(pieces.model_path())
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word]
    assert encoded(own, texts) == own.library.encode(texts)


def test_long_segments_have_their_own_agenda():
    rng = random.Random(3)
    own = pieces.Encoder(pieces.model_path())
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [word("etaoinshrdlu", n) for n in (199, 200, 201, 202, 5000, 1 << 20)] + [word("日本語é☃\U0001f600a", 3000), "x" * 9000, "ab" * 500 + " " + word("the", 400) + "\n" + word("the", 900)]
    assert encoded(own, texts) == own.library.encode(texts)


def test_segments_that_share_a_hash(monkeypatch):
    """Bytes decide: with a hash of seven values the ids are still the library's."""
    from tidelog.llm import kernels as K

    real = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda data, start, end: real(data, start, end) % np.uint64(7))
    own = pieces.Encoder(pieces.model_path())
    texts = [t or "" for t in odd_texts()]
    assert encoded(own, texts) == own.library.encode(texts)


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "c"), (None, "a b")], "doc_id long, text string").repartition(2)
    assert sorted(r.n_tokens for r in pieces.digests(docs).collect()) == sorted(2 + len(pieces.encoder(pieces.model_path()).library.encode(t)) for t in ("a b", "c", "c", "a b"))
