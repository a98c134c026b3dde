"""SentencePiece models of other kinds, written here piece by piece: parity or refusal."""

from __future__ import annotations

import struct

import numpy as np
import pytest
import sentencepiece

from trackloom.llm import sentencepiece_codec as codec


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _model(pieces, kind: int, trainer: bytes = b"", normaliser: bytes = b"") -> bytes:
    out = b""
    for p, s, k in pieces:
        out += _field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k))
    return out + _field(2, _field(3, kind) + trainer) + _field(3, _field(1, b"identity") + normaliser)


BASE = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
LETTERS = [(c, -6.0 - i / 10, codec.NORMAL) for i, c in enumerate("▁abcde")]
WORDS = [("▁ab", -2.0, codec.NORMAL), ("ab", -3.0, codec.NORMAL), ("abc", -3.5, codec.NORMAL), ("cd", -4.0, codec.NORMAL), ("▁de", -2.5, codec.NORMAL), ("bcd", -5.0, codec.NORMAL)]


def _texts(n: int, letters: str) -> list[str]:
    r = np.random.default_rng(7)
    return ["", " ", "a  b ", *("".join(r.choice(list(letters), r.integers(1, 40))) for _ in range(n))]


@pytest.mark.parametrize("letters", ("abcde ", "abcde xz"))
def test_unigram_without_byte_fallback(tmp_path, letters):
    path = tmp_path / "u.model"
    path.write_bytes(_model(BASE + LETTERS + WORDS, codec.UNIGRAM))
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), codec.Codec(str(path))
    texts = _texts(200, letters)
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t) for t in texts]
    assert own.decode(ids) == [library.decode(library.encode(t)) for t in texts]


def test_control_pieces_decode_to_nothing(tmp_path):
    path = tmp_path / "c.model"
    path.write_bytes(_model(BASE + LETTERS + WORDS, codec.UNIGRAM))
    own = codec.Codec(str(path))
    assert own.decode([np.array([1, 9, 2], "<u4").tobytes()]) == ["ab"]


@pytest.mark.parametrize("change", ({"pieces": [("[X]", 0.0, codec.USER)]}, {"trainer": _field(24, 1)}, {"normaliser": _field(5, 0)}, {"kind": 3}))
def test_models_that_differ_are_refused(tmp_path, change):
    path = tmp_path / "r.model"
    path.write_bytes(_model(BASE + LETTERS + change.get("pieces", []), change.get("kind", codec.UNIGRAM), change.get("trainer", b""), change.get("normaliser", b"")))
    with pytest.raises(ValueError, match="r.model"):
        codec.Codec(str(path))
