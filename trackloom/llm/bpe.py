"""Byte-level BPE over space-led chunks, exact for the public vocabulary of the operators.

The pre-tokeniser's pattern always starts a new pre-token at a space that a non-space follows, so a
text without a space before white space or its end can be cut at all its spaces: the chunks' ids,
joined, are the text's ids. Words repeat, so each distinct chunk is encoded once a task.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import regex
import tiktoken

#: Fixed value: the special string of the public vocabulary and its id.
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Chunks that a task remembers at most; beyond it the memory starts anew.
REMEMBERED = 300_000

_UNSAFE = re.compile(r" (?=\s|\Z)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(4)
def whole_tokens(json_path: str) -> frozenset[str]:
    """The vocabulary strings that the library proves to encode, alone, as one token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(json_path)
    texts = t.decode_batch([[i] for i in range(t.get_vocab_size(with_added_tokens=False))])
    found = t.encode_batch_fast(texts, add_special_tokens=False)
    split = pattern()
    return frozenset(s for s, e in zip(texts, found) if s and "�" not in s and len(e.ids) == 1 and split.findall(s) == [s])


class _Remembered(dict):
    """Values of chunks; ``lead`` stands before each."""

    def __init__(self, value, lead: str, known=()):
        super().__init__(known)
        self.value, self.lead, self.known = value, lead, known

    def __missing__(self, chunk: str):
        if len(self) >= REMEMBERED + len(self.known):
            self.clear()
            self.update(self.known)
        out = self[chunk] = self.value(self.lead + chunk)
        return out


class Counter:
    """Token counts by the whole-token shortcut: pre-tokens that are proven whole count as one,
    and only the rest is merged."""

    def __init__(self, ranks_path: str, whole: frozenset[str]):
        merge, split = encoder(ranks_path).encode_ordinary, pattern().findall

        def value(chunk: str) -> int:
            return sum(1 if p in whole else len(merge(p)) for p in split(chunk))

        self._value = value
        self._head = _Remembered(value, "", {s: 1 for s in whole if " " not in s})
        self._rest = _Remembered(value, " ", {s[1:]: 1 for s in whole if s[0] == " " and " " not in s[1:]})

    def __call__(self, text: str) -> int:
        if SPECIAL in text:
            parts = text.split(SPECIAL)
            return len(parts) - 1 + sum(map(self, parts))
        if not text:
            return 0
        if _UNSAFE.search(text):
            return self._value(text)
        chunks = text.split(" ")
        first = chunks.pop(0)
        return (self._head[first] if first else 0) + sum(map(self._rest.__getitem__, chunks))


class Ids:
    """Token ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, ranks_path: str):
        encode = encoder(ranks_path).encode_ordinary

        def value(chunk: str) -> bytes:
            return np.array(encode(chunk), "<u4").tobytes()

        self._value = value
        self._head, self._rest = _Remembered(value, ""), _Remembered(value, " ")

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self, text.split(SPECIAL)))
        if not text:
            return b""
        if _UNSAFE.search(text):
            return self._value(text)
        chunks = text.split(" ")
        first = chunks.pop(0)
        return (self._head[first] if first else b"") + b"".join(map(self._rest.__getitem__, chunks))
