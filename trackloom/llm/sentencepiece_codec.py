"""SentencePiece models on the tokenizers library's backend.

The model's protobuf is parsed here: pieces with scores and kinds, the trainer's model type and byte
fallback, and the normaliser. From these a tokenizers model is rebuilt (merges in the order of the
pieces' scores, or unigram scores), with the metaspace marker and byte fallback. Where no piece has
a marker after another character, a text can be cut before each run of markers, and each distinct
cut is encoded once a worker, in multithreaded batches. A worker checks its first distinct cuts against
the sentencepiece library and fails if any differs. Models that can't be rebuilt with equal results
(user-defined pieces, spaces unescaped or after words, other kinds) are refused.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches, text_of

MARKER = "▁"
#: Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Distinct cuts that a worker remembers at most, and those that it checks for parity.
REMEMBERED, CHECKED = 150_000, 2_000
#: Threads that encode a batch.
THREADS = 2
#: Characters of texts that are cut and encoded at once.
BLOCK = 1 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False
    unknown_surface: str = " \u2047 "


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; lengths give bytes, others numbers or raw bytes."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            c = data[at]
            n |= (c & 127) << shift
            at, shift = at + 1, shift + 7
            if c < 128:
                return n, at

    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if wire == 2 else (8 if wire == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            m.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            m.kind, m.byte_fallback, m.unknown = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
            m.suffix = bool(t.get(24, 0))
            m.unknown_surface = t[44].decode() if 44 in t else m.unknown_surface
        elif number == 3:
            n = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
            m.escape = bool(n.get(5, 1))
    return m


def refused(m: Model) -> str | None:
    """Why a model can't be rebuilt with equal results; None if it can."""
    if m.kind not in (UNIGRAM, BPE):
        return "only unigram and BPE models are rebuilt"
    if not m.escape or m.suffix:
        return "spaces must be escaped by markers before words"
    if any(k == USER for _, _, k in m.pieces):
        return "user-defined pieces are not rebuilt"
    return None


def rebuilt(m: Model):
    """The tokenizers object without its own normaliser: ``normalised`` runs before it."""
    from tokenizers import Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        joined = {p for p, _, k in m.pieces if k in (NORMAL, USER)}
        merges = []
        for p, s, k in m.pieces:
            if k == NORMAL:
                halves = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in joined and p[i:] in joined]
                merges += [(-s, ids[p], ids[a], ids[b], a, b) for a, b in halves]
        merges.sort(key=lambda x: x[:4])
        model = models.BPE(ids, [x[4:] for x in merges], unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    def __init__(self, path: str, checked: int = CHECKED):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        if why := refused(self.model):
            raise ValueError(f"{path}: {why}")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.backend = rebuilt(self.model)
        self.path, self.unchecked, self.memory = path, checked, {}
        self.cuttable = self.model.kind == BPE and not any(MARKER in p.lstrip(MARKER) for p, _, k in self.model.pieces if k in (NORMAL, USER)) and not any(k == USER for _, _, k in self.model.pieces)

    @functools.cached_property
    def _charsmap(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None

    def normalised(self, text: str) -> str:
        """The text after the model's character map and space rules, with markers for spaces."""
        if self._charsmap is not None:
            text = self._charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if not text:
            return ""
        return (MARKER if self.model.dummy_prefix else "") + text.replace(" ", MARKER)

    def _cuts(self, text: str) -> list[str]:
        """The normalised text in parts that encode independently."""
        t = self.normalised(text)
        if not self.cuttable:
            return [t] if t else []
        if MARKER * 2 in t or t[-1:] == MARKER or t[:1] != MARKER:
            return re.findall(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+", t)
        return [MARKER + w for w in t[1:].split(MARKER)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; few texts' cuts are held at once."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            out += self._encode(texts[i:j])
            i = j
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self._cuts(t) for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        memory = self.memory
        new = list({c for one in cuts for c in one if c not in memory})
        for i in range(0, len(new), 4_000):
            part = new[i : i + 4_000]
            found = [e.ids for e in self.backend.encode_batch_fast(part, add_special_tokens=False)]
            memory.update((c, np.array(ids, "<u4").tobytes()) for c, ids in zip(part, found))
            self._check(part, found)
        return [b"".join(map(memory.__getitem__, one)) for one in cuts]

    def _check(self, cuts: list[str], found: list[list[int]]) -> None:
        if self.unchecked > 0 and self.model.dummy_prefix:
            import sentencepiece

            pairs = [(c, ids) for c, ids in zip(cuts, found) if c[:1] == MARKER and len(c) > 1][: self.unchecked]
            self.unchecked -= len(pairs)
            library = sentencepiece.SentencePieceProcessor(model_file=self.path)
            for c, ids in pairs:
                if library.encode(c[1:].replace(MARKER, " ")) != ids:
                    raise ValueError(f"the rebuilt model differs from the library on {c!r}")

    @functools.cached_property
    def _bytes(self) -> list[bytes]:
        """What each id stands for, with spaces for markers; nothing for control pieces."""
        told = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: self.model.unknown_surface.encode()}
        return [told.get(k, lambda p: p.replace(MARKER, " ").encode())(p) for p, _, k in self.model.pieces]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Pieces' bytes joined; the backend's decoder where they are no whole characters."""
        out = []
        for x in ids:
            one = np.frombuffer(x, "<u4").tolist()
            try:
                text = b"".join(map(self._bytes.__getitem__, one)).decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.backend.decode(one, skip_special_tokens=False))
        return out


@functools.lru_cache(2)
def codec_of(path: str) -> Codec:
    """One codec a worker process, which later tasks use again."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with piece_ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded:
    the text that these ids give back.

    Null and empty texts have no ids and decode to the empty text. Texts are encoded whole. Columns
    of these names are replaced, all others stay. Rows are independent, there is no shuffle.
    ``path`` must be readable by all executors, as the installed model files are.
    """
    rows = docs.drop("piece_ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def make():
        codec = codec_of(path)

        def work(b):
            ids = codec.encode([t or "" for t in b[text]])
            return b | {"piece_ids": ids} | ({"decoded": codec.decode(ids)} if decode else {})

        return work

    return map_batches(rows, make, f"{schema}, piece_ids binary" + ", decoded string" * decode)


def decode(rows: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with decoded, the text of their ids; null ids give null."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def make():
        codec = codec_of(path)

        def work(b):
            texts = iter(codec.decode([x for x in b[ids] if x is not None]))
            return b | {"decoded": [None if x is None else next(texts) for x in b[ids]]}

        return work

    return map_batches(rows, make, f"{schema}, decoded string")


def round_trips(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each text: key, n_bytes, n_pieces, ids_crc32, decoded_sha256 and round_trip (whether the
    decoded text is the text)."""
    rows = encode(docs.select(key, text_of(text).alias("__text")), path, "__text", decode=True)
    return rows.select(key, F.octet_length("__text").cast("long").alias("n_bytes"), (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("__text")).alias("round_trip"))
