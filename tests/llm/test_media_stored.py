"""What media.documents_as_media stored, read back here from the shards themselves."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np

from trackloom.llm import media

TEXTS = [None, "", "x" * 191, "x" * 192, "é" * 300, "plain words " * 900, "plain words " * 900]


def _plain_feature(b: bytes) -> str:
    """Mean and deviation of the bytes, and which of 64 parts lie above the parts' mean."""
    x = list(b)
    mean = sum(x) / len(x)
    deviation = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
    at = [int(len(x) * i / 64) for i in range(65)]
    parts = [sum(x[i:j]) / (j - i) for i, j in zip(at, at[1:])]
    bits = "".join("1" if p > sum(parts) / 64 + 1e-12 else "0" for p in parts)
    return f"h{len(x) // 192}:m{mean:.3f}:s{deviation:.3f}:a{int(bits, 2):016x}"


def test_stored_bytes_hashes_and_features(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, shard string")
    got = {r.doc_id: r for r in media.documents_as_media(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.media_bytes)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and r.n_bytes == len(raw)
        width, height = struct.unpack(">II", stored[16:24])
        body = zlib.decompress(stored[41 : 41 + struct.unpack(">I", stored[33:37])[0]])
        assert width == 192 and b"".join(body[k * 193 + 1 : (k + 1) * 193] for k in range(height)) == payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.feature == _plain_feature(payload)
    assert got[5].media_sha256 == got[6].media_sha256
    with tarfile.open(got[5].shard.removeprefix("file://")) as t:
        assert len(t.getmembers()) >= 1


def test_constant_and_short_payloads_have_features():
    for payload in (b" " * 192, bytes(range(192)), b"\xff" * 384):
        assert media.feature(payload) == _plain_feature(payload)
        assert np.frombuffer(media.png_samples(media.png(payload)), np.uint8).tobytes() == payload
