"""Media columns over content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG of 192 samples a line, in tar shards of the shared
folder; a row carries the stored form's digest, its shard, offset and length. A task writes its own
shards under names of their own, and only shards that the stored index names count, so lost or
repeated tasks leave no trace in results. Equal payloads are stored once a shard; no payload is
shuffled. Metadata columns come from range reads of the headers alone (tar and PNG headers).
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches, shared_dir, stored, text_of

#: Samples in a line of an image; payloads are padded to a multiple of it.
LINE = 192
#: Bytes at which a task begins its next shard.
SHARD_BYTES = 256 << 20
#: A PNG file's first bytes, and the bytes up to its data's chunk.
PNG_START = b"\x89PNG\r\n\x1a\n"
PNG_HEADER = 33


def png(payload: bytes) -> bytes:
    """The payload as the samples of a greyscale image, losslessly."""
    raw = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)  # each line begins with filter 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", LINE, len(raw), 8, 0, 0, 0, 0)
    return PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height from a file's first bytes."""
    if header[:8] != PNG_START:
        raise ValueError("not a PNG")
    return struct.unpack(">II", header[16:24])


def png_samples(data: bytes) -> bytes:
    """The samples of an image that ``png`` made."""
    width, height = png_size(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        body += [part] if kind == b"IDAT" else []
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered lines")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean and deviation of the samples, and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    cells = np.add.reduceat(x, np.linspace(0, len(x), 64, endpoint=False).astype(int)) / np.diff(np.append(np.linspace(0, len(x), 64, endpoint=False).astype(int), len(x)))
    bits = int("".join("1" if c > cells.mean() else "0" for c in cells), 2)
    return f"h{len(x) // LINE}:m{x.mean():.3f}:s{x.std():.3f}:a{bits:016x}"


def store(rows: DataFrame, payload: str, name: str = "media") -> DataFrame:
    """Write each row's payload (of a positive multiple of 192 bytes) to tar shards; returns the
    stored index: the other columns, media_sha256, media_bytes, shard, offset (of the media's first
    byte) and length."""
    folder = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    others = [c for c in rows.columns if c != payload]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != payload)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        out, shard, at, known = None, "", 0, {}
        try:
            for batch in batches:
                b = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                found = {n: b[n] for n in others} | {n: [] for n in ("media_sha256", "media_bytes", "shard", "offset", "length")}
                for p in b[payload]:
                    key = hashlib.sha256(p).digest()
                    if key not in known or known[key][2] != shard:
                        if out is None or at > SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            shard, at, known = f"{folder}/{uuid.uuid4().hex}.tar", 0, {}
                            system, path = fs.FileSystem.from_uri(shard)
                            system.create_dir(path.rpartition("/")[0], recursive=True)
                            out = system.open_output_stream(path)
                        data = png(p)
                        digest = hashlib.sha256(data).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(data)
                        head = info.tobuf()
                        out.write(head + data + bytes(-len(data) % 512))
                        known[key] = digest, len(data), shard, at + len(head)
                        at += len(head) + len(data) + -len(data) % 512
                    digest, size, where, offset = known[key]
                    for n, v in zip(("media_sha256", "media_bytes", "shard", "offset", "length"), (digest, size, where, offset, size)):
                        found[n].append(v)
                yield pa.RecordBatch.from_pydict(found, schema=types)
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from trackloom.session import ship_package

    full = f"{schema}, media_sha256 string, media_bytes bigint, shard string, offset bigint, length bigint"
    types = to_arrow_schema(StructType.fromDDL(full))
    ship_package(rows.sparkSession)
    return stored(rows.mapInArrow(run, full), "media-index")


def _by_shard(index: DataFrame) -> DataFrame:
    """Rows of a shard together, in its order; a shard has the rows of one input split at most."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def _ranges(index: DataFrame, make_of, schema: str) -> DataFrame:
    """Columns from ranges of the shards; ``make_of()`` gives (bytes to read at most, function of
    the bytes to a tuple). Rows of one range are read once."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)

    def make():
        from pyarrow import fs

        most, work = make_of()
        last: list = [None, None, None, None]  # shard, its file, offset, values

        def run(b):
            out = {n: [] for n in names}
            for shard, offset, length in zip(b["shard"], b["offset"], b["length"]):
                if last[0] != shard:
                    if last[1] is not None:
                        last[1].close()
                    system, path = fs.FileSystem.from_uri(shard)
                    last[:] = shard, system.open_input_file(path), None, None
                if last[2] != offset:
                    last[2], last[3] = offset, work(last[1].read_at(length if most is None else min(most, length), offset))
                for n, v in zip(names, last[3]):
                    out[n].append(v)
            return b | out

        return run

    return map_batches(index, make, f"{before}, {schema}")


def with_header(index: DataFrame) -> DataFrame:
    """``index`` with width and height, filled by reading the media's headers alone."""
    return _ranges(_by_shard(index), lambda: (PNG_HEADER, png_size), "width bigint, height bigint")


def with_payload(index: DataFrame, read=None, schema: str = "payload binary") -> DataFrame:
    """``index`` with what ``read`` (bytes of a payload to a tuple) makes of the stored payloads."""

    def make():
        return None, lambda data: (read or (lambda x: (x,)))(png_samples(data))

    return _ranges(index, make, schema)


def _digests(samples: bytes) -> tuple:
    return hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), feature(samples)


def documents_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a stored payload, read back: key, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, and where it lies (shard, offset).

    A payload is the text's UTF-8 and spaces up to a positive multiple of 192 bytes; null texts are
    empty ones, of 192 spaces. One row for each row of ``docs``; equal texts have equal values but
    for their place, which is any of the shards that hold them. Other columns are left out. An
    empty table gives no rows.
    """
    raw = F.encode(text_of(text), "UTF-8")
    rows = docs.select(F.col(key), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), raw.alias("__raw"))
    wanted = F.greatest(F.ceil(F.col("n_bytes") / LINE), F.lit(1)) * LINE
    padded = rows.withColumn("__raw", F.concat("__raw", F.encode(F.repeat(F.lit(" "), (wanted - F.col("n_bytes")).cast("int")), "UTF-8")))
    index = with_header(store(padded, "__raw", "documents-media"))
    out = with_payload(index, _digests, "payload_sha256 string, tail_crc32 bigint, feature string")
    return out.select(key, "n_bytes", (F.col("width") * F.col("height")).alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset")
