"""Media columns: texts as baseline JPEG images, and what is read back from the stored bytes.

Defined results. A null text is the empty one, whose payload is 192 spaces. Payloads longer than one image can hold raise
an error (4 GB, beyond any string). Equal texts give equal rows. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm import jpeg
from ledgerlark.llm.common import short_batches, texts

UNIT = 192
#: Payload bytes that are coded side by side; a longer text is coded alone.
TOGETHER = 2_000_000
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def runs(sizes: list[int], most: int):
    """Neighbours whose sizes add up to at most so much (or one that is larger): (from, to)."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's payload as a JPEG image."""
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in payloads]
            payloads = [payload_of(t) for t in payloads]
            for a, b in runs(sizes, TOGETHER):
                media = jpeg.encode_many(payloads[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(sizes[a:b], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Decode stored images: digests of the payload read back, dimensions and the thumbnail's hash."""
    short_batches(stored.sparkSession)

    def run(batches):
        for batch in batches:
            ids, n_bytes, media = (c.to_pylist() for c in batch.columns)
            for a, b in runs([len(m) for m in media], TOGETHER):
                out = []
                for i, n, m, x in zip(ids[a:b], n_bytes[a:b], media[a:b], jpeg.decode_many(media[a:b]), strict=True):
                    payload = jpeg.payload_of(x)
                    out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{x.width}x{x.height}:{jpeg.thumbnail_hash(x.thumbnail)}"))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [c.split()[0] for c in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
