"""Fixed-width records and length-prefixed frames."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record layout (name, first character, length) and the frame limit.
LAYOUT = (("customer_id", 1, 10), ("change_type", 11, 2), ("new_value", 13, 40), ("correlation_id", 53, 32), ("record_checksum", 85, 64))
RECORD_LENGTH, FRAME_LIMIT = 148, 64 << 20


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of fixed-width lines; a wrong length or checksum is reported, not dropped."""
    raw = {name: F.substring(column, at, size) for name, at, size in LAYOUT}
    computed = F.sha2(F.concat_ws("|", *[raw[n] for n, _, _ in LAYOUT[:4]]), 256)
    right = F.coalesce(F.length(column) == RECORD_LENGTH, F.lit(False))
    return lines.select(
        *[F.when(right, F.rtrim(raw[n]) if n == "new_value" else F.trim(raw[n])).alias(n) for n, _, _ in LAYOUT],
        right.alias("length_ok"), (right & (raw["record_checksum"] == computed)).alias("checksum_ok"),
    )


def render_records(df: DataFrame, customer: Column, change: Column, value: Column, correlation: Column) -> DataFrame:
    fields = [F.rpad(c.cast("string"), size, " ") for c, (_, _, size) in zip((customer, change, value, correlation), LAYOUT, strict=False)]
    return df.select("*", F.concat(*fields, F.sha2(F.concat_ws("|", *fields), 256)).alias("value"))


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.text(path))


def encode_frame(payload: bytes) -> bytes:
    if not payload:
        raise ValueError("FRAMING_LENGTH_ZERO")
    if len(payload) > FRAME_LIMIT:
        raise ValueError("FRAMING_TOO_LARGE")
    return struct.pack("<I", len(payload)) + payload


class FrameDecoder:
    """Incremental decoding: push bytes, take whole frames, end the stream."""

    def __init__(self):
        self.held, self.count = bytearray(), 0

    def push(self, data: bytes):
        self.held += data
        while len(self.held) >= 4:
            size = struct.unpack_from("<I", self.held)[0]
            if size == 0:
                raise ValueError("FRAMING_LENGTH_ZERO")
            if size > FRAME_LIMIT:
                raise ValueError("FRAMING_TOO_LARGE")
            if len(self.held) < 4 + size:
                return
            self.count += 1
            yield self.count, bytes(self.held[4 : 4 + size])
            del self.held[: 4 + size]

    def end(self) -> None:
        if self.held:
            raise ValueError("FRAMING_TRUNCATED_HEADER" if len(self.held) < 4 else "FRAMING_TRUNCATED_PAYLOAD")


def frame(payload: Column) -> Column:
    """A payload with its length before it; an empty one, or one beyond the limit, fails the job."""
    size = F.octet_length(payload)
    parts = [F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]
    wrong = F.when(size == 0, F.raise_error(F.lit("FRAMING_LENGTH_ZERO"))).when(size > FRAME_LIMIT, F.raise_error(F.lit("FRAMING_TOO_LARGE")))
    return F.coalesce(wrong.cast("binary"), F.concat(F.unhex(F.concat(*parts)), payload))


def decode_frames(df: DataFrame, column: str) -> DataFrame:
    """Replaces a column of whole streams by their frames: frame (from 1), length, sha256, and error where one breaks off."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [c for c in df.columns if c not in (column, "frame", "length", "sha256", "error")]
    new = T._parse_datatype_string("frame long, length long, sha256 string, error string").fields

    def run(batches):
        for batch in batches:
            at, out = [], []
            for k, content in enumerate(batch.column(len(names)).to_pylist()):
                d, error = FrameDecoder(), None
                try:
                    for i, payload in d.push(content or b""):
                        at.append(k)
                        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), None))
                    d.end()
                except ValueError as e:
                    error = str(e)
                if error:
                    at.append(k)
                    out.append((d.count + 1, None, None, error))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(names)]]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*names, *(f.name for f in new)])

    return df.select(*names, column).mapInArrow(run, T.StructType([*[df.schema[c] for c in names], *new]))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of each file: path, frame (from 1), length, sha256, error. A file is one row, so it can hold 2 GB at most."""
    return decode_frames(spark.read.format("binaryFile").load(path).select("path", "content"), "content")
