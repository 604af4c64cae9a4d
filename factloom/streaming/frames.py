"""Frames from chunks of bytes that arrive in any cut: what isn't a whole frame yet is held as state of its stream."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame

from factloom.sources.records import FrameDecoder

FRAMES = "stream string, frame long, length long, sha256 string, error string"
STATE = "held binary, count long, broken boolean"


def frame_stream(chunks: DataFrame) -> DataFrame:
    """Frames of a stream of chunks: stream, place, data, last (whether the stream ends with this chunk).

    Chunks of a trigger are taken in order of their place. After a framing error a stream gives nothing more; bytes left
    at its end are an error of their own. State is dropped when a stream ends.
    """

    def run(key, parts, state):
        held, count, broken = state.get if state.exists else (b"", 0, False)
        d, out, ended = FrameDecoder(), [], False
        d.held, d.count = bytearray(held), count
        rows = pd.concat(list(parts)).sort_values("place")
        for data, last in zip(rows["data"], rows["last"], strict=True):
            if not broken:
                try:
                    for i, payload in d.push(bytes(data or b"")):
                        out.append((key[0], i, len(payload), hashlib.sha256(payload).hexdigest(), None))
                    if last:
                        d.end()
                except ValueError as e:
                    out.append((key[0], d.count + 1, None, None, str(e)))
                    broken = True
            ended = ended or bool(last)
        if ended:
            state.remove()
        else:
            state.update((b"" if broken else bytes(d.held), d.count, broken))
        yield pd.DataFrame(out, columns=["stream", "frame", "length", "sha256", "error"]).astype({"length": "Int64"})

    return chunks.groupBy("stream").applyInPandasWithState(run, FRAMES, STATE, "append", "NoTimeout")
