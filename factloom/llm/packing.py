"""Packing: sum-of-squares online packing of tokenised documents into windows of fixed length.

A document is its token ids and a closing id. Whole windows' worth of it fill windows of their own; the rest goes,
online, to the fill level that leaves the smallest sum of squared counts of partially filled windows (counts per level
stand in an array; a new window is level 0 and costs what it adds). At the end of a partition, and whenever more than
``MOST_OPEN`` windows are open, the emptiest open windows are cut into the gaps of the fullest ones, which leaves one
open window at most; so a partition pads one window at most.

Every partition packs on its own, in one pass and without a shuffle; a re-run task gives the same windows. A task holds
its open windows only. Window ids are the partition's number and a count.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each on their own (also under
a null doc_id); very long texts are cut into whole windows; of levels that cost the same the fullest is taken; an empty
table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Vocabulary, library_merge, text_steps, worker_encoder
from .shared import lean

WINDOW = 1024
CLOSING_ID = 0
#: Open windows that a task holds (at 1024 ids each, 16 MB).
MOST_OPEN = 4096
#: Characters of text that are encoded at a time.
STEP_CHARS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Open windows by fill level; ``place`` and ``finish`` yield pieces of windows that are complete."""

    def __init__(self, size: int, first: int, most: int = MOST_OPEN):
        self.size, self.next, self.most = size, first, most
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]  # by level: windows, each a list of pieces

    def level(self, length: int) -> int:
        """The level whose windows (0: a new one) take ``length`` at the least sum of squares; the fullest on ties."""
        n = self.count
        top = self.size - length
        cost = 2 * (n[length : self.size + 1] - n[: top + 1]) + 2
        cost[0] = 2 * n[length] + 1
        cost[top] = 0 if top == 0 else 1 - 2 * n[top]  # a full window is no longer counted
        cost = np.where((n[: top + 1] > 0), cost, np.iinfo(np.int64).max)
        cost[0] = 0 if top == 0 else 2 * n[length] + 1
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece):
        length = piece[2]
        h = self.level(length)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + length == self.size:
            yield from self.emit(window)
        else:
            self.open[h + length].append(window)
            self.count[h + length] += 1
            if not h and self.count.sum() > self.most:
                yield from self.cut()

    def emit(self, window):
        at = 0
        for doc, start, length, ids, total in window:
            yield doc, start, length, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at
            at += length
        self.next += 1

    def cut(self):
        """Cuts the emptiest windows into the gaps of the fullest; what doesn't fill a window stays open."""
        left = [w for level in reversed(self.open) for w in level]
        fill = [sum(p[2] for p in w) for w in left]
        self.open, self.count[:] = [[] for _ in range(self.size + 1)], 0
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.size - fill[i]
            if gap == 0:
                yield from self.emit(left[i])
                i += 1
                continue
            doc, start, length, ids, total = left[j].pop()
            take = min(gap, length)
            left[i].append((doc, start + length - take, take, ids[length - take :], total))
            fill[i] += take
            if length > take:
                left[j].append((doc, start, length - take, ids[: length - take], total))
            fill[j] -= take
            if not left[j]:
                j -= 1
        for w, full in zip(left[i : j + 1], fill[i : j + 1], strict=True):
            if full == self.size:
                yield from self.emit(w)
            else:
                self.open[full].append(w)
                self.count[full] += 1

    def finish(self):
        yield from self.cut()
        for w in [w for level in self.open for w in level]:
            yield from self.emit(w)


def pack(docs: DataFrame, path: str, window: int = WINDOW, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window."""
    bc = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # fixed size: the vocabulary

    def table(rows):
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        e = worker_encoder(bc.value, path, library_merge)
        for batch in batches:
            for begin, texts in text_steps(batch.column(1), STEP_CHARS):
                ids, bounds = e.rows(texts)
                doc_ids = batch.column(0).slice(begin, len(texts)).to_pylist()
                rows = []
                for doc, a, b in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.int32(closing))
                    total = len(own)
                    whole = total - total % window
                    for k in range(0, whole, window):
                        rows.extend(packer.emit([(doc, k, window, own[k : k + window], total)]))
                    if whole < total:
                        rows.extend(packer.place((doc, whole, total - whole, own[whole:].copy(), total)))
                yield table(rows)
        yield table(list(packer.finish()))

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
