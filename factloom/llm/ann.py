"""Approximate nearest neighbours: randomly rotated one-bit codes with error bounds that choose what to rerank.

1. Vectors are taken about a centre (the mean of a bounded sample), padded with zeros to ``BITS`` and rotated. The index
   is a table of chunks of packed signs, correction factors, distances to the centre, ids and the vectors themselves,
   written once; the padding buys a smaller error with more bits.
2. The query set becomes a table of blocks of bounded size. Each block meets each chunk: estimates of squared distances
   with bounds on their error come from the codes alone.
3. In a meeting a query's likeliest rows are measured first, exactly, in double precision, on the original vectors. The
   k-th distance found so far is its limit; of the other rows only those whose lower bound lies within it are measured.
   A task keeps the k best of each query that it has seen, so what leaves it is k rows for a query and task.

Nothing of the rows or the query set goes through the driver. Hot rows don't matter: a row meets each query once. The
query set is a part of the rows, so the meetings grow with their square; that is what is asked.

Defined results: unusable vectors (null, empty, zero, a null or non-finite component, another length than the
commonest) take no part on either side; rows with a null id take no part; fewer than k candidates are all returned;
ties go to the smaller id; repeated ids are candidates each on their own, but never of a query with their own id; an
empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rabitq
from .shared import Cuts

NEIGHBOURS = 10
#: Queries in a block, rows for the centre, rows in a chunk, bits of a code, width of the bounds in standard deviations.
BLOCK, CENTRE_ROWS, ROWS, BITS, DEVIATIONS = 512, 4096, 4096, 512, 2.5
CODED = "ids binary, codes binary, factors binary, norms binary, vectors binary"
ASKED = "block_ids binary, turned binary, block_norms binary, asked binary"
FOUND = "query_id long, vec_id long, score double"


def _rotated(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    r = x - centre
    norm = np.sqrt((r**2).sum(1))
    return r / np.maximum(norm, 1e-300)[:, None], norm


def _blobs(part: pa.RecordBatch, *arrays, names: str) -> pa.RecordBatch:
    columns = [part.column(0).to_numpy().astype("<i8"), *arrays]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[f.split()[0] for f in names.split(", ")])


def _index(centre: np.ndarray, dim: int, bits: int):
    """Chunks of codes and vectors."""

    def run(batches):
        turn = rabitq.rotation(dim, 1, bits)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = rabitq.matrix(part.column(1), dim)
                unit, norm = _rotated(x, centre, turn)
                yield _blobs(part, *rabitq.encode(unit, turn), norm, x, names=CODED)

    return run


def _ask(centre: np.ndarray, dim: int, bits: int, block: int):
    """Blocks of rotated queries."""

    def run(batches):
        turn = rabitq.rotation(dim, 1, bits)
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                x = rabitq.matrix(part.column(1), dim)
                unit, norm = _rotated(x, centre, turn)
                yield _blobs(part, (unit @ turn).astype(np.float32), norm, x, names=ASKED)

    return run


class Scan:
    """The k best of each of a block's queries over the chunks that it has met."""

    def __init__(self, ids: np.ndarray, turned: np.ndarray, norm: np.ndarray, asked: np.ndarray, k: int, deviations: float):
        self.ids, self.turned, self.norm, self.q, self.k, self.dev = ids, turned, norm, asked, k, deviations
        self.best_q = self.best_id = np.zeros(0, np.int64)
        self.best_d = np.zeros(0)
        self.limit = np.full(len(ids), np.inf)
        self.measured = 0

    def see(self, ids: np.ndarray, codes: np.ndarray, factor: np.ndarray, norm: np.ndarray, x: np.ndarray) -> None:
        inner = (self.turned @ rabitq.signs(codes).T) / np.maximum(factor, 1e-6)
        off = rabitq.error(factor, codes.shape[1] * 8, self.dev)
        scale = 2 * self.norm[:, None] * norm[None, :]
        middle = self.norm[:, None] ** 2 + norm[None, :] ** 2 - scale * np.clip(inner, -1, 1)
        low = middle - scale * off[None, :] - 1e-5
        own = ids[None, :] == self.ids[:, None]
        low[own] = middle[own] = np.inf
        if middle.shape[1] > 2 * self.k:  # the likeliest first, so that the limit is near its end when the rest is judged
            b = np.argpartition(middle, 2 * self.k, axis=1)[:, : 2 * self.k]
            a = np.repeat(np.arange(len(self.ids)), 2 * self.k)
            b = b.ravel()
            likely = low[a, b] <= self.limit[a]
            self.measure(a[likely], b[likely], ids, x)
            low[a, b] = np.inf
        self.measure(*np.nonzero((low <= self.limit[:, None]) & np.isfinite(low)), ids, x)

    def measure(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact distances of the pairs, and what they change among the best."""
        self.measured += len(a)
        d = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            d[part] = np.sqrt(((self.q[a[part]] - x[b[part]]) ** 2).sum(1))
        fine = np.isfinite(d)
        q, v, d = np.concatenate([self.best_q, a[fine]]), np.concatenate([self.best_id, ids[b[fine]]]), np.concatenate([self.best_d, d[fine]])
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.best_q, self.best_id, self.best_d = q[keep], v[keep], d[keep]
        size = np.bincount(self.best_q, minlength=len(self.ids))
        full = np.flatnonzero(size >= self.k)
        self.limit[full] = self.best_d[np.cumsum(size)[full] - 1] ** 2 * (1 + 1e-9)

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.best_q]), pa.array(self.best_id), pa.array(self.best_d)], names=["query_id", "vec_id", "score"])


def _scan(k: int, deviations: float, bits: int, dim: int):
    """Blocks against chunks; a row is a meeting."""

    def run(batches):
        scans: dict[bytes, Scan] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                numbers = lambda name, t, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_buffer(), t)
                name = hashlib.sha256(batch.column("block_ids")[i].as_buffer()).digest() + hashlib.sha256(batch.column("asked")[i].as_buffer()).digest()
                if name not in scans:
                    ids = numbers("block_ids", "<i8")
                    scans[name] = Scan(ids, numbers("turned", np.float32).reshape(len(ids), bits), numbers("block_norms", np.float64), numbers("asked", np.float64).reshape(len(ids), dim), k, deviations)
                chunk = numbers("ids", "<i8")
                scans[name].see(chunk, numbers("codes", np.uint8).reshape(len(chunk), bits // 8), numbers("factors", np.float32), numbers("norms", np.float64), numbers("vectors", np.float64).reshape(len(chunk), dim))
        for scan in scans.values():
            yield scan.result()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK, deviations: float = DEVIATIONS, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id and Euclidean distance of the k nearest rows of ``vectors`` to each query."""
    spark = vectors.sparkSession
    dim = rabitq.dimension(vectors)
    clean = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & rabitq.usable() & (F.size("embedding") == dim))
    rows, asked = clean(vectors), clean(queries)
    count = asked.count() if dim else 0
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cuts = Cuts(spark)
    size = -(-max(dim, bits) // 64) * 64
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).toPandas()
    centre = np.stack(sample["embedding"]).astype(np.float64).mean(0)
    index = cuts.keep(rows.mapInArrow(_index(centre, dim, size), CODED))
    blocks = cuts.keep(asked.repartition(-(-count // block)).mapInArrow(_ask(centre, dim, size, block), ASKED))
    # Spark broadcasts the blocks where their table is small; otherwise every task takes a part of each table
    found = index.crossJoin(blocks).mapInArrow(_scan(k, deviations, size, dim), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
