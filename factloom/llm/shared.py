"""Pieces that several training-data operators share: lineage cuts, vectorised word hashing, bounded label samples
and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time (a longer single text is one step of its own); its arrays take
#: 70 to 90 times as much.
STEP_BYTES = 1 << 19


# --------------------------------------------------------------------------------------------- lineage cuts


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is configured, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"file://{tempfile.gettempdir()}/factloom-shared"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Cuts:
    """Tables written to the shared folder so that a lost executor costs one stage, not the whole lineage.

    ``keep(df)`` writes and rereads; ``drop(df)`` deletes a table that no later step reads. What a returned DataFrame
    still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/factloom-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self._at_end)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._factloom_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_factloom_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _at_end(self) -> None:
        if self.made and self.spark.sparkContext._jsc is not None:  # a stopped session has nothing left to ask
            with contextlib.suppress(Exception):  # the session may be going down at the same time
                self._delete(self.root)


# --------------------------------------------------------------------------------------------- word hashing


def byte_table(separators: bytes, lower: bool = False, letters_only: bool = False) -> np.ndarray:
    """256 codes: 0 marks a separator, any other value is what a byte adds to its word's hash."""
    table = np.arange(1, 257, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    if letters_only:
        for b in range(128):
            if not (65 <= b < 91 or 97 <= b < 123):
                table[b] = 0
    table[list(separators)] = 0
    return table


def shape_table(separators: bytes) -> np.ndarray:
    """Codes by character class: lower case and non-ASCII letters, upper case, digits; other bytes as themselves."""
    table = np.arange(1000, 1256, dtype=np.uint64)
    table[97:123], table[128:], table[65:91], table[48:58] = 1, 1, 2, 3
    table[list(separators)] = 0
    return table


#: White space that ends a word wherever an operator doesn't say otherwise: space and \t to \r.
SPACE = b" \t\n\v\f\r"
_POSITION = np.random.default_rng(20240229).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null reads as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges of at most ``limit`` bytes each, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Words of the rows: start of each, the code of each byte, and for each row its first word (n + 1 entries)."""
    code = table[data]
    inside = code != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= inside[firsts]
    starts = np.flatnonzero(begins)
    return starts, code, np.searchsorted(starts, offsets)


def word_hashes(starts: np.ndarray, code: np.ndarray, prefix: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(code), dtype=np.int64)
    which = np.zeros(len(code), np.int64)
    which[starts[1:]] = 1
    at -= starts[np.cumsum(which)]
    part = code * _POSITION[at & 4095]
    if prefix:
        part[at >= prefix] = 0
    else:
        long = at >= 4096
        if long.any():  # positions past the table get another multiplier for each round
            part[long] = code[long] * mix(_POSITION[at[long] & 4095] + (at[long] >> 12).astype(np.uint64))
    part[: starts[0]] = 0
    return mix(np.add.reduceat(part, starts))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int):
    """64-bit hashes of runs of ``size`` words and each row's bounds; a shorter row gives its whole sequence as one."""
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    left = bounds[row + 1] - at
    h = np.zeros(len(row), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        h = np.where(k < left, mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), h)
    return h, out_bounds


# --------------------------------------------------------------------------------------------- labels


def fold(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fold_of(doc_id: int, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, columns=("text", "lang")) -> DataFrame:
    """All labelled rows outside fold 0: doc_id, the columns and y.

    Of rows that repeat an id the smallest text counts, of several labels of one document the largest; null ids, labels
    and texts take no part.
    """
    own = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    rows = docs.select("doc_id", *columns).where(F.col("text").isNotNull()).join(own, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c != "text"], "y")).alias("r"))
    return one.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in (*columns, "y")])


#: Most bytes of text that a fit takes to the driver.
SAMPLE_BYTES = 256 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, columns=("text", "lang"), most_bytes: int = SAMPLE_BYTES):
    """Up to ``limit`` labelled rows outside fold 0, chosen by a hash of the id; a pandas frame ordered by doc_id.

    The documents are read once and joined with at most ``limit`` ids; of rows that repeat an id the smallest text
    counts. Only what fits into ``most_bytes`` of whole texts, in the order of that hash, goes to the driver. Several
    labels of one document count as the largest; null ids, labels and texts take no part.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    )
    picked = spark.createDataFrame(chosen.astype({"doc_id": "int64", "y": "int32"}), "doc_id long, y int")
    rows = docs.select("doc_id", *columns).where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c != "text"], "y")).alias("r")).select("doc_id", "r.*")
    cuts = Cuts(spark)
    small = cuts.keep(one.withColumn("size", F.octet_length("text")).withColumn("place", F.xxhash64("doc_id")))
    sizes = small.select("place", "doc_id", "size").toPandas().sort_values(["place", "doc_id"])
    fits = sizes["doc_id"][sizes["size"].cumsum() <= most_bytes].tolist()
    if len(fits) < len(sizes):
        small = small.join(F.broadcast(spark.createDataFrame([(i,) for i in fits], "doc_id long")), "doc_id")
    found = small.select("doc_id", *columns, "y").toPandas().sort_values("doc_id").reset_index(drop=True)
    cuts.drop(small)
    give_back()
    return found


def give_back() -> None:
    """Returns freed memory to the system, so that the peak of a fit isn't held by the driver while later jobs run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """``run`` over a task's batches, giving its memory back at the end: Spark keeps a worker for later tasks and stages,
    several for each executor, and without this each of them keeps the peak of the largest task it has had."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# --------------------------------------------------------------------------------------------- components


def components(cuts: Cuts, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each end of ``edges`` (a, b), as (id, component_id).

    Every node first points at the smallest of itself and its neighbours; each round then hooks roots over the edges
    and halves the paths, until no pointer moves. Pointers only fall, so re-run tasks give the same table. Hubs are
    only ever joined as plain shuffled rows (which adaptive execution can split) or reduced by a map-side minimum.
    """
    both = edges.select(F.col("a"), F.col("b")).where("a <> b")
    both = cuts.keep(both.union(both.select("b", "a")).distinct())
    point = cuts.keep(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("to")))
    for _ in range(rounds):
        # what each node's neighbours point at, offered to the node's own target, and the target's target
        near = both.join(point.withColumnRenamed("to", "nt"), both.b == point.id).select("a", "nt")
        offers = near.join(point, near.a == point.id).select(F.col("to").alias("id"), F.col("nt").alias("to"))
        own = near.select(F.col("a").alias("id"), F.col("nt").alias("to"))
        hop = point.alias("p").join(point.alias("q"), F.col("p.to") == F.col("q.id")).select(F.col("p.id").alias("id"), F.col("q.to").alias("to"))
        after = cuts.keep(point.union(offers).union(own).union(hop).groupBy("id").agg(F.min("to").alias("to")))
        moved = after.alias("x").join(point.alias("y"), "id").where(F.col("x.to") != F.col("y.to")).limit(1).count()
        cuts.drop(point)
        point = after
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    cuts.drop(both)
    return point.select("id", F.col("to").alias("component_id"))
