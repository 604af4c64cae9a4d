"""Embedding near-duplicates: randomised-rotation binary codes whose bounds decide which pairs are recomputed.

1. Identical vectors become one class (smallest id, number of copies), so copies are never paired.
2. Each class gets signs of independent random rotations, cut into bands; classes that share a band's signs meet. The
   width and number of bands follow from the number of classes and the wanted miss probability at the threshold.
3. Pairs are estimated from packed codes and stored correction factors against the other side's randomly rounded rotated
   vector (unbiased, both ways round); a pair whose upper confidence bound is below the threshold is dropped. What is left
   joins vectors into candidate groups; only spanning edges leave a task. In a band bucket of up to ``BLOCK`` members all
   pairs are estimated. In a larger one every member is first compared with a representative that a hash picks for each
   bucket anew, which is enough for most of a dense group; then, where its members are still in several groups, each
   member outside the largest meets the others, in units of two bounded blocks.
4. A candidate group's pairs are recomputed exactly, in double precision, block by block: a group of any size is cut into
   blocks of bounded size and every pair of blocks is a unit of work of its own. Units return each vector's number of
   links and its smallest relative, never the pairs. Every pair of a group is needed here, since links are counted.

Defined results: unusable vectors (null, empty, zero, a null or non-finite component, another length than the
commonest) link with nothing and stand alone, as does a row with a null id; repeated ids with different vectors are
merged by their shared id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rabitq
from .shared import Cuts, components

THRESHOLD = 0.95
#: Chance of missing a pair right at the threshold, width of the bounds, members of a block where pairs are estimated and
#: where they are recomputed, rows of a unit's matrix that are worked on together.
MISS, DEVIATIONS, BLOCK, EXACT_BLOCK, TILE = 4e-5, 4.0, 1024, 2048, 256


def bands(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band (so that chance meetings stay about one for each class) and number of bands."""
    bits = min(28, max(10, math.ceil(math.log2(max(n, 2))) + 2))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def _entries(dim: int, bits: int, count: int):
    """(band key, id) of each class, and its code, factor and rounded rotated vector."""

    def run(batches):
        turns = [rabitq.rotation(dim, 1000 + k) for k in range(-(-bits * count // (-(-dim // 64) * 64)))]
        weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = rabitq.matrix(part.column(1), dim)
                unit = x / np.sqrt((x**2).sum(1))[:, None]
                sign = np.concatenate([unit @ t > 0 for t in turns], 1)[:, : bits * count].reshape(len(x), count, bits)
                keys = (sign * weight).sum(2).astype(np.int64) | (np.arange(count, dtype=np.int64) << 32)[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), count))], names=["key", "id"])

    return run


def _codes(dim: int):
    def run(batches):
        turn = rabitq.rotation(dim, 7)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = rabitq.matrix(part.column(1), dim)
                y = x / np.sqrt((x**2).sum(1))[:, None]
                code, factor = rabitq.encode(y, turn)
                y = y @ turn
                step = np.abs(y).max(1) / 127
                ids = part.column(0).to_numpy()
                # rounding up or down at random keeps the estimate unbiased; seeded by the row, so a re-run agrees
                noise = np.random.default_rng(np.abs(ids[:1])).random(y.shape)
                rounded = np.clip(np.floor(y / step[:, None] + noise), -128, 127).astype(np.int8)
                blobs = [c.tobytes() + f.tobytes() + s.tobytes() + r.tobytes() for c, f, s, r in zip(code, factor, step.astype(np.float32), rounded, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["id", "code"])

    return run


class _Side:
    """Codes, factors and rotated vectors of a set of members."""

    def __init__(self, blobs: list[bytes], size: int):
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        n = size // 8
        self.sign = rabitq.signs(raw[:, :n])
        self.factor = np.ascontiguousarray(raw[:, n : n + 4]).view(np.float32)[:, 0]
        step = np.ascontiguousarray(raw[:, n + 4 : n + 8]).view(np.float32)
        self.vector = np.ascontiguousarray(raw[:, n + 8 :]).view(np.int8).astype(np.float32) * step
        self.off = rabitq.error(self.factor, size, DEVIATIONS)
        self.scaled = self.sign / np.maximum(self.factor, 1e-6)[:, None]

    def upper(self, a, b):
        """Upper bound of the cosine of the pairs (a[i], b[i]): the mean of both estimates and the mean error."""
        est = ((self.vector[a] * self.scaled[b]).sum(1) + (self.vector[b] * self.scaled[a]).sum(1)) / 2
        return est + (self.off[a] + self.off[b]) / 2

    def likely(self, at, threshold: float) -> np.ndarray:
        """Which pairs of ``at`` have an upper bound of at least the threshold, as a matrix."""
        out = np.empty((len(at), len(at)), bool)
        for i in range(0, len(at), TILE):
            a = at[i : i + TILE]
            est = (self.vector[a] @ self.scaled[at].T + self.scaled[a] @ self.vector[at].T) / 2
            out[i : i + TILE] = est + (self.off[a][:, None] + self.off[at][None, :]) / 2 >= threshold
        return out | out.T


def _smallest(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over a symmetric adjacency matrix."""
    label = ids.copy()
    while True:
        near = np.empty_like(label)
        for i in range(0, len(ids), TILE):
            near[i : i + TILE] = np.where(adjacent[i : i + TILE], label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[np.searchsorted(ids, new)])
        if (new == label).all():
            return label
        label = new


def groups_of(batches, names, rows: int = 20_000):
    """Whole groups of consecutive equal keys, several at once (about ``rows``): (columns, starts)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < rows:
            continue
        keys = np.stack([held.column(n).to_numpy() for n in names])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if not len(change):
            continue
        yield held.slice(0, int(change[-1])), np.concatenate([[0], change[:-1]])
        held = held.slice(int(change[-1]))
    if held is not None and held.num_rows:
        keys = np.stack([held.column(n).to_numpy() for n in names])
        yield held, np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])


def _meet(size: int, threshold: float):
    """Spanning edges of each band's surviving pairs."""

    def run(batches):
        for table, starts in groups_of(batches, ["key", "unit"]):
            ids = table.column("id").to_numpy()
            side = _Side(table.column("code").to_pylist(), size)
            count = np.diff(np.append(starts, len(ids)))
            out_a, out_b = [], []
            for n in np.unique(count[(count > 1) & (count <= 24)]):
                first = starts[count == n]
                i, j = np.triu_indices(int(n), 1)
                for k in range(0, len(first), max(1, 200_000 // len(i))):
                    f = first[k : k + max(1, 200_000 // len(i))]
                    a, b = (f[:, None] + i).ravel(), (f[:, None] + j).ravel()
                    ok = side.upper(a, b) >= threshold
                    out_a.append(ids[a[ok]])
                    out_b.append(ids[b[ok]])
            for s, n in zip(starts[count > 24].tolist(), count[count > 24].tolist(), strict=True):
                at = np.arange(s, s + n)
                at = at[np.argsort(ids[at], kind="stable")]
                root = _smallest(side.likely(at, threshold), ids[at])
                out_a.append(ids[at][root != ids[at]])
                out_b.append(root[root != ids[at]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


def _estimate(size: int, threshold: float):
    """The pairs (a, b) whose upper bound reaches the threshold; rows hold both sides' codes."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            side = _Side(batch.column("x").to_pylist() + batch.column("y").to_pylist(), size)
            kept = pa.array(np.flatnonzero(side.upper(np.arange(n), np.arange(n, 2 * n)) >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return run


def _recompute(dim: int, threshold: float):
    """Exact links of each unit: (id, links counted with copies, smallest id reached inside the unit)."""

    def run(batches):
        for table, starts in groups_of(batches, ["group", "unit"]):
            ends = np.append(starts[1:], table.num_rows)
            ids_all, mult_all = table.column("id").to_numpy(), table.column("copies").to_numpy()
            chunk_all = table.column("chunk").to_numpy()
            x_all = rabitq.matrix(table.column("embedding").combine_chunks(), dim)
            norm = np.sqrt((x_all**2).sum(1))
            out = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                at = s + np.argsort(ids_all[s:e], kind="stable")
                ids, x = ids_all[at], x_all[at]
                linked = np.empty((len(at), len(at)), bool)
                for i in range(0, len(at), TILE):
                    linked[i : i + TILE] = (x[i : i + TILE] @ x.T) / np.outer(norm[at[i : i + TILE]], norm[at]) >= threshold
                linked |= linked.T  # a product rounds alike both ways but for its place in a tile
                np.fill_diagonal(linked, False)
                root = _smallest(linked, ids)
                chunk = chunk_all[at]
                if chunk.min() != chunk.max():  # pairs inside a block belong to that block's own unit
                    linked &= chunk[:, None] != chunk[None, :]
                mult = mult_all[at].astype(np.float64)
                out.append((ids, np.concatenate([linked[i : i + TILE] @ mult for i in range(0, len(at), TILE)]), root))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (
                [o[0] for o in out], [o[1].astype(np.int64) for o in out], [o[2] for o in out])], names=["id", "links", "root"])

    return run


def _units(df: DataFrame, count: str, hashed, block: int) -> DataFrame:
    """Deals each group's members into blocks of about ``block`` and each member to the pairs of its block with others."""
    k = F.ceil(F.col(count) / block).cast("long")
    chunk = F.pmod(hashed, k)
    pairs = F.when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda x: F.least(x, F.col("chunk")) * k + F.greatest(x, F.col("chunk")))
    )
    return df.withColumn("chunk", chunk).withColumn("unit", F.explode(pairs))


def represented(entries: DataFrame, block: int) -> DataFrame:
    """(key, id) rows of buckets with more than one member; ``rep``: a representative, picked by a hash, of buckets with more
    than ``block`` members, null for the others."""
    own = entries.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "key")).alias("rep")).where("n > 1")
    return entries.join(own.select("key", F.when(F.col("n") > block, F.col("rep")).alias("rep")), "key")


def apart(members: DataFrame, group: str, block: int) -> DataFrame:
    """Units in which all members of a group with different labels meet: (group, unit, id, label), groups of one label left out.

    Members outside the group's largest label are dealt into blocks that meet one another and all blocks of the largest
    label, whose own members needn't meet. A unit has two blocks at most.
    """
    counts = members.groupBy(group, "label").agg(F.count("*").alias("c"))
    per = counts.groupBy(group).agg(F.max_by("label", "c").alias("major"), F.max("c").alias("most"), F.sum("c").alias("n")).where("most < n")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("long")
    df = members.join(per, group).withColumn("km", blocks(F.col("n") - F.col("most"))).withColumn("kb", blocks(F.col("most"))).withColumn("minor", F.col("label") != F.col("major"))
    df = df.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("km")).otherwise(F.col("kb"))))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    among = F.transform(upto("km"), lambda x: F.least(x, F.col("chunk")) * F.col("km") + F.greatest(x, F.col("chunk")))
    against = F.transform(upto("kb"), lambda y: F.col("km") * F.col("km") + F.col("chunk") * F.col("kb") + y)
    large = F.transform(upto("km"), lambda x: F.col("km") * F.col("km") + x * F.col("kb") + F.col("chunk"))
    units = F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).when(F.col("minor"), F.concat(among, against)).otherwise(large)
    return df.withColumn("unit", F.explode(units)).select(group, "unit", "id", "label")


def find(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    cuts = Cuts(spark)
    rows = vectors.select("vec_id", "embedding")
    dim = rabitq.dimension(rows)
    usable = F.col("vec_id").isNotNull() & rabitq.usable() & (F.size("embedding") == dim)
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    member = cuts.keep(rows.where(usable).select("vec_id", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")))
    same = rows.where(usable).groupBy(F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    classes = cuts.keep(same.agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")))
    n = classes.count()
    if n:
        bits, count = bands(n, threshold, miss)
        size = -(-dim // 64) * 64
        entries = cuts.keep(classes.select("id", "embedding").mapInArrow(_entries(dim, bits, count), "key long, id long").distinct())
        met = cuts.keep(represented(entries, BLOCK))
        codes = classes.select("id", "embedding").mapInArrow(_codes(dim), "id long, code binary")

        def meet(dealt):
            dealt = dealt.join(codes, "id").select("key", "unit", "id", "code").repartition("key", "unit").sortWithinPartitions("key", "unit", "id")
            return cuts.keep(dealt.mapInArrow(_meet(size, threshold), "a long, b long").distinct())

        edges = meet(met.where("rep IS NULL").select("key", F.lit(0).cast("long").alias("unit"), "id"))
        large = met.where("rep IS NOT NULL")
        if large.limit(1).count():
            stars = large.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
            stars = stars.join(codes.toDF("a", "x"), "a").join(codes.toDF("b", "y"), "b").select("a", "b", "x", "y")
            edges = cuts.keep(edges.union(stars.mapInArrow(_estimate(size, threshold), "a long, b long")))
            near = components(cuts, edges)
            named = cuts.keep(large.join(near, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("label")))
            edges = edges.union(meet(apart(named, "key", BLOCK).select("key", "unit", "id")))
        near = components(cuts, edges)
        cuts.drop(entries, met)
        sizes = near.groupBy("component_id").agg(F.count("*").alias("n"))
        work = near.join(sizes, "component_id").join(classes, "id").withColumnRenamed("component_id", "group")
        work = _units(work, "n", F.xxhash64("id"), EXACT_BLOCK).select("group", "unit", "chunk", "id", "copies", "embedding")
        work = work.repartition("group", "unit").sortWithinPartitions("group", "unit")
        exact = cuts.keep(work.mapInArrow(_recompute(dim, threshold), "id long, links long, root long"))
        joined = components(cuts, exact.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
        links = exact.groupBy("id").agg(F.sum("links").alias("links"))
        table = classes.select("id", "copies", "h1", "h2").join(links, "id", "left").join(joined, "id", "left")
        table = table.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        alone = member.join(table, ["h1", "h2"]).select("vec_id", "n_links", "component_id").union(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
