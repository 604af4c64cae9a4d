"""Sharding: k-d tree partitioning with built-in functions only.

Rows are points whose coordinates are metadata that equal texts share: bytes and bytes per character on logarithmic
scales, and the language at a hashed place. A node is split along the dimension in which its points spread widest, at
the weighted median: the place where the cumulated bytes reach the share of the leaves on its left. Leaves have reached
the target, the total bytes over the number of shards. Ties along a dimension are ordered by a hash of the text and then
by a hash of the id. Equal texts stay together: a median falls beside their group, on the nearer side, unless the group
weighs more than ``GROUP`` of a shard; then the group is split, so one of any size doesn't burden a single shard.

A level of the tree takes one pass for a histogram of all its nodes in all dimensions, which gives spans and the bins in
which the medians fall, and as a rule one more that orders a bin's rows by 12 bits of the text's hash; only a bin that
still weighs too much is refined further. The driver holds bins, at most 4096 for each node and dimension, never rows.
The tree is one column expression over the points, which are written once.

Defined results: a null text has size 16 and a null checksum, a null language or count of characters has a place of its own;
repeated rows each get a slot; an empty table gives an empty result; very long texts weigh what they weigh (a shard
can't be smaller than its largest row); other columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts

SHARDS = 40
ROW_BYTES = 16
#: A median is good enough when the bin it falls into holds at most this part of a shard; a group of equal texts that
#: weighs no more than that part of a shard is never split.
TOLERANCE, GROUP = 0.002, 0.5
#: Rows that one slot-numbering task is to have, about.
SLOT_ROWS = 50_000
DIGIT, VALUE_BITS, TEXT_BITS, ID_BITS = 12, 12, 48, 60
DIMENSIONS = ("kd_size", "kd_lang", "kd_width")


@dataclass
class Node:
    """A leaf's shards are [first, first + count); a split node has a dimension, a bound (value, text hash, id hash) and
    two children."""

    first: int
    count: int
    name: int
    dimension: str | None = None
    bound: tuple[int, int, int] = (0, 0, 0)
    left: Node | None = None
    right: Node | None = None


def coordinates() -> list[Column]:
    """What the tree needs of a row, as columns named kd_*: coordinates and the hashes that break ties."""
    top = (1 << VALUE_BITS) - 1
    scaled = lambda c, per_doubling: F.least(F.lit(top), F.greatest(F.lit(0), F.floor(F.log2(c) * per_doubling))).cast("long")
    size, chars = size_of().cast("double"), F.col("n_chars").cast("double")
    return [
        scaled(size, 1 << (VALUE_BITS - 5)).alias("kd_size"),
        F.when(F.col("lang").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("lang"), F.lit(top)) + 1).cast("long").alias("kd_lang"),
        F.when(chars > 0, scaled(1 + size / chars, 1 << (VALUE_BITS - 2))).otherwise(F.lit(0)).cast("long").alias("kd_width"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT_BITS).alias("kd_text"),
        F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col("doc_id")), 64 - ID_BITS).alias("kd_id"),
    ]


def size_of() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def points(docs: DataFrame) -> DataFrame:
    """Every row without its text: id, size, checksum and coordinates."""
    return docs.select("doc_id", size_of().alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), *coordinates())


def _cases(node: Node, leaf) -> str:
    if node.left is None:
        return f"int({leaf(node)})"
    v, t, i = node.bound
    d = node.dimension
    below = f"{d} < {v} OR ({d} = {v} AND (kd_text < {t}L OR (kd_text = {t}L AND kd_id < {i}L)))"
    return f"CASE WHEN {below} THEN {_cases(node.left, leaf)} ELSE {_cases(node.right, leaf)} END"


def place(node: Node, leaf=lambda n: n.first) -> Column:
    """The tree as one expression over the columns of ``points``."""
    return F.expr(_cases(node, leaf))


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of at most one row per node, so of fixed size, to broadcast: an inline table, for which no task runs."""
    fields = [f.split() for f in schema.split(", ")]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    values = ", ".join(f"({', '.join(map(str, row))})" for row in rows)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})"))


def _weight() -> list[Column]:
    return [F.sum("size").alias("bytes"), (F.min("kd_text") == F.max("kd_text")).alias("one")]


def _reached(bins: list[tuple], goal: float):
    """Of (bin, bytes, whether it holds equal texts only), in any order: the bin in which the cumulated bytes reach
    ``goal``, the bytes below it, its bytes and whether it is one group."""
    below = 0
    for b, weight, one in sorted(bins):
        if below + weight >= goal:
            break
        below += weight
    else:  # a goal beyond the last bin by a rounding error
        below -= weight
    return b, below, weight, one


@dataclass
class _Search:
    """A node's median on its way: what is known of its place and the bytes still to find there."""

    node: Node
    value: int
    goal: float
    text: int = 0
    id: int = 0

    def settle(self, digits: int, bin_: int, below: int, weight: int, one: bool, target: float) -> bool:
        """Takes the ``digits``-th bin in; true where the median lies on one of the bin's sides."""
        text = TEXT_BITS // DIGIT
        whole = digits <= text and one or digits == text
        last = digits == (TEXT_BITS + ID_BITS) // DIGIT
        if digits == 0:
            self.value = bin_
        elif digits <= text:
            self.text |= bin_ << (TEXT_BITS - DIGIT * digits)
        else:
            self.id |= bin_ << (ID_BITS - DIGIT * (digits - text))
        self.goal -= below
        if weight > TOLERANCE * target and not last and not (whole and weight <= GROUP * target):
            return False
        after = int(weight - self.goal < self.goal)
        if digits == 0:
            self.node.bound = (self.value + after, 0, 0)
        elif digits <= text:
            self.node.bound = (self.value, self.text + (after << (TEXT_BITS - DIGIT * digits)), 0)
        else:
            self.node.bound = (self.value, self.text, self.id + (after << (ID_BITS - DIGIT * (digits - text))))
        return True


def _refine(at: DataFrame, seeking: list[_Search], digits: int) -> dict[int, list]:
    """The bins of the next digit of each search: at most 4096 for a node."""
    text = TEXT_BITS // DIGIT
    state = [(s.node.name, DIMENSIONS.index(s.node.dimension) + 1, s.value, s.text, s.id) for s in seeking]
    to = _small(at.sparkSession, state, "node int, dim int, q1 long, q2 long, q3 long")
    t, i = min(digits - 1, text) * DIGIT, max(digits - 1 - text, 0) * DIGIT
    same = F.element_at(F.array(*DIMENSIONS), F.col("dim")) == F.col("q1")
    same &= F.shiftright("kd_text", TEXT_BITS - t) == F.shiftright("q2", TEXT_BITS - t)
    same &= F.shiftright("kd_id", ID_BITS - i) == F.shiftright("q3", ID_BITS - i)
    column, left = (F.col("kd_text"), TEXT_BITS - t - DIGIT) if digits <= text else (F.col("kd_id"), ID_BITS - i - DIGIT)
    digit = F.shiftright(column, left).bitwiseAND((1 << DIGIT) - 1).alias("bin")
    out: dict[int, list] = {}
    for r in at.join(to, "node").where(same).groupBy("node", digit).agg(*_weight()).collect():
        out.setdefault(r["node"], []).append((r["bin"], r["bytes"], r["one"]))
    return out


def grow(table: DataFrame, shards: int = SHARDS) -> Node:
    """The tree of ``table`` (columns of ``points``)."""
    total = table.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    root, name = Node(0, shards, 0), 0
    open_ = [root] if shards > 1 and total else []
    while open_:
        at = table.withColumn("node", place(root, lambda n: n.name)).where(F.col("node").isin([n.name for n in open_]))
        value = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(d).alias("bin")) for k, d in enumerate(DIMENSIONS)]))
        bins = at.select("node", "size", "kd_text", value.alias("v")).groupBy("node", "v.dim", "v.bin").agg(*_weight())
        found: dict[int, dict[int, list]] = {}
        for r in bins.collect():
            found.setdefault(r["node"], {}).setdefault(r["dim"], []).append((r["bin"], r["bytes"], r["one"]))
        seeking = []
        for n in open_:
            if n.name in found:
                own = found[n.name]
                widest = max(own, key=lambda d: (max(own[d])[0] - min(own[d])[0], -d))
                n.dimension = DIMENSIONS[widest]
                # a share of what is really here, so that errors above don't pile up in the last leaf
                s = _Search(n, 0, sum(b[1] for b in own[widest]) * (n.count // 2) / n.count)
                if not s.settle(0, *_reached(own[widest], s.goal), target):
                    seeking.append(s)
        split, digits = [n for n in open_ if n.dimension], 0
        while seeking:
            digits += 1
            hits = _refine(at, seeking, digits)
            seeking = [s for s in seeking if not s.settle(digits, *_reached(hits[s.node.name], s.goal), target)]
        open_ = []
        for n in split:
            half = n.count // 2
            n.left, n.right = Node(n.first, half, name + 1), Node(n.first + half, n.count - half, name + 2)
            name += 2
            open_ += [c for c in (n.left, n.right) if c.count > 1]
    return root


def assign(table: DataFrame, root: Node, rows: int, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to the rows of ``points``.

    A shard is numbered in blocks of bounded size; a block begins where the blocks before it end.
    """
    blocks = 8 * max(1, -(-rows // (shards * SLOT_ROWS)))
    placed = table.withColumn("shard", place(root)).withColumn("kd_block", F.pmod(F.col("kd_id"), F.lit(blocks)))
    begin = Window.partitionBy("shard").orderBy("kd_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "kd_block").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "kd_block", F.coalesce(F.sum("n").over(begin), F.lit(0)).alias("kd_start"))
    own = Window.partitionBy("shard", "kd_block").orderBy("doc_id", "text_crc32", "kd_text")
    numbered = placed.withColumn("kd_row", F.row_number().over(own))
    return numbered.join(starts, ["shard", "kd_block"]).withColumn("slot", F.col("kd_start") + F.col("kd_row") - 1)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row's doc_id, size, checksum, shard and slot."""
    cuts = Cuts(docs.sparkSession)
    table = cuts.keep(points(docs))
    return assign(table, grow(table, shards), table.count(), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> Node:
    """Writes the whole rows, texts included, into one folder per shard; the placing itself needs no lookup."""
    cuts = Cuts(docs.sparkSession)
    table = cuts.keep(points(docs))
    own = [c for c in table.columns if c.startswith("kd_")]
    if clash := {*own, "shard"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash with the operator's own")
    root = grow(table, shards)
    docs.select("*", *coordinates()).withColumn("shard", place(root)).drop(*own).write.partitionBy("shard").parquet(path)
    cuts.drop(table)
    return root


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
