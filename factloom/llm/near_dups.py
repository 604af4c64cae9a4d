"""MinHash near-dedup with sequential Bayesian verification.

1. A text's set is its distinct runs of ``words`` words (ASCII lower-cased). Texts with equal sets form one class, so
   exact copies are never paired, however many there are.
2. Classes get a MinHash signature; bands of it bring candidates together, their rows and number following from the
   threshold and the wanted miss probability.
3. Signatures are compared 16 positions at a time. After each step a pair goes if its posterior probability of being
   similar enough (uniform prior, so a binomial tail) is below ``miss``; pairs whose set sizes exclude the threshold go at
   once. Survivors are verified exactly on the full sets.
4. First the members of a band bucket of up to ``BLOCK`` meet; in a larger one every member is compared with one
   representative, which a hash picks for each bucket anew. Of a text's surviving pairs the best is verified: a group of
   near copies, which meets in many buckets, hangs together after work in proportion to its members. Then only what is
   still apart: in a bucket with several components each member outside the largest meets all the others, dealt into
   units of two bounded blocks. Survivors there put their texts into candidate groups (spanning edges only leave a task),
   which are dealt in the same way, and all of a unit's survivors are verified where they are. So no link that would
   change a component is left out. What is shuffled is a multiple of the texts for groups that hang together; for members
   that stay apart it is their number times the bucket's size over the block.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; fewer words than
``words`` give one run of all of them; repeated rows are copies; rows with a null id stand alone; an empty table gives
an empty result; very long texts are handled whole.
"""

from __future__ import annotations

from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ragged
from .embedding_dups import apart, groups_of, represented
from .shared import SPACE, Cuts, byte_table, components, lean, mix, shingles, steps, utf8, word_hashes, word_spans

HASHES, STEP = 128, 16
#: Probability of a wrongly dropped candidate that a comparison step may take, of a pair right at the threshold that
#: shares no band, and members of a block.
MISS, BAND_MISS, BLOCK = 1e-4, 5e-5, 1024
TABLE = byte_table(SPACE, lower=True)
_RNG = np.random.default_rng(2013)
_TURN = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def row_sets(data, offsets, words: int):
    """Distinct shingle hashes of the rows (sorted within each) and the rows' bounds."""
    starts, code, bounds = word_spans(data, offsets, TABLE)
    h, edge = shingles(word_hashes(starts, code), bounds, words)
    row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((h, row)) if len(edge) > 2**15 else np.argsort((h >> np.uint64(16)) | (row.astype(np.uint64) << np.uint64(48)))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(edge)))


def signatures(h: np.ndarray, bounds: np.ndarray):
    """[rows, HASHES] minima; rows without shingles get the largest value."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (mix(h) >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            y = (x ^ _TURN[k]) * _FACTOR[k]
            y ^= y >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(y * _FACTOR[-1 - k], bounds[full])
    return out


def banding(percent: int, miss: float) -> tuple[int, int]:
    """Bands and rows of a band: the most rows with which a pair at the threshold is missed with ``miss`` at most."""
    for rows in range(HASHES, 0, -1):
        together = min((percent / 100) ** rows, 1 - 1e-12)
        count = max(1, ceil(log(miss) / log1p(-together))) if together > 1e-12 else HASHES + 1
        if count * rows <= HASHES:
            return count, rows
    raise ValueError(f"{HASHES} positions can't serve a threshold of {percent} percent with a miss of {miss}")


def band_keys(sig: np.ndarray, count: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), count), np.uint64)
    for b in range(count):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        keys[:, b] = k
    return keys.view(np.int64)


def fewest_matches(threshold: float, miss: float) -> list[int]:
    """For each step, the fewest equal positions with P(similarity >= threshold | matches) >= miss."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:  # P(Bin(n + 1, t) <= m) is the posterior tail under a uniform prior
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sketch(words: int, count: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                h, bounds = row_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sig = signatures(h, bounds)
                keys, small = band_keys(sig, count, rows), (sig & np.uint32(0xFF)).astype(np.uint8)
                total = [np.concatenate([[0], np.cumsum(mix(h ^ np.uint64(s)))]).astype(np.uint64) for s in (0x1234567, 0x89ABCDEF01)]
                prints = [(t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total]
                n = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, count), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), *map(pa.array, prints), lists, pa.array([s.tobytes() for s in small], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                h, bounds = row_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                blobs = [h[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(blobs, pa.binary())], names=["id", "grams"])

    return run


def _survivors(sig: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int, least: list[int], pairs=None):
    """Pairs (i < j) that stay after every step, with their equal positions."""
    small, large = np.minimum, np.maximum
    if pairs is None:
        equal = np.zeros((len(n), len(n)), np.uint8)
        for k in range(STEP):
            equal += sig[:, k][:, None] == sig[:, k][None, :]
        open_ = (equal >= least[0]) & (100 * small(n[:, None], n[None, :]) >= percent * large(n[:, None], n[None, :]))
        open_ &= label[:, None] != label[None, :]
        i, j = np.nonzero(np.triu(open_, 1))
        m, first = equal[i, j].astype(np.int64), 1
    else:
        i, j = pairs
        ok = (100 * small(n[i], n[j]) >= percent * large(n[i], n[j])) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        m, first = np.zeros(len(i), np.int64), 0
    kept = []
    for at in range(0, len(i), 1 << 17):
        a, b, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)], m[at : at + (1 << 17)]
        for s in range(first, HASHES // STEP):
            part = slice(s * STEP, (s + 1) * STEP)
            q = q + (sig[a, part] == sig[b, part]).sum(1)
            ok = q >= least[s]
            a, b, q = a[ok], b[ok], q[ok]
        kept.append((a, b, q))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (i, j, m)


def _best(a, b, m, ids):
    """Of each member's pairs the one with most equal positions (ties: smaller partner)."""
    if not len(a):
        return a, b, m
    own, other, at = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((ids[other], -np.tile(m, 2), own))
    own, at = own[order], at[order]
    keep = np.unique(at[np.concatenate([[True], own[1:] != own[:-1]])])
    return a[keep], b[keep], m[keep]


def _screen(percent: int, miss: float):
    """The pairs (a, b) that pass the sequential test, with their equal positions; rows hold both sides' sizes and signatures."""
    least = fewest_matches(percent / 100, miss)

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("x").to_pylist() + batch.column("y").to_pylist()), np.uint8).reshape(-1, HASHES)
            n = np.concatenate([batch.column("nx").to_numpy(), batch.column("ny").to_numpy()])
            at, _, m = _survivors(sig, n, np.arange(2 * count), percent, least, (np.arange(count), np.arange(count, 2 * count)))
            kept = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept), pa.array(m.astype(np.int32))], names=["a", "b", "m"])

    return run


def _span(a, b, m, ids):
    """Spanning edges of the pairs' graph: each member with the smallest index that it reaches."""
    near = np.arange(len(ids))
    while len(a):
        low = near.copy()
        np.minimum.at(low, a, near[b])
        np.minimum.at(low, b, near[a])
        low = low[low]
        if (low == near).all():
            break
        near = low
    a = np.flatnonzero(near != np.arange(len(ids)))
    return near[a], a, np.zeros(len(a), np.int64)


def _meet(percent: int, miss: float, choose):
    """What ``choose`` takes of each unit's pairs that pass the sequential test and would join two components."""
    least = fewest_matches(percent / 100, miss)

    def run(batches):
        for table, starts in groups_of(batches, ["key", "unit"]):
            ids, n = table.column("id").to_numpy(), table.column("size").to_numpy()
            label = table.column("label").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            count = np.diff(np.append(starts, len(ids)))
            found = []
            for size in np.unique(count[(count > 1) & (count <= 24)]):
                first = starts[count == size]
                i, j = np.triu_indices(int(size), 1)
                for f in np.array_split(first, max(1, len(first) * len(i) // 100_000)):
                    pair = ((f[:, None] + i).ravel(), (f[:, None] + j).ravel())
                    found.append(choose(*_survivors(sig, n, label, percent, least, pair), ids))
            for s, size in zip(starts[count > 24].tolist(), count[count > 24].tolist(), strict=True):
                own = slice(s, s + size)
                a, b, m = _survivors(sig[own], n[own], label[own], percent, least)
                a, b, m = choose(a, b, m, ids[own])
                found.append((a + s, b + s, m))
            if found:
                a, b, m = (np.concatenate(x) for x in zip(*found, strict=True))
                x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(m.astype(np.int32))], names=["a", "b", "m"])

    return run


def _settle(percent: int, miss: float):
    """Spanning edges of each unit's components under exact links between their members."""
    least = fewest_matches(percent / 100, miss)

    def run(batches):
        for table, starts in groups_of(batches, ["group", "unit"], 2_000):
            ids, n, label = (table.column(c).to_numpy() for c in ("id", "size", "label"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            grams = table.column("grams")
            out = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                a, b, _ = _survivors(sig[s:e], n[s:e], label[s:e], percent, least)
                if not len(a):
                    continue
                sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in grams.slice(s, e - s)]
                bounds = np.concatenate([[0], np.cumsum([len(g) for g in sets])])
                names, flat = np.unique(np.concatenate(sets), return_inverse=True)
                mark, linked = np.zeros(len(names), np.int32), np.zeros(len(a), bool)
                cut = np.flatnonzero(np.diff(a)) + 1  # survivors come ordered by their first member
                for p, q in zip([0, *cut.tolist()], [*cut.tolist(), len(a)], strict=True):
                    i, js = a[p], b[p:q]
                    mark[flat[bounds[i] : bounds[i + 1]]] = 1
                    other, edge = ragged(flat, bounds, js)
                    common = np.add.reduceat(mark[other], edge[:-1])
                    mark[flat[bounds[i] : bounds[i + 1]]] = 0
                    size = np.diff(edge)
                    linked[p:q] = 100 * common >= percent * (bounds[i + 1] - bounds[i] + size - common)
                own, at = np.unique(label[s:e], return_inverse=True)
                x, y, _ = _span(at[a[linked]], at[b[linked]], None, own)
                out.append((own[x], own[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), ok], names=["a", "b", "linked"])

    return run


def _merged(cuts: Cuts, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only what they join of the components so far is a graph to work on."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(end), F.col("component_id").alias("c")), end, "left")
        links = links.withColumn(end, F.coalesce("c", end)).drop("c")
    joined = components(cuts, links.where("a <> b").distinct())
    old = labels.join(joined.select(F.col("component_id").alias("c"), F.col("id").alias("component_id")), "component_id", "left")
    old = old.select("id", F.coalesce("c", "component_id").alias("component_id"))
    return cuts.keep(old.union(joined.join(labels.select("id"), "id", "left_anti")))


def find(docs: DataFrame, words: int = 3, percent: int = 85, miss: float = MISS, band_miss: float = BAND_MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    cuts = Cuts(docs.sparkSession)
    text = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_shingles long, h1 long, h2 long, bands array<long>, sig binary").fields])
    sketched = cuts.keep(text.mapInArrow(lean(_sketch(words, *banding(percent, band_miss))), schema))
    rows = sketched.select("doc_id", "n_shingles", "h1", "h2")
    live = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumnRenamed("n_shingles", "size")
    classes = live.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    classes = cuts.keep(classes)
    marks = classes.select("id", "size", "sig")
    met = cuts.keep(represented(classes.select("id", F.explode("bands").alias("key")), BLOCK))
    ordered = lambda df: df.join(marks, "id").select("key", "unit", "id", "size", "sig", "label").repartition("key", "unit").sortWithinPartitions("key", "unit", "id")
    small = ordered(met.where("rep IS NULL").withColumn("unit", F.lit(0).cast("long")).withColumn("label", F.col("id"))).mapInArrow(lean(_meet(percent, miss, _best)), "a long, b long, m int")
    # every member of a large bucket with the bucket's representative
    side = lambda end, own, more: more.select(F.col("id").alias(end), *[F.col(c).alias(n) for c, n in own.items()])
    stars = met.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
    stars = stars.join(side("a", {"size": "nx", "sig": "x"}, marks), "a").join(side("b", {"size": "ny", "sig": "y"}, marks), "b").select("a", "b", "nx", "x", "ny", "y")
    pairs = small.union(stars.mapInArrow(lean(_screen(percent, miss)), "a long, b long, m int"))
    pairs = cuts.keep(pairs.groupBy("a", "b").agg(F.max("m").alias("m")))
    # of these, each text's best pair is verified
    ends = F.explode(F.array(*(F.struct(F.col(p).alias("own"), F.struct(F.col("m"), (-F.col(q)).alias("other")).alias("to")) for p, q in ("ab", "ba"))))
    best = pairs.select(ends.alias("e")).groupBy("e.own").agg(F.max("e.to").alias("to"))
    chosen = cuts.keep(best.select(F.least("own", -F.col("to.other")).alias("a"), F.greatest("own", -F.col("to.other")).alias("b")).distinct())
    needed = chosen.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cuts.keep(text.join(needed, "doc_id", "left_semi").mapInArrow(lean(_sets(words)), "id long, grams binary"))
    sided = chosen.join(side("a", {"grams": "x"}, sets), "a").join(side("b", {"grams": "y"}, sets), "b")
    checked = cuts.keep(sided.select("a", "b", "x", "y").mapInArrow(lean(_verify(percent)), "a long, b long, linked boolean"))
    labels = components(cuts, checked.where("linked").select("a", "b"))
    cuts.drop(pairs, chosen, checked)
    # only buckets in which components are still apart go on
    label = F.coalesce("component_id", "id").alias("label")
    named = cuts.keep(met.join(labels, "id", "left").select("key", "id", label))
    edges = ordered(apart(named, "key", BLOCK)).mapInArrow(lean(_meet(percent, miss, _span)), "a long, b long, m int")
    edges = cuts.keep(edges.select("a", "b").distinct())
    cuts.drop(met, named)
    if edges.limit(1).count():
        groups = components(cuts, edges).withColumnRenamed("component_id", "group")
        named = cuts.keep(groups.join(labels, "id", "left").select("group", "id", label))
        more = named.select("id").join(sets.select("id"), "id", "left_anti").withColumnRenamed("id", "doc_id")
        more = cuts.keep(text.join(more, "doc_id", "left_semi").mapInArrow(lean(_sets(words)), "id long, grams binary"))
        work = apart(named, "group", BLOCK // 2).join(marks, "id").join(sets.union(more), "id")
        work = work.select("group", "unit", "id", "size", "sig", "label", "grams").repartition("group", "unit").sortWithinPartitions("group", "unit", "id")
        labels = _merged(cuts, labels, cuts.keep(work.mapInArrow(lean(_settle(percent, miss)), "a long, b long")))
        cuts.drop(named, more)
    cuts.drop(edges, sets)
    ids = classes.select("id", "h1", "h2", "size").join(labels, "id", "left").select("h1", "h2", "size", F.coalesce("component_id", "id").alias("component_id"))
    inside = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumnRenamed("n_shingles", "size").join(ids, ["h1", "h2", "size"])
    outside = rows.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = inside.select("doc_id", F.col("size").alias("n_shingles"), "component_id").union(outside)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 85)


def oracle(words: int = 3, percent: int = 85, table: str = "documents") -> str:
    run = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table}
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - {words} + 2), lambda i: {run})) END AS s FROM tokens
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)
), edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.doc_id
), parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN parts USING (doc_id)
"""
