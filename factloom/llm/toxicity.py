"""Toxicity: a convolutional text classifier trained in numpy.

Words are the runs of letters of a whole text (ASCII lower-cased). A word's vector is the sum of hashed embeddings of
the word and of its first 4 and 5 bytes, so inflected forms share what they have in common. Filters of several widths
run over the vectors, each filter's largest response over the text is kept (max pooling), and a logistic layer weighs
them. Every labelled row outside the held-out fold takes part: a small table is fitted at once; a larger one counts the
words by class over all rows, descends in units of rows side by side from the same start and takes the mean of what the
units learnt. Platt scaling on a calibration part (a quarter) sets the probability; a threshold for each language is calibrated on the
same part and stands beside the score (the language is no input of the score). Embeddings and weights are rounded to a
grid on which every sum is exact, so a text's score doesn't depend on the rows that it is scored with.

Defined results: a null or empty text gets the model's score for a text without words; very long texts are scored
whole; repeated rows are scored each on its own; an empty table gives an empty result; with no labels of both classes
every score is the smoothed base rate. Other columns of the input pass through ``score`` untouched; those named like
one of its outputs give way to it. Without a column ``lang``, or under a null or unknown language, the threshold is 0.5.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, STEP_BYTES, Cuts, byte_table, fold, give_back, labelled_rows, lean, steps, utf8, word_hashes, word_spans

#: Rows and bytes of text that are fitted at once, and bytes of text that a fit hashes at a time.
UNIT_ROWS, UNIT_BYTES, FIT_BYTES = 6000, 32 << 20, 1 << 19
#: Steps to one of weights, embeddings and responses where those of many rows are summed: whole numbers, so in any order.
WEIGHT_STEPS, EMBEDDING_STEPS, RESPONSE_STEPS = 1 << 30, 1 << 20, 1 << 8
TABLE = byte_table(SPACE, lower=True, letters_only=True)


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: list = field(default_factory=list)  # (width, weights [width * dim, filters], bias)
    weights: np.ndarray | None = None
    bias: float = 0.0
    scale: tuple = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    dead: float | None = None  # the constant score where nothing could be learnt

    def slots(self, starts, code):
        m = np.uint64(len(self.embedding) - 1)
        return [(word_hashes(starts, code, p) >> np.uint64(20) + np.uint64(p)) & m for p in (0, 4, 5)]

    def all_slots(self, data, offsets):
        """Slots and word bounds of many texts, worked out a step at a time to bound the memory."""
        parts, bounds = [np.zeros((3, 0), np.int32)], [np.zeros(1, np.int64)]
        for i, j in steps(offsets, FIT_BYTES):
            starts, code, b = word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TABLE)
            parts.append(np.stack([s.astype(np.int32) for s in self.slots(starts, code)]))
            bounds.append(b[1:] + bounds[-1][-1])
        return list(np.concatenate(parts, 1)), np.concatenate(bounds)

    def pooled(self, slots, bounds):
        """Largest response of each filter over each row's words, and where the pooled windows begin."""
        n = len(bounds) - 1
        x = sum(self.embedding[s] for s in slots)
        full = np.flatnonzero(np.diff(bounds))
        out, where = [], []
        for width, w, b in self.filters:
            dim = x.shape[1]
            r = x @ w[:dim]
            for k in range(1, min(width, len(x))):
                part = x[k:] @ w[k * dim : (k + 1) * dim]
                inner = np.ones(len(x) - k, bool)
                for j in range(1, k + 1):  # a window that leaves its row reads zeros there
                    leaves = bounds[1:-1] - j
                    inner[leaves[(leaves >= 0) & (leaves < len(inner))]] = False
                r[: len(part)] += part * inner[:, None]
            r += b
            top = np.zeros((n, r.shape[1]), np.float32)
            if len(full):
                top[full] = np.maximum.reduceat(r, bounds[full], axis=0)
            out.append(np.maximum(top, 0))
            where.append(r)
        return np.concatenate(out, 1), where, x

    def raw(self, data, offsets, limit: int = STEP_BYTES):
        z = np.empty(len(offsets) - 1)
        for i, j in steps(offsets, limit):
            starts, code, bounds = word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TABLE)
            z[i:j] = self.pooled(self.slots(starts, code), bounds)[0] @ self.weights + self.bias
        return z

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        if self.dead is not None:
            return np.full(len(offsets) - 1, self.dead)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(data, offsets) + b, -30, 30)))


def _on_grid(x: np.ndarray, bits: int) -> np.ndarray:
    return (np.round(x * 2.0**bits) / 2.0**bits).astype(x.dtype)


def settle(model: ToxicityModel) -> None:
    """Rounds the model to grids on which 24 bits hold any filter's response and 53 bits any weighted sum of them."""
    largest = 3 * float(np.abs(model.embedding).max()) + 1
    reach = max(largest * float(np.abs(w).sum(0).max()) + float(np.abs(b).max()) for _, w, b in model.filters) + 1
    bits = min(12, int((24 - np.ceil(np.log2(reach))) // 2))
    model.embedding = _on_grid(model.embedding, bits)
    model.filters = [(width, _on_grid(w, bits), _on_grid(b, 2 * bits)) for width, w, b in model.filters]
    fine = int(53 - 24 - np.ceil(np.log2(np.abs(model.weights).sum() + 1)) - 1)
    model.weights = _on_grid(model.weights, min(24, fine))


def _counts(slots, row, y, table):
    """For each kind of slot, the rows of class 1 and all rows that hold each bucket."""
    out = np.zeros((len(slots), 2, table))
    for k, s in enumerate(slots):
        seen = np.unique(s.astype(np.int64) * len(y) + row)
        bucket, who = seen // len(y), seen % len(y)
        out[k] = np.bincount(bucket, weights=y[who], minlength=table), np.bincount(bucket, minlength=table)
    return out


def _warm_start(counts, n1, n0, table, dim, rng):
    """Random embeddings whose first coordinate starts at the shrunk log-odds of the bucket among labelled rows."""
    e = rng.normal(0, 0.05, (table, dim)).astype(np.float32)
    for a, n in counts:
        b = n - a
        odds = np.log((a + 0.02 * n1 / (n1 + n0)) / n1) - np.log((b + 0.02 * n0 / (n1 + n0)) / n0)
        touched = (a + b) > 0
        e[touched, 0] = np.clip((odds * (a + b) / (a + b + 3))[touched] / 4, -0.5, 1.5)
    return e


def _begin(model, counts, n1, n0, table, dim, widths, filters, rng) -> None:
    """The model that a descent starts from."""
    model.embedding = _warm_start(counts, n1, n0, table, dim, rng)
    for width in widths:
        w = rng.normal(0, 0.3, (width * dim, filters)).astype(np.float32)
        w[0, : filters // 2] = 1.0  # half of the filters start on the informed coordinate
        model.filters.append((width, w, np.zeros(filters, np.float32)))
    model.weights, model.bias = np.full(len(widths) * filters, 0.3), -2.0


def fit(texts, y, langs, table_bits=16, dim=6, widths=(1, 2, 3), filters=6, epochs=8, batch=128, rate=0.02, seed=7) -> ToxicityModel:
    """All rows at once: a start from their counts, a descent, and a calibration on a quarter of them."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(np.zeros((2, 1), np.float32), dead=float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0)
    data, offsets = utf8(pa.array(list(texts), pa.large_string()))
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: len(y) // 4]] = True
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    table = 1 << table_bits
    model = ToxicityModel(np.zeros((table, dim), np.float32))
    slots, bounds = model.all_slots(data, offsets)
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    use = ~held[row]
    started = np.where(held, 0, y)
    counts = _counts([s[use] for s in slots], row[use], started, table)
    _begin(model, counts, started.sum() + 1.0, (1 - started).sum() + 1.0, table, dim, widths, filters, rng)
    _descend(model, slots, bounds, y, np.flatnonzero(~held), rng, epochs, batch, rate)
    settle(model)
    check = held if held.any() else np.ones(len(y), bool)
    picked = pa.array([x for x, h in zip(texts, check, strict=True) if h], pa.large_string())
    langs = np.asarray([str(v) for v in langs], dtype=object)[check]
    calibrate(model, model.raw(*utf8(picked), FIT_BYTES), y[check], langs, np.ones(check.sum()))
    return model


def _descend(model, slots, bounds, y, train, rng, epochs, batch, rate) -> None:
    """Adam on the logistic loss; gradients reach the embeddings through the pooled windows only."""
    table, dim = model.embedding.shape
    filters = len(model.filters[0][2])
    params = [w for _, w, _ in model.filters] + [b for _, _, b in model.filters] + [model.weights]
    m1, m2, t, bias_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, [0.0, 0.0]
    g2 = np.full(table, 1e-6)
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), batch):
            rows = np.sort(train[k : k + batch])
            words = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            b = np.concatenate([[0], np.cumsum(bounds[rows + 1] - bounds[rows])])
            if not len(words):
                continue
            own = [s[words] for s in slots]
            feats, responses, x = model.pooled(own, b)
            p = 1 / (1 + np.exp(-np.clip(feats @ model.weights + model.bias, -30, 30)))
            d = (p - y[rows]) / len(rows)
            grads_w, grads_b, gx = [], [], {}
            back = (d[:, None] * model.weights) * (feats > 0)
            for i, (width, w, _) in enumerate(model.filters):
                r, gw = responses[i], np.zeros_like(w)
                top = feats[:, i * filters : (i + 1) * filters]
                g = back[:, i * filters : (i + 1) * filters]
                for q in range(filters):
                    hit = np.flatnonzero(g[:, q])
                    if not len(hit):
                        continue
                    same = np.flatnonzero(np.maximum(r[:, q], 0) == np.repeat(top[:, q], np.diff(b)))
                    first = same[np.searchsorted(same, b[hit])]
                    for j in range(width):
                        ok = first + j < b[hit + 1]
                        at, gg = first[ok] + j, g[hit[ok], q]
                        gw[j * dim : (j + 1) * dim, q] += x[at].T @ gg
                        gx.setdefault("at", []).append(at)
                        gx.setdefault("g", []).append(gg[:, None] * w[j * dim : (j + 1) * dim, q])
                grads_w.append(gw)
                grads_b.append(g.sum(0).astype(np.float32))
            grads, t = [*grads_w, *grads_b, feats.T @ d + 1e-4 * model.weights], t + 1
            for i, (prm, gr) in enumerate(zip(params, grads, strict=True)):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr**2
                prm -= rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
            bias_m[0], bias_m[1] = 0.9 * bias_m[0] + 0.1 * d.sum(), 0.999 * bias_m[1] + 0.001 * d.sum() ** 2
            model.bias -= rate * (bias_m[0] / (1 - 0.9**t)) / (np.sqrt(bias_m[1] / (1 - 0.999**t)) + 1e-8)
            if gx:
                at, gv = np.concatenate(gx["at"]), np.concatenate(gx["g"]).astype(np.float32)
                for s in own:
                    ids, inv = np.unique(s[at], return_inverse=True)
                    total = np.zeros((len(ids), dim), np.float32)
                    np.add.at(total, inv, gv)
                    g2[ids] += (total**2).mean(1)
                    model.embedding[ids] -= (0.05 * total / np.sqrt(g2[ids])[:, None]).astype(np.float32)


def calibrate(model, z, y, langs, n) -> None:
    """Scale and thresholds from responses, classes and languages, each of which stands for ``n`` rows."""
    model.scale = _platt(z, y, n)
    a, b = model.scale
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    model.thresholds = {v: _threshold(p[langs == v], y[langs == v], n[langs == v]) for v in sorted(set(langs))}


def _platt(z, y, n):
    """Slope and offset of a logistic curve on smoothed targets (Platt 1999), by damped Newton steps."""
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (n * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (n * (p - target)) + 1e-4 * (c - [1.0, 0.0]))
        c = c - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(max(c[0], 1e-3)), float(c[1]))


def _threshold(p, y, n, least=10):
    """The threshold of best F1 that lies nearest to 0.5; 0.5 where a language has too few labels of either class."""
    if (n * y).sum() < least or (n * (1 - y)).sum() < least:
        return 0.5
    cuts = np.unique(np.concatenate([[0.5], np.linspace(0.05, 0.95, 91)]))
    f1 = np.array([2 * (n * y)[p >= c].sum() / max(1, n[p >= c].sum() + (n * y).sum()) for c in cuts])
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])


def score(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """Adds toxicity_score, threshold and flagged (score at least the language's threshold) to every row.

    ``carry``: the columns that stay beside them (all, unless given).
    """
    spark = docs.sparkSession
    bc = spark.sparkContext.broadcast(model)  # fixed size: the embedding table
    names = carry or [n for n in docs.columns if n not in ("toxicity_score", "threshold", "flagged")]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("toxicity_score", T.DoubleType(), False)])
    read = names if "text" in names else [*names, "text"]

    def run(batches):
        for batch in batches:
            s = bc.value.score(batch.column(read.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s)], names=[*names, "toxicity_score"])

    out = docs.select(*read).mapInArrow(lean(run), schema)
    limit = F.lit(0.5)
    for lang, t in sorted(model.thresholds.items()) if "lang" in names else ():
        if t != 0.5:
            limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return out.withColumn("threshold", limit).withColumn("flagged", F.col("toxicity_score") >= F.col("threshold"))


def train(docs: DataFrame, labels: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES, table_bits: int = 16) -> ToxicityModel:
    """Fits on all labelled rows outside the held-out fold, at once or in units of about so many rows and bytes."""
    cuts = Cuts(docs.sparkSession)
    rows = cuts.keep(labelled_rows(docs, labels, "toxic").withColumn("y", F.greatest(F.least("y", F.lit(1)), F.lit(0))))
    n, size, ones = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n <= unit_rows and size <= unit_bytes or ones in (0, n):
        got = rows.toPandas().sort_values("doc_id") if 0 < ones < n else rows.select(F.lit("").alias("text"), "y", F.lit("").alias("lang")).limit(0).toPandas()
        model = fit(got["text"].tolist(), got["y"].to_numpy(), got["lang"].tolist(), table_bits=table_bits)
        if 0 < n and ones in (0, n):
            model.dead = float((ones + 0.5) / (n + 1))
        del got
    else:
        model = _fit_units(rows, max(-(-n // unit_rows), -(-size // unit_bytes)), table_bits)
    cuts.drop(rows)
    give_back()
    return model


def _sum_rows(df: DataFrame) -> np.ndarray:
    """The sum of the int64 arrays in column ``v``, added up in ever fewer tasks; one array goes to the driver."""

    def run(batches):
        total = None
        for batch in batches:
            for v in batch.column(0):
                own = np.frombuffer(v.as_py(), np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = df.sparkSession.sparkContext.defaultParallelism
    df = df.mapInArrow(lean(run), "v binary")
    for left in (max(1, parts // 2), 1):
        df = df.repartition(left).mapInArrow(lean(run), "v binary")
    return np.frombuffer(df.first()["v"], np.int64)


def _fit_units(rows: DataFrame, units: int, table_bits: int, dim=6, widths=(1, 2, 3), filters=6, epochs=8, batch=128, rate=0.02, seed=7) -> ToxicityModel:
    """A fit of any number of rows: counts over all of them, descents of units from one start, calibration on a quarter."""
    spark, table = rows.sparkSession, 1 << table_bits
    sc = spark.sparkContext
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0)
    split = {(r.held, r.y): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    split_up = len(split) == 4  # both classes in both parts; else all rows serve for both
    learn, check = (rows.where("not held"), rows.where("held")) if split_up else (rows, rows)
    n1, n0 = (sum(c for (held, v), c in split.items() if v == y and not (held and split_up)) for y in (1, 0))
    blank = ToxicityModel(np.zeros((table, dim), np.float32))

    def count(batches):
        total = np.zeros((3, 2, table))
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            slots, bounds = blank.all_slots(*utf8(b.column(0)))
            total += _counts(slots, np.repeat(np.arange(len(y)), np.diff(bounds)), y, table) if len(y) else 0
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["v"])

    model = ToxicityModel(np.zeros((table, dim), np.float32))
    counts = _sum_rows(learn.select("text", "y").mapInArrow(lean(count), "v binary")).reshape(3, 2, table).astype(np.float64)
    _begin(model, counts, n1 + 1.0, n0 + 1.0, table, dim, widths, filters, np.random.default_rng(seed))
    start = sc.broadcast(model)  # fixed size: the embedding table

    def descend(group):
        group = group.combine_chunks().sort_by("doc_id")
        y, unit = group["y"].to_numpy().astype(np.float64), group["unit"][0].as_py()
        m = copy.deepcopy(start.value)
        slots, bounds = m.all_slots(*utf8(group["text"].combine_chunks()))
        _descend(m, slots, bounds, y, np.arange(len(y)), np.random.default_rng([seed, unit]), epochs, batch, rate)
        used = sum(np.bincount(s, minlength=table) for s in slots).astype(np.int64)
        moved = np.round((m.embedding - start.value.embedding) * np.float64(EMBEDDING_STEPS)).astype(np.int64) * used[:, None]
        flat = np.concatenate([*[w.ravel() for _, w, _ in m.filters], *[b for _, _, b in m.filters], m.weights, [m.bias]]).astype(np.float64)
        own = np.concatenate([[len(y)], np.round(flat * WEIGHT_STEPS).astype(np.int64) * len(y), used, moved.ravel()]).astype(np.int64)
        del m, slots, bounds, group
        give_back()
        return pa.table({"v": pa.array([own.tobytes()], pa.binary())})

    dealt = learn.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(units)).alias("unit"))
    total = _sum_rows(dealt.groupBy("unit").applyInArrow(descend, "v binary"))
    size = len(total) - table * (dim + 1)
    flat, at = total[1:size] / total[0] / WEIGHT_STEPS, 0
    used, moved = total[size : size + table], total[size + table :].reshape(table, dim)
    model.embedding = (model.embedding + moved / np.maximum(used, 1)[:, None] / EMBEDDING_STEPS).astype(np.float32)
    cut = lambda shape: flat[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32)
    ws, bs = [], []
    for _, w, _ in model.filters:
        ws.append(cut(w.shape))
        at += w.size
    for _, _, b in model.filters:
        bs.append(cut(b.shape))
        at += b.size
    model.filters = [(width, w, b) for (width, _, _), w, b in zip(model.filters, ws, bs, strict=True)]
    model.weights, model.bias = flat[at:-1].copy(), float(flat[-1])
    settle(model)
    final = sc.broadcast(model)

    def respond(batches):
        for b in batches:
            z = np.round(final.value.raw(*utf8(b.column(0)), FIT_BYTES) * RESPONSE_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(z)], names=["y", "lang", "z"])

    seen = check.select("text", "y", F.coalesce("lang", F.lit("None")).alias("lang")).mapInArrow(lean(respond), "y int, lang string, z long").groupBy("y", "lang", "z").count().toPandas().sort_values(["lang", "z", "y"])
    calibrate(model, seen["z"].to_numpy() / RESPONSE_STEPS, seen["y"].to_numpy().astype(np.float64), seen["lang"].to_numpy(dtype=object), seen["count"].to_numpy().astype(np.float64))
    start.unpersist()
    final.unpersist()
    return model


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, ["doc_id", "lang"])
    return out.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged",
    )
