"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - z) with ordered thresholds theta and one latent score z shared by all grades. z is
the mean over a whole text's words of hashed weights: of the word as written, of its character-class shape, of the
shape pair with the word before, and of whether it repeats the word before. Any number of grades works (two in
``labels.quality``); the fitted thresholds give the expected grade and the tail probability P(grade >= k) that the
selection uses. Weights are rounded to a grid on which sums are exact, so a text's score doesn't depend on its batch.

Defined results: a null or empty text has no words and gets the fixed low latent score ``EMPTY_Z`` (never selected
where there is a choice); very long texts are scored whole; repeated rows are scored each on its own, so texts that are
equal tie; an empty table gives an empty result; with fewer than two grades everything is kept at that grade. Other
columns pass through untouched; those named like one of the outputs give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, byte_table, fold, give_back, labelled_sample, lean, mix, shape_table, steps, utf8, word_hashes, word_spans

#: Most labelled rows that a fit takes to the driver, and the tail probability that keeps a document.
SAMPLE_ROWS = 6000
KEEP_PROBABILITY = 0.5
WORDS, SHAPES = byte_table(SPACE), shape_table(SPACE)
EMPTY_Z = -12.0
#: Bits after the point of a weight: with 20, a sum over the words of any text that fits into memory is exact.
GRID = 20


def features(data, offsets, bits: int):
    """Four hashed slots for each word and the rows' word bounds."""
    starts, code, bounds = word_spans(data, offsets, WORDS)
    n = len(starts)
    if not n:
        return np.zeros((4, 0), np.int64), bounds
    words = word_hashes(starts, code)
    shapes = word_hashes(starts, np.where(code > 0, SHAPES[data], np.uint64(0)))
    before = np.ones(n, bool)
    before[bounds[:-1][bounds[:-1] < n]] = False
    last_word, last_shape = np.roll(words, 1), np.where(before, np.roll(shapes, 1), np.uint64(0))
    same = (before & (words == last_word)).astype(np.uint64)
    m = np.uint64((1 << bits) - 1)
    slots = [words, mix(shapes + np.uint64(1)), mix(shapes * np.uint64(31) + last_shape), mix(same + np.uint64(77))]
    return np.stack([(s >> np.uint64(17) & m).astype(np.int64) for s in slots]), bounds


@dataclass
class QualityModel:
    weights: np.ndarray
    theta: np.ndarray  # ordered, one fewer than the grades
    grades: list[int]

    def latent(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        z = np.full(len(offsets) - 1, EMPTY_Z)
        bits = int(np.log2(len(self.weights)))
        for i, j in steps(offsets):
            slots, bounds = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[slots].sum(0))])
            n = np.diff(bounds)
            z[i:j] = np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), EMPTY_Z)
        return z

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the lowest), one column for each."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.theta[None, :], -30, 30)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.asarray(self.grades, dtype=float))


def fit(texts, y, bits: int = 16, epochs: int = 30, batch: int = 256, rate: float = 0.1, l2: float = 2e-4, seed: int = 5) -> QualityModel:
    """Adam on the cumulative-link likelihood; the thresholds stay ordered as a first one plus positive gaps."""
    y = np.asarray(y, dtype=int)
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return QualityModel(np.zeros(2), np.zeros(0), grades or [0])
    k = np.searchsorted(grades, y)
    data, offsets = utf8(pa.array(list(texts), pa.large_string()))
    parts, bounds = [np.zeros((4, 0), np.int32)], [np.zeros(1, np.int64)]
    for i, j in steps(offsets, 1 << 19):  # a step at a time, to bound the memory
        own, b = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        parts.append(own.astype(np.int32))
        bounds.append(b[1:] + bounds[-1][-1])
    slots, bounds = np.concatenate(parts, 1), np.concatenate(bounds)
    n = np.maximum(np.diff(bounds), 1)
    share = np.cumsum(np.bincount(k, minlength=len(grades)))[:-1] / len(k)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = [np.zeros(1 << bits), np.concatenate([start[:1], gaps])]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rng, order = np.random.default_rng(seed), np.arange(len(k))
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), batch):
            rows = np.sort(order[a : a + batch])
            words = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            which = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            s, w = slots[:, words], params[0]
            z = np.bincount(which, weights=w[s].sum(0), minlength=len(rows)) / n[rows]
            theta = np.concatenate([[params[1][0]], params[1][0] + np.cumsum(np.exp(params[1][1:]))])
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            up, low = sig(edges[k[rows] + 1] - z), sig(edges[k[rows]] - z)
            up[k[rows] == len(grades) - 1], low[k[rows] == 0] = 1.0, 0.0
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            dz = (du - dl) / len(rows)  # of the negative log-likelihood
            g = np.bincount(s.ravel(), weights=np.tile((dz / n[rows])[which], 4), minlength=len(w)) + l2 * w
            dt = np.zeros(len(theta))
            np.add.at(dt, np.minimum(k[rows], len(theta) - 1), np.where(k[rows] < len(theta), -du, 0) / len(rows))
            np.add.at(dt, np.maximum(k[rows] - 1, 0), np.where(k[rows] > 0, dl, 0) / len(rows))
            after = np.cumsum(dt[::-1])[::-1]
            g_theta = np.concatenate([after[:1], after[1:] * np.exp(params[1][1:])])
            t += 1
            for i, gr in enumerate((g, g_theta)):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr**2
                params[i] -= rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    theta = np.concatenate([[params[1][0]], params[1][0] + np.cumsum(np.exp(params[1][1:]))])
    return QualityModel(np.round(params[0] * 2.0**GRID) / 2.0**GRID, theta, grades)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    got = labelled_sample(docs, labels, "quality", sample_rows)
    model = fit(got["text"].tolist(), got["y"].to_numpy())
    del got
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel, least_grade: int | None = None, probability: float = KEEP_PROBABILITY, carry: list[str] | None = None) -> DataFrame:
    """Adds latent, expected_grade, tail_probability (of ``least_grade``, the highest unless given) and selected."""
    new = ("latent", "expected_grade", "tail_probability", "selected")
    names = carry or [n for n in docs.columns if n not in new]
    read = names if "text" in names else [*names, "text"]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, T.DoubleType(), False) for n in new[:3]])
    bc = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the weight table
    least = model.grades[-1] if least_grade is None else least_grade

    def run(batches):
        for batch in batches:
            m = bc.value
            z = m.latent(batch.column(read.index("text")))
            tails = m.tails(z)
            at = [i for i, g in enumerate(m.grades[1:]) if g >= least]
            tail = tails[:, at[0]] if at else np.full(len(z), float(m.grades[-1] >= least))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, (z, m.expected(tails), tail))], names=[*names, *new[:3]])

    return docs.select(*read).mapInArrow(lean(run), schema).withColumn("selected", F.col("tail_probability") >= probability)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, carry=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "latent", "expected_grade", "tail_probability", "selected")
