"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and their character grams (4 to 6, with word edges), each kind hashed to
2**18 numbers of its own. Additive weights see each term for itself; the factors add a learned strength for every pair of terms
that meet in a text, such as an insult with the mention of a group, at a cost linear in the terms.

Fitting uses a bounded, class-balanced sample of at most `train_rows` labelled rows (chosen by a hash, weighted back to
the true class shares). Term counts of the sample are a Spark aggregation. Weights and factors go to the at most
`max_terms` terms with the strongest chi-square and, whatever their labels, to the at most `max_words` most frequent words,
so that a pair is learned whose words say nothing alone. The model has a fixed largest size and is sent to the tasks as it
is. Scoring reads every whole text and shuffles nothing.

Defined results: null and empty texts get the score of a text without terms; a document with several labels counts as
toxic if one says so; a null toxic label is no label; a null doc_id counts as held out; if the sample lacks a class,
the score is that of the labels' share (0 without labels); repeated rows are scored each.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import chunks

TERM_BITS, TRAIN_ROWS, MAX_TERMS, LEAST_CHI2, FACTORS, EPOCHS = 18, 8000, 4096, 25.0, 8, 12
MAX_WORDS, LEAST_ROWS = 1024, 20
WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 150_000


def terms_of(word: str) -> set[int]:
    mask = (1 << TERM_BITS) - 1
    edged = f"<{word}>"
    grams = {edged[i:i + n] for n in (4, 5, 6) for i in range(len(edged) - n + 1)}
    number = zlib.crc32(word.encode("utf-8", "replace")) & mask
    return {zlib.crc32(g.encode("utf-8", "replace")) & mask for g in grams} | {number | (1 << TERM_BITS)}


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of factors)."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, active: np.ndarray) -> float:
        v = self.factors[active]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[active].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, text: str | None, known: dict[str, tuple[int, ...]]) -> float:
        active: set[int] = set()
        for w in words_in(text):
            hit = known.get(w)
            if hit is None:
                known[w] = hit = tuple(i for t in terms_of(w) if (i := self.index.get(t)) is not None)
            if hit:
                active.update(hit)
        if len(known) > KEPT_WORDS:
            known.clear()
        z = self.raw(np.fromiter(sorted(active), np.int64, len(active)))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 3) -> Machine:
    """Adam on the weighted logistic loss with L2, over rows of term positions."""
    rng = np.random.default_rng(seed)
    d = len(terms)
    share = float(np.clip((labels * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    theta = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.02, (d, factors))], axis=1)
    bias = float(np.log(share / (1 - share)))
    m, s, mb, sb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at:at + 128]
            cols = np.concatenate([rows[i] for i in pick])
            own = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            v = theta[cols, 1:]
            total = np.zeros((len(pick), factors))
            np.add.at(total, own, v)
            square = np.bincount(own, (v * v).sum(axis=1), len(pick))
            z = bias + np.bincount(own, theta[cols, 0], len(pick)) + 0.5 * ((total * total).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) * weight[pick] / weight[pick].sum()
            grad = np.zeros_like(theta)
            np.add.at(grad, (cols, 0), g[own])
            np.add.at(grad[:, 1:], cols, g[own, None] * (total[own] - v))
            grad += np.concatenate([np.full(1, 1e-5), np.full(factors, 1e-4)]) * theta
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
            a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
            theta -= 0.02 * (m / a) / (np.sqrt(s / b) + 1e-8)
            bias -= 0.02 * (mb / a) / (np.sqrt(sb / b) + 1e-8)
    return Machine(terms, float(bias), theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32))


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS, max_words: int = MAX_WORDS) -> Machine:
    """Fit on labelled rows outside the held-out fold. labels: doc_id, toxic. Words in fewer than LEAST_ROWS rows of the sample
    are not frequent."""
    own = (labels.filter("doc_id is not null and toxic is not null").filter(fold(5) != 0)
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y")))
    own = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    empty = Machine(np.zeros(0, np.int64), 0.0, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    if len(counts) < 2:
        empty.bias = 40.0 if 1 in counts else -40.0
        return empty
    keep = {y: min(1.0, train_rows / 2 / n) for y, n in counts.items()}
    part = F.when(F.col("y") == 1, F.lit(keep[1])).otherwise(F.lit(keep[0]))
    chosen = own.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))).select(F.col("doc_id").alias("_id"), "y")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            terms = [sorted(set().union(*map(terms_of, words_in(t)))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    sample = common.stored(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
                           .mapInArrow(rows, "doc_id long, y int, terms array<int>"), "toxicity-sample")
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(size) < 2:
        return empty
    n1, n0 = size[1], size[0]
    a, b = F.col("a"), F.col("b")
    chi2 = (n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n1 + n0 - a - b) * float(n1) * float(n0))
    counted = common.stored(sample.select("y", F.explode("terms").alias("term")).groupBy("term")
                            .agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
                            .filter(a + b < n1 + n0).select("term", (a + b).alias("rows"), chi2.alias("chi2")), "toxicity-terms")
    strong = counted.filter(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(max_terms)
    frequent = counted.filter((F.col("term") >= 1 << TERM_BITS) & (F.col("rows") >= LEAST_ROWS)).orderBy(F.desc("rows"), "term").limit(max_words)
    terms = np.array(sorted({r["term"] for r in strong.select("term").unionByName(frequent.select("term")).collect()}), np.int64)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            active = []
            for t in b.column(2).to_pylist():
                at = np.searchsorted(terms, t)
                ok = at < len(terms)
                active.append(at[ok][terms[at[ok]] == np.array(t, np.int64)[ok]].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(active, pa.list_(pa.int32()))], ["doc_id", "y", "active"])

    fitted = sorted(sample.mapInArrow(positions, "doc_id long, y int, active array<int>").collect())
    y = np.array([r["y"] for r in fitted], float)
    w = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    return fit_machine([np.array(r["active"], np.int64) for r in fitted], y, w, terms)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in chunks(batches, "text"):
            s = np.array([machine.score(t, known) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in chunks(batches, "text"):
            s = [machine.score(t, known) < 0.5 for t in b.column(names.index("text")).to_pylist()]
            yield b.filter(pa.array(s, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return score(docs, train(docs, common.table(spark, folder, "labels")))
