"""Quality scores by attention over the passages of a document (multiple-instance learning with gated attention).

A document is a bag of passages of PASSAGE words; only the bag has a label. Each passage is described by hashed words,
pairs of neighbouring character classes and a few figures of repetition and shape, and encoded by a dense layer. Gated
attention, softmax over w . (tanh(V h) * sigmoid(U h)), says how much each passage counts, and a linear layer scores the
weighted passage. So a page of which one part is junk can be told from a clean one, and the weights say which part it was.

Fitting uses a bounded sample: at most `train_rows` labelled rows of each class and at most `train_passages` passages in
all (both parameters; rows are chosen by a hash and weighted back to the true class shares, and a row is used whole or
not at all). The tasks describe the passages of the sample; the model, of fixed size, is fitted on the driver and sent
to the tasks. Scoring reads every whole text and shuffles nothing: a text longer than a chunk of work is described in
one piece, and its passages are numbers of fixed length.

Defined results: null and empty texts, and texts without words, are one passage of zeros and get its score; a document
with several labels has quality 1 if at least half of them say so; a null quality is no label; a null doc_id counts as
held out; if the sample lacks a class, all scores are 0 or 1 as the labels say (0 without labels); repeated rows are
scored each; other columns of the table are left aside.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import SPACES, U64, Words, chunks

PASSAGE, WORD_SLOTS = 64, 256
TRAIN_ROWS, TRAIN_PASSAGES, HIDDEN, ATTENTION, EPOCHS = 3000, 60_000, 24, 12, 14
#: Class of each byte: letters by case, digits, blanks, line ends, bytes above ASCII, and four groups of signs.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:'\"-()", "!?", "#$%&*+=@^~", "|/\\<>[]{}_`")
HIGH = len(GROUPS)
CLASSES = HIGH + 2
CLASS = np.full(256, HIGH + 1, np.int64)
for _i, _g in enumerate(GROUPS):
    CLASS[[ord(c) for c in _g]] = _i
CLASS[0x80:] = HIGH
FIGURES = 7
WIDTH = WORD_SLOTS + CLASSES * CLASSES + FIGURES


def described(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (rows of WIDTH) of a column of texts, and the offsets of the texts in passages."""
    words = Words(column, SPACES, False)
    count = np.diff(words.first)
    bags = np.maximum(1, -(-count // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(bags)])
    m, n = int(offsets[-1]), len(words.starts)
    text = np.repeat(np.arange(len(count)), count)
    of = offsets[text] + (np.arange(n) - words.first[text]) // PASSAGE
    size = np.bincount(of, minlength=m).astype(float)
    some = np.maximum(size, 1)[:, None]
    hashes = words.hash()
    slots = np.bincount(of * WORD_SLOTS + (hashes >> U64(56)).astype(np.int64), minlength=m * WORD_SLOTS).reshape(m, WORD_SLOTS)
    # bytes from the start of each word to the start of the next one of its passage, so blanks count too
    kind = CLASS[words.data]
    place = np.zeros(len(words.data) + 1, np.int64)
    place[words.starts] = 1
    inside = np.flatnonzero(np.cumsum(place[:-1]) > 0) if n else np.zeros(0, np.int64)
    byte_of = of[np.cumsum(place[:-1])[inside] - 1] if n else inside
    pair = (byte_of[1:] == byte_of[:-1]) & (inside[1:] == inside[:-1] + 1)
    cell = byte_of[:-1][pair] * CLASSES * CLASSES + kind[inside[:-1][pair]] * CLASSES + kind[inside[1:][pair]]
    pairs = np.bincount(cell, minlength=m * CLASSES * CLASSES).reshape(m, CLASSES * CLASSES)
    lengths = words.ends - words.starts
    again = np.zeros(n, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(n, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    letters = np.bincount(byte_of, (kind[inside] <= 1) | (kind[inside] == HIGH), m)
    total = np.maximum(np.bincount(byte_of, minlength=m), 1)
    mean = np.bincount(of, lengths, m) / some[:, 0]
    figures = np.stack([np.bincount(of, again, m) / some[:, 0], np.bincount(of[order], new, m) / some[:, 0], np.minimum(mean / 10, 5), np.sqrt(np.minimum(np.bincount(of, (lengths / 10.0) ** 2, m) / some[:, 0], 100)),
                        letters / total, size / PASSAGE, np.log1p(np.repeat(bags, bags)) / 5], axis=1)
    out = np.concatenate([np.sqrt(slots / some), np.sqrt(pairs / total[:, None]), figures], axis=1)
    out[size == 0] = 0
    return out.astype(np.float32), offsets


def softmax_in(scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    e = np.exp(scores - np.repeat(np.maximum.reduceat(scores, offsets[:-1]), sizes))
    return e / np.repeat(np.add.reduceat(e, offsets[:-1]), sizes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Encoder, gated attention and scoring layer. Parameters by name, as arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, width: int, hidden: int = HIDDEN, attention: int = ATTENTION, seed: int = 3) -> Attention:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        return cls({"W": draw(width, hidden), "c": np.zeros(hidden), "V": draw(hidden, attention), "U": draw(hidden, attention), "w": draw(attention, 1)[:, 0], "s": draw(hidden, 1)[:, 0], "b": np.zeros(1)})

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = softmax_in((t * g) @ p["w"], offsets)
        z = np.add.reduceat(a[:, None] * h, offsets[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ p["s"] + p["b"])}

    def gradient(self, x: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean logistic loss."""
        p, f = self.p, self.forward(x, offsets)
        bag = np.repeat(np.arange(len(labels)), np.diff(offsets))
        d = (f["score"] - labels) * weight / weight.sum()
        dz = d[:, None] * p["s"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        mean = np.add.reduceat(f["a"] * da, offsets[:-1])
        de = f["a"] * (da - mean[bag])
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ dx, "c": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "s": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-5, seed: int = 5) -> Attention:
        """Adam over batches of 64 bags."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                pick = order[at:at + 64]
                offsets = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
                grad = self.gradient(np.concatenate([bags[i] for i in pick]).astype(float), offsets, labels[pick], weight[pick])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        return self


def constant(score: float) -> Attention:
    """The same score for every text."""
    model = Attention.fresh(WIDTH)
    model.p = {k: np.zeros_like(a) for k, a in model.p.items()}
    model.p["b"] = np.array([80.0 * score - 40.0])
    return model


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % modulus


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES) -> Attention:
    """Fit on labelled rows outside the held-out fold. labels: doc_id, quality."""
    own = (labels.filter("doc_id is not null and quality is not null").filter(fold(3) != 1)
           .groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg((F.col("quality") > 0).cast("double")) >= 0.5).cast("int").alias("y")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.join(rows.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(counts) < 2:
        return constant(1.0 if 1 in counts else 0.0)
    order = F.xxhash64(F.lit("quality"), "_id")
    chosen = own.filter(F.col("y") == 0).orderBy(order, "_id").limit(train_rows).unionByName(own.filter(F.col("y") == 1).orderBy(order, "_id").limit(train_rows))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x, offsets = described(b.column(2))
            sizes = np.diff(offsets)
            data = [x[s:e].tobytes() if e - s <= train_passages else b"" for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(data, pa.binary())], ["doc_id", "y", "passages", "x"])

    sample = common.stored(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"]).select("doc_id", "y", "text")
                           .mapInArrow(passages, "doc_id long, y int, passages long, x binary"), "quality-sample")
    sizes = sorted(((r["doc_id"], r["y"], r["passages"]) for r in sample.select("doc_id", "y", "passages").collect()), key=lambda r: hash(r[0]) * 0x9E3779B97F4A7C15 % (1 << 64))
    room, left = {0: train_passages // 2, 1: train_passages // 2}, {0: [], 1: []}
    for d, y, n in sizes:
        if n <= room[y]:
            room[y] -= n
            left[y].append(d)
    if not (left[0] and left[1]):
        return constant(float(counts[1] > counts[0]))
    ids = docs.sparkSession.createDataFrame([(d,) for d in left[0] + left[1]], "_id long")
    used = sorted(sample.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "y", "x").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in used], float)
    w = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Attention.fresh(WIDTH).fit([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in used], y, w)


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, held_out, score, predicted, and the passage (from 0) that counted most with its attention weight."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x, offsets = described(b.column(2))
            f = model.forward(x, offsets)
            s = np.clip(f["score"].astype(float), 0, 1)
            top = np.array([int(f["a"][u:v].argmax()) for u, v in zip(offsets, offsets[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(top), pa.array(f["a"][offsets[:-1] + top].astype(float))],
                                             ["doc_id", "held_out", "score", "predicted", "top_passage", "attention"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int, top_passage long, attention double")


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return score(docs, train(docs, common.table(spark, folder, "labels")))
