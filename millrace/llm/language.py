"""Language identification: words first, then shorter and shorter character grams.

A known word adds its log frequency in each language. A word that the training texts lack is scored by its known
5-grams (with word edges); if it has none, by its 4-grams, and so on down to single letters. The sums are turned into
shares of belief.

Fitting counts words and grams over a bounded sample of at most `train_rows` rows for each language, chosen by a hash;
counting is a Spark aggregation, and words and grams below `least` occurrences are left to the backoff, so the model's
size is bounded by the sample. Prediction reads every whole text and shuffles nothing.

Defined results: null texts and texts without a letter are `und` with score 0; if there is nothing to learn from, all
are `und`; if nothing in a text is known, the languages' shares in the training rows decide; a null doc_id counts as
held out; repeated rows are predicted each; any number of
languages: beyond DENSE_LANGUAGES the same logs are kept sparse.
"""
from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import chunks

TRAIN_ROWS, LEAST, LONGEST, DENSE_LANGUAGES, KEPT_WORDS, KEPT_CELLS, SUM_CELLS = 3000, 4, 5, 500, 200_000, 100_000_000, 1 << 22
#: Signs that count as word characters but are no letters, such as ½ or ².
NO_LETTERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD, PLAIN_WORD, NO_LETTER_SET = re.compile(rf"[^\W\d_{NO_LETTERS}]+"), re.compile(r"[^\W\d_]+"), frozenset(NO_LETTERS)


def words_of(text: str) -> list[str]:
    """The words of the lower-cased text. The long list of signs slows a match many times, so only texts that hold one meet it."""
    text = text.lower()
    return (PLAIN_WORD if text.isascii() or NO_LETTER_SET.isdisjoint(text) else WORD).findall(text)


def grams(word: str, n: int) -> list[str]:
    edged = f"<{word}>" if n > 1 else word
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


class SparseLogs:
    """Rows of log frequencies that hold only what was seen in a language; the rest of a row is the same for all of its level."""

    def __init__(self, unseen: np.ndarray, level: np.ndarray, starts: np.ndarray, langs: np.ndarray, seen: np.ndarray):
        self.unseen, self.level, self.starts, self.langs, self.seen = unseen, level, starts, langs, seen

    def __getitem__(self, i: int | list[int]) -> np.ndarray:
        if isinstance(i, list):
            return np.array([self[j] for j in i])
        row, own = self.unseen[self.level[i]].copy(), slice(self.starts[i], self.starts[i + 1])
        row[self.langs[own]] = self.seen[own]
        return row


class Backoff:
    """levels[0] has words, levels[n] has n-grams: from string to its row in `logs`, log frequencies by language."""

    def __init__(self, languages: list[str], prior: np.ndarray, levels: list[dict[str, int]], logs: np.ndarray | SparseLogs):
        self.languages, self.prior, self.levels, self.logs = languages, prior, levels, logs

    def word(self, w: str) -> np.ndarray:
        if (i := self.levels[0].get(w)) is not None:
            return self.logs[i]
        for n in range(LONGEST, 0, -1):
            find = self.levels[n].get
            if hit := [i for g in grams(w, n) if (i := find(g)) is not None]:
                return np.add.reduce(self.logs[hit], 0) / np.float32(len(hit))
        return np.zeros(len(self.languages), np.float32)

    def rows(self, words: list[str], known: dict[str, np.ndarray]) -> np.ndarray:
        """The logs of each word, by language. Words of a dense model are fetched together, all others one at a time and kept."""
        direct = self.levels[0] if isinstance(self.logs, np.ndarray) else {}
        at = np.array([direct.get(w, -1) for w in words])
        out = np.empty((len(words), len(self.languages)))
        if direct:
            out[:] = self.logs[at]
        for j in np.flatnonzero(at < 0).tolist():
            w = words[j]
            r = known.get(w)
            if r is None:
                known[w] = r = self.word(w)
            out[j] = r
        if len(known) > min(KEPT_WORDS, KEPT_CELLS // len(self.languages)):
            known.clear()
        return out

    def predict(self, text: str | None, known: dict[str, np.ndarray]) -> tuple[str, float]:
        counts = Counter(words_of(text)) if text else None
        if not counts or not self.languages:
            return "und", 0.0
        total, words, times = self.prior, list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        step = max(1, SUM_CELLS // len(self.languages))
        for at in range(0, len(words), step):
            total = total + times[at:at + step] @ self.rows(words[at:at + step], known)
        total -= total.max()
        belief = np.exp(total)
        best = int(belief.argmax())
        return self.languages[best], float(belief[best] / belief.sum())


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, least: int = LEAST) -> Backoff:
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(fold(4) != 2).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return Backoff([], np.zeros(0), [{} for _ in range(LONGEST + 1)], np.zeros((0, 0), np.float32))
    languages = [x for x, _ in counts]
    parts = docs.sparkSession.createDataFrame([(x, min(1.0, train_rows / n)) for x, n in counts], "lang string, part double")
    sample = rows.join(F.broadcast(parts), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("part") * (1 << 20)).select("lang", "text")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for (x, w), c in words.items():
                total[x, 0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        total[x, n, g] += c
            words.clear()
            if total:
                keys = list(total)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array(list(total.values()), pa.int64())],
                                                 ["lang", "level", "gram", "n"])

        for b in chunks(batches, "text"):
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.update((place[x], w) for w in words_of(t))
            if len(words) > 100_000:
                yield from flush()
        yield from flush()

    known = (sample.mapInArrow(count, "lang int, level int, gram string, n long").groupBy("level", "gram", "lang").agg(F.sum("n").alias("n"))
             .groupBy("level", "gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
             .filter(F.col("all") >= least).orderBy("level", "gram").select("level", "gram", "by").collect())
    levels: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    level, starts = np.zeros(len(known), int), np.zeros(len(known) + 1, int)
    langs, seen = (np.zeros(sum(len(r["by"]) for r in known), k) for k in (np.int32, float))
    for i, r in enumerate(known):
        levels[r["level"]][r["gram"]] = i
        level[i] = r["level"]
        starts[i + 1] = starts[i] + len(r["by"])
        langs[starts[i]:starts[i + 1]], seen[starts[i]:starts[i + 1]] = list(r["by"]), list(r["by"].values())
    row = np.repeat(np.arange(len(known)), np.diff(starts))
    unseen = np.zeros((LONGEST + 1, len(languages)), np.float32)
    for n in range(LONGEST + 1):
        mine = level[row] == n
        total = np.bincount(langs[mine], seen[mine], len(languages)) + 0.5 * max(1, (level == n).sum())
        unseen[n] = np.log(0.5 / total)
        seen[mine] = np.log((seen[mine] + 0.5) / total[langs[mine]])
    logs = SparseLogs(unseen, level, starts, langs, seen.astype(np.float32))
    if len(languages) <= DENSE_LANGUAGES:
        logs, sparse = unseen[level], logs
        logs[row, langs] = sparse.seen
    share = np.array([n for _, n in counts], float)
    return Backoff(languages, np.log(share / share.sum()), levels, logs)


def identify(docs: DataFrame, model: Backoff) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in chunks(batches, "text"):
            out = [sent.value.predict(t, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(4) == 2, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return identify(docs, train(docs))
