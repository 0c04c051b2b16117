"""Benchmark decontamination by suffix arrays of the training texts.

Each task turns what it reads into shards of about a megabyte and builds a word-level suffix array of each shard (sorted to
the depth of a window by packing ranks). Every test suffix that is long enough for a window is binary-searched in
every shard; the interval it finds lists all places where the window occurs. Neighbouring windows on one diagonal are
joined to longest verbatim matches with their places. Documents stay in the tasks that read them, nothing is shuffled.

The test items are sent to the tasks in blocks of about `BLOCK_BYTES`, by hash; with more text than that the documents
pass through one step for each block and gather their matches.

Words are runs of letters and digits (any non-ASCII byte counts as one), A-Z in lower case. An item of fewer words
than a window is one window; an item without words has none. Defined results: null texts have no words; an item_id that
is repeated counts once, a null one as the empty string; repeated documents are judged each; with no items nothing is
hit.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import NOT_ALNUM, Words, chunks, union_length

WINDOW, SHARD_BYTES, BLOCK_BYTES = 10, 1 << 20, 8 << 20
MATCHES = "array<struct<item:string,item_start:int,doc_start:int,n_words:int>>"
MATCH_TYPE = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))


class TestSet:
    """The windows of a block of items as word hashes."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.string()), NOT_ALNUM, True)
        h = words.hash()
        self.ids, self.window = ids, window
        item, start, size = [], [], []
        for i, (a, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = min(window, z - a)
            for s in range(a, z - n + 1 if n else a):
                item.append(i)
                start.append(s - a)
                size.append(n)
        self.item, self.start, self.size = np.array(item, np.int64), np.array(start, np.int64), np.array(size, np.int64)
        self.hashes = np.zeros((len(item), window), np.uint64)
        first = words.first[self.item] + self.start if len(item) else self.start
        for j in range(window):
            ok = j < self.size
            self.hashes[ok, j] = h[first[ok] + j]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Start places of x in the order of the `depth` values from there on; x is padded with zeros behind."""
    def later(r: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([r[k:], np.zeros(min(k, len(r)), r.dtype)])[:len(r)]

    rank, have = np.unique(x, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 1
    bits = max(1, int(len(x)).bit_length())
    parts = max(2, 63 // bits)
    while have < depth:
        key = rank
        for p in range(1, parts):
            key = (key << np.uint64(bits)) | later(rank, have * p)
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        have *= parts
    return np.argsort(rank, kind="stable")


def bounds(x: np.ndarray, order: np.ndarray, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the interval of `order` whose suffixes begin with its first `size` values. x has zeros behind."""
    steps = np.arange(queries.shape[1])
    inside = steps < size[:, None]

    def search(equal_goes_right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            found = x[order[mid][:, None] + steps]
            wrong = (found != queries[open_]) & inside[open_]
            at = wrong.argmax(axis=1)
            pick = np.arange(len(open_))
            differs = wrong[pick, at]
            right = np.where(differs, found[pick, at] < queries[open_, at], equal_goes_right)
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo

    return search(False), search(True)


def shard_matches(words: Words, tests: TestSet) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches in a shard: document, item (place in the block), start in the item, start in the document, words."""
    h = words.hash()
    docs = len(words.first) - 1
    none = (np.zeros(0, np.int64),) * 5
    if not len(h) or not len(tests.item):
        return none
    known = np.unique(h)
    x = np.zeros(len(h) + docs + tests.window, np.int64)  # a zero behind each document
    of = np.repeat(np.arange(docs), np.diff(words.first))
    x[np.arange(len(h)) + of] = 2 * np.searchsorted(known, h) + 2
    at = np.minimum(np.searchsorted(known, tests.hashes), len(known) - 1)
    queries = np.where(known[at] == tests.hashes, 2 * at + 2, 2 * np.searchsorted(known, tests.hashes) + 1)
    order = suffix_array(x[:len(h) + docs], tests.window)
    left, right = bounds(x, order, queries, tests.size)
    count = right - left
    if not count.sum():
        return none
    q = np.repeat(np.arange(len(count)), count)
    places = order[np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    doc = np.searchsorted(words.first[1:] + np.arange(1, docs + 1), places, "right")
    start = places - doc - words.first[doc]
    item, own, size = tests.item[q], tests.start[q], tests.size[q]
    o = np.lexsort((start, start - own, item, doc))
    doc, item, own, start, size = doc[o], item[o], own[o], start[o], size[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - own[1:] != start[:-1] - own[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(o)) - 1
    return doc[head], item[head], own[head], start[head], start[tail] - start[head] + size[tail]


def search_block(docs: DataFrame, tests: TestSet) -> DataFrame:
    """Adds the block's matches to the column `matches` and sets n_words."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)
    names = docs.columns
    text, held, number = names.index("text"), names.index("matches"), names.index("n_words")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for b in chunks(batches, "text", SHARD_BYTES):
            words = Words(b.column(text), NOT_ALNUM, True)
            doc, item, own, start, n = (v.tolist() for v in shard_matches(words, tests))
            columns = list(b.columns)
            columns[number] = pa.array(np.diff(words.first), pa.int64())
            if doc:
                rows = b.column(held).to_pylist()
                for d, i, o, s, k in zip(doc, item, own, start, n):
                    rows[d].append({"item": tests.ids[i], "item_start": o, "doc_start": s, "n_words": k})
                columns[held] = pa.array(rows, MATCH_TYPE)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(search, docs.schema)


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words and matches (item, start word in the item, start word in the document, words)."""
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "matches": F.lit(None).cast(MATCHES)}).withColumn("matches", F.coalesce("matches", F.array().cast(MATCHES)))
    tests = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        out = search_block(out, TestSet([i for i, _ in rows], [t for _, t in rows], window))
    return out


def verdicts(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blank = hashlib.sha256(b"").hexdigest()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, count, sha = [0] * b.num_rows, [0] * b.num_rows, [blank] * b.num_rows
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(sizes > 0).tolist():
                m = b.column(2)[i].as_py()
                start = np.array([x["doc_start"] for x in m])
                hit[i] = int(union_length(start, start + np.array([x["n_words"] for x in m]), b.column(1)[i].as_py()).sum())
                ids = sorted({x["item"] for x in m})
                count[i], sha[i] = len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in hit], pa.bool_())],
                                             ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return (found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "matches")
            .mapInArrow(sums, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a match, with their columns."""
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*others).alias("row"), "text") if others else docs.select("text")
    return find_matches(inner, items).filter(F.size("matches") == 0).select(*[F.col(c if c == "text" else f"row.{c}") for c in docs.columns])


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    return verdicts(find_matches(docs, common.table(spark, folder, "benchmark")))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
        FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (SELECT d.doc_id, d.s, d.size, win.item
        FROM (SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw CROSS JOIN sizes WHERE len(w) >= size)) d
        JOIN win ON win.size = d.size AND win.g = d.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(its.h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""
