"""Exact set similarity join on word 3-grams, and the components of its links.

Documents of equal sets form a class at once; the rest works on classes. A class puts the rarest tenth of its shingles
(the prefix for a similarity of 0.9) into inverted lists that carry the position of the shingle in the set. "Rare" is a
fixed-size sketch of shingle and word counts over all documents; it only decides how long lists get, not the result.

Lists are read in two rounds, with the set relations deciding what is skipped:

* Index level: a list is sorted by set size and only neighbours within the size bound meet; a pair is skipped by position
  when what follows the common shingle cannot reach the overlap needed (it cannot be its first common one then), and by
  the parity bits of the sets, which bound the difference of two sets from below.
* Answer level: round one compares each set with the most similar set before it in each list only. Sets that are found
  to be linked answer for each other: in round two all members of one component share their answers, lists that lie in one
  component are skipped whole, and only pairs between components are compared.

Every pair that passes is decided on the whole sets. Long lists are dealt out in blocks of members and pairs of blocks, so
no task holds a whole list; copies and near copies never meet all with all across rows.

A set is held as 64-bit hashes. Defined results: null and empty texts have an empty set and are linked with nothing;
fewer than three words are one shingle; rows that share a doc_id are one document for linking, so the sets of its texts are
in one component; a null doc_id is linked
with nothing and has a null component; other columns do not matter.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import FIRST, SPACES, U64, Words, chunks, flat, mix, signed
from millrace.llm.components import components

PERCENT, SIZE, BLOCK, SMALL_LIST, PAIRS_AT_ONCE, COPIES_SEEN = 90, 3, 1024, 32, 1 << 18, 200_000
SKETCH_BITS = 16


class Shingles:
    """The shingles of a chunk of texts with the counts of their words in the sketch."""

    def __init__(self, column: pa.Array, sketch: np.ndarray | None = None):
        w = Words(column, SPACES, True)
        h = w.hash()
        self.words, self.first = h, w.first
        self.sums = FIRST.sums(h)
        at = np.arange(max(len(h) - SIZE + 1, 0))
        self.grams = FIRST.span(self.sums, at, at + SIZE)
        if sketch is not None:
            c = sketch[0][bucket(h)].astype(float)
            self.spread = c[:len(at)] * c[1:len(at) + 1] * c[2:len(at) + 2] if len(at) else np.zeros(0)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of text i, sorted, and a place where each begins."""
        a, z = int(self.first[i]), int(self.first[i + 1])
        if z - a >= SIZE:
            s, at = np.unique(self.grams[a:z - SIZE + 1], return_index=True)
            return s, at + a
        if z > a:
            return FIRST.span(self.sums, np.array([a]), np.array([z])), np.array([-1])
        return np.zeros(0, U64), np.zeros(0, np.int64)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SKETCH_BITS)).astype(np.int64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in any order of its members."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(s ^ U64(salt)).sum(dtype=U64).view(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def parity(s: np.ndarray) -> bytes:
    """One bit for the parity of the members in each of 2**k buckets, as many as members or more. The number of bits
    in which two sets differ is at most the size of their symmetric difference; halves may be folded together."""
    bits = max(64, 1 << (max(1, len(s)) - 1).bit_length())
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketch_counts(docs: DataFrame) -> np.ndarray:
    """Counts of words (row 0) and shingles (row 1) by the first bits of their hash: a table of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.ones((2, 1 << SKETCH_BITS), np.int64)
        for b in chunks(batches, "text"):
            s = Shingles(b.column(0))
            total[0] += np.bincount(bucket(s.words), minlength=1 << SKETCH_BITS)
            total[1] += np.bincount(bucket(s.grams), minlength=1 << SKETCH_BITS)
            FIRST.trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 << SKETCH_BITS), pa.int32()), pa.array(total.ravel())], ["place", "n"])

    out = np.ones(2 << SKETCH_BITS, np.int64)
    for r in docs.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["place"]] = r["n"]
    return out.reshape(2, -1)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (members), s1, s2 (signature), bits, text_key."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            sh = Shingles(b.column(1))
            found = [sh.of(i)[0] for i in range(b.num_rows)]
            FIRST.trim()
            sign = [signature(s) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in sign], pa.int64()), pa.array([y for _, y in sign], pa.int64()), pa.array([parity(s) for s in found], pa.binary()), b.column(2)],
                                             ["doc_id", "n", "s1", "s2", "bits", "text_key"])

    return docs.select("doc_id", "text", common.row_key().alias("text_key")).mapInArrow(sets, "doc_id long, n long, s1 long, s2 long, bits binary, text_key long")


def prefix_rows(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """token, s1, n, place: the rarest shingles of each set, as many as two sets of this similarity must share one of.
    A task writes a set that it meets again once."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = sent.value, set()
        mean = float(sketch[1].mean())
        for b in chunks(batches, "text"):
            sh = Shingles(b.column(0), sketch)
            tokens, signs, sizes = [], [], []
            for i in range(b.num_rows):
                s, at = sh.of(i)
                if not len(s) or (sign := signature(s)) in seen:
                    continue
                if len(seen) > COPIES_SEEN:
                    seen.clear()
                seen.add(sign)
                spread = sh.spread[at] if at[0] >= 0 else np.zeros(1)
                level = np.maximum(0, np.floor(8 * np.log2(sketch[1][bucket(s)] / mean)))
                tokens.append(s[np.lexsort((s, spread, level))][:len(s) - (-(-percent * len(s) // 100)) + 1])
                signs.append(sign[0])
                sizes.append(len(s))
            FIRST.trim()
            if tokens:
                k = np.array([len(t) for t in tokens])
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(tokens)), pa.array(np.repeat(signs, k), pa.int64()), pa.array(np.repeat(sizes, k), pa.int32()), pa.array(place, pa.int32())], ["token", "s1", "n", "place"])

    return docs.select("text").mapInArrow(prefixes, "token long, s1 long, n int, place int")


class Lists:
    """A batch of whole inverted lists: arrays by entry, lists marked by their first entries."""

    def __init__(self, b: pa.RecordBatch, edges: np.ndarray, percent: int):
        self.node, self.n, self.place, self.home, self.side = (b.column(i).to_numpy() for i in (2, 3, 4, 6, 7))
        self.n = self.n.astype(np.int64)
        data, offsets = flat(b.column(5))
        self.words = np.diff(offsets) // 8
        self.at = offsets[:-1] // 8
        self.bits = np.frombuffer(data.tobytes(), U64)
        self.edges, self.percent = edges, percent

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries i < j of one list, in portions."""
        size = np.diff(self.edges)
        small = np.repeat(size <= SMALL_LIST, size)
        end = np.repeat(self.edges[1:], size)
        at = np.flatnonzero(small)
        for d in range(1, SMALL_LIST):
            at = at[at + d < end[at]]
            if not len(at):
                break
            yield at, at + d
        for k in np.flatnonzero(size > SMALL_LIST):
            a, m = self.edges[k], int(size[k])
            rows = max(1, PAIRS_AT_ONCE // m)
            for r in range(0, m, rows):
                i, j = np.nonzero(np.arange(r, min(r + rows, m))[:, None] < np.arange(m)[None, :])
                yield a + r + i, a + j

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences."""
        out = np.zeros(len(i), np.int64)
        wi, wj = self.words[i], self.words[j]
        swap = wi > wj
        i, j, wi, wj = np.where(swap, j, i), np.where(swap, i, j), np.minimum(wi, wj), np.maximum(wi, wj)
        for w in np.unique(wi):
            for double in (False, True):
                pick = np.flatnonzero((wi == w) & (wj == (2 * w if double else w)))
                step = max(1, (1 << 20) // int(w))
                for s in range(0, len(pick), step):
                    p = pick[s:s + step]
                    x, base = self.bits[self.at[i[p]][:, None] + np.arange(w)], self.at[j[p]][:, None] + np.arange(w)
                    y = self.bits[base] ^ self.bits[base + w] if double else self.bits[base]
                    out[p] = np.bitwise_count(x ^ y).sum(axis=1)
        return out

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that may be linked, and the lower bound of their difference."""
        kept = [(np.zeros(0, np.int64),) * 3]
        p = self.percent
        for i, j in self.pairs():
            a, b = self.n[i], self.n[j]
            overlap = -(-p * (a + b) // (100 + p))
            ok = (self.home[i] != self.home[j]) & (100 * np.minimum(a, b) >= p * np.maximum(a, b)) & ((self.side[i] != self.side[j]) | (self.side[i] < 0))
            ok &= 1 + np.minimum(a - self.place[i], b - self.place[j]) - 1 >= overlap
            i, j, room = i[ok], j[ok], (a + b - 2 * overlap)[ok]
            d = self.differences(i, j)
            near = d <= room
            kept.append((i[near], j[near], d[near]))
        return tuple(np.concatenate(x) for x in zip(*kept))


def list_pairs(entries: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """a, b: pairs of nodes worth deciding. entries: token, part, node, n, place, bits, home, side, where pairs of one home
    and of one side (other than -1) are skipped. nearest: for each entry only the most similar one before it."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
            lists = Lists(b, edges, percent)
            i, j, d = lists.candidates()
            if nearest and len(j):
                o = np.lexsort((i, d, j))
                o = o[np.append(True, j[o][1:] != j[o][:-1])]
                i, j = i[o], j[o]
            x, y = lists.node[i], lists.node[j]
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            token, part = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            new = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
            if len(new) > 1:
                yield work(whole.slice(0, new[-1]), new)
                whole = whole.slice(new[-1])
            held = [whole]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield work(whole, np.array([0, whole.num_rows]))

    parts = common.all_parts(entries.sparkSession)
    dealt = entries.repartition(parts, "token", "part").sortWithinPartitions("token", "part", "n", "node")
    return dealt.select("token", "part", "node", "n", "place", "bits", "home", "side").mapInArrow(scan, "a long, b long").filter("a <> b").distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are as similar as asked. sets: node, members (sorted 64-bit hashes)."""
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            (x, xo), (y, yo) = flat(b.column(2)), flat(b.column(3))
            for i in range(b.num_rows):
                s, t = x[xo[i]:xo[i + 1]].view(U64), y[yo[i]:yo[i + 1]].view(U64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(s) + len(t) - same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")


def member_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, members for the given nodes (node, own, text_key, s1, s2): own and text_key name a row that has the set."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            sh = Shingles(b.column(1))
            found = [sh.of(i)[0] for i in range(b.num_rows)]
            FIRST.trim()
            right = [signature(s) == (x, y) for s, x, y in zip(found, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "members"]).filter(pa.array(right, pa.bool_()))

    wanted = docs.withColumn("_text", common.row_key()).join(nodes, (F.col("doc_id") == F.col("own")) & (F.col("_text") == F.col("text_key")))
    return wanted.select("node", "text", "s1", "s2").mapInArrow(sets, "node long, members binary").dropDuplicates(["node"])


def in_blocks(entries: DataFrame, across: bool) -> DataFrame:
    """Adds part and side. A list of more than BLOCK entries is dealt out by a hash of the node; across: to every pair of
    blocks, so that each two entries meet once; else to the blocks alone."""
    count = F.ceil(F.col("length") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")
    rows = entries.withColumn("_blocks", count).withColumn("_mine", mine)
    if not across:
        return rows.withColumn("part", F.col("_mine")).withColumn("side", F.lit(-1)).drop("_blocks", "_mine")
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    return (rows.withColumn("part", low * F.col("_blocks") + high)
            .withColumn("side", F.when(F.col("_mine") == F.col("_other"), F.lit(-1)).otherwise(F.col("_mine"))).drop("_blocks", "_mine", "_other"))


def ids_of_several_sets(able: DataFrame) -> DataFrame | None:
    """doc_id, rows, and s1, s2, n of its first set, for each doc_id of several sets; None where there is none."""
    one = F.struct("s1", "s2", "n")
    found = able.groupBy("doc_id").agg(F.min(one).alias("one"), F.max(one).alias("last"), F.count(F.lit(1)).alias("rows")).filter("one <> last")
    return common.stored(found.select("doc_id", "rows", "one.*"), "ids") if found.limit(1).count() else None


def links_of_ids(able: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: every set of such a doc_id and its first one."""
    key = ["s1", "s2", "n"]
    firsts = several.join(classes.select(*key, F.col("node").alias("a")), key).select("doc_id", "rows", "a")
    pairs = common.join_hot(able.select("doc_id", *key), common.stored(firsts, "firsts"), ["doc_id"], "rows", able.count()).filter("a is not null")
    return pairs.distinct().join(classes.select(*key, F.col("node").alias("b")), key).select("a", "b").filter("a <> b").distinct()


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: rows in one component are joined by links of at least `percent` Jaccard."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.stored(set_rows(docs), "sets")
    able = rows.filter("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    classes = able.groupBy("s1", "s2", "n").agg(least, F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")).select("s1", "s2", "n", "copies", "bits", "least.text_key", F.col("least.doc_id").alias("own"))
    several_sets = ids_of_several_sets(able)
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id() if several_sets is not None else F.col("own")), "classes")
    named = docs.filter("doc_id is not null")
    prefix = prefix_rows(named, sketch_counts(named), percent)
    shared = prefix.groupBy("token").agg(F.min("s1").alias("c1"), F.max("s1").alias("c2"), F.count(F.lit(1)).alias("length")).filter("c1 <> c2").select("token", "length")
    names = classes.select("s1", F.col("n").cast("int").alias("n"), "node", "bits")
    entries = common.stored(prefix.join(shared, "token").distinct().join(names, ["s1", "n"]).select("token", "length", "node", "n", "place", "bits"), "lists")

    near = common.stored(list_pairs(in_blocks(entries.withColumn("home", F.col("node")), False), percent, True), "pairs")
    keys = classes.select("node", "own", "text_key", "s1", "s2")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = common.stored(member_sets(docs, keys.join(ends, "node", "left_semi")), "members")
    links = common.stored(linked(near, sets, percent), "links")
    home = components(links)

    placed = entries.join(home, "node", "left").withColumn("home", F.coalesce("component", "node")).drop("component")
    several = placed.groupBy("token").agg(F.min("home").alias("h1"), F.max("home").alias("h2")).filter("h1 <> h2").select("token")
    rest = common.stored(list_pairs(in_blocks(placed.join(several, "token", "left_semi"), True), percent, False)
                         .join(near, ["a", "b"], "left_anti"), "pairs")
    missing = (rest.select(F.col("a").alias("node")).unionByName(rest.select(F.col("b").alias("node"))).distinct().join(sets, "node", "left_anti"))
    if missing.limit(1).count():
        sets = sets.unionByName(common.stored(member_sets(docs, keys.join(missing, "node", "left_semi")), "members"))
    more = common.stored(linked(rest, sets, percent), "links")
    if several_sets is not None:
        joined = common.stored(components(links.unionByName(more).unionByName(links_of_ids(able, several_sets, classes))).join(classes.select("node", "own"), "node"), "components")
        least_id = joined.groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("nodes"))
        final = common.join_hot(joined, least_id, ["component"], "nodes", joined.count()).select("node", F.col("least").alias("component"))
    else:
        final = components(links.unionByName(more)) if more.limit(1).count() else home

    groups = (classes.join(final, "node", "left").select("s1", "s2", "n", "copies", F.coalesce("component", "own").alias("component_id")))
    grouped = common.join_hot(able.select("doc_id", "n", "s1", "s2"), groups, ["s1", "s2", "n"], "copies", able.count())
    alone = rows.filter("not (doc_id is not null and n > 0)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that are first of their component, with their columns; rows without a doc_id stay."""
    name = common.fresh(docs, "_gone")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(common.table(spark, folder, "documents"))
