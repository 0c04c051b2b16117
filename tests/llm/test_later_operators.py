"""Whitening, periodic runs, passage attention and toxic pairs against brute force, and on odd tables."""
import hashlib
import os
import random
import re
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import passages, periodic, toxicity, whitening  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words long, runs string, h long, y int, _id long, x string, passages long"
REST = ("en", "s", 1, "r", 2, 3, 4, "x", 5)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, *REST) for d, t in rows], DOCS).repartition(3)


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int, h long, x string, copies long, `index` long, part int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5) for i, v in rows], VECTORS).repartition(3)


def brute_whitening(rows, components):
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [(i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)), (np.array(x) - sums / n) @ u / np.sqrt(e)) for i, x in good], e / np.trace(cov), u


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_whitening_equals_numpy(spark, block_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)) * [5, 3, 2, 1.5, 1, 0.5]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[5][1])]
    odd = [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (505, [1.0, 2.0])]
    got, found, error = whitening.whiten(vectors_of(spark, rows + odd), None, block_rows=block_rows)
    n, want, shares, _ = brute_whitening(rows, 6)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert n == 60 and len(got) == len(want) == 102 and error < 1e-9
    assert np.allclose(found.values / found.trace, shares)
    sign = np.sign(np.array(got[0][3]) * want[0][2])
    for (i, m, deviation, white), (j, own, projected) in zip(got, want):
        assert (i, m, deviation) == (j, n, own) and np.allclose(white, sign * projected, atol=1e-9)


def test_whitening_of_few_or_no_vectors(spark):
    assert whitening.whiten(vectors_of(spark, []))[0].count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None)]))[0].count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))[0].count() == 0
    rows, found, error = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])]))
    rows = rows.orderBy("vec_id").collect()
    assert len(found.values) == 1 and error < 1e-9 and [len(r["whitened"]) for r in rows] == [1, 1, 1]
    assert abs(abs(rows[0]["whitened"][0]) - 1) < 1e-12 and rows[1] == rows[2]


def test_whitening_with_equal_eigenvalues_and_large_numbers(spark):
    square = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]
    rows, found, error = whitening.whiten(vectors_of(spark, square))
    assert error < 1e-12 and np.allclose(found.values, 256 ** 2 / 2)
    assert all(abs(np.hypot(*r["whitened"]) - np.sqrt(2)) < 1e-12 for r in rows.collect())
    rows, _, error = whitening.whiten(vectors_of(spark, [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [1.0, 1e20])]))
    assert {r["deviation"] for r in rows.collect()} == {None}


def test_whitening_query(spark, folder):
    rows = whitening.op11_embedding_whitening(spark, folder).collect()
    source = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, want, shares, _ = brute_whitening(source, 4)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(rows) == 4 * len(want)
    sign = np.sign(np.array([got[want[0][0]][k]["whitened"] for k in (1, 2, 3, 4)]) * want[0][2])
    for i, deviation, white in want:
        own = [got[i][k] for k in (1, 2, 3, 4)]
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        assert np.allclose([r["whitened"] for r in own], sign * white, atol=1e-8) and np.allclose([r["explained"] for r in own], shares, rtol=1e-6)
        assert own[0]["identity_error"] < 1e-9


# ---- periodic runs

def brute_runs(w, exponent=4, least=6):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, exponent * q) and not any((i, n, p) in out for p in range(1, q)):
                out.add((i, n, q))
            i = j
    return sorted(out)


def repetitive(rng):
    words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
    if words and rng.random() < 0.5:
        words[10:10] = [rng.randrange(3) for _ in range(rng.randint(1, 12))] * rng.randint(2, 7)
    return words


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 6), (4, 6)])
def test_catchers_equal_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(250):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        hashes = periodic.mix(np.array([x + 7 for t in texts for x in t], np.uint64) * np.uint64(12345))
        text, runs = periodic.runs_of(hashes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), exponent, least)
        for i, t in enumerate(texts):
            assert list(map(tuple, runs[text == i].tolist())) == brute_runs(t, exponent, least)


def test_words_appended_one_by_one_or_in_pieces():
    rng = random.Random(9)
    for _ in range(150):
        t, at = repetitive(rng), 0
        hashes = periodic.mix(np.array([x + 7 for x in t], np.uint64))
        catchers, step = periodic.Catchers(2, 2), rng.choice([[1], [1, 2, 5, 9]])
        while at < len(t):
            n = rng.choice(step)
            catchers.append(hashes[at:at + n])
            at += n
            if rng.random() < 0.3:
                assert list(map(tuple, catchers.runs().tolist())) == brute_runs(t[:at], 2, 2)
        assert list(map(tuple, catchers.runs().tolist())) == brute_runs(t, 2, 2)


def brute_document(doc_id, text, loops=True):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if loops and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = [(i, rng.choice([" ", "\n", " \t"]).join("abé"[x] * 2 for x in repetitive(rng))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "x" * 5000), (905, "ab " * 4000), (905, "ab " * 4000), (906, "a b " * 3000), (None, "k k k k k k k"), (None, None), (2 ** 63 - 1, "           ")]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(((r["doc_id"], tuple(r[c] for c in names)) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    fast = [(d, t) for d, t in texts if d not in (905, 906)]
    assert [x for x in got if x[0] not in (905, 906)] == sorted(((d, brute_document(d, t)) for d, t in fast), key=str)
    same = [x for x in got if x[0] == 905]
    assert len(same) == 2 and same[0] == same[1]
    plain = {r["doc_id"]: r for r in periodic.periodic_runs(docs_of(spark, [(905, "ab " * 4000), (906, "a b " * 3000)])).collect()}
    assert [tuple(r) for r in plain[905]["runs"]] == [(0, 4000, 1)] and plain[905]["collapsed"] == "ab"
    assert [tuple(r) for r in plain[906]["runs"]] == [(0, 6000, 2)] and plain[906]["collapsed"] == "a b"
    assert periodic.periodic_runs(docs_of(spark, [])).count() == 0


def test_periodic_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in periodic.op12_periodic_runs(spark, folder).collect():
        if len(WORD.findall(docs[r["doc_id"]] or "")) <= 1500:
            assert tuple(r)[1:] == brute_document(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]


# ---- attention over passages

def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    model = passages.Attention.fresh(5, 4, 3)
    x, offsets, y, w = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        s = model.forward(x, offsets)["score"]
        return float(-(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum())

    for k, g in model.gradient(x, offsets, y, w).items():
        for i in np.ndindex(g.shape):
            old = model.p[k][i]
            model.p[k][i] = old + 1e-6
            up = loss()
            model.p[k][i] = old - 1e-6
            down = loss()
            model.p[k][i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def brute_described(text):
    """Hashed words aside: passages, their sizes, distinct words and repeats, by plain loops."""
    w = WORD.findall(text or "")
    cut = [w[i:i + passages.PASSAGE] for i in range(0, len(w), passages.PASSAGE)] or [[]]
    return [(len(p), len(set(p)), sum(a == b for a, b in zip(p, p[1:]))) for p in cut]


def test_passages_equal_plain_loops():
    import pyarrow as pa
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "é" * 90] + [" ".join(rng.choice(["a", "b", "cd", "É!"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    x, offsets = passages.described(pa.array(texts, pa.string()))
    assert len(offsets) == len(texts) + 1
    figures = x[:, -passages.FIGURES:]
    for i, t in enumerate(texts):
        want = brute_described(t)
        assert offsets[i + 1] - offsets[i] == len(want)
        for row, (n, distinct, again) in zip(figures[offsets[i]:offsets[i + 1]], want):
            assert np.allclose([row[0] * n, row[1] * n, row[5] * passages.PASSAGE], [again, distinct, n], atol=1e-4)
    assert not x[:3].any()


def with_one_part(rng, junk):
    """Long texts of which at most one part is junk."""
    words = ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(100, 700))]
    if junk:
        at = rng.randrange(len(words) // passages.PASSAGE + 1) * passages.PASSAGE
        words[at:at] = [w.upper() + "!!" for w in words[:passages.PASSAGE]]
        return " ".join(words), at // passages.PASSAGE
    return " ".join(words), None


def test_attention_finds_the_part_that_decides(spark):
    rng = random.Random(8)
    made = [with_one_part(rng, i % 3 == 0) for i in range(500)]
    docs = docs_of(spark, [(i, t) for i, (t, _) in enumerate(made)])
    labels = spark.createDataFrame([(i, int(at is None), 0, 1, 2) for i, (_, at) in enumerate(made)], "doc_id long, quality int, toxic int, y int, text int")
    rows = {r["doc_id"]: r for r in passages.score(docs, passages.train(docs, labels)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i in rows if rows[i]["held_out"]) == held
    assert np.mean([rows[i]["predicted"] == int(made[i][1] is None) for i in held]) >= 0.95
    junk = [i for i in held if made[i][1] is not None]
    assert np.mean([rows[i]["top_passage"] == made[i][1] for i in junk]) >= 0.8
    # labels of held-out rows say nothing
    other = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality)"))
    again = {r["doc_id"]: r["score"] for r in passages.score(docs, passages.train(docs, other)).collect()}
    assert all(abs(again[i] - rows[i]["score"]) < 1e-6 for i in again)


def test_quality_on_odd_tables(spark):
    odd = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "a b"), (None, None), (3, "w " * 30_000), (4, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = passages.score(odd, passages.train(odd, none)).collect()
    assert len(rows) == 7 and {r["score"] for r in rows} == {0.0} or all(r["score"] < 1e-9 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    fitted = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    odd = odd.unionByName(docs_of(spark, [(i, f"some words {i} ") for i in fitted]))
    one = spark.createDataFrame([(i, 1, 0) for i in fitted] + [(None, 0, 0), (1, None, 1)], none.schema)
    assert {r["predicted"] for r in passages.score(odd, passages.train(odd, one)).collect()} == {1}
    both = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 2, 3, 4, *fitted)] + [(77, 1, 0)], none.schema)
    rows = passages.score(odd, passages.train(odd, both)).collect()
    assert len(rows) == 7 + len(fitted) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert passages.score(docs_of(spark, []), passages.train(docs_of(spark, []), none)).count() == 0


def test_quality_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in passages.op13_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.97


def test_signs_that_are_no_letters_have_no_language(spark):
    from millrace.llm import language
    schema = "doc_id long, text string, lang string"
    learn = spark.createDataFrame([(i, t, x) for i in range(60) for t, x in (("the house and the tree", "en"), ("das haus und der baum", "de"))], schema)
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 ٣", None), (2, "½the²house", None), (3, "_ -", None)], schema)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, language.train(learn)).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == "en"


# ---- toxicity: pairs

def test_machine_adds_every_pair():
    """The closed form of the score equals a plain loop over all pairs of factors."""
    rng = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    for n in (0, 1, 2, 17):
        active = rng.choice(30, n, replace=False)
        want = m.bias + sum(m.weights[i] for i in active)
        for i in range(n):
            for j in range(i + 1, n):
                want += sum(m.factors[active[i]][f] * m.factors[active[j]][f] for f in range(4))
        assert abs(m.raw(active) - want) < 1e-9


def test_pair_whose_words_say_nothing_alone(spark):
    """Toxic when both words or neither occur: each word alone is balanced, only the pair tells."""
    rng = np.random.default_rng(8)
    filler = ["stone", "river", "cloud", "paper", "green", "light"]
    rows, marks = [], []
    for i in range(4000):
        a, b = i % 2, i // 2 % 2
        words = list(rng.choice(filler, 3, replace=False)) + ["zorvex"] * a + ["quibble"] * b
        rows.append((i, " ".join(words)))
        marks.append((i, int(a == b)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = [r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r["held_out"]]
    right = sum(r["predicted"] == marks[r["doc_id"]][1] for r in got) / len(got)
    assert len(got) > 500 and right > 0.95
