"""The operators against brute force and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""
import hashlib
import itertools
import math
import os
import random
import re
import sys
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from millrace.llm import chat, decontaminate, exact_dedup, jaccard_join, language, mixing, substring_dedup, suffix_dedup, tokens, toxicity  # noqa: E402

CLASH = "id long, rk long, n_words long, matches string, node long, component string, digest string, row string, h long, bucket long"
SCHEMA = "doc_id long, text string, lang string, source string, " + CLASH
REST = (1, 2, 3, "m", 4, "c", "d", "r", 5, 6)


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) + REST for r in rows], SCHEMA).repartition(3)


def invented(n, seed, words=30, longest=60, copies=0.5):
    """Texts of few words, many of them edited copies of others."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    out = []
    for i in range(n):
        if out and rng.random() < copies:
            w = re.split(r"\s+", rng.choice(out)[1] or "")
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            if rng.random() < 0.3:
                w = [rng.choice(vocabulary) for _ in range(8)] + w
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, longest))]
        out.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    return out


ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "One"), (904, "one two"), (905, "ONE two"), (906, "x" * 3000), (907, "ab " * 5000), (908, "ab " * 5000), (909, "ß" * 700)]


@pytest.fixture(scope="module")
def texts():
    return invented(120, 1) + ODD


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- token counts

def test_token_counts_equal_the_library(spark, texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    rows = texts + [(950, "a  b ▁ c <s> d"), (951, " lead and trail "), (952, "the " * 5000)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t in rows}
    got = by_id(tokens.token_counts(docs_of(spark, rows)), "n_bytes", "n_tokens", "over_limit")
    assert got == want and want[952][2]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(tokens.token_counts(docs_of(spark, rows[:30]), "byte_bpe_50k.json"), "n_tokens")
    assert got == {d: (len(other.encode(t or "", add_special_tokens=False).ids),) for d, t in rows[:30]}


# ---- substring and suffix deduplication

@pytest.mark.parametrize("seed", [2, 3])
def test_substring_dedup(spark, seed):
    rows = invented(100, seed, words=12) + ODD
    found = substring_dedup.kept_digests(*substring_dedup.repeats(docs_of(spark, rows), window=7, gram=3), window=7)
    assert by_id(found, "n_words", "n_removed", "kept_sha256") == brute.word_repeats(rows, 7)


@pytest.mark.parametrize("shard_rows", [8000, 3])
def test_suffix_dedup(spark, shard_rows):
    rows = invented(60, 4) + ODD[:8]
    found = suffix_dedup.kept_digests(*suffix_dedup.repeats(docs_of(spark, rows), window=25, gram=6, shard_rows=shard_rows, shard_bytes=4000), window=25)
    assert by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_repeats(rows, 25)


def test_dedup_of_repeated_and_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(5, passage), (5, passage), (5, "other " + passage), (None, passage), (None, passage)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.kept_digests(*substring_dedup.repeats(docs_of(spark, rows))).collect())
    assert got == [(False, 5, 80, 0), (False, 5, 80, 0), (False, 5, 81, 0), (True, 0, 80, 80), (True, 0, 80, 80)]
    gone = [(r["n_bytes"], r["n_removed"]) for r in suffix_dedup.kept_digests(*suffix_dedup.repeats(docs_of(spark, rows))).collect()]
    size = len(passage)
    assert sorted(gone) == sorted([(size, size)] * 4 + [(size + 6, size)])


def test_dedup_of_no_rows(spark):
    assert substring_dedup.kept_digests(*substring_dedup.repeats(no_rows(spark))).count() == 0
    assert suffix_dedup.kept_digests(*suffix_dedup.repeats(no_rows(spark))).count() == 0


def test_repeat_groups_list_all_occurrences():
    import numpy as np
    data = np.frombuffer(b"xabcabcyabcabcz", np.uint8)
    g = suffix_dedup.repeat_groups(data, np.array([0, 15]), np.array([1]), 3)
    groups = {}
    for k, s, m in zip(g["group"], g["start"], g["maximal"]):
        groups.setdefault((int(k), bool(m)), set()).add(int(s))
    assert {tuple(sorted(v)) for (_, m), v in groups.items() if m} == {(1, 4, 8, 11)}  # abc; bca and cab extend to the left
    assert set(map(int, g["start"])) == {1, 2, 3, 4, 8, 9, 10, 11}


def test_exact_dedup_null_ids_as_in_sql(spark, tmp_path):
    rows = [(None, "a  b"), (None, "a b"), (None, "c"), (4, "c"), (5, None), (None, "")]
    folder = str(tmp_path)
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    got = exact_dedup.op8_exact_dedup(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"SELECT {cols} FROM ({exact_dedup.OP8_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols.split(", ")).collect()))) == sorted(map(repr, want))
    assert sum(r[3] for r in want) == 4
    assert (exact_dedup.buckets_for(0), exact_dedup.buckets_for(160_000_001), exact_dedup.buckets_for(2 * 10 ** 10)) == (16, 17, 2000)


# ---- Jaccard join

@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = invented(150, 5, words=200, longest=90, copies=0.8) + ODD
    got = by_id(jaccard_join.similar_components(docs_of(spark, rows)), "n_shingles", "component_id")
    want = brute.jaccard_components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_odd_tables(spark):
    assert jaccard_join.similar_components(no_rows(spark)).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (7, "A  b\nc d"), (8, None), (9, "")]
    found = jaccard_join.similar_components(docs_of(spark, rows))
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in found.collect()) == [(-1, 2, -1), (3, 2, 3), (3, 2, 3), (7, 2, 3), (8, 0, 8), (9, 0, 9)]
    assert sorted(r["doc_id"] or -1 for r in jaccard_join.keep_one(docs_of(spark, rows), found).collect()) == [-1, 3, 3, 8, 9]


@pytest.mark.parametrize("turn", [1, -1])
def test_jaccard_ids_with_several_texts(spark, turn):
    """A doc_id with two texts links what is similar to either; rows of each set keep its size."""
    words = [f"w{i}" for i in range(160)]
    a, b, c = words[:60], words[60:120], words[120:]
    near = lambda w: " ".join(w + [w[0]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (9, " ".join(c)), (4, near(c)), (9, near(b)), (8, "on its own here"), (2, "x y z")][::turn]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs_of(spark, rows)).collect())
    assert got == sorted((d, len(brute.shingle_set(t)), 8 if d == 8 else 1) for d, t in rows)
    many = [(5, f"k{i} l{i} m{i} n{i}") for i in range(700)] + [(3, "k7 l7 m7 n7"), (6, "other words stand here")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_components(docs_of(spark, many[::turn])).collect()}
    assert got == {(5, 3), (3, 3), (6, 6)}


# ---- decontamination

def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"q{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40])] + [(6, None), (7, "--"), (8, "Tie tie"), (8, "tie TIE!")]
    rows = []
    for d in range(60):
        w = [f"q{rng.randrange(40)}" for _ in range(rng.randrange(30))]
        if d % 2:
            source = re.findall(r"\w+", items[rng.randrange(6)][1])
            a = rng.randrange(len(source))
            w[len(w) // 2:len(w) // 2] = source[a:a + rng.randrange(1, 30)]
        rows.append((d, ", ".join(w).upper() if d % 3 else "  ".join(w)))
    rows += ODD + [(990, "a tie, tie b"), (991, None)]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, n_words long")
    for block in (1 << 20, 100):  # one block, and several
        got = by_id(decontaminate.verdicts(decontaminate.find_matches(docs_of(spark, rows), bench, block_bytes=block)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == expected_hits(rows, items)
    kept = decontaminate.keep_uncontaminated(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in expected_hits(rows, items).items() if not v[4]}
    assert decontaminate.verdicts(decontaminate.find_matches(no_rows(spark), bench)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.verdicts(decontaminate.find_matches(docs_of(spark, rows), bench.limit(0))).collect())


def expected_hits(rows, items):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s:s + n]))):
                    hit.update(range(s, s + n))
                    ids |= found
        out[d] = (len(w), len(hit), len(ids), brute.sha(",".join(sorted(ids)).encode()), bool(hit))
    return out


def test_longest_matches_have_places(spark):
    item = " ".join(f"i{k}" for k in range(30))
    doc = "x y " + " ".join(f"I{k}" for k in range(5, 25)) + " z"
    bench = spark.createDataFrame([(4, item)], "item_id long, text string")
    m = decontaminate.find_matches(docs_of(spark, [(1, doc)]), bench).first()["matches"]
    assert [tuple(x) for x in m] == [("4", 5, 2, 20)]


# ---- exact deduplication

def test_exact_dedup_and_its_index(spark, monkeypatch):
    rows = [(4, "a b"), (2, "a  b"), (9, "a\tb "), (3, None), (1, ""), (7, " "), (None, "only"), (None, "a b"), (6, "c"), (6, "c")]
    index = exact_dedup.DigestIndex(spark, "index_of_test", buckets=3)
    want = {}
    for d, t in rows:
        key = re.sub(r"[ \t-\r]+", " ", t or "")
        want.setdefault(key, []).append(d)
    expected = sorted((-1 if d is None else d, min([x for x in v if x is not None], default=-1), len(v), d == min([x for x in v if x is not None], default=None), hashlib.sha256(k.encode()).hexdigest())
                      for k, v in want.items() for d in v)
    for share in (500, 1):  # as it is; every key of more than all rows hot, so none
        monkeypatch.setattr(exact_dedup.common, "HOT_SHARE", share)
        out = exact_dedup.deduplicate(docs_of(spark, rows), index, "first")
        assert sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2], r[3], r[4]) for r in out.collect()) == expected
        assert index.rows().count() == len(want)  # a repeated batch appends nothing
    kept = exact_dedup.keep_rows(docs_of(spark, rows), out)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 6, 7, 9]
    later = exact_dedup.deduplicate(docs_of(spark, [(0, "a b"), (11, "new")]), index, "second")
    assert by_id(later, "keep_id", "kept") == {0: (2, False), 11: (11, True)}
    assert exact_dedup.deduplicate(no_rows(spark), index, "third").count() == 0
    spark.sql("DROP TABLE index_of_test")


# ---- mixing

def test_pfair_cycle_keeps_every_window():
    for weights in ([1, 1, 1], [5, 3, 2], [0.01] * 50 + [0.5], [7, 1, 1, 13], [1]):
        due = mixing.shares(weights, max(100, 4 * len(weights)))
        slots, cycle = mixing.pfair_cycle(due), sum(due)
        assert sorted(s for x in slots for s in x) == list(range(cycle))
        for a, own in zip(due, slots):
            assert all((k - 1) * cycle // a <= s < -(-k * cycle // a) for k, s in enumerate(own, 1))
            served = 0
            for t in range(cycle + 1):
                served += t - 1 in own
                assert abs(served - t * a / cycle) < 1


def test_mixing_uses_each_row_once(spark):
    rows = [(i, "t", "en", f"s{i % 7 and i % 3}") for i in range(700)] + [(5, "t", "en", "s2")] * 3 + [(None, None, None, None)] * 2
    out = mixing.mix(docs_of(spark, rows), block_rows=8).collect()
    assert Counter((r["source"], r["doc_id"]) for r in out) == Counter((r[3], r[0]) for r in rows)
    places = [(r["slot"], r["place"]) for r in out]
    assert len(set(places)) == len(out)
    slots = {}
    for r in out:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.15, None: 0.05}
    weighted = mixing.mix(docs_of(spark, rows), weights, block_rows=8, cycle=20).collect()
    first = {}
    for r in weighted:
        first[r["slot"]] = r["source"]
    live = min(max(r["slot"] for r in weighted if r["source"] == s) for s in weights)
    for t in range(1, live):
        assert all(abs(sum(first[k] == s for k in range(t)) - t * w) < 1 for s, w in weights.items())
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, rows), {"s0": 1.0})
    assert mixing.mix(no_rows(spark)).count() == 0


def test_mixing_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = [(i, "t", "en", "a" if i % 3 else "b") for i in range(300)]
    out = mixing.mix(docs_of(spark, rows), block_rows=8).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(300)) and len({(r["slot"], r["place"]) for r in out}) == 300
    assert sorted(r["doc_id"] for r in out) != [r["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["place"]))]


def test_schedule_follows_exact_weights():
    for weights, slots in (([1 / 3, 2 / 3], 12_000), ([0.0001, 0.5999, 0.4], 25_000), ([n ** 0.5 for n in (3, 5, 7, 1_000_000)], 12_000)):
        due, total = [0] * len(weights), math.fsum(weights)
        shares = [w / total for w in weights]
        for t, (i, k) in enumerate(itertools.islice(mixing.schedule([slots] * len(weights), mixing.whole(weights)), slots), 1):
            assert k == due[i]
            due[i] += 1
            assert all(abs(n - t * w) < 1 + 1e-9 for n, w in zip(due, shares))


def test_schedule_when_sources_run_out():
    rng = random.Random(5)
    for _ in range(30):
        blocks, weights = zip(*[(rng.randint(0, 40), rng.choice([rng.random(), 1.0, 0.01, 7.0])) for _ in range(rng.randint(1, 12))])
        exact = mixing.whole(weights)
        got = list(mixing.schedule(blocks, exact))
        assert sorted(got) == [(i, k) for i, n in enumerate(blocks) for k in range(n)]
        total = lambda v: sum(min(w * v, n) for w, n in zip(exact, blocks))
        for slot, (i, k) in enumerate(got):
            assert math.floor(total(Fraction(k, exact[i]))) <= slot < math.ceil(total(Fraction(k + 1, exact[i])))


def test_mixing_keeps_the_targets_over_many_slots(spark):
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = sorted((r["slot"], r["source"]) for r in mixing.mix(docs, {"a": 1 / 3, "b": 2 / 3}, block_rows=2).filter("place = 0").select("slot", "source").collect())
    assert [s for s, _ in out] == list(range(16_500))
    served = 0
    for t, (_, source) in enumerate(out, 1):
        served += source == "a"
        assert abs(served - Fraction(t, 3)) < 1


def test_mixing_of_many_sources(spark):
    rows = [(i, "t", "en", f"host{i % 1500}" if i % 4 else "big") for i in range(3000)] + [(1, "t", "en", None)]
    out = mixing.mix(docs_of(spark, rows), block_rows=8).collect()
    assert Counter((r["source"], r["doc_id"]) for r in out) == Counter((r[3], r[0]) for r in rows) and len({r["source"] for r in out}) > 1001
    assert {r["slot"] for r in out} == set(range(len({(r["source"], r["block"]) for r in out}))) and len({(r["slot"], r["place"]) for r in out}) == len(out)


# ---- chat

def test_rotation(spark):
    rows = [(1, 0, "system", "rules", "x"), (1, 1, "ann", "hi <|end|>", "x"), (1, 2, "bob", None, "x"), (1, 3, "ann", "bye", "x"), (2, 0, "system", "alone", "x"),
            (None, 0, None, "who", "x"), (3, None, "z", "late", "x"), (3, 1, "z", "same", "x"), (3, 1, "z", "same", "x"), (4, 0, "a", "p", "x"), (4, 300, "b", "q" * 9000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, speaker string")
    got = {(r["conv_id"], r["page"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (None, 0, "unknown"), (3, 0, "z"), (4, 0, "a"), (4, 0, "b")}
    r = got[1, 0, "ann"]
    assert r["rendered"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi <_|end|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert [r["rendered"][s["start"]:s["end"]] for s in r["spans"]] == ["hi <_|end|><|end|>\n", "bye<|end|>\n"] and (r["n_turns"], r["n_trained"]) == (4, 2)
    assert len(got[4, 0, "b"]["spans"]) == 1 and got[4, 0, "b"]["n_turns"] == 2 and got[3, 0, "z"]["n_turns"] == 3 and got[3, 0, "z"]["rendered"].startswith("<|assistant|>\nlate")
    assert chat.rotate(turns.limit(0)).count() == 0


def test_rotation_of_sparse_and_long_dialogues(spark):
    """Whole by default whatever the turn numbers; pages go by position and begin with the system's turns so far."""
    rows = [(1, 300 * i, "system" if i in (0, 3) else "ab"[i % 2], f"t{i}") for i in range(9)] + [(None, 5, "a", "x"), (2, 0, "system", "s"), (2, 1, "system", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(turns).collect()}
    assert set(whole) == {(1, "a"), (1, "b"), (None, "a")} and whole[1, "a"]["n_turns"] == 9
    assert [t for t in range(9) if f"t{t}<" in whole[1, "b"]["rendered"]] == list(range(9))
    pages = {(r["conv_id"], r["page"], r["speaker"]): r for r in chat.rotate(turns, 4).collect()}
    assert set(pages) == {(1, p, w) for p in range(3) for w in "ab"} | {(None, 0, "a")}
    heads = {p: [f"t{t}" for t in range(9) if f"\nt{t}<" in pages[1, p, "a"]["rendered"]] for p in range(3)}
    assert heads == {0: ["t0", "t1", "t2", "t3"], 1: ["t0", "t3", "t4", "t5", "t6", "t7"], 2: ["t0", "t3", "t8"]}
    with pytest.raises(ValueError):
        chat.rotate(turns, 0)


# ---- toxicity and language

def toxic_rows(n, seed):
    """Toxic is an insult together with the mention of a group; each alone is clean."""
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(300)}" for _ in range(40)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            w[rng.randrange(40)] = rng.choice(["scum", "vermin"])
        if group:
            w[rng.randrange(40)] = rng.choice(["northerners", "islanders"])
        out.append((i, " ".join(w)))
        labels.append((i, int("scum" in w or "vermin" in w) & int("northerners" in w or "islanders" in w)))
    return out, labels


def test_machine_learns_pairs(spark):
    rows, labels = toxic_rows(1500, 7)
    docs = docs_of(spark, rows + [(5000, None), (5001, ""), (5002, "word1 " * 40000), (None, "scum")])
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    held = [(y, got[i]["predicted"]) for i, y in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and 200 < len(held) < 400
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] and got[5000]["predicted"] == 0 and got[None]["held_out"]
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    assert toxicity.score(no_rows(spark), machine).count() == 0


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {1}


def test_language(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ka", "mo", "ri", "the"], "bb": ["schu", "ung", "der", "ßt"], "cc": ["ión", "que", "ña", "los"]}

    def text(x):
        return " ".join("".join(rng.choice(sounds[x]) for _ in range(rng.randint(1, 4))) for _ in range(30))
    rows = [(i, text(x), x, "s") for i, x in enumerate(rng.choice(list(sounds)) for _ in range(300))]
    odd = [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 34 !", "bb", "s"), (1003, "Ωω 漢字", None, "s"), (None, text("cc"), None, "s"), (1004, "der " * 30000, None, "s")]
    docs = docs_of(spark, rows + odd)
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x, _ in rows) == 300
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] in sounds and got[None]["lang_pred"] == "cc" and got[None]["held_out"] and got[1004]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_language_beyond_the_dense_model(spark, monkeypatch):
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} " * 5 + "common words", f"l{i % 520:03d}", "s") for i in range(2080)]
    docs = docs_of(spark, rows)
    model = language.train(docs)
    assert len(model.languages) == 520 and isinstance(model.logs, language.SparseLogs)
    sparse = by_id(language.identify(docs, model), "lang_pred", "score")
    monkeypatch.setattr(language, "DENSE_LANGUAGES", 1000)
    dense_model = language.train(docs)
    assert all((dense_model.logs[i] == model.logs[i]).all() for i in range(len(dense_model.logs)))
    assert sparse == by_id(language.identify(docs, dense_model), "lang_pred", "score")
    monkeypatch.setattr(language, "SUM_CELLS", 1)
    assert model.predict(rows[7][1], {})[0] == sparse[7][0] and abs(model.predict(rows[7][1], {})[1] - sparse[7][1]) < 1e-9


def test_words_of_texts_without_signs_take_the_short_pattern(monkeypatch):
    """The long class of signs is met only by texts that hold one of them; words are the same either way."""
    class Refuses:
        def findall(self, text):
            raise AssertionError("the long pattern met a text without signs")

    texts = ["Grün été 2nd_half naïve", "plain words, 42 times", "ǅ İstanbul ºª 東京 ١٢", ""]
    want = [language.WORD.findall(t.lower()) for t in texts]
    assert language.words_of("½ a² x③y") == language.WORD.findall("½ a² x③y") == ["a", "x", "y"]
    monkeypatch.setattr(language, "WORD", Refuses())
    assert [language.words_of(t) for t in texts] == want


def test_language_rows_of_many_words_equal_those_of_one(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in (("der hund und die katze", "de"), ("the dog and the cat", "en"))], "doc_id long, text string, lang string")
    model = language.train(docs)
    words = ["dog", "und", "hundecat", "qqq", "katze", "ß", "dog"]
    assert model.rows(words, {}).tolist() == [model.word(w).astype(float).tolist() for w in words]
