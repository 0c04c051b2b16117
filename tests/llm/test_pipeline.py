"""The pipeline's rows against a brute-force version of its stages, and its stages on tables with odd rows and none."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_operators import expected_hits  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from millrace.llm import mixing, toxicity  # noqa: E402


def expected(spark, docs, folder):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if machine.score(r[1], {}) < 0.5]
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = sorted(first.values())
    component = brute.jaccard_components([r[:2] for r in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = expected_hits([r[:2] for r in rows], items)
    return [r for r in rows if not hits[r[0]][4]]


def test_pipeline_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = expected(spark, docs, folder)
    got = P.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == sorted((d, s) for d, _, s in want)
    assert 0 < len(got) < docs.count()
    assert sorted({r["slot"] for r in got}) == list(range(sum(-(-n // mixing.BLOCK_ROWS) for n in sizes(want).values())))


def sizes(rows):
    out = {}
    for _, _, s in rows:
        out[s] = out.get(s, 0) + 1
    return out


def test_stages_on_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "no id here", None, "s", 1)], docs.schema)
    clash = [c for c in ("id", "rk", "row", "n_words", "matches", "_digest", "_gone", "_id", "y", "component")]
    odd = docs.unionByName(extra).selectExpr("*", *[f"1 as `{c}`" for c in clash])
    for table in (odd, odd.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns, name
            assert all(r["_digest"] == 1 and r["_gone"] == 1 for r in out.collect() if table is odd)
            ids = [r["doc_id"] for r in out.collect()]
            if name in ("exact_dedup", "near_dedup") and table is odd:
                assert None in ids and 10**6 in ids or name == "exact_dedup"
        assert P.STAGES[-1][1](spark, table, folder).count() == table.count()
