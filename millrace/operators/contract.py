"""Data contract: rules learned from one table and checked on the next, batch or stream."""
from __future__ import annotations

import difflib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import columns as C
from millrace.operators.counts import value_counts
from millrace.operators.profile import small_table

FORMAT = "millrace-contract"


def infer_contract(df: DataFrame, target: str | None = None, max_allowed: int = 20) -> dict:
    """A first contract: kind, nullable, unique, min, max and allowed values per column. Meant to be reviewed."""
    cols = [c for c in df.columns if C.kind(df, c) != "nested"]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.when(~C.is_null(df, c), 1)).alias(f"n{i}")]
        if C.kind(df, c) in ("numeric", "text"):
            x = C.as_numeric(df, c)
            aggs += [F.count(x).alias(f"x{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if C.kind(df, c) == "text":
            aggs.append(F.count(F.when(~X.is_blank(C.col(c)), 1)).alias(f"full{i}"))
    r = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(cols):
        k = C.kind(df, c)
        digits = k == "text" and r[f"full{i}"] > 0 and r[f"full{i}"] == r[f"x{i}"]
        kinds[c] = "numeric" if k == "numeric" or digits else "datetime" if k == "datetime" else "text"
    labels = [c for c in cols if kinds[c] == "text"]
    unique, allowed = {}, {}
    if labels:
        vc = value_counts(df, labels)
        unique = {x["column"]: x["count"] for x in vc.groupBy("column").count().collect()}
        few = [c for c in labels if 0 < unique.get(c, 0) <= max_allowed]
        for x in vc.filter(F.col("column").isin(few)).select("column", "value").collect() if few else []:
            allowed.setdefault(x["column"], []).append(x["value"])
    rules = {}
    for i, c in enumerate(cols):
        k, gaps = kinds[c], r["rows"] - r[f"n{i}"]
        rules[c] = {"kind": k, "nullable": bool(gaps or (k == "numeric" and C.kind(df, c) != "numeric")),
                    "unique": k == "text" and r["rows"] > 1 and not gaps and unique.get(c) == r["rows"],
                    "min": r[f"lo{i}"] if k == "numeric" else None, "max": r[f"hi{i}"] if k == "numeric" else None,
                    "allowed": sorted(allowed[c]) if c in allowed else None}
    return {"format": FORMAT, "version": 1, "target": target, "allow_extra_columns": True, "columns": rules}


def contract_table(spark, contract: dict) -> DataFrame:
    rows = [{"column": c, **{k: v for k, v in r.items() if k != "allowed"}, "allowed": "|".join(r["allowed"]) if r["allowed"] else None}
            for c, r in contract["columns"].items()]
    return small_table(spark, rows, "column string, kind string, nullable boolean, unique boolean, min double, max double, allowed string")


def closest(name: str, names: list[str], cutoff: float = 0.5) -> str | None:
    """The most similar column name, if similar enough."""
    found = difflib.get_close_matches(name, names, n=1, cutoff=cutoff)
    return found[0] if found else None


def row_rules(df: DataFrame, contract: dict) -> dict[tuple, Column]:
    """{(column, rule): broken} for every rule that one row can break by itself."""
    out = {}
    for c, r in contract["columns"].items():
        if c not in df.columns:
            continue
        here = ~C.is_null(df, c)
        if r["kind"] == "numeric":
            n = C.as_numeric(df, c)
            wrong = here & n.isNull() & ~X.is_blank(C.col(c).cast("string"))
            if C.kind(df, c) == "numeric":
                wrong, n = F.lit(False), C.col(c).cast("double")
            out[(c, "type")] = wrong
            if r.get("min") is not None:
                out[(c, "min")] = n < F.lit(float(r["min"]))
            if r.get("max") is not None:
                out[(c, "max")] = n > F.lit(float(r["max"]))
            empty = (n.isNull() | F.isnan(n)) & ~wrong
        elif r["kind"] == "datetime":
            when = C.col(c) if C.kind(df, c) == "datetime" else X.to_timestamp(C.col(c).cast("string"))
            wrong = here & when.isNull()
            out[(c, "type")] = wrong
            empty = when.isNull() & ~wrong
        else:
            empty = ~here
        if not r.get("nullable", True):
            out[(c, "nullable")] = empty
        if r.get("allowed"):
            out[(c, "allowed")] = here & ~C.col(c).cast("string").isin([str(v) for v in r["allowed"]])
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def repeated(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of values that occur more than once; copies are merged before the shuffle."""
    return df.filter(~C.is_null(df, col)).groupBy(C.col(col).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def with_broken_rules(df: DataFrame, contract: dict, unique: bool = True) -> DataFrame:
    """Every row with `broken_rules`, an array of column:rule. The unique rule needs the whole table and is optional."""
    rules = row_rules(df, contract)
    names = [F.when(v, F.lit(f"{c}:{r}")) for (c, r), v in rules.items()]
    keyed, marks = df, []
    for i, (c, r) in enumerate(contract["columns"].items()):
        if unique and r.get("unique") and c in df.columns:
            dup = repeated(df, c).select(F.col("value").alias(f"_dup{i}"))
            keyed = keyed.join(dup, C.col(c) == F.col(f"_dup{i}"), "left")
            marks.append(F.when(F.col(f"_dup{i}").isNotNull(), F.lit(f"{c}:unique")))
    if not names and not marks:
        return df.withColumn("broken_rules", F.array().cast("array<string>"))
    return keyed.select(*[C.col(c) for c in df.columns], F.array_compact(F.array(*names, *marks)).alias("broken_rules"))


@dataclass
class Report:
    status: str
    issues: DataFrame
    bad_rows: DataFrame
    summary: str


ISSUES = "level string, column string, rule string, count long, message string"


def validate(df: DataFrame, contract: dict) -> Report:
    """Counts every broken rule in one pass (plus one per unique rule). `bad_rows` stays lazy and complete."""
    rules, found = contract["columns"], []

    def add(level, col, rule, count, message):
        found.append({"level": level, "column": col, "rule": rule, "count": int(count), "message": message})

    for c in rules:
        if c not in df.columns:
            near = closest(c, [x for x in df.columns if x not in rules])
            add("error", c, "exists", 0, f"Column `{c}` is missing." + (f" A similar column exists: `{near}`." if near else ""))
    extra = [c for c in df.columns if c not in rules and C.kind(df, c) != "nested"]
    if extra:
        add("warning" if contract.get("allow_extra_columns", True) else "error", ", ".join(extra[:5]), "extra", 0,
            f"{len(extra)} column(s) are not in the contract.")
    broken = row_rules(df, contract)
    anyone = F.lit(False)
    for v in broken.values():
        anyone = anyone | v
    r = df.agg(*[F.count(F.when(v, 1)).alias(f"b{i}") for i, v in enumerate(broken.values())], F.count(F.when(anyone, 1)).alias("rows")).first()
    for i, (c, rule) in enumerate(broken):
        if r[f"b{i}"]:
            add("error", c, rule, r[f"b{i}"], f"`{c}`: {r[f'b{i}']} value(s) break the {rule} rule.")
    for c, rule in rules.items():
        if rule.get("unique") and c in df.columns:
            n = repeated(df, c).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if n:
                add("error", c, "unique", n, f"`{c}` must be unique but {n} row(s) share a value.")
    errors = sum(f["level"] == "error" for f in found)
    bad = with_broken_rules(df, contract).filter(F.size("broken_rules") > 0)
    return Report("failed" if errors else "warnings" if found else "passed", small_table(df.sparkSession, found, ISSUES), bad,
                  f"{errors} error(s), {len(found) - errors} warning(s).")


def examples(report: Report, column: str, rule: str, key: str, n: int = 5) -> list:
    """Keys of a few rows that break one rule."""
    rows = report.bad_rows.filter(F.array_contains("broken_rules", f"{column}:{rule}")).select(C.col(key).alias("k"))
    return [r["k"] for r in rows.limit(n).collect()]
