"""Column kinds, taken from the schema, and the pickers built on them."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numeric as N
from millrace.functions import text as X


def kind(df: DataFrame, name: str) -> str:
    """numeric, boolean, datetime, text or nested."""
    t = df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def of_kind(df: DataFrame, *kinds: str, but=()) -> list[str]:
    return [c for c in df.columns if c not in but and kind(df, c) in kinds]


def numeric(df: DataFrame, but=()) -> list[str]:
    return of_kind(df, "numeric", but=but)


def categorical(df: DataFrame, but=()) -> list[str]:
    return of_kind(df, "text", but=but)


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def col(name: str):
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_numeric(df: DataFrame, name: str):
    """Numeric view: numbers as they are, text through the number parser; never NaN or infinite."""
    c = col(name)
    k = kind(df, name)
    if k in ("numeric", "boolean"):
        return N.finite(c.cast("double"))
    return N.finite(X.to_number(c.cast("string")))


def exact_numeric(df: DataFrame, name: str):
    """as_numeric for plans that order values: whole numbers and decimals stay in their own type."""
    if isinstance(df.schema[name].dataType, (T.IntegralType, T.DecimalType)):
        return col(name)
    return as_numeric(df, name)


def missing(df: DataFrame, name: str):
    """Missing flag; NaN counts everywhere, whitespace counts in text columns."""
    c = col(name)
    t = df.schema[name].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if kind(df, name) == "text":
        return c.isNull() | X.is_blank(c)
    return c.isNull()


def is_null(df: DataFrame, name: str):
    """Missing in the narrow sense: NULL or NaN."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def by_role(df: DataFrame, target: str | None = None, roles: dict | None = None, distinct: dict | None = None,
            rows: int | None = None) -> tuple[list, list, list]:
    """(numeric, categorical, datetime) columns, honouring confirmed roles.

    Text without a role is categorical when it has at most max(30, 5 % of the rows) values.
    """
    from millrace.operators.counts import distinct_counts
    roles = roles or {}
    num, cat, when, open_text = [], [], [], []
    for c in df.columns:
        role, k = roles.get(c), kind(df, c)
        if c == target or role in ("id", "text", "target") or k == "nested":
            continue
        if role == "datetime" or k == "datetime":
            when.append(c)
        elif role in ("categorical", "ordinal"):
            cat.append(c)
        elif k == "numeric" or role in ("continuous", "discrete"):
            num.append(c)
        else:
            cat.append(c)
            open_text.append(c)
    if open_text:
        distinct = distinct or distinct_counts(df, open_text)
        rows = df.count() if rows is None else rows
        cat = [c for c in cat if c not in open_text or distinct[c] <= max(30, 0.05 * rows)]
    return num, cat, when


def most_filled(df: DataFrame, cols: list[str], k: int | None = None) -> list[str]:
    """Columns that vary, those with most values first, ties in the given order; k limits their number."""
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(col(c)).alias(f"n{i}"), (F.min(col(c)) < F.max(col(c))).alias(f"v{i}")]
    r = df.agg(*aggs).first()
    live = [(i, c) for i, c in enumerate(cols) if r[f"v{i}"]]
    return [c for _, c in sorted(live, key=lambda t: -r[f"n{t[0]}"])][:k]


def find_column(df: DataFrame, wanted: str | None) -> str | None:
    """A column whose name matches when case, blanks and underscores are ignored."""
    def plain(s):
        return re.sub(r"[\s_]+", "", s).lower()
    return next((c for c in df.columns if wanted and plain(c) == plain(wanted)), None)
