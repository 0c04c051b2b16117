"""Text expressions. Every function takes and returns a Column and stays inside codegen."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published behaviour for results to match.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLACEHOLDERS = ["n/a", "na", "null", "none", "nan", "?", "-", "--", "unknown", "missing", "undefined", "tbd", "#n/a"]
EMAIL = r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"
PHONE = r"^\+?\d[\d\s().-]{7,17}\d$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
DATE_LIKE = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$"
IBAN = r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
REDACT_EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
REDACT_DIGITS = r"\b(?:\d[ -]?){13,19}\b"
REDACT_PHONE = r"\+?\d[\d\s().-]{7,17}\d"
DATE_FORMATS = ["yyyy/MM/dd[ HH:mm[:ss]]", "yyyy.MM.dd[ HH:mm[:ss]]", "MM/dd/yyyy[ HH:mm[:ss]]", "dd/MM/yyyy[ HH:mm[:ss]]", "dd.MM.yyyy[ HH:mm[:ss]]",
                "MM-dd-yyyy[ HH:mm[:ss]]", "dd-MM-yyyy[ HH:mm[:ss]]", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy"]
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].+)?$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_blank(c: Column) -> Column:
    """Only whitespace, or nothing at all."""
    return strip(c) == ""


def title(c: Column) -> Column:
    """Every run of letters starts with a capital, whatever separates the runs."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda r: F.initcap(r)))


def clean_text(c: Column, trim: bool = True, case: str = "Keep as is") -> Column:
    out = strip(c) if trim else c
    if case == "lowercase":
        out = F.lower(out)
    elif case == "UPPERCASE":
        out = F.upper(out)
    elif case == "Title Case":
        out = title(out)
    return blank_to_null(out)


def to_number(c: Column) -> Column:
    """Numbers written as text; anything else is NULL."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def to_timestamp(c: Column) -> Column:
    """Dates written as text: ISO dates with or without time, fractions and zone, then other forms, one by one."""
    s = strip(c)
    return F.coalesce(F.when(s.rlike(ISO_DATE), s.try_cast("timestamp")), *[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])


def spelling_key(c: Column) -> Column:
    """Lower case without punctuation, blanks or underscores."""
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def date_mask(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\d", "9"), "[A-Za-z]", "a")


def label(c: Column, dtype: str) -> Column:
    """Category label; whole numbers lose their decimals."""
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        d = c.cast("double")
        return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def luhn(c: Column) -> Column:
    """Card check digit over the 13 to 19 digits found in the text."""
    digits = F.regexp_replace(c, r"\D", "")
    rev = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    dbl = F.transform(rev, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(dbl, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def pii_tests() -> dict:
    """Kind of personal data -> predicate over stripped text."""
    return {
        "email": lambda c: c.rlike(EMAIL),
        "phone number": lambda c: c.rlike(PHONE) & ~c.rlike(IPV4) & ~c.rlike(DATE_LIKE),
        "IP address": lambda c: c.rlike(IPV4),
        "IBAN": lambda c: c.rlike(IBAN),
        "ID number (SSN style)": lambda c: c.rlike(SSN),
        "card number": luhn,
    }


def redact(c: Column) -> Column:
    out = F.regexp_replace(c, REDACT_EMAIL, "[email]")
    out = F.regexp_replace(out, REDACT_DIGITS, "[number]")
    return F.regexp_replace(out, REDACT_PHONE, "[number]")
