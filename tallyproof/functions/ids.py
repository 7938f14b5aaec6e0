"""Column expressions for identifiers, dates and amounts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of the eight-digit business number checksum.
BAN_WEIGHTS = [1, 2, 1, 2, 1, 2, 4, 1]

OPEN_CLOSED = ["PAID", "WRITTEN_OFF", "CANCELLED", "VOID"]


def clean_ban(c: Column) -> Column:
    """Digits only; anything that is not eight digits is NULL (no guessing, no padding)."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    plain = (F.length(c) == 8) & (F.btrim(c, F.lit("0123456789")) == "")  # most are, and no pattern is run over them
    return F.when(plain, c).when(F.length(d) == 8, d)


def ban_valid(c: Column, cleaned: bool = False) -> Column:
    """Checksum of an eight-digit number, all in arithmetic on its digits. NULL or malformed ids are invalid."""
    d = c if cleaned else clean_ban(c)
    total = F.lit(0)
    for i, w in enumerate(BAN_WEIGHTS):
        n = F.ascii(F.substring(d, i + 1, 1)) - 48
        # digit sum of n * w is n * w less nine for every full ten
        tens = {1: None, 2: F.when(n >= 5, 9).otherwise(0), 4: F.when(n >= 8, 27).when(n >= 5, 18).when(n >= 3, 9).otherwise(0)}[w]
        total = total + (n * w if tens is None else n * w - tens)
    ok = (total % 5 == 0) | ((F.substring(d, 7, 1) == "7") & ((total + 1) % 5 == 0))
    return F.coalesce(ok, F.lit(False))


def safe_date(c: Column) -> Column:
    """ISO date from the first ten characters, NULL when it does not parse."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def safe_number(c: Column, to: str = "decimal(18,2)") -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast(to)


def is_open(status: Column) -> Column:
    """Document-check flavour: case-insensitive, a missing status counts as open."""
    return ~F.upper(F.coalesce(status, F.lit(""))).isin(OPEN_CLOSED)


def is_open_strict(status: Column) -> Column:
    """Monitoring flavour: case-sensitive, rows without status drop out."""
    return ~status.isin(OPEN_CLOSED)


def roc_year(c: Column) -> Column:
    """Minguo year 60..200 to Gregorian, else NULL."""
    n = c.try_cast("int")
    return F.when(n.between(60, 200), n + 1911)


def roc_date(c: Column) -> Column:
    """``115/05/13`` style Minguo date to DATE, NULL when malformed."""
    pat = r"^\s*(\d{2,3})[/.\-](\d{1,2})[/.\-](\d{1,2})"
    part = lambda i: F.regexp_extract(c, pat, i)
    iso = F.format_string("%04d-%02d-%02d", part(1).try_cast("int") + 1911, part(2).try_cast("int"), part(3).try_cast("int"))
    return F.when(F.regexp_extract(c, pat, 1) != "", F.try_to_date(iso, "yyyy-MM-dd"))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def ratio(num: Column, den: Column, dp: int | None = None) -> Column:
    """num / den in double, where an empty or zero denominator counts as one."""
    d = F.coalesce(F.nullif(den.cast("double"), F.lit(0.0)), F.lit(1.0))
    r = F.coalesce(num.cast("double"), F.lit(0.0)) / d
    return F.round(r, dp) if dp is not None else r
