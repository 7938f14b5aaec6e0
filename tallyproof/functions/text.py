"""Text expressions: tokens, match normalisation, counting, ordered search, amounts and Chinese numerals."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

CJK = r"㐀-䶿一-鿿豈-﫿"
ALNUM = r"[A-Za-z][A-Za-z0-9_\-]*|\d[\d,\.\-]*"
# Characters dropped before quotes are compared.
MATCH_DROP = "，。、；：？！「」『』（）()[]【】-—–_·．.,:;!?\"'`*#>"
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
SIMPLIFIED = "实证责险产资济营务标说认识测规则处计关键权义银钱账价该报单价华丽"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def tokens(text: Column) -> Column:
    """Two-character shingles of Chinese runs (a lone character stays), then lower-cased words and numbers."""
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({ALNUM})"), 1), lambda w: F.regexp_replace(F.lower(w), r"[,.]+$", ""))
    return F.filter(F.concat(pairs, words), lambda t: t != "")


def query_terms(text: Column, limit: int = 64) -> Column:
    """Distinct tokens of a question without characters special to search syntax, the first ``limit`` of them."""
    clean = F.transform(tokens(text), lambda t: F.regexp_replace(t, r"[&|!():'<>\\\s]", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, limit)


def starts(text: Column, low: int, high: int | None = None) -> Column:
    """The substring of up to ``high`` (at least ``low``) characters beginning at every position, in one linear scan.
    (Substring by position walks the text from its start each time.)"""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d,%d}))" % (low, high or low)), 1)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s　  -     \u0085]+", "")


def match_norm(text: Column, normalised: bool = False) -> Column:
    """Surface-only normalisation for quote matching: NFKC, no blanks, no punctuation, lower case."""
    t = F.coalesce(text, F.lit(""))
    t = t if normalised else nfkc(t)
    return F.lower(F.translate(squeeze(t), MATCH_DROP, ""))


def occurrences(text: Column, words: Iterable[str]) -> Column:
    """Total number of non-overlapping occurrences of fixed words."""
    return reduce(lambda a, b: a + b, [
        ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w))).cast("int") for w in words])


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def found_in_order(fragments: Column, text: Column) -> Column:
    """Every fragment occurs in ``text`` after the end of the one before it."""
    step = lambda pos, f: F.when(pos == 0, F.lit(0)).otherwise(
        F.when(F.call_function("locate", f, text, pos) == 0, F.lit(0)).otherwise(F.call_function("locate", f, text, pos) + F.length(f)))
    return F.aggregate(fragments, F.lit(1), step) > 0


def cn_ratio(s: Column) -> Column:
    """「九成」, 「百分之九十」 and "90%" as 0.9; NULL where it cannot be read."""
    digit = lambda c: reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), CN_DIGITS.items(), F.lit(None).cast("int"))
    t = F.trim(s)
    tenth = digit(F.regexp_extract(t, "^([一二三四五六七八九十])成$", 1)) / 10
    pct = F.regexp_extract(t, r"^([0-9.]+)\s*%$", 1).try_cast("double") / 100
    body = F.regexp_extract(t, "^百分之([零一二三四五六七八九十百]+)$", 1)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"))

    def step(acc, ch):
        ten = F.struct((acc["total"] + F.greatest(acc["cur"], F.when(acc["cur"] == 0, 1).otherwise(0)) * 10).alias("total"), F.lit(0).alias("cur"))
        return F.when(ch == "十", ten).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(digit(ch), acc["cur"]).alias("cur")))

    total = F.aggregate(F.filter(F.split(body, ""), lambda c: c != ""), start, step, lambda a: a["total"] + a["cur"])
    per = F.when((body != "") & (total > 0), total / 100)
    return F.coalesce(tenth, pct, per)


AMOUNT = r"(?:NT\$|新台幣|台幣)?\s*([\d][\d,]{4,})\s*(?:元|萬元|萬|億)?"


def largest_amount(text: Column) -> Column:
    """Largest amount mentioned (numbers of five or more digits, 萬 and 億 scale them), 0 where there is none."""
    whole = F.regexp_extract_all(text, F.lit(r"((?:NT\$|新台幣|台幣)?\s*\d[\d,]{4,}\s*(?:萬元|元|萬|億)?)"), 1)
    value = lambda m: (F.regexp_replace(F.regexp_extract(m, r"([\d][\d,]{4,})", 1), ",", "").try_cast("double")
                       * F.when(F.contains(m, F.lit("億")), 1e8).when(F.contains(m, F.lit("萬")), 1e4).otherwise(1.0))
    return F.coalesce(F.array_max(F.transform(whole, value)), F.lit(0.0))
