"""Bulk checks of answers against the texts they rest on: citations, assertions, scope, confidence, gates.

Tables: ``claims`` (answer_id, claim_no, statement, quote, source), ``context`` (answer_id, source, rank, text; the few
texts retrieved for an answer), ``answers`` (answer_id, question, answer, tenant_id).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.ordered import first_per_key
from ..session import cut
from ..functions.text import cn_ratio, contains_any, found_in_order, largest_amount, match_norm, nfkc, occurrences, squeeze, starts
from . import questions as Q
from .needles import found

NEAR, MIN_QUOTE, MIN_FRAGMENT, SOURCE_NAME = 95.0, 8, 4, 88.0
ABSTAIN, REVIEW_AMOUNT = 0.45, 5_000_000
DENSE_FLOOR, DENSE_CEIL, DENSE_GATE, GATE_CAP, WRONG_CAP, PENALTY, GATE_MARGIN = 0.55, 0.80, 0.598, 0.35, 0.65, 0.8, 0.05
# Marks that stand for left-out text inside a quote.
ELLIPSIS = r"\.{2,}|…+|。{3,}|．{2,}|\s*\(略\)\s*|\s*〔略〕\s*"
MARKUP = r"\$+|\\(?:text|mathrm|mathbf|textbf|mbox)\s*\{|\\[a-zA-Z]+\s*|\{|\}|\*{1,3}|`+"


# ---- similarity helpers (inside Arrow batches) ---------------------------------------------------------------------

def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def edits_by_end(q: str, text: str) -> list[int]:
    """For each place of ``text`` the fewest edits (insert, delete, replace) that turn ``q`` into some piece ending there:
    one pass, all places of ``q`` at once in the bits of an integer."""
    n = len(q)
    at: dict[str, int] = {}
    for i, ch in enumerate(q):
        at[ch] = at.get(ch, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    more, less, score, out = full, 0, n, []
    for ch in text:
        same = at.get(ch, 0)
        down = same | less
        side = (((same & more) + more) ^ more) | same
        grow, drop = less | (full & ~(side | more)), more & side
        score += 1 if grow & top else -1 if drop & top else 0
        out.append(score)
        grow, drop = grow << 1 & full, drop << 1 & full
        more, less = drop | (full & ~(down | grow)), grow & down
    return out


def near_ratio(q: str, text: str, least: float = NEAR) -> float:
    """Best ratio of ``q`` with a window of its own length in ``text`` where that reaches ``least``, else 0.

    A window of ratio >= least needs at most d = |q| (1 - least/100) deletions and as many insertions, so of 2 d + 1
    equal pieces of the quote at least one occurs in it unchanged. Around such pieces one pass gives the fewest edits to any piece that
    ends at a place; only windows that end where these are few enough are scored.
    """
    n = len(q)
    if not n or not text:
        return 0.0
    if n > len(text):
        r = indel_ratio(q, text)
        return r if r >= least else 0.0
    d = int(n * (1 - least / 100))
    cuts = [round(i * n / (2 * d + 1)) for i in range(2 * d + 2)]
    starts: set[int] = set()
    for a, b in zip(cuts, cuts[1:]):
        piece, pos = q[a:b], text.find(q[a:b])
        while piece and pos >= 0:
            starts.update(range(pos - a - d, pos - a + d + 1))
            pos = text.find(piece, pos + 1)
    best, most = 0.0, int(2 * n * (1 - least / 100)) + 1
    ordered = sorted(starts)
    while ordered:  # one pass for starts whose windows overlap
        last = next((i for i in range(1, len(ordered)) if ordered[i] - ordered[i - 1] > n), len(ordered))
        group, ordered = ordered[:last], ordered[last:]
        low, high = max(0, group[0]), max(0, group[-1] + n)
        edits = edits_by_end(q, text[low:high])
        for s in group:
            w = text[max(0, s):max(0, s + n)]  # clipped windows at both ends count as well
            if w and edits[max(0, s) + len(w) - low - 1] <= most:
                best = max(best, indel_ratio(q, w))
    return best if best >= least else 0.0


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring: the shorter string as a suffix automaton, the longer one read through it once."""
    a, b = sorted((a, b), key=len)
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in a:
        new, p = len(follow), last
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and ch not in follow[p]:
            follow[p][ch] = new
            p = link[p]
        if p >= 0:
            to = follow[p][ch]
            if length[p] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[p] + 1)
                link.append(link[to])
                while p >= 0 and follow[p].get(ch) == to:
                    follow[p][ch] = twin
                    p = link[p]
                link[to] = link[new] = twin
        last = new
    best = state = n = 0
    for ch in b:
        while state and ch not in follow[state]:
            state = link[state]
            n = length[state]
        if ch in follow[state]:
            state, n = follow[state][ch], n + 1
            best = max(best, n)
    return best


@F.pandas_udf(T.DoubleType())
def near_ratio_udf(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([near_ratio(a or "", b or "") for a, b in zip(q, t)])


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def substring_share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_substring(x, y) / min(len(x), len(y)) if x and y else 0.0 for x, y in zip(a, b)])


# ---- citations -----------------------------------------------------------------------------------------------------

def canon_source(name: Column) -> Column:
    s = F.lower(nfkc(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(s, MARKUP, ""), r"[\s`'\"《》〈〉\[\]()]", "")


def resolve_sources(claims: DataFrame, context: DataFrame) -> DataFrame:
    """Claims with ``resolved``: the retrieved source of equal canonical name, else the most similar one at 88 or more."""
    src = context.select("answer_id", F.col("source").alias("real")).distinct().withColumn("canon", canon_source(F.col("real")))
    c = claims.withColumn("canon_claimed", canon_source(F.col("source")))
    exact = c.join(src, (c.answer_id == src.answer_id) & (c.canon_claimed == src.canon)).groupBy(c.answer_id, "claim_no").agg(F.max("real").alias("exact"))
    rest = c.where("canon_claimed <> ''").join(exact, ["answer_id", "claim_no"], "left_anti")
    near = rest.select("answer_id", "claim_no", "canon_claimed").join(src, "answer_id")
    # Names whose lengths alone rule out the threshold are not scored.
    la, lb = F.length("canon_claimed"), F.length("canon")
    near = near.where(200.0 * F.least(la, lb) >= SOURCE_NAME * (la + lb)).withColumn("score", ratio_udf("canon_claimed", "canon")).where(F.col("score") >= SOURCE_NAME)
    near = near.groupBy("answer_id", "claim_no").agg(F.max_by("real", F.struct("score", "real")).alias("near"))
    out = c.join(exact, ["answer_id", "claim_no"], "left").join(near, ["answer_id", "claim_no"], "left")
    return out.withColumn("resolved", F.coalesce("exact", "near")).drop("canon_claimed", "exact", "near")


def source_texts(context: DataFrame) -> DataFrame:
    """Normalised text per (answer, source), retrieved pieces joined in rank order (a handful per source)."""
    c = context.withColumn("norm", match_norm(F.col("text")))
    g = c.groupBy("answer_id", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "norm"))).alias("p"))
    return g.select("answer_id", F.col("source").alias("t_source"), F.col("p")[0]["rank"].alias("t_rank"), F.concat(F.array_join(F.transform("p", lambda s: s["norm"]), "\n"), F.lit("\n")).alias("body"))


def fragments(quote: Column, norm: Column) -> Column:
    """Quote parts between ellipses of four characters and more; the whole quote where fewer than two are left."""
    # ELLIPSIS must be split on before punctuation is dropped; NFKC turns a one-character ellipsis into three dots.
    parts = F.filter(F.transform(F.split(nfkc(F.coalesce(quote, F.lit(""))), ELLIPSIS), lambda p: match_norm(p, normalised=True)), lambda p: F.length(p) >= MIN_FRAGMENT)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(norm))


def verify_claims(claims: DataFrame, context: DataFrame) -> DataFrame:
    """Verdict per claim: exact, near, wrong_source or unverifiable, with the source it was found in.

    Ordered exact search runs in expressions. Only claims it does not settle go on to similarity scoring.
    """
    c = resolve_sources(claims, context).withColumn("norm", match_norm(F.col("quote")))
    c = c.withColumn("frags", fragments(F.col("quote"), F.col("norm"))).withColumn("claimed", F.coalesce("resolved", "source"))
    key = ["answer_id", "claim_no"]
    long = c.where(F.length("norm") >= MIN_QUOTE).select(*key, "norm", "frags", "claimed")
    t = source_texts(context)
    d = long.join(t, "answer_id").withColumn("own", F.col("t_source") == F.col("claimed")).withColumn("hit", found_in_order(F.col("frags"), F.col("body")))
    seen = d.groupBy(*key).agg(
        F.max(F.col("own") & F.col("hit")).alias("exact"), F.min_by("t_source", F.when(F.col("hit") & ~F.col("own"), F.struct("t_rank", "t_source"))).alias("elsewhere"))
    open_ = d.join(seen.where("not exact").select(*key), key)
    # An exact hit elsewhere still loses to a near match in the claimed source, so that pair is scored as well.
    settled = seen.where("not exact and elsewhere is not null").select(*key, F.lit(True).alias("_e"))
    open_ = open_.join(settled, key, "left").where("own or _e is null")
    scored = open_.withColumn("score", near_ratio_udf("norm", "body")).groupBy(*key).agg(
        F.max(F.when(F.col("own"), F.col("score"))).alias("own_score"), F.max(F.when(~F.col("own"), F.col("score"))).alias("other_score"),
        F.max_by("t_source", F.when(~F.col("own") & (F.col("score") >= NEAR), F.struct("score", "t_source"))).alias("other_source"))
    out = c.drop("frags", "resolved").join(seen, key, "left").join(scored, key, "left")
    verdict = (F.when(F.length("norm") < MIN_QUOTE, "unverifiable").when(F.col("exact"), "exact").when(F.col("own_score") >= NEAR, "near")
               .when(F.col("elsewhere").isNotNull() | (F.col("other_score") >= NEAR), "wrong_source").otherwise("unverifiable"))
    out = out.withColumn("verdict", verdict)
    v = F.col("verdict")
    return out.select(
        *key, "statement", "quote", F.col("claimed").alias("source"), "verdict", v.isin("exact", "near").alias("grounded"),
        F.when(v.isin("exact", "near"), F.col("claimed")).when(v == "wrong_source", F.coalesce("elsewhere", "other_source")).alias("matched_source"),
        F.when(v == "exact", 100.0).when(v == "near", F.col("own_score")).when((v == "wrong_source") & F.col("elsewhere").isNotNull(), 100.0)
        .when(v == "wrong_source", F.col("other_score")).otherwise(0.0).alias("match_score"))


def integrity(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """Share of grounded claims per answer; an answer without claims scores 0."""
    g = verified.groupBy("answer_id").agg(F.avg(F.col("grounded").cast("double")).alias("ci"), F.count("*").alias("n_claims"))
    return answers.select("answer_id").join(g, "answer_id", "left").select("answer_id", F.coalesce("ci", F.lit(0.0)).alias("citation_integrity"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


# ---- assertions ------------------------------------------------------------------------------------------------------

# How ratios, payment days and business numbers are worded.
RATIO_WORDS = r"(?:成數|保證成數)[^0-9零一二三四五六七八九十百分]{0,8}(百分之[零一二三四五六七八九十百]+|[0-9.]+\s*%|[一二三四五六七八九十]成)"
DAYS_WORDS = r"(?:帳期|付款(?:條件|期限)?|票期)[^0-9]{0,6}(\d{1,3})\s*(?:天|日)"
ID_WORDS = r"(?:統編|統一編號)[^0-9]{0,4}(\d{8})"


def assertions(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, value): ratios, payment days and business numbers stated in a text. Numbers are kept as canonical text."""
    t = F.coalesce(F.col(text), F.lit(""))
    mk = lambda kind, arr: F.transform(arr, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    ratio = F.filter(F.transform(F.regexp_extract_all(t, F.lit(RATIO_WORDS), 1), lambda s: F.format_string("%.6f", cn_ratio(s))), lambda v: v != "null")
    days = F.transform(F.regexp_extract_all(t, F.lit(DAYS_WORDS), 1), lambda s: s.cast("int").cast("string"))
    ids_ = F.regexp_extract_all(t, F.lit(ID_WORDS), 1)
    found = F.concat(mk("guarantee_ratio", ratio), mk("payment_terms", days), mk("tax_id", ids_))
    return texts.select(*keys, F.explode(found).alias("a")).select(*keys, "a.kind", "a.value")


def corroboration(answers: DataFrame, context: DataFrame, full: int = 3) -> DataFrame:
    """Per distinct assertion of an answer: sources that agree, sources that say otherwise, and the score."""
    a = assertions(answers, ["answer_id"], "answer").distinct()
    s = assertions(context, ["answer_id", "source"]).distinct()
    d = a.join(s.withColumnRenamed("value", "said"), ["answer_id", "kind"], "left")
    per = d.groupBy("answer_id", "kind", "value", "source").agg(F.max(F.col("said") == F.col("value")).alias("same"))
    g = per.groupBy("answer_id", "kind", "value").agg(F.count_if(F.col("same")).alias("agree"), F.count_if(~F.col("same")).alias("conflict"))
    vol = F.least(F.lit(1.0), F.col("agree") / F.lit(full))
    den = F.col("agree") + F.col("conflict")
    con = F.when(den > 0, F.col("agree") / den).otherwise(0.0)
    return g.withColumn("volume", vol).withColumn("consistency", con).withColumn("score", vol * con)


def corroboration_score(answers: DataFrame, context: DataFrame, verified: DataFrame, full: int = 3) -> DataFrame:
    """Mean over an answer's assertions; without any, the number of grounded sources over three, at most 1."""
    per = corroboration(answers, context, full).groupBy("answer_id").agg(F.avg("score").alias("s"), F.sum("conflict").alias("conflicts"))
    src = verified.where("grounded").groupBy("answer_id").agg(F.count_distinct("matched_source").alias("n"))
    return answers.select("answer_id").join(per, "answer_id", "left").join(src, "answer_id", "left").select(
        "answer_id", F.coalesce("s", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.lit(full))).alias("corroboration"),
        F.when(F.col("s").isNotNull(), "claim_level").otherwise("source_count").alias("mode"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


# ---- scope -----------------------------------------------------------------------------------------------------------

# Places and regimes outside the home jurisdiction.
FOREIGN = ["日本", "韓國", "新加坡", "香港", "澳門", "中國大陸", "大陸地區", "美國", "歐盟", "英國", "德國", "法國", "越南", "泰國", "馬來西亞", "印尼",
           "菲律賓", "印度", "澳洲", "加拿大", "GDPR", "Basel", "巴塞爾"]
JURIS_WORDS = {
    "台灣": ["中華民國", "臺灣", "台灣", "本國", "我國"], "日本": ["日本"], "韓國": ["韓國", "南韓"], "新加坡": ["新加坡"], "香港": ["香港"],
    "中國大陸": ["中國大陸", "大陸地區"], "美國": ["美國"], "歐盟": ["歐盟", "歐洲聯盟"], "英國": ["英國"], "德國": ["德國"], "法國": ["法國"],
}


def scope_terms(q: Column, normalised: bool = False) -> Column:
    t = q if normalised else nfkc(F.coalesce(q, F.lit("")))
    places = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in FOREIGN]))
    yrs = F.transform(F.regexp_extract_all(t, F.lit(r"(?:民國\s*)?(\d{2,4})\s*年"), 1), lambda y: F.concat(y, F.lit("年")))
    arts = F.transform(F.regexp_extract_all(t, F.lit(r"第\s*([一二三四五六七八九十百0-9]+)\s*條"), 1), lambda a: F.concat(F.lit("第"), a, F.lit("條")))
    return F.array_distinct(F.concat(places, yrs, arts))


def missing_scope(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, term): scope words of the question found in none of its retrieved texts."""
    q = answers.withColumn("_n", nfkc(F.coalesce("question", F.lit(""))))
    t = q.select("answer_id", F.explode(scope_terms(F.col("_n"), True)).alias("term"))
    c = context.select("answer_id", match_norm(F.col("text")).alias("norm"))
    found = t.join(c, "answer_id").where(F.contains("norm", match_norm(F.col("term"), True))).select("answer_id", "term").distinct()
    return t.join(found, ["answer_id", "term"], "left_anti")


def jurisdiction_conflicts(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Retrieved texts that mention another jurisdiction at least twice and the asked ones never (first in list order)."""
    asked = F.array_compact(F.array(*[F.when(contains_any(F.col("question"), ws), F.lit(j)) for j, ws in JURIS_WORDS.items()]))
    a = answers.select("answer_id", asked.alias("asked")).where(F.size("asked") > 0)
    hits = F.array(*[F.struct(F.lit(j).alias("j"), occurrences(F.col("text"), ws).alias("n")) for j, ws in JURIS_WORDS.items()])
    d = a.join(context, "answer_id").withColumn("hits", hits)
    own = F.aggregate(F.filter("hits", lambda h: F.array_contains("asked", h["j"])), F.lit(0), lambda s, h: s + h["n"])
    other = F.filter("hits", lambda h: ~F.array_contains("asked", h["j"]) & (h["n"] >= 2))
    d = d.where((own == 0) & (F.size(other) > 0))
    return d.select("answer_id", "source", "rank", other[0]["j"].alias("jurisdiction"), other[0]["n"].alias("mentions"))


# ---- confidence and gates ---------------------------------------------------------------------------------------------

def strip_ungrounded(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """Answers without the statements of their ungrounded claims; blank runs collapse to one empty line."""
    bad = verified.where("not grounded").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "statement"))).alias("bad"))
    gone = F.transform(F.coalesce("bad", F.array().cast("array<struct<claim_no:int,statement:string>>")), lambda b: F.coalesce(b["statement"], F.lit("")))
    gone = F.filter(gone, lambda s: s != "")
    d = answers.join(bad, "answer_id", "left")
    text = F.aggregate(gone, F.coalesce("answer", F.lit("")), lambda acc, s: F.replace(acc, s, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return d.withColumn("answer", text).withColumn("n_removed", F.coalesce(F.size("bad"), F.lit(0))).drop("bad")


def confidence(answers: DataFrame, verified: DataFrame, context: DataFrame, health: DataFrame, missing: DataFrame) -> DataFrame:
    """Weighted evidence score per answer with its caps. ``verified`` still holds the removed claims: they decide the
    penalty, while only grounded ones count (strip first, then score)."""
    kept = verified.where("grounded")
    ci = integrity(answers, kept)
    corr = corroboration_score(answers, context, kept)
    had = verified.groupBy("answer_id").agg(F.max(F.col("verdict") == "unverifiable").alias("had_bad"))
    miss = missing.groupBy("answer_id").agg(F.count("*").alias("n_missing"))
    d = (answers.select("answer_id").join(ci, "answer_id").join(corr, "answer_id").join(had, "answer_id", "left").join(miss, "answer_id", "left")
         .join(health.withColumnRenamed("query_id", "answer_id").select("answer_id", "n", "top_dense", "sparse_contributing"), "answer_id", "left"))
    strength = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top_dense") - DENSE_FLOOR) / (DENSE_CEIL - DENSE_FLOOR)))).otherwise(0.0)
    sparse = F.when(F.col("n") > 0, F.col("sparse_contributing") / F.col("n")).otherwise(0.0)
    d = d.withColumn("strength", strength).withColumn("sparse_health", sparse)
    s = 0.45 * F.col("citation_integrity") + 0.20 * F.col("strength") + 0.20 * F.col("corroboration") + 0.15 * F.col("sparse_health")
    s = F.when(F.coalesce("had_bad", F.lit(False)), s * PENALTY).otherwise(s)
    dense_gated = F.coalesce((F.col("n") > 0) & (F.col("top_dense") < DENSE_GATE), F.lit(False))
    scope_gated = F.coalesce("n_missing", F.lit(0)) > 0
    s = F.when(dense_gated | scope_gated, F.least(s, F.lit(GATE_CAP))).otherwise(s)
    return d.select("answer_id", F.bround(s, 3).alias("confidence"), "citation_integrity", "strength", "corroboration", "conflicts", "sparse_health",
                    dense_gated.alias("dense_gated"), scope_gated.alias("scope_gated"))


def confidence_raw(verified: DataFrame, parts: DataFrame) -> DataFrame:
    """Caps that apply when ungrounded or misattributed claims stay in the answer: at most 0.40 and 0.65."""
    v = verified.groupBy("answer_id").agg(F.max(F.col("verdict") == "unverifiable").alias("bad"), F.max(F.col("verdict") == "wrong_source").alias("wrong"))
    c = F.col("confidence")
    c = F.when(F.col("bad"), F.least(c, F.lit(max(0.0, ABSTAIN - GATE_MARGIN)))).otherwise(c)
    c = F.when(F.col("wrong"), F.least(c, F.lit(WRONG_CAP))).otherwise(c)
    return parts.join(v, "answer_id", "left").withColumn("confidence", c).drop("bad", "wrong")


def gates(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """Abstain below the threshold with the reasons; otherwise flag large amounts for human review."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("scope_gated"), "scope not in the texts"), F.when(c("dense_gated"), "topic not covered"),
        F.when(c("citation_integrity") < 0.6, "claims not verifiable"),
        F.when((c("strength") < 0.4) & ~(c("scope_gated") | c("dense_gated")), "no relevant document"),
        F.when((c("corroboration") < 0.34) & (c("conflicts") > 0), "sources disagree"),
        F.when((c("corroboration") < 0.34) & (c("conflicts") == 0), "single source")))
    abstain = c("confidence") < ABSTAIN
    d = parts.join(answers.select("answer_id", "answer"), "answer_id")
    amount = largest_amount(F.when(abstain, F.lit("")).otherwise(c("answer")))
    return d.select("answer_id", "confidence", abstain.alias("abstained"), F.when(abstain, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
                    (amount >= REVIEW_AMOUNT).alias("needs_review"))


# ---- names ------------------------------------------------------------------------------------------------------------

# Endings of institution names.
SUFFIXES = ["商業銀行", "信保基金", "基金會", "股份有限公司", "有限公司", "信用保證協會", "銀行", "基金", "控股", "事務所"]


def entity_names(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Institution names: a known ending with at most the four characters before it."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("([一-鿿]{2,12}(?:" + "|".join(SUFFIXES) + "))"), 1)
    d = texts.select(*keys, F.explode(runs).alias("m"))
    suf = F.coalesce(*[F.when(F.endswith("m", F.lit(s)), F.lit(s)) for s in sorted(SUFFIXES, key=len, reverse=True)])
    head = F.substring(F.col("m"), F.lit(1), F.length("m") - F.length(suf))
    head = F.when(F.length(head) > 4, F.right(head, F.lit(4))).otherwise(head)
    return d.select(*keys, F.when(F.length(head) >= 2, F.concat(head, suf)).alias("name")).where("name is not null").distinct()


def name_typos(answers: DataFrame, context: DataFrame, low: float = 85.0, same: float = 99.9) -> DataFrame:
    """Names in an answer that its texts do not contain but nearly do."""
    said = entity_names(answers, ["answer_id"], "answer")
    known = entity_names(context, ["answer_id"], "text")
    odd = said.join(known, ["answer_id", "name"], "left_anti")
    d = odd.join(known.withColumnRenamed("name", "known"), "answer_id")
    la, lb = F.length("name"), F.length("known")
    d = d.where(200.0 * F.least(la, lb) >= low * (la + lb)).withColumn("score", ratio_udf("name", "known"))
    best = d.groupBy("answer_id", "name").agg(F.max_by("known", F.struct("score", "known")).alias("likely"), F.max("score").alias("score"))
    return best.where((F.col("score") >= low) & (F.col("score") < same)).select("answer_id", F.col("name").alias("written"), "likely", F.round("score", 1).alias("similarity"))


# ---- audit of answers against the case ---------------------------------------------------------------------------------

READY_WORDS = r"(可以送件|建議送件|沒有問題|皆無異常|全部通過)"


def audit_answers(answers: DataFrame, inv: DataFrame, con: DataFrame, critical_failed: DataFrame) -> DataFrame:
    """(answer_id, audit_id, severity, value): statements of an answer that its case contradicts or does not support.

    ``critical_failed``: tenant_id of cases with a failed critical check.
    """
    a = answers.select("answer_id", "tenant_id", "answer")
    cases_ = inv.select("tenant_id").distinct()
    said = assertions(a, ["answer_id", "tenant_id"], "answer").join(cases_, "tenant_id", "left_semi")
    terms = inv.select("tenant_id", F.col("payment_terms_days").cast("int").alias("t")).union(con.select("tenant_id", F.col("payment_terms_days").cast("int")))
    terms = terms.where("t is not null and t <> 0").select("tenant_id", F.col("t").cast("string").alias("value")).distinct()
    from ..functions.ids import clean_ban
    known = inv.select("tenant_id", F.explode(F.array(clean_ban(F.col("buyer_ban")), clean_ban(F.col("seller_ban")))).alias("value")).where("value is not null").distinct()
    a1 = said.where("kind = 'payment_terms'").join(terms, ["tenant_id", "value"], "left_anti").select("answer_id", F.lit("AUD-01").alias("audit_id"), F.lit("contradiction").alias("severity"), "value")
    a2 = said.where("kind = 'tax_id'").join(known, ["tenant_id", "value"], "left_anti").select("answer_id", F.lit("AUD-02").alias("audit_id"), F.lit("unsupported").alias("severity"), "value")
    a3 = assertions(a, ["answer_id"], "answer").where("kind = 'guarantee_ratio'").groupBy("answer_id").agg(F.count_distinct("value").alias("n")).where("n > 1").select(
        "answer_id", F.lit("AUD-03").alias("audit_id"), F.lit("contradiction").alias("severity"), F.col("n").cast("string").alias("value"))
    word = F.regexp_extract("answer", READY_WORDS, 1)
    a4 = a.where(word != "").join(critical_failed.select("tenant_id").distinct(), "tenant_id", "left_semi").select("answer_id", F.lit("AUD-04").alias("audit_id"), F.lit("contradiction").alias("severity"), word.alias("value"))
    return a1.unionByName(a2).unionByName(a3).unionByName(a4)


def releasable(answers: DataFrame, found: DataFrame) -> DataFrame:
    bad = found.where("severity = 'contradiction'").groupBy("answer_id").agg(F.count("*").alias("n"))
    return answers.select("answer_id").join(bad, "answer_id", "left").select("answer_id", F.coalesce("n", F.lit(0)).alias("contradictions"), F.col("n").isNull().alias("releasable"))


# ---- quotes in running text --------------------------------------------------------------------------------------------

LOOKBACK = 260


def paired_quotes(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, quote, source): each source tag with the nearest quotation in the 260 characters before it, first of equals."""
    tag = r"\[來源[:：]\s*[^\]]+\]"
    whole = F.regexp_extract_all(F.col(text), F.lit(f"({tag})"), 1)
    # pieces[i] is the text before the i-th tag (after the tag before it)
    d = texts.select(key, F.split(F.col(text), tag).alias("pieces"), whole.alias("tags"))
    # the look-back may reach over earlier tags, so it is cut from the text up to this tag
    d = d.select(key, F.posexplode("tags").alias("i", "tag"), "pieces", "tags")
    upto = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.col("i")), lambda j: F.concat(
        F.col("pieces")[j], F.when(j < F.col("i"), F.col("tags")[j]).otherwise(""))), ""))
    window = F.right(upto, F.lit(LOOKBACK))
    quotes = F.regexp_extract_all(window, F.lit("「([^「」]{6,400})」"), 1)
    d = d.select(key, "i", F.trim(F.regexp_extract("tag", r"\[來源[:：]\s*([^\]]+)\]", 1)).alias("source"), F.trim(F.try_element_at(quotes, F.lit(-1))).alias("quote"))
    d = d.where("quote is not null").withColumn("head", F.substring("quote", 1, 80))
    return first_per_key(d, [key, "head", "source"], ["i"]).drop("head")


MARKS = ["📗", "📊", "💭", "⚠️"]


def marked_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines with the marks in force: a mark carries on to list, table and quote lines below it, until a heading or prose.

    Lines of one text are bounded by the text itself; they are folded inside an expression.
    """
    lines = F.split(F.col(text), r"\r?\n")
    own = lambda l: F.array_compact(F.array(*[F.when(F.contains(l, F.lit(m)), F.lit(m)) for m in MARKS]))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("carry"), F.array().cast("array<struct<line:string,marks:array<string>>>").alias("out"))

    def step(acc, l):
        t, o = F.trim(l), own(l)
        heading = F.rlike(t, F.lit("^(#|---|===|```)"))
        item = F.rlike(t, F.lit(r"^[|\-*>]"))
        marks = F.when(F.size(o) > 0, o).when((t != "") & ~heading & item, acc["carry"]).otherwise(none)
        carry = F.when(F.size(o) > 0, o).when(t == "", acc["carry"]).when(heading, none).when(item & (F.size(acc["carry"]) > 0), acc["carry"]).otherwise(none)
        return F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(F.struct(l.alias("line"), marks.alias("marks")))).alias("out"))

    folded = F.aggregate(lines, start, step, lambda a: a["out"])
    return texts.select(key, F.posexplode(folded).alias("line_no", "l")).select(key, (F.col("line_no") + 1).alias("line_no"), "l.line", "l.marks")


def audit_marked(texts: DataFrame, corpus: DataFrame, key: str, text: str = "text", window: int = 200) -> DataFrame:
    """Text audit: quoted fragments must occur in the corpus, marked numbers within 200 characters of a word of their line,
    lines with figures and no mark are reported. (key, line_no, kind, value, verified)

    ``corpus`` (body) is read once for the quotes and once for the words, through positional indexes of what is asked for.
    """
    figures = F.rlike("line", F.lit(r"\d[\d,]{3,}|\d+(\.\d+)?\s*%"))
    l = cut(marked_lines(texts, key, text).where(F.array_contains("marks", "📗") | F.array_contains("marks", "📊") | ((F.size("marks") == 0) & figures)))
    frag = l.where(F.array_contains("marks", "📗")).select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit("「([^「」]{6,})」"), 1)).alias("value"))
    frag = frag.withColumn("norm", squeeze(F.col("value"))).where(F.length("norm") >= 6)
    num = l.where(F.array_contains("marks", "📊")).select(
        key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(\d[\d,]{3,}(?:\.\d+)?|\d+\.\d{2})"), 1)).alias("value"),
        F.slice(F.filter(F.regexp_extract_all("line", F.lit("([一-鿿]{2,6})"), 1), lambda w: ~w.isin("實測", "原文", "推論", "未涵蓋")), 1, 6).alias("words"))
    num = num.withColumn("plain", F.regexp_replace("value", ",", ""))
    bare = F.regexp_replace(F.regexp_replace("plain", r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    num = num.withColumn("forms", F.array_distinct(F.array("plain", bare)))
    frag = frag.withColumn("id", F.md5("norm"))
    # equal bodies count once; the digest stands in for the text until candidates are known
    body = cut(corpus.select("body", F.md5("body").alias("body_id")).distinct())
    q_found = found(frag.select("id", F.col("norm").alias("needle")).dropDuplicates(["id"]), body.select("body_id", squeeze(F.col("body")).alias("b")), "b").select("id").distinct()
    fr = frag.join(q_found.withColumn("ok", F.lit(True)), "id", "left").select(key, "line_no", F.lit("quote").alias("kind"), "value", F.coalesce("ok", F.lit(False)).alias("verified"))
    pairs = num.withColumn("form", F.explode("forms")).withColumn("word", F.explode("words")).select("form", "word").distinct()
    n_found = _near(pairs, body.select("body_id", F.regexp_replace("body", ",", "").alias("n")), window)
    hit = num.withColumn("form", F.explode("forms")).withColumn("word", F.explode("words")).join(n_found, ["form", "word"], "left_semi").select(key, "line_no", "value").distinct()
    nu = num.select(key, "line_no", "value").join(hit.withColumn("ok", F.lit(True)), [key, "line_no", "value"], "left").select(
        key, "line_no", F.lit("number").alias("kind"), "value", F.coalesce("ok", F.lit(False)).alias("verified"))
    bare_line = l.where((F.size("marks") == 0) & ~F.rlike(F.trim("line"), F.lit(r"^(\|---|#|>|```)")) & figures)
    un = bare_line.select(key, "line_no", F.lit("unmarked").alias("kind"), F.substring(F.trim("line"), 1, 110).alias("value"), F.lit(False).alias("verified"))
    return fr.unionByName(nu).unionByName(un)


def places(asked: DataFrame, bodies: DataFrame, hay: str, least: int = 1) -> DataFrame:
    """(needle, body_id, at): every occurrence of every needle of ``least`` or more characters, places from 0."""
    a = asked.where(F.length("needle") >= least).select("needle", F.md5("needle").alias("id"))
    return found(a, bodies, hay).join(a, "id").select("needle", "body_id", "at")


def _near(pairs: DataFrame, bodies: DataFrame, window: int) -> DataFrame:
    """(form, word) where the word lies within ``window`` characters of the number in some body.

    Places of the words come from the index; what stands around them is cut out once. The number must lie in it wholly on one
    side, near enough: numbers in it are taken apart into pieces of the lengths that are asked for, which meet the forms in an equi-join.
    """
    pairs = cut(pairs)
    lengths = sorted(r.n for r in pairs.select(F.length("form").alias("n")).distinct().collect())  # bounded by the longest number
    longest = max(lengths, default=0)
    at = places(pairs.select(F.col("word").alias("needle")).distinct(), bodies, "n")
    left, right = F.greatest(F.lit(window - 2), F.lit(longest)), F.lit(window + longest)
    around = at.join(bodies, "body_id").select(
        F.col("needle").alias("word"), F.substring("n", F.greatest(F.col("at") - left, F.lit(0)) + 1, F.least(F.col("at"), left)).alias("before"),
        F.substring("n", F.col("at") + F.length("needle") + 1, right).alias("after"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = set()
            for word, before, after in b.itertuples(index=False):
                room, n = window - len(word), len(before)
                for text, ahead in ((before, True), (after, False)):
                    for m in re.finditer(r"[0-9.]+", text):
                        for k in lengths:
                            low = max(m.start(), n - max(room, k)) if ahead else m.start()
                            high = m.end() - k if ahead else min(m.end() - k, max(room, 0))
                            got.update((text[p:p + k], word) for p in range(low, high + 1))
            yield pd.DataFrame(list(got), columns=["form", "word"])

    return pairs.join(around.mapInPandas(pieces, "form string, word string").distinct(), ["form", "word"])


LAYER_DROP = "，。、；：「」『』（）()《》〈〉！？…—－-·　 \t\n\r"


def failure_layers(claims: DataFrame, context: DataFrame) -> DataFrame:
    """At which normalisation a quote is found in its answer's texts: L0 raw, L1 form and blanks, L2 punctuation, L3 four
    fifths in one piece, L4 not at all."""
    c = claims.select("answer_id", "claim_no", F.coalesce("quote", F.lit("")).alias("q0")).withColumn("q1", squeeze(nfkc("q0")))
    c = c.withColumn("q2", F.translate("q1", LAYER_DROP, ""))
    t = context.select("answer_id", F.coalesce("text", F.lit("")).alias("t0")).withColumn("t1", squeeze(nfkc("t0"))).withColumn("t2", F.translate("t1", LAYER_DROP, ""))
    has = lambda a, b: (F.col(a) != "") & F.contains(F.col(b), F.col(a))
    d = c.join(t, "answer_id", "left")
    lvl = F.when(has("q0", "t0"), 0).when(has("q1", "t1"), 1).when(has("q2", "t2"), 2).otherwise(9)
    d = d.withColumn("lvl", lvl)
    key = ["answer_id", "claim_no"]
    best = d.groupBy(*key).agg(F.min("lvl").alias("lvl"), F.max(F.trim("q0") == "").alias("blank"))
    rest = d.join(best.where("lvl = 9 and not blank").select(*key), key, "left_semi").withColumn("share", substring_share_udf("q2", F.coalesce("t2", F.lit(""))))
    near = rest.groupBy(*key).agg(F.max("share").alias("share"))
    out = best.join(near, key, "left")
    layer = F.when(F.col("blank"), "L4").when(F.col("lvl") < 9, F.concat(F.lit("L"), F.col("lvl").cast("string"))).when(F.col("share") >= 0.8, "L3").otherwise("L4")
    return out.select(*key, layer.alias("layer"), F.when(F.col("lvl") < 9, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("share"))
