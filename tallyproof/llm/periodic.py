"""Periodic runs of words: recursive frequency splitting, then a scan by lags of what is left.

A run repeats a period of ``q`` words at least four times, so each of its words occurs at least four times in it. A
word that occurs less often in a segment is in no run there and splits it; the parts are counted anew until no word
is too rare. All segments of an Arrow batch are counted together, and those that stayed whole are not counted again. Of a surviving
segment each lag ``q`` is scanned at every ``q``-th word only: a stretch of ``3 q`` words equal to those ``q`` later
holds three such places in a row. A hit is then extended word by word to the whole run. So a segment of ``m`` words costs
about ``m log m`` steps.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import id_and_text, small_batches
from tallyproof.llm.words import split_words

#: A run has at least so many periods and so many words.
PERIODS, LEAST = 4, 6
#: Comparisons made at once.
STEP = 1 << 20


def segments(x: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """``(low, high)`` of the stretches of rows that no too rare word splits. ``x``: words, ``row``: their rows."""
    at, part, out = np.arange(len(x)), row, []
    while len(at):
        _, number, count = np.unique(part * (int(x.max()) + 1) + x[at], return_inverse=True, return_counts=True)
        common = count[number] >= PERIODS
        split = np.zeros(int(part.max()) + 1, bool)
        split[part[~common]] = True
        whole = ~split[part]
        if whole.any():
            lows = np.flatnonzero(np.concatenate([[True], np.diff(part[whole]) != 0]))
            spots = at[whole]
            out += [(int(spots[a]), int(spots[b - 1]) + 1) for a, b in zip(lows, [*lows[1:], len(spots)]) if b - a >= LEAST]
        stay = common & ~whole
        at, part = at[stay], part[stay]
        if len(at):
            fresh = np.concatenate([[False], (np.diff(at) != 1) | (np.diff(part) != 0)])
            part = np.cumsum(fresh)
            long = np.bincount(part)[part] >= LEAST
            at, part = at[long], part[long]
    return sorted(out)


def reach(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which each word equals the one ``lag`` later."""
    high, width, most = at + 1, 32, len(x) - lag
    while high < most:
        end = min(most, high + width)
        off = x[high:end] != x[high + lag:end + lag]
        first = int(off.argmax())
        if off[first]:
            high += first
            break
        high, width = end, 2 * width
    low, width = at, 32
    while low > 0:
        begin = max(0, low - width)
        off = (x[begin:low] != x[begin + lag:low + lag])[::-1]
        first = int(off.argmax())
        if off[first]:
            low -= first
            break
        low, width = begin, 2 * width
    return low, high


def scan(x: np.ndarray, step: int = STEP) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs in a segment, by start and period."""
    found: dict[tuple[int, int], int] = {}
    n, lag, most = len(x), 1, len(x) // PERIODS

    def fresh(at: np.ndarray, lags: np.ndarray | int, end: int) -> np.ndarray:
        """Hits that lie in no known run whose period divides the lag: those find that run again."""
        new = np.ones(len(at), bool)
        for (a, b), p in found.items():
            if b - a > 3 * max(p, lag) and p < end:
                new &= ~((at >= a) & (at + 3 * lags < b) & (lags % p == 0))
        return at[new] if isinstance(lags, int) else new

    while lag <= most:
        end, size = lag, 0
        while end <= most and (end == lag or size + (n - 1) // end <= step):
            size += (n - 1) // end
            end += 1
        span = np.arange(lag, end)
        count = (n - 1) // span
        lags = np.repeat(span, count)
        at = (np.arange(len(lags)) - np.repeat(np.cumsum(count) - count, count)) * lags
        same = x[at] == x[at + lags]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (lags[:-2] == lags[2:]))
        at, lags = at[three], lags[three]
        keep = fresh(at, lags, end)
        at, lags = at[keep], lags[keep]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(lags) != 0])) if len(lags) else []
        for a, b in zip(edges, [*edges[1:], len(lags)]):
            lag = int(lags[a])
            hits = fresh(at[a:b], lag, lag + 1)
            while len(hits):
                low, high = reach(x, int(hits[0]), lag)
                if high - low + lag >= max(LEAST, PERIODS * lag):
                    found.setdefault((low, high + lag), lag)  # the smallest period comes first
                hits = hits[np.searchsorted(hits, high):]
        lag = end
    return sorted((a, b - a, p) for (a, b), p in found.items())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_words, n_dropped, runs, best)``, one row per row of ``docs``.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, numbered from 0. A run is a stretch of consecutive words
    with smallest period ``q`` and at least ``max(6, 4 q)`` words that no neighbouring word extends. ``runs`` lists ``(start, length,
    period)`` by start, then period; ``best`` is the one with the greatest length by period, then the first; null without a
    run. ``text`` is the text without the words after the first period of any run, joined by one space. A null or empty text has no words;
    rows are judged one by one, so repeated rows and ids come out alike and a null id stays null. Texts of any length pass
    whole. Nothing is shuffled. An empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            bounds, x, words = split_words(batch.column(1))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            runs, size = [[] for _ in range(len(bounds) - 1)], len(x) + 1
            edge = np.zeros(size, np.int64)
            for low, high in segments(x, row):
                r = int(row[low])
                for start, length, period in scan(x[low:high]):
                    edge[low + start + period] += 1
                    edge[low + start + length] -= 1
                    runs[r].append((low + start - int(bounds[r]), length, period))
            stay = np.cumsum(edge[:-1]) == 0
            spell = np.array(words, object)
            kept = [x[a:b][stay[a:b]] for a, b in zip(bounds, bounds[1:])]
            best = [min(v, key=lambda s: (-Fraction(s[1], s[2]), s[0], s[2])) if v else None for v in runs]
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            named = lambda s: s and dict(zip(("start", "length", "period"), s))
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([" ".join(spell[k]) for k in kept], pa.string()), pa.array(n), pa.array(n - np.array([len(k) for k in kept], np.int64)),
                pa.array([[named(s) for s in v] for v in runs], pa.list_(kind)), pa.array([named(s) for s in best], kind)],
                ["doc_id", "text", "n_words", "n_dropped", "runs", "best"])

    one = "struct<start:bigint,length:bigint,period:bigint>"
    return id_and_text(docs).mapInArrow(run, f"doc_id bigint, text string, n_words bigint, n_dropped bigint, runs array<{one}>, best {one}")


def looped(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` in which about every tenth document, by the crc32 of its id, repeats a stretch of its words from some place to
    the end; the others keep their text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    base = id_and_text(docs).withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    base = base.withColumn("w", words)
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    base = base.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    text: Column = F.array_join(F.transform("w", lambda _, i: F.get("w", place(i).cast("int"))), " ")
    return base.select("doc_id", F.when(F.col("p").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("runs", lambda s: F.concat_ws(",", *(s[k].cast("string") for k in ("start", "length", "period")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
