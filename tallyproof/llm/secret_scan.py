"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Texts are cut into tokens: runs of letters, digits and ``_+/=.-``, and single marks. A token's shape (length, alphabet,
turns between kinds of characters, key words) falls into one of some thousand types. The field scores begin, inside
and outside for each token from its own type, those of its neighbours and features of the file, and is trained on a bounded sample whose labels
are the pattern matches. Decoding is by Viterbi. A token at which outside leads by more than any two
transitions can win back is outside on the best path whatever the rest, so only stretches between such tokens are decoded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import SLOTS, small_batches, worker_store
from tallyproof.llm.words import slices, split_words

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: A text that this finds may have a pattern match; used to draw the training sample only.
MATCHES = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
#: A chunk that this finds has types that depend on its characters, not on its shape.
BY_LETTERS = re.compile(r"\d|AKIA|pass|pwd|secret|token|api|key|auth|bearer|credential", re.I)

#: Expected number of documents in the training sample, and the most of them with a match; windows without a secret, and tokens of a window.
SAMPLE_ROWS, MATCH_ROWS, PLAIN_WINDOWS, WINDOW = 12_000, 4_000, 6_000, 48
CACHE_CHUNKS = 200_000
TOKEN = re.compile(r"[A-Za-z0-9_+/=.\-]+|[^\sA-Za-z0-9_+/=.\-]")
KEY_WORDS = frozenset("password passwd pwd secret token apikey api_key key auth bearer credential credentials".split())
HEX_RUNS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
LENGTHS = (2, 4, 8, 12, 16, 20, 32, 40)
MARKS = {":": 1, "=": 2, '"': 3, "'": 3}
#: Sizes of the parts of a type: key word, length, alphabet, hexadecimal, turns, access key. Types below 8 are marks.
PARTS = (2, 9, 8, 2, 4, 2)
TYPES = 8 + int(np.prod(PARTS))
FILE_BINS = (6, 5, 5)


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """``(start, kind, end, value start, value end)`` of all pattern matches, by start and kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in text.encode("utf-8", "replace").translate(HEX_RUNS):
        out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def token_type(token: str) -> int:
    if len(token) == 1 and not token.isalnum():
        return MARKS.get(token, 4)
    bare = token.strip("=.-_/+")
    lower, upper, digit = (any(f(c) for c in token) for f in (str.islower, str.isupper, str.isdigit))
    alphabet = lower * 1 + upper * 2 + digit * 4
    kinds = ["a" if c.isalpha() else "0" if c.isdigit() else "-" for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    parts = (token.strip("=.-").lower() in KEY_WORDS or any(token.lower().startswith(k + "=") for k in KEY_WORDS), sum(len(token) > n for n in LENGTHS), alphabet,
             bool(bare) and digit and not bare.strip("0123456789abcdefABCDEF"), (turns > 0) + (turns > 3) + (turns > 8), token.startswith("AKIA"))
    number = 0
    for size, part in zip(PARTS, parts):
        number = number * size + int(part)
    return 8 + number


def spread() -> np.ndarray:
    """Types by features: one for each value of each part, and length by alphabet."""
    rows = []
    for t in range(TYPES):
        if t < 8:
            rows.append([t])
            continue
        number, parts = t - 8, []
        for size in reversed(PARTS):
            number, part = divmod(number, size)
            parts.append(part)
        parts, at, row = parts[::-1], 8, []
        for size, part in zip(PARTS, parts):
            row.append(at + part)
            at += size
        rows.append([*row, at + parts[1] * PARTS[2] + parts[2]])
    out = np.zeros((TYPES, 8 + sum(PARTS) + PARTS[1] * PARTS[2]), np.float32)
    for t, row in enumerate(rows):
        out[t, row] = 1
    return out


def file_features(text: str) -> tuple[int, int, int]:
    """Steps of length, share of digits, share of ``=`` and ``:``."""
    n = max(1, len(text))
    raw = text.encode("utf-8", "replace")
    step = lambda part: int(np.clip(np.floor(np.log2(part / n + 1e-4)) + 12, 0, 9)) // 2
    return min(5, int(np.log2(n)) // 3), step(len(raw) - len(raw.translate(None, b"0123456789"))), step(text.count("=") + text.count(":"))


class Shapes(dict):
    """Letters by ``a``, ``A``, ``é`` or ``É``; other characters stay. What has no digit and no key word has types by its shape alone."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        cased = c.isalpha() and (c.islower() or c.isupper())
        self[code] = shape = c if not cased else ("aA" if c.isascii() else "éÉ")[c.isupper()]
        return shape


def type_bytes(chunk: str) -> bytes:
    return np.array([token_type(t) for t in TOKEN.findall(chunk)], np.uint16).tobytes()


def tokenizer():
    """A function from an Arrow array of texts to ``(types, bounds)``: row ``r`` has ``types[bounds[r]:bounds[r + 1]]``. Types are found
    once for each distinct stretch without white space, most of them by its shape."""
    store = worker_store()
    shapes, known = store.setdefault("secret shapes", (Shapes(), {}))

    def of_chunk(chunk: str) -> bytes:
        if BY_LETTERS.search(chunk):
            return type_bytes(chunk)
        shape = chunk.translate(shapes)
        found = known.get(shape)
        if found is None:
            if len(known) >= CACHE_CHUNKS:
                known.clear()
            known[shape] = found = type_bytes(shape)
        return found

    def types_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, index, chunks = split_words(texts)
        found = [of_chunk(c) for c in chunks]
        size = np.array([len(f) // 2 for f in found], np.int64)
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(found), np.uint16)
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int64), ends[bounds]

    return types_of


def with_matches(text: Column) -> Column:
    return F.coalesce(text.rlike(MATCHES), F.lit(False))


def windows(docs: DataFrame, rows: int, match_rows: int = MATCH_ROWS) -> DataFrame:
    """Training windows ``(types, labels, file)``; types carry one neighbour on either side, -1 past an end.

    About ``rows`` documents are drawn by a hash of the id, and besides them about ``match_rows`` of those with a match, so a
    corpus with rare secrets has examples too. Rows without ``doc_id`` are never drawn; a repeated id is drawn with all its rows.
    """
    own = docs.where("doc_id is not null")
    n, matching = own.agg(F.count("*"), F.count_if(with_matches(F.col("text")))).first()
    slot = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLOTS)) / F.lit(SLOTS)
    drawn = slot(0) < rows / max(n, 1)
    picked = own.where(drawn | ((slot(1) < match_rows / max(matching, 1)) & with_matches(F.col("text"))))

    def run(batches):
        types_of = tokenizer()
        for batch in batches:
            out = []
            flat, bounds = types_of(batch.column(1))
            for doc_id, text, low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if not text:
                    continue
                spans = base_spans(text)
                types = np.concatenate([[-1], flat[low:high], [-1]]).astype(np.int32)
                n = high - low
                labels, longest = np.zeros(n, np.int32), np.zeros(0, int)
                places = np.array([m.span() for m in TOKEN.finditer(text)], np.int64).reshape(-1, 2)
                for _, _, _, a, b in spans:
                    inside = np.flatnonzero((places[:, 0] < b) & (places[:, 1] > a))
                    labels[inside] = 2
                    labels[inside[:1]] = 1
                lows = np.arange(0, n, WINDOW)
                marked = {int(i) // WINDOW * WINDOW for i in np.flatnonzero(labels)}
                plain = set()
                if len(lows):  # one window by the id, and those of the longest tokens that are no secret
                    longest = np.argsort(np.where(labels > 0, 0, places[:, 0] - places[:, 1]), kind="stable")[:2]
                    plain = {int(lows[doc_id % len(lows)]), *(int(i) // WINDOW * WINDOW for i in longest)}
                for at in sorted(marked | plain):
                    out.append((types[at:at + WINDOW + 2], labels[at:at + WINDOW], file_features(text)))
            types, labels, file = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int32())) for v in (types, labels, file)], ["types", "labels", "file"])

    return picked.mapInArrow(run, "types array<int>, labels array<int>, file array<int>")


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 120, rate: float = 0.15) -> dict | None:
    """Scores by type and place, of file features and of transitions; None if no pattern matches in the sample."""
    got = windows(docs, rows).toArrow()
    types, labels, files = (got[c].to_pylist() for c in ("types", "labels", "file"))
    has = [i for i, y in enumerate(labels) if any(y)]
    if not has:
        return None
    plain = sorted((i for i, y in enumerate(labels) if not any(y)), key=lambda i: (types[i], files[i]))
    plain = plain[::max(1, len(plain) // PLAIN_WINDOWS)]
    use = [*has, *plain]
    n, most = len(use), WINDOW
    x, y, live = np.full((n, most + 2), -1), np.zeros((n, most), int), np.zeros((n, most), bool)
    for r, i in enumerate(use):
        x[r, :len(types[i])], y[r, :len(labels[i])], live[r, :len(labels[i])] = types[i], labels[i], True
    file = np.array([files[i] for i in use])
    x = np.where(x < 0, TYPES, x)  # a type of its own past the ends
    table = np.vstack([spread(), np.zeros(spread().shape[1], np.float32)])
    table = np.hstack([table, np.eye(len(table), 1, -TYPES, dtype=np.float32)])
    k = table.shape[1]
    theta = {"own": np.zeros((k, 3)), "before": np.zeros((k, 3)), "after": np.zeros((k, 3)), "move": np.zeros((3, 3)),
             **{f"file{i}": np.zeros((size, 3)) for i, size in enumerate(FILE_BINS)}}
    first, second = {p: np.zeros_like(v) for p, v in theta.items()}, {p: np.zeros_like(v) for p, v in theta.items()}
    gold = np.eye(3)[y] * live[..., None]
    pairs = (live[:, 1:] & live[:, :-1])
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for epoch in range(1, epochs + 1):
        by_type = {p: table @ theta[p] for p in ("own", "before", "after")}
        e = by_type["own"][x[:, 1:-1]] + by_type["before"][x[:, :-2]] + by_type["after"][x[:, 2:]]
        e += sum(theta[f"file{i}"][file[:, i]] for i in range(3))[:, None]
        e *= live[..., None]
        move = theta["move"]
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, most):
            step = log_sum(ahead[:, t - 1, :, None] + move, 1) + e[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = log_sum(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = log_sum(ahead[:, -1], 1)
        expected = np.exp(ahead + back - total[:, None, None]) * live[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + move + (e + back)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        d = expected - gold
        grad = {"move": joint.sum((0, 1)) - gold_moves}
        for p, cut in (("own", x[:, 1:-1]), ("before", x[:, :-2]), ("after", x[:, 2:])):
            sums = np.stack([np.bincount(cut.ravel(), d[..., c].ravel(), TYPES + 1) for c in range(3)], 1)
            grad[p] = table.T @ sums
        for i, size in enumerate(FILE_BINS):
            grad[f"file{i}"] = np.stack([np.bincount(file[:, i], d[..., c].sum(1), size) for c in range(3)], 1)
        for p in theta:
            g = grad[p] / n + 1e-4 * theta[p]
            first[p], second[p] = 0.9 * first[p] + 0.1 * g, 0.999 * second[p] + 0.001 * g * g
            theta[p] = theta[p] - rate * (first[p] / (1 - 0.9 ** epoch)) / (np.sqrt(second[p] / (1 - 0.999 ** epoch)) + 1e-8)
    return {**{p: table @ theta[p] for p in ("own", "before", "after")}, "move": theta["move"], "file": [theta[f"file{i}"] for i in range(3)]}


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best path of labels 0 (outside), 1 (begin), 2 (inside)."""
    back, score = np.zeros((len(e), 3), int), e[0]
    for t in range(1, len(e)):
        step = score[:, None] + move
        back[t] = step.argmax(0)
        score = step.max(0) + e[t]
    path = np.zeros(len(e), int)
    path[-1] = int(score.argmax())
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode_all(types: np.ndarray, bounds: np.ndarray, files: np.ndarray, model: dict) -> np.ndarray:
    """Labels of the tokens of many texts; equal to Viterbi over each whole text. ``bounds``: where texts begin and end."""
    if not len(types):
        return np.zeros(0, int)
    count = np.diff(bounds)
    before, after = np.concatenate([[TYPES], types[:-1]]), np.concatenate([types[1:], [TYPES]])
    before[bounds[:-1][count > 0]] = TYPES
    after[bounds[1:][count > 0] - 1] = TYPES
    by_file = sum(f[files[:, i]] for i, f in enumerate(model["file"]))
    e = model["own"][types] + model["before"][before] + model["after"][after] + np.repeat(by_file, count, axis=0)
    move = model["move"]
    path, open_ = np.zeros(len(types), int), np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= 2 * (move.max() - move.min()))
    if len(open_):
        row = np.searchsorted(bounds, open_, "right") - 1
        for run in np.split(np.arange(len(open_)), np.flatnonzero((np.diff(open_) > 1) | (np.diff(row) > 0)) + 1):
            first, last, r = open_[run[0]], open_[run[-1]], row[run[0]]
            low, high = max(bounds[r], first - 1), min(bounds[r + 1], last + 2)  # with the sure tokens on either side
            part = e[low:high].copy()
            if low < first:
                part[0, 1:] = -1e9
            if high > last + 1:
                part[-1, 1:] = -1e9
            path[low:high] = viterbi(part, move)
    return path


def decode(types: np.ndarray, file: tuple[int, int, int], model: dict) -> np.ndarray:
    """The same of one text."""
    return decode_all(types, np.array([0, len(types)]), np.array([file]), model)


def scan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``: ``spans`` lists ``(kind, start, end)`` in code points, end
    exclusive, by start and kind (assign, access, hex, crf).

    Pattern matches always stay; of the field's spans those that overlap none of them are added. A null or empty text has none.
    A corpus without any pattern match in a row with an id has nothing to learn from, so only patterns are reported. Rows without ``doc_id`` are
    scanned but not learnt from; repeated rows are scanned one by one and come out alike. Texts of any length pass whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(base, sample_rows))  # as large as there are types

    def run(batches):
        field, types_of = model.value, tokenizer()
        parts = (whole.slice(low, high - low) for whole in batches for low, high in slices(whole.column(1)))
        for batch in parts:
            out, texts, labels = [], [t or "" for t in batch.column(1).to_pylist()], None
            if field is not None:
                types, bounds = types_of(batch.column(1))
                labels = decode_all(types, bounds, np.array([file_features(t) for t in texts]), field)
                marked = np.add.reduceat(np.append(labels, 0), bounds[:-1]) * (np.diff(bounds) > 0)
            for r, text in enumerate(texts):
                found = [(a, k, b) for a, k, b, _, _ in base_spans(text)]
                if labels is not None and marked[r]:
                    now, extra = None, []
                    for m, label in zip(TOKEN.finditer(text), labels[bounds[r]:bounds[r + 1]].tolist()):
                        if label == 2 and now is not None:
                            now[1] = m.end()
                        elif label:
                            now = [m.start(), m.end()]
                            extra.append(now)
                        else:
                            now = None
                    found += [(a, 3, b) for a, b in extra if not any(a < y and x < b for x, _, y in found)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return base.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the pattern matches and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
