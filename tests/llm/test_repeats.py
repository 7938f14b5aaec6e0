"""Repeated passages, periodic runs and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyproof.llm import alignment, periodic, repeats

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = "[^\x20\x09-\x0d]+"


def docs(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)
    names = "row block seed slice cells firsts n rows start spans pairs uses doc words n_words kept".split()
    return df.selectExpr("*", *(f"{k} as {name}" for k, name in enumerate(names))).repartition(parts)  # names that operators use themselves


ODD = [(None, "null id"), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "x" * 70_000), (6, "a b " * 12_000), (7, "Ä ö ß 😀 é\x85  y\x1cz"), (7, "Ä ö ß 😀 é\x85  y\x1cz"), (8, "one two three")]


# ---- repeated passages ----------------------------------------------------------------------------------------------------

def passages(texts, n):
    """Rows as (id, words, removed flags); the least place of each window decides."""
    rows = [(-(1 << 63) if i is None else i, re.findall(WORD, t or "")) for i, t in texts]
    first = {}
    for i, w in rows:
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < (i, s):
                gone[s:s + n] = [True] * n
        out.append((i, w, gone))
    return out


def check_passages(spark, texts, n, parts=3, **how):
    got = repeats.repeated_passages(docs(spark, texts, parts), n_words=n, **how).collect()
    seen = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text, [i for s in r.spans for i in range(s.start, s.end)]) for r in got)
    want = sorted((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), [k for k, g in enumerate(gone) if g]) for i, w, gone in passages(texts, n))
    assert seen == want


@pytest.mark.parametrize("n, gram, vocabulary", [(20, 8, 40), (5, 2, 3), (6, 6, 3), (4, 1, 2)])
def test_passages(spark, n, gram, vocabulary):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(k)] for k in (n, n + 1, 3 * n, n - 1)]
    texts = []
    for i in range(150):
        w = [word() for _ in range(rng.choice([0, 1, n - 1, n, 2 * n, 90]))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        texts.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    texts += [(500 + i, " ".join(f"c{k}" for k in range(60))) for i in range(25)]
    check_passages(spark, texts, n, gram=gram, slice_cells=64)


def test_passages_odd(spark):
    long = " ".join(f"v{k}" for k in range(30))
    texts = ODD + [(9, long), (9, long), (9, "x " + long), (-5, long), (None, long)]
    check_passages(spark, texts, 20)
    check_passages(spark, texts, 20, parts=1)
    assert repeats.repeated_passages(docs(spark, [])).count() == 0


def test_passages_when_all_cells_are_shared(spark, monkeypatch):
    texts = [(i, " ".join(f"w{random.Random(i // 2).randrange(9)}{k}" for k in range(40))) for i in range(30)]
    monkeypatch.setattr(repeats, "cells", lambda anchor, seed, bits: anchor & 0)
    monkeypatch.setattr(repeats, "SEND", 50)
    check_passages(spark, texts, 20)


def test_passages_digest(spark):
    r = repeats.digest(repeats.repeated_passages(docs(spark, [(1, " a  b\n")]))).first()
    assert r.asDict() == {"doc_id": 1, "n_words": 2, "n_removed": 0, "kept_sha256": hashlib.sha256(b"a b").hexdigest()}


# ---- periodic runs --------------------------------------------------------------------------------------------------------

def runs_of(w):
    """By definition: maximal stretches of each period, of equal stretches the smallest period."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w):
    gone = {i for s, length, q in runs_of(w) for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(rng, n):
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 120]))]
        for _ in range(rng.choice([0, 1, 2])):
            unit = [f"p{rng.randrange(3)}" for _ in range(rng.choice([1, 2, 3, 7, 12]))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * 6)[:len(unit) * rng.choice([3, 4, 5]) + rng.randrange(len(unit))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return out


def test_scan_equals_definition():
    rng = random.Random(4)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3])
        unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8]))]
        w = [rng.randrange(k) for _ in range(rng.randrange(12))] + unit * rng.choice([0, 3, 4, 9]) + [rng.randrange(k) for _ in range(rng.randrange(40))]
        assert periodic.scan(np.array(w, int), step=rng.choice([1, 20, 10_000])) == runs_of(w)


def test_scan_of_long_segments():
    x = np.zeros(300_000, int)
    assert periodic.scan(x) == [(0, 300_000, 1)]
    x[1::2], x[150_000] = 1, 2
    assert periodic.scan(x) == [(0, 150_000, 2), (150_001, 149_999, 2)]


def test_segments_split_until_stable():
    #  x is rare; without it one part has three c only, and without c nothing of it is left
    w = "a b a b a b a b x a c a c a c a".split()
    _, x = np.unique(w, return_inverse=True)
    assert periodic.segments(x, np.zeros(len(x), int)) == [(0, 8)]


def test_periodic_runs(spark):
    texts = periodic_texts(random.Random(6), 250) + ODD
    got = periodic.periodic_runs(docs(spark, texts)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    seen = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text, r.n_words - r.n_dropped) for r in got), key=key)
    want = []
    for i, t in texts:
        w = re.findall(WORD, t or "")
        runs = runs_of(w) if len(w) < 1000 else [(0, len(w), 2)]
        left = collapsed(w) if len(w) < 1000 else "a b"
        want.append((i, len(w), runs, left, len(left.split(" ")) if left else 0))
    assert seen == sorted(want, key=key)
    for r in got:
        top = max((x.length / x.period for x in r.runs), default=None)
        assert (r.best is None) == (top is None) and (top is None or r.best == next(x for x in r.runs if x.length / x.period == top))
    assert periodic.periodic_runs(docs(spark, [])).count() == 0


def looped_words(i, t):
    w = re.findall(WORD, t or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_periodic_query_form(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 9, 60, 200])))) for i in range(-20, 300)] + ODD[:6]
    got = periodic.digest(periodic.periodic_runs(periodic.looped(docs(spark, texts)))).collect()
    want = []
    for i, t in texts:
        w = looped_words(i, t)
        runs = runs_of(w)
        best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        want.append((i, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest, hashlib.sha256(collapsed(w).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and sum(r.n_runs for r in got) > 8


# ---- token alignment ------------------------------------------------------------------------------------------------------

BYTE_BPE, PIECE_BPE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens_of(text):
    """Ids and bytes of both tokenizers by their libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    plain = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(range(256, 400))
    table = {**plain, **{chr(next(rest)): b for b in range(256) if b not in plain.values()}}
    a = tok.encode(" " + text, add_special_tokens=False)
    b = model.encode(text)
    pieces = [model.id_to_piece(i) for i in b]
    return (a.ids, [bytes(table[c] for c in t) for t in a.tokens],
            b, [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])


def linked(text):
    """Groups of one document: [(ids of A, ids of B)]."""
    if not text:
        return []
    a, bytes_a, b, bytes_b = tokens_of(text)
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    out, i, j, at_a, at_b, one, two = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a, one, i = at_a + len(bytes_a[i]), [*one, a[i]], i + 1
        else:
            at_b, two, j = at_b + len(bytes_b[j]), [*two, b[j]], j + 1
        if at_a == at_b:
            out.append((one, two))
            one, two = [], []
    return out


def test_alignment(spark, monkeypatch):
    rng = random.Random(8)
    words = "the cat sat running tokenization Überraschung naïve 12345 x.y don't 😀 漢字 ﬁ <|endoftext|> <s> <unk> ▁ \x85 á <0x41> '' zzzqqq".split(" ")
    texts = [(i, rng.choice([" ", "  ", "\n", "\t"]).join(rng.choice(words[:rng.choice([4, 12, len(words)])]) for _ in range(rng.choice([1, 3, 12, 60])))) for i in range(160)]
    texts += ODD[:7] + ODD[8:] + [(900, "x" * 3000), (901, "漢" * 400), (904, "9" * 5000 + "漢字" * 300), (902, " lead"), (903, "a▁b")]
    groups = [linked(t) for _, t in texts]
    counts, rows = Counter(), []
    for g in groups:
        counts.update({(x, y) for one, two in g for x in one for y in two})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    for (i, _), g in zip(texts, groups):
        links = [(x, y) for one, two in g for x in one for y in two]
        said = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in g)
        rows.append((i, sum(len(o) for o, _ in g), sum(len(t) for _, t in g), len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
                     hashlib.sha256(said.encode()).hexdigest() if g else ""))
    assert sum(not g for g in groups) >= 6 and any(len(o) > 1 and len(t) > 1 for g in groups for o, t in g)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    for send in (1 << 20, 5):
        monkeypatch.setattr(alignment, "SEND", send)
        got = alignment.align(docs(spark, texts), BYTE_BPE, PIECE_BPE).collect()
        assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)
    assert alignment.align(docs(spark, []), BYTE_BPE, PIECE_BPE).count() == 0


def test_alignment_groups_and_memory(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 3)
    r = alignment.aligned(docs(spark, [(1, "the cat sat tokenization on the cat")], 1), BYTE_BPE, PIECE_BPE, with_groups=True).first()
    assert r.groups == ";".join(",".join(map(str, o)) + "|" + ",".join(map(str, t)) for o, t in linked("the cat sat tokenization on the cat"))


def test_windows_of_many_tokens_count_pairs_once_each():
    aligner = alignment.Aligner(alignment.Vocabulary([b"x", b"xx"]), alignment.Vocabulary([b"xxx" * 50, b"x" * 151]))
    one, two = [0, 1] * 7000 + [0], [0] * 139 + [1]
    assert sum(1 + t for t in one) == 139 * 150 + 151
    _, (text, n, links, pairs, uses), _ = aligner.documents([[0] * 151, one, [0] * 151], [[1], two, [1]])
    groups = text.split(";")
    want = Counter()
    for g in groups:
        x, y = ([int(v) for v in side.split(",")] for side in g.split("|"))
        want.update((p << 32) + q for p in x for q in y)
    assert n == len(groups) and dict(zip(pairs.tolist(), uses.tolist())) == want and links == sum(want.values()) and max(len(g) for g in groups) > 50


def test_byte_level_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    rng = random.Random(12)
    signs = [chr(k) for k in range(256)] + ["'s", " the", "<|endoftext|>", "  ", "Ā", "漢", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(4000)]
    assert alignment.byte_level(BYTE_BPE)[0](texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
