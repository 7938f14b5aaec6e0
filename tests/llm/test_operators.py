"""Corpus operators on small tables against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import functools
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import common, decontaminate, exact, jaccard, language, licenses, line_dedup, packing, quality, secret_scan, token_files, tokens

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], SCHEMA)
    if extra:  # names that operators use themselves
        df = df.selectExpr("*", "1 as row", "'x' as kept", "2 as grp", "3 as n", "'y' as host", "4 as h", "5 as piece", "'z' as unit", "6 as _k_id")
    return df.repartition(3)


def docs(spark, texts):
    return table(spark, [(i, t, "en", "s") for i, t in texts])


ODD = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "x" * 70_000), (6, "a b " * 20_000), (7, "Ä ö ß 😀 é"), (7, "Ä ö ß 😀 é"), (8, "one two three")]


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


# ---- exact ----------------------------------------------------------------------------------------------------------------

def test_exact(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 3, 5, 200])))) for i in range(300)] + [(1000 + i, "long " * 900 + rng.choice("ab")) for i in range(20)]
    got = {r.doc_id: r for r in exact.exact_dedup(docs(spark, texts), first_block=2, growth=3).collect()}
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert len(got) == len(texts)
    for bare, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(members)[1], len(members), min(members)[1] == i, hashlib.sha256(bare.encode()).hexdigest())


def test_exact_odd(spark):
    rows = exact.exact_dedup(docs(spark, ODD)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == len(ODD) and by[1][0].group_size == 3 and by[3][0].kept and not by[1][0].kept
    assert [r.kept for r in by[7]] == [True, True] and by[7][0].group_size == 2 and by[None][0].kept
    assert exact.exact_dedup(docs(spark, [])).count() == 0


# ---- tokens ---------------------------------------------------------------------------------------------------------------

@functools.cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER)


def direct(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    encode = tokens.encoder(TOKENIZER)
    texts = ["It's a test, isn't it?", "ÀÉ ß x\x85y\x1cz", "á e\n\nb", "<|endoftext|> <|EndOfText|>x", "ΑΣ Σ", "İstanbul", "12,345.67!!", None, "", "  ", "漢字かな 123", "don't. Can't, we'll",
             "İ. İ, xİ. I\u0307. i\u0307!! é... e\u0301, ÿ; ÷. ß) ﬁ. ſ, ŉ. K. Å? a\u0338=. 3.) ...'s x.'s x'.s"]
    rng = random.Random(2)
    signs = "aZéÉİıßﬁſŉKÅ\u0301\u0307\u0338.,;:!?'<|>()=$09 \n\tΣς漢_-"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(6000)]
    want = [direct(t) for t in texts]
    for part in (1, 50, 7000):  # pieces come from the memory of the worker, from this batch or from the library
        at = 0
        while at < len(texts) and at < 100 * part:
            ids, bounds = encode(pa.array(texts[at:at + part], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want[at:at + part]
            at += part
    ids, bounds = encode(pa.array(texts, pa.string()).slice(5, 20))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want[5:25] and encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_packing(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "x", "gamma."]) for _ in range(rng.choice([0, 1, 40, 300, 900, 5000])))) for i in range(120)] + ODD
    got = packing.packed(docs(spark, texts), TOKENIZER).collect()
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(direct(t) + [0])
    for r in got:
        assert any(r.length == len(x[r.start:r.start + 2048]) and r.ids_crc32 == zlib.crc32(np.array(x[r.start:r.start + 2048], "<u4").tobytes()) for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = max(-(-sum(r.length for r in got) // 2048), sum(r.length > 1024 for r in got))
    assert len(bins) <= least * 1.05 + 1
    assert packing.packed(docs(spark, []), TOKENIZER).count() == 0
    made = packing.sequences(docs(spark, texts[:30]), TOKENIZER).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 2048 for r in made)


def test_plan_swaps_the_smallest_for_two():
    # greedy leaves 60 + 30 + (gap 10); 25 + 14 fill the gap of 40 better than 30
    plan = packing.plan({60: 1, 30: 1, 25: 1, 14: 1}, 100)
    assert (1, [(60, 1), (25, 1), (14, 1)]) in plan
    counts = {random.Random(1).randint(1, 99): k for k in range(1, 60)}
    used = defaultdict(int)
    for times, uses in packing.plan(counts, 100):
        assert sum(a * n for a, n in uses) <= 100
        for a, n in uses:
            used[a] += times * n
    assert used == counts


def test_token_files(spark):
    texts = [(i, f"text number {i} with some words, " * (i % 7)) for i in range(250)] + ODD
    shards = token_files.write(docs(spark, texts), TOKENIZER)
    got = token_files.read(spark, shards, with_ids=True).collect()
    want = sorted(((i is not None, i or 0, t is not None, t or "", np.array(direct(t) + [1], "<u4")) for i, t in texts), key=lambda x: x[:4])
    at = 0
    for r, (has, i, _, _, x) in zip(sorted(got, key=lambda r: r.start), want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if has else None, at, len(x), zlib.crc32(x.tobytes())) and r.ids == x.tobytes()
        at += len(x)
    assert len(got) == len(texts)
    path = next(r.path for r in shards.collect() if 33 in token_files.Shard(r.path).doc_ids)
    shard = token_files.Shard(path)
    assert [shard.ids(k).tolist() for k in shard.find(33)] == [direct(texts[33][1]) + [1]]
    with pytest.raises(ValueError):
        token_files.Shard(path, b"another dictionary")
    assert token_files.read(spark, token_files.write(docs(spark, []), TOKENIZER)).count() == 0


def test_token_files_have_a_dictionary_at_any_size(spark):
    for texts in ([(1, "one two three")], [(i, "the same words") for i in range(200)]):
        shards = token_files.write(docs(spark, texts), TOKENIZER)
        assert {r.dictionary for r in shards.collect()} != {hashlib.sha256(b"").hexdigest()}
        assert [r.n_tokens for r in token_files.read(spark, shards).collect()] == [len(direct(t)) + 1 for _, t in texts]


# ---- decontamination --------------------------------------------------------------------------------------------------------

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def contaminated(texts, items):
    windows = defaultdict(set)
    for item, t in items:
        w = words_of(t, WORD)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k:k + 13])].add(item)
    for i, t in texts:
        w = words_of(t, WORD)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        names = ",".join(sorted(map(str, found)))
        yield i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_chars", [4 << 20, 400])
def test_decontaminate(spark, block_chars):
    rng = random.Random(11)
    make = lambda n: [rng.choice(["a", "b", "c", "é"]) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(2, 25)] + [(1, None), (2, ""), (3, "..."), (5, "zz Only-Once yy")]
    texts = [(k, " ".join(make(rng.choice([0, 5, 60])) + [rng.choice(items)[1] or "" for _ in range(rng.choice([0, 1, 2]))])) for k in range(80)] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs(spark, texts), bench, block_chars=block_chars).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert rows == sorted((str(a), *rest) for a, *rest in contaminated(texts, items))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_decontaminate_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, ODD), none).collect())
    assert decontaminate.decontaminate(docs(spark, []), none, carry=True).count() == 0


def test_fm_index_against_scan():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in rng.integers(1, 40, 30)] * 2)
    index = decontaminate.FMIndex(x, 4)
    for n in (1, 2, 3, 5):
        phrases = np.array([rng.integers(1, 4, n) for _ in range(20)])
        who, low, high = index.search(phrases, np.full(20, n))
        for k in range(20):
            want = [i for i in range(len(x) - n + 1) if (x[i:i + n] == phrases[k]).all()]
            rows = np.concatenate([np.arange(a, b) for w, a, b in zip(who, low, high) if w == k] or [np.zeros(0, int)])
            assert sorted(index.locate(rows)) == want


# ---- near copies -----------------------------------------------------------------------------------------------------------

def linked(texts, k, percent):
    sets, parent = [], list(range(len(texts)))
    for _, t in texts:
        w = words_of(t, "[^\x20\x09-\x0d]+")
        sets.append({tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a in range(len(texts)):
        least[root(a)].append(-1 << 63 if texts[a][0] is None else texts[a][0])
    return sorted((str(texts[a][0]), len(sets[a]), min(least[root(a)])) for a in range(len(texts)))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, k, percent):
    rng = random.Random(k)
    common_words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(common_words) for _ in range(rng.choice([2, 30, 120]))] for _ in range(12)]
    texts = []
    for i in range(260):  # families whose members lie on both sides of the threshold, on a shared passage
        w = list(rng.choice(bases[:3] if i % 2 else bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(common_words)
        texts.append((i, " ".join(w + bases[4] * (i % 5 == 0))))
    texts += [t for t in ODD if t[0] is not None]
    got = jaccard.similar(docs(spark, texts), k, percent, group_rows=4, sketch_bits=12).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == linked(texts, k, percent)


def test_jaccard_odd(spark):
    got = jaccard.similar(docs(spark, [(None, "a b c d e f"), (5, "a  b c d E f"), (6, None), (6, "")])).collect()
    assert sorted((r.n_shingles, r.component_id or 0) for r in got) == [(0, 6), (0, 6), (2, 0), (2, 0)]
    assert jaccard.similar(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, rng.randrange(501, 900)) for _ in range(200)] + [(7, 7), (9, 3), (3, 9)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[9] == 3 and {v for k, v in got.items() if k >= 500} == {500}


# ---- licenses and lines ----------------------------------------------------------------------------------------------------

def test_licenses(spark):
    texts = [(1, "some words\nLicensed under the Apache License, version 2.0\nmore"), (2, "RELEASED under the MIT license"), (3, "the license of the house"),
             (4, "Released under\nthe MIT License."), (5, "x\n\nThis work is licensed\nunder the GNU General Public License, version 3.\n\ny"), *[(i + 10 if i else None, t) for i, t in ODD]]
    got = {r.doc_id: r for r in licenses.licenses(docs(spark, texts)).collect()}
    assert [got[i].license for i in (1, 2, 3, 4, 5)] == ["Apache-2.0", "MIT", None, "MIT", "GPL-3.0-only"]
    assert got[1].dice == 1.0 and all(got[i + 10].license is None for i, _ in ODD if i) and got[None].license is None
    assert licenses.licenses(docs(spark, [])).count() == 0 and licenses.licenses(docs(spark, texts), rows=[]).where("license is not null").count() == 0


def test_license_pair_counts(spark):
    rows = [("A", "a b a b a b"), ("B", "c d")]
    texts = [(1, "a b a b a b"), (2, "a b"), (3, "c d"), (4, "c d e")]
    got = {r.doc_id: (r.license, r.dice) for r in licenses.licenses(docs(spark, texts), rows, threshold=0.6).collect()}
    assert got == {1: ("A", 1.0), 2: (None, None), 3: ("B", 1.0), 4: ("B", pytest.approx(2 / 3))}


def test_line_dedup(spark):
    passage = "\n".join(f"shared line {i} of the passage" for i in range(30))
    long = "one very long line " * 15
    texts = [(1, "alpha\n" + passage + "\nomega"), (2, "beta\ngamma\n" + passage), (3, long), (4, "own\n" + long + "\nown too"), (5, "clean text\nof two lines"), *[(i + 10 if i else None, t) for i, t in ODD]]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert got[1].text == texts[0][1] and got[3].text == long and got[5].text == texts[4][1] and got[11].text is None
    assert got[2].n_removed_lines >= 24 and got[2].text.startswith("beta\ngamma") and got[4].text == "own\nown too"
    kept = [x for r in got.values() for x in (r.text or "").split("\n")]
    assert set(kept) >= set(passage.split("\n"))  # nothing is lost from the corpus
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_license_notices_name_one_license(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU %s Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    texts = [(1, "words\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (2, gpl % ("General", "2")), (3, gpl % ("Lesser General", "2.1")), (4, gpl % ("Library General", "2")),
             (5, gpl % ("Affero General", "3")), (6, "Licensed under CC BY-SA 4.0."), (7, "Licensed under CC BY 4.0."), (8, "Licensed under CC BY-NC-SA 4.0."), (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
             (10, "This work is licensed under a Creative Commons Attribution 3.0 International License."), (11, "This work is licensed under the GNU General Public License v3.")]
    got = {r.doc_id: r.licenses for r in licenses.licenses(docs(spark, texts), licenses.NOTICES, alike=True).collect()}
    assert got == {1: ["GPL-3.0-only"], 2: ["GPL-2.0-or-later"], 3: ["LGPL-2.1-or-later"], 4: ["LGPL-2.0-or-later"], 5: ["AGPL-3.0-or-later"], 6: ["CC-BY-SA-4.0"],
                   7: ["CC-BY-4.0"], 8: [], 9: ["CC-BY-NC-4.0", "MIT"], 10: [], 11: ["GPL-3.0-only"]}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_line_runs(spark, n):
    passage = [f"shared line {i} of a passage that is told again and again in many of the {i} documents of the whole corpus so that even two such lines have over fifty words" for i in range(n)]
    assert len(" ".join(passage).split()) > 50
    near = [[f"own line {k} {x} of document {d}" for x in range(2)] for d in range(12) for k in (0, 1)]
    texts = [(d, "\n".join(near[2 * d] + passage + near[2 * d + 1])) for d in range(12)]
    got = {r.doc_id: r for r in line_dedup.line_runs(docs(spark, texts)).collect()}
    assert got[0].text == texts[0][1] and got[0].n_removed_lines == 0
    assert all(got[d].text.split("\n") == near[2 * d] + near[2 * d + 1] and got[d].n_removed_lines == n and got[d].n_removed_chunks == 1 for d in range(1, 12))


def test_line_runs_overlap(spark):
    long = "one very long line " * 15
    texts = [(1, "a\nb\nc"), (2, "a\nb\ny"), (3, "x\nb\nc"), (4, "c\n\n\n\n"), (5, "\n\nb\n\n"), (6, long), (7, "own\n" + long + "\nown too"), *[(i + 10 if i else None, t) for i, t in ODD]]
    rows = line_dedup.line_runs(docs(spark, texts)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and [got[i].text for i in (1, 2, 3)] == ["a\nb\nc", "y", "x"]
    assert got[4].text == texts[3][1] and got[5].text == texts[4][1] and got[6].text == long and got[7].text == "own\nown too"
    assert got[11].text is None and all(got[i + 10].text == t for i, t in ODD if i)
    assert line_dedup.line_runs(docs(spark, [])).count() == 0


# ---- models ----------------------------------------------------------------------------------------------------------------

def tongue(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n)).capitalize() + "."


SYLLABLES = {"xx": ["ba", "lo", "mi"], "yy": ["sch", "un", "er"], "zz": ["que", "ción", "os"]}


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, tongue(rng, SYLLABLES[lang], rng.choice([3, 30, 80])), lang, "s") for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(400))]
    rows += [(1000 + k, t, None, "s") for k, t in enumerate(t for _, t in ODD)] + [(None, "que ción os", "zz", "s")]
    got = {r.doc_id: r for r in language.identify(table(spark, rows)).collect()}
    held = [(got[i].lang_pred == lang) for i, _, lang, _ in rows[:400] if got[i].held_out]
    assert len(held) > 50 and sum(held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows[:400])
    assert [got[1000 + k].lang_pred == "und" for k in range(4)] == [False, True, True, True] and got[1001].score == 0 and got[1001].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    bare = language.identify(table(spark, [(1, "words", None, "s")])).collect()
    assert bare[0].lang_pred == "und" and language.identify(table(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(500):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        text = tongue(rng, SYLLABLES["xx"], 60)
        text = text.upper().replace(" ", "!! ") if kind == "junk" else text + " you vile moron" * (kind == "toxic")
        rows.append((i, text, "en", "s0" if i % 3 else f"s{i % 17}"))
        if i % 4:
            marks.append((i, int(kind != "junk"), int(kind == "toxic")))
    kinds = {i: (q, t) for i, q, t in marks}
    odd = [(None if i is None else 2000 + i, t, None, None) for i, t in ODD]
    labels = spark.createDataFrame([*marks, (3, None, None), (None, 1, 0), (9999, 1, 0), marks[0]], "doc_id bigint, quality int, toxic int")
    got = [r for r in quality.classify(table(spark, rows + odd), labels).collect()]
    assert len(got) == len(rows) + len(odd)
    right = [r.kept == (kinds[r.doc_id] == (1, 0)) for r in got if r.doc_id in kinds]
    assert sum(right) / len(right) > 0.97
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.kept for r in quality.classify(table(spark, rows[:20]), none).collect())
    assert quality.classify(table(spark, []), labels).count() == 0


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "plain words here", "en", "good" if i < 60 else "lone") for i in range(61)]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table(spark, rows), none).collect()}
    assert got[60].path_junk == pytest.approx(got[0].path_junk, abs=0.05)


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


def test_secrets(spark):
    rng = random.Random(6)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = ["PassWord = \"%s\"" % code(12), "secret:short", "token=%s" % code(40), "api_key' : 'x.y-z_1234'", "AKIA" + "Q7" * 8, "AKIAshort", code(31), code(33), "toKen", "ſecret=abcdefghij", "words", "😀"]
    texts = [(i, " ".join([*(rng.choice(["plain", "text", "of", "words"]) for _ in range(30)), *rng.sample(parts, rng.choice([0, 1, 4]))])) for i in range(300)] + ODD
    got = secret_scan.digest(secret_scan.scan(docs(spark, texts))).collect()
    want = sorted((str(i), ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base(t or ""))) for i, t in texts)
    assert sorted((str(r.doc_id), ",".join(s for s in r.spans.split(",") if not s.startswith("crf"))) for r in got) == want
    assert sorted(r.base_sha256 for r in got) == sorted(hashlib.sha256(s.encode()).hexdigest() for _, s in want)
    assert secret_scan.scan(docs(spark, [])).count() == 0 and secret_scan.scan(docs(spark, ODD)).count() == len(ODD)


def test_pruned_decoding_is_viterbi():
    rng = np.random.default_rng(0)
    n = secret_scan.TYPES + 1
    model = {"own": rng.normal(0, 3, (n, 3)), "before": rng.normal(0, 1, (n, 3)), "after": rng.normal(0, 1, (n, 3)), "move": rng.normal(0, 1, (3, 3)), "file": [rng.normal(0, 1, (s, 3)) for s in secret_scan.FILE_BINS]}
    model["own"][:, 0] += 3
    for _ in range(60):
        types = rng.integers(0, n - 1, rng.integers(1, 60))
        x = np.concatenate([[n - 1], types, [n - 1]])
        e = model["own"][x[1:-1]] + model["before"][x[:-2]] + model["after"][x[2:]] + sum(f[0] for f in model["file"])
        assert (secret_scan.decode(types, (0, 0, 0), model) == secret_scan.viterbi(e, model["move"])).all()


def test_field_learns_what_patterns_miss(spark):
    rng = random.Random(2)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, " ".join(rng.choice(["plain", "text", "of", "words"]) for _ in range(40)) + (f" {code(rng.choice([33, 36, 40, 45]))} end" if i % 3 == 0 else "")) for i in range(300)]
    model = secret_scan.train(docs(spark, texts))
    types_of = secret_scan.tokenizer()
    for text, want in (("plain words of text " * 10 + code(31) + " end", [41]), (texts[0][1], [41]), (texts[1][1], []), ("plain words " * 30, [])):
        path = secret_scan.decode(types_of(pa.array([text]))[0], secret_scan.file_features(text), model)
        assert [i + 1 for i in np.flatnonzero(path)] == want


def test_token_types_by_shape():
    rng = random.Random(3)
    parts = ["secret", "Token=", "AKIA", "key", "abc", "ÀÉ", "é", "漢", "ª", "²", "\u0660", "Ab.c-d", "=", "_", "ſ", "\x85", "\u2003", " ", "\n", "9f", "\"", ":", "x/y+z", "K", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)]
    types, bounds = secret_scan.tokenizer()(pa.array([None, *texts]))
    assert bounds[1] == 0
    for text, a, b in zip(texts, bounds[1:], bounds[2:]):
        assert types[a:b].tolist() == [secret_scan.token_type(t) for t in secret_scan.TOKEN.findall(text)], text


def test_batch_decoding_equals_single_texts():
    rng = np.random.default_rng(1)
    n = secret_scan.TYPES + 1
    model = {"own": rng.normal(0, 3, (n, 3)), "before": rng.normal(0, 1, (n, 3)), "after": rng.normal(0, 1, (n, 3)), "move": rng.normal(0, 1, (3, 3)), "file": [rng.normal(0, 1, (s, 3)) for s in secret_scan.FILE_BINS]}
    texts = [rng.integers(0, n - 1, k) for k in (0, 3, 0, 0, 50, 1, 1, 7, 0)]
    bounds = np.cumsum([0, *map(len, texts)])
    files = np.array([[rng.integers(0, s) for s in secret_scan.FILE_BINS] for _ in texts])
    want = [secret_scan.viterbi(sum((model["own"][t], model["before"][np.append(n - 1, t[:-1])], model["after"][np.append(t[1:], n - 1)])) + sum(m[i] for m, i in zip(model["file"], f)), model["move"])
            for t, f in zip(texts, files) if len(t)]
    assert secret_scan.decode_all(np.concatenate(texts), bounds, files, model).tolist() == np.concatenate(want).tolist()


def test_training_sample_leaves_out_rows_without_id_and_finds_rare_secrets(spark):
    plain = [(i, "plain words of text " * 4) for i in range(2000)]
    rows = plain + [(None, "token=0123456789abcdef")] * 900 + [(5000, "token=0123456789abcdef")]
    got = secret_scan.windows(docs(spark, rows), 20, 5).toArrow()
    marked = [y for y in got["labels"].to_pylist() if any(y)]
    assert len(marked) == 1 and got.num_rows < 200
    assert secret_scan.train(docs(spark, rows), 20) is not None
    assert secret_scan.train(docs(spark, plain + [(None, "token=0123456789abcdef")]), 20) is None


def test_license_of_repeated_rows(spark):
    text = " ".join(licenses.TEMPLATES[4][1].split()[:-16])
    once = licenses.licenses(docs(spark, [(1, text)])).first()
    for alike in (False, True):
        got = licenses.licenses(docs(spark, [(1, text)] * 3 + [(2, text), (None, text), (None, text)]), alike=alike).collect()
        assert len(got) == 6 and {r.dice for r in got} == {once.dice} and once.license == "MIT"


def test_line_runs_of_a_long_text(spark):
    rng = random.Random(4)
    shared = [f"shared line {k}" for k in range(5)]

    def text(n):
        lines = [f"own line {rng.random()}" for _ in range(n)]
        for at in range(0, n, 50):
            lines[at:at + 2] = shared[at % 3:at % 3 + 2]
        return lines

    took = []
    for n in (16_000, 64_000):
        rows = [(i, text(n)) for i in range(2)]
        start = time.time()
        got = {r.doc_id: r for r in line_dedup.line_runs(docs(spark, [(i, "\n".join(x)) for i, x in rows])).collect()}
        took.append(time.time() - start)
        seen, want = set(), {}
        for i, lines in rows:
            gone = set()
            for k in range(len(lines) - 1):
                pair = lines[k], lines[k + 1]
                if pair in seen:
                    gone |= {k, k + 1}
                seen.add(pair)
            want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert {i: r.text for i, r in got.items()} == want and got[1].n_removed_chunks == n // 50
    assert took[1] < 4 * took[0] + 5


def test_encoder_gives_the_library_ids_across_its_memory():
    """Pieces with marks at the end, repeated over several texts, parts and generations of the memory."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from tallyproof.llm import tokens as K
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, store = Tokenizer.from_file(path), K.worker_store()
    kept = store.pop(("encoder", path), None)
    encode = K.encoder(path, cache_pieces=6)
    texts = ["Alpha, beta. alpha,beta... (x) é9! <|endoftext|> a<|b, c-d' e'' \t,tab　!", "", None, ",", "word" * 30 + "; end.", "alpha, gamma; beta? 12,345.6!", "naïve?! ÀÉ. ß; ÿ- Ā!"]
    for part in (texts, texts[::-1], ["Alpha, beta? " * 3] * 2, [None]):
        ids, bounds = encode(pa.array(part, pa.string()))
        for text, low, high in zip(part, bounds, bounds[1:]):
            assert ids[low:high].tolist() == tok.encode(text or "", add_special_tokens=False).ids
    store.pop(("encoder", path))
    if kept:
        store["encoder", path] = kept
