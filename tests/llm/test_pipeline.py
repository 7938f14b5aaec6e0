"""The corpus pipeline, stage by stage, against brute force: each stage on what the stage before kept."""

import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "row kept gone group_size component_id start length _k_id _k_row doc piece host path".split()
LOWER = {c: c + 32 for c in range(65, 91)}


def folder(spark, rows, labels, items):
    sf = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], SCHEMA)
    docs.selectExpr("*", *(f"{k} as {name}" for k, name in enumerate(EXTRA))).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    return sf


def exact(docs):
    """Of texts equal but for white space the longest, then the smallest id (null first); one of repeated rows."""
    best = {}
    for i, t, *_ in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        place = (-len(t or ""), i is not None, i or 0)
        best[key] = min(best.get(key, place), place)
    out = {(i, t or "") for i, t, *_ in docs if best[re.sub(r"[\x20\x09-\x0D]", "", t or "")] == (-len(t or ""), i is not None, i or 0)}
    return out


def near(docs):
    """One of each component of texts whose sets of five-word shingles reach 0.8."""
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i, t] = {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[k:k + 5]) for k in range(len(w) - 4)}
    keys, parent = list(sets), {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda k: (k[0] is not None, k[0] or 0))
                parent[y] = x
    return {(i, t or "") for i, t in keys if find((i, t))[0] == i}


def clean(docs, items):
    """Documents of which less than one word in twenty lies in a window of an item."""
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    words = lambda t: re.findall(pattern, (t or "").translate(LOWER))
    windows = defaultdict(set)
    for _, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k:k + n]))
    out = set()
    for i, t, *_ in docs:
        w = words(t)
        hit = {p for n, known in windows.items() for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in known for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.add((i, t or ""))
    return out


def packs(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(30)) for k in range(4)] + [(10, "short item"), (11, None), (12, ""), (None, text(14)), (2, text(13))]
    rows, labels = [], []
    for i in range(240):
        bad = rng.choice([None, None, None, "junk", "toxic"])
        t = text(rng.choice([30, 60, 90]))
        if bad:
            t = t.upper().replace(" ", "!! ") if bad == "junk" else t + " you vile moron" * 3
        elif i % 10 == 0:
            t += " " + rng.choice(items[:4])[1]
        rows.append((i, t, "en", f"s{i % 3}"))
        if i % 3:
            labels.append((i, int(bad != "junk"), int(bad == "toxic")))
    good = [r for r in rows if "!!" not in r[1] and "moron" not in r[1]]
    for k in range(40):  # exact copies with other blanks, and near copies
        i, t, *_ = rng.choice(good)
        words = t.split()
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, (" " if k % 2 else "  ").join(words), "en", "s0"))
    rows += [(None, text(40), "en", "s1"), (None, None, None, None), (2000, None, "en", "s1"), (2001, "", None, "s1"), (2002, " \n", "en", None), (2003, text(3000), "en", "s1")]
    rows += [rows[5], rows[5], (2000, None, "en", "s1"), (7, "another text of a repeated id", "en", "s0")]
    sf = folder(spark, rows, [*labels, labels[0], (None, 1, 0), (9999, 0, 1), (3, None, None)], items)
    docs, names = spark.read.parquet(f"{sf}/documents.parquet"), None
    before = list(rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text or "") for r in out.collect()]
        kinds = {i: (q, t) for i, q, t in labels}
        if name == "quality":  # clean documents stay, labelled bad ones go, no row is made or doubled
            assert set(got) <= {(i, t or "") for i, t, *_ in before} and len(set(got)) == len(got)
            kept = {i for i, _ in got}
            right = [(i in kept) == (kinds[i] == (1, 0)) for i in kinds]
            assert sum(right) / len(right) > 0.97
        else:
            want = {"exact_copies": lambda: exact(before), "near_copies": lambda: near(before), "benchmark_passages": lambda: clean(before, items)}[name]()
            assert Counter(got) == Counter(want), name
            assert len(want) < len(before), name
        before = [(i, t) for i, t in got]
        docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in got], SCHEMA).selectExpr("*", *(f"{k} as {x}" for k, x in enumerate(EXTRA)))
        names = name
    packs(pipeline.STAGES[-1][1](spark, docs, sf).collect(), before)
    assert names == "benchmark_passages"


def test_run_is_its_stages_and_takes_empty_tables(spark):
    texts = [(i, f"plain words of document number {i} " * (1 + i % 3), "en", "s") for i in range(12)] + [(None, None, None, None)]
    sf = folder(spark, texts + texts[:2], [], [])
    rows = pipeline.run(spark, sf).collect()
    left = {(r.doc_id, r.piece) for r in rows}
    assert (0, 0) in left and all(p == 0 for _, p in left)
    packs(rows, [t for t in {(i, t or "") for i, t, *_ in texts} if (t[0], 0) in left])
    empty = folder(spark, [], [], [])
    assert pipeline.run(spark, empty).count() == 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0
