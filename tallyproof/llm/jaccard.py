"""Join of documents by Jaccard similarity of their word n-grams, with a token-group matrix.

Equal sets form one class. Similar classes are gathered into groups of bounded size; the matrix holds the union of each
group's tokens, folded to bits. A query class meets only groups that share one of its prefix tokens (any two similar sets do) and whose
sizes allow a match. Every bit of the query that the group lacks is a token no member has, which bounds the overlap
with all of them; only groups whose bound reaches the threshold are opened. There the bound is taken once more with
the tokens themselves, and members are counted exactly.

* Tokens are ordered by a frequency sketch, rare ones first, so that passages, lines and phrases many documents share
  stay out of the prefixes. The order decides only the cost: any order gives the same links.
* A family is the documents that share prefix tokens with its most central member. Links to that member are found
  first. What they connect needs no further comparison, so groups whose members are already connected with the query are left out.
* Queries of one group are streamed past it in slices; a task holds one group at a time.

Components need not list every link between members that are connected already, so the work for a family of
copies follows its size, not its square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import components, small_batches, stored

WORDS, PERCENT = 5, 80
#: Classes in a group, queries in a slice, buckets of the frequency sketch (two to this power).
GROUP_ROWS, SLICE_ROWS, SKETCH_BITS = 64, 512, 20
#: Long words of bits to which the tokens of a class, and their union over a group, are folded.
FOLD = 16
BITS = [f"b{i}" for i in range(FOLD)]
NO_ID = -(1 << 63)
GOLDEN = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]


def tokens_of(text: str | None, n_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; a text of fewer words is one n-gram, one without words has none."""
    if not text:
        return np.zeros(0, np.uint64)
    from xxhash import xxh3_64_intdigest

    w = np.array(list(map(xxh3_64_intdigest, text.encode("utf-8", "replace").lower().split())), np.uint64)
    if not len(w):
        return w
    k = min(n_words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i:len(w) - k + 1 + i]) * np.uint64(GOLDEN[0])
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(GOLDEN[1])
    return np.unique(h ^ (h >> np.uint64(31)))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))


def sets(base: DataFrame, n_words: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, row, n, mark)`` of every document, and a level of frequency for each sketch bucket."""
    chunk = 1 << 12

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            sizes, marks, pending = [], [], []
            for text in batch.column(2):
                t = tokens_of(text.as_py(), n_words)
                sizes.append(len(t))
                marks.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                pending.append(t >> np.uint64(64 - bits))
            if pending:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=1 << bits)
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), *none],
                                             ["doc_id", "row", "n", "mark", "part", "counts"])
        for part in range(len(counts) // chunk):
            own = counts[part * chunk:(part + 1) * chunk]
            if own.any():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "row": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "mark": pa.nulls(1, pa.binary()),
                                                  "part": pa.array([part], pa.int32()), "counts": pa.array([own.astype("<u4").tobytes()], pa.binary())})

    def add(batches):
        total = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())})

    made = stored(base.mapInArrow(run, "doc_id bigint, row bigint, n bigint, mark binary, part int, counts binary"), "jaccard-sets")
    counts = np.zeros(1 << bits)
    for r in made.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect():
        counts[r.part * chunk:(r.part + 1) * chunk] = np.frombuffer(r.counts, "<i8")
    levels = np.floor(2 * np.log2(1 + counts / max(counts.mean(), 1e-9)))
    return made.where("part is null").select("doc_id", "row", "n", "mark"), np.minimum(levels, 255).astype(np.uint8)


def prefixes(base: DataFrame, levels: np.ndarray, n_words: int, percent: int) -> DataFrame:
    """``(doc_id, row, n, centre, prefix, folded)``: the rarest tokens, as many as hold one of every similar set, in order, how frequent the tokens are on average, and all of them as bits."""
    shared, shift = base.sparkSession.sparkContext.broadcast(levels), np.uint64(64 - int(len(levels) - 1).bit_length())

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2):
                t = tokens_of(text.as_py(), n_words)
                level = shared.value[(t >> shift).astype(np.int64)]
                most = len(t) - (percent * len(t) + 99) // 100 + 1 if len(t) else 0
                fold = np.zeros(64 * FOLD, bool)
                fold[(t % np.uint64(64 * FOLD)).astype(np.int64)] = True
                out.append((len(t), float(level.mean()) if len(t) else 0.0, t[np.lexsort((t, level))[:most]].view(np.int64), np.packbits(fold).view(np.int64)))
            n, centre, prefix, folded = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(centre, pa.float64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(folded, pa.list_(pa.int64()))],
                                             ["doc_id", "row", "n", "centre", "prefix", "folded"])

    return base.mapInArrow(run, "doc_id bigint, row bigint, n bigint, centre double, prefix array<bigint>, folded array<bigint>")


def lacks(other: str) -> Column:
    """How many bits of a row the bits with this prefix lack: at least so many of its tokens are not there."""
    return sum((F.bit_count(F.col(b).bitwiseAND(F.bitwise_not(F.col(f"{other}{b}")))) for b in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseAND(F.bitwise_not(F.col(f"{other}{BITS[0]}")))))


def open_groups(members: DataFrame, queries: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` of queries ``(gid, cls, comp)`` with members ``(gid, cls, comp)`` of the same group: for each
    query one link with each component of the group that is not its own. Groups are of bounded size, queries are not
    and come in slices, so each group is sent once for each slice."""
    slices = queries.groupBy("gid").agg(F.count("*").alias("n")).select("gid", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
    slices = stored(slices, "jaccard-slices")
    left = members.join(slices.hint("merge"), "gid").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = queries.join(slices.hint("merge"), "gid").withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    rows = left.select("gid", "slice", F.lit(0).alias("query"), "cls", "comp").union(right.select("gid", "slice", F.lit(1).alias("query"), "cls", "comp"))
    rows = rows.join(texts.hint("merge"), "cls").select("gid", "slice", "query", "cls", "comp", "text")
    rows = rows.repartition("gid", "slice").sortWithinPartitions("gid", "slice", "query", "cls")

    def run(batches):
        now, members, union, owner, row = None, [], None, None, None
        for batch in batches:
            links = []
            for gid, slice_, query, cls, comp, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (gid, slice_) != now:
                    now, members, union = (gid, slice_), [], None
                t = tokens_of(text, n_words)
                if not query:
                    members.append((cls, comp, t))
                    continue
                if not members:
                    continue
                if union is None:
                    flat = np.concatenate([m[2] for m in members])
                    order = np.argsort(flat, kind="stable")
                    union, start = np.unique(flat[order], return_index=True)
                    start = np.append(start, len(flat))
                    owner = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])[order]
                    sizes = np.array([len(m[2]) for m in members])
                    ids, comps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
                at = np.searchsorted(union, t)
                at = at[union[np.minimum(at, len(union) - 1)] == t]
                if 100 * len(at) < percent * len(t):  # bound: no member can reach the threshold
                    continue
                reach = start[at + 1] - start[at]
                hits = owner[np.repeat(start[at], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)]
                both = np.bincount(hits, minlength=len(members))
                good = np.flatnonzero((100 * both >= percent * (sizes + len(t) - both)) & (comps != comp) & (ids != cls))
                if len(good):
                    links += [(cls, int(ids[g])) for g in good[np.unique(comps[good], return_index=True)[1]]]
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stored(rows.mapInArrow(run, "a bigint, b bigint"), "jaccard-links")


def similar(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, group_rows: int = GROUP_ROWS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``(doc_id, row, n_shingles, component_id)``, one row per row of ``docs``; ``row`` hashes the text.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of ``n_words``-word n-grams
    (lower-cased A-Z, words parted by white space). ``component_id`` is the smallest ``doc_id`` reachable by links. A
    text without words, or null, is linked with nothing. A null ``doc_id`` counts as the smallest. Rows that repeat a
    ``doc_id`` are rows of their own with that id. N-grams are compared by 64-bit hashes, sets of equal documents by
    128-bit ones. All links that decide a component are found whatever the sizes of groups and families.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = keyed(docs)
    marked, levels = sets(base, n_words, sketch_bits)
    classes = marked.where("n > 0").groupBy("mark", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = stored(classes.select("mark", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), F.monotonically_increasing_id().alias("cls")), "jaccard-classes")

    own = prefixes(base, levels, n_words, percent).join(classes.select("doc_id", "row", "cls").hint("merge"), ["doc_id", "row"])
    own = stored(own.select("cls", "n", "centre", "prefix", *[F.get("folded", F.lit(i)).alias(b) for i, b in enumerate(BITS)]), "jaccard-prefixes")
    tokens = own.select("cls", "n", "centre", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.withColumn("rest", F.col("n") - F.col("pos")).drop("pos")
    met = tokens.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"),
                                      F.max_by(F.struct("cls", "n", "rest"), "centre").alias("leader"))
    met = met.where("low < high").select("token", F.col("leader.cls").alias("leader"), F.col("leader.n").alias("g_low"), F.col("leader.rest").alias("g_rest"))
    tokens = stored(tokens.drop("centre").join(met.hint("merge"), "token"), "jaccard-shared")
    # sizes and what is left after the token must allow a match; the first token a similar pair shares passes
    able = ((100 * F.col("g_low") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("g_low"))
            & (F.least("rest", "g_rest") >= (F.col("n") + F.col("g_low")) * percent / (100 + percent)))
    votes = tokens.groupBy("cls", "leader").agg(F.count_if(able).alias("votes"))
    bits = own.select("cls", "n", *BITS)
    heads = bits.select(F.col("cls").alias("leader"), F.col("n").alias("g_low"), *[F.col(b).alias(f"g_{b}") for b in BITS])
    star = votes.where("votes > 0 and cls <> leader").join(bits.hint("merge"), "cls").join(heads.hint("merge"), "leader")
    star = stored(star.where(F.col("n") - lacks("g_") >= (F.col("n") + F.col("g_low")) * percent / (100 + percent)).select("cls", "leader"), "jaccard-star")
    # every class that shares a prefix token: its family is the leader it shares most tokens with, or itself
    own_leader = F.struct("votes", -F.col("leader"))
    family = votes.groupBy("cls").agg(F.max_by("leader", own_leader).alias("family"), F.max("votes").alias("votes"))
    family = stored(family.select("cls", F.when(F.col("votes") > 0, F.col("family")).otherwise(F.col("cls")).alias("family")), "jaccard-families")
    texts = base.join(family.select("cls").join(classes.select("cls", "doc_id", "row"), "cls").hint("merge"), ["doc_id", "row"])
    texts = stored(texts.select("cls", "text"), "jaccard-texts")

    star = star.select(F.col("leader").alias("gid"), "cls", F.col("cls").alias("comp"))
    heads = star.select("gid").distinct().select("gid", F.col("gid").alias("cls"), F.col("gid").alias("comp"))
    links = open_groups(heads, star, texts, n_words, percent)

    comps = components(links).withColumnRenamed("id", "cls").withColumnRenamed("root", "comp")
    placed = family.join(comps.hint("merge"), "cls", "left").select("cls", "family", F.coalesce("comp", "cls").alias("comp"))
    heads = placed.select(F.col("cls").alias("family"), F.col("comp").alias("head"))
    placed = placed.join(heads.hint("merge"), "family", "left").withColumn("inner", F.coalesce(F.col("comp") == F.col("head"), F.lit(False)))
    parts = placed.groupBy("family", "inner").agg(F.ceil(F.count("*") / group_rows).alias("parts"))
    placed = placed.join(parts.hint("merge"), ["family", "inner"])
    gid = F.xxhash64("family", "inner", F.pmod(F.xxhash64("cls"), F.col("parts")))
    placed = stored(placed.select("cls", "comp", gid.alias("gid")), "jaccard-groups")

    mixed = tokens.select("token", "cls", "n", "rest").join(placed.hint("merge"), "cls")
    many = mixed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    mixed = stored(mixed.join(many.hint("merge"), "token", "left_semi"), "jaccard-mixed")
    matrix = mixed.groupBy("token", "gid").agg(
        F.min("n").alias("g_low"), F.max("n").alias("g_high"), F.max("rest").alias("g_rest"), F.min("comp").alias("c_low"), F.max("comp").alias("c_high"))
    matrix = matrix.withColumnRenamed("gid", "g_gid").withColumnRenamed("token", "g_token")
    need = (F.col("n") + F.col("g_low")) * percent / (100 + percent)
    meets = ((F.col("token") == F.col("g_token")) & (F.col("gid") >= F.col("g_gid"))
             & ~((F.col("c_low") == F.col("comp")) & (F.col("c_high") == F.col("comp")))
             & (100 * F.col("g_high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("g_low"))
             & (F.least("rest", "g_rest") >= need))
    asked = mixed.join(matrix.hint("merge"), meets).select(F.col("g_gid").alias("gid"), "cls", "comp").distinct()
    union = placed.join(bits.hint("merge"), "cls").groupBy("gid").agg(*[F.bit_or(b).alias(f"g_{b}") for b in BITS])
    asked = asked.join(bits.hint("merge"), "cls").join(union.hint("merge"), "gid").where(100 * (F.col("n") - lacks("g_")) >= percent * F.col("n"))
    asked = stored(asked.select("gid", "cls", "comp"), "jaccard-queries")
    more = open_groups(placed.join(asked.select("gid").distinct().hint("merge"), "gid").select("gid", "cls", "comp"), asked, texts, n_words, percent)

    roots = components(links.union(more)).withColumnRenamed("id", "cls")
    named = classes.join(roots.hint("merge"), "cls", "left").select("mark", "doc_id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least.hint("merge"), "root").select("mark", "component_id"), "jaccard-components")
    out = marked.join(named.hint("merge"), "mark", "left")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("doc_id").alias("doc_id"), "row", F.col("n").alias("n_shingles"),
                      F.nullif(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")), F.lit(NO_ID)).alias("component_id"))
