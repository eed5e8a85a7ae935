"""N-gram Jaccard join through token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct five-word shingles. Two documents link when
their Jaccard similarity reaches the threshold; the result is one row per document with its component.

1. Sieve. A linked document shares at least threshold * n of its tokens with other documents. Chunks of
   documents send each of their tokens once, packed and dealt by hash, to buckets that find those of two
   documents or more (what documents of one chunk share the chunk knows itself); only counts per document
   come back. Documents below the bound are alone. Documents with the same set of tokens count as one from
   here on.
2. Prefixes. Tokens are ordered by the number of documents that have them. The prefix of a document of n
   tokens holds its first n - ceil(threshold * n) + 1; linked documents share a token of their prefixes,
   and with prefixes extended by one, two tokens. Tokens of one document only come first and need no index.
   Rare tokens (in RARE documents at most) of the extended prefixes are indexed one by one, and the pairs
   in their buckets, whose number RARE bounds, are verified. Frequent tokens are indexed as combinations of
   two where documents are short enough (COMBINE tokens) for that to stay small; longer documents' frequent
   tokens are indexed singly; documents near the limit are in both, so no linked pair falls between.
3. Families. Documents that meet in frequent buckets form families. No pairs of a family are written
   out. Its members are dealt into blocks by size class, so wide that linked documents are at most one class
   apart; each block is compared with a few pivots of its own and the next classes, and
   then only members that are not yet connected to one another, in blocks, by counting common tokens.
4. Components of all verified links.

Hashes stand for shingles: two different shingles are taken for equal with probability 2**-64.
Defined results: null, empty and blank texts have no tokens, n_shingles 0 and are their own component;
a text of fewer words than a shingle has its whole sequence as one; rows of one doc_id are one document
with any of their links, and each row is returned; rows without a doc_id link with nothing and have no component; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm import bytehash
from sheetwise.llm.shared import components, join_small, materialise, release, trim

SHINGLE = 5
PERCENT = 80
RARE = 16
COMBINE = 128
BLOCK = 512
PIVOTS = 8
CHUNK_TOKENS = 500_000
CHUNK_DOCS = 60_000
MANY = 0xFFFF  # stands for several owners of one chunk
BUCKET_TOKENS = 500_000
PIECE_BYTES = 1 << 21


def token_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts are data[offsets[i]:offsets[i + 1]]."""
    out = []
    for i, j in bytehash.pieces(offsets, PIECE_BYTES):
        base = offsets[i]
        # A space after every text keeps words apart.
        own = np.insert(data[base : offsets[j]], offsets[i + 1 : j + 1] - base, 32)
        ends = offsets[i + 1 : j + 1] - base + np.arange(j - i)
        own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
        solid = ~((own == 32) | ((own >= 9) & (own <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        words = bytehash.spans(bytehash.prefix(own), lo, hi)
        first = np.searchsorted(lo, np.concatenate([[0], ends]))
        multiplier, rolled = np.uint64(0xD6E8FEB86659FD93), np.zeros(max(0, len(words) - shingle + 1), np.uint64)
        for k in range(shingle if len(words) >= shingle else 0):
            rolled = rolled * multiplier + words[k : k + len(rolled)]
        rolled = bytehash.mix(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= shingle:
                out.append(np.unique(rolled[a : b - shingle + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    short = short * multiplier ^ w
                out.append(bytehash.mix(short))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _chunks(batches, bits: int) -> Iterator:
    """(key, chunk, payload): for each bucket the chunk's tokens with their owners; under key -1 - chunk its documents."""
    import pyarrow as pa

    task, number = TaskContext.get().partitionId(), 0
    ids, sets, held = [], [], 0

    def flush():
        nonlocal number, ids, sets, held
        chunk = (task << 24) | number
        number += 1
        n = np.array([len(s) for s in sets], np.uint32)
        short, owners = np.concatenate(sets) >> np.uint64(32 - bits), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
        order = np.argsort(short)
        short, owners = short[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(short)))
        inside = np.bincount(owners[np.repeat(many > 1, many)], minlength=len(sets))
        own = np.where(many > 1, MANY, owners[first]).astype("<u2")
        keys, at = np.unique((short[first] >> np.uint64(32)).astype(np.int64), return_index=True)
        rest = (short[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
        at = [*at, len(first)]
        digests = b"".join(hashlib.md5(s.tobytes()).digest() for s in sets)
        rows = [(int(k), chunk, rest[a:b].tobytes() + own[a:b].tobytes()) for k, a, b in zip(keys, at[:-1], at[1:], strict=True)]
        rows.append((-1 - chunk, chunk, np.array(ids, "<i8").tobytes() + n.astype("<u4").tobytes() + inside.astype("<u4").tobytes() + digests))
        ids, sets, held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "chunk", "payload"])

    for b in batches:
        data, offsets = bytehash.column(b.column(1))
        names = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in bytehash.pieces(offsets, PIECE_BYTES):
            for name, s in zip(names[i:j], token_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                ids.append(name)
                sets.append(s)
                held += len(s)
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flush()
    if ids:
        yield flush()
    trim()


def _common(f: pd.DataFrame) -> pd.DataFrame:
    """A bucket: how many of each document's tokens another chunk has too, packed by chunk. Documents pass through."""
    if f.key.iloc[0] < 0:
        return f[["chunk", "key", "payload"]].rename(columns={"key": "kind"})
    rest, owner, chunk = [], [], []
    for n, p in enumerate(f.payload):
        m = len(p) // 6
        rest.append(np.frombuffer(p, "<u4", m))
        owner.append(np.frombuffer(p, "<u2", m, 4 * m))
        chunk.append(np.full(m, n, np.int32))
    rest, owner, chunk = map(np.concatenate, (rest, owner, chunk))
    order = np.argsort(rest, kind="stable")
    same = rest[order][1:] == rest[order][:-1]
    hit = np.zeros(len(rest), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    hit &= owner != MANY
    key, n = np.unique((chunk[hit].astype(np.int64) << 16) | owner[hit], return_counts=True)
    at = np.searchsorted(key, np.arange(len(f) + 1, dtype=np.int64) << 16)
    del rest, owner, chunk, order, same, hit
    trim()
    rows = [(c, 0, (key[a:b] & 0xFFFF).astype("<u2").tobytes() + n[a:b].astype("<u4").tobytes()) for c, a, b in zip(f.chunk, at[:-1], at[1:], strict=True) if b > a]
    return pd.DataFrame(rows, columns=["chunk", "kind", "payload"])


def _counted(f: pd.DataFrame) -> pd.DataFrame:
    """A chunk: doc_id, n, digest and number of shared tokens of its documents."""
    p = next(p for k, p in zip(f.kind, f.payload, strict=True) if k < 0)
    m = len(p) // 32
    shared = np.frombuffer(p, "<u4", m, 12 * m).astype(np.int64)
    for k, q in zip(f.kind, f.payload, strict=True):
        if k >= 0:
            c = len(q) // 6
            shared[np.frombuffer(q, "<u2", c)] += np.frombuffer(q, "<u4", c, 2 * c)
    digests = [p[16 * m + 16 * i : 16 * m + 16 * (i + 1)] for i in range(m)]
    return pd.DataFrame({"doc_id": np.frombuffer(p, "<i8", m), "n": np.frombuffer(p, "<u4", m, 8 * m).astype(np.int64), "digest": digests, "shared": shared})


def sieve(d: DataFrame) -> DataFrame:
    """doc_id, n, digest, shared for each row of d (doc_id, text as binary)."""
    total = d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(4, int(np.ceil(np.log2(max(1, total / 6 / BUCKET_TOKENS)))))
    packed = d.mapInArrow(lambda b: _chunks(b, bits), "key long, chunk long, payload binary")
    common = packed.groupBy("key").applyInPandas(_common, "chunk long, kind long, payload binary")
    return common.groupBy("chunk").applyInPandas(_counted, "doc_id long, n long, digest binary, shared long")


def _sets(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        data, offsets = bytehash.column(b.column(1))
        for i, j in bytehash.pieces(offsets, PIECE_BYTES):
            sets = token_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
            tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(digests, pa.binary()), tokens], names=["doc_id", "digest", "tokens"])
    trim()


def _least(n: Column, percent: int) -> Column:
    """ceil(percent / 100 * n): the least overlap of a document of n tokens with one that it links to."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


class _Counter:
    """Overlaps between rows of two lists of sorted token arrays, by counting."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.rows = flat[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Number of common tokens of s with each set."""
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.rows[at], minlength=len(self.n))


def _compare(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Queries (left) against a block (right), both with rep, n, label, tokens: a link to each label that a query reaches."""
    a, b = [], []
    if len(left) and len(right):
        block, names, n, label = _Counter([np.asarray(t) for t in right.tokens]), right.rep.to_numpy(), right.n.to_numpy(), right.label.to_numpy()
        for rep, m, own, tokens in zip(left.rep, left.n, left.label, left.tokens, strict=True):
            hit = np.flatnonzero(_linked(block.overlaps(np.asarray(tokens)), m, n, percent) & (label != own))
            _, first = np.unique(label[hit], return_index=True)
            a += [rep] * len(first)
            b += list(names[hit[first]])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _families(frequent: DataFrame) -> DataFrame:
    """(key, rep) -> (rep, family): members of one bucket are of one family."""
    first = frequent.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("_m")).filter("_m > 1").select("key", "a")
    edges = frequent.join(first, "key").select("a", F.col("rep").alias("b")).filter("a <> b")
    return components(edges).select(F.col("v").alias("rep"), F.col("label").alias("family"))


def links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): doc_id, n per row; doc_id, rep for documents that may link; verified links a, b between representatives."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = materialise(sieve(d.filter("doc_id is not null")), "jaccard-rows")
    release(spark)
    able = rows.filter((F.col("n") > 0) & (F.col("shared") >= _least(F.col("n"), percent)))
    firsts = able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    # Nothing after the join needs a digest's rows together, so a much-copied text can be split.
    classes = materialise(able.select("doc_id", "digest").distinct().join(firsts, "digest").select("doc_id", "rep"), "jaccard-classes")
    firsts = materialise(firsts.select(F.col("rep").alias("doc_id"), "digest", "n"), "jaccard-firsts")

    # The representatives' sets, and what of them is shared between representatives.
    texts = join_small(d, firsts.select("doc_id").distinct(), ["doc_id"], "left_semi")
    found = texts.mapInArrow(_sets, "doc_id long, digest binary, tokens array<bigint>").dropDuplicates(["doc_id", "digest"])
    sets = found.join(firsts, ["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "digest", "n", "tokens")
    sets = materialise(sets, "jaccard-sets")
    exploded = sets.select("rep", "digest", "n", F.explode("tokens").alias("token"))
    often = exploded.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = exploded.join(often, "token").groupBy("rep", "digest", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    least = _least(F.col("n"), percent)
    shared = shared.filter(F.size("t") >= least)
    # n - size(t) unshared tokens come first in order; the rest of the prefix, extended by one:
    length = (F.size("t") - least + 2).cast("int")
    shared = materialise(shared.select("rep", "digest", "n", F.transform("t", lambda x: x["token"]).alias("tokens"), F.slice("t", 1, length).alias("prefix")), "jaccard-shared")
    del texts, found, exploded, often
    release(spark)

    rare = shared.select("rep", "n", F.explode(F.filter("prefix", lambda x: x["df"] <= RARE)).alias("x")).select("rep", "n", F.col("x.token").alias("token"))
    right = rare.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "token")
    near = (F.col("rep") < F.col("b")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    pairs = rare.join(right, "token").filter(near).select(F.col("rep").alias("a"), "b").distinct()
    own = shared.select("rep", "n", "tokens")
    left = own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(other, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    found_rare = materialise(both.filter(_linked(inter, F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), "jaccard-links")
    del pairs, both
    release(spark)

    often = shared.select("rep", "n", "prefix", F.filter("prefix", lambda x: x["df"] > RARE).alias("f"))
    single = often.filter(F.col("n") >= COMBINE * percent // 100).select("rep", F.explode(F.transform("f", lambda x: F.xxhash64(F.lit("one"), x["token"]))).alias("key"))
    two = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.xxhash64(F.lit("two"), x["token"], y["token"]))))
    double = often.filter((F.col("n") <= COMBINE) & (F.size("f") > 1)).select("rep", F.explode(two).alias("key"))
    families = _families(materialise(single.unionByName(double), "jaccard-frequent"))
    return rows.select("doc_id", "n"), classes, found_rare.unionByName(family_links(families, own, percent))


def family_links(families: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links inside families (rep, family), enough for their components. own: rep, n, tokens.

    Members go into size classes and blocks of about BLOCK. Each block meets the pivots of its own and the next
    classes; members linked through them share a label. Then the members outside their family's largest label, in
    blocks of their own, meet every block of these classes, where only members of other labels are looked at.
    """
    # Linked documents differ in size by 100 / percent at most, which is less than one class.
    step = 1.0001 * math.log(100 / percent) if percent < 100 else 0.0001
    fam = families.join(own.select("rep", "n"), "rep").withColumn("cls", F.floor(F.log("n") / step).cast("long"))
    fam = materialise(fam.withColumn("h", F.xxhash64("rep", F.lit(3))), "family-members")
    many = materialise(fam.groupBy("family", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "family-blocks")
    # The pivots: the members of the lowest hashes. The limit is the feature here: any member is compared below.
    low = F.expr(f"slice(array_sort(collect_list(struct(h, rep))), 1, {PIVOTS})")
    cut = fam.withColumn("part", F.pmod(F.col("h"), F.lit(1024))).groupBy("family", "cls", "part").agg(F.min(F.struct("h", "rep")).alias("m")).select("family", "cls", "m.h", "m.rep")
    pivots = cut.groupBy("family", "cls").agg(low.alias("p")).select(F.explode(F.transform("p", lambda x: x["rep"])).alias("rep"))
    placed = fam.join(many, ["family", "cls"]).withColumn("block", F.pmod(F.col("h"), F.col("blocks"))).select("family", "cls", "block", "rep")
    placed = materialise(placed.join(own, "rep").select("family", "cls", "block", "rep", "n", "tokens"), "family-placed")

    def to_all(q: DataFrame) -> DataFrame:
        near = q.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
        return near.join(many, ["family", "cls"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    run = lambda x, y: _compare(x, y, percent)
    keys = ["family", "cls", "block"]
    block = placed.withColumn("label", F.col("rep")).select(*keys, "rep", "n", "label", "tokens")
    asked = to_all(placed.drop("block").join(pivots, "rep").withColumn("label", F.col("rep"))).select(*keys, "rep", "n", "label", "tokens")
    fresh = lambda q: q.select(*(F.col(c).alias(c) for c in q.columns))  # noqa: E731  both sides come from one table
    first = materialise(fresh(asked).groupBy(*keys).cogroup(fresh(block).groupBy(*keys)).applyInPandas(run, "a long, b long"), "family-links")
    label = components(first)
    named = placed.join(label, placed["rep"] == label["v"], "left").withColumn("label", F.coalesce("label", "rep")).drop("v")
    sizes = named.groupBy("family", "label").agg(F.count("*").alias("m")).groupBy("family").agg(F.max(F.struct("m", "label")).alias("x")).select("family", F.col("x.label").alias("main"))
    named = materialise(named.join(sizes, "family"), "family-named")
    asked = named.filter(F.col("label") != F.col("main")).drop("block").join(many.withColumnRenamed("blocks", "_own"), ["family", "cls"])
    asked = asked.withColumn("asked", F.concat_ws("-", "cls", F.pmod(F.xxhash64("rep", F.lit(4)), F.col("_own"))))
    asked = to_all(asked).select(*keys, "asked", "rep", "n", "label", "tokens")
    groups = asked.select(*keys, "asked").distinct()
    block = named.select(*keys, "rep", "n", "label", "tokens").join(groups, keys).select(*keys, "asked", "rep", "n", "label", "tokens")
    keys = [*keys, "asked"]
    second = materialise(fresh(asked).groupBy(*keys).cogroup(fresh(block).groupBy(*keys)).applyInPandas(run, "a long, b long"), "family-links")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows, classes, found = links(docs, key=key, text=text, percent=percent)
    label = components(found)
    # A document's class, its representative's component, and the smallest doc_id in it.
    known = classes.join(label, classes["rep"] == label["v"], "left").select("doc_id", "rep", F.coalesce("label", "rep").alias("c"))
    same = known.select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
    several = known.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count()
    if several:  # rows of one doc_id in several classes join their components
        label = components(same)
        known = known.select("doc_id").distinct().join(label, known["doc_id"] == label["v"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("c"))
    else:
        known = known.select("doc_id", "c")
    known = known.select(F.col("doc_id").alias("_d"), "c")
    out = rows.join(known, rows["doc_id"] == known["_d"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    nameless = docs.filter(F.col(key).isNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    counted = nameless.mapInArrow(_sets, "doc_id long, digest binary, tokens array<bigint>")
    return out.unionByName(counted.select("doc_id", F.size("tokens").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each component the rows of its smallest doc_id, of equal rows of one doc_id one; rows without a doc_id all stay."""
    found = near_duplicates(docs.select("doc_id", "text"), percent=percent)
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("c"), F.count("*").alias("m"))
    marked = materialise(ids.filter("doc_id <> c OR m > 1").select("doc_id", (F.col("doc_id") != F.col("c")).alias("gone")), "jaccard-marked")
    kept = join_small(docs, marked.filter("gone").select("doc_id"), ["doc_id"], "left_anti")
    again = marked.filter("NOT gone").select("doc_id")
    if not again.limit(1).count():
        return kept
    # Only rows of a repeated doc_id are compared with one another.
    return join_small(kept, again, ["doc_id"], "left_anti").unionByName(join_small(kept, again, ["doc_id"], "left_semi").dropDuplicates())


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
m AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.v = d.doc_id
"""
