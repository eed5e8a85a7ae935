"""Exact substring removal by suffix arrays.

Of every text, the bytes go that are covered by a string of `width` bytes which also starts in a document
of a smaller doc_id. The result is exact: strings are compared by their bytes.

1. Copies. Of equal texts (by SHA-256) only that of the smallest doc_id is looked into; the others are covered
   whole where they are `width` long.
2. Anchors. Positions whose GRAM-byte hash is smallest within some window of width - GRAM + 1 positions.
   Every string of `width` bytes holds an anchor that its bytes alone determine: its designated one. Chunks
   of documents send each anchor's hash once, packed, to buckets that find those of two documents or more.
   Anchors only deal: which text can be shared at all, and which shard it goes to.
3. Runs. Neighbouring starts with the same shared designated anchor form a run. A chunk sends a run once, with
   its smallest document, however many places it has; the places wait for the answer. Equal strings meet in one
   group of shards. Runs of a very common anchor are cut into single strings that are dealt by their own bytes.
4. Shards. The runs of a group are laid out in shards of bounded size, each with a suffix array by
   Larsson-Sadakane refinement (ranks of the first 5 bytes, doubled until `width` bytes are told apart; only
   groups that still tie are sorted again) and common prefixes by Kasai's method, run in lockstep over strips of
   the text. Suffixes between common prefixes of `width` bytes or more are equal strings. Shards are merged by
   binary search of one's distinct strings in those of the others, confirmed by their bytes.
5. Every run hears of the strings that a smaller document elsewhere has. The covered intervals of a document
   are merged and cut out of its whole text.

Defined results: a null text is empty; texts shorter than `width` lose nothing; strings do not cross
documents; rows of one doc_id do not remove one another and each is
returned with what it loses itself; rows without a doc_id neither remove nor lose anything; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm import bytehash
from sheetwise.llm.shared import is_small, join_small, materialise, release

WIDTH = 50
GRAM = 20
CHUNK_ANCHORS = 1_000_000
CHUNK_DOCS = 60_000
BUCKET_ANCHORS = 1_000_000
GROUP_BYTES = 1 << 20  # of text whose runs go to a group of shards, about
SHARD_BYTES = 3 << 17  # of a suffix array
HEAVY = 4000  # documents that share an anchor from which on its runs are cut up
HELD_BYTES = 32 << 20  # of a chunk's runs
PIECE_BYTES = 1 << 22  # of a long text that is looked at in one go
MANY = 0xFFFF  # stands for several owners of one chunk
RUN = np.dtype([("run", "<u4"), ("starts", "<u4"), ("least", "<i8")])  # what a group of shards hears of a run
SPOT = np.dtype([("starts", "<u4"), ("places", "<u4"), ("least", "<i8")])  # what its chunk keeps
PLACE = np.dtype([("doc", "<u4"), ("start", "<u4")])
ANSWER = np.dtype([("run", "<u4"), ("off", "<u4"), ("n", "<u4"), ("low", "<i8")])


# ---- suffix arrays


def _in_order(key: np.ndarray, rows: np.ndarray, bits: int) -> np.ndarray:
    """rows by key, of equal keys the smaller first. Sorting packed numbers is several times faster than sorting places."""
    low = np.uint64(bits)
    if len(key) and int(key.max()) >> (64 - bits):
        return rows[np.lexsort((rows, key))]
    return (np.sort((key << low) | rows.astype(np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def suffix_array(data: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank): suffixes of data in order of their first `limit` bytes, zero bytes after the end; rank is equal
    for suffixes that agree in so many. Larsson-Sadakane: groups that still tie are refined by the rank `h` further."""
    n, h = len(data), 5
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded, 0, (1,)).astype(np.uint64) >> np.uint64(64 - 8 * h)
    sa = _in_order(key, np.arange(n), bits)
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    while h < limit:
        alone = np.concatenate([new[1:], [True]]) & new
        open_at = np.flatnonzero(~alone)  # places in sa of groups of two or more
        if not len(open_at):
            break
        group = head[open_at]
        ahead = sa[open_at] + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        rows = _in_order((group.astype(np.uint64) << np.uint64(bits)) | second.astype(np.uint64), sa[open_at], bits)
        sa[open_at] = rows
        ahead = rows + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        new[open_at] |= np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        # Groups keep their places, so only heads inside them are new.
        head[open_at] = np.maximum.accumulate(np.where(new[open_at], open_at, 0))
        rank[rows] = head[open_at]
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, strips: int = 16384) -> np.ndarray:
    """lcp[i]: length, up to limit, of the common prefix of suffixes sa[i - 1] and sa[i].

    Kasai: going through the text, a common prefix is at most one shorter than the one before. The text is
    cut into strips that go forward in lockstep; eight bytes are compared at a time."""
    n = len(data)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    padded = np.concatenate([data, np.zeros(limit + 16, np.uint8)])
    word = np.ndarray(n + limit + 8, "<u8", padded, 0, (1,))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    length = -(-n // strips)
    starts = np.arange(0, n, length)
    plcp, h, room = np.zeros(n, np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for j in range(length):
        i = starts + j
        ok = i < n
        i = np.minimum(i, n - 1)
        p = before[i]
        ok &= p >= 0
        # Only a prefix that ended in two different bytes tells of the next: at the limit or the text's end order is open.
        h = np.where(ok & (h < room), np.maximum(h - 1, 0), 0)
        room = np.minimum(limit, n - np.maximum(i, p))
        h = np.minimum(h, room)
        todo = np.flatnonzero(ok & (h < room))
        while len(todo):
            x = word[i[todo] + h[todo]] ^ word[p[todo] + h[todo]]
            low = x & (~x + np.uint64(1))  # lowest bit that differs; its byte is the number of equal ones
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            h[todo] = np.minimum(h[todo] + same, room[todo])
            todo = todo[(same == 8) & (h[todo] < room[todo])]
        plcp[i[ok]] = h[ok]
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp


# ---- anchors


def _slide(x: np.ndarray, w: int, low: bool) -> np.ndarray:
    """Smallest (or largest) of each w neighbours: prefix and suffix extremes of blocks of w."""
    n = len(x)
    f = np.minimum if low else np.maximum
    size = -(-n // w) * w
    pad = np.full(size, np.iinfo(x.dtype).max if low else 0, x.dtype)
    pad[:n] = x
    ahead = f.accumulate(pad.reshape(-1, w), axis=1).ravel()
    behind = f.accumulate(pad.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    at = np.arange(len(data) - GRAM + 1)
    return bytehash.spans(bytehash.prefix(data), at, at + GRAM)


def designated(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start of a string of `width` bytes, the position of its designated anchor: the last of the smallest hashes in it."""
    w = width - GRAM + 1
    # Hash above, place below: the smallest key is the smallest hash, of equal ones the last.
    n = len(hashes)
    key = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    return n - 1 - (_slide(key, w, True) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _texts(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, base, bytes, hashes, designated) of each text that is long enough; long ones in pieces that start at
    base and overlap so that every string of `width` bytes lies whole in the one piece that it starts in."""
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for base in range(0, hi - lo - width + 1, PIECE_BYTES):
            d = data[lo + base : min(hi, lo + base + PIECE_BYTES + width - 1)]
            h = gram_hashes(d)
            yield i, base, d, h, designated(h, width)


def _anchors(batches, bits: int, width: int) -> Iterator:
    """(key, chunk, payload): for each bucket the chunk's anchor hashes, each once, with their owner or MANY and then
    how many; under key -1 - chunk the documents, and which of them share a hash inside the chunk."""
    import pyarrow as pa

    task, number = TaskContext.get().partitionId(), 0
    ids, marks, found, held = [], [], [], 0

    def flush():
        nonlocal number, ids, marks, found, held
        chunk = (task << 24) | number
        number += 1
        n = [len(s) for s in found]
        hashes, owners = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.uint16), n)
        short = hashes >> np.uint64(32 - bits)
        order = np.argsort(short)
        short, owners = short[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(short)))
        inside = np.repeat(many > 1, many)
        own = np.where(many > 1, MANY, owners[first]).astype("<u2")
        buckets, rest = (short[first] >> np.uint64(32)).astype(np.int64), (short[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
        keys, at = np.unique(buckets, return_index=True)
        at = [*at, len(first)]
        rows = [(int(k), chunk, np.int64(b - a).tobytes() + rest[a:b].tobytes() + own[a:b].tobytes() + many[a:b][own[a:b] == MANY].astype("<u4").tobytes()) for k, a, b in zip(keys, at[:-1], at[1:], strict=True)]
        rows.append((-1 - chunk, chunk, np.int64(len(ids)).tobytes() + np.array(ids, "<i8").tobytes() + np.array(marks, "<i8").tobytes() + short[inside].astype("<u8").tobytes() + owners[inside].astype("<u2").tobytes()))
        ids, marks, found, held = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "chunk", "payload"])

    for b in batches:
        data, offsets = bytehash.column(b.column(2))
        names, signs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i, parts in groupby(_texts(data, offsets, width), lambda x: x[0]):
            ids.append(names[i])
            marks.append(signs[i])
            own = np.unique(np.concatenate([h[at[np.concatenate([[True], at[1:] != at[:-1]])]] for _, _, _, h, at in parts]))
            found.append(own[np.concatenate([[True], (own[1:] ^ own[:-1]) >> np.uint64(32 - bits) > 0])])  # once by its short form
            held += len(found[-1])
            if held >= CHUNK_ANCHORS or len(ids) >= CHUNK_DOCS:
                yield flush()
    if ids:
        yield flush()


def _shared(f: pd.DataFrame) -> pd.DataFrame:
    """A bucket: each chunk's (owner, hash) pairs whose hash another document has too; kind 2 for very common ones.
    What several documents of one chunk share that chunk knows itself, unless it is very common."""
    if f.key.iloc[0] < 0:
        return f[["chunk", "key", "payload"]].rename(columns={"key": "kind"})
    rest, owner, times, chunk = [], [], [], []
    for n, p in enumerate(f.payload):
        m = int(np.frombuffer(p, "<i8", 1)[0])
        rest.append(np.frombuffer(p, "<u4", m, 8))
        owner.append(np.frombuffer(p, "<u2", m, 8 + 4 * m))
        k = np.ones(m, np.int64)
        k[owner[-1] == MANY] = np.frombuffer(p, "<u4", -1, 8 + 6 * m)
        times.append(k)
        chunk.append(np.full(m, n, np.int32))
    rest, owner, times, chunk = map(np.concatenate, (rest, owner, times, chunk))
    _, where = np.unique(rest, return_inverse=True)
    n = np.bincount(where, weights=times)[where]
    rows = []
    for kind, hit in ((1, (n > 1) & (n < HEAVY) & (owner != MANY)), (2, n >= HEAVY)):
        hit = np.flatnonzero(hit)
        at = np.searchsorted(chunk[hit], np.arange(len(f) + 1))
        for c, a, b in zip(f.chunk, at[:-1], at[1:], strict=True):
            if b > a:
                rows.append((c, kind, np.int64(f.key.iloc[0]).tobytes() + owner[hit[a:b]].astype("<u2").tobytes() + rest[hit[a:b]].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "kind", "payload"])


def _by_document(f: pd.DataFrame) -> pd.DataFrame:
    """A chunk: doc_id, mark and the shared hashes, shortened to bucket and rest, packed; those of very common anchors apart."""
    p = next(p for k, p in zip(f.kind, f.payload, strict=True) if k < 0)
    n = int(np.frombuffer(p, "<i8", 1)[0])
    ids, marks = np.frombuffer(p, "<i8", n, 8), np.frombuffer(p, "<i8", n, 8 + 8 * n)
    m = (len(p) - 8 - 16 * n) // 10
    owner, value = [np.frombuffer(p, "<u2", m, 8 + 16 * n + 8 * m)], [np.frombuffer(p, "<u8", m, 8 + 16 * n)]
    common = []
    for k, q in zip(f.kind, f.payload, strict=True):
        if k > 0:
            m = (len(q) - 8) // 6
            own = np.frombuffer(q, "<u2", m, 8)
            v = (np.frombuffer(q, "<u8", 1)[0] << np.uint64(32)) | np.frombuffer(q, "<u4", m, 8 + 2 * m).astype(np.uint64)
            owner.append(own[own != MANY])
            value.append(v[own != MANY])
            if k == 2:
                common.append(v)
    owner, value = np.concatenate(owner), np.concatenate(value)
    is_common = np.isin(value, np.concatenate(common)) if common else np.zeros(len(value), bool)
    order = np.argsort(owner, kind="stable")
    owner, value, is_common = owner[order], value[order], is_common[order]
    docs, at = np.unique(owner, return_index=True)
    rows = []
    for d, a, b in zip(docs, at, np.append(at[1:], len(owner))[: len(docs)], strict=True):
        v, k = value[a:b], is_common[a:b]
        rows.append((ids[d], marks[d], np.sort(v[~k]).tobytes(), np.sort(v[k]).tobytes()))
    return pd.DataFrame(rows, columns=["doc_id", "mark", "light", "heavy"])


# ---- runs


def _runs(batches, bits: int, groups: int, width: int) -> Iterator:
    """(key, chunk, payload): a chunk's runs for each group of shards; under key -1 - chunk where they stand."""
    import pyarrow as pa

    task, number = TaskContext.get().partitionId(), 0
    runs: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    docs: list[tuple[int, int]] = []
    held = 0

    def flush():
        nonlocal number, runs, docs, held
        chunk = (task << 24) | number
        number += 1
        rows, spots, places, n = [], [], [], 0
        for group, items in runs.items():
            table = np.zeros(len(items), RUN)
            for i, (t, p) in enumerate(items.items()):
                least = min(docs[d][0] for d, _ in p)
                table[i] = n, len(t) - width + 1, least
                spots.append((len(t) - width + 1, len(p), least))
                places += p
                n += 1
            rows.append((group, chunk, np.int64(len(items)).tobytes() + table.tobytes() + b"".join(items)))
        names = np.array(docs, "<i8").reshape(-1, 2)
        rows.append((-1 - chunk, chunk, np.array([len(names), n], "<i8").tobytes() + names.tobytes() + np.array(spots, SPOT).tobytes() + np.array(places, PLACE).tobytes()))
        runs, docs, held = {}, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "chunk", "payload"])

    def put(group: int, t: bytes, start: int):
        nonlocal held
        where = runs.setdefault(group, {})
        places = where.get(t)
        if places is None:
            where[t] = [(len(docs) - 1, start)]
            held += len(t) + 150
        else:
            places.append((len(docs) - 1, start))
            held += 60

    for b in batches:
        data, offsets = bytehash.column(b.column(2))
        names, signs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        light, heavy = b.column(3), b.column(4)
        for i, base, d, h, at in _texts(data, offsets, width):
            if base == 0 or not docs:  # the chunk may have been cut between two pieces
                docs.append((int(names[i]), int(signs[i])))
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(cut[1:], len(at))
            hashes = h[at[cut]]
            short = hashes >> np.uint64(32 - bits)
            common = np.frombuffer(heavy[i].as_py(), "<u8")
            is_heavy = np.isin(short, common) if len(common) else np.zeros(len(short), bool)
            hit = np.flatnonzero(is_heavy | np.isin(short, np.frombuffer(light[i].as_py(), "<u8")))
            whole = d.tobytes()
            group = (bytehash.mix(hashes[hit]) % np.uint64(groups)).tolist()
            for g, many, lo, hi in zip(group, is_heavy[hit].tolist(), cut[hit].tolist(), ends[hit].tolist(), strict=True):
                if many:
                    for k in range(lo, hi):
                        t = whole[k : k + width]
                        put(int.from_bytes(hashlib.blake2b(t, digest_size=7).digest(), "big") % groups, t, base + k)
                else:
                    put(g, whole[lo : hi - 1 + width], base + lo)
            if held > HELD_BYTES:
                yield flush()
    if docs:
        yield flush()


def _distinct(text: np.ndarray, starts: np.ndarray, least: np.ndarray, width: int):
    """Strings of one shard, whose runs lie end to end. For each start of each run: its string's number; each string's
    smallest document and a place."""
    sa, _ = suffix_array(text, width)
    lcp = common_prefixes(text, sa, width)
    size = starts + width - 1
    valid = _positions(np.cumsum(size) - size, starts)  # places of all strings
    is_start = np.zeros(len(text), bool)
    is_start[valid] = True
    string_of_suffix = np.cumsum(lcp < width) - 1
    kept = is_start[sa]
    place, string = sa[kept], string_of_suffix[kept]
    string = np.cumsum(np.concatenate([[0], string[1:] != string[:-1]]))  # numbered without those that only others hold
    owner = np.zeros(len(text), np.int64)
    owner[valid] = np.repeat(least, starts)
    first = np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]]))
    smallest = np.minimum.reduceat(owner[place], first)
    of = np.zeros(len(text), np.int64)
    of[place] = string
    return of[valid], smallest, place[first]


def _positions(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... at[i] + n[i] - 1 for each i, end to end."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    return np.ndarray(len(text) - 7, "<u8", text, 0, (1,))[at]


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the strings of `width` bytes at a and b are the same, eight bytes at a time."""
    if width < 8:
        return (text[a[:, None] + np.arange(width)] == text[b[:, None] + np.arange(width)]).all(axis=1)
    same = np.ones(len(a), bool)
    for k in (*range(0, width - 8, 8), width - 8):
        same &= _words(text, a + k) == _words(text, b + k)
    return same


ID = np.uint64(28)  # bits of a string's number, below those of its hash
LOW = (np.uint64(1) << ID) - np.uint64(1)


def _search(keys: np.ndarray, at: np.ndarray, known: np.ndarray, example: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each string (key: hash above, place among `at` below, in order) its number among the known ones (hash above,
    number below, in order), else -1: binary search, confirmed by the bytes."""
    found = np.full(len(at), -1)
    near = np.searchsorted(known, keys & ~LOW)
    todo = np.arange(len(keys))
    while len(todo):  # once more only for two different strings of one hash
        todo = todo[near[todo] < len(known)]
        todo = todo[known[near[todo]] >> ID == keys[todo] >> ID]
        which, number = (keys[todo] & LOW).astype(np.int64), (known[near[todo]] & LOW).astype(np.int64)
        same = _equal(text, example[number], at[which], width)
        found[which[same]] = number[same]
        todo = todo[~same]
        near[todo] += 1
    return found


def smallest_by_string(text: np.ndarray, starts: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For every string of every run the smallest document of all runs that hold it, end to end; runs lie end to end in
    text. Shards of bounded size get a suffix array each and are merged by binary search."""
    size = starts + width - 1
    ends = np.cumsum(size)
    cuts = [0]
    while cuts[-1] < len(size):
        lo = cuts[-1]
        cuts.append(max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARD_BYTES, side="right"))))
    sums = bytehash.prefix(text) if len(cuts) > 2 else None
    known, numbers, examples, lows, n = np.empty(0, np.uint64), [], [], [], 0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        base = int(ends[lo] - size[lo])
        of, smallest, at = _distinct(text[base : ends[hi - 1]], starts[lo:hi], least[lo:hi], width)
        if sums is None:
            return smallest[of]
        at = at + base
        keys = np.sort(((bytehash.spans(sums, at, at + width) >> ID) << ID) | np.arange(len(at), dtype=np.uint64))
        number = _search(keys, at, known, np.concatenate(examples) if examples else at[:0], text, width)
        new = np.flatnonzero(number < 0)
        number[new] = n + np.arange(len(new))
        fresh = number[(keys & LOW).astype(np.int64)]
        known = np.sort(np.concatenate([known, ((keys & ~LOW) | fresh.astype(np.uint64))[fresh >= n]]))
        n += len(new)
        examples.append(at[new])
        lows.append((number, smallest))
        numbers.append(number[of])
    low = np.full(n, np.iinfo(np.int64).max)
    for number, smallest in lows:  # a shard has each of its strings once
        low[number] = np.minimum(low[number], smallest)
    return low[np.concatenate(numbers)] if numbers else low


def answers(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """For each payload the stretches of its runs (ANSWER) that a smaller document than the run's own least has too."""
    tables, texts = [], []
    for p in payloads:
        m = int(np.frombuffer(p, "<i8", 1)[0])
        tables.append(np.frombuffer(p, RUN, m, 8))
        texts.append(np.frombuffer(p, np.uint8, -1, 8 + m * RUN.itemsize))
    table, text = np.concatenate(tables), np.concatenate(texts)
    starts, least = table["starts"].astype(np.int64), table["least"]
    low = smallest_by_string(text, starts, least, width)
    run = np.repeat(np.arange(len(starts)), starts)
    hit = np.flatnonzero(low < least[run])
    run, off, low = run[hit], (hit - (np.cumsum(starts) - starts)[run[hit]]), low[hit]
    head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (off[1:] != off[:-1] + 1) | (low[1:] != low[:-1])])) if len(hit) else hit
    out = np.zeros(len(head), ANSWER)
    out["run"], out["off"], out["n"], out["low"] = table["run"][run[head]], off[head], np.diff(np.append(head, len(run))), low[head]
    return np.split(out, np.searchsorted(run[head], np.cumsum([len(t) for t in tables])[:-1]))


def _group(f: pd.DataFrame, width: int) -> pd.DataFrame:
    if f.key.iloc[0] < 0:
        return f[["chunk", "key", "payload"]].rename(columns={"key": "kind"})
    found = answers(list(f.payload), width)
    return pd.DataFrame([(c, 1, a.tobytes()) for c, a in zip(f.chunk, found, strict=True) if len(a)], columns=["chunk", "kind", "payload"])


def intervals_of(places: bytes, told: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, lo, hi): the covered intervals of a chunk's documents, merged; docs: doc_id and mark of each."""
    n_docs, n_runs = np.frombuffer(places, "<i8", 2)
    names = np.frombuffer(places, "<i8", 2 * n_docs, 16).reshape(-1, 2)
    spots = np.frombuffer(places, SPOT, n_runs, 16 + 16 * n_docs)
    place = np.frombuffer(places, PLACE, -1, 16 + 16 * n_docs + SPOT.itemsize * n_runs)
    told = np.concatenate([np.frombuffer(t, ANSWER) for t in told]) if told else np.zeros(0, ANSWER)
    told = told[np.argsort(told["run"], kind="stable")]
    run = np.repeat(np.arange(n_runs), spots["places"])
    doc, start = place["doc"].astype(np.int64), place["start"].astype(np.int64)
    later = names[doc, 0] > spots["least"][run]  # the chunk itself has a smaller document with the whole run
    d, lo, hi = [doc[later]], [start[later]], [start[later] + spots["starts"][run[later]] + width - 1]
    first = np.flatnonzero(~later)  # places in the run's least document: covered where the answers say so
    a, b = np.searchsorted(told["run"], run[first]), np.searchsorted(told["run"], run[first], side="right")
    which, at = np.repeat(first, b - a), _positions(a, b - a)
    d.append(doc[which])
    lo.append(start[which] + told["off"][at])
    hi.append(lo[-1] + told["n"][at] + width - 1)
    d, lo, hi = map(np.concatenate, (d, lo, hi))
    order = np.lexsort((lo, d))
    d, lo, hi = d[order], lo[order], hi[order]
    if not len(d):
        return names[:0], lo, hi
    line = d << np.int64(32)  # all documents on one line: the furthest end so far, never from another document
    far = np.maximum.accumulate(line | hi)
    head = np.flatnonzero(np.concatenate([[True], (line[1:] | lo[1:]) > far[:-1]]))
    return names[d[head]], lo[head], far[np.append(head[1:], len(d)) - 1] & 0xFFFFFFFF


def _covered_of_chunk(f: pd.DataFrame, width: int) -> pd.DataFrame:
    places = next(p for k, p in zip(f.kind, f.payload, strict=True) if k < 0)
    names, lo, hi = intervals_of(places, [p for k, p in zip(f.kind, f.payload, strict=True) if k > 0], width)
    return pd.DataFrame({"doc_id": names[:, 0], "mark": names[:, 1], "lo": lo, "hi": hi})


def covered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(d, copies, intervals): the texts as bytes; doc_id and mark of texts that equal a smaller document's; doc_id, mark,
    lo, hi otherwise. A mark, a hash of the text, tells rows of one doc_id apart."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    named = d.filter("doc_id is not null")
    marks = materialise(named.select("doc_id", F.xxhash64("text").alias("mark"), F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").cast("long").alias("n")), "substr-marks")
    least = marks.filter(F.col("n") >= width).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).filter("m > 1").select("sha", "first")
    # By doc_id and text: another row of the same doc_id may be no copy. No row is needed together with others after the join, so a hot text can be split.
    copies = materialise(marks.select("doc_id", "mark", "sha").distinct().join(least, "sha").filter(F.col("doc_id") > F.col("first")).select("doc_id", "mark"), "substr-copies")
    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, int(np.ceil(np.log2(max(1, total / 15 / BUCKET_ANCHORS)))))
    groups = max(8, int(total // GROUP_BYTES))
    own = join_small(named.select("doc_id", F.xxhash64("text").alias("mark"), "text"), copies, ["doc_id", "mark"], "left_anti")
    packed = own.mapInArrow(lambda b: _anchors(b, bits, width), "key long, chunk long, payload binary")
    shared = packed.groupBy("key").applyInPandas(_shared, "chunk long, kind long, payload binary")
    shared = materialise(shared.groupBy("chunk").applyInPandas(_by_document, "doc_id long, mark long, light binary, heavy binary"), "substr-shared")
    del packed
    release(spark)
    shared = shared.dropDuplicates(["doc_id", "mark"])  # equal rows of one doc_id share all they have
    own = join_small(own, materialise(shared.select("doc_id"), "substr-ids"), ["doc_id"], "left_semi")
    # In a fixed order: a task that is run again cuts the same chunks.
    own = own.join(shared, ["doc_id", "mark"]).select("doc_id", "mark", "text", "light", "heavy").sortWithinPartitions("doc_id", "mark")
    runs = own.mapInArrow(lambda b: _runs(b, bits, groups, width), "key long, chunk long, payload binary")
    told = runs.groupBy("key").applyInPandas(lambda f: _group(f, width), "chunk long, kind long, payload binary")
    intervals = materialise(told.groupBy("chunk").applyInPandas(lambda f: _covered_of_chunk(f, width), "doc_id long, mark long, lo long, hi long"), "substr-intervals")
    del runs, told, own, shared
    release(spark)
    return d, copies, intervals


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What stays of a text, and how many bytes and maximal runs go."""
    if spans is None or not len(spans):
        return text, 0, 0
    parts, at, gone, n, end = [], 0, 0, 0, -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > end:
            n += 1
            parts.append(text[at:lo])
            gone += hi - lo
            end = hi
        elif hi > end:
            gone += hi - end
            end = hi
        at = max(at, end)
    return b"".join([*parts, text[at:]]), gone, n


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text (bytes), copy (whole text goes), spans."""
    d, copies, intervals = covered(docs, **options)
    on = ["doc_id", "mark"]
    per = materialise(intervals.groupBy(*on).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "substr-spans")
    d = d.withColumn("mark", F.xxhash64("text"))
    d = join_small(d, copies.withColumn("copy", F.lit(True)), on, "left")
    ids = per.select("doc_id").distinct()
    if is_small(ids):  # texts that lose nothing need no shuffle
        ids = F.broadcast(ids)
        found = d.join(ids, "doc_id", "left_semi").join(per, on, "left").unionByName(d.join(ids, "doc_id", "left_anti"), allowMissingColumns=True)
    else:
        found = d.join(per, on, "left")
    return found.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")


def removal(docs: DataFrame, **options) -> DataFrame:
    """RESULT for each row of docs."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t, copy, spans in zip(f.doc_id, f.text, f["copy"], f.spans, strict=True):
                t = bytes(t)
                kept, gone, n = (b"", len(t), 1) if copy else _cut(t, spans)
                out.append((i, len(t), gone, n, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    # As strings, ids with nulls among them do not become floats on their way through pandas.
    d = _with_spans(docs, **options).withColumn("doc_id", F.col("doc_id").cast("string"))
    return d.mapInPandas(rows, RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, doc_id, i, b[i + 1:i + 50] AS w FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING count(*) > 1), c AS (SELECT r, i FROM s JOIN f ON f.w = s.w WHERE first < doc_id),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c), g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
q AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY r, k), p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM q),
k AS (SELECT p.r, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(CASE WHEN lo > prev THEN hex(b[prev + 1:lo]) ELSE '' END, '' ORDER BY lo) AS kept, max(hi) AS last FROM p JOIN d ON d.r = p.r GROUP BY p.r)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(kept || CASE WHEN last < octet_length(b) THEN hex(b[last + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""
