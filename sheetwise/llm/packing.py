"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A class k takes pieces of at most capacity // k ids, and k pieces of it always fit one sequence. Every
worker fills the bins of each class with k pieces on its own, without looking at lengths again. A
document is cut so that its pieces nearly fill their class: whole capacities first; the rest is one
piece if it fills all but 1/16 of a class's share, else the largest share below it is cut off and the
remainder is treated likewise. What workers have left over of a class is numbered over all workers and
fills bins of k again; the at most k - 1 pieces of each class that remain then, a number that the class
table bounds, are packed best-fit in one task.

Ids are those of the tokenizer over the whole text, with `end_id` after each document. A chunk between
ASCII white space is tokenised once and looked up afterwards: where the tokenizer drops white space and lets
no token cross it, a text's ids are its chunks' ids in order. A tokenizer for which probes show otherwise
encodes whole texts.

Defined results: a null or empty text is a document of one id (`end_id`); repeated rows are packed each; a null doc_id stays null;
an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.shared import materialise, trim

CAPACITY = 2048
#: Documents of a class's bin. Fixed values.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024, 2048)
WASTE = 16  # a piece may leave so small a part of its share unused
SMALL = 64  # remainders below are not cut further
CACHE = 250_000  # chunks that a worker remembers
LONG = 64  # characters of a chunk beyond which it is not remembered
PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, ids binary, cls int, pid long, nth long, sequence_id long, offset long"


class ChunkTokenizer:
    """ids of texts as little-endian unsigned 32-bit numbers, by chunks that are remembered.

    A chunk not met before is made up of runs of letters and runs of other characters where the tokenizer
    splits there too: in Latin-1 texts without apostrophes, whose lower case and composition are plain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        # Another tokenizer may keep case or let tokens cross runs: then chunks, or whole texts, are encoded as they are.
        self.by_runs, self.by_chunks = True, True
        own = self._encode(list(_PROBES))
        if self(list(_PROBES)) != own:
            self.by_runs, self.seen, self.parts = False, {"": b""}, {}
            self.by_chunks = self(list(_PROBES)) == own

    def _encode(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)] if new else []

    def _encode_runs(self, new: list[str]) -> None:
        """Runs of lower-case letters are one pre-token each, so the tokenizer's model takes their bytes' characters directly."""
        model, parts, pack = self.tokenizer.model.tokenize, self.parts, struct.pack
        odd = [r for r in new if not r.isalpha()]
        parts.update(zip(odd, self._encode(odd), strict=True))
        for r in new:
            if r not in parts:
                ids = [x.id for x in model(r if r.isascii() else "".join(map(_BYTE_CHARS.__getitem__, r.encode())))]
                parts[r] = pack(_FORMATS[len(ids)], *ids) if len(ids) < len(_FORMATS) else pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunks:
            return self._encode(texts)
        if len(self.seen) > CACHE:
            self.seen = {"": b""}
        if len(self.parts) > CACHE:
            self.parts = {}
        seen, parts = self.seen, self.parts
        split, plain, whole = [], set(), set()
        for t in texts:
            simple = self.by_runs and _is_latin1(t) and "<|" not in t
            # Lower case is the tokenizer's own step; done here, fewer chunks differ.
            t = t.lower() if simple else t
            chunks = t.split() if simple and not any(map(t.__contains__, _ODD_SPACE)) else t.translate(_TO_SPACE).split(" ")
            split.append(chunks)
            (plain if simple else whole).update(set(chunks).difference(seen))
        letters = [c for c in plain if c.isalpha()]
        mixed = {c: _RUN.findall(c) for c in plain if not c.isalpha() and "'" not in c}
        whole.update(c for c in plain if "'" in c)
        new = {r for rs in mixed.values() for r in rs}
        new.update(letters)
        new = list(new.difference(parts))
        self._encode_runs(new)
        for c in letters:
            seen[c] = parts[c]
        for c, rs in mixed.items():
            seen[c] = b"".join([parts[r] for r in rs])
        rest = list(whole)
        seen.update(zip(rest, self._encode(rest), strict=True))
        out = [b"".join(map(seen.__getitem__, chunks)) for chunks in split]
        # Only short chunks are remembered, so that CACHE bounds bytes as well.
        for held, added in ((parts, new), (seen, plain), (seen, whole)):
            for c in added:
                if len(c) > LONG:
                    del held[c]
        return out


def _is_latin1(t: str) -> bool:
    if t.isascii():
        return True
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_RUN = re.compile(r"[^\W\d_]+|[\W\d_]+")
_FORMATS = [f"<{n}I" for n in range(64)]
#: Texts whose ids by runs must equal the tokenizer's own if runs are used at all.
_PROBES = ("The Cat sat, 12 times; on x2y", "ÀÉ ça été-là 4½ µm", "a_b_c (d) ~e~ f.g", "don't stop", "  two  spaces \n\t")


def _byte_chars() -> list[str]:
    """The character of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


_BYTE_CHARS = _byte_chars()
#: White space of Python's split in Latin-1 that is not ASCII white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0"
_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids."""
    shares = [capacity // k for k in CLASSES if k <= capacity]  # falling
    rising = shares[::-1]
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        at = bisect.bisect_left(rising, n)
        fits = rising[at]
        if n < SMALL or fits - n <= fits // WASTE:
            out.append((n, CLASSES[len(shares) - 1 - at]))
            break
        out.append((rising[at - 1], CLASSES[len(shares) - at]))
        n -= rising[at - 1]
    return out


def _fill(frames: Iterator[pd.DataFrame], path: str, end_id: int, capacity: int, want_ids: bool) -> Iterator[pd.DataFrame]:
    """Tokenise, cut, and fill this worker's bins; open bins come last, without a sequence."""
    pid, full, open_bins = TaskContext.get().partitionId(), 0, {}
    names = [c.split()[0] for c in PIECE.split(", ")]
    end = np.array([end_id], "<u4").tobytes()
    tokenise = tokenizer(path)
    for f in frames:
        for lo in range(0, len(f), 256):
            rows = []
            for doc, ids in zip(f.doc_id[lo : lo + 256], tokenise(list(f.text[lo : lo + 256])), strict=True):
                ids, at = ids + end, 0
                for n, k in cut(len(ids) // 4, capacity):
                    part = ids[4 * at : 4 * (at + n)]
                    row = [doc, at, n, zlib.crc32(part), len(ids) // 4, part if want_ids else None, k, pid]
                    held = open_bins.setdefault(k, [])
                    held.append(row)
                    if len(held) == k:
                        offset = 0
                        for nth, row in enumerate(held):
                            rows.append([*row, nth, (pid << 32) | full, offset])
                            offset += row[2]
                        full += 1
                        open_bins[k] = []
                    at += n
            yield pd.DataFrame(rows, columns=names)
    trim()
    yield pd.DataFrame([[*row, nth, None, None] for held in open_bins.values() for nth, row in enumerate(held)], columns=names)


def _best_fit(f: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over the few pieces that no class could fill."""
    f = f.sort_values(["length", "doc_id", "start", "pid", "nth"], ascending=[False, True, True, True, True]).reset_index(drop=True)
    room: list[tuple[int, int]] = []  # (room, sequence)
    seq, off, n = [], [], 0
    for length in f.length:
        at = bisect.bisect_left(room, (length, -1))
        left, s = room.pop(at) if at < len(room) else (capacity, n)
        n += s == n
        seq.append((1 << 62) | (1 << 60) | s)
        off.append(capacity - left)
        if left > length:
            bisect.insort(room, (left - length, s))
    return f.assign(sequence_id=np.array(seq, np.int64), offset=np.array(off, np.int64))


def pack(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, want_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves where want_ids is set."""
    # As strings, ids with nulls among them do not become floats on their way through pandas.
    d = docs.select(F.col(key).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    filled = materialise(d.mapInPandas(lambda frames: _fill(frames, path, end_id, capacity, want_ids), PIECE), "pack-pieces")
    rest = filled.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    had = rest.groupBy("cls", "pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    had = had.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("cls"))).drop("_n")
    rest = rest.join(had, ["cls", "pid"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    rest = rest.withColumn("_bin", F.floor(F.col("_rank") / F.col("cls"))).withColumn("_whole", F.col("_bin") < F.floor(F.col("_all") / F.col("cls")))
    inside = Window.partitionBy("cls", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = rest.filter("_whole").withColumn("sequence_id", F.lit(1 << 62).bitwiseOR(F.shiftleft(F.col("cls").cast("long"), 44)).bitwiseOR(F.col("_bin")))
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    names = [c.split()[0] for c in PIECE.split(", ")]
    last = rest.filter("NOT _whole").select(*names[:-2]).groupBy().applyInPandas(lambda f: _best_fit(f, capacity)[names], PIECE)
    out = filled.filter(F.col("sequence_id").isNotNull()).unionByName(whole.select(*names)).unionByName(last)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if want_ids else []))
