"""Token counts by a count-only Viterbi search.

A text is cut before its spaces into chunks that start with the word mark, as the metaspace step of unigram
tokenizers does. In a chunk, Aho-Corasick lists the vocabulary's pieces by where they end; dynamic
programming carries, for every end, the best score and the number of pieces of the path that has it, but
no path. The tie rules are the tokenizer's: for one end, starts are tried from the left and only a
strictly better score replaces the one before, so the longest piece wins; a character that is no piece of
its own may be unknown, at the vocabulary's lowest score less 10, after all pieces. With byte fallback an
unknown character counts as many tokens as it has UTF-8 bytes; without, a run of unknown characters is one.
Scores are doubles, as the tokenizer's are. Chunks met before are looked up.

Vocabularies: a sentencepiece model file, whose pieces and scores are taken as they are, or a tokenizers
file with a unigram model.

Defined results: null and empty texts have no tokens; repeated rows are counted each; a null doc_id stays null; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000  # chunks that a worker remembers


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = {5: 4, 1: 8}[kind]
            value = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n
        yield key >> 3, kind, value


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of ids."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:1] == b"{":
        model = json.loads(data)["model"]
        if model.get("type") != "Unigram":
            raise ValueError(f"{path}: a {model.get('type')} model has no unigram scores")
        return [(p, float(s)) for p, s in model["vocab"]]
    out = []
    for field, kind, value in _fields(data):
        if field == 1 and kind == 2:
            piece = {n: v for n, _, v in _fields(value)}  # 1: piece, 2: score
            out.append((piece[1].decode(), float(piece.get(2, 0.0))))
    return out


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = dict(reversed(vocabulary)) | dict(vocabulary)  # of repeated pieces the last one's score
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.found = ahocorasick.Automaton()
        for p, s in pieces.items():
            if p:
                self.found.add_word(p, (len(p), s))
        self.found.make_automaton()
        self.seen: dict[str, int] = {}

    def chunk(self, t: str) -> int:
        """Number of pieces of the best path through one chunk."""
        n = len(t)
        score, count, is_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        worst = float("-inf")
        at, best, pieces, single, unknown = 1, worst, 0, False, False

        def settle(upto: int):
            """All pieces that end before `upto` are known: fix those ends."""
            nonlocal at, best, pieces, single, unknown
            while at < upto:
                if not single and score[at - 1] + self.unknown > best:
                    best, unknown = score[at - 1] + self.unknown, True
                    if self.byte_fallback:
                        pieces = count[at - 1] + len(t[at - 1].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[at - 1] + (not is_unknown[at - 1])
                score[at], count[at], is_unknown[at] = best, pieces, unknown
                at, best, pieces, single, unknown = at + 1, worst, 0, False, False

        for last, (length, s) in self.found.iter(t):  # by end; of one end the longest, so leftmost, first
            end = last + 1
            if at < end:
                settle(end)
            candidate = score[end - length] + s
            if candidate > best:
                best, pieces, unknown = candidate, count[end - length] + 1, False
            single = single or length == 1
        settle(n + 1)
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        t = text.replace(MARK, " ")
        chunks = (t if t[0] == " " else " " + t).split(" ")[1:]
        seen, total = self.seen, 0
        for c in chunks:
            n = seen.get(c)
            if n is None:
                if len(seen) >= CACHE:
                    seen.clear()
                n = seen[c] = self.chunk(MARK + c)
            total += n
        return total


_COUNTERS: dict[tuple[str, bool], Counter] = {}


def counter(path: str, byte_fallback: bool = True) -> Counter:
    if (path, byte_fallback) not in _COUNTERS:
        _COUNTERS[path, byte_fallback] = Counter(read_vocabulary(path), byte_fallback)
    return _COUNTERS[path, byte_fallback]


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_bytes of every whole text."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path, byte_fallback)
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "n_tokens": [count(t) for t in f.text], "n_bytes": f.n_bytes})

    # As strings, ids with nulls among them do not become floats on their way through pandas.
    d = docs.select(F.col(key).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(counted, "doc_id string, n_tokens long, n_bytes long").withColumn("doc_id", F.col("doc_id").cast("long"))
