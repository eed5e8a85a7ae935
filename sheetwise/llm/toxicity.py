"""Toxicity by a weighted lexicon.

A text is folded: letters that look alike (Greek, Cyrillic, full-width, accented) become one Latin
letter, digits and signs that stand for letters inside a word become those letters, i, l and 1 become
one. Aho-Corasick finds the lexicon's words and the exception phrases in the folded text; a word inside
an exception phrase does not count. The sum of the found weights per 1,000 characters goes through a
logistic curve.

The lexicon, the exception phrases and the curve are learned from labelled rows, at most about
`sample_rows` of them, chosen by a hash of doc_id and text, equal ones once. Near copies share a min-hash and
count once, so that a much-copied text does not make its words look toxic. A lexicon word occurs in SUPPORT of
the toxic rows and MIN_SUPPORT rows at least and has a log-odds weight of MIN_WEIGHT at least; of these the
LEXICON_WORDS of the largest weights are kept, the size of the lexicon being a parameter of the model.

Defined results: null and empty texts get the curve's value at no match; rows without a label, or with
a null one, teach nothing, nor does a doc_id whose label rows disagree; repeated rows are scored each; with no labelled rows the lexicon is empty
and every score is the same; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.shared import trim

SAMPLE_ROWS = 10_000  # labelled rows to learn from
LEXICON_WORDS = 500
SLICE = 64  # texts whose word lists are held at once
SUPPORT = 0.03  # of the toxic rows that a lexicon word must occur in
MIN_SUPPORT = 4
MIN_WEIGHT = 1.6

#: Letters of other scripts and the Latin letter each looks like. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "η": "n", "ı": "i", "ɡ": "g", "ɑ": "a", "ø": "o", "ł": "l", "đ": "d", "ß": "b",
}
#: Digits and signs that stand for letters. Fixed values.
STAND_INS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}


class _Fold(dict):
    """Translation of one character, worked out when first met."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        out = "".join(HOMOGLYPHS.get(c, c) for c in base if not unicodedata.combining(c))
        out = "".join(c if "a" <= c <= "z" or c in STAND_INS else "" if not c.strip("​‌‍⁠﻿­") else " " for c in out)
        self[code] = out.replace("l", "i") if out or unicodedata.combining(chr(code)) or chr(code) in "​‌‍⁠﻿­" else " "
        return self[code]


_FOLD = _Fold()
_MIXED = re.compile(r"[a-z0-9@$€]*[0-9@$€][a-z0-9@$€]*")
_STAND = str.maketrans(STAND_INS)


def _replace(m: re.Match) -> str:
    """A word with stand-ins becomes letters; signs after it and runs of signs before it are no letters."""
    w = re.sub(r"^[@$€]{2,}|[@$€]+$", "", m[0])
    letters = sum("a" <= c <= "z" for c in w)
    return w.translate(_STAND) if 3 * letters >= len(w) > 0 else re.sub("[^a-z]", " ", m[0])


def fold(text: str | None) -> str:
    """Folded words between single-character gaps, with a space at either end."""
    out = (text or "").translate(_FOLD)
    return f" {_MIXED.sub(_replace, out)} "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # folded word -> weight
    exceptions: list[str] = field(default_factory=list)  # folded phrases
    bias: float = -3.0
    slope: float = 1.0
    _found: object = None

    def automaton(self):
        import ahocorasick

        if self._found is None:
            self._found = ahocorasick.Automaton()
            for w, weight in self.lexicon.items():
                self._found.add_word(f" {w} ", (len(w) + 2, weight))
            for p in self.exceptions:
                self._found.add_word(f" {p} ", (len(p) + 2, None))
            if len(self._found):
                self._found.make_automaton()
        return self._found

    def weight(self, text: str | None) -> float:
        """Sum of the weights found in the whole text."""
        found = self.automaton()
        if not len(found):
            return 0.0
        folded = fold(text)
        hits, void, at, reach = [], [], 0, -1
        for end, (n, w) in found.iter(re.sub("  +", " ", folded) if self.exceptions else folded):
            (void if w is None else hits).append((end - n + 1, end, w))
        hits.sort()
        void.sort(key=lambda v: v[0])
        total = 0.0
        for a, b, w in hits:  # inside a phrase if one that starts no later reaches as far
            while at < len(void) and void[at][0] <= a:
                reach = max(reach, void[at][1])
                at += 1
            total += w if b > reach else 0.0
        return total

    def __getstate__(self):
        return self.__dict__ | {"_found": None}


def feature(weight: float, n_chars: int) -> float:
    return math.log1p(1000.0 * weight / (n_chars + 200.0))


def score(model: Model, weight: float, n_chars: int) -> float:
    return 1.0 / (1.0 + math.exp(-(model.bias + model.slope * feature(weight, n_chars))))


def _near_key(tokens: list[str]) -> int:
    """A min-hash of the text's three-word shingles: near copies mostly share it."""
    return min((zlib.crc32(" ".join(tokens[i : i + 3]).encode()) for i in range(max(1, len(tokens) - 2))), default=0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def learn(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows (label 0 or 1), about sample_rows of them at most."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    n = rows.count()
    if not n:
        return Model()
    some = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / n)))
    some = some.withColumn("h", F.xxhash64("t")).dropDuplicates(["k", "h", "y"]).drop("h")

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for lo in range(0, len(whole), SLICE):  # lists of words are many times a text's size
                f = whole.iloc[lo : lo + SLICE]
                near, words = [], []
                for t in f.t:
                    w = fold(t).split()
                    near.append(_near_key(w))
                    words.append(sorted(set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}))
                yield pd.DataFrame({"y": f.y.to_numpy(), "near": near, "w": words})
        trim()

    t = some.mapInPandas(tokens, "y int, near long, w array<string>")
    sizes = t.groupBy("y").agg(F.countDistinct("near").alias("n")).collect()
    n_pos, n_neg = (next((r.n for r in sizes if r.y == v), 0) for v in (1, 0))
    if not n_pos or not n_neg:
        return Model()
    least = max(MIN_SUPPORT, SUPPORT * n_pos)
    # A word's rows: one per label and near key. Words of too little support leave before the driver sees them.
    counts = t.select("y", "near", F.explode("w").alias("w")).distinct().groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    worth = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    words = counts.filter((F.instr("w", " ") == 0) & (F.col("pos") >= least))
    # Phrases that clean rows mostly own; a word's clean rows outside its chief phrase are what counts against it.
    phrases = counts.filter((F.instr("w", " ") > 0) & (F.col("neg") >= MIN_SUPPORT) & (F.col("pos") * n_neg < F.col("neg") * n_pos))
    chief = phrases.select(F.explode(F.array_distinct(F.split("w", " "))).alias("w"), F.struct("neg", "pos", F.col("w").alias("p")).alias("c")).groupBy("w").agg(F.max("c").alias("c"))
    words = words.join(chief, "w", "left").withColumn("pos", F.col("pos") - F.coalesce("c.pos", F.lit(0))).withColumn("neg", F.col("neg") - F.coalesce("c.neg", F.lit(0)))
    top = words.withColumn("worth", worth).filter((F.col("pos") >= least) & (F.col("worth") >= MIN_WEIGHT)).select("w", "worth", "c.p")
    found = top.orderBy(F.desc("worth"), "w").limit(LEXICON_WORDS).collect()
    lexicon, exceptions = {r.w: r.worth for r in found}, sorted({r.p for r in found if r.p})
    model = Model(lexicon, exceptions)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [feature(model.weight(v), len(v or "")) for v in f.t], "y": f.y})

    seen = some.mapInPandas(weigh, "x double, y int").toPandas()
    model.bias, model.slope = _logistic(seen.x.to_numpy(), seen.y.to_numpy(float))
    return model


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and the score of the whole text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([score(model, model.weight(t), len(t or "")) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.col(text)))


def is_held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0


def learn_from_tables(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    own = labels.filter(~is_held_out(F.col("doc_id"))).select("doc_id", "toxic").dropna()
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter(F.col("toxic") == F.col("_most")).drop("_most")
    return learn(docs.select("doc_id", "text").join(own, "doc_id"), **options)
