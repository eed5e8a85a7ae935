import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sheetwise.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_equal_to_the_library(byte_fallback):
    rng = random.Random(1)
    vocabulary = tokencount.read_vocabulary(PATH)
    assert len(vocabulary) == 32000 and vocabulary[0][0] == "<unk>"
    ours, theirs = tokencount.Counter(vocabulary, byte_fallback), library(vocabulary, byte_fallback)
    texts = ["a", " ", "  a", "a  b ", "the cat\nsat\t", "▁x ▁▁y", "<s> </s> <0x0A><unk>", "日本語 テスト \U0001f600\U0001f601 é", "x" * 3000, "\x00\x01"]
    for _ in range(400):
        texts.append("".join(rng.choice(["the ", "ing", "tion ", " ", "\n", "Ñandú", "q", "zz", "€", "1999", "ü ", "\U0001f600", "▁"]) for _ in range(rng.randrange(1, 40))))
    for t in texts:
        assert ours(t) == theirs(t), repr(t)
    assert ours("") == ours(None) == 0


def test_ties_take_the_longest_piece():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0), ("b", -4.0)]
    ours, theirs = tokencount.Counter(vocabulary, False), library(vocabulary, False)
    for t in ("a", "aa", "aaa", "aaaa", "aaaaaaa", "b", "ab", "ccc", "cac", "accca"):
        assert ours(t) == theirs(t), t


def test_tables(spark):
    rows = [(2**60 + 1, "x"), (None, "the"), (1, None), (2, ""), (3, "the cat"), (3, "the cat"), (4, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = [(r.doc_id, r.n_tokens, r.n_bytes) for r in tokencount.count_tokens(df, PATH).orderBy("doc_id").collect()]
    assert got[0][0] is None and got[6][0] == 2**60 + 1
    got = got[1:]
    assert got[:2] == [(1, 0, 0), (2, 0, 0)] and got[2] == got[3] and got[4][2] == 100_000
    assert tokencount.count_tokens(df.limit(0), PATH).count() == 0
