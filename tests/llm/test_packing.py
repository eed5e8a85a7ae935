import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], "<u4")


def test_chunks_give_the_tokenizers_ids():
    texts = ["", " ", "The cat's  hat,\tdidn't\nI'LL", "ÀÉ ΣΑΣ ﬁ İI é  x y\u0085z\x1cq", "a<|endoftext|>b <|EndOfText|> <|startoftext|>", "日本語 テスト 123 4a5", "x" * 5000, "x²,y½. été,µß_ª!!### 12a,b3 ÇA\xa0va\x85.\xad-", "l'été don't 'sam 'S", "\x00 ퟿ \U0001f600"]
    t = packing.ChunkTokenizer(PATH)
    for _ in range(2):
        assert [b + b"\1\0\0\0" for b in t(texts)] == [brute(x).tobytes() for x in texts]


def test_pieces_tile_documents_and_sequences(spark):
    rows = [(None, "no id")] + [(i, "word " * (i * 37 % 3000) if i % 7 else None) for i in range(60)] + [(5, "twice"), (5, "twice"), (99, "lang " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x")).withColumn("length", F.lit("y")).repartition(3)
    got = packing.pack(docs, PATH, want_ids=True).toPandas()
    texts = dict(rows)
    for doc, g in got[got.doc_id != 5].groupby("doc_id"):
        g = g.sort_values("start")
        ids = brute(texts[doc])
        assert (g.doc_tokens == len(ids)).all() and list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids)
        for _, p in g.iterrows():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.ids == ids[p.start : p.start + p.length].tobytes()
    assert got.doc_id.isna().sum() >= 1 and sum(1 for d, t in rows if d == 5) == 3 and (got[got.doc_id == 5].start == 0).sum() == 3
    sizes = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
        sizes.append(g.length.sum())
    assert sum(sizes) / (2048 * len(sizes)) > 0.9
    assert packing.pack(docs.limit(0), PATH).count() == 0
