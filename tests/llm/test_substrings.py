import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import substrings


def brute(rows, width=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            s = t[i : i + width]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < d:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for n, letters in ((0, "a"), (1, "a"), (300, "a"), (500, "ab"), (2000, "abcdefgh"), (700, "\0a")):
        t = "".join(rng.choices(letters, k=n)).encode()
        t += t[: n // 2]
        data = np.frombuffer(t, np.uint8)
        sa, rank = substrings.suffix_array(data, 50)
        pad = lambda i: t[i : i + 64].ljust(64, b"\0")
        assert sorted(sa) == list(range(len(t))) and all(pad(a) <= pad(b) for a, b in zip(sa, sa[1:]))
        lcp = substrings.common_prefixes(data, sa, 50, strips=7)
        for k in range(1, len(t)):
            a, b, m = t[sa[k - 1] :], t[sa[k] :], 0
            while m < min(50, len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert lcp[k] == m


def sample_rows(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghié", k=rng.randrange(1, 8))) for _ in range(n))
    shared = [prose(rng.randrange(8, 60)) for _ in range(6)]
    rows = [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 50), (105, "x" * 300), (106, "ab" * 100), (107, "ba" * 60), (108, "\0" * 80), (109, "\0" * 60)]
    for d in range(60):
        parts = [prose(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng.randrange(0, 30))]
        rows.append((d, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(70, rows[15][1]), (71, rows[15][1]), (72, rows[20][1][5:]), (73, "q" + rows[20][1])]
    rng.shuffle(rows)
    return rows


def test_shards_merged_by_binary_search(monkeypatch):
    """Several suffix arrays a group, several chunks; workers read limits where they are pickled, so call the parts here."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 300)
    rows, width = sample_rows(4), 50
    payloads, kept = [], []
    for n in range(0, len(rows), 7):  # chunks of seven documents, each text a run
        chunk = [(d, (t or "").encode()) for d, t in rows[n : n + 7]]
        runs = [(i, d, b) for i, (d, b) in enumerate(chunk) if len(b) >= width]
        table = np.array([(k, len(b) - width + 1, d) for k, (_, d, b) in enumerate(runs)], substrings.RUN)
        payloads.append(np.int64(len(runs)).tobytes() + table.tobytes() + b"".join(b for _, _, b in runs))
        spots = np.array([(len(b) - width + 1, 1, d) for _, d, b in runs], substrings.SPOT)
        kept.append(np.array([len(chunk), len(runs)], "<i8").tobytes() + np.array([(d, 0) for d, _ in chunk], "<i8").tobytes() + spots.tobytes() + np.array([(i, 0) for i, _, _ in runs], substrings.PLACE).tobytes())
    places = {}
    for p, told in zip(kept, substrings.answers(payloads, width)):
        for (d, _), lo, hi in zip(*substrings.intervals_of(p, [told.tobytes()], width)):
            places.setdefault(d, []).append({"lo": lo, "hi": hi})
    got = []
    for d, t in rows:
        left, gone, n = substrings._cut((t or "").encode(), places.get(d))
        got.append((d, len((t or "").encode()), gone, n, hashlib.sha256(left).hexdigest()))
    assert sorted(got) == brute(rows)


def test_long_texts_are_looked_at_in_pieces(monkeypatch):
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choices("abc ", k=5000)).encode(), np.uint8)
    whole = [at for _, _, _, _, at in substrings._texts(data, np.array([0, 5000]), 50)]
    monkeypatch.setattr(substrings, "PIECE_BYTES", 333)
    cut = [base + at for _, base, _, _, at in substrings._texts(data, np.array([0, 5000]), 50)]
    assert len(cut) > 10 and (np.concatenate(cut) == whole[0]).all()


def test_equal_to_brute_force(spark):
    rows = sample_rows(3) + [(200, "one row " * 20), (200, "two rows " * 20), (201, "two rows " * 20), (202, "one row " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("spans", F.lit(2)).repartition(3)
    got = sorted(tuple(r) for r in substrings.removal(df).collect())
    assert got == brute(rows)
    # Rows of one doc_id lose what they lose themselves.
    again = [(1, "first text of all " * 9), (5, "first text of all " * 9 + "x"), (5, "y" * 70 + "first text of all " * 5), (5, "y" * 70 + "first text of all " * 5)]
    assert sorted(tuple(r) for r in substrings.removal(spark.createDataFrame(again, "doc_id long, text string")).collect()) == brute(again)
    nameless = spark.createDataFrame([(None, "a b " * 30), (None, "a b " * 30), (1, "a b " * 30)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.removal(nameless).collect()) == [(0, 120, 0), (0, 120, 0), (1, 120, 0)]
    assert substrings.removal(df.limit(0)).count() == 0


def test_common_anchors_are_cut_up(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(120)
    rows = [(i, prose(40) + passage + prose(40)) for i in range(substrings.HEAVY + 50)]
    got = sorted(tuple(r) for r in substrings.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
