import random
import re

import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import pii


def plain(t):
    """The patterns as the contract writes them."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d(m[0])) <= 19 and luhn(d(m[0]))]
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(d(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        parts = [rng.choice(["@", ".", "-", " ", "+", "(", ")", "a", "B", "é", "0", "00012", "4111111111111111", "255", "1.2.3", ".4", "x@y.z", "+1 (017) 555-7713"]) for _ in range(rng.randrange(14))]
        t = "".join(parts)
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = pii.Tagger.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, pii.N_CLASSES, (7, 3)), rng.integers(0, len(pii.TAGS), (7, 3))
    _, g = net.gradient(x, y)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape) if not k.startswith("emb") else (x[2, 1], 5)
        old, h = v[at], 1e-5
        v[at] = old + h
        up = net.gradient(x, y)[0]
        v[at] = old - h
        down = net.gradient(x, y)[0]
        v[at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-5, k


def test_reconcile_takes_the_best_set():
    assert pii.reconcile([(0, 5, "ip", 1.0), (4, 9, "ip", 1.5), (8, 12, "card", 1.0)]) == [(0, "ip", 5), (8, "card", 12)]
    assert pii.reconcile([]) == []


def test_model_finds_held_out_spans_and_adds_beside_base(spark):
    net = pii.train([], steps=150)
    rng = random.Random(99)
    x, y = pii._labelled([pii.synthetic(rng) for _ in range(200)])
    got, _ = net.decode(x)
    real = y > 0
    assert (got[real] == y[real]).mean() > 0.85 and (got[~real] > 0).mean() < 0.03
    texts = [None, "", "the and of " * 30 + "call (415) 555-0134 now " + "er an " * 40, "mail a.b@c.org or +1 (017) 555-7713", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = {r.doc_id: r for r in pii.find(df, net).collect()}
    assert pii.find(df.withColumn("doc_id", F.lit(None).cast("long")), net).filter("doc_id is null").count() == 5
    assert rows[0].spans == rows[1].spans == rows[4].spans == "" and rows[3].n_email == rows[3].n_phone == 1
    assert rows[3].spans.startswith("email:5:14,phone:18:35") and rows[2].n_phone == 0 and rows[2].n_added <= 1
    masked = {r.doc_id: r.text for r in pii.redact(df, net).collect()}
    assert masked[0] is None and masked[3] == "mail [email] or [phone]"
    assert pii.find(df.limit(0), net).count() == 0


class Sure:
    """A tagger that is sure of the given texts of one kind, also of a part of one at a window's edge."""

    def __init__(self, kind, *known):
        self.tag, self.known = pii.TAGS.index(f"B-{kind}"), [pii.encode(k) for k in known]

    def decode(self, x):
        y = np.zeros(x.shape, np.int64)
        for j in range(x.shape[1]):
            for k in self.known:
                for a in range(1 - len(k), len(x)):
                    lo, hi = max(a, 0), min(a + len(k), len(x))
                    if hi - lo >= 12 and np.array_equal(x[lo:hi, j], k[lo - a : hi - a]):
                        y[lo:hi, j] = self.tag + 1
                        y[lo, j] = self.tag
        return y, np.where(y > 0, 9.0, 0.0)


def test_spelled_out_addresses_are_added():
    forms = ["john dot smith at example dot org", "john[at]example[.]com", "JO.E[AT]EXAMPLE[.]COM", "anna(at)example(dot)org", "k.lee at mail dot host dot net"]
    for s in forms:
        t = "the and of " * 30 + s + " and more" * 30
        assert pii.added_spans(Sure("email", s), [t], [pii.base_spans(t)]) == [[(330, "email", 330 + len(s))]], s
    for s in ("we met at noon today", "look at example.com or", "polka dot dress code"):
        t = "the and of " * 30 + s + " and more" * 30
        assert pii.added_spans(Sure("email", s), [t], [[]]) == [[]], s


def test_long_spans_are_kept_wherever_they_stand():
    long = [" at ".join(["dot".join(["jo"] * n), "example dot " + "host" * n + " dot org"]) for n in (5, 10, 40)]
    for s in long:
        for lead in range(300, 350, 7):
            t = "the " * (lead // 4) + "x" * (lead % 4) + " " + s + " and" * 90
            assert pii.added_spans(Sure("email", s), [t, "no 1", t], [[], [], []]) == [[(lead + 1, "email", lead + 1 + len(s))], [], [(lead + 1, "email", lead + 1 + len(s))]]
    t = "x " * 100 + "1" * 5000  # cannot be a card: not decoded again
    assert pii.added_spans(Sure("card", "1" * 5000), [t], [[]]) == [[]]
