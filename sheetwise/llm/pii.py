"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

Base spans of the four kinds come from patterns over the whole text. The model, trained here in numpy
from labelled spans, tags characters with B/I tags of the kinds. Texts are covered by overlapping
windows; each is decoded by Viterbi, and the windows' spans of a text are reconciled together: of all
sets of spans that do not overlap, that with the largest total score is taken. A span that no window
holds whole is decoded again in windows centred on it, widened until it ends inside. A span of the model is
added if it overlaps no base span, its mean score is large enough and its text fits its kind (Luhn,
at most 255, number of digits, an at sign and dots, which may be spelled out: 'a at b dot org',
'a[at]b[.]org'). Every such span holds a digit, an at sign or a spelled-out one that a label and a
spelled-out dot follow, so windows without one cannot add anything and are not computed: a lossless
test, not a cap.

Labelled spans for training: base spans in windows of a bounded sample of texts (`sample_rows`), and
spans written by a seeded generator in usual and unusual forms among look-alikes that are no personal data.

Defined results: null and empty texts have no spans; repeated rows are searched each; a null doc_id stays null; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed. Fixed values.
KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SAMPLE_ROWS = 400
WINDOW, STRIDE = 96, 48
HIDDEN = 16
MIN_MEAN = 2.0  # of a model span's score per character
RESULT = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_TRIGGER = re.compile("[0-9@]")
_AT, _DOT = r"(?: at |\x20?[\[(]at[\])]\x20?)", r"(?: dot |\x20?[\[(](?:\.|dot)[\])]\x20?)"
_LABEL = r"[A-Za-z0-9_%+-]+"
#: An email address with its signs spelled out; the name before the at sign may have plain dots too.
_SPELLED = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.IGNORECASE | re.ASCII)
#: What a span of the model must hold: a digit, an at sign, or what _SPELLED has from its at sign on.
_HINT = re.compile(rf"[0-9@]|{_AT}(?={_LABEL}{_DOT}{_LABEL})", re.IGNORECASE | re.ASCII)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The same matches as without look-behind and possessive repeats, in linear time on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(d: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
    return (sum(map(int, d[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each at sign backwards: linear in the text."""
    done, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > done and t[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        else:
            done = at + 1
        at = t.find("@", max(done, at + 1))


def base_spans(t: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' spans, by start, then kind as listed."""
    if not _TRIGGER.search(t):
        return []
    out = [(a, "email", b) for a, b in _emails(t)]
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(t) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# ---- characters


def _classes() -> np.ndarray:
    """Class of each ASCII character: small letters and signs one by one, capitals, digits and the rest together."""
    table = np.zeros(129, np.int64)
    own = "abcdefghijklmnopqrstuvwxyz .@-+()_%\n\":,[]/=#"
    for i, c in enumerate(own):
        table[ord(c)] = i + 1
    table[48:58], table[65:91], table[128] = len(own) + 1, len(own) + 2, len(own) + 3
    return table


_CLASS = _classes()
N_CLASSES = int(_CLASS.max()) + 1


def encode(t: str) -> np.ndarray:
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[np.minimum(codes, 128)]


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, emb: np.ndarray, rec: np.ndarray, keep: bool):
    """Hidden states (T, B, H) over class indices x (T, B); with keep also what training needs."""
    n, b = x.shape
    h, c = np.zeros((b, HIDDEN), emb.dtype), np.zeros((b, HIDDEN), emb.dtype)
    hs, kept = np.empty((n, b, HIDDEN), emb.dtype), []
    for t in range(n):
        z = emb[x[t]] + h @ rec
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        old_h, old_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            kept.append((i, f, o, g, old_h, old_c, tc))
    return hs, kept


def _lstm_back(x: np.ndarray, dh_all: np.ndarray, emb: np.ndarray, rec: np.ndarray, kept: list):
    d_emb, d_rec = np.zeros_like(emb), np.zeros_like(rec)
    dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, old_h, old_c, tc = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(d_emb, x[t], dz)
        d_rec += old_h.T @ dz
        dh, dc = dz @ rec.T, dc * f
    return d_emb, d_rec


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Loss of the gold tags y (T, B) and its gradients for emissions e (T, B, K) and transitions."""
    n, b, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, n):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, n):
        d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    at = np.arange(b)
    gold = e[0, at, y[0]]
    for t in range(n):
        de[t, at, y[t]] -= 1
        if t:
            gold = gold + trans[y[t - 1], y[t]] + e[t, at, y[t]]
            np.add.at(d_trans, (y[t - 1], y[t]), -1)
    return float((z - gold).mean()), de / b, d_trans / b


@dataclass
class Tagger:
    """Parameters: embeddings into gates and recurrences of both directions, output layer, transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        g = lambda *shape: (rng.normal(size=shape) * 0.15).astype(np.float32)
        emb = {f"emb{d}": g(N_CLASSES, 4 * HIDDEN) for d in "fb"}
        for e in emb.values():
            e[:, HIDDEN : 2 * HIDDEN] += 1  # forget little at first
        return cls(emb | {f"rec{d}": g(HIDDEN, 4 * HIDDEN) for d in "fb"} | {"out": g(2 * HIDDEN, len(TAGS)), "bias": np.zeros(len(TAGS), np.float32), "trans": g(len(TAGS), len(TAGS))})

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, kf = _lstm(x, self.p["embf"], self.p["recf"], keep)
        b, kb = _lstm(x[::-1], self.p["embb"], self.p["recb"], keep)
        h = np.concatenate([f, b[::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (h, kf, kb)

    def gradient(self, x: np.ndarray, y: np.ndarray):
        e, (h, kf, kb) = self.emissions(x, True)
        loss, de, d_trans = _crf_gradient(e, y, self.p["trans"])
        dh = de @ self.p["out"].T
        d = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum((0, 1)), "trans": d_trans}
        d["embf"], d["recf"] = _lstm_back(x, dh[:, :, :HIDDEN], self.p["embf"], self.p["recf"], kf)
        d["embb"], d["recb"] = _lstm_back(x[::-1], dh[::-1, :, HIDDEN:], self.p["embb"], self.p["recb"], kb)
        return loss, d

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (T, B), and how far each chosen tag's emission is above that of O."""
        e, _ = self.emissions(x)
        n, b, _ = e.shape
        best, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, n):
            s = best[:, :, None] + self.p["trans"]
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
        y = np.empty((n, b), np.int64)
        y[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            y[t - 1] = back[t][np.arange(b), y[t]]
        return y, np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] - e[:, :, 0]


# ---- labelled spans


def _span_text(rng: random.Random, kind: str) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda a, b: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(a, b)))
    if kind == "email":
        dot, at = rng.choice(((".", "@"), (".", "@"), (" dot ", " at "), ("[.]", "[at]"), (".", " @ ")))
        return w(2, 9) + rng.choice(("", dot + w(2, 8), d(2), "." + d(2))) + at + w(3, 9) + rng.choice(("", d(1))) + rng.choice(("", dot + w(4, 8))) + dot + rng.choice(("com", "org", "net", "de", "fr"))
    if kind == "ip":
        return rng.choice((".", ".", ".", "[.]", " . ", "-")).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        n = rng.choice((13, 14, 15, 16, 16, 16, 19))
        s = rng.choice("3456") + d(n - 2)
        s += next(c for c in "0123456789" if luhn(s + c))
        return rng.choice((s, s, *(c.join(s[i : i + 4] for i in range(0, n, 4)) for c in " -./")))
    return rng.choice((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"+{d(2)}{d(10)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"))


def _decoy(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    h = "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 32, 40))))
    return rng.choice((f'token = "{h}"', h, h.upper(), f"{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", d(rng.randint(1, 6)), f"{d(1)},{d(3)}.{d(2)}", f"@{'abcdefgh'[: rng.randint(2, 8)]}", f"{d(2)}:{d(2)}", f"{d(1)}) ", f"${d(3)}", f"version {d(1)}"))


def synthetic(rng: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A window of made-up prose with spans and look-alikes."""
    word = lambda: "".join(rng.choices(("th", "er", "an", "in", "ou", "es", "ver", "ción", "a", "é", "qu", "st"), k=rng.randint(1, 5)))
    t, spans = "", []
    while len(t) < WINDOW:
        r = rng.random()
        if r < 0.22:
            kind = rng.choice(KINDS)
            s = _span_text(rng, kind)
            spans.append((len(t), kind, len(t) + len(s)))
        elif r < 0.34:
            s = _decoy(rng)
        else:
            s = word()
        if rng.random() < 0.1:
            s = s.upper()
        t += s + rng.choice((" ", " ", " ", " ", ", ", ". ", ".\n", "!! ", "*** ", "### ", " | "))
    return t, spans


def _labelled(windows: list[tuple[str, list[tuple[int, str, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.int64)
    for i, (t, spans) in enumerate(windows):
        c = encode(t[:WINDOW])
        x[: len(c), i] = c
        for a, kind, b in spans:
            if a < WINDOW:
                tag = TAGS.index(f"B-{kind}")
                y[a : min(b, WINDOW), i] = tag + 1
                y[a, i] = tag
    return x, y


def train(windows: list[tuple[str, list[tuple[int, str, int]]]], *, seed: int = 11, steps: int = 240, batch: int = 64, rate: float = 0.02) -> Tagger:
    """Adam over batches of half the given windows and half generated ones."""
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    net = Tagger.fresh(gen)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        own = rng.sample(windows, min(len(windows), batch // 3))
        x, y = _labelled(own + [synthetic(rng) for _ in range(batch - len(own))])
        _, g = net.gradient(x, y)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, a in g.items():
            a = a / max(1.0, norm / 5)
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.p[k] -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def labelled_windows(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Windows of at most sample_rows texts with a digit or at sign, labelled by the patterns; only windows reach the driver."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f.t:
                spans = base_spans(t)
                at = [s[0] for s in spans[:4]] + [m.start() for _, m in zip(range(4), _TRIGGER.finditer(t))]
                for a in at:
                    lo = max(0, a - 40)
                    inside = [s for s in spans if lo <= s[0] < lo + WINDOW]
                    out.append((t[lo : lo + WINDOW], [s[0] - lo for s in inside], [s[1] for s in inside], [min(s[2], lo + WINDOW) - lo for s in inside]))
            yield pd.DataFrame(out, columns=["t", "a", "k", "b"])

    held = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    # The texts of the smallest hashes: only hashes are sorted, and equal texts count once.
    last = held.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    some = held.filter(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"]).select("t")
    rows = some.mapInPandas(cut, "t string, a array<long>, k array<string>, b array<long>").toPandas()
    rows = rows.sort_values("t")
    return [(t, list(zip(map(int, a), k, map(int, b), strict=True))) for t, a, k, b in zip(rows.t, rows.a, rows.k, rows.b, strict=True)]


# ---- windows of whole texts, and reconciling


def _fits(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z@]", s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z@]", s) and s[0] in "+(0123456789"
    if "@" not in s:
        return _SPELLED.fullmatch(s) is not None
    return re.fullmatch(r"[^\s@]+\s?@\s?[^\s@.]+(\s?\.\s?[^\s@.]+)+", s) is not None


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, str, int]]:
    """Of (start, end, kind, score), the set without overlaps of largest total score (weighted interval scheduling)."""
    best: dict[tuple[int, int, str], float] = {}
    for a, b, k, s in found:
        best[a, b, k] = max(s, best.get((a, b, k), s))
    items = sorted(((b, a, k, s) for (a, b, k), s in best.items()))
    ends, total, take = [i[0] for i in items], [0.0], []
    for n, (_, a, _, s) in enumerate(items):
        j = int(np.searchsorted(ends[:n], a, side="right"))
        take.append((total[j] + s > total[n], j))
        total.append(max(total[n], total[j] + s))
    out, n = [], len(items)
    while n:
        yes, j = take[n - 1]
        if yes:
            b, a, k, _ = items[n - 1]
            out.append((a, k, b))
        n = j if yes else n - 1
    return out[::-1]


def _hints(t: str) -> Iterator[re.Match]:
    """Matches of _HINT; without a spelled-out dot only those of _TRIGGER are possible, which is quicker."""
    low = t.lower()
    return (_HINT if any(d in low for d in (" dot ", "[.]", "(.)", "[dot]", "(dot)")) else _TRIGGER).finditer(t)


def _may_fit(kind: str, part: str) -> bool:
    """Whether a span that holds `part` can fit its kind: only a number of digits rules it out."""
    return kind == "email" or len(_digits(part)) <= {"ip": 12, "card": 19, "phone": 15}[kind]


def _tagged(net: Tagger, texts: list[str], places: list[tuple[int, int]], width: int, at_once: int) -> Iterator[tuple[int, int, int, int, str, float, bool]]:
    """(place, text, start, end, kind, mean score, whole) of the spans in windows of one width; a span that a window cuts is not whole."""
    for lo in range(0, len(places), at_once):
        part = places[lo : lo + at_once]
        x = np.zeros((width, len(part)), np.int64)
        for j, (i, s) in enumerate(part):
            c = encode(texts[i][s : s + width])
            x[: len(c), j] = c
        y, score = net.decode(x)
        for j in np.flatnonzero((y > 0).any(axis=0)):
            i, s = part[j]
            t = 0
            while t < width:
                if y[t, j] == 0:
                    t += 1
                    continue
                k = (y[t, j] - 1) // 2
                end = t + 1
                while end < width and y[end, j] == 2 * k + 2:
                    end += 1
                whole = (t > 0 or s == 0) and (end < width or s + end >= len(texts[i]))  # not cut by the window
                yield lo + int(j), i, s + t, s + end, KINDS[k], float(score[t:end, j].mean()), whole
                t = end


def _wider(cut: list[tuple[int, int, int]], width: int) -> dict[int, list[tuple[int, int, int]]]:
    """The cut stretches (text, start, end), those that overlap or touch as one, by the width of their next window."""
    joined: list[tuple[int, int, int]] = []
    for i, a, b in sorted(cut):
        if joined and joined[-1][0] == i and a <= joined[-1][2]:
            joined[-1] = (i, joined[-1][1], max(b, joined[-1][2]))
        else:
            joined.append((i, a, b))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, a, b in joined:
        w = 2 * width
        while w < 2 * (b - a):
            w *= 2
        out.setdefault(w, []).append((i, a, b))
    return out


def added_spans(net: Tagger, texts: list[str], bases: list[list[tuple[int, str, int]]], at_once: int = 512) -> list[list[tuple[int, str, int]]]:
    """The model's spans for each text, beside its base spans."""
    places = []
    for i, t in enumerate(texts):
        starts = {max(0, s) for m in _hints(t) for s in ((m.start() // STRIDE - 1) * STRIDE, m.start() // STRIDE * STRIDE)}
        places += [(i, s) for s in sorted(starts)]
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    cut: list[tuple[int, int, int]] = []

    def take(i: int, a: int, b: int, kind: str, mean: float) -> None:
        if b <= len(texts[i]) and mean >= MIN_MEAN and _fits(kind, texts[i][a:b]):
            found[i].append((a, b, kind, mean * (b - a)))

    for _, i, a, b, kind, mean, whole in _tagged(net, texts, places, WINDOW, at_once):
        if whole:
            take(i, a, b, kind, mean)
        elif b - a >= STRIDE and _may_fit(kind, texts[i][a:b]):  # the end of a shorter stretch lies inside another window
            cut.append((i, a, b))
    later = _wider(cut, WINDOW)
    while later:  # windows centred on what was cut, widened until it ends inside
        width = min(later)
        wanted, cut = later.pop(width), []
        places = [(i, max(0, (a + b) // 2 - width // 2)) for i, a, b in wanted]
        for n, i, a, b, kind, mean, whole in _tagged(net, texts, places, width, max(1, at_once * WINDOW // width)):
            if a < wanted[n][2] and wanted[n][1] < b:
                if whole:
                    take(i, a, b, kind, mean)
                elif _may_fit(kind, texts[i][a:b]):
                    cut.append((i, a, b))
        for w, more in _wider(cut, width).items():
            later.setdefault(w, []).extend(more)
    out = []
    for f, base in zip(found, bases, strict=True):
        f = [x for x in f if all(x[1] <= a or b <= x[0] for a, _, b in base)] if f else f
        out.append(reconcile(f))
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, net: Tagger, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT: base spans' counts and digest, all spans, and how many the model added."""
    # As strings, ids with nulls among them do not become floats on their way through pandas.
    d = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(f.text)
            bases = [base_spans(t) for t in texts]
            out = []
            for i, base, more in zip(f.doc_id, bases, added_spans(net, texts, bases), strict=True):
                n = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))
                out.append([i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(more)])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return d.mapInPandas(search, RESULT).withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))


def redact(docs: DataFrame, net: Tagger, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        bases = [base_spans(t) for t in whole]
        out = []
        for t, given, base, more in zip(whole, texts, bases, added_spans(net, whole, bases), strict=True):
            parts, at = [], 0
            for a, k, b in sorted(base + more):
                if a >= at:
                    parts += [t[at:a], f"[{k}]"]
                at = max(at, b)
            out.append(None if given is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype="object")

    return docs.withColumn(text, masked(F.col(text)))
