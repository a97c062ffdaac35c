"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions.

The rules give the base spans, exactly.  The network, written and trained in
numpy, labels the characters around every digit and every '@' (each kind holds
one) in overlapping windows; where windows overlap, a character takes its label
from the window in which it lies deepest.  What the network finds beyond the
rules is kept when it passes the check of its kind and touches no base span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A run of digits that follows a digit can only begin inside a match that was tried, so possessive runs lose nothing.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(digits_of(s)) <= 15


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches, found from each '@': the run before it back to the last match, the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1] in "._%+-" or (text[low - 1].isascii() and text[low - 1].isalnum())):
            low -= 1
        m = DOMAIN.match(text, at + 1)
        if low < at and m:
            out.append(("email", low, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1) if low == at else done
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = emails(text) if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return out


# ---- windows

CONTEXT, WINDOW, STRIDE = 12, 96, 64


def windows(text: str) -> list[tuple[int, int]]:
    """Windows of at most WINDOW characters over all places near an anchor, overlapping by WINDOW - STRIDE."""
    out, start, end = [], -1, -1
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if a <= end:
            end = b
            continue
        if start >= 0:
            out.append((start, end))
        start, end = a, b
    if start >= 0:
        out.append((start, end))
    cut = []
    for a, b in out:
        while b - a > WINDOW:
            cut.append((a, a + WINDOW))
            a += STRIDE
        cut.append((a, b))
    return cut


CLASSES = "@.-_%+ ():;,\"'=/\n"


def char_ids(s: str) -> list[int]:
    """0 pads; 1 digit, 2 lower, 3 upper case ASCII, 4 other letters, 5 other; then the signs above."""
    out = []
    for c in s:
        k = CLASSES.find(c)
        out.append(6 + k if k >= 0 else 1 if "0" <= c <= "9" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isalpha() else 5)
    return out


N_CHARS, N_TAGS = 6 + len(CLASSES), 1 + 2 * len(KINDS)


def tags_of(start: int, end: int, spans: list[tuple[str, int, int]]) -> list[int]:
    """0 outside; for kind k, 1 + 2k begins and 2 + 2k continues."""
    out = [0] * (end - start)
    for kind, a, b in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        k = KINDS.index(kind)
        for i in range(max(a, start), min(b, end)):
            out[i - start] = 1 + 2 * k if i == a else 2 + 2 * k
    return out


# ---- the network


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Tagger:
    """Character embedding folded into the input weights, one LSTM in each direction, CRF output."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        f = lambda *shape: rng.normal(0, 0.25, shape)
        self.h = h
        self.p = {"xf": f(N_CHARS, 4 * h), "uf": f(h, 4 * h), "xb": f(N_CHARS, 4 * h), "ub": f(h, 4 * h), "o": f(2 * h, N_TAGS), "ob": np.zeros(N_TAGS), "a": f(N_TAGS, N_TAGS) * 0.1, "s": np.zeros(N_TAGS)}
        for k in ("xf", "xb"):
            self.p[k][:, h : 2 * h] += 1.0

    def lstm(self, x, u, ids, mask):
        n, t = ids.shape
        h, hs = self.h, []
        state, cell, kept = np.zeros((n, h)), np.zeros((n, h)), []
        for k in range(t):
            z = x[ids[:, k]] + state @ u
            i, f, o, g = sigmoid(z[:, :h]), sigmoid(z[:, h : 2 * h]), sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            tanh = np.tanh(new)
            m = mask[:, k : k + 1]
            kept.append((state, cell, i, f, o, g, tanh))
            cell = np.where(m, new, cell)
            state = np.where(m, o * tanh, state)
            hs.append(state)
        return np.stack(hs, axis=1), kept

    def lstm_back(self, u, ids, mask, kept, d_out, dx):
        n, t = ids.shape
        h, du = self.h, np.zeros_like(u)
        d_state, d_cell = np.zeros((n, h)), np.zeros((n, h))
        for k in reversed(range(t)):
            before, cell, i, f, o, g, tanh = kept[k]
            m = mask[:, k : k + 1]
            d = d_state + d_out[:, k]
            dh = np.where(m, d, 0)
            dc = np.where(m, d_cell, 0) + dh * o * (1 - tanh * tanh)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(dx, ids[:, k], dz)
            du += before.T @ dz
            d_state = np.where(m, dz @ u.T, d)
            d_cell = np.where(m, dc * f, d_cell)
        return du

    def emit(self, ids, mask):
        n, t = ids.shape
        lens = mask.sum(axis=1)
        turn = np.where(mask, lens[:, None] - 1 - np.arange(t), np.arange(t))
        turned = np.take_along_axis(ids, turn, axis=1)
        hf, kf = self.lstm(self.p["xf"], self.p["uf"], ids, mask)
        hb, kb = self.lstm(self.p["xb"], self.p["ub"], turned, mask)
        both = np.concatenate([hf, np.take_along_axis(hb, turn[:, :, None], axis=1)], axis=2)
        return both @ self.p["o"] + self.p["ob"], (both, kf, kb, turn, turned)

    def gradients(self, ids, mask, tags):
        """Of the negative log-likelihood of the tag paths, a window; also the loss."""
        p, (n, t) = self.p, ids.shape
        e, (both, kf, kb, turn, turned) = self.emit(ids, mask)
        fwd = np.zeros((n, t, N_TAGS))
        fwd[:, 0] = e[:, 0] + p["s"]
        for k in range(1, t):
            z = fwd[:, k - 1, :, None] + p["a"]
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + e[:, k]
            fwd[:, k] = np.where(mask[:, k : k + 1], new, fwd[:, k - 1])
        top = fwd[:, -1].max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(fwd[:, -1] - top).sum(axis=1))
        back = np.zeros((n, t, N_TAGS))
        da = np.zeros_like(p["a"])
        for k in reversed(range(t - 1)):
            z = p["a"][None] + (e[:, k + 1] + back[:, k + 1])[:, None]
            m = mask[:, k + 1 : k + 2]
            pair = np.exp(fwd[:, k, :, None] + z - total[:, None, None]) * m[:, :, None]
            da += pair.sum(axis=0)
            w = z.max(axis=2)
            back[:, k] = np.where(m, w + np.log(np.exp(z - w[:, :, None]).sum(axis=2)), back[:, k + 1])
        de = np.exp(fwd + back - total[:, None, None])
        rows = np.arange(n)
        gold = e[rows, 0, tags[:, 0]] + p["s"][tags[:, 0]]
        de[rows, 0, tags[:, 0]] -= 1
        for k in range(1, t):
            m = mask[:, k]
            gold = gold + np.where(m, e[rows, k, tags[:, k]] + p["a"][tags[:, k - 1], tags[:, k]], 0)
            de[rows[m], k, tags[m, k]] -= 1
            np.add.at(da, (tags[m, k - 1], tags[m, k]), -1)
        de *= mask[:, :, None]
        g = {"a": da, "s": de[:, 0].sum(axis=0), "ob": de.sum(axis=(0, 1)), "o": np.einsum("ntk,ntc->kc", both, de)}
        d_both = de @ p["o"].T
        g["xf"], g["xb"] = np.zeros_like(p["xf"]), np.zeros_like(p["xb"])
        g["uf"] = self.lstm_back(p["uf"], ids, mask, kf, d_both[:, :, : self.h], g["xf"])
        g["ub"] = self.lstm_back(p["ub"], turned, mask, kb, np.take_along_axis(d_both[:, :, self.h :], turn[:, :, None], axis=1), g["xb"])
        return g, float((total - gold).sum())

    def decode(self, ids, mask) -> np.ndarray:
        e, _ = self.emit(ids, mask)
        n, t = ids.shape
        best, back = e[:, 0] + self.p["s"], []
        for k in range(1, t):
            z = best[:, :, None] + self.p["a"]
            come = z.argmax(axis=1)
            new = np.take_along_axis(z, come[:, None], axis=1)[:, 0] + e[:, k]
            m = mask[:, k : k + 1]
            back.append(np.where(m, come, np.arange(N_TAGS)))
            best = np.where(m, new, best)
        path = [best.argmax(axis=1)]
        for come in reversed(back):
            path.append(come[np.arange(n), path[-1]])
        return np.stack(path[::-1], axis=1)

    def fit(self, texts: list[str], tags: list[list[int]], rounds: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 3):
        """Adam over windows of like length."""
        rng = np.random.default_rng(seed)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        groups = [order[b : b + batch] for b in range(0, len(order), batch)]
        for _ in range(rounds):
            for g in rng.permutation(len(groups)):
                own = groups[g]
                ids, mask = padded([texts[i] for i in own])
                gold = np.zeros(ids.shape, dtype=np.int64)
                for r, i in enumerate(own):
                    gold[r, : len(tags[i])] = tags[i]
                grads, _ = self.gradients(ids, mask, gold)
                step += 1
                for k, v in grads.items():
                    v = np.clip(v / len(own), -5, 5)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, texts))
    ids, mask = np.zeros((len(texts), t), dtype=np.int64), np.zeros((len(texts), t), dtype=bool)
    for r, s in enumerate(texts):
        ids[r, : len(s)] = char_ids(s)
        mask[r, : len(s)] = True
    return ids, mask


def tag_texts(net: Tagger, texts: list[str], batch: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in each text, over the whole text."""
    todo = [(d, a, b) for d, t in enumerate(texts) for a, b in windows(t)]
    todo.sort(key=lambda w: w[2] - w[1])
    labels: dict[int, dict[int, tuple[int, int]]] = {}
    for k in range(0, len(todo), batch):
        own = todo[k : k + batch]
        path = net.decode(*padded([texts[d][a:b] for d, a, b in own]))
        for (d, a, b), tags in zip(own, path, strict=True):
            mine, n = labels.setdefault(d, {}), len(texts[d])
            for i, tag in zip(range(a, b), tags.tolist(), strict=False):
                depth = min(i - a if a else n, b - 1 - i if b < n else n)
                if i not in mine or depth > mine[i][0]:
                    mine[i] = (depth, tag)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for d, mine in labels.items():
        start, kind, last = -1, -1, -2
        for i in [*sorted(mine), -1]:
            tag = mine[i][1] if i >= 0 else 0
            goes_on = start >= 0 and i == last + 1 and tag == 2 + 2 * kind
            if start >= 0 and not goes_on:
                out[d].append((KINDS[kind], start, last + 1))
                start = -1
            if not goes_on and tag % 2 == 1:
                start, kind = i, (tag - 1) // 2
            last = i
    return out


#: Forms in which people write what the rules ask for, as (kind, written, in the rules' form); spans are learned in both.
FORMS = (
    ("email", " @ ", "@"), ("email", "@ ", "@"), ("email", " @", "@"), ("email", " (@) ", "@"), ("email", "[@]", "@"),
    ("ip", "[.]", "."), ("ip", "(.)", "."), ("ip", " . ", "."), ("ip", " .", "."),
    ("card", ".", "-"), ("card", "/", "-"), ("card", "_", "-"), ("phone", "/", "-"), ("phone", "_", "-"), ("phone", "00", "+"), ("phone", "", "+"),
)


def ruled(kind: str, s: str) -> list[str]:
    """What a written form may stand for, in the form that the rules ask for."""
    out = [s]
    for k, written, form in FORMS:
        if k == kind and form != "+" and written in s:
            out.append(s.replace(written, form))
    if kind == "phone":
        out += ["+" + x.removeprefix("00") for x in list(out) if x[:1] != "+" and len(re.findall(r"[ ().-]+", x)) >= 2]
    return out


def well_formed(kind: str, s: str) -> bool:
    """The check that follows the network: one of the forms that the span may stand for is a whole match of the kind's rule."""
    return any(base_spans(x) == [(kind, 0, len(x))] for x in ruled(kind, s))


def varied(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The text once for each form, all base spans of that kind written in it; which spans there are is known, so these are labelled."""
    out = []
    for kind, written, form in FORMS:
        if not any(k == kind and form in (text[a : a + 1] if form == "+" else text[a:b].replace(" ", "-")) for k, a, b in spans):
            continue
        parts, at, moved, size = [], 0, [], 0
        for k, a, b in sorted(spans, key=lambda s: s[1]):
            if a < at:
                continue
            own = text[a:b]
            if k == kind:
                own = written + own[1:] if form == "+" else (own.replace(" ", "-") if form == "-" else own).replace(form, written)
            parts += [text[at:a], own]
            size += a - at
            moved.append((k, size, size + len(own)))
            size, at = size + len(own), b
        out.append(("".join([*parts, text[at:]]), moved))
    return out


def all_spans(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """The base spans, and what the network adds: well formed, and apart from every base span."""
    added = [(k, a, b) for k, a, b in found if well_formed(k, text[a:b]) and not any(a < y and x < b for _, x, y in base)]
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def train(docs: DataFrame, max_windows: int = 2500, text: str = "text") -> Tagger:
    """Fits the network on at most ``max_windows`` windows, labelled by the base spans.

    They come from about ``8 * max_windows`` documents at most, drawn by a hash of
    the text, of those that hold a digit or '@'.  Windows with spans are learned in
    other written forms too (see FORMS), so the network finds what the rules do not.
    """
    total = max(1, docs.count())
    share = min(1.0, 8 * max_windows / total)
    drawn = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).where(F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for pdf in batches:
            rows = []
            for t in pdf.text:
                spans = base_spans(t)
                rows += [(t[a:b], tags_of(a, b, spans)) for a, b in windows(t)]
                for other, moved in varied(t, spans):
                    rows += [(other[a:b], tags_of(a, b, moved)) for a, b in windows(other) if any(a < y and x < b for _, x, y in moved)]
            yield pd.DataFrame(rows, columns=["window", "tags"])

    got = drawn.mapInPandas(cut, "window string, tags array<int>").orderBy(F.xxhash64("window"), "window").limit(max_windows).collect()
    net = Tagger()
    return net.fit([r.window for r in got], [r.tags for r in got]) if got else net


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_windows: int = 2500, mask: str | None = None) -> DataFrame:
    """Base counts and digest, and all spans, for every row; ``mask`` names a column for the text with spans replaced by [KIND].

    A null or empty text has no spans (its masked text is itself); repeated rows
    give repeated results; columns other than ``keep`` are left out.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, max_windows, text))  # a few thousand numbers
    base = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"]

    def run(batches):
        for pdf in batches:
            given = pdf.pop("__text")
            texts = [t or "" for t in given]
            bases = [base_spans(t) for t in texts]
            spans = [all_spans(b, f, t) for b, f, t in zip(bases, tag_texts(net.value, texts), texts, strict=True)]
            counts = {f"n_{k}": np.array([sum(s[0] == k for s in b) for b in bases], dtype=np.int64) for k in KINDS}
            out = pdf.assign(**counts, base_sha256=[hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], spans=[joined(s) for s in spans])
            if mask:
                out[mask] = [None if t is None else masked(t, s) for t, s in zip(given, spans, strict=True)]
            yield out

    return base.mapInPandas(run, ", ".join([*fields, SCHEMA, *([f"`{mask}` string"] if mask else [])]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind; of overlapping ones the earliest, then longest, goes first and the rest of the others is masked too."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at:a] if a > at else "", f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
