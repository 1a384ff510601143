"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The network reads character classes and gives each character scores for seven tags (none,
the four kinds of the patterns, secrets, and a span's first character); the CRF adds transitions.  Both are trained
here, in numpy, from labelled spans: what the patterns find in a bounded sample of
documents, and spans of many written forms set into their sentences.  Every text is read
whole, in overlapping windows.  Each window's marginals are decoded by the CRF; where windows
overlap, marginals are averaged, those far from a window's edge counting most, and the tags
of the whole text follow from the averages.  Runs of a tag that overlap no span of the
patterns are added: cards run together or with a wrong check digit, phones without a plus
sign or beside other numbers, addresses written with [at], digits of other scripts, secrets.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import per_batch, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: secrets have no pattern.
ALL_KINDS = (*KINDS, "secret")
#: Tags: none, the kinds, and the first character of a span of any kind, which parts neighbours.
BEGIN = len(ALL_KINDS) + 1
TAGS = BEGIN + 1
#: Window and step in characters: any span of up to 64 characters stands whole in a window.
WINDOW, STEP = 256, 192
#: Characters of a training window.
TRAIN_WINDOW = 128
#: Bounds of the training sample: documents with a digit or an @, and characters of each.
MAX_DOCS, MAX_CHARS = 300, 5_000
#: Mean averaged marginal that an added span needs.
CONFIDENCE = 0.8
HIDDEN = 12
#: Windows that the network reads at once.
BATCH = 1024

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is tried once: if no match starts at its first digit, none starts within it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    done = 0
    for m in _AT.finditer(text):
        at = lo = m.start()
        # The local part is the whole run of its characters before the @, down to the last match.
        while lo > done:
            some = text[max(done, lo - 256) : lo]
            bare = some.rstrip(_LOCAL)
            lo -= len(some) - len(bare)
            if bare:
                break
        if lo < at:
            yield lo, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within each kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Class of each code point below 65536: 0 pads, 1 is everything beyond; marks keep a class of their own.
_MARKS = " \n@.-_%+()=\":/,'[]"
_CLASS = np.ones(1 << 16, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 2, 3, 4
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 5 + _i
# Digits of other scripts are digits, the wide @ and full stop are theirs.
for _d in (0xFF10, 0x0660, 0x06F0, 0x0966):
    _CLASS[_d : _d + 10] = 2
_CLASS[0xFF20], _CLASS[0xFF0E], _CLASS[0xFF0B] = _CLASS[ord("@")], _CLASS[ord(".")], _CLASS[ord("+")]
CLASSES = 5 + len(_MARKS)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 0xFFFF)]


@dataclass
class Net:
    """Input tables (2, classes, 4H), recurrent weights (2, H, 4H), output, transitions.

    Gates and cells are clipped lines (z / 4 + 1 / 2 within 0 and 1, z within -1 and 1): exact to
    differentiate, and several times faster than tanh.
    """

    e: np.ndarray
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    a: np.ndarray

    def params(self):
        return [self.e, self.w, self.u, self.b, self.a]

    def forward(self, x: np.ndarray, keep: bool = False):
        """Tag scores (n, t, tags) of class windows (n, t); with what the gradient needs."""
        n, t = x.shape
        h_size = self.w.shape[1]
        both = np.stack([x, x[:, ::-1]])
        h = np.zeros((2, n, h_size), np.float32)
        c = np.zeros_like(h)
        hs, saved = np.empty((2, n, t, h_size), np.float32), []
        side = np.arange(2)[:, None]
        for k in range(t):
            z = self.e[side, both[:, :, k]] + np.matmul(h, self.w)
            s = np.clip(z[..., : 3 * h_size] * np.float32(0.25) + np.float32(0.5), 0, 1)
            i, f, o = s[..., :h_size], s[..., h_size : 2 * h_size], s[..., 2 * h_size :]
            g = np.clip(z[..., 3 * h_size :], -1, 1)
            before = c
            c = f * c + i * g
            tc = np.clip(c, -1, 1)
            if keep:
                saved.append((h, before, i, f, o, g, tc))
            h = o * tc
            hs[:, :, k] = h
        scores = hs[0] @ self.u[0] + hs[1][:, ::-1] @ self.u[1] + self.b
        return scores, (both, hs, saved)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """``forward``'s tag scores alone, (t, tags, n): gates in rows, so each is one run of memory."""
        n, t = x.shape
        size = self.w.shape[1]
        scale, shift = np.ones((4 * size, 1), np.float32), np.zeros((4 * size, 1), np.float32)
        scale[: 3 * size], shift[: 3 * size] = 0.25, 0.5
        one, low = np.float32(1), np.where(np.arange(4 * size) < 3 * size, 0, -1).astype(np.float32)[:, None]
        out = np.empty((t, self.b.shape[0], n), np.float32)
        out[:] = self.b[:, None]
        xt = np.ascontiguousarray(x.T).astype(np.intp)
        z, rec, part, said = np.empty((4 * size, n), np.float32), np.empty((4 * size, n), np.float32), np.empty((size, n), np.float32), np.empty((len(self.b), n), np.float32)
        for side in (0, 1):
            e = np.ascontiguousarray(self.e[side].T * scale + shift)
            w = np.ascontiguousarray(self.w[side].T * scale)
            u = np.ascontiguousarray(self.u[side].T)
            h, c = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
            i, f, o, g = (z[k * size : (k + 1) * size] for k in range(4))
            for k in range(t) if side == 0 else range(t - 1, -1, -1):
                e.take(xt[k], axis=1, out=z, mode="clip")
                np.matmul(w, h, out=rec)
                z += rec
                np.maximum(z, low, out=z)
                np.minimum(z, one, out=z)
                c *= f
                np.multiply(i, g, out=part)
                c += part
                np.maximum(c, -one, out=part)
                np.minimum(part, one, out=part)
                np.multiply(o, part, out=h)
                np.matmul(u, h, out=said)
                out[k] += said
        return out

    def chance(self, s: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability that any place of each window has a tag, of scores (t, tags, n): forward
        alone, with the path of none everywhere as the unit."""
        a = np.exp(np.clip(self.a - self.a[0, 0], -30, 20)).astype(np.float32).T.copy()
        e = np.exp(np.clip(s - s[:, :1], -30, 20))
        alpha, step = e[0].copy(), np.empty_like(e[0])
        whole = mask.all(1)
        for j in range(1, len(e)):
            np.matmul(a, alpha, out=step)
            step *= e[j]
            np.minimum(step, np.float32(1e6), out=step)
            if whole.all() or mask[:, j].all():
                alpha, step = step, alpha
            else:
                np.copyto(alpha, step, where=mask[:, j])
        return 1 - 1 / alpha.sum(0)

    def marginals(self, s: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(n, t, tags) of scores (t, tags, n): forward and backward, scaled at every step."""
        t, k, n = s.shape
        e = np.exp((s - s.max(1, keepdims=True)).transpose(0, 2, 1).astype(np.float64))
        a = np.exp(self.a.astype(np.float64) - self.a.max())
        alpha, beta = np.empty((t, n, k)), np.ones((t, n, k))
        alpha[0] = e[0]
        for j in range(1, t):
            step = (alpha[j - 1] @ a) * e[j]
            step /= step.sum(1, keepdims=True)
            alpha[j] = np.where(mask[:, j, None], step, alpha[j - 1])
        for j in range(t - 2, -1, -1):
            step = (beta[j + 1] * e[j + 1]) @ a.T
            step /= step.sum(1, keepdims=True)
            beta[j] = np.where(mask[:, j + 1, None], step, beta[j + 1])
        p = alpha * beta
        return (p / p.sum(2, keepdims=True)).transpose(1, 0, 2)

    def backward(self, d: np.ndarray, kept) -> list[np.ndarray]:
        both, hs, saved = kept
        h_size = self.w.shape[1]
        flat = d.reshape(-1, d.shape[-1])
        gu = np.stack([hs[0].reshape(-1, h_size).T @ flat, hs[1][:, ::-1].reshape(-1, h_size).T @ flat])
        gh = np.stack([d @ self.u[0].T, (d @ self.u[1].T)[:, ::-1]])
        ge, gw = np.zeros_like(self.e), np.zeros_like(self.w)
        dh, dc = np.zeros_like(gh[:, :, 0]), np.zeros_like(gh[:, :, 0])
        dzs = np.empty((2, both.shape[1], len(saved), 4 * h_size), np.float32)
        for k in range(len(saved) - 1, -1, -1):
            h, before, i, f, o, g, tc = saved[k]
            dh = dh + gh[:, :, k]
            dc = dc + dh * o * (np.abs(tc) < 1)
            gate = lambda y: np.float32(0.25) * ((y > 0) & (y < 1))
            dz = np.concatenate([dc * g * gate(i), dc * before * gate(f), dh * tc * gate(o), dc * i * (np.abs(g) < 1)], -1)
            gw += np.matmul(h.transpose(0, 2, 1), dz)
            dzs[:, :, k] = dz
            dh, dc = np.matmul(dz, self.w.transpose(0, 2, 1)), dc * f
        for s in (0, 1):
            seen = (both[s].reshape(-1) == np.arange(self.e.shape[1])[:, None]).astype(np.float32)
            ge[s] = seen @ dzs[s].reshape(-1, 4 * h_size)
        return [ge, gw, gu, flat.sum(0)]

    def posterior(self, s: np.ndarray, mask: np.ndarray):
        """Tag marginals, pair marginals summed, and log Z, of the CRF over scores; mask is a prefix of each row."""
        n, t, k = s.shape

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for j in range(1, t):
            alpha[:, j] = np.where(mask[:, j, None], lse(alpha[:, j - 1, :, None] + self.a, 1) + s[:, j], alpha[:, j - 1])
        z = lse(alpha[:, -1], 1)
        pairs = np.zeros_like(self.a)
        for j in range(t - 2, -1, -1):
            on = mask[:, j + 1, None]
            nxt = s[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(on, lse(self.a + nxt[:, None, :], 2), beta[:, j + 1])
            pairs += (np.exp(alpha[:, j, :, None] + self.a + nxt[:, None, :] - z[:, None, None]) * on[:, :, None]).sum(0)
        return np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None], pairs, z


def _forms(r: random.Random, kind: str | None = None) -> tuple[str, str, str, str]:
    """(kind, text before, written form, text after), with made-up content."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzeeaaoonnttiirrss") for _ in range(r.randint(2, 9)))
    kind = kind or r.choice(("email", "ip", "card", "card", "phone", "phone", "secret", "secret"))
    if kind == "email":
        name = word() + r.choice(["", "." + word(), "_" + word(), "." + digits(2), digits(2), "-" + word()])
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" [at] ", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        host = word() + r.choice(["", digits(1), "-" + word(), dot + word()]) + dot + r.choice(["com", "org", "net", "de", "fr", "es", "example" + dot + "com", "co" + dot + "uk"])
        return kind, "", (name.title() if r.random() < 0.15 else name) + at + host, ""
    if kind == "ip":
        form = ".".join(str(r.randint(0, 255)) for _ in range(4))
        return kind, "", form, r.choice(["", "", "", ":" + digits(4)])
    if kind == "card":
        # The check digit is not for the network to learn: mistyped numbers are cards too.
        n = 16 if r.random() < 0.85 else r.choice([13, 14, 15, 19])
        body, sep = digits(n), r.choice(["", "", "", " ", "-"])
        return kind, "", sep.join(body[i : i + 4] for i in range(0, n, 4)), ""
    if kind == "secret":
        chars, n = r.choice([("0123456789abcdef", 40), ("0123456789abcdef", 32), ("0123456789abcdef", 64), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randint(20, 40))])
        value = "".join(r.choice(chars) for _ in range(n))
        name, quote = r.choice(["token", "api_key", "secret", "password", "key", word()]), r.choice(['"', '"', "'", ""])
        return kind, name + r.choice([" = ", " = ", "=", ": "]) + quote, value, quote
    n = digits(3), digits(3), digits(4)
    form = r.choice(["+1 ({}) {}-{}", "+1 ({}) {}-{}", "+1 {} {} {}", "+1-{}-{}-{}", "+49 {} {}{}", "+33 {} {} {}", "({}) {}-{}", "({}) {}-{}", "+{}{}{}", "+44 (0) {} {} {}", "{}-{}-{}"])
    return kind, "", form.format(*n), ""


def _others(r: random.Random) -> str:
    """Written forms with digits that are no personal data."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}",
        lambda: f"{r.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: digits(r.randint(1, 8)), lambda: digits(r.randint(24, 40)),
        lambda: "@" + r.choice(["media", "home", "import"]), lambda: f"{r.randint(1, 30)}.", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.",
        lambda: f"{digits(2)}%", lambda: f"no. {digits(r.randint(1, 6))}", lambda: f"{digits(4)}/{digits(2)}", lambda: f"(c) {digits(4)}",
        lambda: f'name = "{r.choice(["draft", "main text", "a-b"])}"', lambda: f"{digits(4)}-{digits(4)}", lambda: f"[{r.randint(1, 99)}]",
        lambda: "word" + digits(r.randint(1, 4)), lambda: " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(2, 9))),
    ])()


# What may be a form that the patterns miss: such places of real texts carry no label.
_UNSURE = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9]){6,}|[0-9A-Za-z]{18,}|[\[(]at[\])]")


def made_text(r: random.Random, plain: list[str], words: int = 16) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of a corpus with labelled forms set between its words."""
    src = _EVIDENCE.sub("", r.choice(plain))
    lo = r.randint(0, max(0, len(src) - 10 * words))
    wrap = r.choice(["", "", "", "!!", "%%%", ",", " |", "###"])
    text, spans = "", []
    for w in src[lo : lo + 10 * words].split(" ")[:words]:
        again = None
        while r.random() < (0.25 if again else 0.2):
            if r.random() < (0.9 if again else 0.65):
                # Forms of one kind often stand side by side.
                kind, before, form, after = _forms(r, again if r.random() < 0.7 else None)
                again = kind
                if wrap == "!!":
                    before, form = before.upper(), form.upper()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(form)))
                text += before + form + after
            else:
                text += _others(r)
            text += wrap + r.choice([" ", " ", " ", ", ", ". ", ".\n", "\n"])
        text += (w.upper() if wrap == "!!" else w) + wrap + " "
    return text, spans


def training_windows(texts: list[str], seed: int = 3, made: int = 2400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, tags, mask) of windows with labelled spans; real places that carry no label are left out."""
    r = random.Random(seed)
    rows: list[tuple[str, list]] = []
    for text in texts:
        spans = base_spans(text)
        marks = [m.start() for m in _EVIDENCE.finditer(text)]
        for at in dict.fromkeys([s[1] for s in spans[:2]] + r.sample(marks, min(1, len(marks)))):
            lo = max(0, at - r.randint(0, TRAIN_WINDOW - 40))
            part = text[lo : lo + TRAIN_WINDOW]
            own = [(k, a - lo, b - lo) for k, a, b in spans]
            if any(not any(a <= m.start() and m.end() <= b for _, a, b in own) for m in _UNSURE.finditer(part)):
                continue
            rows.append((part, own))
    plain = [t for t in texts if t and " " in t] or ["lorem ipsum dolor sit amet, consectetur adipiscing elit"]
    for _ in range(made):
        text, spans = made_text(r, plain)
        cut = r.randint(0, 30)
        rows.append((text[cut : cut + TRAIN_WINDOW], [(k, a - cut, b - cut) for k, a, b in spans]))
    x = np.zeros((len(rows), TRAIN_WINDOW), np.uint8)
    y = np.zeros((len(rows), TRAIN_WINDOW), np.int8)
    mask = np.zeros((len(rows), TRAIN_WINDOW), bool)
    for i, (text, spans) in enumerate(rows):
        x[i, : len(text)] = classes(text)
        mask[i, : max(1, len(text))] = True
        for k, a, b in spans:
            y[i, max(0, a) : max(0, min(b, len(text)))] = 1 + ALL_KINDS.index(k)
            if 0 <= a < len(text):
                y[i, a] = BEGIN
    return x, y, mask


def train(texts: list[str], epochs: int = 6, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Net:
    """Fits the network to the labelled spans by Adam; the same texts give the same weights."""
    rng = np.random.default_rng(seed)
    x, y, mask = training_windows(texts)
    k = TAGS
    init = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    net = Net(init(2, CLASSES, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), init(2, HIDDEN, k), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    net.e[..., HIDDEN : 2 * HIDDEN] += 1.0  # remember by default
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            s, kept = net.forward(x[at], keep=True)
            p, pairs, _ = net.posterior(s.astype(np.float64), mask[at])
            truth = np.eye(k)[y[at]] * mask[at][:, :, None]
            d = ((p - truth) / len(at)).astype(np.float32)
            ga = pairs.copy()
            both = mask[at][:, 1:]
            np.subtract.at(ga, (y[at][:, :-1][both], y[at][:, 1:][both]), 1.0)
            grads = [*net.backward(d, kept), (ga / len(at)).astype(np.float32)]
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            lr = rate * min(1.0, 2 * (1 - step / total) + 0.05)
            for j, (q, g) in enumerate(zip(net.params(), grads, strict=True)):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                q -= (lr * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _plausible(kind: str, s: str) -> bool:
    """Whether a run has as many digits as its kind can have."""
    n = sum(c.isdecimal() for c in s)
    return {"card": 12 <= n <= 19, "phone": 7 <= n <= 15, "ip": n >= 4, "secret": len(s) >= 16}.get(kind, len(s) >= 6)


def _starts(length: int) -> range:
    """Starts of the windows that cover a text."""
    return range(0, max(1, length - (WINDOW - STEP)), STEP)


def _weights(length: int, first: bool, last: bool) -> np.ndarray:
    """Weight of each place of a window: its distance from edges that are not the text's own."""
    at = np.arange(length)
    left, right = (np.full(length, WINDOW) if first else at + 1), (np.full(length, WINDOW) if last else length - at)
    return np.minimum(np.minimum(left, right), (WINDOW - STEP) // 2).astype(np.float64)


def _tagged(net: Net, texts: list[str]) -> dict[int, dict[int, np.ndarray]]:
    """Marginals (length, tags) of the windows in which some tag has a chance, by text and start."""
    out: dict[int, dict[int, np.ndarray]] = {}
    x, held, jobs = np.zeros((BATCH, WINDOW), np.uint8), 0, []

    def read():
        cls = x[:held]
        mask = np.arange(WINDOW) < np.array([n for _, _, n in jobs])[:, None]
        s = net.scores(cls)
        # A window that is untagged with a probability above 0.85 counts as untagged.
        at = np.flatnonzero(net.chance(s, mask) > 0.15)
        if len(at):
            p = net.marginals(s[:, :, at], mask[at])
            for j, q in zip(at.tolist(), p, strict=True):
                i, lo, n = jobs[j]
                out.setdefault(i, {})[lo] = q[:n]

    for i, text in enumerate(texts):
        cls = classes(text)
        for lo in _starts(len(cls)) if len(cls) else ():
            part = cls[lo : lo + WINDOW]
            x[held, : len(part)] = part
            x[held, len(part) :] = 0
            jobs.append((i, lo, len(part)))
            held += 1
            if held == BATCH:
                read()
                held, jobs = 0, []
    if held:
        read()
    return out


def added_spans(net: Net, texts: list[str], bases: list[list]) -> list[list[tuple[str, int, int]]]:
    """Spans that the network adds to each text's base spans.

    Every window of every text is read.  Averages over the windows that cover a place decide
    its tag; of runs that overlap, the surer one counts.
    """
    out: list[list] = [[] for _ in texts]
    for i, windows in _tagged(net, texts).items():
        text, spans = texts[i], []
        every = _starts(len(text))
        # Neighbouring windows with a chance form a region.
        starts = sorted(windows)
        groups = [[starts[0]]]
        for lo in starts[1:]:
            if lo == groups[-1][-1] + STEP:
                groups[-1].append(lo)
            else:
                groups.append([lo])
        for group in groups:
            base, end = group[0], group[-1] + len(windows[group[-1]])
            total, weight = np.zeros((end - base, TAGS)), np.zeros(end - base)
            for lo in range(group[0] - STEP, group[-1] + STEP + 1, STEP):
                if lo < 0 or lo not in every:
                    continue
                n = min(WINDOW, len(text) - lo)
                w = _weights(n, lo == 0, lo + n == len(text))
                a, b = max(lo, base), min(lo + n, end)
                if a >= b:
                    continue
                own = w[a - lo : b - lo]
                weight[a - base : b - base] += own
                if lo in windows:
                    total[a - base : b - base] += own[:, None] * windows[lo][a - lo : b - lo]
                else:
                    total[a - base : b - base, 0] += own
            p = total / weight[:, None]
            row = p.argmax(1)
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] == BEGIN) | (row[1:] != row[:-1]) & (row[:-1] != BEGIN)
            edges = [*np.flatnonzero(fresh).tolist(), len(row)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                tag, lo = int(row[b - 1]), a + int(row[a] == BEGIN)
                if tag not in (0, BEGIN) and (sure := float(p[lo:b, tag].mean())) >= CONFIDENCE:
                    spans.append((-sure, base + a, base + b, ALL_KINDS[tag - 1]))
        taken = [(a, b) for _, a, b in bases[i]]
        for _, a, b, kind in sorted(spans):
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if all(b <= s or e <= a for s, e in taken) and _plausible(kind, text[a:b]):
                taken.append((a, b))
                out[i].append((kind, a, b))
    return out


_SPANS = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean"))


def found(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """``docs`` with spans array<struct<kind,start,end,base>> by start, then kind as listed.

    Whole texts are read; null and empty ones have no spans.  Offsets are code points.
    Long texts cost one task their length, rows never wait for others.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    names = [c for c in docs.columns if c != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(b: pa.RecordBatch):
        spans = []
        for lo in range(0, b.num_rows, 256):
            texts = [t or "" for t in b.column(names.index(text)).slice(lo, 256).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(shipped.value, texts, base)
            for x, y in zip(base, more, strict=True):
                both = [(*s, True) for s in x] + [(*s, False) for s in y]
                both.sort(key=lambda s: (s[1], ALL_KINDS.index(s[0])))
                spans.append([{"kind": k, "start": s, "end": e, "base": o} for k, s, e, o in both])
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(spans, kind)], [*names, "spans"])

    return per_batch(docs.select(*names), run, docs.select(*names).schema.add("spans", _SPANS))


def trained(docs: DataFrame, text: str = "text") -> Net:
    """The network of a corpus, from the documents of smallest text hash that hold evidence."""
    some = docs.select(text).where(F.col(text).rlike("[0-9@]") & (F.length(text) <= MAX_CHARS))
    some = some.orderBy(F.xxhash64(text), text).limit(MAX_DOCS).toArrow()
    return train(some.column(0).to_pylist())


def redacted(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows."""
    d = found(docs, net)
    # Spans of different kinds can overlap (a phone in a card's digits): the covered runs go, named by their first kind.
    step = F.transform("spans", lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("a"), s["end"].alias("b")))
    d = d.withColumn("__s", step)

    def put(acc, s):
        fresh = s["a"] >= acc["at"]
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["a"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.concat(F.lit("<"), F.upper(s["k"]), F.lit(">"))
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, mark)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["b"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    new = F.when(F.size("__s") > 0, F.aggregate("__s", start, put, end)).otherwise(F.col("text"))
    d = d.withColumn("text", new)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans, of every document.

    n_added counts the network's spans.  Null and empty texts have none; repeated rows and null
    doc_ids get a row each; an empty table gives no rows (and trains on made forms alone).
    Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = trained(docs)
    d = found(docs, net).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))
