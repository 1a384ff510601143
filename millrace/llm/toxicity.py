"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are letter runs.  Features are a token's first 4, 5 and 6 bytes and the whole token.
Labels are given for documents, so token labels come from them: a token of a toxic
document is labelled toxic if one of its features marks toxic documents (found in many of
them and hardly elsewhere).  The field's weights and transitions are then fitted by
maximum likelihood on windows of labelled tokens, so a mark that clean documents also
have loses its weight.  Scoring runs forward and backward over the whole text; stretches
of tokens without any weighted feature are one matrix power.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, per_batch, random64, slices, table

#: Bounds of the training sample: documents with label 1 and 0, and the length of each.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 800, 2400, 20_000
#: Features that a model can hold, tokens of a training window, windows without a mark from each document.
MAX_FEATURES, WINDOW, PLAIN_WINDOWS = 2000, 32, 1
PREFIXES = (4, 5, 6)
_R = random64(1 << 12, 23)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, features) of the letter runs of several texts; bytes are folded for
    A-Z and Latin-1 letters.  features has a column for each kind, 0 where it is missing."""
    global _R
    none = np.zeros(0, np.int64)
    inside = _LETTER[data]
    if not inside.any():
        return none, none, none, np.zeros((0, len(PREFIXES) + 1), np.uint64)
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[latin] += np.uint64(32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    n = ends - starts
    if int(n.max()) > len(_R):
        _R = random64(2 * int(n.max()), 23)
    at = np.flatnonzero(inside)
    place = np.searchsorted(at, starts)
    terms = (low[at] + np.uint64(1)) * _R[np.arange(len(at)) - np.repeat(place, n)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    base = sums[place]
    cols = [np.where(n >= k, mix64(sums[np.minimum(place + k, len(at))] - base + np.uint64(k)), np.uint64(0)) for k in PREFIXES]
    cols.append(mix64(sums[place + n] - base + np.uint64(99)))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, np.stack(cols, 1)


@dataclass
class Model:
    """Feature hashes in order, their weights, the bias of the toxic tag and log transitions."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    start: np.ndarray
    trans: np.ndarray
    # Slope and offset from the log-odds that some token is toxic to those of the document.
    scale: tuple[float, float] = (1.0, 0.0)

    def emissions(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of tokens with a weighted feature, their log-odds of the toxic tag)."""
        if not len(self.features) or not len(f):
            return np.zeros(0, np.int64), np.zeros(0)
        table_ = getattr(self, "_table", None)
        if table_ is None:
            table_ = self._table = np.zeros(1 << 20, bool)
            table_[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = table_[(f & np.uint64((1 << 20) - 1)).astype(np.int64)].any(1)
        at = np.flatnonzero(maybe)
        k = np.minimum(np.searchsorted(self.features, f[at]), len(self.features) - 1)
        hit = self.features[k] == f[at]
        w = np.where(hit, self.weights[k], 0.0).sum(1)
        keep = hit.any(1)
        return at[keep], w[keep] + self.bias


def _marks(rows: np.ndarray, f: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents: significant by a G test, or needed to cover two or
    more toxic documents that nothing else covers, with next to no clean documents."""
    n_tox, n_all = max(1, int(toxic.sum())), len(toxic)
    flat, doc = f.ravel(), np.repeat(rows, f.shape[1])
    _, at = np.unique(mix64(flat ^ mix64(doc.astype(np.uint64))), return_index=True)
    at = at[flat[at] != 0]
    doc, feat = doc[at], flat[at]
    names, inv = np.unique(feat, return_inverse=True)
    ct = np.bincount(inv, toxic[doc].astype(float), len(names))
    ca = np.bincount(inv, minlength=len(names))
    cn = ca - ct
    pure = (ct >= 2) & (cn <= 0.02 * ct * max(1.0, (n_all - n_tox) / n_tox))
    g = 2 * ct * np.log(np.maximum(ct, 1e-9) / ca * n_all / n_tox)
    strong = pure & (g > 40) & (ct >= 4)
    chosen = set(np.flatnonzero(strong)[np.argsort(-ct[strong], kind="stable")][:MAX_FEATURES].tolist())
    # Cover what is left, widest feature first.
    keep = pure[inv] & toxic[doc]
    by_doc: dict[int, list[int]] = {}
    for d, k in zip(doc[keep].tolist(), inv[keep].tolist(), strict=True):
        by_doc.setdefault(d, []).append(k)
    left = {d: ks for d, ks in by_doc.items() if not chosen.intersection(ks)}
    while left and len(chosen) < MAX_FEATURES:
        gain = Counter(k for ks in left.values() for k in ks)
        k = max(gain, key=lambda x: (gain[x], -cn[x], -x))
        if gain[k] < 2:
            break
        chosen.add(k)
        left = {d: ks for d, ks in left.items() if k not in ks}
    return np.sort(names[sorted(chosen)])


def _forward_backward(e: np.ndarray, mask: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """Marginals (n, t, 2), pair marginals summed (2, 2) and log Z of padded rows, from log potentials."""
    n, t, _ = e.shape
    a = np.empty_like(e)
    a[:, 0] = start + e[:, 0]
    for i in range(1, t):
        step = np.logaddexp(a[:, i - 1, :1] + trans[0], a[:, i - 1, 1:] + trans[1]) + e[:, i]
        a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    b = np.zeros_like(e)
    pairs = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        nxt = e[:, i + 1] + b[:, i + 1]
        step = np.stack([np.logaddexp(trans[k, 0] + nxt[:, 0], trans[k, 1] + nxt[:, 1]) for k in (0, 1)], 1)
        on = mask[:, i + 1]
        b[:, i] = np.where(on[:, None], step, b[:, i + 1])
        joint = np.exp(a[on, i, :, None] + trans + nxt[on][:, None, :] - z[on, None, None])
        pairs += joint.sum(0)
    return np.exp(a + b - z[:, None, None]) * mask[:, :, None], pairs, z


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on log-odds, by Newton steps with a weak prior at (1, 0)."""
    a, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
        a = a + np.linalg.solve(h, z.T @ (y - p) - (a - prior))
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def train(texts: list[str], labels: list[int], steps: int = 40, rate: float = 0.4) -> Model:
    """Fits the field on documents with labels 0 and 1; without toxic ones nothing is toxic."""
    toxic = np.array(labels, bool)
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    rows, _, _, f = tokens(np.frombuffer(b"".join(data), np.uint8), offs)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, np.array([0.0, -3.0]), np.log([[0.99, 0.01], [0.7, 0.3]]))
    if not toxic.any() or not len(rows):
        return model
    model.features = _marks(rows, f, toxic)
    model.weights = np.full(len(model.features), 3.0)
    if not len(model.features):
        return model
    k = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
    hit = model.features[k] == f
    marked = hit.any(1)
    first = np.searchsorted(rows, np.arange(len(toxic)))
    within = np.arange(len(rows)) - first[rows]
    window = rows * (int(within.max()) // WINDOW + 1) + within // WINDOW
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    size = np.diff(np.append(starts, len(rows)))
    with_mark = np.maximum.reduceat(marked, starts)
    keep = with_mark | (within[starts] // WINDOW < PLAIN_WINDOWS)
    starts, size = starts[keep], size[keep]
    at = starts[:, None] + np.minimum(np.arange(WINDOW), size[:, None] - 1)
    mask = np.arange(WINDOW) < size[:, None]
    y = (marked & toxic[rows])[at] & mask
    tok = np.where(hit, k, len(model.features))[at]  # (n, t, kinds)
    prev_y, next_y, both = y[:, :-1], y[:, 1:], mask[:, 1:]
    seen = np.array([[((~prev_y) & (~next_y) & both).sum(), ((~prev_y) & next_y & both).sum()], [(prev_y & (~next_y) & both).sum(), (prev_y & next_y & both).sum()]], float)
    n = float(mask.sum())
    w, bias, start, trans = np.append(model.weights, 0.0), model.bias, model.start.copy(), model.trans.copy()
    theta = [w, np.array([bias]), start, trans]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for i in range(1, steps + 1):
        e = np.zeros((*y.shape, 2))
        e[..., 1] = theta[0][tok].sum(-1) + theta[1][0]
        p, pairs, _ = _forward_backward(e, mask, theta[2], theta[3])
        miss = np.where(mask, y - p[..., 1], 0.0)
        gw = np.bincount(tok.ravel(), np.repeat(miss.ravel(), tok.shape[-1]), len(w)) - 0.05 * theta[0]
        gw[-1] = 0.0
        first_y = y[:, 0]
        grads = [gw, np.array([miss.sum() - 0.05 * theta[1][0]]), np.array([(~first_y - p[:, 0, 0]).sum(), (first_y - p[:, 0, 1]).sum()]), seen - pairs]
        for j, g in enumerate(grads):
            g = g / n * 100
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            theta[j] += rate * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8)
        theta[0][-1] = 0.0
    model.weights, model.bias, model.start, model.trans = theta[0][:-1], float(theta[1][0]), theta[2], theta[3]
    some = np.full(len(toxic), -LIMIT)
    for r, p, _ in text_marginals(model, rows, f):
        some[r] = any_toxic(p)
    marked_docs = some > -LIMIT
    model.scale = _calibrated(some[marked_docs], toxic[marked_docs].astype(float)) if marked_docs.any() else (1.0, 0.0)
    return model


#: Bound of log-odds.
LIMIT = 12.0


def any_toxic(p: np.ndarray) -> float:
    """Log-odds that some token is toxic, its marginals taken as independent."""
    none = float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    return float(np.clip(np.log(-np.expm1(min(none, -1e-12))) - none, -LIMIT, LIMIT))


def text_marginals(model: Model, rows: np.ndarray, f: np.ndarray):
    """(row, marginals, places) of every text that has a token with a weighted feature."""
    at, odds = model.emissions(f)
    kept: dict = {}
    own = rows[at]
    for r in np.unique(own).tolist():
        lo, hi = np.searchsorted(own, [r, r + 1])
        first, end = np.searchsorted(rows, [r, r + 1])
        yield r, marginals(model, int(end - first), at[lo:hi] - first, odds[lo:hi], kept), at[lo:hi]


def _power(base: np.ndarray, n: int, kept: dict) -> np.ndarray:
    """base ** n scaled to a sum of 1 (log scale does not matter for marginals)."""
    if n not in kept:
        if len(kept) > 4096:
            kept.clear()
        out, b, k = np.eye(2), base / base.sum(), n
        while k:
            if k & 1:
                out = out @ b
                out /= out.sum()
            b = b @ b
            b /= b.sum()
            k >>= 1
        kept[n] = out
    return kept[n]


def marginals(model: Model, length: int, at: np.ndarray, odds: np.ndarray, kept: dict) -> np.ndarray:
    """Probability of the toxic tag at the places ``at`` of a text of ``length`` tokens."""
    trans = np.exp(model.trans - model.trans.max())
    plain = trans * np.array([1.0, np.exp(min(model.bias, 50.0))])
    emit = [np.array([1.0, np.exp(x)]) if x < 0 else np.array([np.exp(-x), 1.0]) for x in np.clip(odds, -50, 50)]
    fwd, state, before = [], None, -1
    for t, e in zip(at.tolist(), emit, strict=True):
        if state is None:
            s = np.exp(model.start - model.start.max())
            state = s * e if t == 0 else ((s * np.array([1.0, np.exp(min(model.bias, 50.0))])) @ _power(plain, t - 1, kept) @ trans) * e
        else:
            state = (state @ _power(plain, t - before - 1, kept) @ trans) * e
        state /= state.sum()
        fwd.append(state)
        before = t
    out = np.empty(len(at))
    back, after = np.ones(2), length
    for i in range(len(at) - 1, -1, -1):
        t = int(at[i])
        gap = _power(plain, after - t - 1, kept)
        back = gap @ back if i == len(at) - 1 else gap @ trans @ (emit[i + 1] * back)
        back /= back.sum()
        p = fwd[i] * back
        out[i] = p[1] / p.sum()
        after = t
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with score double and spans array<struct<start,end>>.

    The score is the calibrated probability that some token is toxic; 0 for texts without a
    token that has a weighted feature, so for empty and null texts.  Spans are runs of tokens with
    marginals of 0.5 or more, in code points, end exclusive.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "score", "spans")]
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*rest).schema), "score double", "spans array<struct<start:int,end:int>>"])

    def run(b: pa.RecordBatch):
        m = shipped.value
        score, spans = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
        for lo, _, data, offs in slices(b.column(len(rest))):
            rows, starts, ends, f = tokens(data, offs)
            for r, p, places in text_marginals(m, rows, f):
                score[lo + r] = 1 / (1 + np.exp(-(m.scale[0] * any_toxic(p) + m.scale[1])))
                raw = data[offs[r] : offs[r + 1]]
                points = np.cumsum((raw & 0xC0) != 0x80)  # code points up to each byte
                run_, last = [], -2
                for t in places[p >= 0.5].tolist():
                    s = int(points[starts[t] - offs[r]]) - 1
                    e = int(points[ends[t] - 1 - offs[r]])
                    if t == last + 1:
                        run_[-1]["end"] = e
                    else:
                        run_.append({"start": s, "end": e})
                    last = t
                spans[lo + r] = run_
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(rest))), pa.array(score), pa.array(spans, kind)], [*rest, "score", "spans"])

    return per_batch(docs.select(*rest, text), run, schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): the bounded training sample, none of it held out.

    Held out are the doc_ids whose crc32 (as text) is divisible by 5.  A doc_id with both
    labels is toxic; null ids, labels and texts take no part.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    l = labels.where("doc_id is not null and toxic in (0, 1)").where(key % 5 != 0)
    l = l.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [l.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    ids = F.broadcast(some[0].unionByName(some[1]))  # MAX_TOXIC + MAX_CLEAN rows at most
    d = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS)
    return d.join(ids, "doc_id").orderBy("doc_id", "text").limit(2 * (MAX_TOXIC + MAX_CLEAN)).select("text", "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels of those that are not held out.

    A null doc_id is never held out (and never learnt from).  Null and empty texts score 0, like those without a
    weighted token; repeated rows get a row each; an empty table gives no rows; without toxic
    labels nothing is toxic.  Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    sample = training_rows(docs, table(spark, sf_dir, "labels")).toArrow()
    model = train(sample.column("text").to_pylist(), sample.column("toxic").to_pylist())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = scored(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
