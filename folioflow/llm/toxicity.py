"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of words; a run of over 64 bytes is several.  Each word enters as the sum of two projections: its
own embedding (if it is in the learned vocabulary) and the mean embedding of its character trigrams.
A GRU runs over the window in either direction, attention pools its states, and a logistic unit
scores the window.  A text's score is its highest window's over the whole text, calibrated on whole
texts.

Training picks, in each toxic text of a bounded sample, the windows that hold its most telling words
(by smoothed log odds), and in clean texts the same and random ones.  Texts are read whole, in the
executors; the driver gets counts of at most TELLING words, the picked windows and a score per text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .quality_rules import sample_of_labels
from .wordhash import _LOWER, blocks, mix, spans, word_hashes

#: Words of a window, and from one window to the next.
LENGTH, STRIDE = 24, 12
#: Bound of the labelled sample: texts of either class.
POSITIVE, NEGATIVE = 1500, 2500
#: Words whose counts by class reach the driver: the most telling ones.
TELLING = 50_000
#: Random windows of clean texts in training, about.
CLEAN_WINDOWS = 6000
THRESHOLD = 0.3
#: Bytes of a word; a longer run is several.
PIECE = 64
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 4096
_BATCH = 2048
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Tokens:
    """Words of a block without outer punctuation, in lower case; distinct ones and their trigrams."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        start, end = spans(data)
        at = np.flatnonzero(_LETTER[data])
        first, last = np.searchsorted(at, start), np.searchsorted(at, end) - 1
        ok = last >= first
        first, last = at[first[ok]], at[last[ok]] + 1
        # Longer runs, as of scripts without spaces, are words of PIECE bytes and a rest.
        n = -(-(last - first) // PIECE)
        first = np.repeat(first, n) + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        last = np.minimum(first + PIECE, np.repeat(last, n))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(first, offsets)
        self.count = np.diff(self.first)
        self.data, self.span = data, (first, last)
        self.hash, where, self.type = np.unique(word_hashes(data, first, last), return_index=True, return_inverse=True)
        first, last = first[where], last[where]
        # Trigrams of "^word$": one per byte of the word, the bytes beyond its ends being marks.
        n = last - first
        self.tri_first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        p = np.repeat(first - self.tri_first, n) + np.arange(n.sum())
        left = np.where(p == first[owner], 1, data[p - 1]).astype(np.uint64)
        right = np.where(p + 1 >= last[owner], 2, data[np.minimum(p + 1, len(data) - 1)]).astype(np.uint64)
        self.tri = (mix(left | data[p].astype(np.uint64) << np.uint64(8) | right << np.uint64(16)) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.tri_count = n

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of every window; a text without words has one empty window."""
        extra = np.maximum(self.count - LENGTH, 0)
        n = 1 + -(-extra // STRIDE)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return text, self.first[:-1][text] + np.minimum(k * STRIDE, extra[text])

    def words(self, text: int, start: int) -> bytes:
        """The words of a window, joined by spaces."""
        at = range(start, min(start + LENGTH, int(self.first[text + 1])))
        return b" ".join(self.data[self.span[0][k] : self.span[1][k]].tobytes() for k in at)

    def matrix(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Distinct-word numbers of windows, (LENGTH, windows); -1 beyond the text's end."""
        at = start[None, :] + np.arange(LENGTH)[:, None]
        inside = at < self.first[1:][text][None, :]
        if not len(self.type):
            return np.full(at.shape, -1)
        return np.where(inside, self.type[np.minimum(at, len(self.type) - 1)], -1)


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row in the word table per hash; 0 for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def logits(self, tokens: Tokens, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Per window.  Both embeddings are projected once per distinct word of the block."""
        p = self.p
        word = p["word"] @ p["w"][:, :WORD_DIM].transpose(1, 0, 2).reshape(WORD_DIM, -1)
        char = p["w"][:, WORD_DIM:].transpose(1, 0, 2).reshape(CHAR_DIM, -1)
        types = np.zeros((len(tokens.hash) + 1, 2, 3 * HIDDEN), dtype=np.float32)
        if len(tokens.hash):
            owner = np.repeat(np.arange(len(tokens.hash)), tokens.tri_count)
            mean = (_add(owner, p["char"][tokens.tri], len(tokens.hash)) / tokens.tri_count[:, None]).astype(np.float32)
            types[:-1] = (word[self.word_rows(tokens.hash)] + mean @ char).reshape(-1, 2, 3 * HIDDEN) + p["b"]
        out = np.empty(len(text))
        for i in range(0, len(text), _BATCH):
            ids = tokens.matrix(text[i : i + _BATCH], start[i : i + _BATCH])
            out[i : i + _BATCH] = forward(p, types[ids].transpose(2, 0, 1, 3), ids >= 0)[0]
        return out

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's logit per text."""
        out = np.empty(len(texts))
        for i, j in blocks(texts, 1 << 20):
            tokens = Tokens(texts[i:j])
            text, start = tokens.windows()
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            out[i:j] = np.maximum.reduceat(self.logits(tokens, text, start), first)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.offset, -30, 30)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def forward(p: dict, a: np.ndarray, mask: np.ndarray, keep: bool = False):
    """a: inputs' projections (2 directions, steps, rows, 3 * HIDDEN); mask (steps, rows) -> logits, what backward needs."""
    steps, rows = mask.shape
    states = np.zeros((steps, rows, 2 * HIDDEN), dtype=np.float32)
    m = mask[..., None].astype(np.float32)
    tape = []
    for d in (0, 1):
        h, u = np.zeros((rows, HIDDEN), dtype=np.float32), p["u"][d]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, s = a[d, t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            if keep:
                tape.append((d, t, h, z, r, n, s[:, 2 * HIDDEN :]))
            h = h + m[t] * ((1 - z) * (n - h))
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    q = np.tanh(states @ p["att"] + p["att_b"])
    e = np.where(mask, q @ p["att_v"], -np.inf)
    top = np.max(e, axis=0, initial=-1e30)
    e = np.where(mask, np.exp(e - top), 0)
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return pooled @ p["out"] + p["out_b"][0], (states, m, tape, q, alpha, pooled) if keep else None


def backward(p: dict, saved, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of parameters and of the inputs' projections, from that of the logits."""
    states, m, tape, q, alpha, pooled = saved
    g = {k: np.zeros_like(v) for k, v in p.items() if k in ("u", "att", "att_b", "att_v", "out", "out_b")}
    g["out"], g["out_b"][0] = pooled.T @ slope, slope.sum()
    dpooled = slope[:, None] * p["out"]
    dalpha = np.einsum("tbh,bh->tb", states, dpooled)
    dstates = alpha[..., None] * dpooled
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["att_v"] = np.einsum("tba,tb->a", q, de)
    dq = de[..., None] * p["att_v"] * (1 - q * q)
    g["att"], g["att_b"] = states.reshape(-1, 2 * HIDDEN).T @ dq.reshape(-1, ATTENTION), dq.sum((0, 1))
    dstates = dstates + dq @ p["att"].T
    da = np.zeros((2, *m.shape[:2], 3 * HIDDEN), dtype=np.float32)
    dh, direction = None, None
    for d, t, h, z, r, n, s in reversed(tape):
        if d != direction:
            dh, direction = np.zeros_like(h), d
        total = dh + dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN]
        new = total * m[t]
        dn = new * (1 - z) * (1 - n * n)
        dz = new * (h - n) * z * (1 - z)
        dr = dn * s * r * (1 - r)
        da[d, t] = np.concatenate([dz, dr, dn], axis=1)
        ds = np.concatenate([dz, dr, dn * r], axis=1)
        g["u"][d] += h.T @ ds
        dh = total - new + new * z + ds @ p["u"][d].T
    return g, da


def _start(words: int, rng) -> dict[str, np.ndarray]:
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    small = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
    return {
        "word": small(words + 1, WORD_DIM), "char": small(TRIGRAMS, CHAR_DIM), "w": draw(2, WORD_DIM + CHAR_DIM, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32),
        "u": draw(2, HIDDEN, 3 * HIDDEN), "att": draw(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": small(ATTENTION), "out": draw(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32),
    }


def _add(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], rows) for k in range(values.shape[1])], axis=1)


def _counts(tokens: Tokens, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts that hold each distinct word."""
    owner = np.repeat(np.arange(len(y)), tokens.count)
    seen = np.unique(owner * (len(tokens.hash) + 1) + tokens.type)
    who, which = seen // (len(tokens.hash) + 1), seen % (len(tokens.hash) + 1)
    return tuple(np.bincount(which[y[who] == k], minlength=len(tokens.hash)) for k in (1, 0))


def _odds(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    return np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1))


def _pick(tokens: Tokens, y: np.ndarray, odds: np.ndarray, clean_windows: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, label) of training windows; odds per distinct word, clean_windows in all texts."""
    text, start = tokens.windows()
    ids = tokens.matrix(text, start)
    best = np.where(ids >= 0, np.append(odds, 0)[ids], -99).max(axis=0) + 1e-6 * rng.random(len(text))
    order = np.lexsort((-best, text))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text)) - np.repeat(np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1])), np.bincount(text, minlength=len(y)))
    toxic = (y[text] == 1) & ((rank == 0) | (rank < 3) & (best > np.log(8)))
    clean = y[text] == 0
    clean &= (rank == 0) | (rng.random(len(text)) < CLEAN_WINDOWS / max(clean_windows, 1))
    use = np.flatnonzero(toxic | clean)
    return text[use], start[use], y[text[use]].astype(np.float32)


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 6, least: int = 240, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Model:
    """Train on labelled texts; weight restores the classes' true shares in the calibration."""
    rng = np.random.default_rng(seed)
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
    if not len(y) or y.min() == y.max():
        model = Model(np.zeros(0, np.uint64), _start(0, rng), 0.0, float(np.log(share / (1 - share))))
        return model
    held = rng.permutation(len(y)) % 5 == 0  # not trained on, if it has toxic texts enough to calibrate with
    if (y[held] == 1).sum() < 30:
        held[:] = False
    train_y = y[~held]
    tokens = Tokens([t for t, h in zip(texts, held, strict=True) if not h])
    odds = _odds(*_counts(tokens, train_y), int(train_y.sum()), int(len(train_y) - train_y.sum()))
    clean = train_y[tokens.windows()[0]] == 0
    model = _learn(tokens, *_pick(tokens, train_y, odds, int(clean.sum()), rng), len(y), rng, epochs, least, batch, rate)
    use = np.flatnonzero(held) if held.any() else np.arange(len(y))
    _calibrate(model, model.raw([texts[k] for k in use]), y[use], weight[use])
    return model


def _learn(tokens: Tokens, text: np.ndarray, start: np.ndarray, label: np.ndarray, n_texts: int, rng, epochs: int = 6, least: int = 240, batch: int = 256, rate: float = 0.01) -> Model:
    """Train on windows of a block, n_texts being the texts they were picked from."""
    ids = tokens.matrix(text, start)
    often = np.bincount(np.append(ids[ids >= 0], 0), minlength=len(tokens.hash))
    vocabulary = tokens.hash[often >= max(5, n_texts // 600)]
    model = Model(np.sort(vocabulary), _start(len(vocabulary), rng))
    p, rows_of = model.p, model.word_rows(tokens.hash)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    lift = np.where(label == 1, max(1.0, (label == 0).sum() / max((label == 1).sum(), 1) / 2), 1.0)
    batch = int(np.clip(len(label) // 12, 32, batch))
    epochs = max(epochs, -(-least * batch // len(label)))
    rate *= 0.3 + 0.7 * min(1.0, len(label) / 8000)  # few windows are soon learned by heart
    step, total = 0, epochs * -(-len(label) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(order), batch):
            use = order[k : k + batch]
            now = ids[:, use]
            mask = now >= 0
            types, at = np.unique(now[mask], return_inverse=True)
            known = np.where(rng.random(len(types)) < 0.25, 0, rows_of[types])  # some words by their letters alone
            n = tokens.tri_count[types]
            of = np.repeat(np.arange(len(types)), n)
            tri = tokens.tri[np.repeat(tokens.tri_first[types] - (np.cumsum(n) - n), n) + np.arange(len(of))]
            n = n[:, None]
            chars = _add(of, p["char"][tri], len(types)) / n
            vec = np.concatenate([p["word"][known], chars], axis=1).astype(np.float32)
            x = np.zeros((*now.shape, WORD_DIM + CHAR_DIM), dtype=np.float32)
            x[mask] = vec[at]
            a = np.stack([x @ p["w"][d] + p["b"][d] for d in (0, 1)])
            z, saved = forward(p, a, mask, keep=True)
            slope = ((_sigmoid(z) - label[use]) * lift[use] / len(use)).astype(np.float32)
            g, da = backward(p, saved, slope)
            g["w"] = np.stack([x.reshape(-1, x.shape[-1]).T @ da[d].reshape(-1, 3 * HIDDEN) for d in (0, 1)])
            g["b"] = da.sum((1, 2))
            dx = (da[0] @ p["w"][0].T + da[1] @ p["w"][1].T)[mask]
            dvec = _add(at, dx, len(types))
            g["word"] = _add(known, dvec[:, :WORD_DIM], len(p["word"]))
            g["char"] = _add(tri, (dvec[:, WORD_DIM:] / n)[of], TRIGRAMS)
            step += 1
            lr = rate * (1 - step / (total + 1))
            for name, v in p.items():
                grad = g[name] + 1e-5 * v
                m1, m2 = moment[name]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                v -= (lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _calibrate(model: Model, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the label on the standardised raw score: damped Newton steps with a ridge."""
    mean, scale = raw.mean(), max(raw.std(), 1e-6)
    x = np.stack([(raw - mean) / scale, np.ones_like(raw)], axis=1)
    ridge = np.array([1.0, 1e-3])

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2

    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, size = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * beta), 1.0
        while size > 1e-4 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
    slope = max(float(beta[0]), 0.0) / scale
    model.slope, model.offset = slope, float(beta[1]) - slope * mean


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """Fit on a bounded sample: at most `positive` and `negative` texts, each read whole in the executors.

    Labels without an id or a label are ignored; an id labelled twice counts as the mean, rounded.  A
    null text is one without words.  One class alone, or no labelled text: a constant score.
    """
    cond = F.lit(True) if where is None else where
    shares = {int(r[0]): r[1] for r in labels.where(cond & F.col(label).isNotNull()).groupBy((F.col(label) > 0.5).cast("int")).count().collect()}
    sample = sample_of_labels(labels, label, cond & (F.col(label) > 0.5), positive).union(sample_of_labels(labels, label, cond & (F.col(label) <= 0.5), negative))
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).join(F.broadcast(sample.withColumnRenamed("__id", "id")), "id")
    mark = F.xxhash64("id", F.coalesce("t", F.lit("")))
    picked = joined.select("id", F.col("__label").alias("y"), F.col("t"), mark.alias("mark")).orderBy("mark", "id").limit(positive + negative)
    # Few rows, but whole texts: written once, then read by each pass below.
    texts = base.materialize(picked.repartition(16, "mark"), "labelled")
    held = F.pmod("mark", F.lit(5)) == 0
    n = {(int(r.y), bool(r.held)): r.n for r in texts.groupBy("y", held.alias("held")).agg(F.count("*").alias("n")).collect()}
    total = [n.get((k, False), 0) + n.get((k, True), 0) for k in (0, 1)]
    weight = np.array([shares.get(k, 0) / max(total[k], 1) for k in (0, 1)])
    rng = np.random.default_rng(7)
    if not all(total):
        share = float(np.clip(weight[1] * total[1] / max(weight @ total, 1e-9), 1e-3, 1 - 1e-3))
        return Model(np.zeros(0, np.uint64), _start(0, rng), 0.0, float(np.log(share / (1 - share))))
    apart = n.get((1, True), 0) >= 30  # enough toxic texts to calibrate with that were not trained on
    learnt = texts.where(~held) if apart else texts
    clean, toxic = (n.get((k, False), 0) + (0 if apart else n.get((k, True), 0)) for k in (0, 1))

    def count(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for part in base.columns_of([batch]):
                tokens, y = Tokens(base.as_bytes(part.column(1))), part.column(0).to_numpy()
                pos, neg = _counts(tokens, y)
                windows = np.bincount(y[tokens.windows()[0]], minlength=2)[0]
                yield pa.RecordBatch.from_arrays([pa.array([None]), pa.array([0]), pa.array([int(windows)])], schema=_COUNT)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.hash.view(np.int64)), pa.array(pos), pa.array(neg)], schema=_COUNT)

    counts = learnt.select("y", "t").mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = base.materialize(counts, "counts")
    clean_windows = counts.where("h is null").agg(F.coalesce(F.sum("neg"), F.lit(0))).first()[0]
    odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5))
    top = counts.where("h is not null").orderBy(odds.desc(), F.col("pos").desc(), "h").limit(TELLING).toArrow()
    h, pos, neg = (top.column(c).to_numpy() for c in ("h", "pos", "neg"))
    order = np.argsort(h.view(np.uint64))
    telling = docs.sparkSession.sparkContext.broadcast((h.view(np.uint64)[order], _odds(pos, neg, toxic, clean)[order]))

    def windows(batches):
        np.seterr(over="ignore")
        known, value = telling.value
        for batch in batches:
            for part in base.columns_of([batch]):
                tokens, y = Tokens(base.as_bytes(part.column(1))), part.column(0).to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(known, tokens.hash), max(len(known) - 1, 0))
                odds = np.where(known[at] == tokens.hash, value[at], value.min(initial=0.0)) if len(known) else np.zeros(len(tokens.hash))
                own = np.random.default_rng(part.column(2).to_numpy().view(np.uint64))
                text, start, label = _pick(tokens, y, odds, int(clean_windows), own)
                found = [tokens.words(i, k) for i, k in zip(text.tolist(), start.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(found, pa.binary())], ["y", "t"])

    got = learnt.select("y", "t", "mark").mapInArrow(windows, "y int, t binary").orderBy("t", "y").collect()
    tokens = Tokens([bytes(r.t) for r in got])
    text, start = tokens.windows()
    label = np.array([r.y for r in got], dtype=np.float32)
    np.seterr(over="ignore")
    model = _learn(tokens, text, start, label[text], sum(total), rng)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def raw(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for part in base.columns_of([batch]):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.raw(base.as_bytes(part.column(1))))], ["y", "raw"])

    judged = (texts.where(held) if apart else texts).select("y", "t").mapInArrow(raw, "y int, raw double").orderBy("raw", "y").toArrow()
    y = judged.column("y").to_numpy().astype(np.int64)
    _calibrate(model, judged.column("raw").to_numpy(), y, weight[y] * len(y) / max(weight[y].sum(), 1e-9))
    return model


_COUNT = pa.schema([("h", pa.int64()), ("pos", pa.int64()), ("neg", pa.int64())])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted, from every overlapping window of the whole text.

    Nulls: a null text scores as one without words; other nulls pass through.  Repeated rows score
    alike.  An empty table gives no rows.  Columns named score or predicted, in any case, are replaced.
    """
    names, plain = base.other_columns(docs, "score", "predicted")
    columns = [*plain.columns, "score"]
    k = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for part in base.columns_of([batch]):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(base.as_bytes(part.column(k))))], columns)

    scored = plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema).toDF(*names, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: the fold crc32(doc_id) mod 4 = 2 is never learned from."""
    model = train(docs, labels, where=base.crc_fold(F.col("doc_id"), 4) != 2)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (base.crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
