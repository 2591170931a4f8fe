"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its quantile bins, and a few pairs of features have
one over coarser bins.  The tables are sums of shallow boosted trees, one feature at a time in
cycles (Newton steps on the logistic loss); the pairs are those that gain most on what the single
tables leave.  Scoring is a bin search per feature and an addition per table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .quality_rules import sample_of_labels
from .wordhash import Words, blocks, mix

#: Bound of the labelled sample that the model is fitted on (rows, chosen by hash of the id).
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_word", "longest_word", "symbols", "uppers", "digits", "stops", "shouts", "bars", "short_words",
    "non_ascii", "lines", "repeats", "variety", "top_word", "dup_lines", "urls", "letters",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "symbols": _table("#*$%&|<>@^~{}[]\\"),
    "uppers": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _table("0123456789"),
    "stops": _table(".?,;:"),
    "shouts": _table("!"),
    "bars": _table("|\t"),
    "lines": _table("\n"),
    "urls": _table("/@_="),
}
_HIGH = np.arange(256) >= 128
_ASCII_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[cuts[1:]] - sums[cuts[:-1]]).astype(np.float64)


def _line_hashes(words: Words, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every line with a word: the sum of its words' hashes by place in the line."""
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.start)
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    return words.owner()[first], np.add.reduceat(mix(words.hash + mix(place.astype(np.uint64))), first)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; a text without words is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    col = {name: k for k, name in enumerate(FEATURES)}
    for i, j in blocks(texts):
        w = Words(texts[i:j])
        cuts = np.zeros(j - i + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts[i:j]], out=cuts[1:])
        cuts[-1] = len(w.data)
        n = np.maximum(w.count, 1).astype(np.float64)
        length = (w.end - w.start).astype(np.float64)
        chars = np.maximum(np.bincount(w.owner(), length, j - i), 1)
        f = out[i:j]
        f[:, col["log_words"]] = np.log1p(w.count)
        f[:, col["mean_word"]] = chars / n
        if len(length):
            longest = np.zeros(j - i)
            np.maximum.at(longest, w.owner(), length)
            f[:, col["longest_word"]] = longest
        for name, table in _CLASSES.items():
            sums = _per_text(table[w.data], cuts)
            if name == "lines":
                sums[:-1] -= 1  # the line break between two texts of a block is neither's
            f[:, col[name]] = sums / n
        f[:, col["uppers"]] *= n / chars
        f[:, col["non_ascii"]] = _per_text(_HIGH[w.data], cuts) / chars
        f[:, col["letters"]] = _per_text(_ASCII_LETTER[w.data], cuts) / chars
        f[:, col["short_words"]] = np.bincount(w.owner(), length <= 3, j - i) / n
        again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.owner()[1:] == w.owner()[:-1]))[: len(w.hash)]
        f[:, col["repeats"]] = np.bincount(w.owner(), again, j - i) / n
        key = mix(w.hash + mix(w.owner().astype(np.uint64)))
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        f[:, col["variety"]] = np.bincount(w.owner()[at], minlength=j - i) / n
        top = np.zeros(j - i)
        np.maximum.at(top, w.owner()[at], count)
        f[:, col["top_word"]] = top / n
        text, line = _line_hashes(w, cuts)
        _, at = np.unique(mix(line + mix(text.astype(np.uint64))), return_index=True)
        total, distinct = np.bincount(text, minlength=j - i), np.bincount(text[at], minlength=j - i)
        f[:, col["dup_lines"]] = (total - distinct) / np.maximum(total, 1)
        f[w.count == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges per feature, a table per feature, and (i, j, table) per pair over coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edge, table) in enumerate(zip(self.edges, self.single, strict=True)):
            out += table[np.searchsorted(edge, x[:, k])]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 1.0) -> np.ndarray:
    """Values per bin of a tree of a few leaves, from sums of gradient and curvature per bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if not len(gl):
                continue
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            gain[(hl < least) | (ht - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid into four, its gain and its values."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = gs[-1, -1], hs[-1, -1]
    gi, hi, gj, hj = gs[:-1, -1:], hs[:-1, -1:], gs[-1:, :-1], hs[-1:, :-1]
    a, ha = gs[:-1, :-1], hs[:-1, :-1]
    parts = ((a, ha), (gi - a, hi - ha), (gj - a, hj - ha), (gt - gi - gj + a, ht - hi - hj + ha))
    gain = sum(_gain(x, y) for x, y in parts) - _gain(gt, ht)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    p, q = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (x, y), rows, cols in zip(parts, (slice(None, p + 1), slice(None, p + 1), slice(p + 1, None), slice(p + 1, None)), (slice(None, q + 1), slice(q + 1, None), slice(None, q + 1), slice(q + 1, None)), strict=True):
        out[rows, cols] = _leaf(x[p, q] if x.shape == gain.shape else x, y[p, q] if y.shape == gain.shape else y)
    return float(gain[p, q]), out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, n_pairs: int = 6, rate: float = 0.1) -> Model:
    """Cyclic boosting.  No rows, or one class alone: a constant."""
    k = x.shape[1]
    edges, coarse = [_edges(x[:, c], bins) for c in range(k)], [_edges(x[:, c], coarse_bins) for c in range(k)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [])
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, c]) for c, e in enumerate(edges)]
    at2 = [np.searchsorted(e, x[:, c]) for c, e in enumerate(coarse)]
    f = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for c in range(k):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[c], g, len(edges[c]) + 1), np.bincount(at[c], h, len(edges[c]) + 1))
            model.single[c] += step
            f += step[at[c]]

    def grid(i, j, v):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(at2[i] * shape[1] + at2[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked[:n_pairs] if gain > 0]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            f += step[at2[i], at2[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, most: int = SAMPLE) -> Model:
    """Fit on at most `most` labelled documents; of each the driver gets its numbers, not its text."""
    sample = sample_of_labels(labels, label, where, most)
    joined = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("t")).join(F.broadcast(sample), "__id").select("__id", "t", "__label")

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for part in base.columns_of([batch]):
                x = features(base.as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = joined.mapInArrow(run, "id long, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(most).collect()
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= threshold).

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
                s = shared.value.score(features(base.as_bytes(part.column(k))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], columns)

    scored = plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema).toDF(*names, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: the fold crc32(doc_id) mod 5 = 0 is never learned from."""
    model = train(docs, labels, where=base.crc_fold(F.col("doc_id"), 5) != 0)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (base.crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
