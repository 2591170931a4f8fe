"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and the case of A-Z; words without a letter or digit are dropped.
Numbers, units (after a number) and names (capitalised words) become typed placeholders.  Windows of
template words are hash-joined to the windows of all benchmark items, in two readings: with names as
placeholders and with names as plain words (which also finds texts whose case was changed).  Both need
enough plain words.  With `literal`, as the queries have it, a third reading takes all words by value, in
every window and in items of any length, so that a verbatim copy is always found.  Matched
windows of one alignment of an item are then checked for consistent slots: within each type, equal
item values stand for equal document values and different ones for different ones.  What remains is
a literal or re-parameterised copy of at least one window.

The benchmark's windows are the small side.  They are broadcast in chunks of at most CHUNK windows (or
one item), one pass over the documents per chunk; a pass is written before the next begins, so one
chunk at a time is held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .wordhash import blocks, spans, window_hashes, word_hashes, _LOWER

WINDOW = 13
#: Items of fewer words than this are searched by value only, if at all: their templates identify nothing.
SHORTEST = 5
#: Plain words that a window needs in the readings with placeholders, as a share of its words.
PLAIN = 0.5
#: Benchmark windows of one broadcast.
CHUNK = 2_000_000
#: Fixed list of measurement units and currencies.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "percent degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons meter meters metre metres centimeters kilometers "
    "kmh mph dollar dollars cent cents euro euros eur usd gbp yen bytes kb mb gb"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xCA7A106))

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_IN_NUMBER = _DIGIT.copy()
_IN_NUMBER[[ord(c) for c in ".,:/-"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True


class Template:
    """Template words of a block of texts."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        start, end = spans(data)
        letter = _LETTER[data]
        at = np.flatnonzero(letter)
        first = np.searchsorted(at, start)
        last = np.searchsorted(at, end) - 1
        ok = last >= first
        first, last = at[first[ok]], at[last[ok]] + 1  # the word without outer punctuation
        self.value = word_hashes(_LOWER[data], first, last)
        odd = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(~_IN_NUMBER[data], out=odd[1:])
        number = _DIGIT[data[first]] & (odd[last] == odd[first])
        unit = np.isin(self.value, unit_hashes())
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(first, offsets)
        self.count = np.diff(self.first)
        unit[1:] &= number[:-1]
        unit[self.first[:-1][self.count > 0]] = False  # what another text of the block ends with is no number before
        name = _CAPITAL[data[first]]
        plain = np.where(number, _NUMBER, np.where(unit, _UNIT, self.value))
        self.slot = number | unit | name
        self.kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        self.readings = (np.where(name & ~number & ~unit, _NAME, plain), plain, self.value)

    def starts(self, length: int) -> np.ndarray:
        place = np.arange(len(self.value)) - np.repeat(self.first[:-1], self.count)
        return np.flatnonzero(place + length <= np.repeat(self.count, self.count))


def unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    return word_hashes(data, *spans(data))


class Index:
    """Windows of some benchmark items, ready to be searched; at most CHUNK windows or one item."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, literal: bool):
        texts = [(t or "").encode() for _, t in items]
        t = Template(texts)
        self.ids = [i for i, _ in items]
        self.first, self.count, self.value, self.kind = t.first, t.count, t.value, t.kind
        self.windows = {}
        for length in sorted({min(window, int(n)) for n in t.count if n}):
            at = t.starts(length)
            item = np.searchsorted(t.first, at, side="right") - 1
            keep = (t.count[item] == length) | (length == window)
            at, long = at[keep], t.count[item[keep]] >= SHORTEST
            for reading in (0, 1, 2) if literal else (0, 1):
                use = at
                if reading < 2:
                    slots = np.concatenate([[0], np.cumsum(t.slot if reading == 0 else t.slot & (t.kind != 3))])
                    use = at[long & (slots[at + length] - slots[at] <= (1 - PLAIN) * length)]
                if len(use):
                    h = window_hashes(t.readings[reading], use, length)
                    order = np.argsort(h, kind="stable")
                    self.windows[length, reading] = (h[order], use[order])


def _expand(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in keys, index in sorted_keys) of equal values."""
    low, high = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
    n = high - low
    i = np.repeat(np.arange(len(keys)), n)
    return i, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(i))


def _consistent(kind, item_value, doc_value) -> bool:
    """Whether slot values of one alignment map one to one."""
    for k in (1, 2, 3):
        pairs = set(zip(item_value[kind == k].tolist(), doc_value[kind == k].tolist(), strict=True))
        if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
            return False
    return True


def _hits(texts: list[bytes], index: Index, window: int) -> dict[int, list[dict]]:
    """Per text (by number) the items it contains."""
    t = Template(texts)
    found: dict[tuple[int, int, int], set[tuple[int, int]]] = {}
    for (length, reading), (keys, places) in index.windows.items():
        at = t.starts(length)
        h = window_hashes(t.readings[reading], at, length)
        at, h = (x[np.isin(h, keys)] for x in (at, h))
        i, j = _expand(keys, h)
        doc_at, item_at = at[i], places[j]
        doc = np.searchsorted(t.first, doc_at, side="right") - 1
        item = np.searchsorted(index.first, item_at, side="right") - 1
        for d, m, p, q in zip(doc.tolist(), item.tolist(), doc_at.tolist(), item_at.tolist(), strict=True):
            found.setdefault((d, m, p - q), set()).add((q, length))
    best: dict[tuple[int, int], tuple[int, bool]] = {}
    for (d, m, shift), windows in found.items():
        words = np.unique(np.concatenate([np.arange(q, q + n) for q, n in windows]))
        item_value, doc_value = index.value[words], t.value[words + shift]
        kind = index.kind[words]
        if not _consistent(kind, item_value, doc_value):
            # Slots may disagree across windows that are each a copy: look at them one by one.
            whole = [np.arange(q, q + n) for q, n in sorted(windows)]
            whole = [w for w in whole if _consistent(index.kind[w], index.value[w], t.value[w + shift])]
            if not whole:
                continue
            words = np.unique(np.concatenate(whole))
            item_value, doc_value = index.value[words], t.value[words + shift]
        now = (len(words), bool((item_value == doc_value).all()))
        best[d, m] = max(best.get((d, m), (0, False)), now)
    out: dict[int, list[dict]] = {}
    for (d, m), (n, exact) in sorted(best.items()):
        out.setdefault(d, []).append({"item_id": index.ids[m], "matched_words": n, "item_words": int(index.count[m]), "exact": exact})
    return out


_HIT = pa.struct([("item_id", pa.int64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("exact", pa.bool_())])
_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched_words", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("exact", T.BooleanType())]))


def _chunks(benchmark: DataFrame, text: str, id_col: str):
    """Items in lists of bounded size, one at a time on the driver.

    An item has at most length / 2 + 1 words, so lists are cut by a running sum of lengths.
    """
    sized = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    held, size = [], 0
    for row in sized.orderBy("item_id", "t").toLocalIterator():
        held.append((row.item_id, row.t))
        size += len(row.t) // 2 + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, into: str = "hits", literal: bool = False) -> DataFrame:
    """docs with a column `into`: array of (item_id, matched_words, item_words, exact) per contained item.

    literal also finds verbatim copies that are too short or too full of slots for their templates.

    Nulls: a null text contains nothing, a null item text is skipped; null ids pass through.  Repeated
    rows are searched each; repeated items count once.  An empty benchmark gives empty arrays.  A column
    of docs that is named as `into`, in any case, is replaced; all others pass through.
    """
    spark = docs.sparkSession
    names, plain = base.other_columns(docs, into)
    out = plain.withColumn("hits", F.array().cast(_HITS))
    k = names.index(text)
    for number, items in enumerate(_chunks(benchmark, item_text, item_id)):
        if number:
            out = base.materialize(out, "searched")
        shared = spark.sparkContext.broadcast(Index(items, window, literal))

        def run(batches, shared=shared, columns=out.columns):
            np.seterr(over="ignore")
            for batch in batches:
                for part in base.columns_of([batch]):
                    texts, before = base.as_bytes(part.column(k)), part.column(len(names)).to_pylist()
                    for i, j in blocks(texts):
                        for d, found in _hits(texts[i:j], shared.value, window).items():
                            before[i + d] = (before[i + d] or []) + found
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(before, pa.list_(_HIT))], columns)

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names, into)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", **kwargs) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, matched_words, item_words, exact."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return annotate(thin, benchmark, **kwargs).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
