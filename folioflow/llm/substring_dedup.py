"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document.  Each word covered by a window whose word
sequence also starts in a document with a smaller id is removed; windows are judged on the input.

1. Anchors.  With D a difference cover modulo PERIOD, only the sub-windows of ANCHOR words that begin
   at positions p with p mod PERIOD in D are hashed.  For any two positions there is a shift below
   PERIOD that brings both into D, and ANCHOR + PERIOD - 1 <= window: two equal windows always share
   an aligned anchor, whatever their positions.
2. A document with an anchor that no other document has there can't lose a word through it.  The
   others extend: every full window around a shared anchor is hashed (96 bits) and each hash gets the
   smallest document id that has it.
3. Windows whose smallest id is below their own document's are removed.

Every exchange is pre-aggregated in the map task: of the documents that one task sees with a hash,
only the smallest asks the others about it and the task answers for the rest itself, so a hash that
a third of all documents share brings one row per task to a reducer.  Texts move compressed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .wordhash import Words, blocks, mix, window_hashes

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two members (fixed values).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Hashes that a map task holds before it combines and sends them.
BUFFER = 1 << 20
_NULL_ID = (1 << 63) - 1


def _in_cover() -> np.ndarray:
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    return cover


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every anchor of a block, in documents that have a full window."""
    place, n = words.place(), np.repeat(words.count, words.count)
    length = window - PERIOD + 1
    at = np.flatnonzero(_in_cover()[place % PERIOD] & (place + length <= n) & (n >= window))
    return at, window_hashes(words.hash, at, length)


def _second(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return (window_hashes(words, at, window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


_ASK = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("more", pa.bool_()), ("told", pa.list_(pa.int64()))])
_ASK_DDL = "h1 long, h2 int, did long, tid long, more boolean, told array<long>"


def _combine(h1: np.ndarray, h2: np.ndarray | None, did: np.ndarray, tid: np.ndarray, smallest_only: bool):
    """Rows for the reducer from (hash, document) pairs of one task.

    Asking rows: one per hash with the smallest document (of rows without an id one per text); `more`
    says that others here have it.  Telling rows: per document the hashes that are settled here - with
    smallest_only those that a smaller document has, else all that two or more documents have (the
    smallest one's too).
    """
    keys = (tid, did, h1) if h2 is None else (tid, did, h2, h1)
    order = np.lexsort(keys)
    h1, did, tid = h1[order], did[order], tid[order]
    h2 = np.zeros(len(h1), np.int32) if h2 is None else h2[order]
    differs = lambda *arrays: np.append(True, np.any([x[1:] != x[:-1] for x in arrays], axis=0))
    new = differs(h1, h2)
    fresh = new | differs(did, tid)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h1)))
    group = np.repeat(np.arange(len(first)), size)
    shared = did[first + size - 1] != did[first]
    least = did == did[first][group]
    ask = fresh & least
    yield pa.RecordBatch.from_arrays([pa.array(h1[ask]), pa.array(h2[ask]), pa.array(did[ask]), pa.array(tid[ask]), pa.array(shared[group][ask]), pa.nulls(int(ask.sum()), pa.list_(pa.int64()))], schema=_ASK)
    tell = fresh & (~least if smallest_only else shared[group])
    if tell.any():
        d, t, h = did[tell], tid[tell], h1[tell]
        order = np.lexsort((t, d))
        d, t, h = d[order], t[order], h[order]
        at = np.flatnonzero(differs(d, t))
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(d)).astype(np.int32)), pa.array(h))
        spread = mix((d[at] ^ t[at]).view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(len(at), np.int32)), pa.array(d[at]), pa.array(t[at]), pa.array(np.ones(len(at), bool)), lists], schema=_ASK)


class _Buffer:
    """Collects distinct (hash, document) pairs and combines them when it is full."""

    def __init__(self, smallest_only: bool):
        self.parts, self.size, self.smallest_only = [], 0, smallest_only

    def add(self, h1, h2, did, tid):
        self.parts.append((h1, h2, did, tid))
        self.size += len(h1)

    def flush(self):
        if self.size:
            h1, h2, did, tid = zip(*self.parts, strict=True)
            self.parts, self.size = [], 0
            yield from _combine(np.concatenate(h1).view(np.int64), None if h2[0] is None else np.concatenate(h2), np.concatenate(did), np.concatenate(tid), self.smallest_only)

    def full(self):
        if self.size >= BUFFER:
            yield from self.flush()


def _settle(rows: DataFrame, smallest_only: bool) -> DataFrame:
    """did, tid, hashes: per document what other tasks know about its hashes, with what its own task told."""
    same = Window.partitionBy("h1", "h2", F.col("told").isNotNull())
    least, most = F.min("did").over(same), F.max("did").over(same)
    asked = F.col("told").isNull()
    if smallest_only:
        found = asked & (F.col("did") > least)
    else:
        found = asked & ~F.col("more") & ((least != most) | F.max("more").over(same))
    # The smallest of several documents in one task was told already; alone it has to ask.
    flagged = rows.withColumn("found", found)
    kept = flagged.where(F.col("told").isNotNull() | F.col("found"))
    return kept.groupBy("did", "tid").agg(F.flatten(F.collect_list(F.coalesce("told", F.array("h1")))).alias("hashes"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs (did, t, ...) with z, the text compressed for exchanges, in place of t."""
    rest = [c for c in docs.columns if c not in ("did", "t")]

    def run(batches):
        for batch in batches:
            for part in base.columns_of([batch]):
                z = pa.array([zlib.compress(t, 1) for t in base.as_bytes(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), z, *part.columns[2:]], ["did", "z", *rest])

    schema = T.StructType([T.StructField("did", T.LongType()), T.StructField("z", T.BinaryType()), *[docs.schema[c] for c in rest]])
    return docs.select("did", "t", *rest).mapInArrow(run, schema)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        np.seterr(over="ignore")
        buffer = _Buffer(False)
        for batch in base.columns_of(batches):
            texts, (ids, tids) = base.as_bytes(batch.column(1)), (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for i, j in blocks(texts):
                words = Words(texts[i:j])
                at, h = _anchors(words, window)
                whose = words.owner()[at]
                buffer.add(h, None, ids[i:j][whose], tids[i:j][whose])
                yield from buffer.full()
        yield from buffer.flush()

    return docs.select("did", "t", "tid").mapInArrow(run, _ASK_DDL)


def _window_rows(candidates: DataFrame, window: int) -> DataFrame:
    """candidates: did, tid, z, hashes (shared anchors)."""

    def run(batches):
        np.seterr(over="ignore")
        buffer = _Buffer(True)
        for batch in base.columns_of(batches):
            texts, (ids, tids) = [zlib.decompress(z) for z in batch.column(1).to_pylist()], (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3))
            lists = batch.column(2)
            for i, j in blocks(texts):
                words = Words(texts[i:j])
                at, h = _anchors(words, window)
                shared = lists.slice(i, j - i).flatten().to_numpy()
                at = at[np.isin(h.view(np.int64), shared)]
                around = np.zeros(len(words.hash) + 1, dtype=np.int64)
                owner = words.owner()
                np.add.at(around, np.maximum(at - PERIOD + 1, words.first[owner[at]]), 1)
                np.add.at(around, at + 1, -1)
                place, n = words.place(), words.count[owner]
                start = np.flatnonzero((np.cumsum(around[:-1]) > 0) & (place + window <= n))
                buffer.add(window_hashes(words.hash, start, window), _second(words.hash, start, window), ids[i:j][owner[start]], tids[i:j][owner[start]])
                yield from buffer.full()
        yield from buffer.flush()

    return candidates.select("did", "z", "hashes", "tid").mapInArrow(run, _ASK_DDL)


def _covered(words: Words, removed: pa.ListArray, window: int) -> np.ndarray:
    """Which words of a block lie in a removed window."""
    owner, place = words.owner(), words.place()
    lists = removed.fill_null([]) if removed.null_count else removed
    mine = lists.flatten().to_numpy().view(np.uint64)
    whose = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
    if len(mine):
        start = np.flatnonzero(place + window <= words.count[owner])
        some = np.zeros(len(lists), bool)
        some[whose] = True
        start = start[some[owner[start]]]
        key = mix(window_hashes(words.hash, start, window) + mix(owner[start].astype(np.uint64)))
        start = start[np.isin(key, mix(mine + mix(whose.astype(np.uint64))))]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
    return np.cumsum(cover[:-1]) > 0


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, tid, hashes: per document the windows to remove.  docs: did, tid, t."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    shared = _settle(_anchor_rows(docs, window), False)
    candidates = _packed(docs).join(shared, ["did", "tid"])
    return _settle(_window_rows(candidates, window), True)


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text, and the columns in `carry`.

    kept_text is the text itself where nothing was removed, else the kept words joined by a space.
    Nulls: a null text has no words (kept_sha256 is that of the empty text, kept_text null); a null id
    counts as the largest, so such rows lose what any other document has and never what they share
    among themselves; they are told apart by a hash of their text (tid), so no key gathers them all.  Rows that repeat a doc_id are one document as to "smaller" and are judged each
    on its own text.  An empty table gives no rows; columns not carried are ignored, whatever their names.
    """
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("did")
    tid = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0)).cast("long").alias("tid")
    removed = removed_windows(docs.select(did, F.col(text).alias("t"), tid), window)
    rest = F.struct(F.col(id_col).cast("long").alias("id"), F.col(text).isNull().alias("no_text"), F.struct(F.lit(0).alias("__"), *[F.col(c) for c in carry]).alias("carry"))
    full = _packed(docs.select(did, F.col(text).alias("t"), tid, rest.alias("rest"))).join(removed, ["did", "tid"], "left")
    schema = T.StructType([full.schema["rest"], *[T.StructField(c, k) for c, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType()))]])

    def run(batches):
        np.seterr(over="ignore")
        for batch in base.columns_of(batches):
            texts = [zlib.decompress(z) for z in batch.column(0).to_pylist()]
            n, gone, sha, left = [], [], [], []
            for i, j in blocks(texts):
                words = Words(texts[i:j])
                drop = _covered(words, batch.column(1).slice(i, j - i), window)
                for k in range(j - i):
                    lost = drop[words.first[k] : words.first[k + 1]]
                    parts = texts[i + k].split()
                    if lost.any():
                        parts = [parts[x] for x in np.flatnonzero(~lost)]
                    kept = b" ".join(parts)
                    n.append(len(lost))
                    gone.append(len(lost) - len(parts))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    left.append((kept if gone[-1] else texts[i + k]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], schema.fieldNames())

    done = full.select("z", "hashes", "rest").mapInArrow(run, schema)
    return done.select(
        F.col("rest.id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.when(~F.col("rest.no_text"), F.col("kept")).alias("kept_text"), *[F.col(f"rest.carry.`{c}`").alias(c) for c in carry]
    )
