"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64 bits.  If two differ in at most 3, one of their two 32-bit halves differs in at
most 1, so each half is covered by itself with threshold 1.  The anchors of a half are the words of
the perfect Hamming code of length 31 (every point lies within covering radius 1 of exactly one)
times the free 32nd bit.  A fingerprint is replicated to every anchor within covering radius +
threshold = 2 and is at home at the one within 1; two fingerprints that differ in one bit of the half
meet where either is at home.  Per anchor, those at home are compared with all that came.

Only distinct fingerprints are replicated (equal ones are one node, whatever their documents' ids).
An anchor passes on a chain through each of its connected sets, never pairs.  An anchor with very many
fingerprints deals them out again by anchors of the other half's quarters, exactly as above; one that
is still full is cut into blocks, and every two blocks are compared in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .components import connected_components

BITS = 64
THRESHOLD = 3
#: Fingerprints at one anchor beyond which the anchor is dealt out by finer ones.
FULL = 8192
_PAIRS = 1 << 21


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is set in over half the XXH64 hashes of the shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone are lowered
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(s, 42) for s in joined[i : i + (1 << 16)]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long) for every row; a null text has no words."""

    def run(batches):
        for batch in batches:
            for part in base.columns_of([batch]):
                fps = np.array([fingerprint(t, shingle) for t in base.as_bytes(part.column(1))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("text_hash"))
    return thin.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _syndrome(x: np.ndarray, m: int) -> np.ndarray:
    """XOR of the 1-based places of the set bits among the low m."""
    s = np.zeros(len(x), dtype=np.uint64)
    for k in range(m):
        s ^= ((x >> np.uint64(k)) & np.uint64(1)) * np.uint64(k + 1)
    return s


def anchors(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for points of `bits` = 2**r bits: all anchors within distance 2.

    The low bits - 1 form a Hamming code word; the top bit is free.
    """
    m = bits - 1
    one, free = np.uint64(1), np.uint64(1 << m)
    s = _syndrome(x, m)
    off = s != 0
    row = np.arange(len(x))
    home = np.where(off, x ^ (one << (np.maximum(s, one) - one)), x)
    rows, out, at_home = [row, row], [home, home ^ free], [np.ones(len(x), bool), np.zeros(len(x), bool)]
    # Off the code, a second kind of word lies at distance 2: flip a pair of places whose XOR is the syndrome.
    xo, so, ro = x[off], s[off], row[off]
    for a in range(1, m + 1):
        b = so ^ np.uint64(a)
        ok = (b > np.uint64(a)) & (b <= np.uint64(m))
        rows.append(ro[ok])
        out.append(xo[ok] ^ np.uint64(1 << (a - 1)) ^ (one << (b[ok] - one)))
        at_home.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(at_home)


_ROW = ["anchor", "fine", "fp", "home"]
_DDL = "anchor long, fine long, fp long, home boolean"


def _batch(anchor, fine, fp, home) -> pa.RecordBatch:
    as_long = [pa.array(np.asarray(v).view(np.int64)) for v in (anchor, fine, fp)]
    return pa.RecordBatch.from_arrays([*as_long, pa.array(home)], _ROW)


def _replicate(nodes: DataFrame) -> DataFrame:
    """nodes: fp -> one row per anchor of either half."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                row, at, home = anchors(x, 32)
                yield _batch(at | np.uint64(half << 32), np.zeros(len(row), np.int64), fp[row], home)

    return nodes.select("fp").mapInArrow(run, _DDL)


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of full anchors, dealt out by the anchors of the other half's quarters.

    The other halves of a linked pair differ in at most 3 bits, so one of their quarters in at most 1.
    Home stays with rows that were at home at the first anchor.
    """

    def run(batches):
        for batch in batches:
            anchor, _, fp = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            was = batch.column(3).to_numpy(zero_copy_only=False)
            other = np.where((anchor >> np.uint64(32)) == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
            for quarter in (0, 1):
                x = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
                row, at, home = anchors(x, 16)
                yield _batch(anchor[row], at | np.uint64((quarter + 1) << 16), fp[row], home & was[row])

    return rows.select(*_ROW).mapInArrow(run, _DDL)


def _blocks(rows: DataFrame, full: int) -> DataFrame:
    """Rows of anchors that are full at their finest, dealt to tasks that each compare two blocks.

    A block has about full / 2 fingerprints, so a task holds a bounded number of them and an anchor of
    m fingerprints is read by m * m / full**2 tasks, not by one.  Anchors are renamed by a hash; two
    that got one name would only be compared for nothing.
    """
    name = F.concat_ws(":", F.col("anchor").cast("string"), F.col("fine").cast("string"))
    named = base.materialize(rows.withColumn("name", name), "full")
    count = F.ceil(F.col("n") * 2 / full).cast("int").alias("blocks")
    sizes = base.materialize(named.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", count), "sizes")
    r = base.lookup(named, sizes, "name", "n", F.col("fp"))
    r = r.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return r.select(F.xxhash64("name", F.least("block", "other"), F.greatest("block", "other")).alias("anchor"), F.lit(0).cast("long").alias("fine"), "fp", "home")


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n points, by links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(fp: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """Label per fingerprint of one anchor; those at home are compared with all, block by block."""
    n, label = len(fp), np.arange(len(fp))
    at_home = np.flatnonzero(home)
    step = max(1, _PAIRS // n)
    for k in range(0, len(at_home), step):
        block = at_home[k : k + step]
        i, j = np.nonzero(np.bitwise_count(fp[block][:, None] ^ fp[None, :]) <= threshold)
        # One merge per row and label: links of a block collapse before the next is compared.
        merged = _least_labels(n, label[block[i]], label[j])
        label = merged[label]
    return label


def _small_links(fp, home, first, size, threshold):
    """Links i-j between rows of many small anchors at once."""
    starts = np.repeat(first, size)
    of = np.repeat(size, size)
    rows = np.flatnonzero(home)
    reach = of[rows]
    at = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(reach, out=at[1:])
    cuts = np.minimum(np.searchsorted(at, np.arange(0, at[-1] + _PAIRS, _PAIRS)), len(rows))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r = rows[a:b]
        i = np.repeat(r, reach[a:b])
        j = np.repeat(starts[r] - at[a:b], reach[a:b]) + np.arange(at[a], at[b])
        ok = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= threshold)
        yield i[ok], j[ok]


def _compare(rows: DataFrame, threshold: int, full: int | None) -> DataFrame:
    """Rows of each anchor together -> edges (anchor and fp are linked, home is null), or the rows of a full anchor as they came."""

    def chain(fp: np.ndarray, label: np.ndarray):
        order = np.lexsort((fp, label))
        fp, label = fp[order], label[order]
        same = label[1:] == label[:-1]
        return fp[:-1][same], fp[1:][same]

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.bool_())], _ROW)

    def closed(anchor, fine, fp, home):
        """Whole anchors, none of them full."""
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (fine[1:] != fine[:-1])))
        size = np.diff(np.append(new, len(fp)))
        large = size > 256
        for f, n in zip(new[large], size[large], strict=True):
            yield edges(*chain(fp[f : f + n], _links(fp[f : f + n], home[f : f + n], threshold)))
        keep = np.repeat((size > 1) & ~large, size)
        if keep.any():
            fp, home, size = fp[keep], home[keep], size[(size > 1) & ~large]
            first = np.cumsum(size) - size
            found = [x for x in _small_links(fp, home, first, size, threshold) if len(x[0])]
            if found:
                i, j = (np.concatenate(v) for v in zip(*found, strict=True))
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                label = _least_labels(len(used), at[: len(i)], at[len(i) :])
                yield edges(*chain(fp[used], label))

    def run(batches):
        held, size, over = [], 0, None  # pieces of the last anchor so far, and their rows; the anchor that is passed on
        for batch in batches:
            cols = [batch.column(k).to_numpy().view(np.uint64) for k in range(3)]
            cols.append(batch.column(3).to_numpy(zero_copy_only=False))
            if over is not None:
                more = (cols[0] == over[0]) & (cols[1] == over[1])
                if more.any():
                    yield _batch(*[c[more] for c in cols])
                    cols = [c[~more] for c in cols]
                if not len(cols[0]):
                    continue
                over = None
            ends = (cols[0][0], cols[1][0]) == (cols[0][-1], cols[1][-1])
            if not (held and ends and (held[0][0][0], held[0][1][0]) == (cols[0][0], cols[1][0])):
                cols = [np.concatenate(v) for v in zip(*held, cols, strict=True)]
                last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
                if last:
                    yield from whole([c[:last] for c in cols])
                cols, held, size = [c[last:] for c in cols], [], 0
            held.append(cols)
            size += len(cols[0])
            if full is not None and size > full:
                over = (held[0][0][0], held[0][1][0])
                for part in held:
                    yield _batch(*part)
                held, size = [], 0
        if held:
            yield from whole([np.concatenate(v) for v in zip(*held, strict=True)])

    def whole(cols):
        if full is None:
            yield from closed(*cols)
            return
        new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        big = np.repeat(size > full, size)
        if big.any():
            yield _batch(*[c[big] for c in cols])
        if not big.all():
            yield from closed(*[c[~big] for c in cols])

    return rows.repartition("anchor", "fine").sortWithinPartitions("anchor", "fine").mapInArrow(run, _DDL)


def links(nodes: DataFrame, threshold: int = THRESHOLD, full: int = FULL) -> DataFrame:
    """nodes (fp, all distinct) -> edges (a, b) between fingerprints that connect all within threshold.

    No nodes: no rows.  Every level passes the anchors over `full` on, so no task holds more than about
    that many fingerprints of one anchor.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"two halves with threshold 1 cover at most {THRESHOLD} bits")
    edge = [F.col("anchor").alias("a"), F.col("fp").alias("b")]
    out, todo = None, _replicate(nodes)
    for finer, name in ((_finer, "anchors"), (lambda rows: _blocks(rows, full), "fine_anchors")):
        done = base.materialize(_compare(todo, threshold, full), name)
        found, passed = done.where(F.col("home").isNull()).select(*edge), done.where(F.col("home").isNotNull())
        out = found if out is None else out.union(found)
        if not passed.limit(1).count():
            return out
        todo = finer(passed)
    return out.union(_compare(todo, threshold, None).where(F.col("home").isNull()).select(*edge))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, threshold: int = THRESHOLD, full: int = FULL) -> DataFrame:
    """doc_id, text_hash, fp, component_id, keeper_id, keeper_hash for every row.

    The keeper of a component is its row of the smallest id (null last), then of the smallest text hash.
    """
    fps = base.materialize(fingerprints(docs, text, id_col, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    nodes = base.materialize(fps.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")), "nodes")
    found = connected_components(links(nodes, threshold, full))
    of = nodes.join(found, nodes.fp == found.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    of = base.materialize(of, "members")
    least = base.materialize(of.groupBy("component").agg(F.min("least").alias("keeper"), F.count("*").alias("m")), "components")
    named = base.lookup(of, least, "component", "m", F.col("fp")).select("fp", "n", F.col("keeper.id").alias("keeper_id"), F.col("keeper.text_hash").alias("keeper_hash"))
    out = base.lookup(fps, base.materialize(named, "classes"), "fp", "n", F.coalesce("doc_id", "text_hash"))
    return out.withColumn("component_id", F.col("keeper_id"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, threshold: int = THRESHOLD, full: int = FULL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Nulls: a null text has no words, and all texts without words have fingerprint zero and link; a
    row with a null id links like any other, but names no component: that is the smallest id that is
    not null, or null if there is none.  Repeated rows fall into one component.  An empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    out = classes(docs, text, id_col, shingle, threshold, full)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
