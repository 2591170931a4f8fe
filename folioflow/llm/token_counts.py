"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table, broadcast: the frequent pre-tokens of the corpus with their lengths
in tokens.  It is counted over all documents without moving pre-tokens: every map task keeps a
Misra-Gries summary of SUMMARY entries and hands on what makes up at least one part in RARE of its
own pre-tokens, so a pre-token that frequent in the corpus is handed on by some task.  The ENTRIES
most frequent are encoded once, on the driver.
Tier two holds what the first lacks: each Python worker encodes a missed pre-token once and keeps its
length in a bounded cache that later batches and tasks of that worker reuse.

A text is cut into pre-tokens by Python's own expressions where their character classes are known to
agree with the tokenizer library's, else by the library.  Texts that hold a special token's string,
and tokenizers that are no byte-level BPE, are encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Characters of \p{N} below U+0250 that Python's \d leaves out (fixed values).
_NUMERALS = "²³¹¼½¾"
#: The splitting pattern of byte-level BPE, in Python's classes.
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_{_NUMERALS}]+| ?[\d{_NUMERALS}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Long-assigned blocks (Latin, Greek, Cyrillic, punctuation, kana, common CJK) on which the classes agree.
SAFE = r"[\x00-\x1b\x20-ȳΑ-ΡΣ-ώА-я‐-‧‰-⁞€←-⇿ぁ-ゖァ-ヺ一-龥가-힣]*"
#: Entries of the broadcast table, and of each task's summary.
ENTRIES, SUMMARY = 16_384, 65_536
#: The share of a task's pre-tokens, one in RARE, from which it hands a pre-token on.
RARE = 32_768
#: Words in each of the two generations of a worker's cache, and the longest that is kept (characters).
CACHE_ENTRIES, LONGEST = 300_000, 256

_worker: dict[str, _Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level BPE writes each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


def _by_ranks(conf: dict, model):
    """Lengths of pre-tokens (bytes) by ranks, where the vocabulary numbers its entries in the order of
    the merges, so that merging the lowest rank first is the same; else None.  Entries that the merges
    can't reach are no single token.
    """
    import tiktoken

    letters, vocab = _byte_letters(), conf["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in conf["model"]["merges"]]
    if any(vocab.get(c, 256) > 255 for c in letters) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    special = {t["content"] for t in conf["added_tokens"]}
    ranks = {bytes(letters[c] for c in entry): i for entry, i in vocab.items() if entry not in special}
    one = tiktoken.Encoding("by_ranks", pat_str=PATTERN_OF_LIBRARY, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    unreached = {bytes(letters[c] for c in entry): n for entry in vocab if entry not in special and (n := len(model.tokenize(entry))) != 1}
    return lambda piece: unreached.get(piece) or len(one(piece))


#: Never applied here: the rank encoder is only given single pre-tokens.
PATTERN_OF_LIBRARY = r"\S+|\s+"


class _Encoder:
    """Splits texts and encodes pre-tokens in one Python worker."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = re.compile(PATTERN).findall
        self.known = re.compile(SAFE).fullmatch
        self.special = [t["content"] for t in conf["added_tokens"]]
        pre = conf["pre_tokenizer"] or {}
        self.by_parts = conf["model"]["type"] == "BPE" and not conf["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        self.letters = _byte_letters()
        self.letter = {b: c for c, b in self.letters.items()}.__getitem__
        self.ranked = _by_ranks(conf, self.tokenizer.model) if self.by_parts else None
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def split(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if it has to be encoded as a whole."""
        if not self.by_parts or any(s in text for s in self.special):
            return None
        if self.known(text if text.isascii() else "".join(set(text))):
            return self.find(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.letters.__getitem__, piece)).decode() for piece, _ in pieces]

    def length(self, part: str) -> int:
        """Tokens of a pre-token, by its merges."""
        data = part.encode()
        return self.ranked(data) if self.ranked else len(self.tokenizer.model.tokenize("".join(map(self.letter, data))))

    def cached(self, part: str) -> int:
        """length(), kept.  The cache has two generations: what was used lately survives a change."""
        n = self.cache.get(part)
        if n is None:
            n = self.older.get(part)
            if n is None:
                n = self.length(part)
            if len(part) <= LONGEST:
                self.cache[part] = n
                if len(self.cache) >= CACHE_ENTRIES:
                    self.older, self.cache = self.cache, {}
        return n

    def count(self, text: str, frequent: dict[str, int]) -> int:
        if not text:
            return 0
        parts = self.split(text)
        if parts is None:
            return self.whole(text)
        got = list(map(frequent.get, parts))
        if None not in got:
            return sum(got)
        return sum(filter(None, got)) + sum(self.cached(p) for p, n in zip(parts, got, strict=True) if n is None)


def _encoder(spec: str) -> _Encoder:
    """This worker's encoder of a tokenizer, by the digest of its file: workers outlive tasks and jobs."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _worker:
        _worker[key] = _Encoder(spec)
    return _worker[key]


def _shrink(counts: Counter, most: int) -> Counter:
    """A Misra-Gries summary of at most `most` entries: all counts fall by the first that is left out."""
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return Counter({p: n - cut for p, n in counts.items() if n > cut})


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", entries: int = ENTRIES) -> dict[str, int]:
    """Pre-tokens that are frequent in docs, with their lengths in tokens; at most `entries`.

    All texts are read.  A pre-token that is one in RARE of all is certainly among those counted.
    """
    spark = docs.sparkSession
    spec = Path(tokenizer_path).read_text()
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        encoder, counts, total = _encoder(shared.value), Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                parts = encoder.split(t) or ()
                counts.update(parts)
                total += len(parts)
                if len(counts) > 2 * SUMMARY:
                    counts = _shrink(counts, SUMMARY)
        kept = [(p, n) for p, n in counts.items() if n > 1 and n * RARE >= total and len(p) <= LONGEST]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["part", "n"])

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(run, "part string, n long")
    top = found.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "part").limit(entries).collect()
    encoder = _encoder(spec)
    return {r.part: encoder.length(r.part) for r in top}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", limit: int = 1024, frequent: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    frequent: the first tier's table, by default that of frequent_lengths() over these documents; it
    decides where a length is found, never what it is.
    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id is passed through.  Repeated
    rows are counted each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    if frequent is None:
        frequent = frequent_lengths(docs, tokenizer_path, text)
    tables = spark.sparkContext.broadcast((Path(tokenizer_path).read_text(), frequent))

    def run(batches):
        spec, table = tables.value
        encoder = _encoder(spec)
        for batch in batches:
            for part in base.columns_of([batch]):
                counts = [encoder.count(t or "", table) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).alias("t"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = thin.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
