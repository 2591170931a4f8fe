"""Quality rules as learned decision lists, in DataFrame functions alone.

Statistics of every text are Catalyst expressions.  From a bounded sample of labelled statistics a
list of rules is learned by sequential covering: each rule is a conjunction of thresholds, grown on
two thirds of the rows by FOIL's information gain, pruned on the rest, and kept if it is right often
enough; the rows it covers are set aside and the next rule is grown.  The list becomes one ordered
CASE expression: the first rule that holds rejects, no rule keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Bound of the labelled sample (rows, chosen by hash of the id) that rules are learned from.
SAMPLE = 20_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, chars: str) -> Column:
    """Characters of a class; counting matches is several times faster than translating the text."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def n_symbols(text: Column) -> Column:
    return _count(text, r"#*$%&|<>")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(base.WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


#: A window's key: 32 bits of its words' hash above its position.
_POSITION = (1 << 32) - 1


def _maybe_repeated(keys: Column) -> Column:
    """Positions whose hash a neighbour shares: all windows that occur twice, and few others."""
    upper = lambda k: F.shiftright(k, 32)
    same = lambda k, i: (upper(F.get(keys, i - 1)) == upper(k)) | (upper(F.get(keys, i + 1)) == upper(k))
    return F.transform(F.filter(keys, lambda k, i: F.coalesce(same(k, i), F.lit(False))), lambda k: k.bitwiseAND(F.lit(_POSITION)).cast("int"))


def _repeated(words: Column, places: Column) -> Column:
    """Of these positions those whose three words do occur at another, in order.

    Each window is written as "a b c\\nposition" and sorted as a string: equal windows become
    neighbours (words hold no white space), so no window is compared with all others.
    """
    text = lambda i: F.concat(words[i], F.lit(" "), words[i + 1], F.lit(" "), words[i + 2], F.lit("\n"), i.cast("string"))
    window = lambda k: F.substring_index(k, "\n", 1)
    same = lambda all_, k, i: F.coalesce((window(F.get(all_, i - 1)) == window(k)) | (window(F.get(all_, i + 1)) == window(k)), F.lit(False))
    kept = let(F.sort_array(F.transform(places, text)), lambda s: F.filter(s, lambda k, i: same(s, k, i)))
    return F.sort_array(F.transform(kept, lambda k: F.substring_index(k, "\n", -1).cast("int")))


def _covered(places: Column) -> Column:
    """Words in the three-word windows at ascending positions: each adds what the one before left out."""
    return F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
    )


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first ones included.

    Hashes name the few windows that may be repeated; their words decide.  Every step is bound once:
    what stands inside a lambda is evaluated anew for each element, and a filter above is pushed
    through columns by writing them out.
    """
    three = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    keys = lambda h: F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 32) + i))
    found = lambda w, h: let(keys(h), lambda k: let(_maybe_repeated(k), lambda m: _covered(_repeated(w, m))))
    count = lambda w, h: F.when(F.size(F.array_distinct(h)) < F.size(h), found(w, h)).otherwise(F.lit(0).cast("long"))
    return let(words, lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h1: let(three(h1), lambda h3: count(w, h3))))


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratios of them and `carry` for every row.

    A null text has no words and all statistics zero; a null id passes through.  Repeated rows are
    measured each, an empty table gives no rows, columns not carried are ignored.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *carry)
    w = t.select("doc_id", "t", words_of(F.col("t")).alias("w"), *carry)
    s = w.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("t")).alias("n_symbols"),
        n_dup_lines(F.col("t")).alias("n_dup_lines"),
        n_repeat_words(F.col("w")).alias("n_repeat_words"),
        _count(F.col("t"), "A-Z").cast("double").alias("upper"),
        _count(F.col("t"), "0-9").cast("double").alias("digits"),
        _count(F.col("t"), ".!?").cast("double").alias("stops"),
        _count(F.col("t"), "!").cast("double").alias("shouts"),
        F.size(F.array_distinct("w")).cast("double").alias("distinct"),
        *carry,
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("n_words").cast("double").alias("words"), per_word("word_chars").alias("mean_word"), per_word("n_symbols").alias("symbols"),
        per_word("n_dup_lines").alias("dup_lines"), per_word("n_repeat_words").alias("repeats"), per_char("upper").alias("uppers"),
        per_char("digits").alias("digit_share"), per_word("stops").alias("sentence_ends"), per_word("shouts").alias("exclaims"), per_word("distinct").alias("variety"),
        *carry,
    )


FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "uppers", "digit_share", "sentence_ends", "exclaims", "variety")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); `right` of the `covered` rows it was kept for."""

    tests: tuple[tuple[str, str, float], ...]
    right: int
    covered: int

    def holds(self, row: dict[str, float]) -> bool:
        return all(row[f] <= x if op == "<=" else row[f] > x for f, op, x in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, x in self.tests:
            out = out & (F.col(f) <= F.lit(x) if op == "<=" else F.col(f) > F.lit(x))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {x:.4g}" for f, op, x in self.tests) + f" ({self.right} of {self.covered})"


def _best_test(x: np.ndarray, bad: np.ndarray, features):
    """The threshold test with the most information gain for `bad` rows; None if none gains."""
    p, n = int(bad.sum()), len(bad)
    base_bits = np.log2(p / n)
    best, found = 0.0, None
    for k, f in enumerate(features):
        order = np.argsort(x[:, k], kind="stable")
        values, below = x[order, k], np.cumsum(bad[order])[:-1]
        size = np.arange(1, n)
        apart = values[1:] != values[:-1]
        for op, hit, covered in (("<=", below, size), (">", p - below, n - size)):
            ok = apart & (hit > 0)
            if not ok.any():
                continue
            gain = np.where(ok, hit * (np.log2(np.maximum(hit, 1) / covered) - base_bits), -1.0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = float(gain[at]), (f, op, float((values[at] + values[at + 1]) / 2))
    return found


def learn(rows: list[dict[str, float]], bad: list[int], features=FEATURES, precision: float = 0.8, most: int = 12, least: int = 5) -> list[Rule]:
    """Ordered rules that reject, by sequential covering.  No rows of either kind: no rules."""
    column = {f: k for k, f in enumerate(features)}
    x = np.array([[r[f] for f in features] for r in rows], dtype=np.float64).reshape(len(rows), len(features))
    y = np.array(bad, dtype=np.int64)
    growing = np.arange(len(rows)) % 3 != 0
    left = np.ones(len(rows), dtype=bool)
    rules: list[Rule] = []

    def holds(tests) -> np.ndarray:
        out = np.ones(len(rows), dtype=bool)
        for f, op, cut in tests:
            out &= x[:, column[f]] <= cut if op == "<=" else x[:, column[f]] > cut
        return out

    def score(tests, of: np.ndarray) -> tuple[int, int]:
        hit = holds(tests) & of
        return int(y[hit].sum()), int(hit.sum())

    def worth(tests) -> float:
        p, n = score(tests, left & ~growing)
        return (p - (n - p)) / n if n else -1.0

    while len(rules) < most and y[left & growing].sum() >= least:
        tests, inside = [], left & growing
        while len(tests) < 4 and 0 < y[inside].sum() < inside.sum():
            test = _best_test(x[inside], y[inside], features)
            if test is None:
                break
            tests.append(test)
            inside = inside & holds([test])
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        right, covered = score(tests, left)
        if not tests or covered < least or right < precision * covered:
            break
        rules.append(Rule(tuple(tests), right, covered))
        left &= ~holds(tests)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered CASE: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def sample_of_labels(labels: DataFrame, label: str, where: Column | None = None, most: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """id, label of at most `most` labelled ids, by hash of the id; an id labelled twice takes the mean, rounded."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.round(F.avg(label)).cast("int").alias("__label"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(most)


def learn_from(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, **kwargs) -> list[Rule]:
    """Rules from the statistics of labelled documents: at most `most` rows of ten numbers reach the driver.

    Rows without an id or a label are not learned from; a document whose id is repeated counts as
    often as it occurs.  No labels: no rules.
    """
    sample = sample_of_labels(labels, label, most=most)
    found = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__label")
    stats = statistics(found, carry=("__label",))
    got = stats.select("doc_id", "__label", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", "__label", *FEATURES).limit(most).collect()
    rows = [r.asDict() for r in got]
    return learn(rows, [1 - r["__label"] for r in rows], **kwargs)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (number of the first that holds) and kept."""
    n, r = F.col("n_words"), F.col("n_repeat_words")
    out = stats.withColumn("base_failed", (n < 50) | (r * 100 > n * 50)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and rule for every row of docs.

    Nulls: a null text has no words and fails the base rules; a null doc_id passes through unlabelled.
    Repeated rows are judged each.  Empty labels learn no rule: the base rules alone decide.  An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rules = learn_from(docs.select("doc_id", "text"), labels)
    out = apply_rules(statistics(docs), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
