"""Decontamination and the pipeline against brute force."""

import random

import brute
import corpus_pipeline
from folioflow.llm import base, decontaminate, quality_classifier, queries, toxicity

UNITS = set(decontaminate.UNITS)


def test_decontamination_against_all_pairs_of_windows(spark):
    rnd = random.Random(5)
    vocabulary = ["the", "train", "Anna", "Boris", "km", "12", "7.5", "meters", "runs", "of", "each", "kg", "--", "(Carl)", "3", "ran,", "Über", "hours"]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (0, 3, 5, 9, 13, 14, 30, 40)] + [None, "Of the 12 meters"]
    texts = [None, "", "km of the train", "the end 12", "meters of the train runs each"]
    for item in items[2:8]:
        w = item.split()
        swap = {x: rnd.choice(vocabulary) for x in set(w) if x[0].isdigit() or x[0].isupper()}
        filler = " ".join(rnd.choice(vocabulary) for _ in range(20))
        texts += [f"{filler} {item} {filler}", " ".join(swap.get(x, x) for x in w), item.lower(), " ".join(rnd.choice(vocabulary) if x == "12" else x for x in w), " ".join(w[3:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    want = sorted(brute.contaminated(texts, items, UNITS))
    assert got == want and len(want) > 12


def test_verbatim_copies_of_short_and_slot_heavy_items_are_found(spark, tmp_path):
    """Items whose templates say too little are found by value; other values are another item."""
    row = " ".join(str(k * k) for k in range(20, 45))
    items = ["Compute 12 + 7 * 3 - 4", "What is 12 + 7 ?", "Find the sum of this table of values by rows and columns : " + row, row, "42", "Meters of rope are cut by the sailor"]
    held = ["lead in. Compute 12 + 7 * 3 - 4, tail", "so what is 12 + 7 ? Tell", "the table " + " ".join(row.split()[:13]) + " end", "it is 42.", "page 12 Meters of rope are cut by the sailor"]
    other = ["compute 13 + 8 * 3 - 4", "what is 13 + 7 ?", " ".join(str(k * k + 1) for k in range(20, 45)), "it is 43", "page 12 of rope"]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(held + other)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): (r.matched_words, r.exact) for r in queries.op7_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (5, True), (1, 1): (4, True), (2, 2): (13, True), (2, 3): (13, True), (3, 4): (1, True), (4, 5): (8, True)}
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()) == [5, 6, 7, 8, 9]


def test_a_text_does_not_see_its_neighbours(spark):
    """Texts share a block: a number at the end of one is not before the unit that begins the next."""
    item = "5 meters of rope are cut by the sailor before the storm comes in again"
    texts = ["a list of 12", "meters of rope are cut by the sailor before the storm comes in again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    alone = docs.where("doc_id = 1")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    both = [tuple(r) for r in decontaminate.contaminated(docs, bench).collect() if r.doc_id == 1]
    assert both == [tuple(r) for r in decontaminate.contaminated(alone, bench).collect()]


def test_scores_do_not_depend_on_the_block(sf):
    """A text has the same features, and the same score, alone and among others."""
    import duckdb
    import numpy as np

    np.seterr(over="ignore")
    texts = [(t or "").encode() for (t,) in duckdb.sql(f"select text from read_parquet('{sf}/documents.parquet') order by doc_id").fetchall()] + [b"", b"\n\n", b"a\n", b"\na\nb"]
    alone = np.concatenate([quality_classifier.features([t]) for t in texts])
    assert (quality_classifier.features(texts) == alone).all()
    assert (quality_classifier.features(texts[::-1])[::-1] == alone).all()
    lines = alone[:, quality_classifier.FEATURES.index("lines")]
    assert np.allclose(lines, [t.count(b"\n") / len(t.split()) if t.split() else 0 for t in texts])
    y = np.arange(len(texts)) % 2
    model = toxicity.fit(texts, y, np.ones(len(y)), epochs=1, least=2)
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]), atol=1e-5)


def test_long_runs_are_scored_to_their_end():
    """Every byte of a run without spaces is in some word, so the tail of a run counts."""
    import numpy as np

    np.seterr(over="ignore")
    run = "".join(chr(0x4E00 + k) for k in range(200)).encode()
    t = toxicity.Tokens([b"a " + run, b"", b"x" * 64 + b" b", run])
    assert t.count.tolist() == [11, 0, 2, 10] and int(t.tri_count[t.type].sum()) == 1 + 600 + 64 + 1 + 600
    texts = [b"plain words here %d" % (k % 7) for k in range(60)] + [b"plain vile words %d" % (k % 7) for k in range(60)]
    model = toxicity.fit(texts, np.arange(120) // 60, np.ones(120), epochs=1, least=2)
    clean, vile = b"_".join([b"plain"] * 40), b"_".join([b"plain"] * 20 + [b"vile"] * 20)
    assert model.raw([clean])[0] != model.raw([vile])[0]


def test_clashing_columns_are_replaced_or_passed_on(spark):
    rows = [(1, "some text of a few plain words", "x", "y", 2.0, "z", "dot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Hits string, SCORE string, predicted double, item_id string, `a.b` string")
    bench = spark.createDataFrame([(9, "some text of a few plain words")], "item_id long, text string")
    (row,) = decontaminate.annotate(docs, bench).collect()
    assert [h.item_id for h in row.hits] == [9] and row.SCORE == "y" and row["a.b"] == "dot" and row.item_id == "z"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    (row,) = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert isinstance(row.score, float) and row.predicted in (0, 1) and row.Hits == "x" and row["a.b"] == "dot"


def test_pipeline_against_brute_force(spark, sf):
    table = base.read(spark, sf, "documents")
    rows = {r.doc_id: r for r in table.collect()}
    items = [r.text for r in base.read(spark, sf, "benchmark").collect()]
    model = quality_classifier.train(table, base.read(spark, sf, "labels"))
    docs = {i: r.text for i, r in rows.items()}
    features = {i: quality_classifier.features([(t or "").encode()])[0] for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if brute.additive_score(model, features[i]) >= 0.3}
    counts = [len(rows), len(docs)]
    keep = brute.first_of_groups(docs)
    docs = {i: t for i, t in docs.items() if i in keep}
    counts.append(len(docs))
    docs = brute.without_repeats(docs)
    ids = list(docs)
    hit = {ids[d] for d, *_ in brute.contaminated(list(docs.values()), items, UNITS)}
    docs = {i: t for i, t in docs.items() if i not in hit}
    counts.append(len(docs))
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]

    size, by_source = {i: len(brute.words(t)) for i, t in docs.items()}, {}
    for i, n in size.items():
        by_source[rows[i].source] = by_source.get(rows[i].source, 0) + n
    target, taken = brute.shares(by_source), {}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r["size"] for r in out} == size
    for r in out:
        assert r.source == rows[r.doc_id].source and r.source_size == by_source[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_quality_features_against_plain_python(sf):
    import duckdb
    import numpy as np

    np.seterr(over="ignore")
    texts = [(t or "").encode() for (t,) in duckdb.sql(f"select text from read_parquet('{sf}/documents.parquet') order by doc_id").fetchall()]
    texts += [b"", b" \n", b"a\na\n\na b\na b|c\td", b"http://x.y/z?a=b a a A \xc3\xa9!", b"x" * 5000, b"\na"]
    for t, got in zip(texts, quality_classifier.features(texts), strict=True):
        want = brute.quality_features(t)
        assert np.allclose(got, [want.get(f, 0.0) for f in quality_classifier.FEATURES], atol=1e-12), t[:80]


def test_toxicity_scores_against_plain_python():
    import numpy as np

    from folioflow.llm.wordhash import word_hashes

    np.seterr(over="ignore")
    rnd = random.Random(3)
    vocabulary = ["plain", "words", "vile", "Nasty,", "(and)", "é", "漢字", "--", "x1", "run" * 40]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).encode()
    model = toxicity.fit([make(rnd.randint(0, 60)) for _ in range(80)], np.arange(80) % 2, np.ones(80), epochs=1, least=8)
    model.slope, model.offset = 1.0, 0.0  # the labels above mean nothing: calibration would flatten all scores
    one = lambda x: int(word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    texts = [b"", b"--", b"vile", make(23), make(24), make(25), make(36), make(37), make(150), "漢字".encode() * 100]
    want = [brute.toxicity_score(model, t, one, toxicity.LENGTH, toxicity.STRIDE, toxicity.PIECE, toxicity.TRIGRAMS) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-5) and np.ptp(want) > 1e-3
