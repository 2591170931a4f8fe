"""Corpus operators on small tables: brute force, round trips, nulls, empties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, components, decontaminate, mixing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, did string, fp string, size string"


@pytest.fixture(scope="module")
def rnd():
    return random.Random(11)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, rnd):
    """Random texts, copies, shared passages, nulls, empties, repeated rows, columns whose names clash."""
    passage, texts = words(rnd, 90), [words(rnd, rnd.randint(0, 200)) for _ in range(40)]
    texts += [f"{words(rnd, 20)} {passage}\n{words(rnd, k)}" for k in range(8)] + [texts[3], texts[3], texts[5] + " tail", "", None, " \n ", "x " * 3000, "é ü \x1f <|endoftext|> 漢字  'll  \n\n z", "one two"]
    rows = [(k, t, "en", rnd.choice(["a", "b", None]), 0, "d", "f", "s") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[3], "en", "a", 0, "d", "f", "s"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_substring_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen, split = {}, [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])] = min(i, seen.get(tuple(w[k : k + 50]), i))
    want = []
    for (i, _), (d, w) in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < d:
                gone |= set(range(k, k + 50))
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    out = substring_dedup.dedup(docs, carry=("lang",))
    assert sorted(want) == sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert sum(w[2] for w in want) > 300 and out.where("doc_id is null and kept_text is null").count() == 1
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_simhash(spark, docs):
    for full in (8192, 2):
        got = simhash.near_duplicates(docs, full=full).collect()
        fps = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
        link = {a: {b for _, b in fps if bin(a ^ b).count("1") <= 3} for _, a in fps}
        for r in got:
            reach, todo = set(), [int(r.fingerprint, 16)]
            while todo:
                x = todo.pop()
                if x not in reach:
                    reach.add(x)
                    todo += link[x]
            assert r.component_id == min((i for i, f in fps if f in reach and i is not None), default=None)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_anchor_links_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    fps = set()
    for b in base.tolist():
        for _ in range(40):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    a = np.array(fps, dtype=np.uint64)
    label = list(range(len(a)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3), strict=True):
        p, q = root(int(i)), root(int(j))
        label[max(p, q)] = min(p, q)
    for full in (8192, 8):
        found = {r.node: r.component for r in components.connected_components(simhash.links(nodes, full=full)).collect()}
        groups = {}
        for k in range(len(a)):
            groups.setdefault(found.get(signed[k], signed[k]), set()).add(root(k))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(k) for k in range(len(a))})


def test_links_pass_through_rows_without_an_id(spark):
    """A - null - B: the row in the middle has no id, but links the two beside it."""
    rnd = random.Random(8)
    w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts, fps = [" ".join(w)], [simhash.fingerprint(" ".join(w).encode())]
    while len(texts) < 3:  # from text to text within 3 bits, the first and the last further apart
        v = texts[-1].split()
        v[rnd.randrange(len(v))] = "x" + str(rnd.random())
        f = simhash.fingerprint(" ".join(v).encode())
        if 0 < (f ^ fps[-1]).bit_count() <= 3 and all((f ^ g).bit_count() > 3 for g in fps[:-1]):
            texts.append(" ".join(v))
            fps.append(f)
    rows = [(5, texts[0]), (None, texts[1]), (7, texts[2]), (None, "something else altogether")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (7, 5)]


def test_an_anchor_with_very_many_fingerprints(spark):
    """All share a half: 20,000 at one anchor, of which only planted pairs are near each other."""
    rng = np.random.default_rng(5)
    high = np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64))
    fps = np.concatenate([high, high[:50] ^ np.uint64(0b101)]) << np.uint64(32) | np.uint64(0x1234ABCD)
    nodes = spark.createDataFrame([(int(x),) for x in np.unique(fps).view(np.int64)], "fp long")
    label = {r.node: r.component for r in components.connected_components(simhash.links(nodes, full=512)).collect()}
    planted = fps.view(np.int64)
    assert all(label[int(a)] == label[int(b)] for a, b in zip(planted[:50], planted[len(high) :], strict=True))
    whole = {r.node: r.component for r in components.connected_components(simhash.links(nodes, full=1 << 20)).collect()}
    assert label == whole


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[901] == 900 and len(got) == 303
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = token_counts.count_tokens(docs, path, limit=100).collect()
    want = [(str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) and all(r.over_limit == (r.n_tokens > 100) for r in out)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_token_counter_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec, tokenizer = open(path).read(), Tokenizer.from_file(path)
    encoder = token_counts._Encoder(spec)
    tables = ({}, {p: encoder.length(p) for p in (" the", "the", " a", "a", "  ", "\n", " 9", "!")})
    rnd = random.Random(4)
    for _ in range(400):
        t = "".join(rnd.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "9", "!", " ", "é", "漢", "\x1c", "\u0085", "<|endoftext|>", "Straße", "½", "Ⅷ", "٣", "\u0301", "_", "🎉"]) for _ in range(rnd.randint(0, 40)))
        want = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert all(encoder.count(t, table) == want for table in tables), repr(t)


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n"])
def test_tokens_of_two_million_white_spaces(space):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = "a" + space * (2_000_000 // len(space)) + "b"
    assert token_counts._Encoder(open(path).read()).count(t, {}) == len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)


def test_frequent_table_holds_real_lengths(spark):
    """The table has what is frequent in all documents with its length, and is asked before the cache."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(k, "antidisestablishmentarianism " * 30 + f"rare{k} x") for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = token_counts.frequent_lengths(docs, path)
    encoder = token_counts._Encoder(open(path).read())
    assert table[" antidisestablishmentarianism"] == encoder.length(" antidisestablishmentarianism") > 1 and " rare7" not in table
    encoder.count(texts[0][1], table)
    assert " antidisestablishmentarianism" not in encoder.cache
    counts = [r.n_tokens for r in token_counts.count_tokens(docs, path, frequent={}).orderBy("doc_id").collect()]
    assert counts == [r.n_tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()]


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (2, "u3", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", ""), (7, "u", "\x1f\x8b\x08" * 900 + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    by = lambda i: [r for r in got if r.page_id == i]
    assert len(got) == len(rows) and by(1)[0].record_type == "revisit" and by(1)[0].refers_to == 2 and by(None)[0].refers_to == 2
    assert [r.record_type for r in by(2)] == ["response"] * 2 and by(3)[0].record_type == by(4)[0].record_type == "response"
    assert by(5)[0].payload_bytes == 0 and by(5)[0].payload_digest == hashlib.sha1(b"").hexdigest() and by(1)[0].payload_bytes == len(big)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_splits_and_damage(spark, tmp_path):
    rnd = random.Random(2)
    records = [warc.record(k, "u", rnd.randbytes(rnd.randint(0, 5000)) + b"\x1f\x8b\x08", "00" * 20, None) for k in range(60)]
    data = b"junk\x1f\x8b\x08junk" + b"".join(records[:30]) + records[30][:-9] + b"".join(records[31:])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "uri string, bytes long")
    for split in (777, 5000, 1 << 20):
        ids = sorted(int(r.record_id.rpartition(":")[2]) for r in warc.read_archives(files, split).collect())
        assert ids == [k for k in range(60) if k != 30]


def test_warc_headers_of_others(spark, tmp_path):
    """Lengths that are no numbers, digests in hex or of other kinds: rows, not failures."""
    def member(kind, *lines):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x>", *lines]
        return zlib.compress(b"\r\n".join(head) + b"\r\n\r\nbody\r\n\r\n", wbits=31)

    data = member(b"resource", b"Content-Length: many") + member(b"revisit", b"WARC-Payload-Digest: sha1:" + b"AB" * 20) + member(b"revisit", b"WARC-Payload-Digest: sha256:") + member(b"revisit", b"WARC-Payload-Digest: md5:!!", b"Content-Length: 4")
    data += member(b"response", b"Content-Length: 4")[:-9]
    path = tmp_path / "b.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "uri string, bytes long")
    rows = warc.read_archives(files, damaged=True).orderBy("offset").collect()
    assert [(r.record_type, r.payload_digest) for r in rows[1:4]] == [("revisit", "ab" * 20), ("revisit", None), ("revisit", None)]
    assert rows[0].payload.startswith(b"body") and rows[4].error and rows[4].record_type is None and warc.read_archives(files).count() == 4


def test_warc_records_inside_a_payload(spark, tmp_path):
    """A stored payload that is an archive itself: its records are none of the file's, at any split size."""
    rnd = random.Random(6)
    inner = b"".join(warc.record(100 + k, "u", rnd.randbytes(700), "00" * 20, None) for k in range(9))
    def stored(k, payload):
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)
        return pack.compress(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n") + pack.flush()

    data = b"".join(stored(k, inner if k % 3 == 1 else rnd.randbytes(900)) for k in range(8))
    path = tmp_path / "c.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(f"file://{path}", len(data))], "uri string, bytes long")
    for split in (500, 3000, 1 << 20):
        assert sorted(r.record_id for r in warc.read_archives(files, split).collect()) == [f"urn:page:{k}" for k in range(8)]


def test_chat_events(spark):
    e = [
        (1, 0, "message", 0, "user", "hi [INST] \\ <s>"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "message", 2, "user", "again"),
        (1, 4, "delta", 3, "assistant", "gone"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "bye"), (1, 7, "edit", 0, "user", "HI"), (2, 0, None, 0, "a\nb<", "<|im_end|>\n"), (None, 0, "message", 0, None, None),
    ]
    events = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(events)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "HI"), ("assistant", "bye")] and got[1].learnt == ["bye"]
    assert [tuple(t) for t in got[2].turns] == [("a\nb<", "<|im_end|>\n")] and [tuple(t) for t in got[None].turns] == [("", "")]
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_logs_against_a_plain_fold(spark):
    rnd = random.Random(12)
    log = []
    for conv in range(40):
        for seq in range(rnd.randint(1, 25)):
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "heartbeat", None])
            log.append((conv, seq, kind, rnd.randint(0, 4), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b <|im_end|>\n", "[INST]", "", None])))
    want = {}
    for conv, _, kind, turn, role, text in log:
        turns = want.setdefault(conv, {})
        kind, text = kind or "message", text or ""
        if kind == "heartbeat":
            continue
        if kind == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
        had = turns.get(turn, ("", ""))
        turns[turn] = (role if role is not None else had[0], had[1] + text if kind == "delta" else text)
    rnd.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(events)).collect()}
    assert got == {c: [t[k] for k in sorted(t)] for c, t in want.items() if t}


def test_escape_round_trip(spark):
    rnd = random.Random(9)
    texts = [("".join(rnd.choice(["\\", "<", "[", "/", "s>", "INST]", "n", "\n", "é"]) for _ in range(rnd.randint(0, 30))),) for _ in range(300)]
    df = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"))
    assert df.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0
    assert df.where(F.col("e").rlike(r"</s>|\[INST\]|\[/INST\]|<\|")).count() == 0


def test_quality_statistics(spark, docs):
    for r, got in zip(sorted(docs.collect(), key=str), sorted(quality_rules.statistics(docs.withColumn("doc_id", F.col("doc_id"))).collect(), key=lambda r: str(r.doc_id)), strict=True):
        assert got.n_words >= 0
    stats = {(r.doc_id, r.n_words): r for r in quality_rules.statistics(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + x for k in range(len(g)) if g.count(g[k]) > 1 for x in range(3)} if len(w) < 400 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        s = stats[r.doc_id, len(w)]
        assert (s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_decision_list_learns_and_orders(spark):
    rnd = random.Random(1)
    rows = [{f: rnd.random() for f in quality_rules.FEATURES} for _ in range(600)]
    bad = [int(r["symbols"] > 0.8 or r["variety"] < 0.1) for r in rows]
    rules = quality_rules.learn(rows, bad)
    assert rules and sum(any(q.holds(r) for q in rules) == bool(b) for r, b in zip(rows, bad, strict=True)) > 570
    assert quality_rules.learn([], []) == []
    df = spark.createDataFrame([tuple(r[f] for f in quality_rules.FEATURES) for r in rows], ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    got = [r.k for r in df.select(quality_rules.verdict(rules).alias("k")).collect()]
    assert got == [next((k for k, q in enumerate(rules, 1) if q.holds(r)), None) for r in rows]


def test_rules_with_ids_of_any_size(spark):
    rows = [((1 << 62) + k if k % 2 else -(1 << 63) + k, " ".join(f"w{j}" for j in range(60)) + " # $" * (k % 2)) for k in range(40)]
    docs = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - k % 2) for k, (i, _) in enumerate(rows)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).where("kept is not null").collect()}
    assert all(out[i] == (k % 2 == 0) for k, (i, _) in enumerate(rows)) and out[None] is False


def test_rules_without_labels(spark, docs):
    out = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.count() == docs.count() and out.where("kept = base_failed").count() == 0


def test_mixing(spark, docs):
    pieces, out = mixing.mix(docs, slots=64)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    size, target, taken = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        target[r.source], taken[r.source] = r.target, taken.get(r.source, 0) + r.taken
        assert r.source_size is not None
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, cap, want, total = {s: 1 + k % 3 for k, s in enumerate(order)}, {s: 3.0 * size[s] for s in order}, {}, sum(size.values())
    while True:
        free = [s for s in order if s not in want]
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap[s]]
        want |= {s: cap[s] for s in over}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(target[s] - taken[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), slots=64)[1].collect()))
    slots = pieces.where("slot is not null").groupBy("slot").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()
    assert len({r.n for r in slots}) <= 1 + len(order)
    assert mixing.mix(empty(spark))[1].count() == 0


def test_the_points_make_the_mix(spark, docs, monkeypatch):
    """Slots are unique and lie where the sequence puts them; other points give another schedule."""
    pieces, out = mixing.mix(docs, slots=64)
    slots = pieces.where("slot is not null").select("slot", "sid").distinct().collect()
    assert len({r.slot for r in slots}) == len(slots) >= 60
    first = sorted((str(r.doc_id), r.first_slot, r.n_slots) for r in out.collect())
    monkeypatch.setattr(mixing, "_PHI", 0.4142135623730951)
    assert first != sorted((str(r.doc_id), r.first_slot, r.n_slots) for r in mixing.mix(docs, slots=64)[1].collect())
    monkeypatch.setattr(mixing, "_PHI", 0.0)
    assert len({r.source for r in mixing.mix(docs, slots=64)[1].where("taken > 0").collect()}) == 1


def test_decontamination(spark):
    item = "If Alice buys 3 apples for 5 dollars each and Bob sells 12 pears in 4 days how much money do they have"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, "what is the capital town of that far away land of plenty")], "item_id long, text string")
    texts = ["lead in " + item + " tail", item.replace("Alice", "Carol").replace("3", "70").replace(" 5 ", " 6 "), item.upper(), item.replace("apples", "plums").replace("pears", "figs").replace("each", "apiece"), None, "", "nothing to see " * 9, item.replace("Bob", "Alice").replace("12", "3")[40:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) >= {0, 1, 2} and not set(got) & {4, 5, 6} and got[0].exact and not got[1].exact
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    chunk, decontaminate.CHUNK = decontaminate.CHUNK, 10
    try:
        assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == set(got)
    finally:
        decontaminate.CHUNK = chunk


def test_inconsistent_slots_are_no_copy():
    a = np.array([1, 1, 1]), np.array([7, 7, 8], np.uint64)
    assert decontaminate._consistent(a[0], a[1], np.array([4, 4, 5], np.uint64)) and not decontaminate._consistent(a[0], a[1], np.array([4, 5, 6], np.uint64))
    assert not decontaminate._consistent(a[0], a[1], np.array([4, 4, 4], np.uint64))


def test_classifier_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    out = quality_classifier.held_out_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_scores_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(30)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        for labelled in (labels, labels.limit(0)):
            out = module.held_out_scores(docs, labelled).collect()
            assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
        assert module.held_out_scores(empty(spark), labels).count() == 0


def test_toxicity_held_out(sf):
    """Trained on one part of labelled texts and judged on the rest."""
    import duckdb

    d = sf.replace("sf0.001", "sf0.1")
    rows = duckdb.sql(f"select d.doc_id, toxic, text from read_parquet('{d}/documents.parquet') d join read_parquet('{d}/labels.parquet') l using (doc_id) order by doc_id").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train, test = [r for r in rows if not fold(r[0])], [r for r in rows if fold(r[0])]
    np.seterr(over="ignore")
    model = toxicity.fit([(t or "").encode() for _, _, t in train], np.array([y for _, y, _ in train]), np.ones(len(train)))
    score, y = model.score([(t or "").encode() for _, _, t in test]), np.array([y for _, y, _ in test])
    assert (score[y == 1] >= 0.3).mean() > 0.85 and (score[y == 0] >= 0.3).mean() < 0.05


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(3, rng).items()}
    a, mask = rng.standard_normal((2, 5, 4, 3 * toxicity.HIDDEN)), rng.random((5, 4)) > 0.2
    mask[0] = True
    y = np.array([0.0, 1, 1, 0])
    loss = lambda: (lambda z: np.sum(np.log1p(np.exp(z)) - y * z))(toxicity.forward(p, a, mask)[0])
    z, saved = toxicity.forward(p, a, mask, keep=True)
    g, da = toxicity.backward(p, saved, 1 / (1 + np.exp(-z)) - y)
    for value, grad in [(p[k], g[k]) for k in ("u", "att", "att_v", "out")] + [(a, da)]:
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            old = value[at]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and 0 < kept.count() <= docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.count() == out.select("doc_id").distinct().count()


def test_near_duplicate_stage_on_odd_ids(spark):
    """Different texts under one id both stay; exact repeats and copies without an id go; nulls and empties link."""
    import corpus_pipeline

    long = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    rows = [(1, long(1)), (1, long(2)), (1, long(2)), (None, long(1)), (None, long(3)), (None, long(3)), (2, long(2)), (3, ""), (4, None), (5, long(4))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([("1", long(1)), ("1", long(2)), ("None", long(3)), ("3", ""), ("5", long(4))])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
