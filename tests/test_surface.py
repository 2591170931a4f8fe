"""Command line, SQL names and sinks."""

import json
import os

from pyspark.sql import functions as F

from folioflow import __main__ as cli
from folioflow.functions import sql
from folioflow.functions import text as X
from folioflow.sources import ingest, sinks


def test_sql_functions_equal_the_expressions(spark):
    sql.register(spark)
    texts = [None, "", "plain words", "漢字かな交じり", "############ and ~~~~~~~~~~~~~~~~", "² a　b\x1cc", "ab" * 230_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("select est_tokens(t) as e, count_words(t) as w, human_size(length(t) * 977) as h from texts").collect()
    want = df.select(X.est_tokens(F.col("t")).alias("e"), X.word_count(F.col("t")).alias("w"), X.human_size((F.length("t") * 977).cast("long")).alias("h")).collect()
    assert got == want
    assert spark.sql("select html_to_text('<h1>a</h1>b') as x").first().x == "# a\nb"
    rows = spark.sql("select s.* from values (encode('a,b\n1,2\n', 'UTF-8')) f(c), lateral file_sections(f.c, 'delimited', 'x.csv') s").collect()
    assert [r.anchor for r in rows] == ["=== [delimited data] ==="] and "1\t2" in rows[0].body


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha beta")
    (tmp_path / "b c.html").write_text("<html><body><p>gamma</p></body></html>")
    done = sinks.write_sidecars(ingest.document_text(spark, str(tmp_path))).collect()
    assert sorted(os.path.basename(r.sidecar) for r in done) == [".a.txt.folioflow.md", ".b c.html.folioflow.md"]
    assert "alpha beta" in (tmp_path / ".a.txt.folioflow.md").read_text()
    assert "gamma" in (tmp_path / ".b c.html.folioflow.md").read_text()
    # Hidden files are not input: a second run finds the same two.
    assert ingest.document_text(spark, str(tmp_path)).count() == 2


def test_command_line(spark, tmp_path, capsys):
    good = tmp_path / "in" / "a.txt"
    good.parent.mkdir()
    good.write_text("alpha beta")
    assert cli.main([str(good)]) == 0 and "alpha beta" in capsys.readouterr().out
    assert cli.main([str(good), "--json"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert one["ok"] and "alpha beta" in one["text"]
    assert cli.main([str(good), "--stats-only"]) == 0 and "text" not in json.loads(capsys.readouterr().out)
    (good.parent / "b.gz").write_bytes(b"\x1f\x8b\x08\x00rest")
    assert cli.main([str(good.parent)]) == 3
    captured = capsys.readouterr()
    assert "alpha beta" in captured.out and "b.gz" in captured.err
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert cli.main([str(empty)]) == 6 and cli.main([str(tmp_path / "none"), "--json"]) == 6
    os.mkfifo(tmp_path / "pipe")
    assert cli.main([str(tmp_path / "pipe")]) == 4
    assert cli.main([str(good.parent), "--out", str(tmp_path / "out")]) == 0
    assert sorted(json.loads(r.value)["ok"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [False, True]
