"""The thin queries of the ten operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity, warc
from .base import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows and conversation -7 as message events, formatted, read back and digested."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    events = rows.unionByName(own).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), *_turn_of_row())
    back = chat.read_back(chat.format_chats(events))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _turn_of_row():
    """Rows are messages of their own, also where a table repeats a turn's number."""
    from pyspark.sql import Window

    order = [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    return [at.cast("long").alias("turn"), "role", "text"]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))[1].drop("source")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), literal=True)


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_warc, op3_simhash, op4_chat, op5_quality_rules, op6_mixing, op7_decontaminate, op8_token_counts, op9_toxicity, op10_substring_dedup)
}

_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as n, sha1(h) as d from p),
g as (select d, max(page_id) as k from q where n >= 1000 group by d)
select q.page_id, q.n::bigint as payload_bytes, q.d as payload_digest,
  case when g.k is null or g.k = q.page_id then 'response' else 'revisit' end as record_type,
  case when g.k <> q.page_id then g.k end as refers_to
from q left join g on g.d = q.d and q.n >= 1000
"""

_CHAT_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(role) + length(text) + length('<|im_start|>') + length('<|im_end|>') + 2
    + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) as chars from r)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

_SUBSTRING_SQL = r"""
with t as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select r, doc_id, unnest(range(1, len(w) - 48)) as i from t where len(w) >= 50),
h as (select s.r, s.doc_id, s.i, array_to_string(t.w[s.i : s.i + 49], ' ') as x from s join t on t.r = s.r),
m as (select x, min(doc_id) as least from h group by x),
gone as (select h.r, h.i from h join m on m.x = h.x where m.least < h.doc_id),
p as (select r, i as p, w[i] as x from (select r, w, unnest(range(1, len(w) + 1)) as i from t)),
k as (select p.r, p.p, p.x, max(g.i) as cover from p asof left join gone g on g.r = p.r and g.i <= p.p group by all),
d as (select r, count(*) as n, count(*) filter (where cover is not null and p - cover < 50) as lost,
  string_agg(x, ' ' order by p) filter (where cover is null or p - cover >= 50) as kept from k group by r)
select t.doc_id, coalesce(d.n, 0)::bigint as n_words, coalesce(d.lost, 0)::bigint as n_removed, sha256(coalesce(d.kept, '')) as kept_sha256
from t left join d on d.r = t.r
"""

ORACLE_SQL = {"op2_warc": _WARC_SQL, "op4_chat": _CHAT_SQL, "op10_substring_dedup": _SUBSTRING_SQL}
