"""The engine's functions under SQL names, for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import CJK, SAMPLE, SAMPLED_FROM, SYMBOL_RUN


def _estimate(s: str) -> str:
    cjk = f"regexp_count({s}, r'{CJK}')"
    runs = f"aggregate(regexp_extract_all({s}, r'{SYMBOL_RUN}', 0), 0L, (n, r) -> n + floor(length(r) / 4.0D))"
    return f"cast(floor((length({s}) - {cjk}) / 4.0D + {cjk} * 1.05D + {runs} + 1) as bigint)"


def _let(name: str, value: str, body: str) -> str:
    """body with `name` bound once, so that a long text is measured once and not per character."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_STEP = f"greatest(cast(floor(length(s) / {SAMPLE}) as int), 1)"
_SAMPLED = _let("x", f"array_join(filter(split(s, ''), (c, i) -> i % {_STEP} = 0), '')", _estimate("x"))
_SCALARS = {
    "est_tokens(t STRING) RETURNS BIGINT": _let(
        "s", "coalesce(t, '')", f"case when length(s) = 0 then 0L when length(s) > {SAMPLED_FROM} then {_SAMPLED} * {_STEP} else {_estimate('s')} end"
    ),
    "human_size(n BIGINT) RETURNS STRING": (
        "case when n < 1024 then concat(n, 'B') when n < 1048576 then concat(format_string('%.1f', bround(n / 1024D, 1)), 'KB')"
        " when n < 1073741824 then concat(format_string('%.1f', bround(n / 1048576D, 1)), 'MB') else concat(format_string('%.2f', bround(n / 1073741824D, 2)), 'GB') end"
    ),
    "count_words(t STRING) RETURNS BIGINT": r"cast(regexp_count(coalesce(t, ''), r'(?U)[^\s\x1C-\x1F]+') as bigint)",
}


class _Sections:
    def eval(self, content: bytes, fmt: str, name: str):
        from ..conf import EngineConf
        from ..sources.readers import read_file

        if content is None or fmt is None:
            return
        for k, (anchor, body, hint) in enumerate(read_file(bytes(content), fmt, name or "", EngineConf(), None, None)[1]):
            yield k, anchor, body, hint


def register(spark: SparkSession) -> None:
    """Temporary functions: est_tokens, human_size and count_words, inlined by the optimizer; html_to_text
    by Arrow batches; and the table function file_sections(content, fmt, name), in which a damaged file
    fails the query (ingest.extract gives it a row instead).
    """
    from ..sources.readers import html_text

    for signature, body in _SCALARS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")

    def convert(batch):
        return batch.map(lambda x: html_text(x) if x is not None else None)

    spark.udf.register("html_to_text", F.pandas_udf(convert, "string"))
    spark.udtf.register("file_sections", F.udtf(_Sections, returnType="section_idx int, anchor string, body string, fetch_hint string"))
