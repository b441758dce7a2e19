"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import encode_decode, read_spec
from tidewater.llm.common import table
from tidewater.llm.decontaminate import contaminated
from tidewater.llm.exact_dedup import exact_groups
from tidewater.llm.html_text import extract
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.quality import resample
from tidewater.llm.sharding import shard
from tidewater.llm.simhash import near_duplicates
from tidewater.llm.toxicity import toxicity
from tidewater.llm.url_filter import judge_urls


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    spec = read_spec(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return encode_decode(table(spark, sf_dir, "documents"), spec, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), arrivals=2).select("doc_id", "shard_id", "shard_bytes", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents)
select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  doc_id = min(doc_id) over (partition by x) as kept, sha256(x) as text_sha256 from t""",
    # no page of these tables has a canonical link or a meta refresh, so a page without a rule is allowed
    "op6_url_filter": r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
r(verdict, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
m as (select page_id, host, path, verdict, rule, row_number() over (partition by page_id order by length(rule) desc nulls last) as n
  from p left join r on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1""",
    "op10_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, {_KEY} as key from l),
c as (select key, min(doc_id) as first_id, count(distinct doc_id) as n from k where length(key) >= 10 group by key),
d as (select k.*, coalesce(c.n >= 2 and k.doc_id <> c.first_id, false) as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from d group by doc_id""",
}
