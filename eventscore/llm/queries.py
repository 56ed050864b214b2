"""The registered queries of these operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), spark, width=4, radius=4, seed=42)


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), spark)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import token_table

    return token_table(_table(spark, sf_dir, "documents"), spark, tokenizer_path(), end=1)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), spark, weights=(3, 1, 2), share=1.5, cap=2.0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), spark, RULES)


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warczip import archive_table

    return archive_table(_table(spark, sf_dir, "pages"), spark)


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    return rotate(_table(spark, sf_dir, "conversations"), spark)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import protect

    return protect(_table(spark, sf_dir, "documents"), spark, b"eventscore")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"), spark)


#: The rules of op2: (host and path, verdict).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


#: judge() over `documents` as SQL for DuckDB, where doc_id is unique and not null. Lines and windows are compared as texts, not by hashes.
QUALITY_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as full_lines from d),
each_word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
win as (select doc_id, i, x as a, lead(x) over o as b, lead(x, 2) over o as c from each_word window o as (partition by doc_id order by i)),
again as (select doc_id, i from win where c is not null qualify count(*) over (partition by doc_id, a, b, c) > 1),
rep as (select doc_id, count(distinct i + k) as n from again, range(3) as r(k) group by doc_id),
base as (select w.doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      (len(full_lines) - len(list_distinct(full_lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from w left join rep on rep.doc_id = w.doc_id),
split as (select doc_id, source, trim(unnest(string_split(regexp_replace(lower(t), '[^\p{L}\n]+', ' ', 'g'), chr(10)))) as x from d),
line as (select distinct doc_id, source, x from split where x <> ''),
often as (select source, x from (select distinct split.source, d.t, x from split join d on d.doc_id = split.doc_id where x <> '') group by source, x having count(*) > 10),
gone as (select doc_id, count(*)::bigint as n, sum(length(line.x)) as size from line join often on line.source is not distinct from often.source and line.x = often.x
      group by doc_id),
total as (select doc_id, sum(length(x)) as size from line group by doc_id),
told as (select base.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(gone.n, 0)::bigint as n_removed_lines,
      coalesce(gone.size > 0.5::double * total.size, false) as depleted
      from base left join gone on gone.doc_id = base.doc_id left join total on total.doc_id = base.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, depleted, not base_failed and not depleted as kept from told
"""

#: archive_table() over `pages` as SQL for DuckDB, where page_id is unique and not null. Five hexadecimal digits are four of base32.
WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by payload) as first_id from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from h
"""


def _oracles() -> dict[str, str]:
    from .chat import rotate_sql
    from .leaks_sql import LEAKS_SQL

    return {"op10_decontaminate": LEAKS_SQL, "op5_chat_rotation": rotate_sql(), "op3_quality_lines": QUALITY_SQL, "op4_warc_zip": WARC_SQL}


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_url_filter, op3_quality_lines, op4_warc_zip, op5_chat_rotation, op6_pii_surrogates, op7_token_files, op8_mix_sources, op9_language_id, op10_decontaminate)
}
ORACLES = _oracles()
