"""The numbered operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausework.llm.decontaminate import contaminated
from clausework.llm.embeddings import near_duplicate_vectors
from clausework.llm import licenses
from clausework.llm.html import main_text
from clausework.llm.mixing import SCHEDULES, SHARE, WEIGHTS, mix
from clausework.llm.neardup import near_duplicates
from clausework.llm.packing import pack
from clausework.llm.pii import find_personal_data
from clausework.llm.quality import quality_scores
from clausework.llm.search import ranked_search
from clausework.llm.toxicity import toxicity_scores
from clausework.llm.warc import LEAST_REVISIT, capture_history
from clausework.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_history(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "captured")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_html_extraction": op5_html_extraction,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_best_fit_packing": op13_best_fit_packing,
}


def _position_sql(demand: str, schedule: tuple[tuple[float, float], ...]) -> str:
    steps = list(zip(schedule, schedule[1:], strict=False))
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in steps)
    cases, before = [], 0.0
    for (t0, w0), (t1, w1) in steps:
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        q = f"greatest(0e0, {demand} * {total}e0 - {before}e0)"
        x = f"2 * ({q}) / nullif({w0}e0 + sqrt(greatest(0e0, {w0 * w0}e0 + {2 * slope}e0 * ({q}))), 0e0)"
        cases.append(f"when {demand} * {total}e0 <= {before + area}e0 then {t0}e0 + least(coalesce({x}, 0e0), {t1 - t0}e0)")
        before += area
    return f"case {' '.join(cases)} else {float(schedule[-1][0])}e0 end"


def _mixing_sql() -> str:
    weights = " ".join(f"when {k} then {w}e0" for k, w in enumerate(WEIGHTS))
    when = lambda start: " ".join(f"when rank % {len(SCHEDULES)} = {k} then {_position_sql(f'(({start}) / nullif(target, 0e0))', s)}" for k, s in enumerate(SCHEDULES))
    return rf"""
with d as (
  select doc_id, source, text, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as place
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
w as (select *, case rank % {len(WEIGHTS)} {weights} end as weight, 2e0 * source_size as cap from r),
f as (
  select *, least({SHARE}e0 * sum(source_size) over (), sum(cap) over ()) as total,
    coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0e0) as cap_before,
    sum(weight) over (order by cap / weight desc, rank desc rows between unbounded preceding and current row) as weight_left
  from w),
l as (select *, max(case when (total - cap_before) / weight_left <= cap / weight then (total - cap_before) / weight_left end) over () as level from f),
t as (select source, source_size, rank, case when level is null then cap else least(cap, level * weight) end as target from l),
p as (
  select doc_id, size, d.source, place,
    cast(coalesce(sum(size) over (partition by d.source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d),
j as (select p.*, t.source_size, t.rank, t.target, cast(round(t.target) as bigint) as goal from p join t on p.source is not distinct from t.source),
o as (
  select *, greatest(0, least(start + size, goal) - start) as first_part, greatest(0, least(source_size + start + size, goal) - (source_size + start)) as second_part
  from j)
select doc_id, size, source, source_size, target, cast(first_part + second_part as bigint) as taken,
  case when first_part > 0 then case {when("start")} end end as position,
  case when second_part > 0 then case {when("(source_size + start)")} end end as repeat_position
from o"""


_WARC_SQL = f"""
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    strftime(make_timestamp((1577836800 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured
  from pages),
m as (select *, case when payload_bytes >= {LEAST_REVISIT} then max(page_id) over (partition by payload_digest, payload_bytes) end as original from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, url, captured,
  case when original is not null and original <> page_id then 'revisit' else 'response' end as record_type,
  case when original <> page_id then original end as refers_to
from m"""

_SEARCH_SQL = """
with dt as (
  select row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as term
  from (select row_number() over () as row, doc_id, text from documents)),
it as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) as term
  from benchmark),
lengths as (select row, doc_id, count(*) as n from dt group by all),
totals as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as words from lengths),
tfs as (select row, term, count(*) as tf from dt where term in (select term from it) group by all),
weights as (select term, cast(floor(1000 * ln((2e0 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, totals group by term),
scores as (
  select item_id, row, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) as bigint) as score
  from it join tfs using (term) join weights using (term) join lengths using (row), totals
  group by item_id, row),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from scores join lengths using (row) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50"""

ORACLES: dict[str, str] = {"op11_ranked_search": _SEARCH_SQL, "op4_warc": _WARC_SQL, "op6_licenses": licenses.oracle_sql(), "op7_mixing": _mixing_sql()}
