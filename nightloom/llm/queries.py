"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightloom.llm.abuse import rates, score_documents
from nightloom.llm.bpe import encode_corpus
from nightloom.llm.components import groups
from nightloom.llm.leaks import find_leaks
from nightloom.llm.linkage import link
from nightloom.llm.near_duplicates import near_duplicates
from nightloom.llm.places import map_places
from nightloom.llm.survivors import consensus_survivors, survivors
from nightloom.session import table

TRUST = {"time_raw": "time_trust", "coordinate_source": "coord_trust", "shape_normalized": "shape_trust"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_places(table(spark, sf_dir, "canonical_input"), table(spark, sf_dir, "place_ref"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*(table(spark, sf_dir, n) for n in ("compact_record", "compact_partner", "place_ref", "match_pair")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).selectExpr("least(record_id, partner_id) as left_id", "greatest(record_id, partner_id) as right_id")


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("record_id", "partner_id", "rule", "confidence", "same", "different")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "compact_record"), table(spark, sf_dir, "match_pair"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "candidate_feature").selectExpr("canonical_input_id as id", "source_text_key as text")
    compact = table(spark, sf_dir, "compact_record").selectExpr("input_id as id", "coalesce(nullif(trim(text_normalized), ''), summary) as text")
    return near_duplicates(features.union(compact))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "event_provenance"), table(spark, sf_dir, "canonical_input"), table(spark, sf_dir, "source_registry"), TRUST)


def p7_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records of each event agree on, token by token, whether or not the best-ranked one says so."""
    tables = [table(spark, sf_dir, n) for n in ("event_provenance", "canonical_input", "source_registry")]
    ranked = survivors(*tables, TRUST).withColumnRenamed("canonical_input_id", "ranked_id")
    return consensus_survivors(*tables, TRUST).join(ranked, ["event_id", "field_name"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_scored(spark, sf_dir))


P3_SQL = r"""
with recursive rec as (
  select input_id, nullif(lower(trim(input_id)), '') as node, nullif(lower(trim(event_id)), '') as event from compact_record
), heads as (
  select event, min(node) as head from rec where event is not null group by event
), links as (
  select node as u, head as v from rec join heads using (event) where node <> head
  union
  select nullif(lower(trim(left_input_id)), ''), nullif(lower(trim(right_input_id)), '') from match_pair where lower(trim(verdict)) = 'same'
), ways as (
  select u, v from links where u is not null and v is not null and u <> v
  union
  select v, u from links where u is not null and v is not null and u <> v
), reach(node, other) as (
  select node, node from rec where node in (select u from ways)
  union
  select reach.node, ways.v from reach join ways on ways.u = reach.other
), least as (
  select reach.node, min(rec.input_id) as group_id, count(*) as members from reach join rec on rec.node = reach.other group by reach.node
)
select rec.input_id, least.group_id from rec join least using (node) where least.members > 1
"""

P5_SQL = """
with texts as (
  select canonical_input_id as id, source_text_key as text from candidate_feature
  union all
  select input_id, coalesce(nullif(trim(text_normalized), ''), summary) from compact_record
), words as (
  select id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from texts where id is not null and text is not null
), bags as (
  select id, word, count(*) as n, sum(count(*)) over (partition by id) as total from words group by id, word
), fit as (
  select * from bags where total >= 20
), shared as (
  select a.id as left_id, b.id as right_id, any_value(a.total) as l, any_value(b.total) as r, sum(least(a.n, b.n)) as common
  from fit a join fit b on a.word = b.word and a.id < b.id and b.total >= 0.7 * a.total and a.total >= 0.7 * b.total group by 1, 2
)
select left_id, right_id from shared where common >= 0.7 * (l + r - common) - 1e-9
"""

P7_SQL = """
with ci as (
  select canonical_input_id as id, max(ingested_at) as late, any_value(source_name) as source_name,
         any_value(time_raw) as time_raw, any_value(coordinate_source) as coordinate_source, any_value(shape_normalized) as shape_normalized
  from canonical_input group by canonical_input_id
), link as (
  select distinct trim(event_id) as event_id, trim(canonical_input_id) as id from event_provenance where trim(event_id) <> '' and trim(canonical_input_id) <> ''
), many as (select event_id from link group by event_id having count(*) > 1
), long as (
  select event_id, id, late, field_name, value, trust from (
    select event_id, id, late, 'time_raw' as field_name, time_raw as value, time_trust as trust from link join ci using (id) left join source_registry using (source_name)
    union all
    select event_id, id, late, 'coordinate_source', coordinate_source, coord_trust from link join ci using (id) left join source_registry using (source_name)
    union all
    select event_id, id, late, 'shape_normalized', shape_normalized, shape_trust from link join ci using (id) left join source_registry using (source_name)
  ) where event_id in (select event_id from many)
    and value is not null and lower(trim(value)) not in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '-', 'unresolved', 'not_provided')
)
select event_id, field_name, id as canonical_input_id from (
  select *, row_number() over (partition by event_id, field_name order by trust nulls last, late desc nulls last, id) as k from long
) where k = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_confidence": p2_confidence,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_consensus": p7_consensus,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
SQL: dict[str, str] = {"p3_found": P3_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL}
