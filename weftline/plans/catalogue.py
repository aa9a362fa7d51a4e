"""Registered queries of the linkage engine and the SQL each must equal."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..operators import blocking, channels, resolve
from ..sources import sinks, tables
from . import channel_sql

FIRST, OTHER, P = resolve.FIRST, resolve.OTHER, resolve.P
DOCS, PARTS = tables.DUCK_ENTITIES["documents"], tables.DUCK_ENTITIES["parts"]
CH = channels.by_name()


def _rule_union_sql(*names: str) -> str:
    return " union all ".join(f"select {FIRST}, {OTHER}, probability from ({blocking.oracle(CH[n], DOCS)})" for n in names)


#: Source-1 entities that the exact rules have matched, for channels that only serve the rest.
MATCHED = ("r1_name_address", "r3_address_name8")


def matched(entities: DataFrame) -> DataFrame:
    out = blocking.pairs(entities, CH[MATCHED[0]]).select(FIRST)
    for n in MATCHED[1:]:
        out = out.unionByName(blocking.pairs(entities, CH[n]).select(FIRST))
    return out.distinct()


def _matched_sql(kind: str) -> str:
    return " union ".join(f"select {FIRST} from ({blocking.oracle(CH[n], tables.DUCK_ENTITIES[kind])})" for n in MATCHED)


def claims(entities: DataFrame) -> DataFrame:
    """Rules one and two and the rare first token (at .5), best probability per pair."""
    rare = blocking.pairs(entities, CH["b03_first_token_rare"]).withColumn(P, F.lit(0.5))
    return resolve.merge_claims([blocking.pairs(entities, CH["r1_name_address"]), blocking.pairs(entities, CH["r2_name_address8"]), rare])


CLAIMS_SQL = f"""select {FIRST}, {OTHER}, max(probability) as probability from (
  {_rule_union_sql("r1_name_address", "r2_name_address8")}
  union all select {FIRST}, {OTHER}, 0.5::double from ({blocking.oracle(CH["b03_first_token_rare"], DOCS)})) group by all"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve documents: rules and rare tokens -> best claim -> injective -> one list per source-1 entity."""
    entities = tables.entities(spark, sf_dir)
    first, _ = tables.sides(entities)
    return sinks.result_lists(first, resolve.injective_by_candidate(claims(entities)))


RESOLVED_SQL = f"""select {FIRST}, {OTHER}, probability from (
  select *, row_number() over (partition by {OTHER} order by probability desc, {FIRST}) as r from ({CLAIMS_SQL})) where r = 1"""
FLAGSHIP_SQL = f"""select e.entity_id as {FIRST}, coalesce(l.ids, '') as matched_entity_ids
  from ({DOCS}) e left join (
    select {FIRST}, string_agg({OTHER}, ',' order by probability desc, {OTHER}) as ids from ({RESOLVED_SQL}) group by 1) l
  on e.entity_id = l.{FIRST} where starts_with(e.entity_id, 'S1-')"""


def _group_of(name: str) -> str:
    return name.split("_")[0].rstrip("abcde") if name[0] == "b" else name.split("_")[0]


def _channel_query(group: list[blocking.Channel]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for ch in group:
            e = tables.entities(spark, sf_dir, ch.entities)
            rows = blocking.pairs(e, ch, matched(e) if ch.unmatched else None)
            prob = F.col(P) if P in rows.columns else F.lit(None).cast("double").alias(P)
            rows = rows.select(F.lit(ch.name).alias("channel"), FIRST, OTHER, prob)
            out = rows if out is None else out.unionByName(rows)
        return out

    return run


def _channel_sql(group: list[blocking.Channel]) -> str:
    def one(ch: blocking.Channel) -> str:
        done = _matched_sql(ch.entities) if ch.unmatched else None
        if ch.name in channel_sql.BY_HAND:
            body = channel_sql.BY_HAND[ch.name](tables.DUCK_ENTITIES[ch.entities], done)
        else:
            body = blocking.oracle(ch, tables.DUCK_ENTITIES[ch.entities], done)
        stated = ch.name in channel_sql.BY_HAND or ch.prob is not None or ch.prob_by_shared
        return f"select '{ch.name}' as channel, {FIRST}, {OTHER}, {P if stated else f'null::double as {P}'} from ({body})"

    return " union all ".join(map(one, group))


GROUPS = {k: list(g) for k, g in groupby(sorted(CH.values(), key=lambda c: _group_of(c.name)), key=lambda c: _group_of(c.name))}


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("name", "addr", "name_a", "addr_q", "stripped", "house", "postal", "letters")
    both = tables.entities(spark, sf_dir).unionByName(tables.entities(spark, sf_dir, "parts"))
    return derive.with_columns(both, cols).select("entity_id", "country", *cols)


NORMALIZED_SQL = f"select entity_id, country, name, addr, name_a, addr_q, stripped, house, postal, letters from ({derive.duck_select(f'({DOCS} union all {PARTS})')})"


def queries() -> dict:
    from . import evaluation, relational, scoring

    out = {"resolve_documents": flagship, "normalize_entities": _normalized}
    out |= {f"channel_{k}": _channel_query(g) for k, g in GROUPS.items()}
    for m in (relational, evaluation, scoring):
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    from . import evaluation, relational, scoring

    out = {"resolve_documents": FLAGSHIP_SQL, "normalize_entities": NORMALIZED_SQL}
    out |= {f"channel_{k}": _channel_sql(g) for k, g in GROUPS.items()}
    for m in (relational, evaluation, scoring):
        out |= m.ORACLES
    return out
