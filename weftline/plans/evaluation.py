"""Resolution and evaluation queries over documents as entities; the truth is equality of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..operators import blocking, evaluate, resolve, sets
from ..sources import sinks, tables
from . import catalogue as c

FIRST, OTHER = resolve.FIRST, resolve.OTHER
QUERIES: dict = {}
ORACLES: dict = {}

TRUTH_SQL = """select 'S1-' || a.doc_id as source1_entity_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id as matched_entity_id
  from documents a join documents b on md5(a.text) = md5(b.text) where a.doc_id % 3 = 0 and b.doc_id % 3 <> 0"""
SPINE_SQL = "select 'S1-' || doc_id as source1_entity_id from documents where doc_id % 3 = 0"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("m"))
    a = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias(FIRST), "m")
    b = d.filter("doc_id % 3 <> 0").select(F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias(OTHER), "m")
    return a.join(b, "m").select(FIRST, OTHER)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sides(tables.entities(spark, sf_dir))[0].select(F.col("entity_id").alias(FIRST))


def _claims(spark, sf_dir) -> DataFrame:
    return c.claims(tables.entities(spark, sf_dir))


def _sql():
    return c.CLAIMS_SQL, c.RESOLVED_SQL


CLAIMS, RESOLVED = _sql()


@query(CLAIMS)
def merged_claims(spark, sf_dir):
    return _claims(spark, sf_dir)


@query(RESOLVED)
def injective_by_probability(spark, sf_dir):
    return resolve.injective_by_candidate(_claims(spark, sf_dir))


@query(RESOLVED)
def injective_by_rank(spark, sf_dir):
    return resolve.injective_by_rank(_claims(spark, sf_dir))


_SIM = "len(list_intersect(string_split(x.name, ' '), string_split(y.name, ' '))) + len(list_intersect(string_split(x.addr, ' '), string_split(y.addr, ' ')))"


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), k as ({CLAIMS}), j as (
  select k.*, {_SIM} as s from k join d x on k.{FIRST} = x.entity_id join d y on k.{OTHER} = y.entity_id),
  r as (select *, row_number() over (partition by {OTHER} order by s desc, {FIRST}) as r from j) select {FIRST}, {OTHER}, probability from r where r = 1""")
def injective_by_similarity(spark, sf_dir):
    """Conflicting claims go to the claimant that shares most name and address tokens."""
    e = derive.with_columns(tables.entities(spark, sf_dir), ("name", "addr")).select("entity_id", F.split("name", " ").alias("n"), F.split("addr", " ").alias("a"))
    k = _claims(spark, sf_dir).join(e.toDF(FIRST, "n1", "a1"), FIRST).join(e.toDF(OTHER, "n2", "a2"), OTHER)
    score = F.size(F.array_intersect("n1", "n2")) + F.size(F.array_intersect("a1", "a2"))
    return resolve.injective_by_similarity(k, score).select(FIRST, OTHER, "probability")


@query(f"""select {FIRST}, {OTHER}, max(probability) as probability from (select {FIRST}, {OTHER}, 0.9999::double as probability from ({blocking.oracle(c.CH['r3_address_name8'], c.DOCS)})
  union all select * from ({CLAIMS})) group by all""")
def baseline_precedence(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return resolve.with_baseline(blocking.pairs(e, c.CH["r3_address_name8"]), c.claims(e))


@query(f"""select {FIRST}, {OTHER}, probability from ({CLAIMS}) k where probability >= 0.9 and not exists (select 1 from ({blocking.oracle(c.CH['r3_address_name8'], c.DOCS)}) b where b.{FIRST} = k.{FIRST} and b.{OTHER} = k.{OTHER})""")
def missing_imports(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return resolve.missing_imports(c.claims(e), blocking.pairs(e, c.CH["r3_address_name8"]), 0.9)


@query(f"select {FIRST}, {OTHER}, probability from (select *, count(*) over (partition by {FIRST}) as n from ({RESOLVED})) where not (n = 1 and probability < 0.95)")
def singleton_shield(spark, sf_dir):
    return resolve.singleton_shield(resolve.injective_by_candidate(_claims(spark, sf_dir)))


_TWINS = f"""select x.entity_id as a, y.entity_id as b from d x join d y on x.name = y.name and x.addr = y.addr and x.country = y.country
  where x.entity_id < y.entity_id and x.name <> '' and x.addr <> '' and not starts_with(x.entity_id, 'S1-') and not starts_with(y.entity_id, 'S1-')"""


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), g as (select entity_id, min(entity_id) over w as class_id, count(*) over w as n from d
  where not starts_with(entity_id, 'S1-') and name <> '' and addr <> '' and country is not null window w as (partition by name, addr, country)) select entity_id, class_id from g where n > 1""")
def identical_records(spark, sf_dir):
    e = derive.with_columns(tables.entities(spark, sf_dir), ("name", "addr"))
    return resolve.identical_records(tables.sides(e)[1])


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), tw as ({_TWINS}), m as (select {FIRST}, {OTHER} from ({RESOLVED}))
  select * from m union select m.{FIRST}, tw.b from m join tw on m.{OTHER} = tw.a union select m.{FIRST}, tw.a from m join tw on m.{OTHER} = tw.b""")
def one_hop_closure(spark, sf_dir):
    return resolve.one_hop_closure(resolve.injective_by_candidate(_claims(spark, sf_dir)), identical_records(spark, sf_dir))


@query(f"select {FIRST}, {OTHER} from ({blocking.oracle(c.CH['b03_first_token_rare'], c.DOCS)}) union select {FIRST}, {OTHER} from ({blocking.oracle(c.CH['r2_name_address8'], c.DOCS)})")
def ensure_subset(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return resolve.ensure_subset(blocking.pairs(e, c.CH["r2_name_address8"]), blocking.pairs(e, c.CH["b03_first_token_rare"]))


@query(f"select {FIRST}, {OTHER} from ({blocking.oracle(c.CH['r4_address_name3'], c.DOCS)}) except select {FIRST}, {OTHER} from ({blocking.oracle(c.CH['r3_address_name8'], c.DOCS)})")
def new_pairs(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return resolve.delta(blocking.pairs(e, c.CH["r4_address_name3"]), blocking.pairs(e, c.CH["r3_address_name8"]))


_UNION = [f"b{i:02d}_" for i in range(1, 10)]
_BLOCKS = [n for n in c.CH if any(n.startswith(p) for p in _UNION)]


@query(" union ".join(f"select {FIRST}, {OTHER} from ({blocking.oracle(c.CH[n], c.DOCS)})" for n in _BLOCKS))
def union_of_blocks(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return blocking.union(e, c.CH[_BLOCKS[0]], [c.CH[n] for n in _BLOCKS[1:]])


#: Frequency blocks that a later generation adds to the first nine.
_FREQUENT = ("b16_country_name3_freq10", "b16_country_first_freq10", "b16_country_name4_freq10", "b16_house_address5_freq10")


@query(" union ".join(f"select {FIRST}, {OTHER} from ({blocking.oracle(c.CH[n], tables.DUCK_ENTITIES['parts'])})" for n in _FREQUENT))
def union_of_frequency_blocks(spark, sf_dir):
    e = tables.entities(spark, sf_dir, "parts")
    return sets.union_distinct([blocking.pairs(e, c.CH[n]).select(FIRST, OTHER) for n in _FREQUENT])


@query(f"select count(*) as pairs, count(distinct {FIRST}) as first_entities, count(distinct {OTHER}) as other_entities from (select distinct {FIRST}, {OTHER} from ({CLAIMS}))")
def distinct_pair_count(spark, sf_dir):
    return _claims(spark, sf_dir).select(FIRST, OTHER).distinct().agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(FIRST).alias("first_entities"), F.countDistinct(OTHER).alias("other_entities"))


@query(f"""with a as (select k0, co, count(distinct id) as n from ({blocking._keyed_sql(c.CH['b20_containment'], True)}) group by all),
  b as (select k0, co, count(distinct id) as n from ({blocking._keyed_sql(c.CH['b20_containment'], False)}) group by all)
  select sum(a.n * b.n)::bigint as candidates, count(*) as shared_keys from a join b using (k0, co)""".replace("from d where", f"from ({derive.duck_select(f'({c.DOCS})')}) where"))
def candidate_volume(spark, sf_dir):
    return blocking.volume(tables.entities(spark, sf_dir), c.CH["b20_containment"])


def _hits_sql(p: str) -> str:
    return f"(select count(*) from ({p})) as predicted, (select count(*) from (select distinct * from ({TRUTH_SQL}))) as actual, (select count(*) from (select {FIRST}, {OTHER} from ({p}) intersect ({TRUTH_SQL}))) as correct"


@query(f"select actual, correct, predicted, correct / actual as recall from (select {_hits_sql(CLAIMS)})")
def blocking_recall(spark, sf_dir):
    return evaluate.blocking_recall(_claims(spark, sf_dir), truth(spark, sf_dir))


@query(f"select predicted, actual, correct, 1.25 * correct / (0.25 * actual + predicted) as f from (select {_hits_sql(RESOLVED)})")
def micro_f(spark, sf_dir):
    return evaluate.micro(injective_by_probability(spark, sf_dir), truth(spark, sf_dir))


def _each_sql(p: str) -> str:
    return f"""t as (select distinct * from ({TRUTH_SQL})), p as (select distinct {FIRST}, {OTHER} from ({p})), s as ({SPINE_SQL}),
      n as (select s.{FIRST}, (select count(*) from p where p.{FIRST} = s.{FIRST}) as predicted, (select count(*) from t where t.{FIRST} = s.{FIRST}) as actual,
        (select count(*) from p join t using ({FIRST}, {OTHER}) where p.{FIRST} = s.{FIRST}) as tp from s)"""


_F = "case when predicted = 0 and actual = 0 then 1.0 when tp = 0 then 0.0 else 1.25 * tp / (0.25 * actual + predicted) end"


@query(f"with {_each_sql(RESOLVED)} select count(*) as entities, sum(tp)::bigint as tp, avg({_F})::double as macro_f from n")
def macro_f_all(spark, sf_dir):
    return evaluate.macro(injective_by_probability(spark, sf_dir), truth(spark, sf_dir), spine(spark, sf_dir))


@query(f"with {_each_sql(RESOLVED)} select count(*) as entities, sum(tp)::bigint as tp, avg({_F})::double as macro_f from n where predicted + actual > 0")
def macro_f_observed(spark, sf_dir):
    return evaluate.macro(injective_by_probability(spark, sf_dir), truth(spark, sf_dir))


@query(f"with {_each_sql(CLAIMS)} select count(*) as entities, count(*) filter (where tp > 0) as any_found, count(*) filter (where tp = actual) as all_found from n where actual > 0")
def entity_coverage(spark, sf_dir):
    return evaluate.coverage(_claims(spark, sf_dir), truth(spark, sf_dir))


_RULES = ("r1_name_address", "r2_name_address8", "r3_address_name8", "r4_address_name3", "r5_name_address4", "r6_address_initial")


@query(f"""with t as (select distinct * from ({TRUTH_SQL})), r as ({" union all ".join(f"select '{n}' as rule, {FIRST}, {OTHER} from ({blocking.oracle(c.CH[n], c.DOCS)})" for n in _RULES)})
  select rule, count(*) as predictions, count(t.{FIRST}) as hits, count(t.{FIRST}) / count(*) as purity from r left join t using ({FIRST}, {OTHER}) group by 1""")
def rule_purity(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    rules = [blocking.pairs(e, c.CH[n]).select(F.lit(n).alias("rule"), FIRST, OTHER) for n in _RULES]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return evaluate.purity(out, truth(spark, sf_dir))


@query(f"""with t as (select distinct * from ({TRUTH_SQL}) except select {FIRST}, {OTHER} from ({blocking.oracle(c.CH['r1_name_address'], c.DOCS)})), p as ({blocking.oracle(c.CH['b01_exact_name'], c.DOCS)})
  select (select count(*) from p) as candidates, (select count(*) from t) as missed, (select count(*) from p join t using ({FIRST}, {OTHER})) as recovered,
  (select count(*) from p join t using ({FIRST}, {OTHER})) / (select count(*) from p) as efficiency""")
def channel_efficiency(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return evaluate.channel_efficiency(blocking.pairs(e, c.CH["b01_exact_name"]), blocking.pairs(e, c.CH["r1_name_address"]), truth(spark, sf_dir))


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), t as (select distinct * from ({TRUTH_SQL})), j as (select x.name as n1, y.name as n2, x.addr as a1, y.addr as a2, x.house as h1, y.house as h2
  from t join d x on t.{FIRST} = x.entity_id join d y on t.{OTHER} = y.entity_id)
  select count(*) as pairs, count(*) filter (where n1 = n2) as same_name, count(*) filter (where a1 = a2) as same_address, count(*) filter (where substring(n1, 1, 4) = substring(n2, 1, 4)) as name_prefix4,
  count(*) filter (where h1 = h2 and h1 <> '') as same_house, count(*) filter (where abs(length(n1) - length(n2)) <= 2) as close_length from j""")
def signal_profile(spark, sf_dir):
    e = derive.with_columns(tables.entities(spark, sf_dir), ("name", "addr", "house")).select("entity_id", "name", "addr", "house")
    j = truth(spark, sf_dir).join(e.toDF(FIRST, "n1", "a1", "h1"), FIRST).join(e.toDF(OTHER, "n2", "a2", "h2"), OTHER)
    n1, n2 = F.col("n1"), F.col("n2")
    return evaluate.signal_profile(j, {
        "same_name": n1 == n2, "same_address": F.col("a1") == F.col("a2"), "name_prefix4": F.substring(n1, 1, 4) == F.substring(n2, 1, 4),
        "same_house": (F.col("h1") == F.col("h2")) & (F.col("h1") != ""), "close_length": F.abs(F.char_length(n1) - F.char_length(n2)) <= 2,
    })


_GRID = (0.4, 0.9, 0.9992, 0.9999)


@query(" union all ".join(f"select {g}::double as threshold, (with {_each_sql(f'select * from ({RESOLVED}) where probability >= {g}')} select avg({_F})::double from n) as macro_f" for g in _GRID))
def threshold_grid(spark, sf_dir):
    return evaluate.threshold_grid(injective_by_probability(spark, sf_dir), truth(spark, sf_dir), spine(spark, sf_dir), list(_GRID))


_SOURCE_GRID = (0.4, 0.9, 0.9992)


@query(" union all ".join(f"""select {a}::double as s2_threshold, {b}::double as s3_threshold, (with {_each_sql(f"select * from ({RESOLVED}) where probability >= case when starts_with({OTHER}, 'S2-') then {a} else {b} end")}
  select avg({_F})::double from n) as macro_f""" for a in _SOURCE_GRID for b in _SOURCE_GRID))
def source_threshold_grid(spark, sf_dir):
    """Macro F for each pair of thresholds of the second and the third source."""
    return evaluate.source_threshold_grid(injective_by_probability(spark, sf_dir), truth(spark, sf_dir), spine(spark, sf_dir), list(_SOURCE_GRID))


@query("select * from (values ('missing_rows', 0::bigint), ('unknown_rows', 0), ('repeated_entities', 0), ('repeated_ids', 0), ('unknown_ids', 0), ('shared_candidates', 0)) v(\"check\", n)")
def validated_results(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    first, others = tables.sides(e)
    lists = sinks.result_lists(first, resolve.injective_by_candidate(c.claims(e)))
    return evaluate.validation(lists, first.select(F.col("entity_id").alias(FIRST)), others.select(F.col("entity_id").alias(OTHER)))


def _frequency_sql(n: str) -> str:
    d = f"({derive.duck_select(f'({c.DOCS})')})"
    side = lambda first, name: f"select k0, count(distinct id) as {name} from ({blocking._keyed_sql(c.CH[n], first)}) group by 1".replace("from d where", f"from {d} where")
    return f"select '{n}' as channel, k0, coalesce(n1, 0) as n1, coalesce(n23, 0) as n23 from ({side(True, 'n1')}) full join ({side(False, 'n23')}) using (k0)"


_TOKENS = ("b03_first_token_rare", "b06_second_token_rare", "b08_last_token_rare")


@query(" union all ".join(map(_frequency_sql, _TOKENS)))
def token_frequencies(spark, sf_dir):
    """How often first, second and last name tokens occur on either side."""
    e, out = tables.entities(spark, sf_dir), None
    for n in _TOKENS:
        rows = blocking.key_frequencies(e, c.CH[n]).select(F.lit(n).alias("channel"), "k0", "n1", "n23")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with u as ({" union all ".join(f"select '{n}' as channel, {FIRST}, {OTHER} from ({blocking.oracle(c.CH[n], c.DOCS)})" for n in _BLOCKS)}),
  k as (select *, count(*) over (partition by {FIRST}, {OTHER}) as n from u) select channel, count(*) as pairs, count(*) filter (where n = 1) as only_here from k group by 1""")
def block_overlap(spark, sf_dir):
    return blocking.overlap(tables.entities(spark, sf_dir), [c.CH[n] for n in _BLOCKS])


_HOUSE = "b13_house_first_token"


@query(f"""with d as ({derive.duck_select(f'({c.PARTS})')}), a as (select k0, k1, count(distinct id) as n from ({blocking._keyed_sql(c.CH[_HOUSE], True)}) group by all),
  b as (select k0, k1, count(distinct id) as n from ({blocking._keyed_sql(c.CH[_HOUSE], False)}) group by all)
  select coalesce(sum(a.n * b.n), 0)::bigint as candidates, count(*) as shared_keys from a join b using (k0, k1)""")
def house_candidate_volume(spark, sf_dir):
    return blocking.volume(tables.entities(spark, sf_dir, "parts"), c.CH[_HOUSE])
