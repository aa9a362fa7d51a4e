"""Feature, scoring, gate and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive, features, normalize
from ..functions import similarity as sim
from ..operators import blocking, gates, resolve, sampling, scoring, tfidf
from ..sources import tables
from . import catalogue as c
from . import evaluation as ev

FIRST, OTHER = resolve.FIRST, resolve.OTHER
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Pairs whose features are computed: a rare shared token or an exact name.
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derive.with_columns(tables.entities(spark, sf_dir), ("name", "addr", "house", "postal"))
    pairs = blocking.pairs(tables.entities(spark, sf_dir), c.CH["b09_informative_token"])
    return features.attached(pairs, e)


_PAIRS_SQL = f"""select k.{FIRST}, k.{OTHER}, x.name as n1, y.name as n2, x.addr as a1, y.addr as a2, x.house as h1, y.house as h2, x.postal as z1, y.postal as z2, coalesce(x.country, '') as c1, coalesce(y.country, '') as c2
  from ({blocking.oracle(c.CH['b09_informative_token'], c.DOCS)}) k join d x on k.{FIRST} = x.entity_id join d y on k.{OTHER} = y.entity_id"""


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else {both}::double / (len({a}) + len({b}) - {both}) end"


def _dice(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"


def _grams(x: str, n: int) -> str:
    q = f"replace({x}, ' ', '')"
    return f"case when length({x}) >= {n} and length({q}) >= {n} then list_distinct(list_transform(range(1, length({q}) - {n} + 2), lambda i: substring({q}, i, {n}))) else []::varchar[] end"


def _acronym(a: str, b: str) -> str:
    ini = lambda x: f"case when len(list_filter(string_split({x}, ' '), lambda w: w <> '')) >= 2 then array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: substring(w, 1, 1)), '') end"
    return f"(coalesce({ini(a)} = {b}, false) or coalesce({ini(b)} = {a}, false))::int"


_FLAG = {
    "name_exact": "n1 = n2 and n1 <> ''", "name_contains": "n1 <> '' and n2 <> '' and (contains(n2, n1) or contains(n1, n2))",
    "name_prefix3": "n1[1:3] = n2[1:3] and length(n1) >= 3 and length(n2) >= 3", "name_prefix5": "n1[1:5] = n2[1:5] and length(n1) >= 5 and length(n2) >= 5",
    "name_suffix4": "right(n1, 4) = right(n2, 4) and length(n1) >= 4 and length(n2) >= 4", "name_first_token_match": "coalesce(w1[1] = w2[1], false)", "name_last_token_match": "coalesce(w1[-1] = w2[-1], false)",
    "address_exact": "a1 = a2 and a1 <> ''", "address_contains": "a1 <> '' and a2 <> '' and (contains(a2, a1) or contains(a1, a2))",
    "address_prefix5": "a1[1:5] = a2[1:5] and length(a1) >= 5 and length(a2) >= 5", "address_prefix8": "a1[1:8] = a2[1:8] and length(a1) >= 8 and length(a2) >= 8",
    "address_suffix8": "right(a1, 8) = right(a2, 8) and length(a1) >= 8 and length(a2) >= 8", "house_match": "h1 <> '' and h1 = h2", "postal_exact": "z1 <> '' and z1 = z2",
    "postal_prefix3": "z1[1:3] = z2[1:3] and length(z1) >= 3 and length(z2) >= 3", "country_match": "c1 <> '' and c1 = c2", "country_missing": "c1 = '' or c2 = ''",
    "source2": f"starts_with({OTHER}, 'S2-')", "source3": f"starts_with({OTHER}, 'S3-')",
}
_VALUE = {
    "name_shared_token_count": "len(list_intersect(w1, w2))::int", "name_token_jaccard": _jac("u1", "u2"), "name_token_dice": _dice("u1", "u2"),
    "name_char3_jaccard": _jac("g31", "g32"), "name_char4_jaccard": _jac("g41", "g42"), "name_acronym_match": _acronym("n1", "n2"), "name_len_diff": "abs(length(n1) - length(n2))::int",
    "name_len_rel_diff": "abs(length(n1) - length(n2))::double / greatest(length(n1), 1)", "address_char3_jaccard": _jac("b31", "b32"), "address_char4_jaccard": _jac("b41", "b42"),
    "address_token_jaccard": _jac("t1", "t2"), "address_numeric_overlap": _jac("m1", "m2"), "address_len_diff": "abs(length(a1) - length(a2))::int", "address_len_rel_diff": "abs(length(a1) - length(a2))::double / greatest(length(a1), 1)",
}
NATIVE = [*_FLAG, *_VALUE]


def _features_sql() -> str:
    tok = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    lists = {"w1": tok("n1"), "w2": tok("n2"), "u1": f"list_distinct({tok('n1')})", "u2": f"list_distinct({tok('n2')})", "t1": f"list_distinct({tok('a1')})", "t2": f"list_distinct({tok('a2')})"}
    lists |= {f"m{k}": f"list_filter(list_distinct({tok(f'a{k}')}), lambda w: regexp_matches(w, '[0-9]'))" for k in (1, 2)}
    lists |= {f"{p}{n}{k}": _grams(f"{s}{k}", n) for p, s in (("g", "n"), ("b", "a")) for n in (3, 4) for k in (1, 2)}
    cols = [f"({x})::int as {n}" for n, x in _FLAG.items()] + [f"round(({x})::double, 9) as {n}" for n, x in _VALUE.items()]
    return f"""with d as ({derive.duck_select(f'({c.DOCS})')}), p as ({_PAIRS_SQL}), l as (select *, {', '.join(f'{x} as {n}' for n, x in lists.items())} from p)
      select {FIRST}, {OTHER}, {', '.join(cols)} from l"""


@query(_features_sql())
def native_features(spark, sf_dir) -> DataFrame:
    out = features.native(_pairs(spark, sf_dir))
    return out.select(FIRST, OTHER, *_FLAG, *[F.round(F.col(n).cast("double"), 9).alias(n) for n in _VALUE])


@query()
def all_features(spark, sf_dir) -> DataFrame:
    return features.extract(_pairs(spark, sf_dir)).drop(*[f"{s}{k}" for s in features.SIDES for k in (1, 2)])


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), p as ({_PAIRS_SQL}), l as (select *, list_filter(list_distinct(list_filter(string_split(a1, ' '), lambda w: w <> '')), lambda w: regexp_matches(w, '[0-9]')) as m1,
  list_filter(list_distinct(list_filter(string_split(a2, ' '), lambda w: w <> '')), lambda w: regexp_matches(w, '[0-9]')) as m2 from p)
  select {FIRST}, {OTHER}, {_jac('m1', 'm2')} as both_empty_one, case when len(m1) = 0 then 0.0 else len(list_intersect(m1, m2))::double / len(m1) end as over_first, len(list_intersect(m1, m2))::double as "count",
  case when len(m1) = 0 or len(m2) = 0 then 0.0 else {_jac('m1', 'm2')} end as either_empty_zero from l""")
def number_overlap_profiles(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select(FIRST, OTHER, *[features.numeric_overlap(F.col("addr1"), F.col("addr2"), k).alias(k) for k in ("both_empty_one", "over_first", "count", "either_empty_zero")])


@query()
def full_normalizer(spark, sf_dir) -> DataFrame:
    """The long normaliser profile with its structured address fields."""
    e = tables.entities(spark, sf_dir).unionByName(tables.entities(spark, sf_dir, "parts"))
    e = e.select("entity_id", normalize.business_name(F.col("business_name")).alias("name"), normalize.business_address(F.col("business_address"), F.col("country")).alias("address"))
    return e.withColumns({"house": normalize.house_number(F.col("address")), "postal": normalize.postal_code(F.col("address"))} | {k: v for k, v in normalize.house_variants(F.col("address")).items()})


@query(tfidf.duck(derive.duck_select(f"({c.DOCS})")))
def channel_b79_tfidf(spark, sf_dir) -> DataFrame:
    e = derive.with_columns(tables.entities(spark, sf_dir), ("name",)).select("entity_id", "country", "name")
    return tfidf.similar(e).withColumn("cosine", F.round("cosine", 6))


def _scored(spark, sf_dir) -> DataFrame:
    """Native features with stand-in alignments and a probability from a hash, so that gates have an exact oracle."""
    f = features.native(_pairs(spark, sf_dir))
    u = F.conv(F.substring(F.md5(F.concat(FIRST, F.lit("|"), OTHER)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return f.withColumns({"name_ratio": F.col("name_char3_jaccard"), "address_ratio": F.col("address_char3_jaccard"), "probability": F.sqrt(F.sqrt(F.lit(1.0) - u * F.lit(0.3)))})


_SCORED_SQL = f"""select *, name_char3_jaccard as name_ratio, address_char3_jaccard as address_ratio, sqrt(sqrt(1.0 - ('0x' || substr(md5({FIRST} || '|' || {OTHER}), 1, 8))::bigint::double / 4294967296 * 0.3)) as probability from ({_features_sql()})"""
_P, _N, _A = "probability", "name_ratio", "address_ratio"
_GATES = {
    "base": f"{_P} >= 0.972 and ({_N} >= 0.2 or {_A} >= 0.4 or house_match = 1)",
    "rescue_one": f"{_P} >= 0.9 and (({_N} >= 0.6 and {_A} >= 0.6) or ({_N} >= 0.9 and house_match = 1) or {_A} >= 0.95)",
    "colocation_guard": f"{_N} >= 0.4",
    "containment_rescue": f"{_P} >= 0.95 and name_contains = 1 and {_A} >= 0.65",
    "acronym_rescue": f"{_P} >= 0.9 and name_acronym_match = 1 and {_A} >= 0.4",
    "rescue_two": f"{_P} >= 0.8 and {_N} >= 0.9 and {_A} >= 0.85",
    "anti_merge": f"{_N} >= 0.4 or name_acronym_match = 1 or {_P} >= 0.998",
    "anti_merge_by_address": f"{_N} >= 0.8 or ({_N} >= 0.4 and {_A} >= 0.5) or name_acronym_match = 1",
}
_GATES |= {f"branch_disambiguation_{t}": f"not ({_N} >= 0.85 and {_A} < 0.{t})" for t in (30, 40, 50)}
_GATES["final"] = f"((({_GATES['base']}) or ({_GATES['rescue_one']})) and ({_GATES['colocation_guard']})) or ({_GATES['containment_rescue']}) or ({_GATES['acronym_rescue']})"


@query("with t as (select distinct * from (" + ev.TRUTH_SQL + f")), s as (select s.*, t.{FIRST} is not null as hit from ({_SCORED_SQL}) s left join t using ({FIRST}, {OTHER})) " + " union all ".join(f"select '{n}' as gate, count(*) filter (where {g}) as pairs, count(*) filter (where hit and ({g})) as correct from s" for n, g in _GATES.items()))
def gate_volumes(spark, sf_dir) -> DataFrame:
    return gates.volumes(_scored(spark, sf_dir), ev.truth(spark, sf_dir))


@query(f"with s as ({_SCORED_SQL}) " + " union all ".join(
    f"select {p}::double as p, {n}::double as n, count(*) filter (where {_P} >= {p} and ({_N} >= {n} or (name_token_jaccard >= 0.7 and {_A} >= 0.4) or (name_first_token_match = 1 and {_N} >= 0.15 and {_A} >= 0.4)) and ({_A} >= 0.35 or house_match = 1)) as pairs from s"
    for p in (0.9, 0.95, 0.98) for n in (0.2, 0.4, 0.6)))
def gate_grid(spark, sf_dir) -> DataFrame:
    return gates.grid(_scored(spark, sf_dir), [0.9, 0.95, 0.98], [0.2, 0.4, 0.6])


@query(f"with s as ({_SCORED_SQL}) select {FIRST}, {OTHER} from s where {_GATES['final']}")
def gated_pairs(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).filter(gates.final()).select(FIRST, OTHER)


@query(f"with s as ({_SCORED_SQL}) select " + ", ".join(f"count(*) filter (where {x}) as {n}" for n, x in {
    "name85_postal_country": f"{_N} >= 0.85 and postal_exact = 1 and country_match = 1", "exact_name_postal": "name_exact = 1 and postal_exact = 1", "name80_house_postal": f"{_N} >= 0.8 and house_match = 1 and postal_exact = 1",
    "acronym_address70": f"name_acronym_match = 1 and {_A} >= 0.7", "contained_address90_p85": f"name_contains = 1 and {_A} >= 0.9 and {_P} >= 0.85", "name95_address70_p80": f"{_N} >= 0.95 and {_A} >= 0.7 and {_P} >= 0.8",
    "name90_address85_p80": _GATES["rescue_two"], "exact_address_house_name75": f"address_exact = 1 and house_match = 1 and {_N} >= 0.75", "p92_name70_address70": f"{_P} >= 0.92 and {_N} >= 0.7 and {_A} >= 0.7",
    "p88_name80_address80": f"{_P} >= 0.88 and {_N} >= 0.8 and {_A} >= 0.8"}.items()) + " from s")
def rescue_volumes(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).agg(*[F.count_if(g).alias(n) for n, g in gates.rescues().items()])


_CROSSED = {
    "name_address_ratio_mean": f"({_N} + {_A}) / 2", "name_address_ratio_product": f"{_N} * {_A}", "name_address_harmonic": f"2 * {_N} * {_A} / ({_N} + {_A} + 1e-6)",
    "name_postal_cross": f"{_N} * postal_exact", "name_house_cross": f"{_N} * house_match", "strong_name_address": f"({_N} >= 0.9 and {_A} >= 0.7)::int",
    "strong_name_house": f"({_N} >= 0.9 and house_match = 1)::int", "strong_name_postal": f"({_N} >= 0.9 and postal_exact = 1)::int",
    "name_gate_40": f"({_N} >= 0.4 or name_token_jaccard >= 0.35 or name_acronym_match = 1)::int", "name_gate_60": f"({_N} >= 0.6 or name_token_jaccard >= 0.5)::int",
    "addr_gate_50": f"({_A} >= 0.5 or house_match = 1 or postal_exact = 1)::int",
}


@query(f"with s as ({_SCORED_SQL}) select {FIRST}, {OTHER}, " + ", ".join(f"floor(({x})::double * 1e6 + 3e-5)::bigint as {n}" for n, x in _CROSSED.items()) + " from s")
def crossed_features(spark, sf_dir) -> DataFrame:
    """The eleven crossed features in millionths, on the stand-in alignments; the shift keeps decimal ties off the edges."""
    alike = _scored(spark, sf_dir).withColumns({n: F.round(F.col(n), 9) for n in (_N, _A)})
    return features.crossed(alike).select(FIRST, OTHER, *[F.floor(F.col(n) * 1e6 + 3e-5).cast("long").alias(n) for n in _CROSSED])


_BLEND = {"even": 0.5, "leaning": 0.6}


@query(f"with s as ({_SCORED_SQL}) select {FIRST}, {OTHER}, " + ", ".join(f"floor(({_P} * {w} + {_N} * (1 - {w})) * 1e6 + 3e-5)::bigint as {n}" for n, w in _BLEND.items()) + " from s")
def blended_scores(spark, sf_dir) -> DataFrame:
    """Two scores blended evenly and six to four, in millionths."""
    s = _scored(spark, sf_dir).withColumn(_N, F.round(F.col(_N), 9))
    return s.select(FIRST, OTHER, *[F.floor(gates.blend(_P, _N, w) * 1e6 + 3e-5).cast("long").alias(n) for n, w in _BLEND.items()])


@query(f"""with s as (select * from ({_SCORED_SQL}) where {_P} >= 0.92), k as (select *, count(*) over (partition by {FIRST}) as n from s)
  select {FIRST}, {OTHER} from k where not (n = 1 and {_P} < 0.95 and {_N} < 0.5 and house_match <> 1)""")
def singleton_shield_corroborated(spark, sf_dir) -> DataFrame:
    """An entity's only match goes if it is not probable and neither name nor house number bears it out."""
    borne = (F.col(_N) >= 0.5) | (F.col("house_match") == 1)
    return resolve.singleton_shield(_scored(spark, sf_dir).filter(F.col(_P) >= 0.92), 0.95, borne).select(FIRST, OTHER)


_LABEL_SQL = f"with t as (select distinct * from ({ev.TRUTH_SQL})), k as ({blocking.oracle(c.CH['b01_exact_name'], c.DOCS)}), l as (select k.{FIRST}, k.{OTHER}, (t.{FIRST} is not null)::int as label from k left join t using ({FIRST}, {OTHER}))"


@query(f"{_LABEL_SQL} select * from l")
def labelled_candidates(spark, sf_dir) -> DataFrame:
    return sampling.labelled(blocking.pairs(tables.entities(spark, sf_dir), c.CH["b01_exact_name"]), ev.truth(spark, sf_dir))


@query(f"{_LABEL_SQL} select {FIRST}, {OTHER}, label from (select *, row_number() over (partition by {FIRST}, label order by {OTHER}) as r from l) where r <= case when label = 1 then 3 else 5 end")
def capped_training_pairs(spark, sf_dir) -> DataFrame:
    return sampling.capped(labelled_candidates(spark, sf_dir))


@query(f"""with d as ({derive.duck_select(f'({c.DOCS})')}), t as (select distinct * from ({ev.TRUTH_SQL})) select {FIRST}, {OTHER} from (
  select a.entity_id as {FIRST}, b.entity_id as {OTHER} from d a join d b on a.addr = b.addr and a.country = b.country where length(a.addr) >= 15 and starts_with(a.entity_id, 'S1-') and not starts_with(b.entity_id, 'S1-'))
  anti join t using ({FIRST}, {OTHER}) order by md5('5:' || {FIRST} || '|' || {OTHER}), {FIRST}, {OTHER} limit 300""")
def colocated_negatives(spark, sf_dir) -> DataFrame:
    e = derive.with_columns(tables.entities(spark, sf_dir), ("addr",))
    return sampling.colocated_negatives(e, ev.truth(spark, sf_dir), 300, 5)


def _training(spark, sf_dir) -> DataFrame:
    rows = sampling.labelled(features.native(_pairs(spark, sf_dir)), ev.truth(spark, sf_dir))
    rows = rows.withColumn("fold", sampling.part_of(F.col(FIRST), 5))
    return rows.repartition(F.col(FIRST)).cache()


@query()
def boosted_ensemble(spark, sf_dir) -> DataFrame:
    """Two boosted models trained on four fifths of the entities, blended on the rest."""
    rows = _training(spark, sf_dir)
    presets = scoring.PRESETS["small_a"], scoring.PRESETS["small_b"]
    return scoring.ensemble(rows.filter("fold > 0"), rows.filter("fold = 0"), NATIVE, *presets).select(FIRST, OTHER, "label", "p_a", "p_b", "probability")


@query()
def stacked_scores(spark, sf_dir) -> DataFrame:
    rows = _training(spark, sf_dir)
    return scoring.stacked(rows, ["name_char3_jaccard", "address_char3_jaccard", "name_token_dice"]).select(FIRST, OTHER, "label", "fold", "stacked")


@query()
def pure_leaves(spark, sf_dir) -> DataFrame:
    return scoring.pure_leaves(_training(spark, sf_dir), NATIVE)


@query()
def alignment_kernels(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    a, b = F.col("name1"), F.col("name2")
    return p.select(FIRST, OTHER, sim.ratio(a, b).alias("ratio"), sim.partial_ratio(a, b).alias("partial"), sim.token_sort_ratio(a, b).alias("token_sort"), sim.token_set_ratio(a, b).alias("token_set"))
