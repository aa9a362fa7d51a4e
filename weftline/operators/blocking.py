"""Blocking: one template for every candidate channel, planned for Spark and written out as DuckDB SQL.

key on both sides -> optional key-frequency filters -> equi-join (usually with country) -> optional shared-key count ->
fan-out cap -> distinct pairs. The caps keep their distinct meanings: ``cap`` drops a source-1 entity with more join
rows than that altogether; ``freq23`` / ``freq1`` / ``freq_all`` keep keys by how often a side (or both) has them.

For a channel whose cap counts join rows, the plan never builds the join that the cap would throw away: join rows per
source-1 entity are the sum of its keys' counts on the other side, so entities over the cap are dropped before the pair
join, and the join's output is at most cap rows per entity. Where the cap counts pairs after a test between the sides or
of shared keys (``residual``, ``min_shared``), key counts cannot tell it and the join is built: for shared keys between
classes of entities that hold the same keys, whose pairs and members give each entity's number of pairs before any pair of
entities is made. The oracle states the plain form (join, count over, filter).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.dialect import X, same

FIRST, OTHER = "source1_entity_id", "matched_entity_id"


@dataclass(frozen=True)
class Channel:
    """How a channel pairs entities. ``keys``: equal on both sides; a list key is exploded (``exploded``: its index).
    ``guards``: conditions on each side. ``residual``: condition between sides a and b over ``carry`` columns."""

    name: str
    keys: tuple[X, ...]
    country: bool = True
    guards: tuple[X, ...] = ()
    exploded: int | None = None
    token_guard: X | None = None  # on the exploded element, named tok
    freq23: tuple[int, int] | None = None
    freq1: tuple[int, int] | None = None
    freq_all: tuple[int, int] | None = None
    freq_country: bool = False  # frequencies counted per country
    freq_distinct: bool = False  # entities, not rows
    min_shared: int | None = None
    cap: int | None = None
    prob: float | None = None
    prob_by_shared: tuple[tuple[int, float], ...] = ()  # (shared keys at least, probability), most first
    unmatched: bool = False
    carry: tuple[tuple[str, X], ...] = ()
    residual: str | None = None
    keys1: tuple[X, ...] | None = None  # if the source-1 side derives its key otherwise
    guards1: tuple[X, ...] | None = None
    exploded1: int | None | str = field(default="same")
    entities: str = "documents"

    def side(self, first: bool) -> tuple[tuple[X, ...], tuple[X, ...], int | None]:
        keys = self.keys1 if first and self.keys1 is not None else self.keys
        guards = self.guards1 if first and self.guards1 is not None else self.guards
        exploded = self.exploded1 if first and self.exploded1 != "same" else self.exploded
        return keys, guards, exploded


def _keyed(df: DataFrame, ch: Channel, first: bool) -> DataFrame:
    keys, guards, exploded = ch.side(first)
    texts = [x.spark for x in (*keys, *guards, *(c for _, c in ch.carry))]
    df = derive.with_columns(df, derive.needed(*texts))
    for g in guards:
        df = df.filter(F.expr(g.spark))
    cols = [F.expr(f"explode({k.spark})" if i == exploded else k.spark).alias(f"k{i}") for i, k in enumerate(keys)]
    df = df.select(F.col("entity_id").alias("id"), F.col("country").alias("co"), *cols, *[F.expr(x.spark).alias(f"c_{n}") for n, x in ch.carry])
    for i in range(len(keys)):
        df = df.filter(f"k{i} <> ''")
    if exploded is not None and ch.token_guard is not None:
        df = df.filter(F.expr(ch.token_guard.spark.replace("tok", f"k{exploded}")))
    return df.filter("co is not null") if ch.country else df


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """By these columns to an explicit number of tasks: what is joined next is small, but makes many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: A channel whose keys are held by more rows than this on both sides may make very many pairs of one key.
FEW = 1_000
#: Rows that one task of a crossing makes, about.
CROSSED = 1 << 20


def crossed(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` joined with ``b`` on ``on``. A key of very many pairs is dealt to several tasks: b's rows by a hash, a's to each."""
    counts = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*on).agg(F.count(F.lit(1)).alias("_nb")), on)
    hot = counts.filter(F.col("_na") * F.col("_nb") > CROSSED)
    hot = hot.select(*on, F.least(F.col("_nb"), F.ceil(F.col("_na") * F.col("_nb") / CROSSED)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    a = a.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    own = F.xxhash64(*[c for c in b.columns if c not in on])
    b = b.join(hot, on, "left").withColumn("_part", F.pmod(own, parts).cast("int")).drop("_parts")
    by = [*on, "_part"]
    return _dealt(a, *by).join(_dealt(b, *by), by).drop("_part")


def _once(df: DataFrame, on: list[str], also: list[str]) -> DataFrame:
    """(id, ``also``, ks, ``on``): each id's distinct keys; ks: all of them, if there are several."""
    held = df.groupBy("id", *also).agg(F.collect_set(F.struct(*on)).alias("ks"))
    return held.select("id", *also, F.when(F.size("ks") > 1, F.col("ks")).alias("ks"), F.inline("ks"))


def _crossed_once(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct (source1_entity_id, matched_entity_id) of entities that share a key: a pair comes from the smallest key
    that both have, so that no pair is moved to be compared with others."""
    left, right = (_once(x, on, []).withColumnsRenamed({"id": i, "ks": k}) for x, i, k in ((a, FIRST, "ka"), (b, OTHER, "kb")))
    least = F.array_min(F.array_intersect("ka", "kb"))
    out = crossed(left, right, on)
    return out.filter(F.col("ka").isNull() | F.col("kb").isNull() | (F.struct(*on) == least)).select(FIRST, OTHER)


def _classes(df: DataFrame, on: list[str], rep: str) -> tuple[DataFrame, DataFrame]:
    """(id, ``rep``) of entities, and (``rep``, n, keys) of classes of those with the same rows of keys; ``rep``: the smallest id."""
    held = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*on))).alias("keys"))
    classes = held.groupBy("keys").agg(F.min("id").alias(rep), F.count(F.lit(1)).alias("n"))
    return held.join(classes.select("keys", rep), "keys").select("id", rep), classes


def _shared(a: DataFrame, b: DataFrame, on: list[str], least: int, cap: int | None) -> DataFrame:
    """(source1_entity_id, matched_entity_id, shared) of entities with at least ``least`` join rows, capped: classes of
    equal keys are joined, an entity's pairs counted by the members of the classes met, and only what is kept is expanded."""
    ids_a, classes_a = _classes(a, on, "ra")
    ids_b, classes_b = _classes(b, on, "rb")
    x = _dealt(classes_a.select("ra", F.inline("keys")), *on)
    y = _dealt(classes_b.select("rb", F.col("n").alias("nb"), F.inline("keys")), *on)
    met = x.join(y, on).groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("shared"), F.first("nb").alias("nb")).filter(F.col("shared") >= least)
    if cap is not None:
        met = met.groupBy("ra").agg(F.sum("nb").alias("fan"), F.collect_list(F.struct("rb", "shared")).alias("to")).filter(F.col("fan") <= cap)
        met = met.select("ra", F.inline("to"))
    out = met.join(ids_a.withColumnRenamed("id", FIRST), "ra").join(ids_b.withColumnRenamed("id", OTHER), "rb")
    return out.select(FIRST, OTHER, "shared")


def _kept_keys(ch: Channel, a: DataFrame, b: DataFrame) -> DataFrame | None:
    names = [f"k{i}" for i in range(len(ch.keys))]
    by = (["co"] if ch.freq_country else []) + names
    count = F.countDistinct("id") if ch.freq_distinct else F.count(F.lit(1))
    out = None
    for rows, span in ((b, ch.freq23), (a, ch.freq1), (a.select(b.columns).unionAll(b) if ch.freq_all else b, ch.freq_all)):
        if span:
            good = rows.groupBy(*by).agg(count.alias("n")).filter(F.col("n").between(*span)).drop("n")
            out = good if out is None else out.join(good, by, "left_semi")
    return out


def pairs(entities: DataFrame, ch: Channel, matched: DataFrame | None = None) -> DataFrame:
    """Distinct (source1_entity_id, matched_entity_id[, probability]) of a channel.

    ``matched``: source-1 ids that an ``unmatched`` channel leaves out."""
    first = F.col("entity_id").startswith("S1-")
    a, b = _keyed(entities.filter(first), ch, True), _keyed(entities.filter(~first), ch, False)
    if ch.unmatched and matched is not None:
        a = a.join(matched.select(F.col(FIRST).alias("id")), "id", "left_anti")
    names = [f"k{i}" for i in range(len(ch.keys))]
    on = (["co"] if ch.country else []) + names
    good = _kept_keys(ch, a, b)
    if good is not None:
        by = good.columns
        a, b = a.join(good, by, "left_semi"), b.join(good, by, "left_semi")
    carried = [f"c_{n}" for n, _ in ch.carry]
    if ch.cap is not None and ch.min_shared is None and ch.residual is None:
        fan = b.groupBy(*on).agg(F.count(F.lit(1)).alias("fan"))
        low = a.join(fan, on).groupBy("id").agg(F.sum("fan").alias("fan")).filter(F.col("fan") <= ch.cap).select("id")
        a = a.join(low, "id", "left_semi")
    if ch.cap is None and ch.min_shared is None and not ch.residual and not any(f and f[1] <= FEW for f in (ch.freq23, ch.freq1, ch.freq_all)):
        return _with_probability(_crossed_once(a, b, on), ch)
    if ch.min_shared is not None and not ch.residual:
        return _with_probability(_shared(a, b, on, ch.min_shared, ch.cap), ch)
    left = a.select(F.col("id").alias(FIRST), *on, *[F.col(c).alias(f"a_{c}") for c in carried])
    right = b.select(F.col("id").alias(OTHER), *on, *[F.col(c).alias(f"b_{c}") for c in carried])
    out = left.join(right, on)
    if ch.residual:
        out = out.filter(F.expr(ch.residual))
    if ch.min_shared is not None:
        out = out.groupBy(FIRST, OTHER).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= ch.min_shared)
    out = out.select(FIRST, OTHER, *(["shared"] if ch.min_shared is not None else []))
    if ch.cap is not None and (ch.min_shared is not None or ch.residual):
        low = out.groupBy(FIRST).count().filter(F.col("count") <= ch.cap).select(FIRST)
        out = out.join(low, FIRST, "left_semi")
    return _with_probability(out.distinct(), ch)


def _with_probability(out: DataFrame, ch: Channel) -> DataFrame:
    if ch.prob_by_shared:
        least = ch.prob_by_shared[-1][1]
        cases = " ".join(f"when shared >= {n} then {p}d" for n, p in ch.prob_by_shared)
        return out.withColumn("probability", F.expr(f"case {cases} else {least}d end"))
    return out.withColumn("probability", F.lit(ch.prob)) if ch.prob is not None else out


def union(entities: DataFrame, whole: Channel, rest: list[Channel]) -> DataFrame:
    """Distinct pairs of a channel on exact names (one key, all countries) and of uncapped others. Pairs of entities with a
    name in common are those of ``whole``; the others give the rest, so that only those are compared with each other. The
    entities are cached, lest each side of each channel read them anew."""
    named = derive.with_columns(entities, ("name",)).withColumn("name", F.nullif("name", F.lit("")))
    own = F.collect_set("name").over(Window.partitionBy("entity_id"))  # one name but where an id is repeated
    cached = named.withColumn("own_names", own).drop("name").cache()
    out = None
    for ch in rest:
        apart = replace(ch, carry=(("names", same("own_names")),), residual="not arrays_overlap(a_c_names, b_c_names)")
        rows = pairs(cached, apart).select(FIRST, OTHER)
        out = rows if out is None else out.unionByName(rows)
    return pairs(cached, whole).select(FIRST, OTHER).unionByName(out.distinct())


def volume(entities: DataFrame, ch: Channel) -> DataFrame:
    """Join rows a channel would make, from key counts alone."""
    first = F.col("entity_id").startswith("S1-")
    on = (["co"] if ch.country else []) + [f"k{i}" for i in range(len(ch.keys))]
    a = _keyed(entities.filter(first), ch, True).groupBy(*on).agg(F.countDistinct("id").alias("n1"))
    b = _keyed(entities.filter(~first), ch, False).groupBy(*on).agg(F.countDistinct("id").alias("n2"))
    return a.join(b, on).agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("candidates"), F.count(F.lit(1)).alias("shared_keys"))


def key_frequencies(entities: DataFrame, ch: Channel) -> DataFrame:
    """How many source-1 and other entities hold each key of a channel."""
    first = F.col("entity_id").startswith("S1-")
    on = [f"k{i}" for i in range(len(ch.keys))]
    a = _keyed(entities.filter(first), ch, True).groupBy(*on).agg(F.countDistinct("id").alias("n1"))
    b = _keyed(entities.filter(~first), ch, False).groupBy(*on).agg(F.countDistinct("id").alias("n23"))
    return a.join(b, on, "outer").na.fill(0, ["n1", "n23"])


def overlap(entities: DataFrame, chosen: list[Channel]) -> DataFrame:
    """Per channel: its pairs, those no other of the channels finds, and the union's size, in one aggregate."""
    out = None
    for ch in chosen:
        rows = pairs(entities, ch).select(F.lit(ch.name).alias("channel"), FIRST, OTHER)
        out = rows if out is None else out.unionByName(rows)
    found = out.groupBy(FIRST, OTHER).agg(F.collect_list("channel").alias("by"))
    named = found.select(F.explode("by").alias("channel"), (F.size("by") == 1).cast("int").alias("alone"))
    return named.groupBy("channel").agg(F.count(F.lit(1)).alias("pairs"), F.sum("alone").alias("only_here"))


# -- the same in DuckDB -------------------------------------------------------------------------------------------


def _keyed_sql(ch: Channel, first: bool) -> str:
    keys, guards, exploded = ch.side(first)
    where = ["starts_with(entity_id, 'S1-')" if first else "not starts_with(entity_id, 'S1-')", *(g.duck for g in guards)]
    cols = [f"unnest({k.duck}) as k{i}" if i == exploded else f"{k.duck} as k{i}" for i, k in enumerate(keys)]
    carry = [f"{x.duck} as c_{n}" for n, x in ch.carry]
    tests = [f"k{i} <> ''" for i in range(len(keys))] + (["co is not null"] if ch.country else [])
    if exploded is not None and ch.token_guard is not None:
        tests.append(ch.token_guard.duck.replace("tok", f"k{exploded}"))
    return f"select * from (select entity_id as id, country as co, {', '.join(cols + carry)} from d where {' and '.join(where)}) where {' and '.join(tests)}"


def oracle(ch: Channel, entities_sql: str, matched_sql: str | None = None) -> str:
    """Plain SQL of the channel over ``entities_sql``; ``matched_sql`` may use the derived table d."""
    names = [f"k{i}" for i in range(len(ch.keys))]
    on = (["co"] if ch.country else []) + names
    by = ", ".join((["co"] if ch.freq_country else []) + names)
    count = "count(distinct id)" if ch.freq_distinct else "count(*)"
    ctes = [f"e as ({entities_sql})", f"d as ({derive.duck_select('e')})"]
    skip = ""
    if ch.unmatched and matched_sql:
        ctes.append(f"done as ({matched_sql})")
        skip = f" where id not in (select {FIRST} from done)"
    ctes += [f"a0 as (select * from ({_keyed_sql(ch, True)}){skip})", f"b0 as ({_keyed_sql(ch, False)})"]
    a, b, step = "a0", "b0", 0
    for source, span in (("b0", ch.freq23), ("a0", ch.freq1), ("(select * from a0 union all select * from b0)", ch.freq_all)):
        if span:
            step += 1
            ctes.append(f"f{step} as (select {by} from {source} group by {by} having {count} between {span[0]} and {span[1]})")
            for s in "ab":
                ctes.append(f"{s}{step} as (select * from {s}{step - 1} where ({by}) in (select ({by}) from f{step}))")
            a, b = f"a{step}", f"b{step}"
    join = " and ".join(f"a.{c} = b.{c}" for c in on)
    residual = f" where {_residual_sql(ch)}" if ch.residual else ""
    ctes.append(f"j as (select a.id as {FIRST}, b.id as {OTHER} from {a} a join {b} b on {join}{residual})")
    shared = ""
    if ch.min_shared is not None:
        ctes.append(f"s as (select {FIRST}, {OTHER}, count(*) as shared from j group by all having count(*) >= {ch.min_shared})")
        shared = ", shared"
    source = "s" if ch.min_shared is not None else "j"
    if ch.cap is not None:
        ctes.append(f"c as (select *, count(*) over (partition by {FIRST}) as fan from {source})")
        source = f"c where fan <= {ch.cap}"
    prob = f", {ch.prob}::double as probability" if ch.prob is not None else ""
    if ch.prob_by_shared:
        cases = " ".join(f"when shared >= {n} then {p}" for n, p in ch.prob_by_shared)
        prob = f", (case {cases} else {ch.prob_by_shared[-1][1]} end)::double as probability"
    return f"with {', '.join(ctes)} select distinct {FIRST}, {OTHER}{shared}{prob} from {source}"


def _residual_sql(ch: Channel) -> str:
    out = ch.residual
    for n, _ in ch.carry:
        out = out.replace(f"a_c_{n}", f"a.c_{n}").replace(f"b_c_{n}", f"b.c_{n}")
    return out
