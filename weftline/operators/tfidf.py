"""Character n-gram TF-IDF retrieval between two sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import FIRST, OTHER

#: Least and most grams of one side of a cell, and grams of candidates that are weighed at a time.
CELL = 1 << 19, 1 << 21
RUN = 1 << 21
#: Members of a class on one side are dealt to so many lists.
SALTS = 64
#: A side is broadcast only when its counted bytes stay under this.
BROADCAST_BYTES = 64 << 20


def word_grams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """n-grams inside words padded by one blank each side; a padded word no longer than n is itself a gram."""
    padded = F.transform(F.filter(F.split(text, " ", -1), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.concat(*[F.flatten(_cuts(padded, n)) for n in sizes])


def _cuts(padded: Column, n: int) -> Column:
    def of(w: Column) -> Column:
        room = F.greatest(F.char_length(w) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), room), lambda i: F.substring(w, i, F.lit(n)))

    return F.transform(padded, of)


def similar(entities: DataFrame, column: str = "name", least: float = 0.75, sizes: tuple[int, ...] = (3, 4), max_df: int | None = None) -> DataFrame:
    """Pairs of the two sources in one country whose cosine is at least ``least``, with it.

    Grams are weighted by tf * (1 + ln((1 + N) / (1 + df))) over both sides of a country and scaled to unit length.
    Entities of equal countries and texts are one class. Both sides' classes of a country are dealt to blocks, and each
    pair of blocks meets in one task (a cell), so that no meeting on a gram is ever written: a pair over the limit must
    share a gram of its sides' prefixes (the rarest grams whose rest cannot reach the limit), those pairs alone are
    weighed there, and only pairs of classes over the limit leave. Members are put in last.
    """
    rows = entities.filter((F.char_length(column) >= 4) & F.col("country").isNotNull()).select("entity_id", "country", F.col(column).alias("text"))
    texts = rows.groupBy("entity_id", "country", "text").agg(F.count(F.lit(1)).alias("times"))
    members = texts.filter("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("country", "text", "times"))).alias("parts"))
    first = F.col("entity_id").startswith("S1-")
    members = members.select("entity_id", first.alias("first"), F.unhex(F.md5(F.to_json("parts"))).alias("c"), "parts")
    classes = members.groupBy("c", "parts").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("n1"))
    countries = F.array_distinct(F.transform("parts", lambda p: p["country"]))

    def counted(of: DataFrame) -> DataFrame:
        each = of.select("c", "n", F.explode("parts").alias("p"))
        each = each.select("c", "n", "p.country", "p.times", F.explode(word_grams(F.col("p.text"), sizes)).alias("g"))
        return each.groupBy("c", "n", "country", "g").agg(F.sum("times").alias("tf"))

    # rows without an id are one entity that pairs with none
    nameless = texts.filter("entity_id is null").select("country", F.explode(word_grams(F.col("text"), sizes)).alias("g")).distinct()
    df = counted(classes).select("country", "g", "n").unionByName(nameless.withColumn("n", F.lit(1).cast("long")))
    df = df.groupBy("country", "g").agg(F.sum("n").alias("df"))
    if max_df is not None:
        df = df.filter(F.col("df") <= max_df)
    sums = classes.select("n", "n1", "parts", F.explode(countries).alias("country"))
    mass = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + len(sizes) * F.char_length(p["text"]))
    sums = sums.groupBy("country").agg(F.sum("n").alias("_n"), *[F.coalesce(F.sum(F.when(x, mass)), F.lit(0)).alias(k) for k, x in (("m1", F.col("n1") > 0), ("m2", F.col("n") > F.col("n1")))])
    weights = df.join(_broadcast(sums.select("country", "_n"), F.octet_length("country") + 64), "country")
    # the key of a gram holds the country's length, so that no two are alike
    key = F.concat(F.char_length("country").cast("string"), F.lit(":"), "country", "g")
    weights = weights.select("country", "g", "df", key.alias("key"), (1 + F.log((1 + F.col("_n")) / (1 + F.col("df")))).alias("idf"))
    weights = _broadcast(weights, F.octet_length("key") + F.octet_length("country") + F.octet_length("g") + 64)
    vectors = counted(classes.repartition("c")).join(weights, ["country", "g"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "key", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))

    size = F.greatest(F.lit(CELL[0]), F.least(F.lit(CELL[1]), F.sqrt(F.col("m1") * F.col("m2").cast("double")) / 8))
    shapes = sums.filter("m1 > 0 and m2 > 0").select("country", *[F.ceil(F.col(m) / size).cast("int").alias(k) for m, k in (("m1", "_i"), ("m2", "_j"))])
    placed = classes.select("c", "n", "n1", F.explode(countries).alias("country")).join(_broadcast(shapes, F.octet_length("country") + 64), "country")
    own = F.xxhash64("c")

    def cells(has: Column, mine: str, theirs: str, build) -> Column:
        at = F.pmod(own, F.col(mine)).cast("int")
        return F.when(has, F.transform(F.sequence(F.lit(0), F.col(theirs) - 1), lambda k: build(at, k))).otherwise(F.array())

    one = cells(F.col("n1") > 0, "_i", "_j", lambda at, k: F.struct(at.alias("i"), k.alias("j"), F.lit(True).alias("first")))
    two = cells(F.col("n") > F.col("n1"), "_j", "_i", lambda at, k: F.struct(k.alias("i"), at.alias("j"), F.lit(False).alias("first")))
    placed = placed.groupBy("c").agg(F.flatten(F.collect_list(F.transform(F.concat(one, two), lambda x: F.struct(F.col("country"), x["i"].alias("i"), x["j"].alias("j"), x["first"].alias("first"))))).alias("cells"))
    dealt = vectors.join(placed, "c").select("c", F.col("v.key").alias("keys"), F.col("v.w").alias("w"), F.explode("cells").alias("cell"))
    dealt = dealt.select("cell.country", "cell.i", "cell.j", "cell.first", "c", "keys", "w")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(batches, least)

    # classes of several countries may meet more than once, each time with their whole cosine
    pairs = dealt.groupBy("country", "i", "j").applyInArrow(met, "c1 binary, c2 binary, cosine double").dropDuplicates(["c1", "c2"])
    lists = members.groupBy("first", "c", F.pmod(F.xxhash64("entity_id"), F.lit(SALTS)).alias("salt")).agg(F.collect_list("entity_id").alias("ids"))
    for k, side in ((1, lists.filter("first")), (2, lists.filter("not first"))):
        pairs = pairs.join(side.select(F.col("c").alias(f"c{k}"), F.col("salt").alias(f"s{k}"), F.col("ids").alias(f"ids{k}")), f"c{k}")
    pairs = pairs.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c1", "s1", "c2", "s2")
    return pairs.select(F.explode("ids1").alias(FIRST), "ids2", "cosine").select(FIRST, F.explode("ids2").alias(OTHER), "cosine")


def _broadcast(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Hint a broadcast only after summing the rows' bytes."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs over the limit of one cell's rows (first, c, keys, w), of which a row's grams stand rarest first."""
    cell = pa.Table.from_batches(batches)
    keys, c, w = cell["keys"].combine_chunks(), cell["c"].combine_chunks(), cell["w"].combine_chunks().flatten().to_numpy()
    first, n = cell["first"].to_numpy(), pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = keys.flatten().dictionary_encode()
    ids, vocabulary, row = coded.indices.to_numpy(), len(coded.dictionary), np.repeat(np.arange(len(n)), n)
    del cell, keys, coded
    begin = np.cumsum(n) - n
    w = w / np.sqrt(np.bincount(row, w * w, len(n)))[row]
    total = np.cumsum(w * w) - w * w
    prefix = 1 - (total - total[begin][row]) >= least * least - 1e-9
    del total
    # where each gram stands in a prefix of the other side
    at = np.flatnonzero(prefix & ~first[row])
    at = at[np.argsort(ids[at], kind="stable")]
    other, post = row[at], np.searchsorted(ids[at], np.arange(vocabulary + 1))
    reach = np.bincount(row, prefix, len(n)).astype(np.int64)
    dense, found, held = np.zeros(vocabulary), [], 0

    def batch() -> pa.RecordBatch:
        a, b, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([c.take(pa.array(a)), c.take(pa.array(b)), pa.array(cosine)], ["c1", "c2", "cosine"])

    for x in np.flatnonzero(first):
        own = slice(begin[x], begin[x] + n[x])
        lists = [other[post[g] : post[g + 1]] for g in ids[own][: reach[x]]]
        near = np.flatnonzero(np.bincount(np.concatenate(lists), minlength=1))
        if not len(near):
            continue
        dense[ids[own]] = w[own]
        for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(n[near]) // RUN)) + 1):
            m = n[part]
            start = np.cumsum(m) - m
            flat = np.repeat(begin[part] - start, m) + np.arange(int(m.sum()))
            cosine = np.add.reduceat(dense[ids[flat]] * w[flat], start)
            hit = np.flatnonzero(cosine >= least)
            if len(hit):
                found.append((np.full(len(hit), x), part[hit], cosine[hit]))
                held += len(hit)
        dense[ids[own]] = 0
        if held >= 1 << 16:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def duck(entities_sql: str, column: str = "name", least: float = 0.75) -> str:
    """The same without prefixes, for DuckDB."""
    cuts = " union all ".join(
        f"select entity_id, country, unnest(list_transform(range(1, greatest(length(w) - {n} + 1, 1) + 1), lambda i: substring(w, i, {n}))) as g from p" for n in (3, 4)
    )
    return f"""with e as (select entity_id, country, {column} as t from ({entities_sql}) where length({column}) >= 4),
      p as (select entity_id, country, ' ' || w || ' ' as w from (select entity_id, country, unnest(string_split(t, ' ')) as w from e) where w <> ''),
      tf as (select entity_id, country, g, count(*) as tf from ({cuts}) group by all),
      n as (select country, count(distinct entity_id) as n from e group by 1), df as (select country, g, count(*) as df from tf group by all),
      w as (select entity_id, country, g, tf * (1 + ln((1 + n.n) / (1 + df.df))) as w from tf join df using (country, g) join n using (country)),
      u as (select entity_id, country, g, w / sqrt(sum(w * w) over (partition by entity_id)) as w from w)
      select a.entity_id as {FIRST}, b.entity_id as {OTHER}, round(sum(a.w * b.w), 6) as cosine from u a join u b on a.country = b.country and a.g = b.g
      where starts_with(a.entity_id, 'S1-') and not starts_with(b.entity_id, 'S1-') group by all having sum(a.w * b.w) >= {least}"""
