"""Pair features: 52 columns from two entities' normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity as sim

#: Columns of a pair row, for side 1 and 2.
SIDES = ("name", "addr", "house", "postal", "country")


def _i(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _both(a: Column, b: Column, n: int) -> Column:
    return (F.char_length(a) >= n) & (F.char_length(b) >= n)


def _digits(tokens: str) -> Column:
    return F.filter(tokens, lambda w: w.rlike("[0-9]"))


def native(pairs: DataFrame) -> DataFrame:
    """The 33 features of built-in expressions. ``pairs``: matched_entity_id and name1, addr1, .. country2."""
    p = pairs.withColumns({f"{c}{k}": F.coalesce(F.col(f"{c}{k}"), F.lit("")) for c in SIDES for k in (1, 2)})
    n1, n2, a1, a2, h1, h2, z1, z2, c1, c2 = (F.col(f"{c}{k}") for c in SIDES for k in (1, 2))
    w1, w2, t1, t2 = F.col("_w1"), F.col("_w2"), F.col("_t1"), F.col("_t2")
    # token and gram lists are columns of their own: each is used several times and so computed once per pair
    lists = {"_w1": F.filter(F.split(n1, " ", -1), lambda w: w != ""), "_w2": F.filter(F.split(n2, " ", -1), lambda w: w != ""), "_t1": sim.tokens(a1), "_t2": sim.tokens(a2)}
    lists |= {f"_{s}{n}{k}": sim.grams(F.col(f"{c}{k}"), n) for s, c in (("n", "name"), ("a", "addr")) for n in (3, 4) for k in (1, 2)}
    p = p.withColumns(lists)
    p = p.withColumns({"_d1": F.array_distinct("_w1"), "_d2": F.array_distinct("_w2"), "_m1": _digits("_t1"), "_m2": _digits("_t2")})
    length = lambda x, y: F.abs(F.char_length(x) - F.char_length(y))
    first, last = (lambda w: F.get(w, F.lit(0))), (lambda w: F.try_element_at(w, F.lit(-1)))
    mid = F.coalesce(F.col("matched_entity_id"), F.lit(""))
    d1, d2 = F.col("_d1"), F.col("_d2")
    grams = lambda s: sim.jaccard(F.col(f"_{s}1"), F.col(f"_{s}2"))
    return p.withColumns(
        {
            "name_exact": _i((n1 == n2) & (n1 != "")),
            "name_contains": _i((n1 != "") & (n2 != "") & (n2.contains(n1) | n1.contains(n2))),
            "name_prefix3": _i((F.substring(n1, 1, 3) == F.substring(n2, 1, 3)) & _both(n1, n2, 3)),
            "name_prefix5": _i((F.substring(n1, 1, 5) == F.substring(n2, 1, 5)) & _both(n1, n2, 5)),
            "name_suffix4": _i((F.right(n1, F.lit(4)) == F.right(n2, F.lit(4))) & _both(n1, n2, 4)),
            "name_first_token_match": _i(first(w1) == first(w2)),
            "name_last_token_match": _i(last(w1) == last(w2)),
            "name_shared_token_count": F.size(F.array_intersect(w1, w2)),
            "name_token_jaccard": sim.jaccard(d1, d2),
            "name_token_dice": sim.dice(d1, d2),
            "name_char3_jaccard": grams("n3"),
            "name_char4_jaccard": grams("n4"),
            "name_acronym_match": _i(sim.acronym(n1, n2)),
            "name_len_diff": length(n1, n2),
            "name_len_rel_diff": length(n1, n2) / F.greatest(F.char_length(n1), F.lit(1)),
            "address_exact": _i((a1 == a2) & (a1 != "")),
            "address_contains": _i((a1 != "") & (a2 != "") & (a2.contains(a1) | a1.contains(a2))),
            "address_prefix5": _i((F.substring(a1, 1, 5) == F.substring(a2, 1, 5)) & _both(a1, a2, 5)),
            "address_prefix8": _i((F.substring(a1, 1, 8) == F.substring(a2, 1, 8)) & _both(a1, a2, 8)),
            "address_suffix8": _i((F.right(a1, F.lit(8)) == F.right(a2, F.lit(8))) & _both(a1, a2, 8)),
            "address_char3_jaccard": grams("a3"),
            "address_char4_jaccard": grams("a4"),
            "house_match": _i((h1 != "") & (h1 == h2)),
            "postal_exact": _i((z1 != "") & (z1 == z2)),
            "postal_prefix3": _i((F.substring(z1, 1, 3) == F.substring(z2, 1, 3)) & _both(z1, z2, 3)),
            "address_token_jaccard": sim.jaccard(t1, t2),
            "address_numeric_overlap": sim.jaccard(F.col("_m1"), F.col("_m2")),
            "address_len_diff": length(a1, a2),
            "address_len_rel_diff": length(a1, a2) / F.greatest(F.char_length(a1), F.lit(1)),
            "country_match": _i((c1 != "") & (c1 == c2)),
            "country_missing": _i((c1 == "") | (c2 == "")),
            "source2": _i(mid.startswith("S2-")),
            "source3": _i(mid.startswith("S3-")),
        }
    ).drop(*lists, "_d1", "_d2", "_m1", "_m2")


def aligned(features: DataFrame) -> DataFrame:
    """The eight alignment features, by Arrow batches."""
    out = {}
    for c, name in (("name", "name"), ("addr", "address")):
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        out |= {f"{name}_ratio": sim.ratio(a, b), f"{name}_partial_ratio": sim.partial_ratio(a, b), f"{name}_token_sort": sim.token_sort_ratio(a, b), f"{name}_token_set": sim.token_set_ratio(a, b)}
    return features.withColumns(out)


def crossed(features: DataFrame) -> DataFrame:
    """The eleven features built on the others."""
    n, a, h, z, j = (F.col(c) for c in ("name_ratio", "address_ratio", "house_match", "postal_exact", "name_token_jaccard"))
    return features.withColumns(
        {
            "name_address_ratio_mean": (n + a) / 2,
            "name_address_ratio_product": n * a,
            "name_address_harmonic": 2 * n * a / (n + a + 1e-6),
            "name_postal_cross": n * z,
            "name_house_cross": n * h,
            "strong_name_address": _i((n >= 0.90) & (a >= 0.70)),
            "strong_name_house": _i((n >= 0.90) & (h == 1)),
            "strong_name_postal": _i((n >= 0.90) & (z == 1)),
            "name_gate_40": _i((n >= 0.40) | (j >= 0.35) | (F.col("name_acronym_match") == 1)),
            "name_gate_60": _i((n >= 0.60) | (j >= 0.50)),
            "addr_gate_50": _i((a >= 0.50) | (h == 1) | (z == 1)),
        }
    )


def extract(pairs: DataFrame) -> DataFrame:
    """All 52 features."""
    return crossed(aligned(native(pairs)))


def numeric_overlap(a: Column, b: Column, profile: str) -> Column:
    """The number-overlap feature as other model generations define it: ``both_empty_one`` (Jaccard), ``over_first``
    (share of the first side's numbers), ``count``, ``either_empty_zero`` (Jaccard)."""
    x, y = (F.filter(sim.tokens(c), lambda w: w.rlike("[0-9]")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    if profile == "both_empty_one":
        return sim.jaccard(x, y)
    if profile == "over_first":
        return F.when(F.size(x) == 0, 0.0).otherwise(both / F.size(x))
    if profile == "count":
        return both.cast("double")
    if profile == "either_empty_zero":
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(sim.jaccard(x, y))
    raise ValueError(profile)


def attached(pairs: DataFrame, entities: DataFrame, house: str = "house", postal: str = "postal") -> DataFrame:
    """Pair rows with both sides' columns. ``entities``: entity_id, name, addr, country and the two anchors."""
    cols = {"name": "name", "addr": "addr", "house": house, "postal": postal, "country": "country"}
    side = lambda k, key: entities.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{n}{k}") for n, c in cols.items()])
    out = pairs.join(side(1, "source1_entity_id"), "source1_entity_id", "left").join(side(2, "matched_entity_id"), "matched_entity_id", "left")
    # feature rows are small but dear: an explicit count keeps adaptive coalescing from putting them into a few tasks
    return out.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
