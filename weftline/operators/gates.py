"""Decision gates over scored pairs, as predicates on named feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, NAME, ADDR, HOUSE = "probability", "name_ratio", "address_ratio", "house_match"


def _c(name: str) -> Column:
    return F.col(name)


def blend(a: str, b: str, weight: float = 0.5) -> Column:
    """Weighted mean of two models' probabilities."""
    return _c(a) * weight + _c(b) * (1 - weight)


def base() -> Column:
    return (_c(P) >= 0.972) & ((_c(NAME) >= 0.20) | (_c(ADDR) >= 0.40) | (_c(HOUSE) == 1))


def rescue_one() -> Column:
    """Less probable pairs that agree in name and place, in a near-exact name at one house, or in a near-exact address."""
    alike = ((_c(NAME) >= 0.60) & (_c(ADDR) >= 0.60)) | ((_c(NAME) >= 0.90) & (_c(HOUSE) == 1)) | (_c(ADDR) >= 0.95)
    return (_c(P) >= 0.90) & alike


def colocation_guard() -> Column:
    """Two businesses at one address are not one: some likeness of name is needed."""
    return _c(NAME) >= 0.40


def containment_rescue() -> Column:
    return (_c(P) >= 0.95) & (_c("name_contains") == 1) & (_c(ADDR) >= 0.65)


def acronym_rescue() -> Column:
    return (_c(P) >= 0.90) & (_c("name_acronym_match") == 1) & (_c(ADDR) >= 0.40)


def final() -> Column:
    return ((base() | rescue_one()) & colocation_guard()) | containment_rescue() | acronym_rescue()


def rescue_two() -> Column:
    return (_c(P) >= 0.80) & (_c(NAME) >= 0.90) & (_c(ADDR) >= 0.85)


def branch_disambiguation(limit: float) -> Column:
    """Holds for pairs to keep: not alike in name while apart in place."""
    return ~((_c(NAME) >= 0.85) & (_c(ADDR) < limit))


def anti_merge(least: float = 0.40) -> Column:
    """Holds for pairs to keep: some likeness of name, an acronym or near certainty."""
    return (_c(NAME) >= least) | (_c("name_acronym_match") == 1) | (_c(P) >= 0.998)


def anti_merge_by_address(least: float = 0.40, address: float = 0.50) -> Column:
    """The same where a middling name needs a fitting address."""
    return (_c(NAME) >= 0.80) | ((_c(NAME) >= least) & (_c(ADDR) >= address)) | (_c("name_acronym_match") == 1)


def smart_gate(probability: float, name: float) -> Column:
    """A gate of two free limits, for grids."""
    token, first = _c("name_token_jaccard"), _c("name_first_token_match")
    named = (_c(NAME) >= name) | ((token >= 0.70) & (_c(ADDR) >= 0.40)) | ((first == 1) & (_c(NAME) >= 0.15) & (_c(ADDR) >= 0.40))
    return (_c(P) >= probability) & named & ((_c(ADDR) >= 0.35) | (_c(HOUSE) == 1))


def rescues() -> dict[str, Column]:
    """Named rescue rules, measured one by one before any is adopted."""
    n, a, p, h, z = _c(NAME), _c(ADDR), _c(P), _c(HOUSE) == 1, _c("postal_exact") == 1
    return {
        "name85_postal_country": (n >= 0.85) & z & (_c("country_match") == 1),
        "exact_name_postal": (_c("name_exact") == 1) & z,
        "name80_house_postal": (n >= 0.80) & h & z,
        "acronym_address70": (_c("name_acronym_match") == 1) & (a >= 0.70),
        "contained_address90_p85": (_c("name_contains") == 1) & (a >= 0.90) & (p >= 0.85),
        "name95_address70_p80": (n >= 0.95) & (a >= 0.70) & (p >= 0.80),
        "name90_address85_p80": rescue_two(),
        "exact_address_house_name75": (_c("address_exact") == 1) & h & (n >= 0.75),
        "p92_name70_address70": (p >= 0.92) & (n >= 0.70) & (a >= 0.70),
        "p88_name80_address80": (p >= 0.88) & (n >= 0.80) & (a >= 0.80),
    }


CATALOGUE = {
    "base": base, "rescue_one": rescue_one, "colocation_guard": colocation_guard, "containment_rescue": containment_rescue,
    "acronym_rescue": acronym_rescue, "final": final, "rescue_two": rescue_two, "anti_merge": anti_merge,
    "anti_merge_by_address": anti_merge_by_address,
    **{f"branch_disambiguation_{t}": (lambda t=t: branch_disambiguation(t / 100)) for t in (30, 40, 50)},
}


def volumes(scored: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Pairs that pass each gate (and are true, if the truth is given), in one pass."""
    label = F.lit(0)
    if truth is not None:
        keys = ["source1_entity_id", "matched_entity_id"]
        scored = scored.join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "left")
        label = F.coalesce("_t", F.lit(0))
    cells = [F.struct(F.lit(n).alias("gate"), F.count_if(g()).alias("pairs"), F.count_if(g() & (label == 1)).alias("correct")) for n, g in CATALOGUE.items()]
    return scored.agg(F.array(*cells).alias("g")).select(F.inline("g"))


def grid(scored: DataFrame, probabilities: list[float], names: list[float]) -> DataFrame:
    """Pairs kept by each combination of a probability and a name limit, in one pass."""
    cells = [F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"), F.count_if(smart_gate(p, n)).alias("pairs")) for p in probabilities for n in names]
    return scored.agg(F.array(*cells).alias("g")).select(F.inline("g"))
