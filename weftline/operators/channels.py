"""The catalogue of candidate channels, as data for the blocking template."""

from __future__ import annotations

from ..functions import vocab
from ..functions.dialect import X, at, distinct, extract, fill, head, joined, keep, listed, pair, prefix, replace_all, same, size, sort, split, unordered, words
from .blocking import Channel

name, addr, name_a, addr_a, name_q, addr_q = (same(c) for c in ("name", "addr", "name_a", "addr_a", "name_q", "addr_q"))
nt, at_, house, postal, stripped = same("nt"), same("att"), same("house"), same("postal"), same("stripped")
name_words, address_words = split(name), split(addr)
lead_digits = extract(addr, r"^(\d+)")
stripped_tokens = split(stripped)
_L, STOP, LONG, ASTOP = vocab.BRAND_LEGAL, vocab.NAME_STOP, vocab.NAME_STOP_LONG, vocab.ADDRESS_STOP


def long(text: X, n: int) -> X:
    return fill(f"length({{0}}) >= {n}", text)


def many(items: X, n: int) -> X:
    return fill(f"{{0}} >= {n}", size(items))


def brand(n: int, stop: tuple[str, ...] = STOP) -> X:
    return words(nt, n, stop)


def places(n: int, stop: tuple[str, ...] = ()) -> X:
    return words(at_, n, stop, digits=False)


def top_two(n: int) -> X:
    """The two lexicographically last address words, as one key."""
    two = head(sort(places(n, ASTOP), descending=True), 2)
    return unordered(at(two, 1), at(two, 2))


unit = extract(addr_a, vocab.UNIT_PATTERN)
plot = replace_all(extract(addr_a, vocab.PLOT_PATTERN), "^([a-z]?)0+([1-9])", r"\1\2")
plot = X(plot.spark.replace(r"\1\2", "$1$2"), plot.duck)
leet_words = words(split(X("translate(name_a, '051', 'osl')", "translate(name_a, '051', 'osl')")), 4)
number = extract(addr_a, r"\b(\d{3,6})\b")
grams = listed(*(fill(f"substring({{0}}, {i}, 4)", name_q) for i in (1, 2, 3)))
street_number = fill("{0}", at(same("nums"), 1))
zero_house = X(f"trim(LEADING '0' FROM {street_number.spark})", f"ltrim({street_number.duck}, '0')")
prefixes = sort(X(f"transform({brand(4).spark}, w -> substring(w, 1, 4))", f"list_transform({brand(4).duck}, lambda w: substring(w, 1, 4))"))

_first, _second, _last = at(name_words, 1), at(name_words, 2), at(name_words, -1)
_p3, _p4 = prefix(name, 3), prefix(name, 4)
_sq3, _sq4 = prefix(name_q, 3), prefix(name_q, 4)
B, D = "parts", "documents"
tok = same("tok")


def _token(n: int) -> X:
    return same(f"length(tok) >= {n}")


def catalogue() -> list[Channel]:
    """Every channel, named by what it pairs on."""
    C = Channel
    out = [
        # first generation: no country
        C("b01_exact_name", (name,), country=False, freq23=(1, 10**9)),
        C("b02_house_name8", (lead_digits, prefix(name, 8)), country=False, entities=B),
        C("b03_first_token_rare", (_first,), country=False, freq23=(1, 25)),
        C("b04_address_prefix12", (prefix(addr, 12),), country=False, guards=(long(addr, 1),), freq23=(1, 5)),
        C("b05_address_suffix12", (same("right(addr, 12)"),), country=False, guards=(long(addr, 1),), freq23=(1, 5)),
        C("b06_second_token_rare", (_second,), country=False, freq23=(1, 25)),
        C("b07_exact_address", (addr,), country=False, freq23=(1, 10)),
        C("b08_last_token_rare", (_last,), country=False, freq23=(1, 25)),
        C("b09_informative_token", (words(name_words, 1, vocab.GENERIC_TOKENS),), country=False, exploded=0, freq23=(1, 25)),
        # frequency-aware blocks
        C("b10_prefix4", (extract(name, r"^(\S{4})"),), freq23=(1, 50), freq_country=True),
        C("b11_first_token", (_first,), freq23=(1, 50), freq_country=True),
        C("b12_house_prefix4", (lead_digits, extract(name, r"^(\S{4})")), country=False, freq23=(1, 50), entities=B),
        C("b13_house_first_token", (lead_digits, _first), country=False, freq23=(1, 50), entities=B),
    ]
    out += [C(f"b14_prefix{n}_freq{f}", (prefix(name, n),), guards=(long(name, n),), freq23=(1, f), freq_country=True) for n in (3, 4) for f in (10, 25, 50, 100, 250, 500)]
    families = {
        "country_name3": ((_p3,), True, D), "country_name4": ((_p4,), True, D), "country_first": ((_first,), True, D), "house_name3": ((lead_digits, _p3), False, B),
        "house_name4": ((lead_digits, _p4), False, B), "house_first": ((lead_digits, _first), False, B), "first_last": ((_first, _last), False, D),
        "house_address5": ((lead_digits, prefix(addr, 5)), False, B), "country_address8": ((prefix(addr, 8),), True, D),
    }
    out += [C(f"b16_{n}_freq{f}", k, country=c, freq23=(1, f), freq_country=c, entities=e) for n, (k, c, e) in families.items() for f in (10, 25, 50, 100)]
    contained = distinct(name_words)
    sizes = (("length", fill("length({0})", replace_all(name, r"\s+", ""))), ("tokens", size(name_words)))
    b20 = dict(keys=(contained,), exploded=0, keys1=(_first,), exploded1=None, freq1=(1, 50), freq_country=True)
    out += [
        C("b20_containment", **b20),
        C("b21_containment_length4", **b20, carry=sizes, residual="abs(a_c_length - b_c_length) <= 4"),
        C("b23_containment_length2", **b20, carry=sizes, residual="abs(a_c_length - b_c_length) <= 2"),
        C("b24_containment_freq10", **(b20 | {"freq1": (1, 10)})),
        C("b25_containment_address5", **(b20 | {"keys": (contained, prefix(addr, 5)), "keys1": (_first, prefix(addr, 5)), "freq1": None})),
        C("b26_containment_same_tokens", **b20, carry=sizes, residual="abs(a_c_tokens - b_c_tokens) <= 0"),
        C("b26_containment_tokens2_length4", **b20, carry=sizes, residual="abs(a_c_tokens - b_c_tokens) <= 2 and abs(a_c_length - b_c_length) <= 4"),
        C("b27_contained_in_first", (_first,), keys1=(contained,), exploded1=0, freq23=(1, 50), freq_country=True),
        # capped channels of the fourth generation
        C("b30_squashed_name4", (_sq4,), guards=(long(name_q, 4),), cap=15),
        C("b30_first_token", (at(nt, 1),), guards=(long(at(nt, 1), 4),), cap=15),
        C("b30_postal_name3", (postal, _sq3), guards=(long(name_q, 3),), cap=20, entities=B),
        C("b30_house_name3", (house, _sq3), guards=(long(name_q, 3),), cap=15, entities=B),
        C("b30_house_address6", (house, prefix(addr_q, 6)), guards=(long(addr_q, 5),), cap=15, entities=B),
        C("b31_stripped_exact", (stripped,), country=False, guards=(long(stripped, 4),), cap=15),
        C("b32_stripped_first", (at(stripped_tokens, 1),), guards=(long(at(stripped_tokens, 1), 4),), cap=10),
        C("b33_stripped_second", (at(stripped_tokens, 2),), guards=(long(at(stripped_tokens, 2), 4),), cap=10),
        C("b34_postal_stripped_first", (postal, at(stripped_tokens, 1)), country=False, guards=(long(at(stripped_tokens, 1), 3),), cap=15, entities=B),
        C("b35_house_stripped_first", (house, at(stripped_tokens, 1)), country=False, guards=(long(at(stripped_tokens, 1), 3),), cap=15, entities=B),
        C("b36_house_postal", (house, postal), country=False, cap=10, entities=B),
        C("b37_address10", (prefix(addr_q, 10),), guards=(long(addr_q, 10),), cap=15),
        C("b38_positional_grams", (grams,), exploded=0, guards=(long(name_q, 5),), token_guard=_token(1), min_shared=2, cap=12),
        C("b39_address14", (prefix(addr_q, 14),), country=False, guards=(long(addr_q, 14),), cap=15),
        C("b39_name5_postal", (prefix(name_q, 5), postal), country=False, guards=(long(name_q, 5),), cap=15, entities=B),
        C("b39_name5_house", (prefix(name_q, 5), house), country=False, guards=(long(name_q, 5),), cap=15, entities=B),
        C("b41_sorted_brand_pair", (pair(at(sort(brand(3)), 1), at(sort(brand(3)), 2)),), cap=12),
        C("b42_rare_address_token7", (words(at_, 7, ASTOP),), exploded=0, freq23=(2, 15), cap=12),
        C("b43_house_postal56", (house, postal), country=False, cap=12, entities=B),
        C("b44_two_shared_address_tokens", (words(at_, 7, ASTOP),), exploded=0, min_shared=2, cap=15),
        C("b45_rare_address_token6", (words(at_, 6, ASTOP),), exploded=0, freq23=(2, 25), cap=12),
        C("b46_token_prefix_pair", (pair(at(prefixes, 1), at(prefixes, 2)),), cap=12),
        C("b47_first_two_brand", (pair(at(brand(3), 1), at(brand(3), 2)),), guards=(long(pair(at(brand(3), 1), at(brand(3), 2)), 7),), cap=15),
        C("b48_house_street8", (house, prefix(same("letters"), 8)), guards=(long(same("letters"), 8),), cap=12, entities=B),
        C("b49_rare_address_token5", (words(at_, 5, ASTOP),), exploded=0, freq23=(2, 10), cap=12),
        C("b50_clean_first", (at(brand(4), 1),), cap=15),
        C("b51_unit_word", (unit, at(places(5), 1)), guards=(long(unit, 2),), cap=12, entities="customers"),
        C("b52_street_pair_initial", (pair(at(places(3), 1), at(places(3), 2)), prefix(name_a, 1)), guards=(long(pair(at(places(3), 1), at(places(3), 2)), 8),), cap=12),
        C("b53_house_brand3", (house, prefix(name_a, 3)), guards=(long(name_a, 3),), cap=12, entities=B),
        C("b54_first_non_stop", (at(brand(4, LONG), 1),), cap=20),
        C("b55_second_non_stop", (at(brand(4, LONG), 2),), cap=20),
        C("b56_unordered_pair", (unordered(at(brand(3, LONG), 1), at(brand(3, LONG), 2)),), cap=15),
        C("b57_zero_house_street", (zero_house, at(places(5), 1)), cap=15, entities=B),
        C("b58_postal_brand3", (postal, prefix(name_a, 3)), guards=(long(name_a, 3),), cap=20, entities=B),
        C("b59_street_pair_initial", (pair(at(places(3), 1), at(places(3), 2)), prefix(name_a, 1)), guards=(long(pair(at(places(3), 1), at(places(3), 2)), 8),), cap=12),
        C("b60_unit_word", (unit, at(places(5), 1)), cap=12, entities="customers"),
        C("b61_rare_name_token", (words(nt, 5, LONG),), exploded=0, freq_all=(2, 150), cap=15),
        C("b62_squashed_brand", (joined(words(nt, 3, _L)),), guards=(long(joined(words(nt, 3, _L)), 6),), cap=15),
        C("b63_formerly", (at(words(split(same("former")), 4), 1),), guards=(long(same("former"), 4),), keys1=(at(words(nt, 4), 1),), guards1=()),
        C("b64_address_pair", (pair(at(places(4, ASTOP), 1), at(places(4, ASTOP), 2)),), guards=(long(pair(at(places(4, ASTOP), 1), at(places(4, ASTOP), 2)), 10),), cap=12),
        C("b65_leet_first", (at(leet_words, 1),), cap=15),
        C("b66_initials_number", (prefix(name_a, 2), number), guards=(long(name_a, 2), long(number, 3)), cap=15, entities=B),
        C("b67_street_triple", (pair(*(at(places(4, ASTOP), i) for i in (1, 2, 3))),), guards=(long(pair(*(at(places(4, ASTOP), i) for i in (1, 2, 3))), 14),), cap=12),
        C("b68_plot_word", (plot, at(places(5), 1)), guards=(long(plot, 1),), cap=12, entities="customers"),
        C("b69_house_locality", (house, places(6, ASTOP)), exploded=1, guards=(long(house, 1),), cap=15, entities=B),
        C("b70_top_two_address", (top_two(5),), cap=15),
        C("b71_first_two_words", (pair(at(brand(2), 1), at(brand(2), 2)),), cap=20),
        C("b71_first_two_unordered", (unordered(at(brand(2), 1), at(brand(2), 2)),), cap=20),
        C("b72_rare_address_word7", (words(at_, 7),), exploded=0, freq_all=(2, 15), freq_country=True, cap=15),
        C("b73_rare_prefix4", (prefix(name_a, 4),), guards=(long(name_a, 4),), freq_all=(2, 20), freq_country=True, cap=15),
        C("b74_house_postal", (house, postal), guards=(long(house, 2), long(postal, 4)), cap=15, entities=B),
        C("b75_rare_word_no_address", (words(nt, 5, vocab.NAME_STOP_RARE),), exploded=0, freq_all=(2, 25), freq_country=True, cap=15, guards=(same("addr_a in ('', 'none', 'nan')"),), guards1=(), entities="customers"),
        C("b76_rare_address_word", (places(7, ASTOP),), exploded=0, freq_all=(2, 20), freq_country=True, cap=15),
        C("b77_sorted_address", (joined(sort(distinct(places(5, ASTOP))), "_"),), guards=(many(distinct(places(5, ASTOP)), 2),), cap=15),
        C("b78_distinctive_name_token", (distinct(words(nt, 5, vocab.NAME_STOP_SHORT)),), exploded=0, cap=15),
        # full-scale channels, keys also bounded on the first source
        C("b80_top_two_address", (top_two(5),), freq1=(1, 50), freq_country=True, cap=15),
        C("b81_house_locality", (house, places(6, ASTOP)), exploded=1, guards=(long(house, 1),), freq1=(1, 50), freq_country=True, cap=15, entities=B),
        C("b82_address10", (prefix(addr_a, 10),), guards=(long(addr_a, 10),), freq1=(1, 50), freq_country=True, cap=15, unmatched=True),
        C("b83_brand_word6", (words(nt, 6, STOP),), exploded=0, freq1=(1, 30), freq_country=True, cap=15, unmatched=True),
        C("b84_postal_name3", (postal, prefix(name_a, 3)), guards=(long(name_a, 3), long(postal, 5)), freq1=(1, 50), freq_country=True, cap=15, unmatched=True, entities=B),
        C("b85a_sorted_address", (top_two(5),), freq1=(1, 30), freq_country=True, cap=10, prob=0.75, unmatched=True),
        C("b85b_house_word", (house, places(5, ASTOP)), exploded=1, guards=(long(house, 2),), freq1=(1, 30), freq_country=True, cap=10, prob=0.72, unmatched=True, entities=B),
        C("b85c_postal_name4", (postal, prefix(name_a, 4)), guards=(long(postal, 5), long(name_a, 4)), freq1=(1, 30), freq_country=True, cap=10, prob=0.70, unmatched=True, entities=B),
        C("b85d_address12", (prefix(addr_a, 12),), guards=(long(addr_a, 12),), freq1=(1, 20), freq_country=True, cap=10, prob=0.73, unmatched=True),
        C("b85e_brand_word7", (words(nt, 7, STOP),), exploded=0, freq1=(1, 20), freq_country=True, cap=10, prob=0.71, unmatched=True),
        C("b86_token_index", (words(nt, 4, STOP),), exploded=0, freq23=(1, 200), freq_country=True, freq_distinct=True, min_shared=2, cap=15, prob_by_shared=vocab.SHARED_PROBABILITY, unmatched=True),
        C("b87_ultra_rare_token", (words(nt, 6, STOP),), exploded=0, freq23=(1, 5), freq_country=True, freq_distinct=True, min_shared=1, cap=10, prob=0.80, unmatched=True),
        C("b88_postal_name5", (postal, prefix(name_a, 5)), guards=(long(postal, 5), long(name_a, 5)), freq1=(1, 20), freq_country=True, cap=10, prob=0.73, unmatched=True, entities=B),
        C("b88_house_name5", (house, prefix(name_a, 5)), guards=(long(name_a, 5),), freq1=(1, 20), freq_country=True, cap=10, prob=0.76, unmatched=True, entities=B),
        C("b88_sorted_address", (top_two(5),), freq1=(1, 30), freq_country=True, cap=10, prob=0.74),
        C("b89_house_street_word", (house, places(4)), exploded=1, freq1=(1, 50), freq_country=True, cap=15, unmatched=True, entities=B),
        C("b89_top_two_address", (top_two(5),), freq1=(1, 50), freq_country=True, cap=15, unmatched=True),
    ]
    # deterministic rules: country always
    p = vocab.RULE_PROBABILITY
    out += [
        C("r1_name_address", (name, addr), guards=(long(name, 4), long(addr, 4)), prob=p["R1"]),
        C("r2_name_address8", (name, prefix(addr, 8)), guards=(long(name, 4), long(addr, 8)), prob=p["R2"]),
        C("r3_address_name8", (addr, prefix(name, 8)), guards=(long(addr, 8), long(name, 8)), prob=p["R3"]),
        C("r4_address_name3", (addr, prefix(name, 3)), guards=(long(addr, 12), long(name, 3)), prob=p["R4"]),
        C("r5_name_address4", (name, prefix(addr, 4)), guards=(long(name, 6),), prob=p["R5"]),
        C("r6_address_initial", (addr, prefix(name, 1)), guards=(long(addr, 12),), prob=p["R6"]),
        C("r7_address", (addr,), guards=(long(addr, 12),), cap=5, prob=p["R7"]),
        C("r8_name6_address6", (prefix(name, 6), prefix(addr, 6)), guards=(long(name, 6), long(addr, 6)), cap=5, prob=p["R8"]),
        C("r9_name", (name,), guards=(long(name, 6),), cap=5, prob=p["R9"]),
    ]
    # the trade-name disjunction, as three equi-joins whose union is capped by trade_pairs
    trade = same("trade")
    out += [
        C("b40_trade_to_name", (stripped,), keys1=(trade,), guards=(long(stripped, 4),), guards1=(long(trade, 4),), entities="customers"),
        C("b40_trade_to_trade", (trade,), guards=(long(trade, 4),), entities="customers"),
        C("b40_name_to_trade", (trade,), keys1=(stripped,), guards=(long(trade, 4),), guards1=(long(stripped, 4),), entities="customers"),
    ]
    return out


def by_name() -> dict[str, Channel]:
    return {c.name: c for c in catalogue()}


def keep_condition(items: X, spark: str, duck: str) -> X:
    """A filtered list with its own condition over w."""
    return keep(items, X(spark, duck))
