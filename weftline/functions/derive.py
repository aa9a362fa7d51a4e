"""Derived entity columns: normal forms, tokens and anchors, each as a dialect pair in order of dependency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .dialect import X, extract, fill, keep, replace_all, same, split

_raw_name, _raw_addr = same("coalesce(business_name, '')"), same("coalesce(business_address, '')")


def simple(text: X) -> X:
    """Unicode-preserving normal form: lower case, & as and, letters, marks and digits kept, blanks squeezed."""
    out = replace_all(fill("replace(lower({0}), '&', ' and ')", text), r"[^\p{L}\p{N}\p{M}]+", " ")
    return fill("trim({0})", out)


def ascii_words(text: X) -> X:
    return fill("trim(lower({0}))", replace_all(text, "[^a-zA-Z0-9]+", " "))


def squashed(text: X) -> X:
    return fill("lower({0})", replace_all(text, "[^a-zA-Z0-9]+", ""))


_legal = r"\b(" + "|".join(vocab.STRIPPED_LEGAL) + r")\b"

COLUMNS: dict[str, X] = {
    "name": simple(_raw_name),
    "addr": simple(_raw_addr),
    "name_a": ascii_words(_raw_name),
    "addr_a": ascii_words(_raw_addr),
    "name_q": squashed(_raw_name),
    "addr_q": squashed(_raw_addr),
    "nt": split(same("name_a")),
    "att": split(same("addr_a")),
    "stripped": fill("trim({0})", replace_all(same("name_a"), _legal, "")),
    "house": fill("ltrim({0}, '0')", extract(same("addr_a"), vocab.HOUSE_PATTERN)),
    "postal": extract(same("addr_a"), vocab.POSTAL_PATTERN),
    "letters": fill("trim(lower({0}))", replace_all(_raw_addr, "[^a-zA-Z]+", " ")),
    "trade": fill("trim({0})", replace_all(ascii_words(extract(_raw_name, vocab.TRADE_PATTERN)), _legal, "")),
    "former": ascii_words(extract(_raw_name, vocab.FORMERLY_PATTERN)),
    "nums": keep(same("att"), X("w rlike '^[0-9]'", "regexp_matches(w, '^[0-9]')")),
}
# Spark's ltrim takes the characters first
COLUMNS["house"] = X(f"trim(LEADING '0' FROM {extract(same('addr_a'), vocab.HOUSE_PATTERN).spark})", COLUMNS["house"].duck)


def with_columns(entities: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """``entities`` with the derived columns (all, or those named and what they build on)."""
    wanted = set(COLUMNS if names is None else names)
    for name in reversed(COLUMNS):
        if name in wanted:
            wanted |= {n for n in COLUMNS if n != name and _uses(COLUMNS[name].spark, n)}
    out = entities
    for name, x in COLUMNS.items():
        if name in wanted:
            out = out.withColumn(name, F.expr(x.spark))
    return out


def _uses(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", re.sub(r"r?'(?:[^'])*'", "", sql)) is not None


def needed(*texts: str) -> tuple[str, ...]:
    """Derived columns that these Spark texts use."""
    return tuple(n for n in COLUMNS if any(_uses(t, n) for t in texts))


def duck_select(source: str) -> str:
    """The same columns as a DuckDB query over ``source``."""
    return f"select *, {', '.join(f'{x.duck} as {n}' for n, x in COLUMNS.items())} from {source}"
