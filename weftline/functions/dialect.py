"""Key expressions kept as a pair of SQL texts, one for Spark and one for the DuckDB oracle.

Most scalar SQL is shared; the helpers below cover what differs (lambdas, list access, regex flags)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class X:
    """One expression in both dialects."""

    spark: str
    duck: str

    def __str__(self) -> str:
        return self.spark


def same(text: str) -> X:
    """SQL that both engines read alike."""
    return X(text, text)


def fill(template: str, *parts: X) -> X:
    """``template`` with {0}, {1}.. replaced by the parts in each dialect."""
    return X(template.format(*(p.spark for p in parts)), template.format(*(p.duck for p in parts)))


def replace_all(text: X, pattern: str, by: str) -> X:
    quoted = pattern.replace("'", "''")
    return X(f"regexp_replace({text.spark}, r'{pattern}', '{by}')", f"regexp_replace({text.duck}, '{quoted}', '{by}', 'g')")


def extract(text: X, pattern: str, group: int = 1) -> X:
    quoted = pattern.replace("'", "''")
    return X(f"regexp_extract({text.spark}, r'{pattern}', {group})", f"regexp_extract({text.duck}, '{quoted}', {group})")


def split(text: X, by: str = " ") -> X:
    return X(f"split({text.spark}, '{by}', -1)", f"string_split({text.duck}, '{by}')")


def quoted_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def keep(items: X, condition: X) -> X:
    """Filter a list; the condition names the element w."""
    return X(f"filter({items.spark}, w -> {condition.spark})", f"list_filter({items.duck}, lambda w: {condition.duck})")


def words(items: X, least: int = 1, stop: tuple[str, ...] = (), digits: bool = True) -> X:
    """Tokens of at least ``least`` characters, outside ``stop``, and unless ``digits`` not starting with one."""
    spark, duck = [f"length(w) >= {least}"], [f"length(w) >= {least}"]
    if stop:
        spark.append(f"w not in {quoted_list(stop)}")
        duck.append(f"w not in {quoted_list(stop)}")
    if not digits:
        spark.append("not w rlike '^[0-9]'")
        duck.append("not regexp_matches(w, '^[0-9]')")
    return keep(items, X(" and ".join(spark), " and ".join(duck)))


def at(items: X, n: int) -> X:
    """n-th element from 1, from the end if negative; null out of range."""
    if n > 0:
        return X(f"get({items.spark}, {n - 1})", f"({items.duck})[{n}]")
    return X(f"try_element_at({items.spark}, {n})", f"({items.duck})[{n}]")


def sort(items: X, descending: bool = False) -> X:
    if descending:
        return X(f"sort_array({items.spark}, false)", f"list_reverse_sort({items.duck})")
    return X(f"sort_array({items.spark})", f"list_sort({items.duck})")


def head(items: X, n: int) -> X:
    return X(f"slice({items.spark}, 1, {n})", f"list_slice({items.duck}, 1, {n})")


def size(items: X) -> X:
    return X(f"size({items.spark})", f"len({items.duck})")


def joined(items: X, by: str = "") -> X:
    return X(f"array_join({items.spark}, '{by}')", f"array_to_string({items.duck}, '{by}')")


def listed(*parts: X) -> X:
    return X("array(" + ", ".join(p.spark for p in parts) + ")", "[" + ", ".join(p.duck for p in parts) + "]")


def pair(a: X, b: X, *more: X) -> X:
    """Parts joined by _, null if any is."""
    out = fill("({0} || '_' || {1})", a, b)
    for m in more:
        out = fill("({0} || '_' || {1})", out, m)
    return out


def unordered(a: X, b: X) -> X:
    """Two tokens as one key, whatever their order."""
    return pair(fill("least({0}, {1})", a, b), fill("greatest({0}, {1})", a, b))


def distinct(items: X) -> X:
    return X(f"array_distinct({items.spark})", f"list_distinct({items.duck})")


def prefix(text: X, n: int) -> X:
    return fill(f"substring({{0}}, 1, {n})", text)
