"""DuckDB SQL of channels written out by hand from their definitions, independent of the channel records."""

from __future__ import annotations

from ..functions import vocab
from ..operators.resolve import FIRST, OTHER

ADDRESS, NAME = "business_address", "business_name"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _plain(column: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({column}, ''), '[^a-zA-Z0-9]+', ' ', 'g')))"


def _tokens(entities: str, column: str, test: str, one: str = "true", other: str = "true", distinct: str = "") -> str:
    """e: entities with their plain address; k: (id, co, one, tok) of tokens that pass ``test``."""
    return f"""e as (select entity_id as id, country as co, starts_with(entity_id, 'S1-') as one,
        {_plain(column)} as words, {_plain(ADDRESS)} as place from ({entities})),
      k as (select {distinct} id, co, one, tok from (select id, co, one, unnest(string_split(words, ' ')) as tok from e
        where case when one then {one} else {other} end) where {test})"""


def _capped(joined: str, cap: int, prob: str = "null::double") -> str:
    return f"select distinct {FIRST}, {OTHER}, {prob} as probability from (select *, count(*) over (partition by {FIRST}) as fan from ({joined})) where fan <= {cap}"


JOIN = f"select a.id as {FIRST}, b.id as {OTHER} from k a join k b on a.co = b.co and a.tok = b.tok"


def _address_rare_in_others(least: int, high: int, cap: int):
    """An address token that 2 to ``high`` rows of the other sources hold, in whatever country."""

    def sql(entities: str, matched: str) -> str:
        test = f"length(tok) >= {least} and tok not in {_in(vocab.ADDRESS_STOP)}"
        return f"with {_tokens(entities, ADDRESS, test)}, f as (select tok from k where not one group by tok having count(*) between 2 and {high}) " + _capped(
            f"{JOIN} join f on f.tok = a.tok where a.one and not b.one", cap
        )

    return sql


def _rare_in_country(column: str, test: str, high: int, other: str = "true"):
    """A token that 2 to ``high`` rows of both sides together hold within the country."""

    def sql(entities: str, matched: str) -> str:
        return f"with {_tokens(entities, column, test, other=other)}, f as (select co, tok from k group by co, tok having count(*) between 2 and {high}) " + _capped(
            f"{JOIN} join f on f.co = a.co and f.tok = a.tok where a.one and not b.one", 15
        )

    return sql


def _two_shared(entities: str, matched: str) -> str:
    test = f"length(tok) >= 7 and tok not in {_in(vocab.ADDRESS_STOP)}"
    return f"with {_tokens(entities, ADDRESS, test)} " + _capped(f"{JOIN} where a.one and not b.one group by 1, 2 having count(*) >= 2", 15)


def _prefix_rare(entities: str, matched: str) -> str:
    return f"""with e as (select entity_id as id, country as co, starts_with(entity_id, 'S1-') as one, {_plain(NAME)} as n from ({entities})),
      k as (select id, co, one, substring(n, 1, 4) as tok from e where length(n) >= 4),
      f as (select co, tok from k group by co, tok having count(*) between 2 and 20) """ + _capped(
        f"{JOIN} join f on f.co = a.co and f.tok = a.tok where a.one and not b.one", 15
    )


def _distinctive_name(entities: str, matched: str) -> str:
    test = f"length(tok) >= 5 and tok not in {_in(vocab.NAME_STOP_SHORT)}"
    return f"with {_tokens(entities, NAME, test, distinct='distinct')} " + _capped(f"{JOIN} where a.one and not b.one", 15)


def _address10(entities: str, matched: str) -> str:
    return f"""with e as (select entity_id as id, country as co, starts_with(entity_id, 'S1-') as one, {_plain(ADDRESS)} as n from ({entities})),
      done as ({matched}),
      k as (select id, co, one, substring(n, 1, 10) as tok from e where length(n) >= 10 and not (one and id in (select {FIRST} from done))),
      f as (select co, tok from k where one group by co, tok having count(*) <= 50) """ + _capped(
        f"{JOIN} join f on f.co = a.co and f.tok = a.tok where a.one and not b.one", 15
    )


def _token_index(entities: str, matched: str) -> str:
    test = f"length(tok) >= 4 and tok not in {_in(vocab.NAME_STOP)}"
    pairs = f"select a.id as {FIRST}, b.id as {OTHER}, count(*) as shared from k a join k b on a.co = b.co and a.tok = b.tok join f on f.co = a.co and f.tok = a.tok"
    return f"""with {_tokens(entities, NAME, test, one=f"id not in (select {FIRST} from ({matched}))")},
      f as (select co, tok from k where not one group by co, tok having count(distinct id) <= 200) """ + _capped(
        f"{pairs} where a.one and not b.one group by 1, 2 having count(*) >= 2", 15, "(case when shared >= 4 then 0.82 when shared >= 3 then 0.77 else 0.72 end)::double"
    )


_ADDRESS_WORD = f"length(tok) >= 7 and tok not in {_in(vocab.ADDRESS_STOP)} and not regexp_matches(tok, '^[0-9]')"
#: channel -> function of (entities SQL, SQL of the source-1 ids already matched)
BY_HAND = {
    "b42_rare_address_token7": _address_rare_in_others(7, 15, 12),
    "b44_two_shared_address_tokens": _two_shared,
    "b45_rare_address_token6": _address_rare_in_others(6, 25, 12),
    "b49_rare_address_token5": _address_rare_in_others(5, 10, 12),
    "b72_rare_address_word7": _rare_in_country(ADDRESS, "length(tok) >= 7", 15),
    "b73_rare_prefix4": _prefix_rare,
    "b75_rare_word_no_address": _rare_in_country(NAME, f"length(tok) >= 5 and tok not in {_in(vocab.NAME_STOP_RARE)}", 25, "place in ('', 'none', 'nan')"),
    "b76_rare_address_word": _rare_in_country(ADDRESS, _ADDRESS_WORD, 20),
    "b78_distinctive_name_token": _distinctive_name,
    "b82_address10": _address10,
    "b86_token_index": _token_index,
}
