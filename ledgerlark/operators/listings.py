"""Which listed contracts belong to a league: a likely one by its words, and a certain one by what the provider declares."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.text import tokens_found


@dataclass(frozen=True)
class Words:
    """A league's words. Names are looked for anywhere in a text, their last words, the abbreviations and the league's token between non-alphanumerics."""

    token: str
    series_mark: str  # anywhere in the series, event or event's text
    names: tuple[str, ...]
    abbreviations: tuple[str, ...]
    not_series: tuple[str, ...] = ()
    category: str = "sports"


@dataclass(frozen=True)
class Series:
    """A series of single-game winners as the provider declares it; shaped: ids and words must also have the form of a game."""

    league: str
    ticker: str
    competition: str | None = None
    shaped: bool = False


# Words of contracts that are no plain winner of one game.
NO_WINNER = (
    r"\b(?:spread|total|over|under|touchdowns?|yards?|passing|rushing|receiving|props?|periods?|quarters?|half|halves|halftime|regulation|1h|2h|q[1-4]|[1-4]q|first score|"
    r"super bowl|championship|playoffs?|division|conference|season|futures?|margin|wins? by)\b"
)
WINNER = r"\b(?:wins?|winner)\b"


def _joined(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))


def likely(series: Column, event_id: Column, event_text: Column, category: Column, title: Column, subtitle: Column, words: Words) -> Column:
    """Whether a contract is likely the league's: declared fields first, then its category, then its words: the league's token, or two teams."""
    declared, said = _joined(series, event_id, event_text), _joined(title, subtitle)
    last = [name.rsplit(" ", 1)[-1] for name in words.names]
    named = sum((((F.contains(said, F.lit(n.lower()))) | (tokens_found(said, [w]) > 0)).cast("int") for n, w in zip(words.names, last, strict=True)), F.lit(0))
    teams = (named >= 2) | (tokens_found(said, list(words.abbreviations)) >= 2) | (tokens_found(said, last) >= 2)
    other = F.coalesce(category != "", F.lit(False)) & (F.lower(category) != words.category)
    return (
        F.when(F.coalesce(series.isin(*words.not_series), F.lit(False)) if words.not_series else F.lit(False), F.lit(False))
        .when((tokens_found(declared, [words.token]) > 0) | F.contains(declared, F.lit(words.series_mark)), F.lit(True))
        .when(other, F.lit(False))
        .otherwise((tokens_found(said, [words.token]) > 0) | teams)
    )


def game_shaped(market_id: Column, event_id: Column, title: Column, texts: Column, ticker: str) -> Column:
    """Whether ids are those of a game and its side, the title speaks of a winner, and no text of any other kind of contract."""
    ids = event_id.rlike(rf"^{re.escape(ticker)}-[A-Z0-9]+\z") & F.startswith(market_id, F.concat(event_id, F.lit("-"))) & F.substring_index(market_id, "-", -1).rlike(r"^[A-Z]{2,3}\z")
    whole = F.length(market_id) == F.length(event_id) + 1 + F.length(F.substring_index(market_id, "-", -1))
    return ids & whole & title.rlike(f"(?i){WINNER}") & ~F.exists(F.filter(texts, lambda x: x.isNotNull()), lambda x: x.rlike(f"(?i){NO_WINNER}"))


def classified(c: dict[str, Column], series: list[Series], provider: str, category: str = "Sports") -> Column:
    """The league of a declared single-game winner; null for anything else.

    c: provider, category, market_type, series, event_id, market_id, scope, competition, title, texts (all texts, the title among them).
    """
    base = (c["provider"] == provider) & (c["category"] == category) & (F.lower(c["market_type"]) == "binary") & c["event_id"].isNotNull() & (c["scope"] == "Game")
    found = F.when(F.lit(False), F.lit(""))
    for s in series:
        fits = c["series"] == s.ticker
        if s.competition:
            fits = fits & (c["competition"] == s.competition)
        if s.shaped:
            fits = fits & game_shaped(c["market_id"], c["event_id"], c["title"], c["texts"], s.ticker)
        found = found.when(F.coalesce(base & fits, F.lit(False)), F.lit(s.league))
    return found
