"""Matching contracts to events from their texts: an alias index, signals, pairs in time, and one outcome with its method.

Aliases of all teams are one table. A text's word runs (up to the longest alias) and upper-case tokens are joined to it by equality, so no text meets every
alias. Pairs of signalled teams meet events through time buckets: events outside the window all have the same score, so for
them it is enough to know that the pair has some. Of those inside, each score's number and first event are enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators.matching import confidence, temporal_score

# Quality of an alias by where it comes from.
QUALITY = {"full_name": "1.00", "nickname": "0.95", "curated": "0.95", "abbreviation": "0.90", "city": "0.75"}
# Distance up to which a pair at its own time counts as exact.
EXACT_SECONDS = 3 * 3600


@dataclass(frozen=True)
class League:
    """Words that a league's texts are read by. Texts with a phrase of another sport are not matched; some aliases count only with a phrase of the league."""

    context: tuple[str, ...]
    others: tuple[str, ...]
    nicknames_in_context: tuple[str, ...] = ()
    curated: tuple[tuple[str, str, bool], ...] = ()  # abbreviation, alias, only in context
    other_abbreviations: tuple[tuple[str, str], ...] = ()
    ambiguous_cities: tuple[str, ...] = ()
    city_quality: str = QUALITY["city"]
    guard: str | None = None  # tokens in this pattern are no abbreviations


# Phrases and aliases of the basketball league.
BASKETBALL = League(
    context=("nba", "basketball game", "pro basketball", "national basketball association"),
    others=(
        "college basketball", "ncaa", "women s basketball", "wnba", "pro football", "football game", "nfl", "pro baseball", "baseball game", "mlb", "pro soccer",
        "soccer game", "mls", "usl", "hockey", "nhl",
    ),
    nicknames_in_context=("heat", "jazz", "kings", "magic", "nets", "suns", "thunder"),
    curated=(
        ("BKN", "bk nets", False), ("GSW", "dubs", False), ("LAC", "la clippers", False), ("LAL", "la lakers", False), ("NOP", "nola pelicans", False), ("NYK", "ny knicks", False),
        ("OKC", "okc thunder", False), ("OKC", "okc", True), ("PHI", "sixers", False), ("PHI", "philly 76ers", False), ("PHX", "phx suns", False), ("POR", "blazers", False),
        ("SAS", "sa spurs", False),
    ),
)


@dataclass(frozen=True)
class Policy:
    least: str = "0.90"
    margin: str = "0.10"
    window_hours: int = 36


def alias_index(teams: DataFrame, league: League) -> DataFrame:
    """team_id, alias, source, quality, in_context: aliases that belong to one team alone. teams: team_id, abbreviation, city, name, full_name."""

    def row(source: str, alias: Column, in_context: Column | bool, quality: str | None = None) -> Column:
        return F.struct(F.lit(source).alias("source"), alias.alias("raw"), F.lit(quality or QUALITY[source]).cast("decimal(5,4)").alias("quality"), (in_context if isinstance(in_context, Column) else F.lit(in_context)).alias("in_context"))

    key = F.upper("abbreviation")
    own = [
        row("full_name", F.col("full_name"), False),
        row("nickname", F.col("name"), F.lower("name").isin(*league.nicknames_in_context)),
        row("abbreviation", F.col("abbreviation"), True),
        row("city", F.when(~F.lower("city").isin(*league.ambiguous_cities), F.col("city")), True, league.city_quality),
    ]
    own += [row("curated", F.when(key == a, F.lit(alias)), only) for a, alias, only in league.curated]
    own += [row("abbreviation", F.when(key == a, F.lit(alias)), True) for a, alias in league.other_abbreviations]
    rows = teams.select("team_id", F.explode(F.array(*own)).alias("s")).select("team_id", "s.*").withColumn("alias", text.normalize(F.col("raw"))).filter("alias <> ''").drop("raw")
    owners = rows.groupBy("alias").agg(F.count_distinct("team_id").alias("owners")).filter("owners = 1")
    return rows.join(owners.select("alias"), "alias")


def readable(markets: DataFrame, fields: list[str], league: League) -> DataFrame:
    """markets with original (their texts, joined), plain (its normal form), in_context and other_sport."""
    rows = markets.withColumn("original", F.concat_ws(" ", *fields)).withColumn("plain", text.normalize(F.col("original")))
    some = lambda phrases: text.any_phrase(F.col("plain"), list(phrases)) if phrases else F.lit(False)
    return rows.withColumns({"in_context": some(league.context), "other_sport": some(league.others)})


def signals(markets: DataFrame, aliases: DataFrame, league: League, longest: int) -> DataFrame:
    """market_id, team_id, alias, source, quality: each team's strongest alias in each text. longest: words of the longest alias.

    markets: readable(). Equal qualities go by the later source and alias in the alphabet.
    """
    words = F.split("plain", " ")
    runs = []
    for n in range(1, longest + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        runs.append(F.transform(starts, _run_of(words, n)))
    phrases = markets.select("market_id", "in_context", F.explode(F.array_distinct(F.concat(*runs))).alias("alias"))
    original = F.regexp_replace("original", league.guard, " ") if league.guard else F.col("original")
    tokens = F.array_distinct(F.regexp_extract_all(original, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    named = markets.select("market_id", "in_context", F.explode(tokens).alias("token"))
    codes = aliases.filter("source = 'abbreviation'").withColumn("token", F.upper("alias"))
    others = aliases.filter("source <> 'abbreviation'")
    usable = F.col("has") | ~F.col("in_context")
    columns = ["market_id", "team_id", "alias", "source", "quality"]
    hits = phrases.withColumnRenamed("in_context", "has").join(others, "alias").filter(usable).select(*columns)
    hits = hits.unionByName(named.withColumnRenamed("in_context", "has").join(codes, "token").filter(usable).select(*columns))
    best = hits.groupBy("market_id", "team_id").agg(F.max(F.struct("quality", "source", "alias")).alias("best"))
    return best.select("market_id", "team_id", "best.alias", "best.source", "best.quality")


def _run_of(words: Column, n: int):
    return lambda at: F.array_join(F.slice(words, at, F.lit(n)), " ")


def pairs_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(market_id, signals; market_id, a, b, team_score): how many teams a text names, and every pair of them with its score."""
    side = F.struct("team_id", "quality")
    per = found.groupBy("market_id").agg(F.sort_array(F.collect_list(side)).alias("teams"))  # a market's teams: at most all of a league
    left = per.select("market_id", "teams", F.posexplode("teams").alias("i", "x"))
    both = left.select("market_id", "x", F.explode(F.slice("teams", F.col("i") + 2, F.size("teams"))).alias("y"))
    score = F.round((F.col("x.quality") + F.col("y.quality")) / 2, 4).cast("decimal(5,4)")
    return per.select("market_id", F.size("teams").alias("signals")), both.select("market_id", F.col("x.team_id").alias("a"), F.col("y.team_id").alias("b"), score.alias("team_score"))


def near(pairs: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """Pairs with the events of the same teams within the window: market and event meet in time buckets, not in all pairs of the teams.

    pairs: market_id, a, b, team_score, at, from_close. events: event_id, a, b, starts_at. Adds event_id and gap (whole seconds).
    """
    width = hours * 3600
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    asked = pairs.filter(F.col("at").isNotNull()).withColumn("_bucket", F.explode(F.array(*[bucket("at") + d for d in (-1, 0, 1)])))
    held = events.withColumn("_bucket", bucket("starts_at"))
    gap = F.floor(F.abs(F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1_000_000).cast("long")
    return asked.join(held, ["a", "b", "_bucket"]).withColumn("gap", gap).filter(F.col("gap") <= width).drop("_bucket")


def tiers(asked: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """a, b, at, from_close, tiers: for each pair and time that is asked for, the temporal scores of the events within the window, each with the
    number of its events (n) and the first of them by id (event_id, gap).

    Events of one score differ by their ids only. Events that start together are one row, and so are markets of one pair and time, so that
    the work grows with the different times near each other and not with markets times events.
    """
    together = events.groupBy("a", "b", "starts_at").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
    found = near(asked.select("a", "b", "at", "from_close").distinct(), together, hours)
    of = found.groupBy("a", "b", "at", "from_close", temporal_score(F.col("gap"), F.col("from_close"), hours).alias("temporal"))
    rows = of.agg(F.min(F.struct("event_id", "gap")).alias("e"), F.sum("n").alias("n"))
    return rows.groupBy("a", "b", "at", "from_close").agg(F.collect_list(F.struct("temporal", "n", "e.event_id", "e.gap")).alias("tiers"))


def match(markets: DataFrame, teams: DataFrame, events: DataFrame, fields: list[str], league: League = BASKETBALL, policy: Policy = Policy(), longest: int = 4) -> DataFrame:
    """market_id, status, method, reason, confidence, event_id, margin, signals, near_events: one outcome a market, by precedence.

    markets: market_id, the text fields, occurrence_time, close_time. events: event_id, home, away, starts_at. An occurrence counts before a close.
    """
    rows = readable(markets, fields, league).withColumn("at", F.coalesce("occurrence_time", "close_time")).withColumn("from_close", F.col("occurrence_time").isNull())
    counted, pairs = pairs_of(signals(rows, alias_index(teams, league), league, longest))
    games = events.select("event_id", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), "starts_at")
    known = pairs.join(games.select("a", "b").distinct(), ["a", "b"], "left_semi").join(rows.select("market_id", "at", "from_close"), "market_id")
    without_time = confidence(F.col("team_score"), F.lit(0))
    base = known.groupBy("market_id").agg(F.max(without_time).alias("base"))  # what events outside the window score
    found = known.join(tiers(known, games, policy.window_hours), ["a", "b", "at", "from_close"]).select("market_id", "team_score", F.explode("tiers").alias("t"))
    row = F.struct((-confidence(F.col("team_score"), F.col("t.temporal"))).alias("less"), "t.event_id", "t.gap", "t.n")
    ranked = found.groupBy("market_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.sum("t.n").alias("near_events"))  # a few rows a pair of its teams
    first, next_ = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    best = ranked.select("market_id", first["event_id"].alias("best_id"), (-first["less"]).alias("best"), first["gap"].alias("gap"), F.when(first["n"] > 1, -first["less"]).otherwise(-next_["less"]).alias("second"), "near_events")
    out = rows.select("market_id", "other_sport", "at", "from_close").join(counted, "market_id", "left").join(base, "market_id", "left").join(best, "market_id", "left")
    out = out.fillna(0, ["signals", "near_events"]).withColumn("margin", F.col("best") - F.col("second"))
    least, margin = (F.lit(x).cast("decimal(5,4)") for x in (policy.least, policy.margin))
    reason = (
        F.when(F.col("other_sport"), "incompatible_sport_signal")
        .when(F.col("signals") < 2, "insufficient_team_evidence")
        .when(F.col("signals") > 2, "non_single_game_market")
        .when(F.col("base").isNull(), "no_team_pair_event")
        .when(F.col("at").isNull(), "team_pair_only")
        .when(F.col("best").isNull(), "date_mismatch")
        .when(F.col("best") < least, "low_confidence")
        .when(F.col("margin") < margin, "small_margin")
        .otherwise("matched")
    )
    out = out.withColumn("reason", reason)
    timed = F.when(~F.col("from_close") & (F.col("gap") <= EXACT_SECONDS), "exact_team_pair_and_time").otherwise("team_pair_and_time")
    decided = F.col("reason").isin("low_confidence", "small_margin", "matched")
    seen = F.col("signals") >= 2
    score = F.when(~F.col("other_sport") & seen, F.coalesce(F.greatest("base", "best"), F.lit(0))).otherwise(F.lit(0)).cast("decimal(5,4)")
    return out.select(
        "market_id",
        F.when(F.col("reason") == "matched", "matched").when(decided | (F.col("reason") == "team_pair_only"), "ambiguous").otherwise("unmatched").alias("status"),
        F.when(decided, timed).otherwise(F.col("reason")).alias("method"),
        "reason",
        score.alias("confidence"),
        F.when(F.col("reason") == "matched", F.col("best_id")).alias("event_id"),
        F.when(decided, F.coalesce("margin", F.lit(1)).cast("decimal(5,4)")).alias("margin"),
        "signals",
        "near_events",
    )
