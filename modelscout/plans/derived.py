"""A modelling table from titles and ratings, and the same steps for any pair of tables."""
from __future__ import annotations

from pyspark.sql import DataFrame

from modelscout.operators.prep import (
    Mean,
    WeightedMean,
    cast_columns,
    drop_incomplete,
    drop_sentinel,
    enrich,
    explode_delimited,
    filter_between,
    flag_at_least,
)

# Fixed values of the movie table: kept columns, year range, rating that counts as high.
TITLE_COLUMNS = ["tconst", "primaryTitle", "isAdult", "startYear", "runtimeMinutes", "genres"]
FIRST_YEAR, LAST_YEAR = "2010", "2022"
HIGH_RATING = 8


def rating_flags(df: DataFrame, rate: str, votes: str, names: tuple[str, str, str], high: float) -> DataFrame:
    """Three 1/0 targets: rate against its vote-weighted mean, votes against their mean, rate against a constant.

    The constant is taken as a weighted mean of itself, which only rounding can tell from the constant."""
    # all thresholds read the same plan, so Spark merges their subqueries into one aggregate
    out = flag_at_least(df, rate, WeightedMean(rate, votes), names[0], over=df)
    out = flag_at_least(out, votes, Mean(votes), names[1], over=df)
    return flag_at_least(out, rate, WeightedMean(high, votes), names[2], over=df)


def movie_flags(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per title and genre with its rating and the three flags."""
    kept = drop_sentinel(titles, ["startYear", "runtimeMinutes"])
    per_genre = drop_sentinel(explode_delimited(kept, "genres"), ["genres"])
    text_year = cast_columns(per_genre, {"startYear": "string"})
    in_range = filter_between(text_year, "startYear", FIRST_YEAR, LAST_YEAR).select(*TITLE_COLUMNS)
    rated = drop_incomplete(enrich(in_range, ratings, "tconst"))
    return rating_flags(
        rated, "averageRating", "numVotes", ("rateHighLow", "voteHighLow", "rateGreaterThan8"), HIGH_RATING
    )
