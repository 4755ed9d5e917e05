"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateframe.fixed_values import (
    EVENT_WEIGHTS,
    FULL_WEIGHT,
    MULTIPLIER_MAX,
    MULTIPLIER_MIN,
    NEUTRAL_WEIGHT,
    NO_GENRE,
    RECS_AT_FULL_WEIGHT,
    SCORE_MAX,
)


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def share(part: str | Column, whole: str | Column) -> Column:
    """part / whole as a double; null when there is nothing to divide by."""
    return col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0))


def percent(part: str | Column, whole: str | Column) -> Column:
    return share(part, whole) * 100


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def ladder(value: Column, steps: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """First label whose bound ``value`` exceeds, tried in the given order."""
    out = None
    for bound, label in steps:
        test = value > F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def sum_of(columns: Iterable[Column]) -> Column:
    total = None
    for column in columns:
        total = column if total is None else total + column
    return total


# --- movies -----------------------------------------------------------------

def genre_list(genres: str | Column) -> Column:
    """Pipe-separated genres as a trimmed array; empty for null, blank or the sentinel."""
    text = F.trim(col(genres))
    parts = F.filter(
        F.transform(F.split(text, r"\|"), lambda g: F.trim(g)),
        lambda g: F.length(g) > 0,
    )
    missing = text.isNull() | (text == "") | (text == NO_GENRE)
    return F.when(missing, F.array().cast("array<string>")).otherwise(parts)


def raw_genre_terms(genres: str | Column) -> Column:
    """Genres as written between the pipes, without empty terms and the sentinel."""
    return F.filter(
        F.split(col(genres), r"\|"),
        lambda g: (g != NO_GENRE) & (F.length(g) > 0),
    )


# --- metric keys and values ---------------------------------------------------

def key_part(label: str, when_null: str, when_empty: str) -> str:
    """Data-derived part of a metric key as SQL text: letters and digits only, lower case."""
    cleaned = f"lower(regexp_replace({label}, '[^a-zA-Z0-9]', ''))"
    return f"case when {label} is null then '{when_null}' when {cleaned} = '' then '{when_empty}' else {cleaned} end"


def numeric_value(raw: str | Column) -> Column:
    """Number in a stored metric: plain, {"$numberLong": n} or {"$date": iso}; else 0.

    Dates count as epoch milliseconds.
    """
    text = col(raw)
    as_long = F.get_json_object(text, "$['$numberLong']").try_cast("bigint").cast("double")
    as_date = F.unix_millis(F.try_to_timestamp(F.get_json_object(text, "$['$date']"))).cast("double")
    return F.coalesce(as_long, as_date, text.try_cast("double"), F.lit(0.0))


# --- interaction events -------------------------------------------------------

def event_type_name(raw: str | Column) -> Column:
    """Upper case with underscores; anything not in the list is UNKNOWN."""
    name = F.replace(F.upper(col(raw)), F.lit("-"), F.lit("_"))
    return F.when(name.isin(*EVENT_WEIGHTS), name).otherwise(F.lit("UNKNOWN"))


def event_weight(type_name: str | Column) -> Column:
    """A lookup in a constant map, so a filter on the weight evaluates the name only once."""
    weights = F.create_map(*[F.lit(x) for pair in EVENT_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, col(type_name)), F.lit(0.0))


def rec_budget(weight: str | Column) -> Column:
    """How many neighbours an event of this weight asks for, at least one."""
    return F.greatest(
        F.lit(1), F.ceil(col(weight) * RECS_AT_FULL_WEIGHT / FULL_WEIGHT).cast("int")
    )


def score_multiplier(weight: str | Column) -> Column:
    return F.least(
        F.lit(MULTIPLIER_MAX), F.greatest(F.lit(MULTIPLIER_MIN), col(weight) / NEUTRAL_WEIGHT)
    )


def weighted_score(cosine: Column, weight: Column) -> Column:
    """Similarity on the five-point scale, scaled by event weight, at most 5."""
    return F.least(F.lit(SCORE_MAX), cosine * score_multiplier(weight) * SCORE_MAX)


# --- vectors ------------------------------------------------------------------

def vector_problem(features: str | Column) -> Column:
    """Why a vector cannot be stored; null when it can."""
    vector = col(features)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull(), F.lit("NULL_VECTOR"))
        .when(F.size(vector) == 0, F.lit("EMPTY_VECTOR"))
        .when(bad, F.lit("NON_FINITE_VALUE"))
    )


# --- presentation ---------------------------------------------------------------

def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns so that summation order cannot show in results."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {digits}) as `{f.name}`"
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )
