"""String and name expressions: symbols, founding years, headquarters, column-name parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from crosstide.functions.numeric import as_col

# US state -> census region.
STATE_REGION = {
    "Alabama": "South", "Alaska": "West", "Arizona": "West", "Arkansas": "South",
    "California": "West", "Colorado": "West", "Connecticut": "Northeast", "Delaware": "South",
    "Florida": "South", "Georgia": "South", "Hawaii": "West", "Idaho": "West",
    "Illinois": "Midwest", "Indiana": "Midwest", "Iowa": "Midwest", "Kansas": "Midwest",
    "Kentucky": "South", "Louisiana": "South", "Maine": "Northeast", "Maryland": "South",
    "Massachusetts": "Northeast", "Michigan": "Midwest", "Minnesota": "Midwest",
    "Mississippi": "South", "Missouri": "Midwest", "Montana": "West", "Nebraska": "Midwest",
    "Nevada": "West", "New Hampshire": "Northeast", "New Jersey": "Northeast",
    "New Mexico": "West", "New York": "Northeast", "North Carolina": "South",
    "North Dakota": "Midwest", "Ohio": "Midwest", "Oklahoma": "South", "Oregon": "West",
    "Pennsylvania": "Northeast", "Rhode Island": "Northeast", "South Carolina": "South",
    "South Dakota": "Midwest", "Tennessee": "South", "Texas": "South", "Utah": "West",
    "Vermont": "Northeast", "Virginia": "South", "Washington": "West",
    "West Virginia": "South", "Wisconsin": "Midwest", "Wyoming": "West",
}
UNKNOWN = "Unknown"
YEAR_PATTERN = "((?:18|19|20)[0-9]{2})"
TARGET_PATTERN = r"^target_(.+)_fwd_(\d+)d$"


def clean_symbol(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c).cast("string")))


def years_in(text: Column | str) -> Column:
    """All years 18xx-20xx in reading order."""
    found = F.regexp_extract_all(as_col(text), F.lit(YEAR_PATTERN), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))


def first_year(text: Column | str) -> Column:
    return F.get(years_in(text), F.lit(0))


def earliest_year(text: Column | str) -> Column:
    return F.array_min(years_in(text))


def headquarters_parts(text: Column | str) -> dict[str, Column]:
    """City, state-or-country and region; blank text is unknown, a lone part has no state."""
    text = F.trim(as_col(text))
    blank = text.isNull() | (text == "") | (F.lower(text) == "nan")
    parts = F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda p: p != "")
    region_of = F.create_map(*[F.lit(v) for pair in STATE_REGION.items() for v in pair])
    state = F.when(blank | (F.size(parts) < 2), UNKNOWN).otherwise(F.element_at(parts, -1))
    return {
        "hq_city": F.when(blank, UNKNOWN).otherwise(
            F.coalesce(F.get(parts, F.lit(0)), F.lit(UNKNOWN))),
        "hq_state": state,
        "hq_region": F.when(state == UNKNOWN, UNKNOWN).otherwise(
            F.coalesce(region_of[state], F.lit("Non-US"))),
    }


def horizon_of(name: Column | str) -> Column:
    """Forward horizon in a label name, NULL when the name carries none."""
    digits = F.regexp_extract(as_col(name), r"_fwd_(\d+)d$", 1)
    return F.when(digits != "", digits).cast("int")


def family_of(name: Column | str) -> Column:
    family = F.regexp_extract(as_col(name), TARGET_PATTERN, 1)
    return F.when(family != "", family).otherwise("unknown")


def agreed_horizon(*names: str) -> int:
    """The one horizon that all label names carry; raises when absent or different."""
    found = {name: re.search(r"_fwd_(\d+)d$", name) for name in names}
    bare = [name for name, m in found.items() if m is None]
    if bare:
        raise ValueError(f"no forward horizon in {bare}")
    horizons = {int(m.group(1)) for m in found.values()}
    if len(horizons) > 1:
        raise ValueError(f"label horizons differ: {sorted(horizons)} in {names}")
    return horizons.pop()


def largest_lookback(name: Column | str) -> Column:
    """Largest ``{n}d`` token of a feature name, NULL when it has none."""
    days = F.regexp_extract_all(as_col(name), F.lit(r"(?<![0-9])([0-9]+)d(?![0-9])"), F.lit(1))
    return F.array_max(F.transform(days, lambda d: d.cast("int")))


def preferred_price(df: DataFrame) -> str:
    """Adjusted close when the table has one."""
    return "adj_close" if "adj_close" in df.columns else "close"
