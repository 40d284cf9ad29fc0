"""Registered queries: a Spark builder, a column layout, and the SQL both engines must agree on.

The layout (``"date:d symbol:i vol_4d:6"``) is applied to both sides: ``d`` date as text, ``i``
64-bit integer, ``s`` text, ``b`` boolean as integer, ``e`` a double as text with seven significant
digits (values over many magnitudes; below 1e-9 it reads 0), a digit the decimals of a double. Rounding
first moves a value by a fixed fraction of the last kept digit, so that an exact half (a price in
cents divided by 8, say) does not depend on how an engine rounds halves.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosstide.session import tune

HALF_SHIFT = 0.13


@dataclass(frozen=True)
class Query:
    name: str
    layout: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(tune(spark), sf_dir), self.layout)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_ctes(present_sql(self.sql, self.layout))


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def query(name: str, layout: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, " ".join(layout.split()), build, sql)
        return build
    return register


def cte(name: str, sql: str) -> str:
    if name in CTES:
        raise ValueError(f"shared table {name} registered twice")
    CTES[name] = sql
    return name


def columns_of(layout: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in layout.split()]


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """``a * b`` and what its rounding took off, exactly (Dekker)."""
    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high
    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    return p, (((ah * bh - p) + ah * bl) + al * bh) + al * bl


def seven_digits(c: Column) -> Column:
    """A double as ``%.6e``, rounded as C does: its exact binary value, an exact half to the even digit.

    Java's formatter rounds the shortest decimal that names the double, and halves up. The two differ only where
    that decimal has eight digits and ends in 5, so a value is looked at closely only if eight digits and a 5 name it nearly.
    """
    scaled = F.abs(c) * F.pow(F.lit(10.0), 7 - F.floor(F.log10(F.abs(c)) - 1e-9)) / 5
    # few values meet this; the lambda keeps their long expression out of the code generated for a row
    exact = F.get(F.transform(F.array(c), _seven_digits), F.lit(0))
    return F.when(F.abs(scaled - F.rint(scaled)) < 1e-6, exact).otherwise(F.format_string("%.6e", c))


def _seven_digits(c: Column) -> Column:
    x = F.abs(c)
    power = F.lit(7) - F.floor(F.log10(x) - 1e-9).cast("int")
    tens = F.array(*[F.lit(10.0 ** i) for i in range(23)])
    up, down = (F.get(tens, F.greatest(F.lit(0), n).cast("int")) for n in (power, -power))
    text = F.format_string("%.7e", x)
    (left, left_rest), (right, right_rest) = _product(x, up), _product(F.rint(text.cast("double") * up / down), down)
    off = (left - right) + (left_rest - right_rest)
    lower = (off < 0) | ((off == 0) & F.substring(text, 8, 1).isin("0", "2", "4", "6", "8"))
    cut = (F.substring(text, 9, 1) == "5") & (text.cast("double") == x) & lower
    below = F.concat(F.when(c < 0, "-").otherwise(""), F.substring(text, 1, 8), F.substring(text, 10, 9))
    return F.when(cut, below).otherwise(F.format_string("%.6e", c))


def present(df: DataFrame, layout: str) -> DataFrame:
    out = []
    for name, kind in columns_of(layout):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("int").cast("long")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "e":
            c = c.cast("double")
            c = F.when(c.isNotNull(), seven_digits(F.when(F.abs(c) < 1e-9, 0.0).otherwise(c)))
        else:
            digits = int(kind)
            c = F.round(c.cast("double") + F.lit(HALF_SHIFT * 10.0 ** -digits), digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(sql: str, layout: str) -> str:
    out = []
    for name, kind in ((f'"{n}"', kind) for n, kind in columns_of(layout)):          # a name may be a word of SQL
        if kind == "d":
            e = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            e = f"cast({name} as bigint)"
        elif kind == "b":
            e = f"cast(cast({name} as int) as bigint)"
        elif kind == "s":
            e = f"cast({name} as varchar)"
        elif kind == "e":
            e = f"case when {name} is not null then format('{{:.6e}}', case when abs({name}) < 1e-9 then 0.0::double else {name}::double end) end"
        else:
            digits = int(kind)
            shift = f"{HALF_SHIFT * 10.0 ** -digits!r}::double"
            e = f"round(cast({name} as double) + {shift}, {digits}) + 0.0::double"
        out.append(f"{e} as {name}")
    return f"select {', '.join(out)} from (\n{sql}\n) as result"


def with_ctes(sql: str) -> str:
    """Prefix the shared tables a text refers to, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = [f"{name} as materialized (\n{CTES[name]}\n)" for name in CTES if name in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + sql


# -- small SQL writers --------------------------------------------------------------------------

def over(w: int, key: str = "symbol") -> str:
    part = f"partition by {key} " if key else ""
    return f"over ({part}order by date rows between {w - 1} preceding and current row)"


def roll(fn: str, x: str, w: int, need: int, key: str = "symbol") -> str:
    return f"case when count({x}) {over(w, key)} >= {need} then {fn}({x}) {over(w, key)} end"


def lagged(x: str, n: int, key: str = "symbol") -> str:
    part = f"partition by {key} " if key else ""
    return f"lag({x}, {n}) over ({part}order by date)"


def led(x: str, n: int) -> str:
    return f"lead({x}, {n}) over (partition by symbol order by date)"


def pct_rank_sql(x: str, keys: str, extra: str = "") -> str:
    """Average-tie rank as a share of the non-null count; NULL for a NULL value or key."""
    return (f"case when {x} is not null {extra} then (rank() over (partition by {keys} order by {x} nulls last) "
            f"+ (count(*) over (partition by {keys}, {x}) - 1) / 2.0::double) "
            f"/ count({x}) over (partition by {keys}) end")


def z_sql(x: str, keys: str) -> str:
    return f"({x} - avg({x}) over (partition by {keys})) / nullif(stddev_samp({x}) over (partition by {keys}), 0)"


def seeded_sql(seed: int, *parts: str) -> str:
    """``functions.numeric.seeded`` in SQL."""
    joined = " || ':' || ".join([f"'{seed}'", *[f"coalesce(cast({p} as varchar), '~')" for p in parts]])
    return f"cast(concat('0x', substr(md5({joined}), 1, 15)) as bigint)"
