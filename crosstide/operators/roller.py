"""Rolling statistics in O(log w) steps per row.

A sliding SQL frame visits ``w`` rows for every output row and every aggregate. Here each row
carries a mergeable state (count, mean, central moments, co-moments, or an extreme) of the last
1, 2, 4, 8 ... rows: a state of ``2m`` rows is the merge of the state at the row and the state
``m`` rows earlier, one ``lag`` away. A window of ``w`` rows is put together from the powers of
two in ``w`` along the way. All steps share one ``(key, order)`` window, so Spark plans one
shuffle and one sort, then about log2(w) streaming passes of plain arithmetic.

Merging central moments is numerically stable: a constant window has a variance of exactly 0.

    roll = Roller(df)
    df = roll.finish({"vol_20d": roll.std("ret_1d", 20, 10)})

States and merges are flat, non-null double columns written as SQL text: a family needs hundreds
of them, text is parsed once in the JVM, and the generated code stays small enough to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOMENTS = ["mean", "var", "tails"]                      # each extends the one before
FIELDS = {
    "mean": ["n", "m1"],
    "var": ["n", "m1", "m2"],
    "tails": ["n", "m1", "m2", "m3", "m4"],
    "pair": ["n", "mx", "my", "cxy", "mxx", "myy"],
    "max": ["n", "v"],
    "min": ["n", "v"],
}
# Merge rules for an older state {a} and a newer state {b}; {t} is the total count, at least 1.
MERGE = {
    "n": "{a}__n + {b}__n",
    "m1": "{a}__m1 + ({b}__m1 - {a}__m1) * {b}__n / {t}",
    "m2": "{a}__m2 + {b}__m2 + ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * {a}__n * {b}__n / {t}",
    "m3": "{a}__m3 + {b}__m3 + ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * {a}__n * {b}__n * ({a}__n - {b}__n) / ({t} * {t})"
          " + 3 * ({b}__m1 - {a}__m1) * ({a}__n * {b}__m2 - {b}__n * {a}__m2) / {t}",
    "m4": "{a}__m4 + {b}__m4 + ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * {a}__n * {b}__n"
          " * ({a}__n * {a}__n - {a}__n * {b}__n + {b}__n * {b}__n) / ({t} * {t} * {t})"
          " + 6 * ({b}__m1 - {a}__m1) * ({b}__m1 - {a}__m1) * ({a}__n * {a}__n * {b}__m2 + {b}__n * {b}__n * {a}__m2) / ({t} * {t})"
          " + 4 * ({b}__m1 - {a}__m1) * ({a}__n * {b}__m3 - {b}__n * {a}__m3) / {t}",
    "mx": "{a}__mx + ({b}__mx - {a}__mx) * {b}__n / {t}",
    "my": "{a}__my + ({b}__my - {a}__my) * {b}__n / {t}",
    "cxy": "{a}__cxy + {b}__cxy + ({b}__mx - {a}__mx) * ({b}__my - {a}__my) * {a}__n * {b}__n / {t}",
    "mxx": "{a}__mxx + {b}__mxx + ({b}__mx - {a}__mx) * ({b}__mx - {a}__mx) * {a}__n * {b}__n / {t}",
    "myy": "{a}__myy + {b}__myy + ({b}__my - {a}__my) * ({b}__my - {a}__my) * {a}__n * {b}__n / {t}",
}


def _merge(kind: str, a: str, b: str) -> dict[str, str]:
    if kind in ("max", "min"):
        pick = "greatest" if kind == "max" else "least"
        return {"n": f"{a}__n + {b}__n", "v": f"{pick}({a}__v, {b}__v)"}
    total = f"greatest({a}__n + {b}__n, 1D)"
    return {f: MERGE[f].format(a=a, b=b, t=total) for f in FIELDS[kind]}


def _start(kind: str, x: str, y: str | None) -> dict[str, str]:
    if kind in ("max", "min"):
        return {"n": f"if({x} is null, 0D, 1D)", "v": x}
    if kind == "pair":
        gap = f"{x} is null or {y} is null"
        known = {"n": f"if({gap}, 0D, 1D)", "mx": f"if({gap}, 0D, coalesce({x}, 0D))",
                 "my": f"if({gap}, 0D, coalesce({y}, 0D))"}
    else:
        known = {"n": f"if({x} is null, 0D, 1D)", "m1": f"coalesce({x}, 0D)"}
    return {f: known.get(f, "0D") for f in FIELDS[kind]}


class Roller:
    """Collects the windows a family needs, then adds them to the frame in one go.

    A series is a column name, or ``(name, Column)`` for an expression.
    """

    def __init__(self, df: DataFrame, key: str = "symbol", order: str = "date"):
        self.df = df
        self.over = f"over (partition by {key} order by {order})"
        self.inputs: dict[str, Column] = {}
        self.series: dict[str, dict] = {}

    # -- requests ---------------------------------------------------------------------------

    def _input(self, x: str | tuple[str, Column]) -> str:
        name, value = (x, F.col(x)) if isinstance(x, str) else x
        self.inputs.setdefault(f"_x_{name}", value.cast("double"))
        return f"_x_{name}"

    def _want(self, kind: str, w: int, x: str, y: str | None = None) -> str:
        family = "mom" if kind in MOMENTS else kind
        name = f"{family}{x}" + (y or "")
        entry = self.series.setdefault(name, {"kind": kind, "x": x, "y": y, "windows": set()})
        if kind in MOMENTS and MOMENTS.index(kind) > MOMENTS.index(entry["kind"]):
            entry["kind"] = kind
        entry["windows"].add(w)
        return f"_acc_{name}_{w}"

    def count(self, x, w: int) -> Column:
        return F.expr(f"{self._want('mean', w, self._input(x))}__n")

    def mean(self, x, w: int, need: int) -> Column:
        s = self._want("mean", w, self._input(x))
        return F.expr(f"case when {s}__n >= {need} then {s}__m1 end")

    def var(self, x, w: int, need: int) -> Column:
        s = self._want("var", w, self._input(x))
        return F.expr(f"case when {s}__n >= {max(2, need)} then {s}__m2 / ({s}__n - 1) end")

    def std(self, x, w: int, need: int) -> Column:
        s = self._want("var", w, self._input(x))
        return F.expr(f"case when {s}__n >= {max(2, need)} then sqrt({s}__m2 / ({s}__n - 1)) end")

    def zscore(self, x, w: int, need: int) -> Column:
        i = self._input(x)
        s = self._want("var", w, i)
        return F.expr(f"case when {s}__n >= {max(2, need)} then "
                      f"try_divide({i} - {s}__m1, sqrt({s}__m2 / ({s}__n - 1))) end")

    def skewness(self, x, w: int, need: int) -> Column:
        """Bias-corrected; NULL on a constant window."""
        s = self._want("tails", w, self._input(x))
        return F.expr(f"case when {s}__n >= {max(3, need)} then try_divide(sqrt({s}__n * ({s}__n - 1)) "
                      f"* sqrt({s}__n) * {s}__m3, ({s}__n - 2) * power({s}__m2, 1.5D)) end")

    def kurtosis(self, x, w: int, need: int) -> Column:
        """Bias-corrected excess; NULL on a constant window."""
        s = self._want("tails", w, self._input(x))
        return F.expr(f"case when {s}__n >= {max(4, need)} then ({s}__n - 1) / (({s}__n - 2) * ({s}__n - 3)) * "
                      f"(({s}__n + 1) * (try_divide({s}__n * {s}__m4, {s}__m2 * {s}__m2) - 3) + 6) end")

    def max(self, x, w: int, need: int) -> Column:
        s = self._want("max", w, self._input(x))
        return F.expr(f"case when {s}__n >= {need} then {s}__v end")

    def min(self, x, w: int, need: int) -> Column:
        s = self._want("min", w, self._input(x))
        return F.expr(f"case when {s}__n >= {need} then {s}__v end")

    def cov(self, x, y, w: int, need: int) -> Column:
        """Sample covariance over complete pairs."""
        s = self._want("pair", w, self._input(x), self._input(y))
        return F.expr(f"case when {s}__n >= {max(2, need)} then {s}__cxy / ({s}__n - 1) end")

    def corr(self, x, y, w: int, need: int) -> Column:
        """Correlation over complete pairs; NULL when a side is constant."""
        s = self._want("pair", w, self._input(x), self._input(y))
        return F.expr(f"case when {s}__n >= {max(2, need)} then "
                      f"try_divide({s}__cxy, sqrt({s}__mxx) * sqrt({s}__myy)) end")

    # -- evaluation -------------------------------------------------------------------------

    def finish(self, columns: dict[str, Column]) -> DataFrame:
        """Evaluate the requested windows, add ``columns`` and drop the states."""
        keep = self.df.columns
        df = self.df.select("*", *[c.alias(n) for n, c in self.inputs.items()])
        df = df.selectExpr("*", *[f"{sql} as _cur_{s}__{f}" for s, e in self.series.items()
                                  for f, sql in _start(e["kind"], e["x"], e["y"]).items()])
        widest = max((max(e["windows"]) for e in self.series.values()), default=0)
        step = 1
        while step <= widest:
            lags: dict[str, str] = {}
            merges: dict[str, str] = {}
            done = set()
            for s, e in self.series.items():
                kind, cur = e["kind"], f"_cur_{s}"

                def earlier(state: str) -> str:
                    for f in FIELDS[kind]:
                        empty = "" if f == "v" else ", 0D"
                        lags[f"_old{state}__{f}"] = f"lag({state}__{f}, {step}{empty}) {self.over}"
                    return f"_old{state}"

                def put(state: str, fields: dict[str, str]) -> None:
                    merges.update({f"{state}__{f}": sql for f, sql in fields.items()})

                for w in sorted(e["windows"]):
                    if not w & step:
                        continue
                    acc = f"_acc_{s}_{w}"
                    if w & (step - 1):                  # rows already gathered from lower bits
                        put(acc, _merge(kind, earlier(acc), cur))
                    else:
                        put(acc, {f: f"{cur}__{f}" for f in FIELDS[kind]})
                if max(e["windows"]) >= 2 * step:
                    put(cur, _merge(kind, earlier(cur), cur))
                elif max(e["windows"]) >= step:
                    done.update(f"{cur}__{f}" for f in FIELDS[kind])
            if lags:
                df = df.selectExpr("*", *[f"{sql} as {n}" for n, sql in lags.items()])
            rest = [c for c in df.columns if c not in lags and c not in merges and c not in done]
            df = df.selectExpr(*[f"`{c}`" for c in rest], *[f"{sql} as {n}" for n, sql in merges.items()])
            step *= 2
        return df.select(*keep, *[c.alias(n) for n, c in columns.items()])
