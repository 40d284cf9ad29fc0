"""Model fits and scores as Spark jobs over design tables.

Ridge fits come from mergeable sums. One pass over the training rows adds up the products of all columns (each feature
less a fixed centre, its missing mark, the labels and 1) per cell, a cell being the first of the expanding folds whose train
block holds the row. Prefix sums over the cells are every fold's sums; from them follow imputed means and deviations, normal equations
for any label and penalty, and so all folds and all runs of one design, without another pass. What reaches the
driver has the size of folds times columns squared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from crosstide.operators import splits
from crosstide.operators.ranking import quantile_table
from crosstide.operators.xsection import apply_scaler, liquidity_universe, scaler_table, winsorize
from crosstide.session import stage

# Default settings of the tree learners.
TREE_DEFAULTS = {"n_estimators": 350, "learning_rate": 0.04, "max_depth": 5, "min_child": 250, "subsample": 0.75}


def prepare_design(panel: DataFrame, features: list[str], *, liquidity: str | None = None, drop_share: float = 0.0,
                   winsor_share: float = 0.0) -> DataFrame:
    """Universe filter, then per-date clipping. The panel is staged once; both steps read it and join a small table per date to
    it, so every fit reads the staged rows and no further copy is written."""
    panel = stage(panel)
    if liquidity and drop_share > 0:
        panel = liquidity_universe(panel, liquidity, drop_share)
    if winsor_share > 0:
        panel = winsorize(panel, features, winsor_share)
    return panel


def scaled(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` imputed and scaled with statistics of ``train`` only."""
    return apply_scaler(rows, scaler_table(train, features, []), features, [])


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


@dataclass(frozen=True)
class Ridge:
    """A ridge fit on imputed, scaled features: ``coefficients`` belong to the scaled ones."""
    features: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for f, med, mean, dev, c in zip(self.features, *map(np.ndarray.tolist, (self.medians, self.means, self.deviations, self.coefficients)), strict=True):
            out = out + (F.coalesce(F.col(f).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(dev) * F.lit(c)
        return out


def _products(features: list[str], labels: list[str], centre: np.ndarray) -> Callable:
    """Per cell the upper triangle of the products of (1, labels, centred features, missing marks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: pc.fill_null(batch.column(c).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            x = np.column_stack([column(f) for f in features]) - centre
            missing = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), *[column(y) for y in labels], np.where(missing, 0.0, x), missing])
            cell = batch.column("_cell").to_numpy(zero_copy_only=False)
            for c in np.unique(cell).tolist():
                own = z[cell == c]
                sums[c] = sums.get(c, 0.0) + own.T @ own
        for c, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c)), pa.array(i), pa.array(j), pa.array(total[i, j])], ["cell", "i", "j", "value"])
    return run


def _solve(sums: np.ndarray, features: list[str], label: int, labels: int, medians: np.ndarray, centre: np.ndarray, alpha: float) -> Ridge:
    """The fit from summed products; ``sums`` has 1, the labels, the features and their marks."""
    p, n = len(features), sums[0, 0]
    x, m = slice(1 + labels, 1 + labels + p), slice(1 + labels + p, 1 + labels + 2 * p)
    fill = medians - centre                                 # what a missing value becomes, centred
    total = sums[0, x] + fill * sums[0, m]
    cross = sums[x, x] + fill[None, :] * sums[x, m] + fill[:, None] * sums[m, x] + fill[:, None] * fill[None, :] * sums[m, m]
    means = total / n
    covariance = cross / n - np.outer(means, means)
    spread = np.diag(covariance)
    deviations = np.sqrt(np.where(spread > 1e-14 * np.maximum(np.diag(cross) / n, 0.0), spread, 0.0))
    deviations[deviations == 0] = 1.0
    mean_y = sums[0, 1 + label] / n
    with_y = sums[x, 1 + label] + fill * sums[m, 1 + label] - n * means * mean_y
    left = n * covariance / np.outer(deviations, deviations) + alpha * np.eye(p)
    return Ridge(tuple(features), medians, means + centre, deviations, np.linalg.solve(left, with_y / deviations), float(mean_y))


def ridge_cells(rows: DataFrame, cells: int, features: list[str], runs: dict[str, tuple[str, float]]) -> list[dict[str, Ridge]]:
    """Per cell, the fits on all rows of ``_cell`` up to it. ``runs``: name -> (label, penalty); rows without all labels are left out.

    A cell without rows before it has no fits.
    """
    labels = list(dict.fromkeys(label for label, _ in runs.values()))
    rows = rows.select("_cell", *dict.fromkeys([*labels, *features])).dropna(subset=labels)
    folds = rows.withColumn("_fold", F.explode(F.sequence(F.col("_cell"), F.lit(cells - 1)))).drop("_cell")
    medians = {r["_fold"]: np.array([0.0 if r[f"{f}_q0"] is None else r[f"{f}_q0"] for f in features])
               for r in quantile_table(folds, ["_fold"], features, [0.5]).collect()}
    if not medians:
        return [{}] * cells
    centre = medians[max(medians)]
    size = 1 + len(labels) + 2 * len(features)
    own = np.zeros((cells, size, size))
    for r in rows.mapInArrow(_products(features, labels, centre), "cell long, i long, j long, value double").groupBy("cell", "i", "j").agg(
            F.sum("value").alias("value")).collect():
        own[r.cell, r.i, r.j] = own[r.cell, r.j, r.i] = r.value
    sums = own.cumsum(0)
    return [{name: _solve(sums[c], features, labels.index(label), len(labels), medians[c], centre, alpha) for name, (label, alpha) in runs.items()}
            if c in medians else {} for c in range(cells)]


def ridge_folds(design: DataFrame, features: list[str], folds: list[tuple[str, dt.date, dt.date]], runs: dict[str, tuple[str, float]]) -> dict[str, dict[str, Ridge]]:
    """Fold -> run -> fit on the rows whose date and label end lie at or before the fold's train end. Train blocks expand
    with their ends, so a row's cell is the first fold that holds it."""
    ends = sorted({end for _, end, _ in folds})
    cell = F.lit(None).cast("int")
    for i, end in reversed([*enumerate(ends)]):
        cell = F.when((F.col("date") <= splits.as_date(end)) & (F.col("label_end_date") <= splits.as_date(end)), F.lit(i)).otherwise(cell)
    fits = ridge_cells(design.withColumn("_cell", cell).where(F.col("_cell").isNotNull()), len(ends), features, runs)
    return {name: fits[ends.index(end)] for name, end, _ in folds}


def fit_ridge(train: DataFrame, features: list[str], label: str, alpha: float = 10.0):
    """Closed-form ridge on scaled features: intercept is the label mean, penalty ``alpha``.

    The solver needs one pass that sums a feature-by-feature matrix; its penalty is stated per
    row and per label deviation.
    """
    size = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    fit = LinearRegression(featuresCol="_features", labelCol=label, predictionCol="model_score", solver="normal",
                           elasticNetParam=0.0, standardization=False,
                           regParam=alpha * float(size["s"] or 0.0) / max(1, size["n"]))
    return fit.fit(_assemble(train.where(F.col(label).isNotNull()), features))


def fit_trees(train: DataFrame, features: list[str], label: str, *, n_estimators: int = 350,
              learning_rate: float = 0.04, max_depth: int = 5, min_child: int = 250, subsample: float = 0.75,
              seed: int = 42):
    rows = stage(_assemble(train.where(F.col(label).isNotNull()), features).select("_features", label))
    fit = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="model_score", maxIter=n_estimators,
                       stepSize=learning_rate, maxDepth=max_depth, minInstancesPerNode=min_child,
                       subsamplingRate=subsample, seed=seed)
    return fit.fit(rows)


def score(model, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_assemble(rows, features)).drop("_features")


def importance(model, features: list[str], spark) -> DataFrame:
    """Absolute coefficient, or tree importance, largest first."""
    if hasattr(model, "coefficients"):
        weights = getattr(model.coefficients, "toArray", lambda: model.coefficients)()
        rows = [(f, abs(float(c)), float(c)) for f, c in zip(features, weights)]
    else:
        rows = [(f, float(c), None) for f, c in zip(features, model.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double, coefficient double")
    return table.orderBy(F.col("importance").desc(), "feature")


def train_and_score(design: DataFrame, features: list[str], label: str, train_end, val_end, embargo_days: int,
                    fit: Callable = fit_ridge, max_train_rows: int | None = None, seed: int = 42, alpha: float = 10.0):
    """Split, purge, embargo, sample, scale, fit, score: ``(model, scored validation and test rows)``.

    Ridge, the default, is fitted from summed products (with penalty ``alpha``) and scored by one expression; other learners
    get scaled rows.
    """
    kept = splits.purged_splits(design, train_end, val_end, embargo_days)
    if fit is not fit_ridge:                # read many times
        kept = stage(kept)
    train = kept.where(F.col("split") == "train")
    if max_train_rows is not None:
        chosen = splits.budget_dates(splits.date_counts(train), max_train_rows, seed=seed)
        train = splits.on_dates(train, chosen)
    rest = kept.where(F.col("split") != "train")
    if fit is fit_ridge:
        model = ridge_cells(train.withColumn("_cell", F.lit(0)), 1, features, {"run": (label, alpha)})[0]["run"]
        return model, rest.withColumn("model_score", model.score())
    stats = stage(scaler_table(train, features, []))
    model = fit(apply_scaler(train, stats, features, []), features, label)          # a fit that reads its rows often stages them
    return model, score(model, apply_scaler(rest, stats, features, []), features)


def walk_forward(design: DataFrame, features: list[str], label: str, folds: list[tuple[str, dt.date, dt.date]],
                 embargo_days: int, fit: Callable = fit_ridge, alpha: float = 10.0) -> DataFrame:
    """Scored rows after each fold's train end, tagged ``fold``, in one result table.

    Ridge fits all folds from one pass; other learners are fitted fold by fold, of which there are a handful. Statistics come from
    the fold's train rows only. Validation folds keep their validation block, the hold-out keeps its test block.
    """
    blocks = {name: "test" if train_end == val_end else "val" for name, train_end, val_end in folds}
    parts = []
    if fit is fit_ridge:
        fits = ridge_folds(design, features, folds, {"run": (label, alpha)})
        rows = splits.fold_splits(design, folds, embargo_days)
        scores = F.lit(None).cast("double")
        chosen = F.lit(False)
        for name, block in blocks.items():
            own = (F.col("fold") == name) & (F.col("split") == block)
            chosen = chosen | own
            if fits[name]:
                scores = F.when(own, fits[name]["run"].score()).otherwise(scores)
        return rows.where(chosen).drop("train_end", "val_end").withColumn("model_score", scores)
    for name, train_end, val_end in folds:
        _, scored_rows = train_and_score(design, features, label, train_end, val_end, embargo_days, fit)
        parts.append(scored_rows.where(F.col("split") == blocks[name]).withColumn("fold", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
