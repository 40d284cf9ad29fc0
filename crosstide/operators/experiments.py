"""Operators over run and metric tables: grids, selection, gates, ensembles, comparisons.

A metric table has one row per (run, score, split) and stays small next to the panel, but nothing
here relies on that: selections are ``max_by`` aggregates and joins, never driver loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.functions.text import family_of, horizon_of
from crosstide.operators.ranking import quantile_table
from crosstide.session import stage

# Models that count as simple or tree models in ensembles, and graph variants.
TREE_MODELS = ("ridge", "lightgbm", "xgboost")
SUPERVISED_ALL = ("supervised_graph", "supervised_graph_all")
SUPERVISED_VARIANTS = (
    "supervised_graph", "supervised_graph_all", "supervised_graph_sector", "supervised_graph_style_knn",
    "supervised_graph_rolling_corr", "supervised_graph_sector_style", "supervised_graph_sector_corr",
    "supervised_graph_style_corr", "supervised_graph_random", "supervised_graph_no_edges")


# -- task grids ---------------------------------------------------------------------------------

def expand_grid(base: DataFrame, options: dict[str, list]) -> DataFrame:
    """Every combination of the options for each base row, one ``explode`` per option."""
    for name, values in options.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base


def with_run_name(tasks: DataFrame, parts: list[str], out: str = "run_name") -> DataFrame:
    return tasks.withColumn(out, F.concat_ws("__", *[F.col(p).cast("string") for p in parts]))


def thin_grid(tasks: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """``keep`` evenly spaced rows per group: positions ``floor(j * (n - 1) / (keep - 1))``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = tasks.withColumns({"_i": F.row_number().over(w) - 1,
                                "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    spots = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)),
                        lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(float(max(1, keep - 1)))))
    chosen = (F.col("_n") <= keep) | F.array_contains(spots, F.col("_i").cast("long"))
    return placed.where(chosen).drop("_i", "_n")


def open_tasks(tasks: DataFrame, done: DataFrame, key: str = "run_name") -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def unscored(grid: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: grid keys with no stored prediction."""
    return grid.join(scored.select(*keys), keys, "left_anti")


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# Refinement rules per booster, each variant against the best configuration.
def refine(best: DataFrame) -> DataFrame:
    """Three clamped variants around each best booster configuration, as long rows with a tag.

    Needs ``model, n_estimators, learning_rate, max_depth, num_leaves, min_child, subsample,
    colsample, reg_lambda``. Leaf limits apply to the leaf-wise model only and are NULL for the other.
    """
    n, lr, depth, leaves = (F.col(c) for c in ("n_estimators", "learning_rate", "max_depth", "num_leaves"))
    child, sub, col, lam = (F.col(c) for c in ("min_child", "subsample", "colsample", "reg_lambda"))
    leafwise = F.col("model") == "lightgbm"
    leaves = F.when(leafwise, leaves)

    def leaf_limit(c: Column) -> Column:
        return F.when(leafwise, c)

    def whole(c: Column) -> Column:
        return F.floor(c).cast("double")

    def variant(tag, n_, lr_, depth_, leaves_, child_, sub_, col_, lam_) -> Column:
        values = {"n_estimators": n_, "learning_rate": F.round(lr_, 4), "max_depth": depth_, "num_leaves": leaves_,
                  "min_child": child_, "subsample": F.round(sub_, 3), "colsample": F.round(col_, 3),
                  "reg_lambda": F.round(lam_, 3)}
        return F.struct(F.lit(tag).alias("tag"), *[v.cast("double").alias(k) for k, v in values.items()])

    variants = F.array(
        variant("refine_lower_lr", whole(n * 1.5), _clamp(lr * 0.65, 0.01, 0.08), depth, leaves, child, sub, col, lam),
        variant("refine_more_regularized", n, lr,
                F.greatest(F.when(leafwise, 3).otherwise(2), depth - 1),
                leaf_limit(F.greatest(F.lit(7), whole(leaves / 2))),
                F.when(leafwise, whole(child * 1.5)).otherwise(child * 1.7),
                _clamp(sub - 0.05, 0.55, 0.95), _clamp(col - 0.05, 0.55, 0.95), lam * 1.7),
        variant("refine_more_capacity", F.greatest(F.lit(200), whole(n * 0.85)), _clamp(lr * 1.15, 0.015, 0.08),
                F.least(F.when(leafwise, 7).otherwise(6), depth + 1),
                leaf_limit(F.least(F.lit(127), F.greatest(leaves + 16, whole(leaves * 1.6)))),
                F.when(leafwise, F.greatest(F.lit(80), whole(child * 0.7))).otherwise(
                    F.greatest(F.lit(10.0), child * 0.65)),
                _clamp(sub + 0.05, 0.55, 0.95), _clamp(col + 0.05, 0.55, 0.95),
                F.greatest(F.lit(1.0), lam * 0.75)))
    ids = [c for c in best.columns if c not in ("n_estimators", "learning_rate", "max_depth", "num_leaves",
                                                "min_child", "subsample", "colsample", "reg_lambda")]
    return best.withColumn("_v", F.explode(variants)).select(*ids, "_v.*")


# -- selection ----------------------------------------------------------------------------------

def best_rows(df: DataFrame, keys: list[str], metric: str, tie: str) -> DataFrame:
    """The row with the largest metric per group; NULL loses, ties go to the smallest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def select_best(metrics: DataFrame, metric: str, keys: tuple[str, ...] = ("target_col", "model", "feature_variant"),
                score: str = "model_score") -> DataFrame:
    """All rows of the runs that win their group on the validation split."""
    val = metrics.where((F.col("score") == score) & (F.col("split") == "val"))
    winners = best_rows(val, list(keys), metric, "run_name").select("run_name").distinct()
    return metrics.join(winners, "run_name", "left_semi")


def with_target_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"horizon": horizon_of("target_col"), "target_family": family_of("target_col")})


def best_by_family(runs: DataFrame, metric: str) -> DataFrame:
    """Best run per (family, horizon); runs without the metric are out."""
    return best_rows(runs.where(F.col(metric).isNotNull()), ["target_family", "horizon"], metric, "run_name")


def across_folds(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median and deviation over folds; the deviation of a single fold is 0."""
    folds = stage(folds)
    spread = {m: F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m)) for m in metrics}
    moments = folds.groupBy(*keys).agg(*[e for m in metrics for e in (
        F.avg(m).alias(f"mean_{m}"), spread[m].alias(f"std_{m}"))], F.count(F.lit(1)).alias("n_folds"))
    medians = quantile_table(folds, keys, metrics, [0.5])
    medians = medians.select(*keys, *[F.col(f"{m}_q0").alias(f"median_{m}") for m in metrics])
    return moments.join(medians, keys, "left")


def newest_artifact(files: DataFrame, keys: list[str], path: str = "path", modified: str = "modified") -> DataFrame:
    """Latest file per key, ties by the larger path."""
    return files.groupBy(*keys).agg(F.max_by(path, F.struct(modified, path)).alias(path),
                                    F.max(modified).alias(modified))


# -- stability gates ----------------------------------------------------------------------------

# Outcomes of the gates in the order in which they are tested.
GATE_ORDER = ("low_full_val_rank_ic", "empty_val_rank_ic_file", "too_few_val_years", "unstable_yearly_rank_ic",
              "unstable_regime_rank_ic", "pass")


def yearly_ic(ic: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Years, share of years at or above ``floor`` and the worst year of the daily IC."""
    by_year = ic.groupBy(*keys, F.year("date").alias("year")).agg(F.avg("rank_ic").alias("_y"))
    by_year = by_year.where(F.col("_y").isNotNull())
    return by_year.groupBy(*keys).agg(
        F.count("year").alias("val_years"),
        F.avg(F.when(F.col("_y") >= floor, 1.0).otherwise(0.0)).alias("val_positive_year_frac"),
        F.min("_y").alias("val_min_year_rank_ic"))


def stability(runs: DataFrame, yearly: DataFrame, regimes: DataFrame | None, *, min_ic: float = 0.0,
              min_years: int = 2, min_positive: float = 0.5, min_regime: float = -0.01) -> DataFrame:
    """Gate flags and the first failing reason, tested in a fixed order; figures past it stay empty.

    ``runs`` holds ``run_name, mean_rank_ic`` on validation; ``yearly`` and ``regimes`` are keyed
    by ``run_name`` (``regimes`` with ``mean_rank_ic`` per regime).
    """
    out = runs.join(yearly, "run_name", "left")
    if regimes is not None:
        worst = regimes.groupBy("run_name").agg(F.min("mean_rank_ic").alias("val_min_regime_rank_ic"))
        out = out.join(worst, "run_name", "left")
    else:
        out = out.withColumn("val_min_regime_rank_ic", F.lit(None).cast("double"))
    reason = (F.when(F.col("mean_rank_ic").isNull() | (F.col("mean_rank_ic") < min_ic), "low_full_val_rank_ic")
              .when(F.col("val_years").isNull(), "empty_val_rank_ic_file")
              .when(F.col("val_years") < min_years, "too_few_val_years")
              .when(F.col("val_positive_year_frac") < min_positive, "unstable_yearly_rank_ic")
              .when(F.col("val_min_regime_rank_ic") < min_regime, "unstable_regime_rank_ic").otherwise("pass"))
    out = out.withColumns({"stability_reason": reason, "stable": reason == "pass"})
    stage = F.create_map(*[F.lit(x) for pair in {r: i for i, r in enumerate(GATE_ORDER)}.items() for x in pair])[F.col("stability_reason")]
    return out.withColumns({
        "val_years": F.when(stage >= 2, F.col("val_years")).otherwise(0),
        **{c: F.when(stage >= 3, F.col(c)) for c in ("val_positive_year_frac", "val_min_year_rank_ic")},
        "val_min_regime_rank_ic": F.when(stage >= 4, F.col("val_min_regime_rank_ic"))})


def gate_mlp(selected: DataFrame, policy: str, metric: str, min_ic: float = 0.0) -> DataFrame:
    """Neural members: all, none, or only those that are stable with a positive metric."""
    if policy == "include":
        return selected
    other = F.col("model") != "mlp"
    if policy == "exclude":
        return selected.where(other)
    return selected.where(other | (F.col("stable") & (F.col("mean_rank_ic") >= min_ic) & (F.col(metric) > 0)))


# -- ensembles ----------------------------------------------------------------------------------

def ensemble_members(selected: DataFrame, metric: str, *, policy: str = "stable_only",
                     mlp_min_ic: float = 0.0, graph_variants: tuple[str, ...] = SUPERVISED_VARIANTS) -> DataFrame:
    """Long member table of the seven ensembles; ensembles with one member are left out.

    Each row lists the ensembles it belongs to, and one ``explode`` makes the member table.
    """
    model, variant = F.col("model"), F.col("feature_variant")
    tree = model.isin(*TREE_MODELS)
    gated = {"include": F.lit(True), "exclude": model != "mlp"}.get(
        policy, (model != "mlp") | (F.col("stable") & (F.col("mean_rank_ic") >= mlp_min_ic) & (F.col(metric) > 0)))
    rules = {
        "ensemble_all_val_selected": F.lit(True),
        "ensemble_mlp_gated": gated,
        "ensemble_no_mlp": model != "mlp",
        "ensemble_tree_only": tree,
        "ensemble_supervised_graph_tree": tree & variant.isin(*SUPERVISED_ALL),
        "ensemble_graph_ablation_tree": tree & variant.isin(*graph_variants),
        "ensemble_stability_filtered": F.col("stable"),
    }
    names = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items()]),
                     lambda n: n.isNotNull())
    members = selected.withColumn("ensemble", F.explode(names))
    sizes = members.groupBy("target_col", "ensemble").agg(F.count(F.lit(1)).alias("n_members"))
    weight = F.greatest(F.lit(0.0), F.coalesce(F.col(metric), F.lit(0.0)))
    return members.withColumn("member_weight", weight).join(
        sizes.where(F.col("n_members") >= 2), ["target_col", "ensemble"])


def member_lists(members: DataFrame) -> DataFrame:
    """The run names of each ensemble in one text; an ensemble has a few members."""
    names = F.array_join(F.array_sort(F.collect_set("run_name")), "|")
    return members.groupBy("target_col", "ensemble").agg(names.alias("members"))


# -- report tables ------------------------------------------------------------------------------

def validation_and_test(best: DataFrame, score: str = "model_score") -> DataFrame:
    """One row per run: validation metrics beside the test metrics."""
    def side(split: str, prefix: str, extra: list[str]) -> DataFrame:
        rows = best.where((F.col("score") == score) & (F.col("split") == split))
        return rows.select("run_name", *extra, F.col("mean_rank_ic").alias(f"{prefix}_ic"),
                           F.col("rank_ic_ir").alias(f"{prefix}_icir"), F.col("sharpe_net").alias(f"{prefix}_sharpe"))
    test = side("test", "test", ["target_col", "model"])
    return test.join(side("val", "val", []), "run_name", "left")


def baseline_delta(best: DataFrame) -> DataFrame:
    """Test metrics of the model against the baseline of the same run."""
    test = best.where(F.col("split") == "test")

    def side(score: str, prefix: str, extra: list[str]) -> DataFrame:
        return test.where(F.col("score") == score).select(
            "run_name", *extra, F.col("rank_ic_ir").alias(f"{prefix}_test_icir"),
            F.col("sharpe_net").alias(f"{prefix}_test_sharpe"), F.col("mean_rank_ic").alias(f"{prefix}_test_ic"))
    both = side("model_score", "model", ["target_col", "model"]).join(
        side("baseline_score", "baseline", []), "run_name", "left")
    return both.withColumns({"delta_icir": F.col("model_test_icir") - F.col("baseline_test_icir"),
                             "delta_sharpe": F.col("model_test_sharpe") - F.col("baseline_test_sharpe")})


def winners(table: DataFrame, metric: str) -> DataFrame:
    """Model with the largest metric per target."""
    rows = table.where(F.col(metric).isNotNull())
    best = best_rows(rows, ["target_col"], metric, "model")
    return best.select("target_col", F.col("model").alias("winner"), F.col(metric).alias("value"))


def model_gap(table: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Models as columns and the difference of two of them, per target."""
    wide = table.groupBy("target_col").pivot("model", [first, second]).agg(F.first(metric, ignorenulls=True))
    return wide.withColumn(f"{first}_minus_{second}", F.col(first) - F.col(second))


def challenger_comparison(challenger: DataFrame, reports: DataFrame) -> DataFrame:
    """Challenger test metrics against the best reported model and the reported baseline."""
    test = reports.where(F.col("split") == "test")
    models = test.where(F.col("score") == "model_score")
    best = best_rows(models.where(F.col("rank_ic_ir").isNotNull()), ["target_col"], "rank_ic_ir", "run_name").select(
        "target_col", F.col("model").alias("report_best_model"), F.col("mean_rank_ic").alias("report_best_test_ic"),
        F.col("rank_ic_ir").alias("report_best_test_icir"))
    base = best_rows(test.where(F.col("score") == "baseline_score"), ["target_col"], "run_name", "run_name").select(
        "target_col", F.col("mean_rank_ic").alias("report_baseline_test_ic"),
        F.col("rank_ic_ir").alias("report_baseline_test_icir"))
    out = challenger.join(best, "target_col", "left").join(base, "target_col", "left")
    return out.withColumns({
        "minus_report_best_icir": F.col("test_icir") - F.col("report_best_test_icir"),
        "minus_baseline_icir": F.col("test_icir") - F.col("report_baseline_test_icir")})


def completed_runs(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("score") == "model_score").groupBy("target_col", "model").agg(
        F.countDistinct("run_name").alias("runs"))


# -- sequence splits ----------------------------------------------------------------------------

def window_splits(df: DataFrame, periods: dict[str, tuple[str, str]], min_rows: int) -> DataFrame:
    """Per period: symbols with enough rows, their rows, range and row-count spread."""
    table = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(a).cast("date").alias("a"),
                               F.lit(b).cast("date").alias("b")) for n, (a, b) in periods.items()])
    inside = F.filter(table, lambda p: (F.col("date") >= p["a"]) & (F.col("date") <= p["b"]))
    tagged = df.select("symbol", "date", F.explode(inside).alias("_p")).select("symbol", "date", "_p.split")
    lengths = tagged.groupBy("split", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("_f"), F.max("date").alias("_l"))
    lengths = stage(lengths.where(F.col("n") >= min_rows))
    medians = quantile_table(lengths, ["split"], ["n"], [0.5])
    out = lengths.groupBy("split").agg(
        F.count("symbol").alias("symbols"), F.sum("n").alias("rows"), F.min("_f").alias("date_min"),
        F.max("_l").alias("date_max"), F.min("n").alias("min_rows_per_symbol"), F.max("n").alias("max_rows_per_symbol"))
    return out.join(medians.select("split", F.col("n_q0").alias("median_rows_per_symbol")), "split", "left")


def missing_report(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows where all, or any, of the joined columns are missing."""
    nulls = [F.col(c).isNull() for c in columns]
    every, some = nulls[0], nulls[0]
    for n in nulls[1:]:
        every, some = every & n, some | n
    return joined.agg(F.avg(every.cast("double")).alias("missing_all"), F.avg(some.cast("double")).alias("missing_any"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses a right side with duplicate keys."""
    repeated = right.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if repeated:
        raise ValueError(f"right side repeats {keys}")
    return left.join(right, keys, "left")
