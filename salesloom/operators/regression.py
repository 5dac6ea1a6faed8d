"""Linear regression of volume on price and two category indicators, per group.

Everything comes from second moments of standardised features, which are ordinary aggregates.
Only one small system of equations per group (and fold) is solved outside SQL, on rows that are
aggregates already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom import fixed
from salesloom.functions import numbers, text
from salesloom.functions.solve import solve_normal
from salesloom.operators.cleaning import join_on
from salesloom.operators.filters import valid_rows
from salesloom.operators.spread import attach, running_start
from salesloom.roles import SALES, Roles
from salesloom.session import staged

FEATURES = ["price", "is_electric", "is_hybrid"]


def features(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Price, the two indicators and the volume of every valid row."""
    cat = F.coalesce(F.col(roles.cat), F.lit(fixed.UNKNOWN_CATEGORY))
    return valid_rows(df, roles).select(
        *by, roles.dim, roles.item,
        F.col(roles.price).cast("double").alias("price"),
        text.is_electric(cat).alias("is_electric"),
        text.is_hybrid(cat).alias("is_hybrid"),
        F.col(roles.qty).cast("double").alias("y"),
    )


def scaling(rows: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Row count, mean and population deviation of each column; a constant column scales by one."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std") for c in columns],
    )


def scaled(c: str, struct: str) -> Column:
    return (F.col(c) - F.col(f"{struct}.{c}_mean")) / F.col(f"{struct}.{c}_std")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(3) for j in range(i, 3)]


def _moment_sums(weight: Column) -> list[Column]:
    """Weighted sums over standardised features z0..z2 and the centred target t."""
    z = [F.col(f"z{i}") for i in range(3)]
    t = F.col("t")
    return [
        F.sum(weight).alias("m"),
        *[F.sum(weight * z[i]).alias(f"s{i}") for i in range(3)],
        F.sum(weight * t).alias("st"),
        F.sum(weight * t * t).alias("stt"),
        *[F.sum(weight * z[i] * z[j]).alias(f"s{i}{j}") for i, j in _pairs()],
        *[F.sum(weight * z[i] * t).alias(f"s{i}t") for i in range(3)],
    ]


MOMENTS = ["m", "s0", "s1", "s2", "st", "stt", *[f"s{i}{j}" for i, j in _pairs()], "s0t", "s1t", "s2t"]


def _normal(prefix: str) -> tuple[Column, Column]:
    """Centred moment matrix (flattened) and vector from the sums with the given name prefix."""
    s = lambda k: F.col(prefix + k)
    xx = lambda i, j: s(f"s{min(i, j)}{max(i, j)}") - s(f"s{i}") * s(f"s{j}") / s("m")
    xy = lambda i: s(f"s{i}t") - s(f"s{i}") * s("st") / s("m")
    return (
        F.array(*[xx(i, j) for i in range(3) for j in range(3)]),
        F.array(*[xy(i) for i in range(3)]),
    )


def _fit(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group with scaling, sums of squares and coefficients, from feature rows.

    One aggregate gives means, deviations and all covariances; dividing these by the deviations
    gives the moments of the standardised features, so the rows are not visited a second time.
    """
    names = FEATURES + ["y"]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}_mean") for c in names],
        *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std") for c in names],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in _pairs()],
        *[F.covar_pop(c, "y").alias(f"c{i}y") for i, c in enumerate(FEATURES)],
        F.var_pop("y").alias("cyy"),
    )
    std = [F.col(f"{c}_std") for c in FEATURES]
    xx = F.array(*[F.col(f"c{min(i, j)}{max(i, j)}") / (std[i] * std[j]) for i in range(3) for j in range(3)])
    xy = [F.col(f"c{i}y") / std[i] for i in range(3)]
    solved = sums.filter(F.col("n") >= fixed.MIN_POINTS).withColumn("_b", solve_normal(xx, F.array(*xy)))
    beta = [F.col("_b")[i] for i in range(3)]
    coef = {f"coef_{c}": beta[i] for i, c in enumerate(FEATURES)}
    raw = {f"raw_{c}": beta[i] / std[i] for i, c in enumerate(FEATURES)}
    shift = sum((beta[i] / std[i] * F.col(f"{c}_mean") for i, c in enumerate(FEATURES)), F.lit(0.0))
    explained = sum((beta[i] * xy[i] for i in range(3)), F.lit(0.0))
    wide = solved.withColumns(coef | raw | {
        "intercept": F.col("y_mean"),
        "raw_intercept": F.col("y_mean") - shift,
        "sse": F.col("n") * F.greatest(F.lit(0.0), F.col("cyy") - explained),
        "sst": F.col("n") * F.col("cyy"),
    })
    scale = [f"{c}_{k}" for c in names for k in ("mean", "std")]
    return wide.select(*by, "n", "intercept", *coef, "raw_intercept", *raw, "sse", "sst", *scale)


def fit(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = ()) -> DataFrame:
    """Coefficients per group, in standardised units (``coef_*``) and in raw units (``raw_*``).

    Groups with fewer than five valid rows have no row.
    """
    return _fit(features(df, roles, by), by).select(
        *by, "n", "intercept", *[f"coef_{c}" for c in FEATURES],
        "raw_intercept", *[f"raw_{c}" for c in FEATURES],
    )


def _predicted(struct: str) -> Column:
    out = F.col(f"{struct}.raw_intercept")
    for c in FEATURES:
        out = out + F.col(f"{struct}.raw_{c}") * F.col(c)
    return out


def train(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), cross_validate: bool = True) -> DataFrame:
    """One model row per group: coefficients, scaling, R2, RMSE, MAE, cross-validated R2, mode.

    The feature rows and the fitted models are written out, as several passes read them.
    """
    by = list(by)
    rows = staged(features(df, roles, by), "features")
    model = staged(_fit(rows, by), "models")
    raw = rows.select(*by, *FEATURES, "y")
    scored = attach(raw, model, by, "_m", "n").filter(F.col("_m.n").isNotNull())
    error = scored.groupBy(*by).agg(F.avg(F.abs(F.col("y") - _predicted("_m"))).alias("mae"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") > 0, 0.0).otherwise(1.0))
    out = model.withColumns({"r2": r2, "rmse": F.sqrt(F.col("sse") / F.col("n"))})
    extras = [(error, ["mae"])]
    if cross_validate:
        extras.append((_cross_validated(rows, roles, by, 5), ["cv_r2_mean"]))
    for table, names in extras:
        if by:
            out = join_on(out, table.select(*by, *names), by, "left")
        else:
            for name in names:
                out = out.withColumn(name, table.select(name).scalar())
    if not cross_validate:
        out = out.withColumn("cv_r2_mean", F.lit(None).cast("double"))
    return out.withColumn("mode", F.when(F.col("r2") >= 0, "predictive").otherwise("exploratory"))


def _folded_cells(rows: DataFrame, roles: Roles, by: Sequence[str], folds: int) -> DataFrame:
    """Distinct ones of the feature rows with fold number and count.

    Folds are contiguous in the order of entity group and entity.  Equal rows are one cell that
    covers a stretch of positions; a cell across a fold border is split by its overlap with each
    fold, so no row-level numbering is needed.  The first ``n % k`` folds hold one row more.
    """
    by = list(by)
    order = [roles.dim, roles.item, "price", "y", "is_electric", "is_hybrid"]
    cells = rows.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("c"))
    placed = staged(running_start(cells, order, "c", by), "placed")
    sizes = placed.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("w"))
    wide = attach(placed, sizes, by, "_z", "w")
    n = F.col("_z.n")
    k = F.least(F.lit(folds), n)
    size, extra = F.floor(n / k), n % k
    fold = F.explode(F.sequence(F.lit(0), (k - 1).cast("int")))
    first = F.col("fold") * F.col("_size") + F.least(F.col("fold"), F.col("_extra"))
    last = first + F.col("_size") + F.when(F.col("fold") < F.col("_extra"), 1).otherwise(0)
    overlap = F.least(F.col("start") + F.col("c"), last) - F.greatest(F.col("start"), first)
    return (
        wide.filter(n >= fixed.MIN_POINTS)
        .withColumns({"_size": size, "_extra": extra, "_n": n})
        .withColumn("fold", fold)
        .withColumn("w", overlap)
        .filter(F.col("w") > 0)
        .select(*by, *FEATURES, "y", "fold", "w")
    )


def fold_sizes(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """Rows and volume of every fold."""
    return _folded_cells(features(df, roles, by), roles, by, folds).groupBy(*by, "fold").agg(
        F.sum("w").cast("bigint").alias("rows"), F.sum(F.col("w") * F.col("y")).alias("volume"))


def cross_validation(df: DataFrame, roles: Roles = SALES, by: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """Mean R2 over contiguous folds, from the moments of the folds.

    The training moments of a fold are the totals less the fold's own; all moments are taken about
    the group's means, which keeps the subtraction harmless.  At most ``folds`` small systems per
    group are solved.
    """
    return _cross_validated(staged(features(df, roles, by), "features"), roles, by, folds)


def _cross_validated(rows: DataFrame, roles: Roles, by: Sequence[str], folds: int) -> DataFrame:
    by = list(by)
    cells = _folded_cells(rows, roles, by, folds)
    # scaling is the whole group's, as the features are scaled before they are split
    scale = staged(scaling(rows, by, FEATURES + ["y"]), "scaling")
    ready = attach(cells, scale, by, "_s", "n").withColumns(
        {f"z{i}": scaled(c, "_s") for i, c in enumerate(FEATURES)}
        | {"t": F.col("y") - F.col("_s.y_mean")}
    )
    per_fold = ready.groupBy(*by, "fold").agg(*_moment_sums(F.col("w")))
    # at most `folds` rows per group meet here
    totals = per_fold.groupBy(*by).agg(*[F.sum(c).alias(f"all_{c}") for c in MOMENTS])
    if by:
        both = join_on(per_fold, totals, by, "inner")
    else:
        both = per_fold.withColumn("_a", totals.select(F.struct(*totals.columns)).scalar()).select("*", "_a.*")
    both = both.withColumns({f"tr_{c}": F.col(f"all_{c}") - F.col(c) for c in MOMENTS})
    xx, xy = _normal("tr_")
    solved = both.withColumn("_b", solve_normal(xx, xy))
    b = [F.col("_b")[i] for i in range(3)]
    a = (F.col("tr_st") - sum((b[i] * F.col(f"tr_s{i}") for i in range(3)), F.lit(0.0))) / F.col("tr_m")
    # sum of (t - a - b z)^2 over the fold, from its sums
    sse = F.col("stt") + a * a * F.col("m") - 2 * a * F.col("st")
    for i in range(3):
        sse = sse - 2 * b[i] * F.col(f"s{i}t") + 2 * a * b[i] * F.col(f"s{i}")
        for j in range(3):
            sse = sse + b[i] * b[j] * F.col(f"s{min(i, j)}{max(i, j)}")
    sst = F.col("stt") - F.col("st") * F.col("st") / F.col("m")
    r2 = F.when(sst > 1e-12 * F.col("stt"), 1 - F.greatest(F.lit(0.0), sse) / sst).otherwise(
        F.when(sse > 1e-9, 0.0).otherwise(1.0))
    # one test row has no R2
    scored = solved.withColumn("r2", F.when(F.col("m") >= 2, r2))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.when(F.count("r2") == F.count(F.lit(1)), F.avg("r2")).alias("cv_r2_mean"),
    )


def metrics(model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded metrics and coefficients of each model."""
    return model.select(
        *by, F.lit(True).alias("success"),
        numbers.rounded("r2", 4).alias("r2"), numbers.rounded("rmse", 1).alias("rmse"), numbers.rounded("mae", 1).alias("mae"),
        numbers.rounded("cv_r2_mean", 4).alias("cv_r2_mean"), F.col("n").alias("data_points"), "mode",
        numbers.rounded("intercept", 2).alias("intercept"),
        *[numbers.rounded(f"coef_{c}", 2).alias(f"coef_{c}") for c in FEATURES],
        *[numbers.rounded(f"raw_{c}", 4).alias(f"raw_{c}") for c in FEATURES],
    )


def annualise(monthly: Column, month: Column) -> tuple[Column, Column, Column]:
    """Yearly volume, method and factor for a monthly figure."""
    factor = numbers.season_factor(month)
    method = F.when(month.isNotNull() & (month != 0), "seasonal").otherwise("naive")
    return numbers.rounded(monthly * 12 * factor, 0).cast("bigint"), method, factor


def predict(scenarios: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Forecast for every scenario row (``price``, ``energy_type``, ``month``, plus ``by``).

    ``model`` has one row per group.  Volumes and the lower end of the 95% interval stop at zero.
    A scenario without a model comes back unsuccessful.
    """
    by = list(by)
    given = scenarios.withColumns({
        "is_electric": text.is_electric(F.col("energy_type")),
        "is_hybrid": text.is_hybrid(F.col("energy_type")),
    })
    # interval width from the metric as reported, that is to one decimal
    used = model.withColumns({"w": F.lit(1), "width": numbers.rounded("rmse", 1) * fixed.INTERVAL_Z})
    if by:
        wide = attach(given, used, by, "_m", "w")
    else:
        wide = given.withColumn("_m", used.select(F.struct(*used.columns)).scalar())
    monthly = numbers.clamp0(_predicted("_m"))
    yearly, method, factor = annualise(F.col("_monthly"), F.col("month"))
    whole = lambda c: numbers.rounded(c, 0).cast("bigint")
    ready = F.col("_m").isNotNull()
    return wide.withColumn("_monthly", monthly).select(
        *scenarios.columns,
        ready.alias("success"),
        F.when(~ready, fixed.MSG_NOT_READY).alias("error"),
        F.when(ready, whole(F.col("_monthly"))).alias("monthly_sales"),
        F.when(ready, yearly).alias("annual_sales"),
        method.alias("annual_method"), factor.alias("factor"),
        F.when(ready, whole(numbers.clamp0(F.col("_monthly") - F.col("_m.width")))).alias("interval_low"),
        F.when(ready, whole(F.col("_monthly") + F.col("_m.width"))).alias("interval_high"),
        F.when(ready, F.format_string(
            fixed.MSG_MODEL_EQUATION,
            numbers.rounded("_m.intercept", 2).cast("string"), numbers.rounded("_m.coef_price", 2).cast("string"),
        )).alias("equation"),
    )


def model_info(model: DataFrame, by: Sequence[str] = (), tenants: DataFrame | None = None) -> DataFrame:
    """Status of each model; with ``tenants``, groups without a model are listed as not ready."""
    by = list(by)
    table = metrics(model, by)
    if tenants is not None and by:
        table = join_on(tenants.select(*by), table, by, "left")
    ready = F.coalesce("success", F.lit(False))
    return table.select(
        *by, ready.alias("ready"), "r2", "rmse", "mae",
        F.coalesce("data_points", F.lit(0)).alias("data_points"),
        F.coalesce("mode", F.lit("no_data")).alias("mode"),
        F.when(~ready, fixed.MSG_UPLOAD_FIRST).when(F.col("r2") < 0, fixed.MSG_NEGATIVE_R2).alias("warning"),
        "intercept", *[f"coef_{c}" for c in FEATURES],
    )


def save_model(model: DataFrame, path: str) -> None:
    """Keep the models as a small table; one row per group."""
    model.write.mode("errorifexists").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
