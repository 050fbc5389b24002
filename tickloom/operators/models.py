"""Training on Spark ML, feature importance, evaluation, ensembles and signal rules."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, ratio
from tickloom.operators.quantiles import exact_quantiles, quantile_bins
from tickloom.order import EventOrder, Frames, running, windowed


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def train_regressor(df: DataFrame, features: list[str], label: str, seed: int = 42, **params) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **params)
    return Pipeline(stages=[_assembled(features), gbt]).fit(df)


def train_direction(df: DataFrame, features: list[str], label: str, seed: int = 42, **params) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    return Pipeline(stages=[_assembled(features), gbt]).fit(df)


def train_horizons(df: DataFrame, features: list[str], labels: list[str], **params) -> dict[str, PipelineModel]:
    """One regressor per target horizon."""
    return {t: train_regressor(df.filter(F.col(t).isNotNull()), features, t, **params) for t in labels}


def score(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """A ``pred_{name}`` column per model, added by plan composition."""
    out = df
    for name, model in models.items():
        out = model.transform(out).withColumnRenamed("prediction", f"pred_{name}")
        out = out.drop("features", "rawPrediction", "probability")
    return out


def tuned_regressor(df: DataFrame, features: list[str], label: str, depths: list[int], steps: list[float], folds: int = 3, seed: int = 42) -> PipelineModel:
    """k-fold search over tree depth and step size, fits run in parallel."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=5, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, depths).addGrid(gbt.stepSize, steps).build()
    cv = CrossValidator(
        estimator=Pipeline(stages=[_assembled(features), gbt]), estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, parallelism=2, seed=seed,
    )
    return cv.fit(df).bestModel


def forest_importance(df: DataFrame, features: list[str], label: str, classify: bool = False, seed: int = 42, **params) -> DataFrame:
    """(feature, importance) of a random forest; k rows."""
    kind = RandomForestClassifier if classify else RandomForestRegressor
    model = Pipeline(stages=[_assembled(features), kind(featuresCol="features", labelCol=label, seed=seed, **params)]).fit(df)
    values = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    return df.sparkSession.createDataFrame(list(zip(features, values)), "feature string, importance double")


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with a discrete label.

    All features are binned, stacked and counted in one aggregate.
    """
    d = df
    for c in features:
        d = quantile_bins(d, c, f"_b_{c}", bins)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_b_{c}").alias("bin")) for c in features]))
    joint = d.select(F.col(label).alias("y"), pairs.alias("p")).groupBy("p.feature", "p.bin", "y").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("feature"))
    px = F.sum("n").over(Window.partitionBy("feature", "bin"))
    py = F.sum("n").over(Window.partitionBy("feature", "y"))
    term = (F.col("n") / F.col("t")) * F.log(F.col("n") * F.col("t") / (F.col("px") * F.col("py")))
    return joint.withColumns({"t": total, "px": px, "py": py}).groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def stability(scores: DataFrame) -> DataFrame:
    """1 / (1 + coefficient of variation) of each feature's scores over folds or methods."""
    m, s = F.avg("score"), F.stddev_pop("score")
    return scores.groupBy("feature").agg(
        m.alias("mean_score"), (1 / (1 + s / (F.abs(m) + 1e-8))).alias("stability")
    )


# Fixed values (keywords of order-flow feature families).
CATEGORIES = {
    "volume": ["volume", "size"],
    "imbalance": ["imbalance", "delta", "ofi"],
    "pattern": ["iceberg", "absorption", "order_block", "support_resistance"],
    "momentum": ["momentum", "rsi", "macd"],
    "risk": ["var_", "cvar", "drawdown", "volatility"],
    "microstructure": ["spread", "liquidity", "depth", "toxicity"],
}
# End of fixed values.


def feature_categories(columns: list[str]) -> dict[str, list[str]]:
    """Column names by keyword; a column belongs to the first family it matches."""
    out: dict[str, list[str]] = {k: [] for k in CATEGORIES}
    for c in columns:
        for family, words in CATEGORIES.items():
            if any(w in c.lower() for w in words):
                out[family].append(c)
                break
    return out


def regression_metrics(df: DataFrame, prediction: str, actual: str, by: list[str]) -> DataFrame:
    """RMSE, MAE and R2 per group, one pass."""
    e = F.col(prediction) - F.col(actual)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0))).alias("r2"),
        F.count(F.lit(1)).alias("rows"),
    )


def financial_metrics(df: DataFrame, order: EventOrder, prediction: str, actual: str) -> DataFrame:
    """Per key: trade the prediction beyond half its deviation, one row later.

    Total return, volatility, Sharpe, drawdown, win rate, profit factor, averages, VaR,
    CVaR, Calmar, Sortino.
    """
    order = order.measured(df)
    keys = list(order.keys)
    sigma = df.groupBy(*keys).agg((F.stddev_pop(prediction) * 0.5).alias("_cut"))
    d = df.join(sigma, keys)
    p = F.col(prediction)
    d = d.withColumn("_pos", F.when(p > F.col("_cut"), 1.0).when(p < -F.col("_cut"), -1.0).otherwise(0.0))

    def body(x: DataFrame, f: Frames) -> DataFrame:
        prev = F.coalesce(F.lag("_pos").over(f.ordered()), F.lit(0.0))
        return x.withColumn("_r", F.coalesce(prev * F.col(actual), F.lit(0.0)))

    d = windowed(d, order, body, before=1)
    d = running(d, order, {"_cum": ("sum", "_r")})
    d = running(d, order, {"_peak": ("max", "_cum")})
    var = exact_quantiles(d, "_r", {"var_95": 0.05}, keys)
    r = F.col("_r")
    g = d.join(var, keys).groupBy(*keys).agg(
        F.sum(r).alias("total_return"), F.stddev_pop(r).alias("volatility"), F.min(F.col("_cum") - F.col("_peak")).alias("max_drawdown"),
        F.count_if(r > 0).alias("profitable_trades"), F.count_if(r != 0).alias("total_trades"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_loss"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.stddev_pop(F.when(r < 0, r)).alias("_dn"), F.max("var_95").alias("var_95"),
        F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
    )
    return g.withColumns(
        {
            "sharpe_ratio": ratio(F.col("total_return"), F.col("volatility")),
            "win_rate": ratio(F.col("profitable_trades"), F.col("total_trades")),
            "profit_factor": F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")),
            "calmar_ratio": F.when(F.col("max_drawdown") != 0, F.col("total_return") / F.abs("max_drawdown")).otherwise(0.0),
            "sortino_ratio": F.when(F.col("_dn") > 0, F.col("total_return") / F.col("_dn")).otherwise(0.0),
        }
    ).drop("_gain", "_loss", "_dn")


def prediction_accuracy(df: DataFrame) -> DataFrame:
    """Direction, price and overall accuracy per prediction.

    Columns: predicted_direction, price_target, actual_direction, actual_price and
    optionally pattern_accuracy (0 when absent).
    """
    hit = flag(F.col("predicted_direction") * F.col("actual_direction") > 0)
    miss = F.abs(F.col("actual_price") - F.col("price_target")) / F.col("price_target")
    price = F.when(F.col("price_target") > 0, F.greatest(F.lit(0.0), 1 - miss)).otherwise(0.0)
    pattern = F.col("pattern_accuracy") if "pattern_accuracy" in df.columns else F.lit(0.0)
    d = df.withColumns({"direction_accuracy": hit.cast("double"), "price_accuracy": price, "pattern_accuracy": pattern})
    return d.withColumn(
        "overall_accuracy", (F.col("direction_accuracy") + F.col("price_accuracy") + F.col("pattern_accuracy")) / 3
    )


def ensemble(predictions: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Weighted direction, price change and confidence over models.

    ``weights`` (model, weight; summing to 100) has one row per model, so it is
    broadcast; models without a weight are left out.
    """
    total = weights.agg(F.sum("weight")).first()[0]
    if total is None or abs(total - 100.0) > 0.01:
        raise ValueError(f"model weights must sum to 100, got {total}")
    d = predictions.join(F.broadcast(weights), "model")
    w = F.sum("weight")
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / w).alias(c)
    return d.groupBy(*by).agg(mean("direction"), mean("price_change"), mean("confidence"), F.count(F.lit(1)).alias("models"))


def trade_levels(signals: DataFrame, price: str, tick: float, stop_ticks: float, take_ticks: float) -> DataFrame:
    """Price target, stop and take-profit prices of a combined signal."""
    p, long = F.col(price), F.col("direction") > 0
    s, t = stop_ticks * tick, take_ticks * tick
    return signals.withColumns(
        {
            "price_target": p * (1 + F.col("price_change")),
            "stop_loss": F.when(long, p - s).otherwise(p + s),
            "take_profit": F.when(long, p + t).otherwise(p - t),
        }
    )


def choose_strategy(signals: DataFrame, price: str, tick: float) -> DataFrame:
    """One of six order strategies and its price, from direction, confidence, patterns."""
    c, long = F.col("confidence"), F.col("direction") > 0
    pattern = (F.col("absorption_confidence") > 0.6) | (F.col("order_block_confidence") > 0.6)
    p = F.col(price)
    support = F.coalesce("support_level", p - 5 * tick)
    resistance = F.coalesce("resistance_level", p + 5 * tick)
    return signals.withColumns(
        {
            "strategy": F.when(long & pattern, "buy_limit").when(long & (c > 0.8), "buy_market").when(long, "buy_bid")
            .when(pattern, "sell_limit").when(c > 0.8, "sell_market").otherwise("sell_bid"),
            "execution_price": F.when(long & pattern, support).when(long & (c > 0.8), p + tick).when(long, p - tick)
            .when(pattern, resistance).when(c > 0.8, p - tick).otherwise(p + tick),
        }
    )


def signal_gate(signals: DataFrame, drawdown: Column | None = None, max_drawdown: float = 0.1) -> DataFrame:
    """should_trade and the first reason against it."""
    dd = drawdown if drawdown is not None else F.lit(0.0)
    reason = (
        F.when(F.col("confidence") < 0.6, "confidence")
        .when(F.abs("direction") < 0.3, "direction")
        .when(dd > max_drawdown, "drawdown")
        .when(F.col("overall_pattern_confidence") < 0.3, "pattern")
        .otherwise("ok")
    )
    return signals.withColumn("reason", reason).withColumn("should_trade", F.col("reason") == "ok")


def alpha_gate(signals: DataFrame) -> DataFrame:
    """Gate on remaining alpha (30 %) and competitive window (10 ms) first."""
    reason = (
        F.when(F.col("alpha_remaining") < 30, "alpha")
        .when(F.col("competitive_window_ms") < 10, "window")
        .when(F.col("confidence") < 0.6, "confidence")
        .when(F.abs("direction") < 0.3, "direction")
        .otherwise("ok")
    )
    return signals.withColumns(
        {
            "reason": reason,
            "action": F.when(reason == "ok", F.when(F.col("direction") > 0, "buy").otherwise("sell")),
            "adjusted_confidence": F.when(reason == "ok", F.col("confidence") * F.col("alpha_remaining") / 100),
        }
    )


def prediction_velocity(predictions: DataFrame, order: EventOrder, threshold: float, min_velocity: float) -> DataFrame:
    """Change of each prediction and the entry rule on prediction and velocity."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        p = F.col("prediction")
        d = d.withColumn("velocity", p - F.coalesce(F.lag("prediction").over(f.ordered()), p))
        strong = (F.abs(p) >= threshold) & (F.abs("velocity") >= min_velocity)
        up, down = (p > 0) & (F.col("velocity") > 0), (p < 0) & (F.col("velocity") < 0)
        return d.withColumn("entry_side", F.when(strong & up, "B").when(strong & down, "A"))

    return windowed(predictions, order, body, before=1)


def order_quantity(prob: Column, liquidity: Column, spoofing: Column, base: int = 1, most: int = 4) -> Column:
    """0 when spoofed or unlikely, base in thin books, more when very likely."""
    return (
        F.when(spoofing, 0)
        .when(prob < 0.55, 0)
        .when(liquidity < 0.1, base)
        .when(prob > 0.65, min(most, max(base + 1, 2)))
        .otherwise(base)
    )


def run_diagnostics(runs: DataFrame) -> DataFrame:
    """Convergence, stability, over- and underfitting and advice per training run.

    Columns: losses (array, in order), train_accuracy, val_accuracy.
    """
    first, last = F.get("losses", F.lit(0)), F.element_at("losses", -1)
    tail = F.slice("losses", F.greatest(F.size("losses") - 9, F.lit(1)), 10)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    d = runs.withColumns({"_tail": tail, "_mean": mean})
    var = F.aggregate("_tail", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("_tail")
    known = (F.col("train_accuracy") > 0) & (F.col("val_accuracy") > 0)
    gap = (F.col("train_accuracy") - F.col("val_accuracy")) / F.col("train_accuracy")
    d = d.withColumns(
        {
            "convergence_rate": F.when(first > 0, (first - last) / first).otherwise(0.0),
            "stability_score": 1 / (1 + var),
            "overfitting_score": F.when(known, F.greatest(F.lit(0.0), gap)).otherwise(0.0),
            "underfitting_score": F.when(known & (F.col("val_accuracy") < 0.8), (0.8 - F.col("val_accuracy")) / 0.8).otherwise(0.0),
        }
    )
    advice = (
        F.when(F.col("overfitting_score") > 0.2, "add regularisation or data")
        .when(F.col("underfitting_score") > 0.3, "raise capacity or add features")
        .when(F.col("convergence_rate") < 0.1, "raise the learning rate or train longer")
        .otherwise("no change")
    )
    return d.withColumn("advice", advice).drop("_tail", "_mean")


def probabilities(df: DataFrame, column: str = "probability") -> DataFrame:
    return df.withColumn("prob_up", F.get(vector_to_array(column), F.lit(1)))


def model_means(metrics: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Means of metric columns over models or horizons."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], F.count(F.lit(1)).alias("n"))
