"""Training-run logs and forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


def lr_column(columns: Sequence[str]) -> str | None:
    """The first column that names a learning rate."""
    for c in columns:
        low = c.lower()
        if "learning_rate" in low or low.startswith("lr") or "lr-" in low:
            return c
    return None


def with_epoch(log: DataFrame, run: str = "run_id", step: str = "step", epoch: str = "epoch") -> DataFrame:
    """Rows numbered from 0 in step order as epochs, where the log has no epoch column."""
    if epoch in log.columns:
        return log
    return log.withColumn(epoch, F.row_number().over(Window.partitionBy(run).orderBy(step)) - 1)


def run_epochs(log: DataFrame, run: str = "run_id", step: str = "step", epoch: str = "epoch") -> DataFrame:
    """(run, epoch, train_loss, val_loss, lr): each epoch's last value that is not null, by ``step``.

    Rows without any value are left out first.  The training loss is train_loss_epoch if the
    log has it, else train_loss_step, else train_loss.
    """
    names = [c for c in log.columns if c not in (run, step)]
    log = with_epoch(log.dropna(how="all", subset=names) if names else log, run, step, epoch)
    pick = lambda options: next((c for c in options if c in log.columns), None)
    sources = {"train_loss": pick(("train_loss_epoch", "train_loss_step", "train_loss")), "val_loss": pick(("val_loss",)), "lr": lr_column(log.columns)}

    def last(c: str | None) -> Column:
        if c is None:
            return F.lit(None).cast("double")
        return F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(step))).cast("double")

    return log.where(F.col(epoch).isNotNull()).groupBy(run, epoch).agg(*[last(c).alias(n) for n, c in sources.items()])


def run_summary(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """One row for each run: epochs, losses of the last one, best validation loss and its
    epoch (the first of equals), learning rate of the first and the last epoch."""
    at = F.col(epoch)
    scored = F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", at.alias("epoch")))
    return epochs.groupBy(run).agg(
        (F.max(at) + 1).alias("n_epochs"),
        F.max_by("train_loss", at).alias("final_train_loss"), F.max_by("val_loss", at).alias("final_val_loss"),
        F.min(scored).alias("__best"), F.min_by("lr", at).alias("initial_lr"), F.max_by("lr", at).alias("final_lr"),
    ).select(
        run, "n_epochs", "final_train_loss", "final_val_loss", F.col("__best.val_loss").alias("best_val_loss"),
        F.col("__best.epoch").alias("best_val_epoch"), "initial_lr", "final_lr",
    )


def run_results(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """One row for each run: (run, results), its epochs in order as structs (epoch, train_loss, val_loss,
    learning_rate); a missing value is null, which JSON leaves out.  A run's epochs stand in one row."""
    item = F.struct(F.col(epoch).cast("int").alias("epoch"), "train_loss", "val_loss", F.col("lr").alias("learning_rate"))
    return epochs.groupBy(run).agg(F.sort_array(F.collect_list(item)).alias("results"))


def nested_summary(epochs: DataFrame, logs_dir: Column | None = None, meta: dict[str, str] | None = None, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """``run_summary`` with its figures in a struct ``metrics``, beside where the run's logs lie and what else is
    known of the runs (``meta``); missing figures are null, which JSON leaves out."""
    s = run_summary(epochs, run, epoch)
    metrics = [c for c in s.columns if c not in (run, "n_epochs")]
    pairs = [F.lit(x) for kv in (meta or {}).items() for x in kv]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    where = logs_dir if logs_dir is not None else F.lit(None).cast("string")
    return s.select(run, where.alias("logs_dir"), F.col("n_epochs").cast("int").alias("n_epochs"), F.struct(*metrics).alias("metrics"), known.alias("meta"))


def compare_runs(summary: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs by best validation loss, those without one last."""
    return summary.orderBy(F.col("best_val_loss").asc_nulls_last(), run)


def metric_rows(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """(run, epoch, metric, value) of the values that are set."""
    d = epochs.unpivot([run, epoch], ["train_loss", "val_loss", "lr"], "metric", "value")
    return d.where("value is not null")


def forecast_errors(scored: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE, MAPE and SMAPE by ``by``, over rows with both values.

    e = y - yhat; MAPE leaves y = 0 out; SMAPE is the mean of 2 |e| / (|y| + |yhat|), 0 / 0 left out.
    """
    e, a, b = F.col(y) - F.col(yhat), F.abs(y), F.abs(yhat)
    d = scored.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.try_divide(F.abs(e), a)).alias("mape"), F.avg(F.try_divide(2 * F.abs(e), a + b)).alias("smape"),
    )


def pinball_loss(scored: DataFrame, quantiles: dict[float, str], by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Mean of max((q - 1) e, q e), e = y - forecast, for each quantile's column, and their mean as ``loss``."""
    one = lambda q, c: F.avg(F.greatest((q - 1) * (F.col(y) - F.col(c)), q * (F.col(y) - F.col(c))))
    names = [f"pinball_{round(100 * q):02d}" for q in quantiles]
    d = scored.where(F.col(y).isNotNull()).groupBy(*by)
    d = d.agg(F.count(F.lit(1)).alias("n"), *[one(q, c).alias(n) for n, (q, c) in zip(names, quantiles.items(), strict=True)])
    mean = F.col(names[0])
    for n in names[1:]:
        mean = mean + F.col(n)
    return d.withColumn("loss", mean / len(names))


def mse_loss(scored: DataFrame, by: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean squared error by ``by``."""
    e = F.col(y) - F.col(yhat)
    return scored.groupBy(*by).agg(F.avg(e * e).alias("mse"))
