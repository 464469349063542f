"""Run metrics: losses, best epochs, progress rows, schedules, retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numbers import perplexity


def mean_losses(batches: DataFrame, group: list[str], loss: str = "loss") -> DataFrame:
    """group, batches, mean_loss, perplexity: unweighted mean over batches."""
    x = batches.groupBy(*group).agg(F.count(loss).alias("batches"), F.avg(loss).alias("m"))
    return x.select(*group, "batches", F.round("m", 6).alias("mean_loss"), F.round(perplexity(F.col("m")), 4).alias("perplexity"))


def running_best(history: DataFrame, run: list[str], step: str, loss: str) -> DataFrame:
    """Adds best_loss so far and improved: whether the step is strictly better than all before. One row a step: runs are short."""
    before = Window.partitionBy(*run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    past = F.min(loss).over(before)
    return history.withColumn("best_loss", F.least(F.col(loss), past)).withColumn("improved", F.coalesce(F.col(loss) < past, F.col(loss).isNotNull()))


def best_step(history: DataFrame, run: list[str], step: str, loss: str) -> DataFrame:
    """run, step, loss of the first best step of each run."""
    return history.where(F.col(loss).isNotNull()).groupBy(*run).agg(F.min_by(step, F.struct(loss, step)).alias(step), F.min(loss).alias(loss))


def running_mean(history: DataFrame, run: list[str], step: str, loss: str, every: int = 100) -> DataFrame:
    """Progress rows (first, each *every*-th, last) with the mean loss so far."""
    w = Window.partitionBy(*run).orderBy(step)
    n, of = F.row_number().over(w), F.count("*").over(Window.partitionBy(*run))
    x = history.withColumns({"n": n, "of": of, "running_loss": F.round(F.avg(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)})
    return x.where((F.col("n") == 1) | (F.col("n") % every == 0) | (F.col("n") == F.col("of"))).drop("of")


def newest_checkpoints(names: DataFrame, name: str = "name", keep: int = 5, pattern: str = r"resume_step_(\d+)\.pt$") -> DataFrame:
    """(name, step) of the *keep* newest checkpoints; names that do not match are no checkpoints."""
    step = F.regexp_extract(name, pattern, 1)
    return names.select(name, F.nullif(step, F.lit("")).cast("long").alias("step")).where("step is not null").orderBy(F.desc("step"), name).limit(keep)


def schedule(spark: SparkSession, batches: int, epochs: int, rate: float, accumulate: int = 4) -> DataFrame:
    """(step, learning_rate): cosine decay over ceil(batches / accumulate) steps an epoch."""
    steps = max(1, math.ceil(batches / accumulate) * epochs)
    return spark.range(steps).select(F.col("id").alias("step"), (F.lit(rate) * (1 + F.cos(F.lit(math.pi) * F.col("id") / steps)) / 2).alias("learning_rate"))


def parameters(vocabulary: int, context: int, width: int, layers: int, inner: int) -> int:
    """Parameters of a decoder with tied embeddings, biases and two norms a layer."""
    layer = 4 * width * width + 4 * width + 2 * width * inner + inner + width + 4 * width
    return vocabulary * width + context * width + layers * layer + 2 * width


def gigabytes(c: Column) -> Column:
    """Bytes in GB, two places."""
    return F.round(c / (1024**3), 2)


def generation_step(df: DataFrame, logits: str, seen: str, temperature: float, penalty: float, k: int) -> DataFrame:
    """Adds probs and greedy (index of the largest logit) for the next token."""
    from ..functions.numbers import kept_top, penalised, softmax

    kept = kept_top(penalised(F.col(logits).cast("array<double>"), F.col(seen), temperature, penalty), k)
    return df.withColumns({"probs": softmax(kept), "greedy": F.array_position(F.col(logits), F.array_max(logits)) - 1})
