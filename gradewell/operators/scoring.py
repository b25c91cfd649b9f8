"""Batch jobs that run a caller's function over prompts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions.text import ERROR_PREFIX
from gradewell.plans.skew import lookup_join
from gradewell.session import path_exists, scratch_path

Answer = Callable[[str], str]


def paced(fn: Answer, pause: float, on_error: Callable[[Exception], str | None]) -> Callable[[str], str | None]:
    """The function with a pause after each call and failures turned into a value."""

    def call(text: str) -> str | None:
        try:
            return fn(text)
        except Exception as error:  # the caller's function may fail in any way
            return on_error(error)
        finally:
            if pause:
                time.sleep(pause)

    return call


def for_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every row once per model; the models are a short list, so rows are repeated in place."""
    return df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def append_answers(
    df: DataFrame,
    factory: Callable[[str], Answer],
    prompt: str = "prompt",
    model: str = "model",
    spread: Sequence[str] = ("row_id",),
    partitions: int | None = None,
    pause: float = 0.0,
) -> DataFrame:
    """The table with a ``prediction`` column from ``factory(model)(prompt)``.

    Rows are spread over ``partitions`` by their id, not by model, so three models do not mean three tasks;
    inside a task rows are sorted by model and each model is loaded once. A failing call is recorded as
    ``[Error] message``. Keep row ids in the table: a lost task is run again.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(df.schema.fields + [T.StructField("prediction", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded, answer = None, None
        for batch in batches:
            out = []
            for name, text in zip(batch[model], batch[prompt]):
                if answer is None or name != loaded:
                    loaded = name
                    answer = paced(factory(name), pause, on_error=lambda e: f"{ERROR_PREFIX}{e}")
                out.append(answer(text))
            yield batch.assign(prediction=out)

    spreaded = df.repartition(partitions, *spread, model).sortWithinPartitions(model)
    return spreaded.mapInPandas(run, schema)


# The answer log: one row per call, only ever appended to.
LOG = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("prediction", T.StringType()),
    T.StructField("failed", T.BooleanType()),
])
# Open prompts of one wave: what a run that dies asks again at most.
WAVE_PROMPTS = 100_000


def read_answers(spark: SparkSession, log: str) -> DataFrame:
    """(model, digest, prediction, failed): one answer per model and prompt of a log, which may not exist yet.

    If two runs asked the same prompt, an answer counts before a failure, and of several the one that sorts first.
    """
    if not path_exists(spark, log):
        return spark.createDataFrame([], LOG)
    rows = spark.read.schema(LOG).parquet(log)
    best = rows.groupBy("model", "digest").agg(F.min(F.struct("failed", "prediction")).alias("answer"))
    return best.select("model", "digest", "answer.prediction", "answer.failed")


def answers_from_log(
    df: DataFrame,
    factory: Callable[[str], Answer],
    log: str,
    prompt: str = "prompt",
    model: str = "model",
    partitions: int | None = None,
    wave_prompts: int = WAVE_PROMPTS,
    retry_errors: bool = False,
    pause: float = 0.0,
) -> DataFrame:
    """U1 with answers kept: the table with a ``prediction`` column, asking only what the log at ``log`` lacks.

    Prompts are known by model and SHA-256, so equal prompts are asked once. Open prompts go out in waves of about
    ``wave_prompts``, and every wave is appended to the log before the next begins: a run that dies, or is started again
    with more rows or models, asks at most one wave again, and a lost executor costs its own tasks of that wave.
    Failures are recorded as ``[Error] message``; ``retry_errors`` asks them again. A missing prompt is not asked and has no
    prediction.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_digest", F.unhex(F.sha2(F.col(prompt), 256)))
    wanted = keyed.filter("_digest is not null").groupBy(F.col(model).alias("model"), F.col("_digest").alias("digest")).agg(
        F.min(prompt).alias("prompt"))
    known = read_answers(spark, log)
    if retry_errors:
        known = known.filter("not failed")
    open_path = scratch_path(spark, "open-prompts")
    wanted.join(known.select("model", "digest"), ["model", "digest"], "left_anti").write.parquet(open_path)
    asked = spark.read.parquet(open_path)
    waves = -(-asked.count() // wave_prompts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded, answer = None, None
        failures: list[bool] = []

        def failed(error: Exception) -> str:
            failures.append(True)
            return f"{ERROR_PREFIX}{error}"

        for batch in batches:
            predictions, flags = [], []
            for name, text in zip(batch["model"], batch["prompt"]):
                if answer is None or name != loaded:
                    loaded, answer = name, paced(factory(name), pause, on_error=failed)
                failures.clear()
                predictions.append(answer(text))
                flags.append(bool(failures))
            yield pd.DataFrame({"model": batch["model"], "digest": batch["digest"], "prediction": predictions, "failed": flags})

    for wave in range(waves):
        own = asked.filter(F.pmod(F.xxhash64("model", "digest"), F.lit(waves)) == wave)
        own.repartition(partitions, "model", "digest").sortWithinPartitions("model").mapInPandas(run, LOG).write.mode("append").parquet(log)
    answers = read_answers(spark, log).select(F.col("model").alias(model), F.col("digest").alias("_digest"), "prediction")
    joined = lookup_join(keyed, answers, [model, "_digest"], spread=[c for c in df.columns if c != prompt])
    return joined.select(*df.columns, "prediction")
