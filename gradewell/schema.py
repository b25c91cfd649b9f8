"""Schemas of the tables that pass between operators. Labels are always text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


PREDICTIONS = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("gold", T.StringType()),
        T.StructField("prediction", T.StringType()),
    ]
)

LABEL_COUNTS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

INSTRUCTION = _strings("instruction", "output")

FLAT_PREFERENCE = _strings("prompt", "chosen", "rejected")

CHAT_PREFERENCE = T.StructType(
    _strings("chosen", "rejected").fields
    + [T.StructField("score_chosen", T.IntegerType()), T.StructField("score_rejected", T.IntegerType())]
)

CHOICE = _strings("text", "value")

QUESTION = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("choice_a", CHOICE),
        T.StructField("choice_b", CHOICE),
    ]
)

# Input tables of the benchmark datasets, by the columns their scorers read.
INPUTS = {
    "gsm8k": _strings("question", "label"),
    "arc_easy": _strings("question", "choices", "label"),
    "boolq": _strings("passage", "question", "label"),
    "finance": _strings("text", "answer"),
    "edtsum": _strings("query", "answer"),
    "movie": _strings("Plot", "PlotSummary"),
    "text_label": _strings("text", "label"),
    "sst2": _strings("idx", "text", "label"),
    "news_summary": _strings("article", "highlights"),
    "meqsum": _strings("CHQ", "Summary"),
}


def with_prediction(schema: T.StructType) -> T.StructType:
    """Result-file schema: the input columns and the appended answer."""
    return T.StructType(schema.fields + [T.StructField("prediction", T.StringType())])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise when a needed column is absent."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
