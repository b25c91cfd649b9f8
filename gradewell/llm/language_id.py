"""Language identification that scores words first and falls back to character n-grams.

Training counts words and the n-grams of words (length 4 to 1, with marks at both ends) per language over labelled
documents. A known word scores its log frequency in each language. An unseen word scores by its 4-grams; a 4-gram that
is unknown too gives way to its two 3-grams, and so on. A document's score is the sum over its words.

The classifier is fitted on a sample: at most about ``SAMPLE_DOCUMENTS`` documents of each language, drawn by hash of id and
text, so that copies of a text are drawn one by one. It
keeps the ``MODEL_ROWS`` most frequent words and as many n-grams of each length, so its size is bounded. Texts are
scored whole. Null text and text without a letter, or a table without labels, gives ``und`` with score 0; ties go to
the language that sorts first. A null id counts as the empty text in the choice of held-out documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.llm.common import fold, hand_over
from gradewell.plans.skew import number_rows

FOLDS, UNDETERMINED = 5, "und"
SAMPLE_DOCUMENTS, MODEL_ROWS, LONGEST_GRAM = 5_000, 100_000, 4
# Words of evidence that count in full towards the score's confidence.
CONFIDENT_WORDS = 8
# Additive smoothing of frequencies.
SMOOTHING = 0.5
_REMEMBERED = 300_000
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; runs of other number signs without any letter do not count."""
    found = _WORDS.findall(text.lower())
    return found if found and any(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, length, unit); length 0 is a word."""
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, seen in counts.items():
            units: Counter = Counter({(0, w): c for w, c in seen.items()})
            for word, c in seen.items():
                for n in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, n):
                        units[n, gram] += c
            if units:
                lengths, names = zip(*units)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(units)), pa.array(lengths, pa.int32()), pa.array(names), pa.array(units.values(), pa.int64())],
                    names=["lang", "length", "unit", "n"],
                )

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > 200_000:
            yield from out()
            counts.clear()
    yield from out()


class Model:
    """Rows of centred log frequencies per language, found by word or gram."""

    def __init__(self, languages: list[str], units: list[dict[str, int]], table: np.ndarray):
        self.languages, self.units, self.table = languages, units, table
        self._reset()

    def __getstate__(self):
        return self.languages, self.units, self.table

    def __setstate__(self, state):
        self.__init__(*state)

    def _reset(self) -> None:
        self.rows, self.extra = dict(self.units[0]), []

    def _gram_rows(self, gram: str, out: list[int]) -> None:
        row = self.units[len(gram)].get(gram)
        if row is not None:
            out.append(row)
        elif len(gram) > 1:
            self._gram_rows(gram[:-1], out)
            self._gram_rows(gram[1:], out)

    def _unseen(self, word: str) -> np.ndarray:
        found: list[int] = []
        n = min(LONGEST_GRAM, len(word) + 2)
        for gram in grams_of(word, n):
            self._gram_rows(gram, found)
        return self.table[found].mean(axis=0) if found else np.zeros(len(self.languages), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The sum of word scores per language."""
        base, total = len(self.table), np.zeros(len(self.languages))
        for at in range(0, len(words), 100_000):
            part, rows = words[at : at + 100_000], self.rows
            if len(self.extra) > _REMEMBERED:
                self._reset()
                rows = self.rows
            for word in set(part).difference(rows):
                rows[word] = base + len(self.extra)
                self.extra.append(self._unseen(word))
            found = np.fromiter(map(rows.__getitem__, part), np.int64, len(part))
            known = found < base
            total += self.table[found[known]].sum(axis=0, dtype=np.float64)
            for row in found[~known].tolist():
                total += self.extra[row - base]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        total = self.scores(words) / len(words) * min(len(words), CONFIDENT_WORDS)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _ranked(counts: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(length, unit, by, position) from the most frequent unit of each length on, and the first position of each length.

    The order is made by ranges on the executors; the driver would have to merge the best ``MODEL_ROWS`` rows of every task.
    """
    found = counts.groupBy("length", "unit").agg(
        (-F.sum("n")).alias("_less"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    ranked = number_rows(found, ["length", "_less", "unit"])
    starts = {r["length"]: r["start"] for r in ranked.groupBy("length").agg(F.min("position").alias("start")).collect()}
    return ranked, starts


def _frequencies(by: pa.ChunkedArray, languages: list[str]) -> np.ndarray:
    """Units by languages, from Arrow maps of language to count."""
    table = np.zeros((len(by), len(languages)))
    at = 0
    for maps in by.chunks:
        sizes = np.diff(maps.offsets.to_numpy())
        first, last = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
        rows = at + np.repeat(np.arange(len(maps)), sizes)
        columns = pc.index_in(maps.keys[first:last], pa.array(languages, maps.keys.type)).to_numpy(zero_copy_only=False)
        table[rows, columns] = maps.items[first:last].to_numpy(zero_copy_only=False)
        at += len(maps)
    return table


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE_DOCUMENTS, id_col: str = "doc_id") -> Model:
    """Fit on labelled rows. Counting runs on the executors; only the bounded model reaches the driver."""
    labelled = docs.select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")
    ).where("lang is not null and text is not null")
    per_language = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(per_language)
    if not languages:
        return Model([], [{} for _ in range(LONGEST_GRAM + 1)], np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in per_language.items() for x in (k, min(1.0, sample / n))])
    drawn = labelled.where(F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = hand_over(
        drawn.drop("id").mapInArrow(_count_batches, "lang string, length int, unit string, n long")
        .groupBy("length", "unit", "lang").agg(F.sum("n").alias("n")), "language-counts",
    )
    totals = {(r["length"], r["lang"]): r["n"] for r in counts.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    ranked, starts = _ranked(counts)
    units: list[dict[str, int]] = []
    tables = []
    for length in range(LONGEST_GRAM + 1):
        start = starts.get(length, 0)
        top = ranked.where((F.col("length") == length) & F.col("position").between(start, start + MODEL_ROWS - 1)).select("unit", "by").toArrow()
        table = _frequencies(top["by"], languages)
        table = np.log((table + SMOOTHING) / (np.array([totals.get((length, k), 0) for k in languages]) + SMOOTHING * (len(table) + 1)))
        peak = table.max(axis=1, keepdims=True) if len(table) else table
        table -= peak + np.log(np.exp(table - peak).sum(axis=1, keepdims=True))
        at = sum(map(len, tables))
        units.append(dict(zip(top["unit"].to_pylist(), range(at, at + len(table)))))
        tables.append(table.astype(np.float32))
    return Model(languages, units, np.concatenate(tables))


def _predict_batches(batches: Iterable[pa.RecordBatch], model, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value.predict(t.as_py()) for t in batch.column(text_at)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"],
        )


def _predicted(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """``rows`` with lang_pred and score; column names must not clash with these."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(rows.schema.fields + found)
    text_at = rows.columns.index(text)
    return rows.mapInArrow(lambda x: _predict_batches(x, shared, text_at), schema)


def _training_rows(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.where(fold(F.col(id_col), FOLDS) != 0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    model = train(_training_rows(docs, id_col), text_col, label_col, id_col=id_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == 0).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    return _predicted(rows, "text", model).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language was determined, however uncertain a short text leaves it.

    Without any labelled row no language can be, and the rows with a letter stay.
    """
    model = train(_training_rows(docs, id_col), text_col, label_col, id_col=id_col)
    if not model.languages:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = _predicted(plain, f"c{docs.columns.index(text_col)}", model).where(F.col("lang_pred") != UNDETERMINED)
    return kept.drop("lang_pred", "score").toDF(*docs.columns)
