"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A text is read as units: runs of letters (lower-cased), digits or signs, each with a unit for the case of its letters.
Every unit has a sparse random index vector derived from its hash; a word vector is the sum of the index vectors of the
units around the word. A document is the mean of its word vectors, with the logarithm of its length. A two-layer numpy
network is trained on labelled documents, and a temperature fitted on a part that it did not see makes its
probabilities honest.

The classifier is fitted on at most about ``SAMPLE_DOCUMENTS`` documents per label, drawn by hash, and keeps the
``VOCABULARY`` most frequent units; classes are weighted back to their true sizes. Texts are scored whole. A text
without units (null too) is the zero vector. Without labels every score is 0.5. Null labels are ignored; a document
with several labels counts with the highest. A null id counts as the empty text in the choice of held-out documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import fold, hand_over

FOLDS, THRESHOLD = 5, 0.3
SAMPLE_DOCUMENTS, VOCABULARY = 6_000, 20_000
DIMENSIONS, NONZERO, REACH = 64, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
# One in so many sampled documents is kept for the temperature.
CALIBRATION = 8
_REMEMBERED, _BLOCK = 500_000, 1_000
_UNITS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _case(raw: str) -> str | None:
    if raw.islower() or not raw.isalpha():
        return None
    return "\x01upper" if raw.isupper() and len(raw) > 1 else "\x01capital" if raw[1:].islower() or len(raw) == 1 else "\x01mixed"


def units_of(text: str) -> list[str]:
    """The units of a text in order; a case unit follows its word."""
    out = []
    for raw in _UNITS.findall(text):
        out.append(raw.lower())
        case = _case(raw)
        if case:
            out.append(case)
    return out


def index_vector(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a unit's random index vector, from its hash alone."""
    random = np.random.default_rng(crc32(unit.encode("utf-8", "surrogatepass")))
    places = random.choice(DIMENSIONS, NONZERO, replace=False)
    return places, np.where(np.arange(NONZERO) % 2, -1.0, 1.0)


def _unit_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(units_of(text or ""))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["unit", "n"])


def _context_blocks(batches: Iterable[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors around each word of the vocabulary, in blocks of rows."""
    size, known = len(vocabulary), {}
    sums = np.zeros(size * DIMENSIONS)
    places, signs = np.zeros((0, NONZERO), np.int64), index_vector("")[1]
    for batch in batches:
        found: list[np.ndarray] = []
        for text in batch.column(0).to_pylist():
            units = units_of(text or "")
            rows = np.fromiter((vocabulary.get(u, -1) for u in units), np.int64, len(units))
            for u in units:
                if u not in known:
                    known[u] = len(known)
                    found.append(index_vector(u)[0])
            if found:
                places, found = np.concatenate([places, np.stack(found)]), []
            ids = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            for step in range(1, REACH + 1):
                for words, context in ((rows[step:], ids[:-step]), (rows[:-step], ids[step:])):
                    inside = words >= 0
                    cells = words[inside][:, None] * DIMENSIONS + places[context[inside]]
                    np.add.at(sums, cells.ravel(), np.broadcast_to(signs, cells.shape).ravel())
            if len(known) > _REMEMBERED:
                known, places = {}, np.zeros((0, NONZERO), np.int64)
    blocks = sums.reshape(size, DIMENSIONS)
    starts = list(range(0, size, _BLOCK))
    yield pa.RecordBatch.from_arrays(
        [pa.array([s // _BLOCK for s in starts], pa.int32()), pa.array([blocks[s : s + _BLOCK].tobytes() for s in starts], pa.binary())],
        names=["block", "sums"],
    )


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table["sums"].to_pylist())
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


class Pooler:
    """Document vectors from a table of word vectors; unknown words share the last row."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors = vocabulary, vectors
        self.rows: dict[str, int] = {}
        self.table: list[np.ndarray] = []
        self.combined: dict[tuple, int] = {}
        self.matrix = np.zeros((0, DIMENSIONS + 1), np.float32)

    def __getstate__(self):
        return self.vocabulary, self.vectors

    def __setstate__(self, state):
        self.__init__(*state)

    def _row(self, raw: str) -> int:
        """Spellings with the same word row and case share a row: vector sum, and number of units."""
        case = _case(raw)
        key = (self.vocabulary.get(raw.lower(), len(self.vocabulary)), case)
        if key not in self.combined:
            vector = self.vectors[key[0]].copy()
            if case:
                vector += self.vectors[self.vocabulary.get(case, len(self.vocabulary))]
            self.combined[key] = len(self.table)
            self.table.append(np.append(vector, 2.0 if case else 1.0).astype(np.float32))
        return self.combined[key]

    def document(self, text: str | None) -> np.ndarray:
        raws = _UNITS.findall(text or "")
        total, rows = np.zeros(DIMENSIONS + 1), self.rows
        for at in range(0, len(raws), 50_000):
            part = raws[at : at + 50_000]
            if len(rows) > _REMEMBERED:
                rows.clear()
            for raw in set(part).difference(rows):
                rows[raw] = self._row(raw)
            if len(self.matrix) < len(self.table):
                self.matrix = np.concatenate([self.matrix, np.stack(self.table[len(self.matrix) :])])
            total += self.matrix[np.fromiter(map(rows.__getitem__, part), np.int64, len(part))].sum(axis=0)
        mean = total[:DIMENSIONS] / max(1.0, total[DIMENSIONS])
        return np.append(mean, np.log1p(total[DIMENSIONS]) / 10)


class Network:
    """Two layers, trained with Adam on weighted cross entropy, and a temperature."""

    def __init__(self, inputs: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.shift, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.parts = [random.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.random = random

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh((x - self.shift) / self.scale @ a + b) @ c + d[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, weight = (x - self.shift) / self.scale, weight / weight.mean()
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        step = 0
        for epoch in range(EPOCHS):
            order = self.random.permutation(len(z))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(z), BATCH):
                rows = order[at : at + BATCH]
                a, b, c, d = self.parts
                hidden = np.tanh(z[rows] @ a + b)
                error = (1 / (1 + np.exp(-np.clip(hidden @ c + d[0], -60, 60))) - y[rows]) * weight[rows] / len(rows)
                back = np.outer(error, c) * (1 - hidden**2)
                grads = [z[rows].T @ back + DECAY * a, back.sum(axis=0), hidden.T @ error + DECAY * c, np.array([error.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g**2
                    self.parts[i] = self.parts[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least weighted cross entropy."""
        logits = self.logits(x)
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [(weight * np.logaddexp(0, np.where(y > 0, -logits, logits) / t)).sum() for t in options]
        self.temperature = float(options[int(np.argmin(losses))])


class Classifier:
    def __init__(self, pooler: Pooler | None, network: Network | None):
        self.pooler, self.network = pooler, network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), 0.5)
        return self.network.probabilities(np.stack([self.pooler.document(t) for t in texts]))


def _document_vectors(batches: Iterable[pa.RecordBatch], pooler) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [pooler.value.document(t).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), *batch.columns[1:]], names=["vector", *batch.schema.names[1:]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE_DOCUMENTS) -> Classifier:
    """Fit on the labelled documents outside the held-out fold. Only bounded tables reach the driver."""
    context = docs.sparkSession.sparkContext
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), FOLDS) != 0)).groupBy(
        F.col(id_col).cast("long").alias("id")
    ).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not sizes:
        return Classifier(None, None)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = hand_over(  # the sample is bounded, so it is broadcast and no text is shuffled
        texts.join(F.broadcast(drawn), "id").select("text", "label", (F.pmod(F.xxhash64("id", F.lit(29)), F.lit(CALIBRATION)) == 0).alias("calibrate")),
        "quality-sample",
    )
    counted = rows.select("text").mapInArrow(_unit_counts, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    vocabulary = {r["unit"]: i for i, r in enumerate(counted.orderBy(F.desc("n"), "unit").limit(VOCABULARY).collect())}
    shared = context.broadcast(vocabulary)
    blocks = rows.select("text").mapInArrow(lambda x: _context_blocks(x, shared.value), "block int, sums binary")
    parts = {r["block"]: np.frombuffer(bytes(r["sums"])) for r in
             blocks.groupBy("block").applyInArrow(_add_blocks, "block int, sums binary").collect()}
    vectors = np.concatenate([parts[b] for b in sorted(parts)] or [np.zeros(0)]).reshape(-1, DIMENSIONS)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    pooler = Pooler(vocabulary, np.concatenate([vectors, np.zeros((1, DIMENSIONS))]).astype(np.float32))
    shared_pooler = context.broadcast(pooler)
    found = rows.mapInArrow(lambda x: _document_vectors(x, shared_pooler), "vector binary, label int, calibrate boolean").collect()
    if not found:
        return Classifier(None, None)
    found.sort(key=lambda r: (bytes(r["vector"]), r["label"]))  # training does not depend on the order of arrival
    x = np.stack([np.frombuffer(bytes(r["vector"])) for r in found])
    y = np.array([float(r["label"] > 0) for r in found])
    drawn_sizes = Counter(r["label"] for r in found)
    weight = np.array([sizes[r["label"]] / drawn_sizes[r["label"]] for r in found])
    aside = np.array([r["calibrate"] for r in found])
    network = Network(x.shape[1])
    if (~aside).any():
        network.fit(x[~aside], y[~aside], weight[~aside])
    if aside.any():
        network.calibrate(x[aside], y[aside], weight[aside])
    return Classifier(pooler, network)


def _score_batches(batches: Iterable[pa.RecordBatch], classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = classifier.value.scores(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    classifier = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(lambda x: _score_batches(x, classifier), "doc_id long, held_out boolean, score double, predicted int")
