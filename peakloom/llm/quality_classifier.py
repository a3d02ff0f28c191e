"""Compression classifier: does a text compress better with good or with bad examples at hand?

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. Every whole text is compressed piece by piece with each of them, and the
difference of the two sizes over the text's own size goes through a logistic curve fitted on
labelled texts that built no dictionary, weighted to the labels' true shares. That is the score: nothing but the difference enters it.

Fitting uses a bounded sample: per label the ``SAMPLE`` documents with the least
hashes among those labelled outside the held-out fifth, texts of more than
``LONGEST`` characters left out of fitting alone. Scoring covers every text whole.

Defined results: a null text counts as empty and gets the score of an empty text; a doc_id
with conflicting labels is not learnt from; without labels of both kinds the score is
the share of good labels (one half without any); a null doc_id is held out of learning but
scored; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import table

#: Labelled texts per label; the longest one used in fitting; bytes of a dictionary, of a piece; level.
SAMPLE, LONGEST, DICTIONARY, PIECE, LEVEL = 2000, 65_536, 65_536, 256, 3
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    """Two dictionaries and the curve; ``constant`` where there was nothing to learn from."""

    good: bytes = b""
    bad: bytes = b""
    centre: float = 0.0
    scale: float = 1.0
    weights: tuple = ()
    constant: float | None = None

    def compressors(self):
        kinds = [zstandard.ZstdCompressionDict(x) for x in (self.good, self.bad)]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=k) for k in kinds]

    def scores(self, differences: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(differences), self.constant)
        z = (differences - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * z, -30, 30)))


def _pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def differences(texts, compressors) -> np.ndarray:
    """Per text: how many bytes fewer it takes with the good dictionary than with the bad one, over its own bytes; 0 if empty."""
    good, bad = compressors
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            pieces = _pieces(text)
            out[i] = sum(len(bad.compress(x)) - len(good.compress(x)) for x in pieces) / sum(map(len, pieces))
    return out


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"".join(samples)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents outside the held-out fifth."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", "y")
    shares = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Model(constant=shares.get(1, 0) / total if total else 0.5)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = own.where("y = 1").orderBy(*order).limit(SAMPLE).unionAll(own.where("y = 0").orderBy(*order).limit(SAMPLE))
    # At most twice SAMPLE ids, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.length("text") <= LONGEST)
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(*order).collect()
    half = {y: [r["text"] for r in rows if r["y"] == y] for y in (0, 1)}
    if min(map(len, half.values())) < 2:
        return Model(constant=shares[1] / total)
    cut = {y: max(1, len(t) // 2) for y, t in half.items()}
    model = Model(_dictionary(half[1][: cut[1]]), _dictionary(half[0][: cut[0]]))
    rest = [(t, y) for y in (0, 1) for t in half[y][cut[y] :]]
    x = differences([t for t, _ in rest], model.compressors())
    y = np.array([y for _, y in rest], float)
    centre, scale = float(x.mean()), float(x.std()) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    weight = np.where(y == 1, shares[1] / total / y.mean(), shares[0] / total / (1 - y.mean()))
    beta = np.zeros(z.shape[1])
    ridge = 1e-2 * np.eye(len(beta))
    ridge[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.centre, model.scale, model.weights = centre, scale, tuple(map(float, beta))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors() if model.constant is None else None
        for b in batches:
            texts = b.column("text").to_pylist()
            x = differences(texts, tools) if tools else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "doc_id long, score double")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
