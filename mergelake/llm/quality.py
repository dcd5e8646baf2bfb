"""Quality classifier: two zstandard dictionaries, trained on good and on bad text; the normalised difference of a text's
compressed sizes under them becomes a calibrated probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import small_batches
from mergelake.llm.units import balanced, release, text_bytes

#: Texts are compressed in pieces of so many bytes: a longer window would learn the text itself and forget the dictionary.
PIECE = 256
LEVEL = 3
#: The bounded sample that the model is fitted on: labelled rows of each class, and bytes taken of each.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16_384
DICTIONARY_BYTES = 50_000


@dataclass(frozen=True)
class Model:
    """good, bad: dictionaries (empty: nothing learnt). A text's score is 1 / (1 + exp(-(intercept + slope * difference)))."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0


class Differences:
    """Normalised difference of compressed sizes: (bad - good) / (bad + good), over all pieces of the whole text."""

    def __init__(self, model: Model):
        import zstandard

        self.sizes = []
        for content in (model.good, model.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.sizes.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def of(self, text: bytes) -> float:
        good, bad = self.sizes
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        a, b = sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)
        return (b - a) / (a + b) if a + b else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a slight ridge that keeps them finite on separable rows."""
    scale = float(x.std()) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on labelled rows that aren't held out: SAMPLE_ROWS of each class by hash order of doc_id, SAMPLE_BYTES of each
    text. Alternate rows train the dictionaries and calibrate the score, so calibration sees texts that the dictionaries
    don't know; calibration weighs the classes as often as they occur among all training labels.

    Null labels and null doc_ids aren't used; a doc_id with several labels counts with the largest. Without both classes
    the model scores 0.5 throughout.
    """
    import zstandard

    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.filter(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return Model()
    order = F.xxhash64("doc_id")
    chosen = known.filter("y = 1").orderBy(order, "doc_id").limit(SAMPLE_ROWS).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(SAMPLE_ROWS))
    sample = docs.select("doc_id", F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sorted(((r["y"], r["doc_id"], bytes(r["text"] or b"")) for r in sample.filter("text IS NOT NULL").collect()), key=lambda r: r[:2])
    fit, check, dictionaries = [], [], []
    for y in (0, 1):
        own = [r for r in rows if r[0] == y]
        fit, check = fit + own[::2], check + own[1::2]
    for y in (1, 0):
        pieces = [t[i : i + PIECE] for k, _, t in fit if k == y for i in range(0, len(t), PIECE)]
        try:
            size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 4))
            dictionaries.append(zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            dictionaries.append(b"".join(pieces)[:DICTIONARY_BYTES])
    if not all(dictionaries):
        return Model()
    model = Model(*dictionaries)
    check = check or fit
    differences = Differences(model)
    y = np.asarray([r[0] for r in check], float)
    if len({*y}) < 2:
        return Model()
    x = np.asarray([differences.of(r[2]) for r in check])
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(model.good, model.bad, *_logistic(x, y, weight))


def _scores(texts: pa.Array, model: Model, differences: Differences | None) -> np.ndarray:
    data, offsets, _ = text_bytes(texts)
    x = np.zeros(len(texts))
    if differences and len(data):
        whole = memoryview(data)
        x = np.asarray([differences.of(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
    return 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -60, 60)))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text alone; one pass, no shuffle.

    Null and empty texts get the score of no difference; so does all, if the model learnt nothing. Null doc_ids are kept
    (held_out false); repeated rows are scored each; columns besides doc_id and text aren't read.
    """
    small_batches(docs.sparkSession)

    def scored(batches):
        release()
        differences = Differences(model) if model.good else None
        for batch in balanced(batches):
            score = _scores(batch.column(1), model, differences)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `threshold`; one pass, no shuffle. Edge cases as in score_quality."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches):
        release()
        differences = Differences(model) if model.good else None
        for batch in balanced(batches):
            yield batch.filter(pa.array(_scores(batch.column(at), model, differences) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
