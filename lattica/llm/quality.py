"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is compressed with
either, in windows of ``WINDOW`` bytes so that a text's own repetitions do not hide what it is like;
x = (size with the good one - size with the bad one) / bytes. A logistic curve over x, the normalised
size itself (a run of one word compresses to almost nothing with either) and the text's shortness (a
few words tell little) makes a calibrated score; it is fitted on labelled rows that the dictionaries
have not seen, weighted to the labels' true shares.

Fitted on at most ``PER_CLASS`` labelled rows of either label and ``SAMPLE_CHARS`` characters of
each (a bound for fitting only; every text is scored whole).

Defined cases: null counts as the empty text, whose sizes are 0 and shortness 1. Without labels of both kinds every score
is the share of label 1. Repeated rows keep one row each; conflicting labels are all used.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id_col, kept, labelled_sample, table

PER_CLASS = 3000
SAMPLE_CHARS = 3000
WINDOW = 256
LEVEL = 3
#: Bytes below which a text tells little.
SHORT = 48
MEASURES = 3
DICTIONARY_BYTES = 64 * 1024
#: The query's contract: predicted is 1 from this score.
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = measures(self.good, self.bad, texts) @ np.array(self.weights) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def measures(good: bytes, bad: bytes, texts: list[str | None]) -> np.ndarray:
    """A row a text: normalised difference, normalised size (either faded for short texts), shortness."""
    out = np.zeros((len(texts), MEASURES))
    if not good or not bad:
        return out
    cg, cb = (c.compress for c in kept(("dictionaries", good, bad), lambda: (compressor(good), compressor(bad))))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        with_good = with_bad = 0
        for lo in range(0, len(raw), WINDOW):
            piece = raw[lo : lo + WINDOW]
            with_good += len(cg(piece))
            with_bad += len(cb(piece))
        n = len(raw)
        out[i] = max(-0.4, min(0.4, (with_good - with_bad) / (n + SHORT))), min(1.5, with_good / (n + SHORT)), SHORT / (n + SHORT)
    return out


def dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Weights and offset by Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-2 * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        step = np.clip(np.linalg.solve(h, g), -3, 3)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    w = b[:-1] / scale
    return tuple(map(float, w)), float(b[-1] - w @ mean)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels of rows whose crc32 of the id is not 0 modulo 5."""
    rows, share = labelled_sample(docs, labels, "quality", crc_of_id_col() % 5 != 0, PER_CLASS, SAMPLE_CHARS)
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    part = {(v, side): [t for i, (_, t, y) in enumerate(r for r in rows if r[2] == v) if i % 2 == side] for v in (0, 1) for side in (0, 1)}
    good, bad = dictionary(part[1, 0]), dictionary(part[0, 0])
    if not good or not bad or not part[1, 1] or not part[0, 1]:
        return Model(good, bad, (0.0,) * MEASURES, prior)
    x = np.concatenate([measures(good, bad, part[v, 1]) for v in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(part[0, 1]), len(part[1, 1])])
    n1, n0 = y.sum(), len(y) - y.sum()
    weights, offset = logistic(x, y, np.where(y == 1, share / n1, (1 - share) / n0) * len(y))
    return Model(good, bad, weights, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= ACCEPT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (crc_of_id_col() % 5 == 0).alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(s >= ACCEPT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
