"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Method.  A text is described by STATISTICS numbers (shares of character classes, word and line shape, repetition).
Standardised, they go through D random Fourier features, which approximate a Gaussian kernel.  The ridge scores solve the
normal equations; each task sums its rows' part of them, and the parts are added in Spark, so no training row reaches
the driver and every labelled training row counts.  A quarter of the training rows is kept from the fit and calibrates:
scores are counted in BINS bins, and isotonic regression over the bins gives probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import crc_mod, cut, id_text, record_batch, slices

FOURIER, RIDGE, BINS, THRESHOLD, SEED = 256, 1.0, 512, 0.3, 17
#: Every how many-th training row calibrates instead of fitting.
CALIBRATE = 4

_CLASS = np.zeros(256, np.int64)
for _c in range(128):
    _CLASS[_c] = (1 if chr(_c).isupper() else 2 if chr(_c).islower() else 3 if chr(_c).isdigit()
                  else 4 if chr(_c).isspace() else 5 if chr(_c) in ".,;:'\"-()?" else 6 if chr(_c) in "!" else 7 if chr(_c) == "|" else 8)
_CLASS[128:] = 9
_STATS = pa.schema([("id", pa.int64()), ("stats", pa.list_(pa.float64()))])
STATISTICS = 22


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS numbers of a whole text (all 0 for a NULL or empty one)."""
    if not text:
        return [0.0] * STATISTICS
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=10) / len(text)
    p = byte[byte > 0] / len(text)
    ws, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(ws), 1)
    counts, own = Counter(ws), Counter(lines)
    long_lines = sum(len(x) for x in lines) or 1
    letters = kind[1] + kind[2] + kind[9] or 1.0
    return [np.log1p(len(text)), np.log1p(len(ws)), sum(map(len, ws)) / n, kind[1] / letters, *kind[3:10].tolist(),
            float(-(p * np.log(p)).sum()), len(counts) / n, max(counts.values(), default=0) / n,
            sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, sum(w.isalpha() for w in ws) / n,
            sum(len(w) <= 2 for w in ws) / n, sum(w.isupper() and len(w) > 1 for w in ws) / n, np.log1p(len(lines)), np.log1p(long_lines / max(len(lines), 1)),
            sum(len(k) * (c - 1) for k, c in own.items()) / long_lines, np.log1p(max(map(len, ws), default=0))]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield record_batch(_STATS, part.column("id"), [statistics(t) for t in part.column("text").to_pylist()])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATISTICS)


class Fourier:
    """Standardisation and random Fourier features of a Gaussian kernel of width sqrt(STATISTICS)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int = FOURIER):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, size)), rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.column_stack([z, np.ones(len(z))])


def _partial_sums(fourier: Fourier):
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for part in slices(batches, 1024):
            z, y = fourier(_matrix(part.column("stats"))), np.array(part.column("label").to_pylist(), float)
            total += z.T @ np.column_stack([z, y])
        yield record_batch(schema, np.arange(len(total), dtype=np.int32), total.tolist())
    return run


def _add_rows(key: tuple, table: pa.Table) -> pa.Table:
    rows = np.array(table.column("row").to_pylist(), float)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def isotonic(x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in order: knots and non-decreasing rates between which scores are interpolated."""
    blocks: list[list[float]] = []
    for at, count, ones in zip(x, n, pos, strict=True):
        blocks.append([at * count, count, ones])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # one success and one failure are added to each block: no rate is 0 or 1 for sure
    return (np.array([b[0] / b[1] for b in blocks]),
            np.maximum.accumulate(np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])))


class QualityModel:
    def __init__(self, fourier: Fourier, w: np.ndarray, knots: np.ndarray, rates: np.ndarray):
        self.fourier, self.w, self.knots, self.rates = fourier, w, knots, rates

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.w

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a trace of the raw score keeps ties of a flat stretch in order."""
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(0.998 * np.interp(raw, self.knots, self.rates) + 0.001 + 0.001 * np.tanh(raw - 0.5), 0, 1)


def _binned(model: QualityModel):
    schema = pa.schema([("bin", pa.int32()), ("x", pa.float64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            raw = model.raw(_matrix(part.column("stats")))
            yield record_batch(schema, np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32), raw, part.column("label"))
    return run


def _scored(model: QualityModel):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            yield record_batch(schema, part.column("id"), model.score(_matrix(part.column("stats"))))
    return run


def fit_quality(stats: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> QualityModel:
    """Fit on the described rows with a quality label whose fold isn't held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("label"))
             .where("lid is not null and label is not null").where(crc_mod("lid", folds) != held)
             .groupBy("lid").agg(F.min("label").alias("label")))
    rows = cut(stats.join(known, F.col("id") == F.col("lid")).select("id", "stats", "label"), "quality-train")
    each = [F.col("stats")[k] for k in range(STATISTICS)]
    size, *moments = rows.agg(F.count("*"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    if not size:
        none = np.zeros(0)
        return QualityModel(Fourier(np.zeros(STATISTICS), np.ones(STATISTICS)), none, none, none)
    fourier = Fourier(np.array(moments[:STATISTICS], float), np.array(moments[STATISTICS:], float))
    turn = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(CALIBRATE))
    sums = (rows.where(turn != 0).select("stats", "label").mapInArrow(_partial_sums(fourier), "i int, row array<double>")
            .groupBy("i").applyInArrow(_add_rows, "i int, row array<double>").orderBy("i").collect())
    total = np.array([r.row for r in sums], float) if sums else np.zeros((FOURIER + 1, FOURIER + 2))
    w = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(FOURIER + 1), total[:, -1])
    model = QualityModel(fourier, w, np.zeros(0), np.zeros(0))
    bins = (rows.where(turn == 0).select("stats", "label").mapInArrow(_binned(model), "bin int, x double, label int")
            .groupBy("bin").agg(F.avg("x"), F.count("*"), F.sum("label")).orderBy("bin").collect())
    if bins:
        model.knots, model.rates = isotonic(*(np.array([r[k] for r in bins], float) for k in (1, 2, 3)))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                   held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for every row; only the text is an input of a score.

    Labels are learned from rows whose crc32 of the id modulo ``folds`` isn't ``held``.  Defined cases: a NULL or empty text
    has all statistics 0 and is scored like any other; rows that repeat an id are scored one by one (of labels that repeat
    an id, the lowest counts); a NULL id is not held out and has no label; an empty table gives no rows; without usable
    labels every score is 0.5; further columns are ignored.
    """
    stats = cut(id_text(docs, id_col, text_col, binary=True).mapInArrow(_describe, "id long, stats array<double>"), "quality-stats")
    model = fit_quality(stats, labels, folds, held)
    return (stats.mapInArrow(_scored(model), "id long, score double")
            .select("id", F.coalesce(crc_mod("id", folds) == held, F.lit(False)).alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))
