"""Toxicity by a classifier chain: linear models, each fed with the probabilities of the earlier categories.

Categories come from the labels table, in chain order: toxic prose, toxic junk (by the quality label), toxic at all.
Each link is an L2 logistic regression over counts of selected word features; in training, the probabilities that a
later link sees are out-of-fold predictions, so they are as honest as those it meets in use.

Features.  Words are runs of letters and digits, A-Z in lower case.  A word gives itself, its first 3 to 6 bytes and its
last 4 and 5: word families with a common stem count as one.  Document frequencies of all features over the
training rows are counted in Spark; the FEATURES most telling ones (likelihood ratio) stay, of those beyond what
chance gives among so many candidates (a ratio of 2 log of their number).

Fitting uses TRAIN_ROWS labelled rows at most, chosen by a hash of the id; scoring reads every document whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, record_batch, slices

CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")
#: Bound of the labelled rows that the models are fitted on.
TRAIN_ROWS = 20_000
FEATURES, MIN_DOCS, FOLDS, L2, THRESHOLD, MAX_FEATURE_BYTES = 256, 5, 4, 0.05, 0.5, 32

_LETTERS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(128)) + bytes(range(128, 256))
_COUNTED = pa.schema([("feature", pa.binary()), ("n", pa.int64()), ("pos", pa.int64())])
_VECTORS = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("quality", pa.int32()),
                      ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _words(text: bytes | None) -> Counter:
    return Counter(text.lower().translate(_LETTERS).split()) if text else Counter()


def _features(word: bytes) -> list[bytes]:
    # a long word is known by the digest of all its bytes
    whole = b"=" + word if len(word) <= MAX_FEATURE_BYTES else b"#" + xxhash.xxh3_128_digest(word)
    found = [whole] + [b"^" + word[:k] for k in range(3, 7) if len(word) > k]
    return found + [word[-k:] + b"$" for k in (4, 5) if len(word) > k]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of features, summed in bounded pieces."""
    every, positive = Counter(), Counter()

    def emit():
        keys = list(every)
        return record_batch(_COUNTED, keys, [every[k] for k in keys], [positive[k] for k in keys])

    for part in slices(batches):
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            own = {f for w in _words(text) for f in _features(w)}
            every.update(own)
            if toxic:
                positive.update(own)
        if len(every) > 400_000:
            yield emit()
            every, positive = Counter(), Counter()
    yield emit()


class _Vectorizer:
    """Counts of the selected features; known words are remembered, up to a bound."""

    def __init__(self, names: list[bytes]):
        self.place, self.seen = {f: k for k, f in enumerate(names)}, {}

    def __call__(self, text: bytes | None) -> dict[int, int]:
        found: dict[int, int] = {}
        for word, n in _words(text).items():
            at = self.seen.get(word)
            if at is None:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                at = self.seen[word] = tuple(k for f in _features(word) if (k := self.place.get(f)) is not None)
            for k in at:
                found[k] = found.get(k, 0) + n
        return found

    def __getstate__(self):
        return {"place": self.place, "seen": {}}


def _vectors(vectorizer: _Vectorizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [vectorizer(t) for t in part.column("text").to_pylist()]
            yield record_batch(_VECTORS, part.column("id"), part.column("toxic"), part.column("quality"),
                               [list(f) for f in found], [list(f.values()) for f in found])
    return run


def _dense(found: list[dict[int, int]], odds: np.ndarray) -> np.ndarray:
    """Feature rows: log counts, then the summed and the largest log odds of what occurs, and 1."""
    x = np.zeros((len(found), len(odds) + 3))
    for row, f in enumerate(found):
        if f:
            at = np.fromiter(f, int, len(f))
            x[row, at] = np.log1p(np.fromiter(f.values(), float, len(f)))
            x[row, -3], x[row, -2] = np.clip(odds[at].sum(), -20, 20), odds[at].max()
    x[:, -1] = 1
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """L2 logistic regression by Newton steps; row k stands for n[k] training rows."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], L2)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


class ToxicityModel:
    """The fitted chain: ``score(texts)`` gives one column of probabilities per category."""

    def __init__(self, names: list[bytes], odds: np.ndarray, links: list[np.ndarray]):
        self.vectorizer, self.odds, self.links = _Vectorizer(names), odds, links

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = _dense([self.vectorizer(t) for t in texts], self.odds)
        p = np.zeros((len(texts), 0))
        for w in self.links:
            p = np.column_stack([p, sigmoid(np.column_stack([p, x]) @ w)])
        return p


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit the chain on documents with a toxic label (rows with a NULL id or label are left out; no labels at all give a
    model that calls nothing toxic)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("toxic").cast("int").alias("toxic"),
                           F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("quality"))
             .where("lid is not null and toxic is not null")
             .groupBy("lid").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
             .join(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc")), F.col("lid") == F.col("doc"), "left_semi")
             .orderBy(F.xxhash64("lid", F.lit(7)), "lid").limit(train_rows))
    # train_rows rows of 16 bytes: a broadcast of proven size
    rows = cut(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
               .join(F.broadcast(known), F.col("id") == F.col("lid")).select("id", "text", "toxic", "quality"), "labelled")
    n, pos = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return ToxicityModel([], np.zeros(0), [np.array([0.0] * k + [0.0, 0.0, -20.0]) for k in range(len(CATEGORIES))])
    a, b, m = F.col("pos"), F.col("n") - F.col("pos"), float(n - pos)
    rate = F.col("n") / float(n)
    part = lambda k, of, r: F.when(k > 0, k * F.log(k / (of * r))).otherwise(0.0)
    ratio = 2 * (part(a, float(pos), rate) + part(b, m, rate) + part(pos - a, float(pos), 1 - rate) + part(m - b, m, 1 - rate))
    odds = F.log((a + 0.5) / (float(pos) + 1)) - F.log((b + 0.5) / (m + 1))
    counted = cut(rows.select("text", "toxic").mapInArrow(_count, "feature binary, n long, pos long")
                  .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
                  .where((F.col("n") >= MIN_DOCS) & (F.col("n") < n)), "features")
    chosen = (counted.withColumn("ratio", ratio).withColumn("odds", odds)
              .where(F.col("ratio") >= 2 * float(np.log(max(counted.count(), 2)))).orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect())
    names, weight = [bytes(r.feature) for r in chosen], np.array([r.odds for r in chosen], float)
    found = (rows.mapInArrow(_vectors(_Vectorizer(names)), "id long, toxic int, quality int, at array<int>, n array<int>")
             .orderBy("id").limit(2 * train_rows).collect())
    # equal rows of a fold are one row with a weight: most rows hold no feature at all
    rows = Counter((tuple(sorted(zip(r["at"], r["n"], strict=True))), r.toxic, r.quality, k % FOLDS) for k, r in enumerate(found))
    x, n = _dense([dict(r[0]) for r in rows], weight), np.array(list(rows.values()), float)
    toxic, good, fold = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    target = {"toxic_prose": toxic * good, "toxic_junk": toxic * (1 - good), "toxic": toxic}
    links, p = [], np.zeros((len(rows), 0))
    for name in CATEGORIES:
        y, own = target[name].astype(float), np.column_stack([p, x])
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            if (fold == k).any():
                out[fold == k] = sigmoid(own[fold == k] @ _logistic(own[fold != k], y[fold != k], n[fold != k]))
        links.append(_logistic(own, y, n))
        p = np.column_stack([p, out])
    return ToxicityModel(names, weight, links)


def score_column(model: ToxicityModel, text):
    """Struct column of the chain's probabilities for a text column (NULL and empty texts hold no feature)."""
    shared = pa.schema([(f"p_{c}", pa.float64()) for c in CATEGORIES])
    from pyspark.sql import SparkSession
    sent = SparkSession.active().sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            p = [own.score(list(texts.iloc[k:k + 512])) for k in range(0, len(texts), 512)]
            yield pd.DataFrame(np.concatenate(p) if p else np.zeros((0, len(shared))), columns=shared.names)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, ", ".join(f"{x} double" for x in shared.names))(text.cast("string").cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, p_toxic_prose, p_toxic_junk, p_toxic, toxic`` for every row, toxic being ``p_toxic >= threshold``.

    Defined cases: a NULL or empty text is scored like a text without any known feature; rows that repeat an id are scored
    one by one; a NULL id is kept as it is; an empty table gives no rows; without usable labels nothing is toxic;
    further columns are ignored.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, train_rows)
    scored = docs.select(F.col(f"`{id_col}`").alias("id"), score_column(model, F.col(f"`{text_col}`")).alias("p"))
    return scored.select("id", "p.*").withColumn("toxic", F.col("p_toxic") >= threshold)
