"""Document quality by regularised quadratic discriminant analysis.

Document statistics are transformed and standardised; each class gets a mean and a covariance that is shrunk to
its own diagonal and to the pooled covariance; a score is the logistic of the difference of the two Mahalanobis
log-densities, computed with Cholesky factors that are inverted once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace, drawn

SAMPLE = 20_000
FEATURES = (
    "log_words", "log_bytes_per_word", "lower_share", "upper_share", "digit_share", "wide_share", "stop_share", "symbol_share",
    "pair_share", "upper_words", "marked_words", "bare_words", "distinct_words", "top_word", "log_words_per_line", "repeated_lines", "entropy",
)
PUNCTUATION = b".,;:'\"()-?"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text, each finite; a text without words has its own fixed point."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = max(1, len(text))
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    m = max(1, len(words))
    lower, upper, digit, wide = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum()
    stop = sum(counts[c] for c in PUNCTUATION)
    space = counts[32] + counts[9:14].sum()
    symbol = n - lower - upper - digit - wide - stop - space
    letters = max(1, lower + upper + wide)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    caps = marked = bare = 0
    for w, k in tally.items():
        if w.isupper() and len(w) > 1:
            caps += k
        if (last := w[-1]) not in LETTERS and last not in PUNCTUATION and not 48 <= last <= 57:
            marked += k
        if not w.strip(PUNCTUATION).isalpha() and not any(c > 127 for c in w):
            bare += k
    p = counts[counts > 0] / n
    share = lambda a, b: float(np.log((a + 0.5) / (b + 20.0)))
    return [
        float(np.log1p(len(words))),
        float(np.log(n / m)),
        lower / letters,
        share(upper, letters),
        share(digit, n),
        wide / letters,
        share(stop, n),
        share(max(0, symbol), n),
        share(text.count(b"!!") + text.count(b" | "), m),
        share(caps, m),
        share(marked, m),
        share(bare, m),
        float(np.log((len(tally) + 1) / (m + 1)) / np.log(m + 2)),
        share(max(tally.values(), default=0), m),
        float(np.log1p(len(words) / max(1, len(lines)))),
        share(len(lines) - len(set(lines)), len(lines)),
        float(-(p * np.log(p)).sum()),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid and len(t.as_buffer() or b"") else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x array<double>")


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray  # inverse Cholesky factors
    log_det: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        part = [-0.5 * (((z - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) - self.log_det[c] for c in (0, 1)]
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.intercept, -700, 700)))


def discriminant(x: np.ndarray, y: np.ndarray, diagonal: float, pooled: float) -> Model:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    groups = [z[y == c] for c in (0, 1)]
    covariances = [np.cov(g.T) if len(g) > 1 else np.eye(x.shape[1]) for g in groups]
    both = sum(c * len(g) for c, g in zip(covariances, groups)) / len(x)
    means, whiten, log_det = [], [], []
    for g, c in zip(groups, covariances):
        s = (1 - pooled) * c + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        means.append(g.mean(0))
        whiten.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Model(centre, scale, np.array(means), np.array(whiten), np.array(log_det))


def calibration(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept for the log-density difference, by Newton steps on a lightly penalised log-loss."""
    scale = np.abs(d).mean() + 1e-9
    a, b, x = 1.0, 0.0, np.clip(d / scale, -20, 20)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return (max(float(a), 1e-6) / scale, float(b)) if np.isfinite([a, b]).all() else (1.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, folds: int = 4) -> Model | None:
    """The shrinkage with the best cross-validated log-loss; None where a class has fewer than two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    fold = np.arange(len(y)) % folds
    best: tuple[float, tuple[float, float], np.ndarray] | None = None
    for choice in ((0.05, 0.0), (0.2, 0.0), (0.1, 0.2), (0.3, 0.3), (0.6, 0.3), (0.8, 0.6)):
        d = np.zeros(len(y))
        for k in range(folds):
            train = fold != k
            if min((y[train] == 0).sum(), (y[train] == 1).sum()) < 2:
                model = discriminant(x, y, 0.8, 0.6)
                model.slope, model.intercept = calibration(model.difference(x), y)
                return model
            d[~train] = discriminant(x[train], y[train], *choice).difference(x[~train])
        slope, intercept = calibration(d, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * d + intercept, -35, 35))), 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0]:
            best = (loss, choice, d)
    _, choice, d = best
    model = discriminant(x, y, *choice)
    model.slope, model.intercept = calibration(d, y)
    return model


def held_out(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the labels that may be learned from."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    return known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))


def fitted(rows: DataFrame, known: DataFrame) -> Model | None:
    """The model of the known labels; known is a bounded sample, so it is broadcast and its statistics collected."""
    train = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").collect()
    train.sort(key=lambda r: r.id)
    return fit(np.array([r.x for r in train]), np.array([r.y for r in train])) if train else None


def scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, held_out, score): score is the fitted probability of label 1.

    Labels are learned only from rows that are not held out, at most about `sample` of them, chosen by a hash of the
    id. A label that is null is left out; an id with several labels takes the larger one; rows that repeat an id are
    scored each, and the one of smallest statistics is learned from. With too few labels of either class every score
    is 0.5. Null and empty texts are scored by their statistics like any other. A very long text is counted whole; a
    task holds its words. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = work.table(features(docs, id_col, text_col), "features")
    model = fitted(rows, drawn(learnable(labels, id_col, label_col), sample, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy().reshape(n, len(FEATURES)) if n else np.zeros((0, len(FEATURES)))
            s = model.score(x) if model is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, "id long, score double").select("id", held_out(F.col("id")).alias("held_out"), "score")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is 0.5 or more, in one pass over their texts.

    The model is fitted on at most about `sample` labelled ids that are not held out, chosen by a hash of the id. With
    too few labels of either class every row stays.
    """
    known = drawn(learnable(labels, id_col, label_col), sample, "id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("id")), "id", "left_semi")
    model = fitted(features(rows, "id", "text"), known)
    if model is None:
        return docs
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid and len(t.as_buffer() or b"") else b"") for t in batch.column(place)])
                yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
