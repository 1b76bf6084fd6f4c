"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a dozen surface statistics, each statistic a bin.  Boosting goes round the features cyclically: a
shallow tree of at most four leaves on one feature's bins is fitted to the logistic gradient and added, shrunk, to that
feature's lookup table.  The pairs with the largest remaining gain then get two-way tables the same way.  A score is the
sum of table entries, looked up for whole batches at once.

The model is fitted on the driver from at most ``sample`` labelled rows, chosen by a seeded hash of the id (a documented
bound: the tables have a few thousand entries).  Scoring reads every text in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_bytes", "upper_share", "symbol_share", "bang_share", "stop_share", "comma_share", "digit_share",
    "line_share", "distinct_words", "distinct_lines", "non_ascii_share", "deflated_share",
)
_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[list(b"#$%&*@^~|<>{}[]\\=+_")] = True


def features(text: bytes | None) -> list[float]:
    """Statistics of one whole UTF-8 text (null: empty)."""
    text = text or b""
    n = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    return [
        np.log1p(len(words)),
        (n - int(seen[32] + seen[10])) / max(1, len(words)),
        upper / max(1, upper + lower),
        int(seen[_SYMBOL].sum()) / n,
        int(seen[33] + seen[63]) / n,
        int(seen[46]) / max(1, len(words)),
        int(seen[44] + seen[59] + seen[58]) / max(1, len(words)),
        int(seen[_DIGIT].sum()) / n,
        len(lines) / max(1, len(words)),
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        int(seen[128:].sum()) / n,
        len(zlib.compress(text, 1)) / n,
    ]


@dataclass
class Model:
    """Bin edges by feature, a table by feature, and two-way tables by pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[bins[i], bins[j]]
        return 1 / (1 + np.exp(-z))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best gain and cut of ordered bins with gradient and curvature sums."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
    if not len(left):
        return 0.0, 0
    cut = int(left.argmax())
    return float(left[cut] - cg[-1] ** 2 / (ch[-1] + ridge)), cut + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of at most ``2 ** depth`` leaves."""
    gain, cut = _split(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)))


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values by cell of a tree that cuts the rows once and then each part's columns once; its gain."""
    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        total, sides = 0.0, []
        for rows in (slice(0, cut), slice(cut, None)):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            gain, at = _split(gs, hs, ridge)
            total += gain + gs.sum() ** 2 / (hs.sum() + ridge)
            sides.append((rows, at, gs, hs))
        if total > best:
            best, values = total, np.zeros_like(g)
            for rows, at, gs, hs in sides:
                values[rows, :at] = gs[:at].sum() / (hs[:at].sum() + ridge)
                values[rows, at:] = gs[at:].sum() / (hs[at:].sum() + ridge)
    return values, best - g.sum() ** 2 / (h.sum() + ridge)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, n_pairs: int = 6, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Fit on features ``x`` and labels ``y`` (0 or 1).  Without rows the model scores 0.5."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    code = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    size = [len(e) + 1 for e in edges]
    tables = [np.zeros(n) for n in size]
    z = np.full(len(y), base)
    for _ in range(rounds if len(y) else 0):
        for j in range(len(FEATURES)):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(code[j], y - p, size[j]), np.bincount(code[j], p * (1 - p), size[j]), ridge)
            tables[j] += step
            z += step[code[j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        cell, n = code[i] * size[j] + code[j], size[i] * size[j]
        return cell, np.bincount(cell, y - p, n).reshape(size[i], size[j]), np.bincount(cell, p * (1 - p), n).reshape(size[i], size[j])

    ranked = sorted(((-_tree2(*grid(i, j)[1:], ridge)[1], i, j) for i in range(len(FEATURES)) for j in range(i)) if len(y) else [])
    pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in ranked[:n_pairs]]
    for _ in range(rounds // 5):
        for i, j, t in pairs:
            cell, g, h = grid(i, j)
            step = rate * _tree2(g, h, ridge)[0]
            t += step
            z += step.ravel()[cell]
    return Model(base, edges, tables, pairs)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: str = "") -> DataFrame:
    """(id, [extra double], x array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            rows = [features(t.as_py()) for t in batch.column(last).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:last], "x"])

    cols = [F.col(id_col).cast("long").alias("id"), *([F.col(extra).cast("double").alias("label")] if extra else [])]
    return docs.select(*cols, F.col(text_col).alias("text")).mapInArrow(run, "id long, " + "label double, " * bool(extra) + "x array<double>")


def is_held_out(id_col: str):
    """True where crc32 of the id as text is divisible by 5; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled ids that are not held out.

    Null labels and rows without an id are skipped; of several labels the least counts, of several texts of an id that
    with the least statistics.  Without labelled rows, or of an empty table, the model scores 0.5.  Extra columns are
    ignored.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_label_id")).agg(F.min(label_col).alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_label_id", F.lit("quality")), "_label_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # bounded by sample
    x = F.min("x").alias("x")
    rows = feature_table(joined, "_id", "_text", "_label").groupBy("id", "label").agg(x).collect()
    rows = sorted((r["id"], r["label"], r["x"]) for r in rows)
    x = np.array([r[2] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row.

    Null and empty texts are scored as empty, rows without an id keep a null, repeated rows repeat their result, extra
    columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1).cast(pa.binary())], dtype=float).reshape(-1, len(FEATURES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject; judged in one pass, without a join.

    Rows are judged by their text alone: repeated rows stay or go together, rows without an id are judged like others,
    columns of any names pass through, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            x = np.array([features(t.as_py()) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
