"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the bytes of each text.  The trees are grown on the driver from a
bounded sample of labelled rows: features are binned by quantiles, every node's gradient and hessian sums are
bincounts per bin, and a level of splits is chosen at once.  A model is a few flat arrays (feature, threshold,
children, value); scoring walks all rows of a batch down all trees with numpy indexing.

Null and empty texts have statistics of zero and get a score like any other row; texts of any length are measured whole.  Labels other
than 0 and 1 and labels of unknown documents are ignored; of an id with several labels the larger counts, of one with several
texts the one with the smallest statistics.  A sample without both classes gives its share as constant score.
Ties between splits go to the first feature and threshold.  Repeated rows and null ids are scored each; a null id is not held out.
Extra columns are not passed, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vec

#: Labelled rows that fit the model at most, those with the smallest id hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 1.0, 5
FOLDS, THRESHOLD = 5, 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "log_lines", "words_per_line", "upper", "digit", "symbol", "punctuation", "pipe", "exclamation",
    "stop", "comma", "non_ascii", "white", "distinct_words", "repeated_next", "repeated_windows", "repeated_lines", "short_words", "long_words", "first_upper", "colon",
)

_B = np.arange(256)
_CLASS = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "symbol": np.isin(_B, list(b"#$%&*+<=>@^_`{}~\\[]/")),
    "punctuation": np.isin(_B, list(b".,;:!?'\"()-")),
    "pipe": _B == ord("|"),
    "exclamation": _B == ord("!"),
    "stop": np.isin(_B, list(b".?")),
    "comma": _B == ord(","),
    "white": vec.WHITE,
    "colon": _B == ord(":"),
}


def statistics(arr: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    data, off = vec.utf8(arr)
    n = len(off) - 1
    size = np.maximum(off[1:] - off[:-1], 1).astype(float)
    lead = (data & 0xC0) != 0x80
    starts, ends, row = vec.runs(~vec.WHITE[data], off)
    prefix = vec.prefix_hash(data)
    h = vec.span_hash(prefix, starts, ends)
    per_row = lambda rows, w=None: np.bincount(rows, weights=w, minlength=n).astype(float)
    words = per_row(row)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = per_row(row, length) / some
    sd = np.sqrt(np.maximum(per_row(row, length**2) / some - mean**2, 0))

    def distinct(hashes, rows):
        key = np.unique(vec.mix(hashes + rows.astype(np.uint64) * vec.BASE), return_index=True)[1]
        return per_row(rows[key])

    lines, stops, owner = vec.runs(data != 10, off)
    n_lines = per_row(owner)
    at, win = vec.windows(h, row, 3)
    n_win = np.maximum(per_row(row[at]), 1)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    share = {k: vec.counts(c[data], off) / size for k, c in _CLASS.items()}
    share["non_ascii"] = vec.counts(data >= 0x80, off) / size
    columns = share | {
        "log_chars": np.log1p(vec.counts(lead, off)),
        "log_words": np.log1p(words),
        "word_length": mean,
        "word_length_sd": sd,
        "log_lines": np.log1p(n_lines),
        "words_per_line": words / np.maximum(n_lines, 1),
        "distinct_words": distinct(h, row) / some,
        "repeated_next": per_row(row[1:][same]) / some,
        "repeated_windows": 1 - distinct(win, row[at]) / n_win,
        "repeated_lines": 1 - distinct(vec.span_hash(prefix, lines, stops), owner) / np.maximum(n_lines, 1),
        "short_words": per_row(row[length <= 2]) / some,
        "long_words": per_row(row[length >= 12]) / some,
        "first_upper": per_row(row[_CLASS["upper"][data[starts]]]) / some if len(starts) else np.zeros(n),
    }
    return np.stack([columns[k] for k in FEATURES], axis=1) if n else np.zeros((0, len(FEATURES)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2, least: int = LEAST) -> dict[str, np.ndarray]:
    """Boosted trees of logistic loss as flat arrays; node i's children are left[i] and left[i] + 1, a leaf's left is itself."""
    n, m = x.shape
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = np.log(prior / (1 - prior))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, w = y - p, np.maximum(p * (1 - p), 1e-9)
            root = len(feature)
            roots.append(root)
            feature.append(0), threshold.append(np.inf), left.append(root), value.append(0.0)
            at = np.full(n, root)
            level = [root]
            for d in range(depth + 1):
                nxt = []
                for node in level:
                    rows = np.flatnonzero(at == node)
                    gs, ws = g[rows].sum(), w[rows].sum()
                    value[node] = rate * gs / (ws + l2)
                    if d == depth or len(rows) < 2 * least:
                        continue
                    best = (1e-6, 0, 0)
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                        wl = np.cumsum(np.bincount(b, w[rows], len(cuts[j]) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
                        gain = gl**2 / (wl + l2) + (gs - gl) ** 2 / (ws - wl + l2) - gs**2 / (ws + l2)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                    if best[0] <= 1e-6:
                        continue
                    _, j, k = best
                    child = len(feature)
                    for _ in range(2):
                        feature.append(0), threshold.append(np.inf), left.append(len(left)), value.append(0.0)
                    feature[node], threshold[node], left[node] = j, cuts[j][k], child
                    at[rows] = child + (binned[rows, j] > k)
                    nxt += [child, child + 1]
                level = nxt
            score += np.array(value)[at]
    names = {"feature": (feature, np.int32), "threshold": (threshold, float), "left": (left, np.int32), "value": (value, float), "roots": (roots, np.int32)}
    return {k: np.array(v, t) for k, (v, t) in names.items()} | {"base": np.array([base]), "depth": np.array([depth])}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: every row goes down all trees at once, a level a step."""
    if not len(model["roots"]) or not len(x):
        return np.full(len(x), 1 / (1 + np.exp(-model["base"][0])))
    at = np.tile(model["roots"], (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(int(model["depth"][0])):
        child = model["left"][at]
        at = np.where(child == at, at, child + (x[rows, model["feature"][at]] > model["threshold"][at]))
    return 1 / (1 + np.exp(-(model["base"][0] + model["value"][at].sum(axis=1))))


def _statistics(batches):
    for part in vec.slices(batches, "text"):
        x = statistics(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "x"])


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Fit on the labelled rows outside the held-out fold, at most ``rows`` of them."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id"))
    y = y.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y.select("id")), "id", "left_semi")
    measured = some.mapInArrow(_statistics, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    table = measured.join(F.broadcast(y), "id").select("y", "x").toPandas()  # at most ``rows``
    if not len(table):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(table["x"].to_numpy())
    order = np.lexsort((*x.T, table["y"].to_numpy()))  # the same trees however the rows came
    return fit(x[order], table["y"].to_numpy()[order].astype(float))


def _score(model: dict[str, np.ndarray]):
    def run(batches):
        for part in vec.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(predict(model, statistics(part.column(2))))], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
