"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; at each visit a shallow tree over the
feature's bins (for a pair: over the grid of both features' bins) is fitted to the
gradient of the log loss and added to the feature's lookup table with a small step. The
result is a set of tables, so a score is a sum of looked-up numbers, computed for whole
batches with numpy.

The features are read off whole texts alone: neither labels nor any other column of the
documents goes into them. The model is trained on the driver from at most
``sample_rows`` labelled documents, chosen by a hash of their ids; only their feature rows
are collected. Everything else covers every document.

Defined results: null and empty texts have all features zero and get the model's score for
them; without labelled rows of both classes the score is the share of label 1 (a half
without any); labels that are null, and repeated labels of an id beyond the largest, are
left out; of rows that repeat both id and text one is learned from; rows with null or repeated ids are scored like any other; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.llm.common import bounded_batches, schema_with

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digit", "symbol", "symbol_runs", "pipes", "space",
    "distinct_words", "repeats_previous", "top_word", "line_repeats", "mean_line", "line_end_stops", "compressed", "non_ascii", "exclaims", "word_entropy",
)
#: Labelled documents that a model is fitted on at most, and bins of a feature.
SAMPLE_ROWS = 20_000
BINS = 64
#: Bytes that are compressed at once; a long text's ratio is over all its blocks.
_BLOCK = 1 << 15

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-")
_HIGH = bytes(range(128, 256))
_SYMBOL_RUN = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]{2,}")


def features(text: str) -> list[float]:
    """The features of one whole text, each linear in its length."""
    data = text.encode()
    n, words = len(data), text.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = len(words)
    share = lambda members: (n - len(data.translate(None, members))) / n
    seen = Counter(words)
    freq = np.fromiter(seen.values(), float, len(seen)) / count
    lines = [x for x in text.split("\n") if x.strip()]
    packed = sum(len(zlib.compress(data[k : k + _BLOCK], 1)) for k in range(0, n, _BLOCK))
    repeats = sum(map(str.__eq__, words[1:], words))
    lengths = np.fromiter(map(len, words), float, count)
    return [
        float(np.log1p(n)),
        float(np.log1p(count)),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        len(_SYMBOL_RUN.findall(data)) / count,
        data.count(b"|") / count,
        share(b" \n\t\r"),
        len(seen) / count,
        repeats / count,
        float(freq.max()),
        1.0 - len(set(lines)) / len(lines),
        count / len(lines),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
        packed / n,
        share(_HIGH),
        data.count(b"!") / count,
        float(-(freq * np.log(freq)).sum() / np.log(count + 1)),
    ]


def feature_rows(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


# -- the model -----------------------------------------------------------------------------


@dataclass
class Additive:
    """Lookup tables over binned features and pairs of them; a score is the logistic of their sum."""

    cuts: list[np.ndarray]
    base: float
    single: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for j, cuts in enumerate(self.cuts):
            total += self.single[j][np.searchsorted(cuts, rows[:, j], side="right")]
        for (a, b), grid in self.pairs.items():
            total += grid[np.searchsorted(self.coarse[a], rows[:, a], side="right"), np.searchsorted(self.coarse[b], rows[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float = 1.0) -> np.ndarray:
    """Values of a shallow regression tree over ordered bins, from their sums of gradient and curvature."""
    gains = lambda g, h: g * g / (h + least)
    parts = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            gain = gains(g[:-1], h[:-1]) + gains(g[-1] - g[:-1], h[-1] - h[:-1]) - gains(g[-1], h[-1])
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + least)
    return out


def _grid_tree(gradient: np.ndarray, weight: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Values of a four-leaf tree over the cells of two features: a split of one, then one of the other on each side."""
    best, out = -1.0, np.zeros_like(gradient)
    for flip in (False, True):
        g, h = (gradient.T, weight.T) if flip else (gradient, weight)
        for at in range(1, len(g)):
            value, gain = np.zeros_like(g), 0.0
            for side in (slice(0, at), slice(at, len(g))):
                row = _tree(g[side].sum(axis=0), h[side].sum(axis=0), 2, least)
                value[side] = row
                gain += float((row * g[side].sum(axis=0)).sum())
            if gain > best:
                best, out = gain, value.T if flip else value
    return out


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1, leaves: int = 4, pairs: int = 6, pair_rounds: int = 25, bins: int = BINS) -> Additive:
    """Cyclic boosting of single features, then of the pairs that explain most of what these leave."""
    n, share = len(rows), float(labels.mean()) if len(labels) else 0.5
    p = min(max(share, 1e-4), 1 - 1e-4)
    columns = rows.T if n else np.zeros((len(FEATURES), 1))
    model = Additive([_cuts(c, bins) for c in columns], float(np.log(p / (1 - p))), np.zeros((len(FEATURES), bins + 1)), {}, [_cuts(c, 8) for c in columns])
    if share in (0.0, 1.0) or not n:
        return model
    binned = [np.searchsorted(c, col, side="right") for c, col in zip(model.cuts, columns, strict=True)]
    total = np.full(n, model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1.0 / (1.0 + np.exp(-total))
        return labels - q, q * (1 - q)

    for _ in range(rounds):
        for j, at in enumerate(binned):
            g, h = slope()
            step = rate * _tree(np.bincount(at, g, bins + 1), np.bincount(at, h, bins + 1), leaves)
            model.single[j] += step
            total += step[at]
    coarse = [np.searchsorted(c, col, side="right") for c, col in zip(model.coarse, columns, strict=True)]
    cells = lambda a, b: coarse[a] * 9 + coarse[b]
    g, h = slope()
    found = []
    for a in range(len(FEATURES)):
        for b in range(a + 1, len(FEATURES)):
            gs, hs = (np.bincount(cells(a, b), x, 81) for x in (g, h))
            found.append((float((gs * gs / (hs + 5.0)).sum()), a, b))
    for _, a, b in sorted(found, reverse=True)[:pairs]:
        model.pairs[a, b] = np.zeros((9, 9))
    for _ in range(pair_rounds):
        for (a, b), grid in model.pairs.items():
            g, h = slope()
            at = cells(a, b)
            step = rate * _grid_tree(np.bincount(at, g, 81).reshape(9, 9), np.bincount(at, h, 81).reshape(9, 9))
            grid += step
            total += step.ravel()[at]
    return model


# -- on tables -----------------------------------------------------------------------------


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most sample_rows labelled documents; their ids and feature rows are all that is collected or broadcast."""
    bounded_batches(docs.sparkSession)
    usable = labelled.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = feature_rows([t.as_py() or "" for t in batch.column(3)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in rows.T)], names=["id", "h", "label", *FEATURES])

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("id", F.xxhash64("text").alias("h"), "label", "text")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, h long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    # Rows that repeat an id: of those with one text, one; of the rest, those with the smallest hashes, sample_rows in all. Texts stay where they are.
    narrow = chosen.mapInArrow(run, schema).dropDuplicates(["id", "h"]).orderBy("h", "id").limit(sample_rows).drop("id", "h")
    got = np.array([tuple(r) for r in narrow.collect()], float).reshape(-1, len(FEATURES) + 1)
    got = got[np.lexsort(got.T)]  # the same model whatever the order of arrival
    return fit(got[:, 1:], got[:, 0])


def scored(docs: DataFrame, model: Additive, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs, all columns kept, with a column score in 0 to 1."""
    bounded_batches(docs.sparkSession)
    names, spark = docs.columns, docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    at = names.index(text_col)
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shipped.value.score(feature_rows([t.as_py() or "" for t in batch.column(at)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return inner.mapInArrow(run, schema_with(inner, [T.StructField("score", T.DoubleType())])).toDF(*names, score_col)


def held_out(id_: str = "doc_id"):  # noqa: ANN201
    """The rows that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
