"""Quality rules: fixed base rules, then a calibrated logistic regression.

The regression reads hashed word n-grams (orders 1 and 2) and character n-grams (orders 2 and 4)
of the whole text, each kind as shares of its own total, and is fitted in numpy on labelled
rows. A second fold of labels calibrates its output to a probability, which is compared
with a fixed threshold; a third (``held_out``) is read by neither, so that the verdicts can be
measured on it. Base counts and scores come from one pass in Arrow batches, without a shuffle.

What a fit holds in the driver is bounded as for toxicity: labelled ids, one text for each, and
n-grams of a text, of which those with the least hashes stand for all.

Null text has no words: all counts 0, base_failed true, kept false. The empty text likewise. Very long
texts are judged one at a time. Rows that repeat a document are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import CODE_POINT, NOT_SPACE, blocks, code_points, counted, fewest, lines, mix, row_sums, span_hashes, spans, windows
from .common import table
from .toxicity import held_out, sampled

BITS = 16
#: Most labelled rows that a fit reads, those whose doc_id hashes lowest; a documented bound.
TRAIN_ROWS = 4000
#: Most distinct n-grams that a fit reads of one text.
TRAIN_BUCKETS = 4096
#: Kept if the calibrated probability of quality 1 is at least this.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_CHARACTER_ORDERS = (2, 4)
KINDS = 4
#: Shares are small numbers; times this, one learning rate suits all.
SCALE = 50.0


def base_counts(data, offsets, starts, ends, rows, words) -> dict[str, np.ndarray]:
    n_rows = len(offsets) - 1
    n_words = np.bincount(rows, minlength=n_rows)
    at, window = windows(words, rows, 5)
    order = np.lexsort((window, rows[at]))
    same = (window[order][1:] == window[order][:-1]) & (rows[at][order][1:] == rows[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n_rows)
    line_starts, line_ends, line_rows = lines(data, offsets)
    inside = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    worded = inside[line_ends] > inside[line_starts]
    distinct, _, _ = counted(line_rows[worded], span_hashes(data, line_starts[worded], line_ends[worded]))
    return {
        "n_words": n_words,
        "word_chars": row_sums(NOT_SPACE[data] & CODE_POINT[data], offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_rows[worded], minlength=n_rows) - np.bincount(distinct, minlength=n_rows),
        "n_repeat_words": repeated,
    }


def features(data, offsets, rows, words):
    """For each kind of n-gram: bucket and row of each one; buckets of the kinds are apart."""
    for kind, n in enumerate((1, 2)):
        at, h = (np.arange(len(words)), words) if n == 1 else windows(words, rows, n)
        yield (mix(h) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS), rows[at]
    points, offsets = code_points(data, offsets)
    values = mix(points)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for kind, n in enumerate(_CHARACTER_ORDERS, 2):
        m = max(len(points) - n + 1, 0)
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h += values[i : i + m] * _FACTORS[i]
        h = (h ^ (h >> np.uint64(29))) * _FACTORS[3] >> np.uint64(64 - BITS)
        one = row_of[:m] == row_of[n - 1 :]
        yield h[one].astype(np.int64) + (kind << BITS), row_of[:m][one]


@dataclass
class QualityModel:
    """weights of KINDS << BITS buckets; slope and intercept turn the raw score into a log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, data, offsets, rows, words) -> np.ndarray:
        n_rows = len(offsets) - 1
        total = np.full(n_rows, self.bias)
        for bucket, row in features(data, offsets, rows, words):
            total += SCALE * np.bincount(row, self.weights[bucket], n_rows) / np.maximum(np.bincount(row, minlength=n_rows), 1)
        return total

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.intercept, -30, 30)))


def words_of(data, offsets):
    starts, ends, rows = spans(NOT_SPACE[data], offsets)
    return starts, ends, rows, span_hashes(data, starts, ends)


def bags(column: pa.Array, most: int = TRAIN_BUCKETS) -> pa.Array:
    """At most ``most`` of each text's buckets with their share of their kind, which is raised by as much as is left out."""
    sizes, buckets, shares = [], [], []
    for _, data, offsets in blocks(column):
        _, _, rows, words = words_of(data, offsets)
        found = [counted(row, bucket) for bucket, row in features(data, offsets, rows, words)]
        row, bucket, n = (np.concatenate(x) for x in zip(*found))
        kind = bucket >> BITS
        total = np.bincount(row * KINDS + kind, n, (len(offsets) - 1) * KINDS)
        order = np.argsort(row, kind="stable")
        row, bucket, share = row[order], bucket[order], (n / total[row * KINDS + kind])[order]
        at = fewest(row, bucket, most)
        all_of, size = np.bincount(row, minlength=len(offsets) - 1), np.bincount(row[at], minlength=len(offsets) - 1)
        sizes.append(size)
        buckets.append(bucket[at])
        shares.append(share[at] * (all_of / np.maximum(size, 1))[row[at]])
    ends = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int32)
    bucket, share = np.concatenate([*buckets, np.zeros(0)]).astype(np.int32), np.concatenate([*shares, np.zeros(0)]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(bucket), pa.array(share)], ["bucket", "share"]))


def train(sizes, buckets, shares, good, calibrate, *, steps: int = 120, rate: float = 0.05, decay: float = 1e-4) -> QualityModel:
    """Logistic regression by full-batch Adam on the rows not in ``calibrate``, whose labels then
    fit slope and intercept (Platt's targets, so that certain labels don't drive them to infinity)."""
    n = len(sizes)
    model = QualityModel(np.zeros(KINDS << BITS), 0.0)
    if not n or good.min() == good.max():
        p = (good.sum() + 1) / (n + 1)
        model.bias = float(np.log(p / (1 - p))) if p < 1 else 30.0
        return model
    of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    x = shares * np.float32(SCALE)
    fold = (~calibrate).astype(float) if (~calibrate).any() else np.ones(n)
    fold /= fold.sum()
    # both classes weigh the same, as a good text is far more common
    balance = np.where(good > 0, 0.5 / max((fold * good).sum(), 1e-9), 0.5 / max((fold * (1 - good)).sum(), 1e-9)) * fold
    m, v = np.zeros(KINDS << BITS), np.zeros(KINDS << BITS)
    mb = vb = 0.0
    for step in range(1, steps + 1):
        raw = np.bincount(of, x * model.weights[buckets], n) + model.bias
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - good) * balance
        gradient = np.bincount(buckets, x * error[of], KINDS << BITS) + decay * model.weights
        pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        model.weights = model.weights - pace * m / (np.sqrt(v) + 1e-5)
        model.bias -= pace * mb / (vb**0.5 + 1e-5)
    raw = np.bincount(of, x * model.weights[buckets], n) + model.bias
    at = calibrate if calibrate.any() and good[calibrate].min() < good[calibrate].max() else np.ones(n, bool)
    n_good, n_bad = good[at].sum(), (1 - good[at]).sum()
    target = np.where(good[at] > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    line = np.stack([raw[at], np.ones(at.sum())], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(line @ w, -30, 30)))
        curve = line.T @ (line * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, line.T @ (p - target)), -1, 1)
    model.slope, model.intercept = (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
    return model


def fit(documents: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS, buckets: int = TRAIN_BUCKETS) -> QualityModel:
    """Learn from at most ``most`` labelled rows and ``buckets`` n-grams of each; by crc32 of the doc_id a quarter of
    all labelled rows calibrates, and another isn't read."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = sampled(documents, sample)

    def bag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], batch["calibrate"], bags(batch["text"], buckets)], ["doc_id", "quality", "calibrate", "bag"])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3
    found = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), fold.alias("calibrate"), "text").mapInArrow(bag, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, quality int, calibrate boolean, bag array<struct<bucket: int, share: float>>").toArrow().combine_chunks().sort_by("doc_id")
    if not found.num_rows:
        return train(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    lists = found["bag"].combine_chunks()
    flat = lists.flatten()
    return train(np.diff(lists.offsets.to_numpy()), flat.field("bucket").to_numpy(), flat.field("share").to_numpy(), (found["quality"].to_numpy() > 0).astype(float), found["calibrate"].to_numpy())


#: The columns that ``judge`` adds.
JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_probability double, kept boolean"


def judge(documents: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and, for each row, the base counts, the calibrated probability and the verdict."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def judged(batches):
        for batch in batches:
            parts = []
            for _, data, offsets in blocks(batch["text"]):
                starts, ends, rows, words = words_of(data, offsets)
                found = base_counts(data, offsets, starts, ends, rows, words)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
                probability = shared.value.probability(shared.value.raw(data, offsets, rows, words))
                parts.append({**found, "base_failed": failed, "quality_probability": probability, "kept": ~failed & (probability >= threshold)})
            if parts:
                columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns.values())], ["doc_id", *columns])

    return documents.select("doc_id", "text").mapInArrow(judged, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {JUDGED}")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))
