"""Toxicity: subword-bag embeddings, averaged, into a linear softmax.

A text's feature bag holds the character n-grams of its words (A-Z in lower case, a space
before and after each word), each with a learned embedding. The text's vector is their
mean, and a two-class softmax reads it; embeddings and softmax are trained together in
numpy. An unseen misspelling shares most n-grams with what it was made from.

The mean and the softmax are both linear, so scoring needs one number per n-gram: the
embedding's product with the difference of the two class vectors. ``ToxicityModel`` keeps
that vector, 512 KB, and texts are scored where they lie, without a shuffle.

What a fit holds in the driver is bounded: ``most`` labelled doc_ids, one text for each (of several the
least), and of a text at most ``buckets`` of its n-grams, those whose hash is least. Scores
read whole texts.

Null and empty texts have an empty bag: their score is the softmax of the bias alone. Very long texts
are scored one at a time. Rows that repeat a document are scored alike; other columns are
carried along, and one with the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, blocks, code_points, counted, fewest, mix, row_sums
from .common import extended, table

#: n-grams fall into 2 ** BITS buckets.
BITS = 17
ORDERS = (3, 4, 5)
DIMENSIONS = 8
#: Most labelled rows that a fit reads, those whose doc_id hashes lowest; a documented bound.
TRAIN_ROWS = 4000
THRESHOLD = 0.3
#: Most distinct n-grams that a fit reads of one text.
TRAIN_BUCKETS = 4096
#: A bucket and its count travel as one number of 32 bits; a text's greater counts are told as this.
MOST_COUNTED = (1 << 32 - BITS) - 1
#: Texts of a mini-batch.
BATCH = 256

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FOLD = np.where(ALNUM, LOWER, 32).astype(np.uint8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, the buckets by position, a mark of the positions that count, and the
    rows' offsets. An n-gram stands inside one word or takes the space beside it."""
    rows = len(offsets) - 1
    points, offsets = code_points(data, offsets)
    ascii_ = points < 128
    points[ascii_] = _FOLD[points[ascii_].astype(np.uint8)]
    padded = np.full(len(points) + 2 * rows, 32, np.uint64)
    shift = np.repeat(np.arange(rows) * 2 + 1, np.diff(offsets))
    padded[np.arange(len(points)) + shift] = points
    at = offsets + 2 * np.arange(rows + 1)
    values = mix(padded)
    gaps = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(padded == 32, out=gaps[1:])
    for n in ORDERS:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        h = values[:m] * _FACTORS[0]
        for i in range(1, n):
            h += values[i : i + m] * _FACTORS[i]
        bucket = np.zeros(len(padded), np.int64)
        bucket[:m] = ((h ^ (h >> np.uint64(29))) * (_FACTORS[1] + np.uint64(2 * n))) >> np.uint64(64 - BITS)
        counts = np.zeros(len(padded), bool)
        # no space between the ends, and both ends not spaces: rows are parted by two spaces
        counts[:m] = gaps[n - 1 : n - 1 + m] == gaps[1 : m + 1]
        counts[:m] &= (padded[:m] != 32) | (padded[n - 1 :] != 32)
        yield bucket, counts, at


@dataclass
class ToxicityModel:
    """``weights``: of each bucket, its embedding times the difference of the class vectors."""

    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, data, offsets in blocks(column):
            total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
            for bucket, counts, at in ngrams(data, offsets):
                total += row_sums(np.where(counts, self.weights[bucket], 0.0), at)
                n += row_sums(counts, at)
            out[first : first + len(total)] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))
        return out


def bags(column: pa.Array, most: int = TRAIN_BUCKETS) -> pa.Array:
    """The n-gram counts of each text, as a list of at most ``most`` numbers: the bucket in the low BITS, the count above."""
    sizes, found_in = [], []
    for _, data, offsets in blocks(column):
        found = [(np.searchsorted(at, np.flatnonzero(ok), "right") - 1, bucket[ok]) for bucket, ok, at in ngrams(data, offsets)]
        rows, values, n = counted(*(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
        at = fewest(rows, values, most)
        rows, values, n = rows[at], values[at], n[at]
        sizes.append(np.bincount(rows, minlength=len(offsets) - 1))
        found_in.append((values | np.minimum(n, MOST_COUNTED) << BITS).astype(np.uint32).view(np.int32))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found_in, np.zeros(0, np.int32)])))


def unbagged(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the numbers in a bag."""
    flat = flat.view(np.uint32)
    return (flat & np.uint32((1 << BITS) - 1)).view(np.int32), flat >> np.uint32(BITS)


def train(sizes: np.ndarray, buckets: np.ndarray, counts: np.ndarray, toxic: np.ndarray, *, steps: int = 600, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax together by Adam over shuffled mini-batches.

    sizes: buckets of each text, which buckets and counts hold one text after another.
    A text's logit difference is the mean of its embeddings times (class 1 - class 0), so
    the gradient of an embedding is that difference times one number, and neither pass
    needs more than one number per stored bucket.
    """
    n_texts = len(sizes)
    if not n_texts or toxic.min() == toxic.max():
        p = (toxic.sum() + 0.5) / (n_texts + 1)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.bincount(buckets, minlength=1 << BITS) > 0  # others keep no weight
    share = counts.astype(np.float32)
    for a, z in zip(ends[:-1], ends[1:]):
        share[a:z] /= max(share[a:z].sum(), 1)
    embeddings = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    classes, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2)
    bias[1] = np.log(toxic.mean() / (1 - toxic.mean()))
    state = [np.zeros_like(x, np.float32) for x in (embeddings, embeddings, classes, classes, bias, bias)]
    order, at = rng.permutation(n_texts), 0
    for step in range(1, steps + 1):
        if at >= n_texts:
            order, at = rng.permutation(n_texts), 0
        texts = order[at : at + BATCH]
        at += BATCH
        where = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in texts])
        of = np.repeat(np.arange(len(texts)), sizes[texts])
        x, g = share[where], buckets[where]
        difference = classes[:, 1] - classes[:, 0]
        logit = np.bincount(of, x * (embeddings @ difference)[g], len(texts)) + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[texts]) / len(texts)
        by_bucket = np.bincount(g, x * error[of], 1 << BITS).astype(np.float32)
        toward = embeddings.T @ by_bucket
        gradients = (by_bucket[:, None] * difference, np.stack([-toward, toward], 1), np.array([-error.sum(), error.sum()]))
        pace = rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, (value, gradient) in enumerate(zip((embeddings, classes, bias), gradients)):
            m, v = state[2 * k], state[2 * k + 1]
            m *= 0.9
            m += 0.1 * gradient
            v *= 0.999
            v += 0.001 * gradient**2
            value -= (pace * m / (np.sqrt(v) + 1e-5)).astype(value.dtype)
    difference = classes[:, 1] - classes[:, 0]
    return ToxicityModel(np.where(seen, embeddings @ difference, 0).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels no fit sees. A null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_of(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, label), those whose doc_id hashes lowest; a doc_id
    with several labels counts once, with the largest."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id, ...) with text: of a doc_id's texts the least. The sample is few ids by its bound, so it
    is broadcast, and no other documents are shuffled."""
    others = [F.first(c).alias(c) for c in sample.columns if c != "doc_id"]
    return documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(*others, F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, *, most: int = TRAIN_ROWS, buckets: int = TRAIN_BUCKETS) -> ToxicityModel:
    """Learn from at most ``most`` labelled rows outside the held-out quarter, and ``buckets`` n-grams of each."""
    texts = sampled(documents, sample_of(labels.where(~held_out(F.col("doc_id"))), "toxic", most))

    def bag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], bags(batch["text"], buckets)], ["doc_id", "toxic", "bag"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(bag, f"doc_id {kind}, toxic int, bag array<int>").toArrow()
    # the same order of texts at each run; the bags are copied once, as numbers
    order = pa.compute.sort_indices(found["doc_id"]).to_numpy()
    toxic = (found["toxic"].to_numpy()[order] > 0).astype(float)
    bags_of = found["bag"].chunks
    del found
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(b.offsets.to_numpy()) for b in bags_of)])
    flat = np.concatenate([np.zeros(0, np.int32), *(b.flatten().to_numpy() for b in bags_of)])
    del bags_of
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([np.zeros(0, np.int32), *(flat[ends[i] : ends[i + 1]] for i in order)])
    return train(sizes[order], *unbagged(flat), toxic)


def score(documents: DataFrame, model: ToxicityModel, *, column: str = "toxicity") -> DataFrame:
    """``documents`` and a column of scores from 0 to 1, whole texts, in Arrow batches."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 512 KB
    kept = documents.drop(column)
    names = kept.columns

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(names.index("text"))))], [*names, column])

    return kept.mapInArrow(scored, extended(kept.schema, f"`{column}` double"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, column="score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_toxicity(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what scores at least the threshold; the columns stay as they are."""
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, column="__toxicity").where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
