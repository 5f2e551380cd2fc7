"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; a
normalised text is its words with one space between. The automaton holds each window of
``n`` consecutive words of an item (a shorter item is one window) with a space at both
ends, and reads each normalised text once; word numbers map hits to the original bytes.

The benchmark is a stated set of items against all documents: its windows are cut and counted
first, and what exceeds ``block_windows`` is dealt to several automata. Driver and workers hold one
automaton at a time: each block is a pass over the documents, whose result is written and read by
the next, so the broadcast is bounded by ``block_windows``. Documents aren't shuffled.

Null and empty texts have no words. An item without words has no window. An item's id that
is null counts as the text ``null``; rows with the same id and several texts are one item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER
from .common import discard, extended, table, written

WORDS = 10
#: Windows in one automaton, about 200 bytes each.
BLOCK_WINDOWS = 200_000

_FOLD = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised(text: bytes) -> tuple[list[bytes], str]:
    """The words, and their bytes joined by spaces, one character a byte."""
    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return words, (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def item_windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """Each distinct window (``pattern``), with the ids of its items, sorted as strings."""

    def cut(batches):
        for batch in batches:
            ids, patterns = [], []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                words, _ = normalised(text or b"")
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    ids.append("null" if item is None else item)
                    patterns.append(b" ".join(words[i : i + n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.binary())], ["item_id", "pattern"])

    cut_up = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, pattern binary")
    return cut_up.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def automata(items: DataFrame, n: int = WORDS, block_windows: int = BLOCK_WINDOWS) -> Iterator[ahocorasick.Automaton]:
    """The automata of the items' windows, block by block."""
    found = written(item_windows(items, n), "leak-windows")
    blocks = -(-found.count() // block_windows)
    for k in range(blocks):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        automaton = ahocorasick.Automaton()
        for pattern, ids in part.toLocalIterator():
            words = pattern.count(b" ") + 1
            automaton.add_word(f" {bytes(pattern).decode('latin-1')} ", (words, tuple(ids)))
        if len(automaton):
            automaton.make_automaton()
            yield automaton
    discard(items.sparkSession, found)


def hits(automaton: ahocorasick.Automaton, text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """How many words the text has, the numbers of those in an occurrence, and the items that occur."""
    words, joined = normalised(text)
    found = list(automaton.iter(joined)) if words else []
    if not found:
        return len(words), np.zeros(0, np.int64), set()
    ends = np.cumsum([len(w) + 1 for w in words])  # of the space after each word
    cover = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    last = np.searchsorted(ends, [at for at, _ in found])
    size = np.array([n for _, (n, _) in found])
    np.add.at(cover, last - size + 1, 1)
    np.add.at(cover, last + 1, -1)
    for _, (_, ids) in found:
        items.update(ids)
    return len(words), np.flatnonzero(np.cumsum(cover[:-1])), items


def character_spans(text: bytes, words: np.ndarray) -> list[dict]:
    """Start and end, in code points of the original text, of each run of the numbered words."""
    if not len(words):
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(words) > 1)
    return [{"start": int(points[at[a][0]]), "end": int(points[at[b][1]])} for a, b in zip(words[np.append(0, breaks + 1)], words[np.append(breaks, len(words) - 1)])]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find(documents: DataFrame, items: DataFrame, *, n: int = WORDS, block_windows: int = BLOCK_WINDOWS, prefix: str = "") -> DataFrame:
    """``documents`` with n_words, hit_words (their numbers), item_ids (sorted) and hit_spans
    (start and end in code points of the original text); columns of these names, which begin
    with ``prefix``, are replaced."""
    spark = documents.sparkSession
    added = [prefix + x for x in ("n_words", "hit_words", "item_ids", "hit_spans")]
    kept = documents.drop(*added)
    kinds = ("long", "array<int>", "array<string>", "array<struct<start: int, end: int>>")
    schema = extended(kept.schema, ", ".join(f"`{name}` {kind}" for name, kind in zip(added, kinds)))
    rest = automata(items, n, block_windows)
    automaton, done, before = next(rest, None), kept, None
    while True:
        shared = spark.sparkContext.broadcast(automaton)
        done = done.mapInArrow(_scan(shared, kept.columns, added), schema)
        automaton = next(rest, None)
        if automaton is None:
            return done
        # one pass of several: its automaton goes before the next is sent
        done = written(done, "leak-pass", outlives=True)
        shared.unpersist()
        if before is not None:
            discard(spark, before)
        before = done


def _scan(shared, names: list[str], added: list[str]):
    """Batches with what the automaton finds, added to what an earlier pass found."""

    def scan(batches):
        for batch in batches:
            rows, text_at = [], names.index("text")
            earlier = [batch.column(len(names) + k).to_pylist() for k in (1, 2)] if batch.num_columns > len(names) else None
            for i, text in enumerate(batch.column(text_at).cast(pa.binary())):
                text = text.as_py() or b""
                if shared.value is None:
                    rows.append((len(normalised(text)[0]), [], [], []))
                    continue
                n_words, words, items = hits(shared.value, text)
                if earlier is not None:
                    words, items = np.union1d(words, np.array(earlier[0][i], np.int64)), items.union(earlier[1][i])
                rows.append((n_words, words.tolist(), sorted(items), character_spans(text, words)))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), _SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *added])

    return scan


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage_decontaminate(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each document that holds a window of a test item."""
    found = find(documents, table(spark, sf_dir, "benchmark"), prefix="__found_")
    return found.where(F.size("__found_hit_words") == 0).select(*documents.columns)


#: Joins every 10-word window of the documents with the items' windows, then marks words.
OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM pattern),
gram AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT g.doc_id, g.i, g.n, t.item_id FROM gram g JOIN pattern t ON g.n = t.n AND g.p = t.p),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
