"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of a document's lines (the last two that have words) chooses
where chunks end, all lines alike: a chunk has ``spread`` lines on average, and an inserted line
shifts no boundary beyond its neighbours. A chunk of several lines that stands earlier in the
corpus too, byte for byte, is removed, if it has ``chunk_words`` words: two short lines that meet
by chance, such as a licence line and a byline, aren't a passage.

Boundaries fall where hashes say, so the chunk at either edge of a passage takes in lines of its
host, and a passage of one or two long lines may hold no whole chunk. For passages of
``least_words`` words and more that isn't left to luck: beside the chunks, each line opens and closes
a window, the shortest run of lines with so many words. Any line of such a passage stands in a
window inside the passage, whatever stands around it. Windows that stand earlier go like chunks.
What is neither in such a chunk nor in a repeated passage of ``least_words`` words stays.

The first occurrence, by doc_id and place, stays. A later one in the same document counts only
if it doesn't overlap the first.

Chunks and windows meet by hash in partial sums (least and greatest occurrence), never in one
group. Of a document's repeated ones as few as cover the same lines send their bytes to meet
the first occurrence's. Texts are shuffled once, as zstd frames, to meet what is wanted of them.

Null text stays null and has no chunk; the empty text is one empty line, which is never
removed. Very long texts are read whole, a text a time. Rows that repeat a doc_id and text are one
document and are treated alike. A null doc_id comes first in the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .bytetext import NOT_SPACE, blocks, lines, mix, packed, span_hashes, unpacked
from .common import extended, scratch, table, written

#: One in this many lines ends a chunk: so many lines a chunk has on average.
SPREAD = 3
#: Words of a repeated chunk that goes.
CHUNK_WORDS = 20
#: Words of a passage that goes though it holds no whole chunk of several lines.
LEAST_WORDS = 50

_OLDER = np.uint64(0x9E3779B97F4A7C15)


def _worded_lines(data, offsets):
    """Start, end, row and number of words of each line that has words."""
    start, end, row = lines(data, offsets)
    inside = NOT_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    opens[at] = inside[at]
    total = np.concatenate([[0], np.cumsum(opens)])
    words = total[end] - total[start]
    some = words > 0
    return start[some], end[some], row[some], words[some]


def chunk_lines(data, start, end, row, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each chunk; together they are all lines."""
    h = span_hashes(data, start, end)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
    opens = np.ones(len(row), bool)
    opens[1:] = row[1:] != row[:-1]
    before[opens] = 0
    closes = mix(h + before * _OLDER) % np.uint64(spread) == 0
    closes[:-1] |= opens[1:]
    closes[-1:] = True
    last = np.flatnonzero(closes)
    return np.concatenate([np.zeros(1, np.int64), last[:-1] + 1])[: len(last)], last


def window_lines(row, words, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the windows that open and close at each line, where the row has the words."""
    total, n, least = np.concatenate([[0], np.cumsum(words)]), len(words), max(least_words, 1)
    line = np.arange(n)
    on = np.stack([line, np.searchsorted(total, total[:-1] + least) - 1])
    back = np.stack([np.searchsorted(total, total[1:] - least, "right") - 1, line])
    low, high = np.concatenate([on, back], 1)
    fits = (low >= 0) & (high < n)
    low, high = low[fits], high[fits]
    return tuple(x[row[low] == row[high]] for x in (low, high))


def pieces(data, offsets, spread: int = SPREAD, chunk_words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS):
    """row, first and last line (of the row's lines that have words), start and end (bytes of the row) and hash
    of each chunk of several lines and each window."""
    start, end, row, words = _worded_lines(data, offsets)
    n = max(len(row), 1)
    low, high = chunk_lines(data, start, end, row, spread)
    total = np.concatenate([[0], np.cumsum(words)])
    several = (high > low) & (total[high + 1] - total[low] >= chunk_words)
    more_low, more_high = window_lines(row, words, least_words)
    low, high = np.divmod(np.unique(np.concatenate([low[several] * n + high[several], more_low * n + more_high])), n)
    of, a, b = row[low], start[low], end[high]
    first = np.searchsorted(row, of)
    return of, low - first, high - first, a - offsets[of], b - offsets[of], span_hashes(data, a, b)


def _key(documents: DataFrame) -> DataFrame:
    """``documents`` with ``key``, the MD5 of the text."""
    return documents.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def chunks(documents: DataFrame, *, spread: int = SPREAD, chunk_words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, key, low, high (lines), start, stop (bytes) and hash of each chunk of several lines and each window."""

    def cut(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch["text"]):
                row, *places, h = pieces(data, offsets, spread, chunk_words, least_words)
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(at), batch["key"].take(at), *(pa.array(x.astype(np.int32)) for x in places), pa.array(h.view(np.int64))],
                    ["doc_id", "key", "low", "high", "start", "stop", "hash"],
                )

    keyed = _key(documents.where("text is not null").select("doc_id", "text")).select("doc_id", "key", "text")
    return keyed.mapInArrow(cut, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key binary, low int, high int, start int, stop int, hash long")


def covering(low: list[int], high: list[int]) -> list[int]:
    """Indexes of some of the runs from low to high, sorted by low, that together stand on the same lines."""
    taken: list[int] = []
    done, best = -1, -1  # best: the farthest of those that leave no line after done open
    for i, (x, y) in enumerate(zip(low, high)):
        if best >= 0 and x > done + 1:
            taken.append(best)
            done, best = high[best], -1
        if y > done and (best < 0 or y > high[best]):
            done = max(done, x - 1) if best < 0 else done
            best = i
    return [*taken, best] if best >= 0 else taken


def _covered(repeats: DataFrame) -> DataFrame:
    """Of each document's repeated pieces (doc_id, key, low, high, start, stop, hash) some that cover the same lines."""
    names = ["doc_id", "key", "start", "stop", "hash"]
    listed = repeats.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("low", "high", "start", "stop", "hash"))).alias("pieces"))

    def chosen(batches):
        for batch in batches:
            sizes = np.diff(batch["pieces"].offsets.to_numpy())
            flat = batch["pieces"].flatten()
            low, high = (flat.field(x).to_pylist() for x in ("low", "high"))
            at, of, begin = [], [], 0
            for doc, n in enumerate(sizes.tolist()):
                mine = covering(low[begin : begin + n], high[begin : begin + n])
                at += [begin + i for i in mine]
                of += [doc] * len(mine)
                begin += n
            at, of = pa.array(at, pa.int64()), pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["key"].take(of), *(flat.field(x).take(at) for x in names[2:])], names)

    return listed.mapInArrow(chosen, repeats.select(*names).schema)


def _wanted(documents: DataFrame, spread: int, chunk_words: int, least_words: int) -> DataFrame:
    """w_doc_id, w_key and pieces (structs start, stop, hash, is_first) of the documents that hold a repeated piece
    to remove or the first occurrence of one."""
    cut = written(chunks(documents, spread=spread, chunk_words=chunk_words, least_words=least_words), "chunks")
    place = F.struct("doc_id", "key", "low", "high", "start", "stop")
    ends = cut.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    # written, so that the joins below have plain exchanges, which adaptive execution splits
    ends = written(ends, "chunk-firsts")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    again = cut.join(ends, "hash").where(~same | (F.col("low") > F.col("first.high"))).select(*cut.columns)
    repeats = written(_covered(again), "chunk-repeats")
    firsts = ends.join(repeats.select("hash").distinct(), "hash", "left_semi").select("first.doc_id", "first.key", "first.start", "first.stop", "hash")
    both = repeats.withColumn("is_first", F.lit(False)).unionByName(firsts.withColumn("is_first", F.lit(True)))
    # pieces of a document are three times its lines at most
    listed = both.groupBy(F.col("doc_id").alias("w_doc_id"), F.col("key").alias("w_key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop", "hash", "is_first"))).alias("pieces"))
    return listed


def _bytes_of(met: DataFrame) -> DataFrame:
    """hash, is_first, doc, key, start and bytes of the pieces of ``met`` (__doc, __key, __pieces, text as frames)."""

    def cut(batches):
        for batch in batches:
            listed = batch["__pieces"]
            sizes, flat = np.diff(listed.offsets.to_numpy()), listed.flatten()
            start, stop = (flat.field(x).to_pylist() for x in ("start", "stop"))
            out, begin = [], 0
            for text, n in zip(unpacked(batch["text"]).cast(pa.binary()), sizes.tolist()):
                text = text.as_py()
                out += [text[a:b] for a, b in zip(start[begin : begin + n], stop[begin : begin + n])]
                begin += n
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [flat.field("hash"), flat.field("is_first"), batch["__doc"].take(of), batch["__key"].take(of), flat.field("start"), pa.array(out, pa.binary())],
                ["hash", "is_first", "doc", "key", "start", "bytes"],
            )

    some = met.where("__pieces is not null").select("__doc", "__key", "__pieces", "text")
    return some.mapInArrow(cut, f"hash long, is_first boolean, doc {met.schema['__doc'].dataType.simpleString()}, key binary, start int, bytes binary")


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the spans of whole lines, sorted by start; and how many lines and words went."""
    parts, at, n_lines, n_words = [], 0, 0, 0
    for a, b in spans:
        if b < at:
            continue
        if a > at:
            parts.append(text[at : a - 1])
        gone = text[max(a, at) : b]
        n_lines += gone.count(b"\n") + 1
        n_words += len(gone.split())
        at = b + 1
    if at <= len(text):
        parts.append(text[at:])
    return b"\n".join(parts), n_lines, n_words


def dedup_lines(documents: DataFrame, *, spread: int = SPREAD, chunk_words: int = CHUNK_WORDS, least_words: int = LEAST_WORDS, prefix: str = "") -> DataFrame:
    """``documents``, text without repeated chunks and passages, and the columns n_lines_removed and
    n_words_removed (names begin with ``prefix``; columns of these names are replaced)."""
    spark = documents.sparkSession
    added = [f"{prefix}n_lines_removed", f"{prefix}n_words_removed"]
    kept = documents.drop(*added)
    names = [f"__{c}" for c in kept.columns]  # apart from the names used on the way
    text = names[kept.columns.index("text")]
    with scratch(spark):
        wanted = _wanted(documents, spread, chunk_words, least_words)
        named = kept.select(*(F.col(c).alias(n) for c, n in zip(kept.columns, names))).withColumn("text", F.col(text)).drop(text)
        named = _key(named)
        order = named.columns

        def pack(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([packed(c) if name == "text" else c for name, c in zip(order, batch.columns)], order)

        frames = named.mapInArrow(pack, StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in named.schema]))
        doc = names[kept.columns.index("doc_id")]
        met = frames.join(wanted, frames[doc].eqNullSafe(F.col("w_doc_id")) & (F.col("key") == F.col("w_key")), "left").drop("w_doc_id", "w_key")
        met = written(met.withColumnRenamed("pieces", "__of_pieces").withColumnRenamed("key", "__of_key"), "chunk-texts", outlives=True)
        bytes_of = _bytes_of(met.select(F.col(doc).alias("__doc"), F.col("__of_key").alias("__key"), F.col("__of_pieces").alias("__pieces"), "text"))
        bytes_of = written(bytes_of, "chunk-bytes")
        # written too: a passage that very many documents hold is one key, which only plain exchanges let Spark split
        first = written(bytes_of.where("is_first").select("hash", F.col("bytes").alias("first_bytes")).dropDuplicates(["hash"]), "chunk-first-bytes")
        unequal = bytes_of.where("not is_first").join(first, "hash").where("bytes <> first_bytes")
        # equal hashes of unequal bytes: as good as none, so this join moves no texts
        unequal = written(unequal.groupBy(F.col("doc").alias("u_doc"), F.col("key").alias("u_key")).agg(F.collect_set("start").alias("__unequal")), "chunk-unequal", outlives=True)
    ready = met.join(unequal, met[doc].eqNullSafe(F.col("u_doc")) & (F.col("__of_key") == F.col("u_key")), "left")
    ready = ready.select(*(F.col("text") if n == text else F.col(n) for n in names), "__of_pieces", "__unequal")
    place, result = kept.columns.index("text"), [*kept.columns, *added]

    def removed(batches):
        for batch in batches:
            texts, n_lines, n_words = unpacked(batch.column(place)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            listed, unequal, new = batch.column(len(names)), batch.column(len(names) + 1), {}
            for i in np.flatnonzero(np.asarray(listed.is_valid())).tolist():
                wrong = set(unequal[i].as_py() or ())
                spans = [(p["start"], p["stop"]) for p in listed[i].as_py() if not p["is_first"] and p["start"] not in wrong]
                if spans:
                    left, n_lines[i], n_words[i] = without(texts[i].as_py().encode(), spans)
                    new[i] = left.decode()
            columns = list(batch.columns[: len(names)])
            columns[place] = texts
            if new:
                mask = np.zeros(len(batch), bool)
                mask[list(new)] = True
                columns[place] = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), texts.type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_words)], result)

    return ready.mapInArrow(removed, extended(kept.schema, f"`{added[0]}` long, `{added[1]}` long"))


def op7_line_chunks(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_line_chunks(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated passages, n_chars follows; a document of which nothing is left goes."""
    done = dedup_lines(documents, prefix="__chunks_")
    lost = F.col("__chunks_n_words_removed") > 0
    done = done.where(~lost | (F.length(F.trim(F.col("text"))) > 0))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(lost, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*documents.columns)
