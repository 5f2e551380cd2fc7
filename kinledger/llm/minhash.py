"""MinHash near-dedup by ProbMinHash: weighted shingles, banding, exact verification.

Each distinct run of five words is an element whose weight grows with its count. It sends
arrivals of a Poisson process, at a rate of its weight, to random places of the signature;
a place keeps the element that arrives first. Two texts agree in a place with a probability
that equals their probability Jaccard similarity. Arrivals stop early, at a time by which
every place has one: the few texts with an open place go on to a later time. For a long
text nearly all elements are done after one arrival.

A link is told by shingle sets, which weights can hold far apart: a text and its copy with a
block repeated 50 times have nearly the same set. So a text that repeats a shingle has a
second signature, of equal weights; that of any other text is of equal weights already.

Signatures are cut into bands; texts that share a band's hash are candidates. Candidates
are compared by their whole shingle sets: a link is a Jaccard similarity of 0.8 or more.
Equal texts are one node from the start. Links are joined to components, and candidates of
different components are compared until none is left that might be linked (``links`` says
how): no bucket is cut off, and a group of copies costs about one comparison a member.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A text of
one to four words is a single shingle. Null texts and texts without words are nobody's
copies: each is its own class, as is a row whose doc_id is null. Rows that repeat a doc_id
and text have one class; a doc_id with several texts counts once for each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, blocks, counted, mix, shingles, span_hashes, spans
from .common import scratch, table, written
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: At a Jaccard similarity of the sets of 0.8, 24 bands of 5 of the signatures of equal weights
#: miss a pair with probability 7e-5.
BANDS, ROWS = 24, 5
#: Members of a bucket whose pairs are few enough to meet all, levels of finer buckets, and
#: steps in which a large bucket's members agree on a centre; pivots to begin with.
SMALL, LEVELS, STEPS, PIVOTS = 8, 2, 2, 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD1B54A32D192ED03)


def weighted_shingles(data, offsets, n: int = WORDS):
    """Row, hash and count of each distinct shingle, in order of row and hash."""
    starts, ends, rows = spans(ALNUM[data], offsets)
    return counted(*shingles(span_hashes(LOWER[data], starts, ends), rows, n))


def signatures(rows, elements, weights, n_rows: int, places: int) -> np.ndarray:
    """The element that arrives first at each place of each row's signature; 0 for a row without
    elements. rows is sorted. An element's arrivals depend on its hash and weight alone."""
    total = np.bincount(rows, weights, n_rows)
    until = places * (np.log(places) + 2) / np.maximum(total, 1e-300)
    first = np.full(n_rows * places, np.inf)
    out = np.zeros(n_rows * places, np.uint64)
    todo = np.arange(len(rows))
    while len(todo):
        state, time, at = elements[todo], np.zeros(len(todo)), todo
        found = []
        while len(at):
            state = mix(state + _STEP)
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[at]
            early = time <= until[rows[at]]
            state, time, at = state[early], time[early], at[early]
            place = (mix(state ^ _PLACE) % np.uint64(places)).astype(np.int64)
            found.append((rows[at] * places + place, time, elements[at]))
        slot, time, element = (np.concatenate(x) for x in zip(*found))
        np.minimum.at(first, slot, time)
        wins = time == first[slot]
        out[slot[wins]] = element[wins]
        open_rows = (np.isinf(first).reshape(n_rows, places)).any(1) & (total > 0)
        until[open_rows] *= 2
        todo = np.flatnonzero(open_rows[rows])
    return out.reshape(n_rows, places)


def _banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hash of each band of each signature."""
    signature = signature.reshape(len(signature), bands, rows)
    band = np.zeros(signature.shape[:2], np.uint64)
    for i in range(rows):
        band = band * _STEP + mix(signature[:, :, i])
    return mix(band + np.arange(bands, dtype=np.uint64) * _PLACE)


def sketch(documents: DataFrame, *, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (MD5 of the text) and the distinct hashes of the bands, of both signatures; rows
    without words or doc_id are left out."""
    keyed = documents.where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")

    def sketched(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch["text"]):
                n_rows = len(offsets) - 1
                row, shingle, count = weighted_shingles(data, offsets, n)
                worded = np.flatnonzero(np.bincount(row, minlength=n_rows))
                band = _banded(signatures(row, shingle, 1 + np.log(count), n_rows, bands * rows), bands, rows)[worded]
                repeating = np.unique(row[count > 1])
                some = np.isin(row, repeating)
                even = _banded(signatures(np.searchsorted(repeating, row[some]), shingle[some], np.ones(some.sum()), len(repeating), bands * rows), bands, rows)
                of, band, _ = counted(np.repeat(np.concatenate([worded, repeating]), bands), np.concatenate([band, even]).ravel())
                ends = np.searchsorted(of, worded, "right").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.array(band.view(np.int64)))
                taken = pa.array(first + worded)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(taken), batch["node"].take(taken), lists], ["doc_id", "node", "bands"])

    return keyed.mapInArrow(sketched, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>")


def similarity(pairs: DataFrame, texts: DataFrame, n: int = WORDS) -> DataFrame:
    """Of each pair (a, b, central) of nodes: similarity (Jaccard, of the whole shingle sets), overlap
    (shingles of both), words (shingles of b) and, if a is central, b's shingles that a hasn't."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", "central", "a_text", "b_text")

    def compared(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                both = pa.concat_arrays([part["a_text"], part["b_text"]]).take(pa.array(np.arange(2 * len(part)).reshape(2, -1).T.ravel()))
                sets: list[np.ndarray] = []
                out, more, central = [], [], part["central"].to_pylist()
                for _, data, offsets in blocks(both):  # a pair's texts stand together
                    row, shingle, _ = weighted_shingles(data, offsets, n)
                    ends = np.searchsorted(row, np.arange(len(offsets)))
                    for i in range(len(offsets) - 1):
                        sets.append(shingle[ends[i] : ends[i + 1]])
                        if len(sets) == 2:
                            x, y = sets
                            shared = len(np.intersect1d(x, y, assume_unique=True))
                            out.append((shared / max(len(x) + len(y) - shared, 1), shared, len(y)))
                            more.append(np.setdiff1d(y, x, assume_unique=True).view(np.int64) if central[len(more)] else np.zeros(0, np.int64))
                            sets = []
                figures = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, more)]), pa.int32()), pa.array(np.concatenate([*more, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], part["central"], *figures, lists], ["a", "b", "central", "similarity", "overlap", "words", "added"])

    return met.mapInArrow(compared, "a binary, b binary, central boolean, similarity double, overlap long, words long, added array<long>")


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """Of written rows (bucket, node, root), those of buckets with more than one component, and the bucket's size.
    Rows and bounds are written: the join's sides are then plain exchanges, which adaptive execution splits."""
    bounds = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    return written(rows.join(written(bounds, name), "bucket"), name)


class Search:
    """The links found so far, their components, and the pairs that were compared."""

    def __init__(self, texts: DataFrame, threshold: float, n: int) -> None:
        self.texts, self.threshold, self.n = texts, threshold, n
        self.found = self.roots = self.seen = self.fresh = None

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Compare pairs (a, b, central) and keep what links; components follow in ``join``."""
        told = written(similarity(pairs, self.texts, self.n), "near-compared")
        links = told.where(F.col("similarity") >= self.threshold).select("a", "b")
        self.found = links if self.found is None else self.found.unionByName(links)
        self.fresh = links if self.fresh is None else self.fresh.unionByName(links)
        pair = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        self.seen = pair if self.seen is None else self.seen.unionByName(pair)
        return told

    def join(self) -> None:
        """Components of all links so far: those of the last time, joined by the links since between two of them."""
        fresh, self.fresh = self.fresh, None
        if fresh is None or self.roots is None:
            self.roots = self.roots if fresh is None else connected_components(fresh, distinct=False)
            return
        for end in ("a", "b"):
            root = self.roots.select(F.col("node").alias(end), F.col("root").alias("root"))
            fresh = fresh.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        between = written(fresh.where("a <> b"), "near-between")
        if not between.isEmpty():
            above = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = self.roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            # a node without a link so far isn't among the roots
            others = above.select(F.col("root").alias("node"), F.col("above").alias("root")).join(self.roots, "node", "left_anti")
            self.roots = written(known.unionByName(others), "near-roots")

    def new(self, pairs: DataFrame) -> DataFrame:
        """Pairs that weren't compared yet, each once, the lesser node first."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("central")).distinct()
        return written(pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti").select("a", "b", "central"), "near-pairs")

    def rooted(self, rows: DataFrame, *more: str) -> DataFrame:
        """Rows (bucket, node, more columns) with the node's component."""
        return rows.join(self.roots, "node", "left").select("bucket", "node", *more, F.coalesce("root", "node").alias("root"))


def links(buckets: DataFrame, texts: DataFrame, *, threshold: float = SIMILARITY, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The links among the members of buckets (bucket, node, size: its members), and their components.

    Complete between components: two members of a bucket that no link joins, directly or
    through others, were compared, or were shown to be too far apart, in three ways.

    1. A small bucket: its least member meets all others, then all pairs of different
       components meet; they are few by the bound on a small bucket.
    2. A large bucket: each node has a centre, that member of its large buckets which has most
       company, and meets it. Let p be the centre of s and c, with what more than a quarter of
       its nodes share besides. What s and c share is at most
       what p shares with either, and what they share outside p. So a linked pair either
       shares a shingle that p hasn't, and then both are in the finer bucket of p and that
       shingle, which is searched the same way; or p's share alone is large enough for the
       two sizes, and then the pair is left for 3. Edited copies of one text that aren't
       linked to it share little but the text itself: they part here, one comparison each.
    3. The rest, and buckets with several centres: pivots, twice as many each round, meet all
       members of other components.
    """
    search = Search(texts, threshold, n)
    left, hard, pairs = buckets, [], None
    for level in range(LEVELS):
        small = left.where(F.col("size") <= SMALL).select("bucket", "node")
        large = left.where(F.col("size") > SMALL)
        crowded = not large.isEmpty()
        # the pairs of the level before and this one's centres don't hang on each other: they are compared at once
        now = [_centres(large)] if crowded else []
        if level == 0:
            least = small.groupBy("bucket").agg(F.min("node").alias("a"))
            pairs = small.withColumnRenamed("node", "b").join(least, "bucket").where("a < b").select("a", "b")
        told = search.compare(reduce(DataFrame.unionByName, [*now, search.new(pairs)]))
        search.join()
        rooted = search.rooted(small)
        pairs = rooted.select("bucket", F.col("node").alias("a"), F.col("root").alias("a_root")).join(rooted.withColumnRenamed("node", "b"), "bucket").where("a < b and a_root <> root").select("a", "b")
        if not crowded:
            break
        left, crossed, close = _parted(large, told.where("central"), search)
        if crossed is not None:
            hard.append(crossed)
        pairs = pairs.unionByName(close)
        if left.isEmpty():
            break
    else:
        hard.append(left.select("bucket", "node"))
    _by_pivots(reduce(DataFrame.unionByName, hard) if hard else None, pairs, search)
    return search.found, search.roots


def _centres(large: DataFrame) -> DataFrame:
    """Each node with its centre, as pairs (a: centre, b: node); a node that is its own has none.

    The centre is the node with most company that is found in a few steps from node to
    bucket to node, so that all members of a bucket, as a rule, have the same one.
    """
    company = large.groupBy("node").agg(F.sum("size").alias("company"))
    best = company.select("node", F.struct("company", "node").alias("best"))
    for _ in range(STEPS):
        # a node is in as many large buckets as it has bands, of both signatures, or added shingles, at most
        of_bucket = written(large.join(best, "node").groupBy("bucket").agg(F.max("best").alias("best")), "near-best")
        best = large.join(of_bucket, "bucket").groupBy("node").agg(F.max("best").alias("best"))
    return written(best.select(F.col("best.node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("central")).where("a <> b"), "near-centres")


def _parted(large: DataFrame, told: DataFrame, search: Search) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """After the nodes of large buckets met their centres: the finer buckets with several
    components, the rows of buckets with several centres, and the pairs that may be linked
    by what they share with their centre alone."""
    each = told.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.explode("added").alias("shingle"))
    members = told.groupBy(F.col("a").alias("centre")).agg(F.count("*").alias("members"))
    often = each.groupBy("centre", "shingle").agg(F.count("*").alias("n")).join(members, "centre").where("n * 4 > members")
    often = written(often.select("centre", "shingle", F.lit(True).alias("common")), "near-common")
    each = each.join(often, ["centre", "shingle"], "left").withColumn("bucket", F.xxhash64("centre", "shingle"))
    each = written(search.rooted(each, "common"), "near-added")
    more = each.where("common").groupBy("node").agg(F.count("*").alias("more"))
    about = told.select(F.col("b").alias("node"), F.col("a").alias("centre"), "overlap", "words", (F.col("similarity") >= search.threshold).alias("linked")).join(more, "node", "left")
    about = about.select("node", "centre", (F.col("overlap") + F.coalesce("more", F.lit(0))).alias("overlap"), "words", "linked")
    finer = _mixed(each.where("common is null").drop("common"), "near-finer").select("bucket", "node", "size")

    # a centre has all its own shingles; what it shares with itself bounds nothing
    near = search.rooted(large.select("bucket", "node")).join(about, "node", "left")
    near = written(near.withColumn("centre", F.coalesce("centre", "node")), "near-large")
    # s and c need an overlap of t (|s| + |c|): what s shares with p allows sizes of c up to overlap / t - |s|.
    # In such a pair at least one allows its own size: the smaller one, close to a part of p.
    t = search.threshold / (1 + search.threshold)
    near = near.withColumn("allows", F.col("overlap") / F.lit(t) - F.col("words") + 1e-6)
    near = near.withColumn("part", F.col("allows") >= F.col("words"))
    # those linked to the centre are of one component: one of a pair isn't
    bounds = near.groupBy("bucket").agg(
        (F.min("centre") < F.max("centre")).alias("several"),
        F.max(F.when(~F.col("linked"), F.col("allows"))).alias("most"),
        F.min(F.when(F.col("part") & ~F.col("linked"), F.col("words"))).alias("least"),
        F.min(F.when(F.col("part"), F.col("words"))).alias("least_of_all"),
    )
    bounds = written(bounds, "near-bounds")
    crossed, several = None, bounds.where("several").select("bucket")
    if not several.isEmpty():
        crossed = _mixed(written(near.join(several, "bucket", "left_semi").select("bucket", "node", "root"), "near-crossed"), "near-crossed").select("bucket", "node")
    alone = near.where("overlap is not null").join(bounds.where("not several"), "bucket")
    if_linked = F.col("part") & (F.col("words") <= F.col("most")) | (F.col("allows") >= F.col("least"))
    kept = alone.where(F.when(F.col("linked"), if_linked).otherwise(F.col("part") | (F.col("allows") >= F.col("least_of_all"))))
    kept = written(kept.select("bucket", "node", "root", "words", "allows", "part"), "near-kept")
    # a pair that shares several buckets is made in the least; only what is in very many isn't asked
    listed = kept.groupBy("node").agg(F.count("*").alias("n"), F.collect_set("bucket").alias("buckets"))
    kept = kept.join(listed.select("node", F.when(F.col("n") <= 2 * BANDS, F.col("buckets")).alias("buckets")), "node")
    kept = written(kept, "near-kept")
    part = kept.where("part").select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "words", "allows", "buckets")))
    once = F.coalesce(F.array_min(F.array_intersect("buckets", "buckets_b")) == F.col("bucket"), F.lit(True))
    pairs = kept.join(part, "bucket").where("root <> root_b and words_b <= allows and words <= allows_b and (words_b < words or words_b = words and node_b < node)").where(once)
    return finer, crossed, pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _by_pivots(hard: DataFrame | None, pairs: DataFrame, search: Search) -> None:
    """Compare the pairs (a, b) and, of the hard rows (bucket, node), members of different components: some pivots
    of a bucket with all others, then twice as many."""
    each, left = PIVOTS, hard
    while left is not None:
        left = _mixed(written(search.rooted(left), "near-left"), "near-left")
        if left.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
        pivots = left.withColumn("i", place).where(F.col("i") <= each).select("bucket", F.col("node").alias("a"), F.col("root").alias("a_root"))
        pivots = written(pivots, "near-pivots")
        met = left.withColumnRenamed("node", "b").join(pivots, "bucket").where("a < b and a_root <> root").select("a", "b")
        search.compare(search.new(met if pairs is None else met.unionByName(pairs)))
        search.join()
        # pivots have met all others
        larger, pairs = left.where(F.col("size") > each + 1), None
        if larger.isEmpty():
            break
        left = larger.select("bucket", "node").join(pivots.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        each *= 2
    if pairs is not None:
        search.compare(search.new(pairs))
        search.join()


def classes(documents: DataFrame, *, threshold: float = SIMILARITY, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, node, class_id (least doc_id of its group), n_joins (links
    of its text that were found while the groups were joined), is_first (of the least doc_id's rows,
    of the least text).

    n_joins is no count of similar texts: pairs within a group that other links join already aren't
    compared, and which those are depends on the order of the texts' hashes. A text is alone if it is 0."""
    spark = documents.sparkSession
    with scratch(spark):
        sketched = written(sketch(documents, n=n, bands=bands, rows=rows), "near-sketch")
        nodes = written(sketched.groupBy("node").agg(F.min("doc_id").alias("node_id"), F.first("bands").alias("bands")), "near-nodes")
        exploded = nodes.select("node", F.explode("bands").alias("bucket"))
        shared = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        buckets = written(exploded.join(shared, "bucket").select("bucket", "node", "size"), "near-buckets")
        candidates = buckets.select("node").distinct().join(nodes.select("node", "node_id"), "node")
        keyed = documents.where("doc_id is not null and text is not null").select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
        # one row's text stands for a node: its least doc_id's; rows that repeat it go
        texts = keyed.join(candidates, (keyed.key == candidates.node) & (keyed.doc_id == candidates.node_id)).select("node", "text")
        texts = written(texts, "near-texts")
        found, roots = links(buckets, texts, threshold=threshold, n=n)
        counts = found.select(F.col("a").alias("node"), F.col("b").alias("other")).union(found.select("b", "a")).groupBy("node").agg(F.countDistinct("other").alias("n_joins"))
        rooted = nodes.select("node", "node_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min(F.struct("node_id", "node")).alias("least"))
        named = rooted.join(least, "root").join(counts, "node", "left").select("node", F.col("least.node_id").alias("class_id"), F.coalesce("n_joins", F.lit(0)).alias("n_joins"), (F.col("node") == F.col("least.node")).alias("first_text"))
        named = written(named, "near-classes", outlives=True)
    ids = documents.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"))
    return ids.join(named, "node", "left").select(
        "doc_id", "node",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_joins", F.lit(0)).cast("long").alias("n_joins"),
        (F.col("class_id").isNull() | (F.col("first_text") & (F.col("doc_id") == F.col("class_id")))).alias("is_first"),
    )


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_joins", F.col("is_first").alias("kept"))


def stage_near_duplicates(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first, by doc_id."""
    found = classes(documents.select("doc_id", "text"))
    gone = found.where(~F.col("is_first")).select(F.col("doc_id").alias("__gone"), F.col("node").alias("__text")).distinct()
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    return documents.join(gone, (F.col("doc_id") == F.col("__gone")) & (node == F.col("__text")), "left_anti").select(*documents.columns)
