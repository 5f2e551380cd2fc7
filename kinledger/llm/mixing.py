"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is how often its words are taken. Whole copies up to that
number are certain for each of its documents. For the rest a document's inclusion
probability is proportional to its size: ``theta * size``, and one certain copy more where that
passes 1, with theta such that the expected words are those that the source has left. With a
random u from the document's hash, documents rank by the odds of u over the odds of their
inclusion probability and are taken in that order until the words are used up: a sample of
unequal probabilities whose size in words is fixed, not merely expected.

Theta follows from the number of documents of each size, and the order is found without
sorting a source in one task: a document's rank value falls into one of many equal bins, the
words of each bin are summed, and only the bin in which the source's words run out is ordered
row by row. That bin lies where the odds are equal, away from the ends at which ranks crowd;
there are as many bins as the root of the largest source's count of documents.

u comes from the hash of doc_id and text, so rows without a doc_id have their own unless the
text is the same too. Rows that repeat both have one rank; where the words run out among
them, as many of them are taken as fit, whichever these are. Null text has size 0; null source is
a source, last in order. A size of 0 has no words to take and is never drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, table, written

WEIGHTS = (5, 2, 1)
#: Of all words, and of a source's words at most.
TOTAL, MOST = 1.5, 2.0
SEED = "mix-1"
LEAST_BINS = 256


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, docs and target of each source; ``sizes`` has source, size.

    Filling by weight until nothing is above its bound has a closed form: in order of
    bound over weight, the sources up to some place get their bounds and the others share
    what is left by weight. One row a source, so the ordering is over a small table.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w.cast("long"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    by = by.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    by = by.withColumn("fits", F.lit(most) * F.col("source_size") > F.col("level") * F.col("weight"))
    # the level of the first source that stays below its bound holds for it and all after it
    by = by.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"])
    bound = F.lit(most) * F.col("source_size")
    return by.select("source", "source_size", "docs", F.least(bound, F.coalesce(F.col("level") * F.col("weight"), bound)).alias("target"))


def uniform(doc_id: F.Column, text: F.Column, seed: str = SEED) -> F.Column:
    """A number between 0 and 1 from the hash of seed, doc_id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rank_of(u: F.Column, inclusion: F.Column) -> F.Column:
    """u's odds over the inclusion's odds, brought to 0..1 by x / (1 + x)."""
    x = u * (1 - inclusion)
    return x / (x + (1 - u) * inclusion)


def plans(sized: DataFrame, by: DataFrame) -> DataFrame:
    """Each source's source_size, target, __copies (certain for all), __cut (larger documents have one more),
    __theta (inclusion probability per word of the others) and __left (words that these get)."""
    classes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    n, size = F.col("n").cast("decimal(12,0)"), F.col("size").cast("decimal(9,0)")
    # as many rows as sizes that occur, whatever the number of documents
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum(n * size).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    # sums of all, less the running sum: a frame to the end would be summed anew at each row
    up_to = F.coalesce(F.sum(n * (size * size)).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = (F.sum(n * (size * size)).over(Window.partitionBy("source")) - up_to).cast("double")
    some = F.col("source_size") > 0
    by = by.withColumn("copies", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    by = by.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).select(F.col("source").alias("of"), "source_size", "target", "copies", "rest")
    solved = classes.withColumn("larger", larger).withColumn("squares", squares)
    solved = solved.join(by.select("of", "rest"), solved.source.eqNullSafe(F.col("of"))).withColumn("theta", (F.col("rest") - F.col("larger")) / F.col("squares"))
    # the largest size whose inclusion isn't above 1, given that all larger ones are certain
    solved = solved.where(F.col("theta") * F.col("size") <= 1).groupBy(F.col("source").alias("__of")).agg(F.max_by(F.struct("theta", "larger", "size"), "size").alias("s"))
    joined = by.join(solved, F.col("of").eqNullSafe(F.col("__of")), "left")
    return joined.select(F.col("of").alias("__source"), "source_size", "target", F.col("copies").alias("__copies"), F.col("s.size").alias("__cut"), F.col("s.theta").alias("__theta"), (F.col("rest") - F.col("s.larger")).alias("__left"))


def mix(documents: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``documents`` with size, source_size, target, copies (how often the mix holds the row) and
    taken (copies times size); columns of these names are replaced.

    Sizes are counted and written once to find each source's plan, and the rank of the last
    document that it draws. Both are a row a source, so ``documents`` meets them where it
    lies and isn't shuffled.
    """
    spark = documents.sparkSession
    with scratch(spark):
        sized = written(documents.select("source", n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("__u")), "mix-sizes")
        by = written(targets(sized, weights=weights, total=total, most=most), "mix-targets")
        bins = max(LEAST_BINS, math.isqrt(by.agg(F.max("docs")).first()[0] or 0))
        plan = written(plans(sized, by), "mix-plans", outlives=True)
        ranked = _ranked(sized, plan, bins).where("__rank is not null")

        words = ranked.groupBy("__source", "__bin").agg(F.sum("size").alias("words"), F.min("__left").alias("left"))
        words = words.withColumn("upto", F.sum("words").over(Window.partitionBy("__source").orderBy("__bin"))).withColumn("before", F.col("upto") - F.col("words"))
        # the first bin at whose end the words exceed what is left
        edges = words.where(F.col("upto") > F.col("left")).groupBy(F.col("__source").alias("__of")).agg(F.min("__bin").alias("__edge"), F.min_by("before", "__bin").alias("before"))
        edges = written(edges, "mix-edges")
        inside = ranked.join(edges, F.col("__source").eqNullSafe(F.col("__of"))).where(F.col("__bin") == F.col("__edge"))
        ranks = inside.groupBy("__of", "__edge", "__rank").agg(F.sum("size").alias("block"), F.count("*").alias("n"), F.min("before").alias("before"), F.min("__left").alias("left"))
        upto = F.col("before") + F.sum("block").over(Window.partitionBy("__of").orderBy("__rank"))
        ranks = ranks.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        # of the rank at which the words run out, as many rows as come nearest
        fit = F.floor((F.col("left") - (F.col("upto") - F.col("block"))) / (F.col("block") / F.col("n")) + F.lit(0.5))
        last = ranks.withColumn("fit", F.greatest(F.lit(0), F.least(fit, F.col("n"))).cast("long"))
        ends = written(last.groupBy("__of", "__edge").agg(F.min("__rank").alias("__last"), F.min_by("fit", "__rank").alias("__fit"), F.min_by("n", "__rank").alias("__n")), "mix-ends", outlives=True)
    carried = documents.drop("size", "source_size", "target", "copies", "taken")
    rows = _ranked(carried.select("*", n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("__u")), plan, bins)
    rows = rows.join(ends, F.col("__source").eqNullSafe(F.col("__of")), "left")
    at_end = F.col("__rank") == F.col("__last")
    drawn = F.col("__of").isNull() | (F.col("__rank") < F.col("__last")) | at_end & (F.col("__fit") > 0)
    more = F.when(F.col("size") > F.col("__cut"), 1).when(F.col("__rank").isNotNull() & drawn, 1).otherwise(0)
    copies = F.coalesce("__copies", F.lit(0)) + more
    out = [*carried.columns, "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")]
    if ends.where("__fit between 1 and __n - 1").isEmpty():
        return rows.select(*out)
    split = F.coalesce(at_end & F.col("__fit").between(F.lit(1), F.col("__n") - 1), F.lit(False))
    return rows.where(~split).select(*out).unionByName(_first_of(rows.where(split)).select(*out))


def _first_of(tied: DataFrame) -> DataFrame:
    """Rows of one rank a source, numbered task by task: those after the first __fit lose __fit."""
    tied = written(tied.withColumn("__at", F.monotonically_increasing_id()), "mix-tied").withColumn("__task", F.shiftright("__at", 33))
    tasks = tied.groupBy(F.col("__source").alias("__s"), F.col("__task").alias("__t")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__s").orderBy("__t")) - F.col("__rows")
    tasks = tasks.withColumn("__before", before)
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__source", "__task").orderBy("__at"))
    met = tied.join(tasks, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    return met.withColumn("__fit", F.when(place <= F.col("__fit"), F.col("__fit")).otherwise(0))


def _ranked(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """``rows`` (source, size, __u, ...) with their source's plan, __rank and __bin, null where nothing is drawn."""
    ranked = rows.join(plan, rows.source.eqNullSafe(plan["__source"]))
    p = F.least(F.lit(1.0), F.col("__theta") * F.col("size"))
    ranked = ranked.withColumn("__rank", F.when((p > 0) & (F.col("size") <= F.col("__cut")), rank_of(F.col("__u"), p)))
    return ranked.withColumn("__bin", F.least(F.floor(F.col("__rank") * bins), F.lit(bins - 1)).cast("long"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and ``copies``: how often it takes them."""
    return mix(documents).where("copies > 0")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM src),
levelled AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(2 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
level AS (SELECT arg_min(level, (source_size / weight, level)) AS level FROM levelled WHERE CAST(2 AS DOUBLE) * source_size > level * weight),
plan AS (
  SELECT w.source, source_size, least(CAST(2 AS DOUBLE) * source_size, coalesce(l.level * weight, CAST(2 AS DOUBLE) * source_size)) AS target
  FROM weighed w, level l),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM plan),
rests AS (SELECT *, target - copies * source_size AS rest FROM parts),
class AS (SELECT source, size, CAST(count(*) AS HUGEINT) AS n FROM sized WHERE size > 0 GROUP BY source, size),
summed AS (
  SELECT source, size, CAST(coalesce(sum(n * size) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS larger,
    CAST(sum(n * size * size) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares
  FROM class WINDOW d AS (PARTITION BY source ORDER BY size DESC)),
solved AS (
  SELECT r.source, s.size AS cut, (rest - larger) / squares AS theta, larger FROM summed s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
  WHERE (rest - larger) / squares * s.size <= 1
  QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY s.size DESC) = 1),
hashed AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
included AS (
  SELECT h.doc_id, h.source, h.size, h.u, r.source_size, r.target, r.copies, v.cut, r.rest - v.larger AS rest, least(CAST(1 AS DOUBLE), v.theta * h.size) AS p
  FROM hashed h JOIN rests r ON h.source IS NOT DISTINCT FROM r.source LEFT JOIN solved v ON h.source IS NOT DISTINCT FROM v.source),
ranked AS (SELECT *, CASE WHEN p > 0 AND size <= cut THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank FROM included),
queued AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank) AS upto, sum(size) OVER (PARTITION BY source, rank) AS block,
    row_number() OVER (PARTITION BY source, rank ORDER BY doc_id) AS place FROM ranked),
taken AS (
  SELECT *, CASE WHEN size > cut THEN 1 WHEN rank IS NULL THEN 0
    WHEN upto <= rest OR upto - block <= rest AND place <= floor((rest - (upto - block)) / size + CAST(0.5 AS DOUBLE)) THEN 1 ELSE 0 END AS more FROM queued)
SELECT doc_id, size, source_size, target, CAST((copies + more) * size AS BIGINT) AS taken FROM taken
"""
