"""Deletion of repeated line runs by a suffix array over line ids.

The corpus is read as sequences of line ids. Only lines that occur twice or more can lie in a repeated run, so the suffix
array is built over stretches of such lines alone, and only over stretches long enough to matter. It grows by distributed
prefix doubling: the ranks of all suffixes by their first 2^k lines give, by one sort of the distinct pairs (rank here,
rank 2^k lines on), the ranks by their first 2^(k+1) lines.

Suffixes that share their first n lines form an interval of the suffix array whose longest common prefix is n or more; two
overlapping ranks of a level name it. A run counts if it has at least MIN_WORDS words. For each line, the shortest such
run that begins with it, and the shortest that ends with it, are looked up: of the interval of such a run, the earliest
occurrence stays and the others are later copies. Together these runs cover exactly what all longer repeated runs
cover, so their union is that of the maximal ones. A run of MIN_WORDS words has at most MIN_WORDS lines, so
log2(MIN_WORDS) levels suffice, however long the copies are.

Everything is DataFrame and SQL functions; no step holds more than a document's lines in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, require

#: Words of the shortest run whose later copies go.
MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, place, two hashes of the trimmed line, and words (an empty line counts as one)."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    parts = texts.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line")
    return parts.select("doc_id", "key", "pos", F.xxhash64(line).alias("a"), F.hash(line).alias("b"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines in stretches of at least min_words words, and how many lines a run from, or up to, each has to have."""
    # A table of its own, so that both sides of the join are dealt out for it, and a very common line can be split.
    often = materialize(lines.groupBy("a", "b").count().where("count > 1").select(F.col("a").alias("a2"), F.col("b").alias("b2")), "line-ids")
    again = lines.join(often, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left_semi")
    again = again.dropDuplicates(["doc_id", "key", "pos"])
    by_doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    again = again.withColumn("stretch", F.col("pos") - F.row_number().over(by_doc))
    stretch = Window.partitionBy("doc_id", "key", "stretch")
    again = again.withColumn("total", F.sum("words").over(stretch)).where(F.col("total") >= min_words)

    def shortest(words: Column) -> Column:
        """The first so many of these add up to min_words; NULL if all of them don't."""
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
        step = lambda acc, x: F.when(acc["sum"] >= min_words, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + 1).alias("n")))
        return F.aggregate(words, start, step, lambda acc: F.when(acc["sum"] >= min_words, acc["n"]))

    order = stretch.orderBy("pos")
    after = F.collect_list("words").over(order.rowsBetween(0, min_words - 1))
    before = F.collect_list("words").over(order.rowsBetween(-(min_words - 1), 0))
    again = again.withColumn("after", after).withColumn("before", before)
    return again.select("doc_id", "key", "stretch", "pos", "a", "b", shortest(F.col("after")).alias("from"), shortest(F.reverse("before")).alias("upto"))


def _ranked(suffixes: DataFrame, *by: str) -> DataFrame:
    """suffixes with rank: the place of these columns' values in their sorted order, with gaps; equal values, equal ranks."""
    places = suffixes.select(*by).distinct().orderBy(*by).withColumn("place", F.monotonically_increasing_id())
    places = places.select(*(F.col(c).alias(f"_{c}") for c in by), "place")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return suffixes.join(places, same).drop(*by, *(f"_{c}" for c in by)).withColumnRenamed("place", "rank")


def _runs(suffixes: DataFrame, level: int) -> DataFrame:
    """Runs of 2^level to 2^(level+1) - 1 lines: length, ranks of their first and last 2^level lines, and where they begin."""
    width = 1 << level
    order = Window.partitionBy("doc_id", "key", "stretch").orderBy("pos")
    near = suffixes.withColumn("on", F.collect_list("rank").over(order.rowsBetween(0, width - 1)))
    near = near.withColumn("back", F.collect_list("rank").over(order.rowsBetween(-(2 * width - 1), 0)))
    fits = lambda n: (n >= width) & (n < 2 * width)
    size = F.size("back")
    found = F.array(
        F.when(fits(F.col("from")), F.struct(F.col("from").alias("n"), F.col("rank").alias("x"), F.get("on", F.col("from") - width).alias("y"), F.col("pos").alias("begin"))),
        F.when(fits(F.col("upto")), F.struct(F.col("upto").alias("n"), F.get("back", size - F.col("upto")).alias("x"), F.get("back", size - width).alias("y"), (F.col("pos") - F.col("upto") + 1).alias("begin"))),
    )
    return near.select("doc_id", "key", F.explode(F.array_compact(found)).alias("run")).select("doc_id", "key", "run.*").distinct()


def _later(runs: DataFrame) -> DataFrame:
    """doc_id, key, begin, n of the runs that aren't the earliest of their interval, by doc_id (NULL last), key and place."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "begin")
    first = runs.groupBy("n", "x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = first.select(F.col("n").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "first")
    met = runs.join(first, (F.col("n") == F.col("n2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    return met.where(place != F.col("first")).select("doc_id", "key", "begin", "n")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key (xxhash64 of the text) and pos (from 0) of each line that lies in a later copy of a run."""
    require(docs, "doc_id", "text")
    own = materialize(_stretches(_lines(docs), min_words), "lines")
    longest = own.agg(F.greatest(F.max("from"), F.max("upto"))).first()[0]
    later: list[DataFrame] = []
    suffixes = own
    for level in range((longest or 0).bit_length()):
        by = ("a", "b") if level == 0 else ("rank", "next")
        suffixes = materialize(_ranked(suffixes, *by), "line-ranks")
        later.append(_later(_runs(suffixes, level)))
        order = Window.partitionBy("doc_id", "key", "stretch").orderBy("pos")
        suffixes = suffixes.withColumn("next", F.coalesce(F.lead("rank", 1 << level).over(order), F.lit(-1).cast("long")))
    if not later:
        return own.select("doc_id", "key", "pos")
    found = later[0]
    for more in later[1:]:
        found = found.union(more)
    reach = found.groupBy("doc_id", "key", "begin").agg(F.max(F.col("begin") + F.col("n") - 1).alias("reach"))
    reach = reach.select(F.col("doc_id").alias("d2"), F.col("key").alias("k2"), "begin", "reach")
    marked = own.select("doc_id", "key", "pos").join(reach, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")) & (F.col("pos") == F.col("begin")), "left")
    so_far = F.max("reach").over(Window.partitionBy("doc_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("so_far", so_far).where(F.col("so_far") >= F.col("pos")).select("doc_id", "key", "pos")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from text; all rows and columns stay, n_chars follows the text.

    The earliest copy, by doc_id and place, stays, within a document too. Lines are compared without white space at
    their ends. A document all of whose lines are later copies has an empty text. NULL and empty texts stay as they are.
    Rows of equal doc_id and equal text count as one document, and stay equal; rows of equal doc_id and other text count as
    several. A NULL doc_id comes last. An empty table gives an empty one.
    """
    gone = repeated_lines(docs, min_words)
    by_doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    run = gone.withColumn("run", F.col("pos") - F.row_number().over(by_doc)).groupBy("doc_id", "key", "run").agg(F.min("pos").alias("begin"), F.max("pos").alias("end"))
    gap = F.col("begin") - F.coalesce(F.lag("end").over(Window.partitionBy("doc_id", "key").orderBy("begin")), F.lit(-1)) - 1
    run = run.withColumn("gap", gap)
    flags = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "gap", "end"))), lambda r: F.concat(F.array_repeat(F.lit(True), r["gap"]), F.array_repeat(F.lit(False), r["end"] - r["begin"] + 1))))
    keep = run.groupBy("doc_id", "key").agg(flags.alias("__weir_keep")).select(F.col("doc_id").alias("__weir_doc"), F.col("key").alias("__weir_key"), "__weir_keep")
    met = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__weir_doc")) & (F.xxhash64("text") == F.col("__weir_key")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("__weir_keep", i), F.lit(True))), "\n")
    met = met.withColumn("text", F.when(F.col("__weir_keep").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        met = met.withColumn("n_chars", F.when(F.col("__weir_keep").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return met.select(*docs.columns)
