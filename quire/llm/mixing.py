"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, staged

#: Cells to a unit of the logarithm of the ranking key, in which the cut of a source is looked for.
CELLS = 1024


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from a table (source, source_size) with one row per source.

    Weights repeat over the sources by code point, null last. All targets come to `share` times
    all sizes; none is above `most` times its source's size, the excess going to the others by weight.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth - 1) % len(weights) + 1).cast("double")
    capped = totals.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    # the first source that the common level doesn't fill sets that level for all after it
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("rank"))).over(every)
    chosen = F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(every)
    return levels.withColumn("first", first).withColumn("target", F.least("cap", F.col("weight") * chosen)).select("source", "source_size", "target")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def size_classes(sized: DataFrame, rated: DataFrame, most: float) -> DataFrame:
    """Expected copies of a document by source and size class (binary digits of its size).

    Longer documents are likelier: expected copies are c * (1 + class) in each source, but `most`
    at most, with the c that brings the source's expected words to its target.
    """
    words = sized.groupBy("_source", "class").agg(F.sum("size").alias("words"))
    found = words.join(rated, words["_source"].eqNullSafe(rated["source"])).withColumn("weight", F.col("class") + 1)
    longest = W.partitionBy("_source").orderBy(F.desc("class"))
    before, every = longest.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_source")
    left = F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0))
    open_ = F.sum(F.col("weight") * F.col("words")).over(longest.rowsBetween(0, W.unboundedFollowing))
    # the first class, from the longest down, that its c leaves within the bound sets c for all after it
    levels = found.withColumn("c", F.when(open_ > 0, left / open_)).withColumn("rank", F.row_number().over(longest))
    first = F.min(F.when(F.col("c") * F.col("weight") <= most, F.col("rank"))).over(every)
    chosen = F.max(F.when(F.col("rank") == F.col("first"), F.col("c"))).over(every)
    expected = levels.withColumn("first", first).withColumn("expected", F.when(F.coalesce(F.col("rank") < F.col("first"), F.lit(True)), F.lit(most)).otherwise(chosen * F.col("weight")))
    expected = expected.withColumn("expected", F.when(F.col("source_size") > 0, F.col("expected")).otherwise(0.0))
    expected = expected.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.floor("expected"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)
    return expected.withColumn("rest", rest).select("_source", "class", "source_size", "target", "whole", "part", "rest")


def decide(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """For every row of docs: the row as struct `doc`, size, source_size, target and copies.

    A document's expected copies follow from its source's target and its size class (see
    `size_classes`). It is certain of the whole ones. For the rest, the documents of a source are
    ranked by random odds over inclusion odds, the inclusion probability being the fraction of the
    expected copies, which differs from class to class; they are taken in that order while the
    middle of a document lies within the words left. The cut is found in two steps: words per cell
    of the ranking key's logarithm (a cell holds 1 in 4 * CELLS of a class at most), then an exact
    running sum in the one cell of each source that holds the cut; so no source is gathered in one
    task, and each row is decided by its own id and size. Rows that repeat id and size are taken or
    left together. Null and empty texts have size 0 and copies like others; a null source is a
    source of its own; without words all copies of a source are 0. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size.alias("size"), F.col("source").alias("_source"), uniform(F.col("doc_id"), seed).alias("_u"), F.col("doc_id").alias("_id"))
    sized = sized.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    slim = staged(sized.select("_source", "_id", "_u", "size", "class"), "mix-sizes")
    totals = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    rates = staged(size_classes(slim, source_targets(totals, weights, share, most), most), "mix-rates")  # some 40 rows per source at most

    of_class = rates.select(F.col("_source").alias("_r"), F.col("class").alias("_class"), "part", "rest")
    keyed = slim.join(of_class, slim["_source"].eqNullSafe(F.col("_r")) & (slim["class"] == F.col("_class"))).where("part > 0").withColumn("key", _key(F.col("_u"), F.col("part")))
    keyed = keyed.withColumn("cell", _cell(F.col("key")))
    cells = keyed.groupBy("_source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(W.partitionBy("_source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    cut = cells.withColumn("upto", upto).where("upto > rest").groupBy("_source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), F.col("cell")).alias("at")).select("_source", "at.*")
    within = keyed.join(cut.withColumnRenamed("_source", "_s").withColumnRenamed("cell", "_cell"), keyed["_source"].eqNullSafe(F.col("_s")) & (keyed["cell"] == F.col("_cell")))
    running = F.col("before") + F.sum("size").over(W.partitionBy("_source").orderBy("key", "_id").rowsBetween(W.unboundedPreceding, 0))
    last = within.withColumn("running", running).where("running - size / 2 <= rest").groupBy("_source").agg(F.max(F.struct("key", "_id")).alias("last"))
    cuts = rates.join(cut.select(F.col("_source").alias("_c"), "cell"), rates["_source"].eqNullSafe(F.col("_c")), "left").join(last.select(F.col("_source").alias("_l"), "last"), rates["_source"].eqNullSafe(F.col("_l")), "left")
    names = (F.col("_source").alias("_t"), F.col("class").alias("_class"), "source_size", "target", "whole", "part", "cell", F.col("last.key").alias("cut_key"), F.col("last._id").alias("cut_id"))
    table = staged(cuts.select(*names), "mix-cuts")

    found = sized.join(table, sized["_source"].eqNullSafe(F.col("_t")) & (sized["class"] == F.col("_class"))).withColumn("key", _key(F.col("_u"), F.col("part")))
    own = _cell(F.col("key"))
    upto_cut = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("_id").isNull() | (F.col("_id") <= F.col("cut_id"))))
    taken = F.when(F.col("cell").isNull() | (own < F.col("cell")), 1).when((own == F.col("cell")) & upto_cut, 1).otherwise(0)
    copies = F.col("whole") + F.when(F.col("part") > 0, taken).otherwise(0)
    return found.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as `decide` takes it."""
    found = decide(docs, **settings)
    return found.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_n")).select("doc.*")


def _key(u: Column, part: Column) -> Column:
    """Rank of a document: odds of its random number over its inclusion odds; null if nothing is left to chance."""
    return F.when(part > 0, (u / (F.lit(1.0) - u)) / (part / (F.lit(1.0) - part)))


def _cell(key: Column) -> Column:
    return F.floor(F.log(key) * CELLS)
