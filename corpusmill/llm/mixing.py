"""Mixing sources to target weights along a time-varying curriculum.

A source's share of training at time t in [0, 1] is its target times 1 + a (2t - 1), a
schedule that rises for a > 0 and falls for a < 0. Its integral, target * ((1 - a) t + a t^2),
is the source's cumulative token demand, and its inverse gives the time at which the source's
u-th share is asked for. Documents stand in a fixed shuffled order on their source's token
axis, once for every pass over the source; a document's training position is the inverse at
its start. A range sort by position interleaves the sources as their schedules ask.

Only sums go through windows over a source: documents are ranged along the shuffle order into
parts of bounded size, whatever their keys, so neither a source that holds a third of all
rows nor an id that many rows share lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.native import n_words
from corpusmill.sources.store import written

WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule slopes that go with the weights: heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
TOTAL = 1.5
MOST_PASSES = 2
#: Rows of the shuffle order that one part holds.
PART_ROWS = 50_000


def by_rank(rank: Column, values: tuple[float, ...]) -> Column:
    """values repeated along ranks 1, 2, 3, ..."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[float, ...], slopes: tuple[float, ...], total: float, most: int) -> DataFrame:
    """A row for each source: source, rank, source_size, target, slope.

    Targets share total * all sizes by weight; a target above most * its source's size stops
    there and the excess goes to the others by weight. In order of cap per weight the first
    k sources are at their caps, and the level of the rest is what is left over their weights;
    the right k is the first for which no further source is above its cap.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns({"weight": by_rank(F.col("rank"), weights), "slope": by_rank(F.col("rank"), slopes), "cap": (most * F.col("source_size")).cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("all_size", F.sum("source_size").over(Window.partitionBy())).withColumn(
        "level", (F.lit(total) * F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("a"), "rank"))
    level = levels.agg(F.min_by("level", fits).alias("level"))
    return ranked.crossJoin(F.broadcast(level)).select("source", "rank", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"), "slope")


def when_asked(u: Column, a: Column) -> Column:
    """The time by which the share u of a source's demand has been asked for."""
    return 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))


def mixture(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, total: float = TOTAL, most: int = MOST_PASSES, part_rows: int = PART_ROWS) -> DataFrame:
    """Assign training positions: sized(doc_id, source, size, _tie, _row, ...) with its own columns and more.

    Adds source_size, target, taken (words that the mix takes of the document, passes
    added up) and positions (array<double>, one for each pass that
    takes any of it). The last document of a pass may be taken in part, so a source's taken
    words are its target rounded down. Null sizes count as 0, and such documents are never
    taken. A null source is a source of its own, after the others. The shuffle order is by MD5
    of doc_id (null as empty), then doc_id, size and _tie, a hash of what else tells rows
    apart, so reruns agree; rows equal in all of these are as good as each other and stand in
    the order of _row, a number of their own. An empty table gives no rows.
    """
    # Written, so that the join below reads two plain exchanges and can split a hot source.
    targets, _ = written(source_targets(sized, weights, slopes, total, most).withColumnRenamed("source", "_source"), "targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("_order").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("_tie").asc(), F.col("_row").asc()]
    parts = max(1, -(-sized.count() // part_rows))
    placed, _ = written(rows.repartitionByRange(parts, F.col("rank").asc(), *order).withColumn("_part", F.spark_partition_id()), "mixture")
    sums = placed.groupBy("rank", "_part").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("rank", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("rank", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["rank", "_part"])
    rows = rows.withColumn("_start", F.col("_start") + F.col("_base"))
    whole = F.floor("target").cast("bigint")
    starts = [F.col("_start") + p * F.col("source_size") for p in range(most)]
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), whole - s)) for s in starts]
    positions = F.filter(F.array(*(F.when(t > 0, when_asked(s / F.col("target"), F.col("slope"))) for s, t in zip(starts, taken, strict=True))), lambda p: p.isNotNull())
    return rows.withColumns({"taken": sum(taken[1:], taken[0]), "positions": positions}).drop("_order", "_part", "_base", "_start", "slope", "rank")


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns of documents with size, _tie and _row, written once: numbers given as a table is written are fixed."""
    tie = F.xxhash64("source", "text").alias("_tie")
    return written(docs.select(*columns, n_words(F.col("text")).alias("size"), tie, F.monotonically_increasing_id().alias("_row")), "sizes")[0]


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and positions of documents, by first position.

    Documents that the mix leaves out come last. See mixture() for the options and for null
    and repeated rows; null texts have size 0.
    """
    mixed = mixture(numbered(docs, F.col("doc_id"), F.col("source")), **options)
    return mixed.drop("_tie", "_row").orderBy(F.get("positions", 0).asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The training stream: documents in order of position, repeated as often as they are taken.

    Columns are those of docs. A pass that takes under half of a document's words leaves the
    document out, one that takes more takes all of it. Documents are written once with the
    numbers of their rows, by which they meet their positions, so equal rows and equal ids do
    not meet each other.
    """
    whole = numbered(docs, F.col("doc_id"), F.col("source"), F.struct(*docs.columns).alias("row"))
    mixed = mixture(whole.drop("row"), **options)
    taken = F.round(F.col("taken") / F.col("size")).cast("int")
    at = mixed.where("taken > 0").select("_row", F.explode(F.slice("positions", F.lit(1), F.greatest(F.lit(0), taken))).alias("_at"))
    return whole.select("_row", "row").join(at, "_row").orderBy("_at").select("row.*")
