"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: the total is shared by source weights, a source stops
at ``most`` times its own words, and what it cannot take is shared again by weight.

Within a source a document of value v is due ``c * v`` copies, at most ``most``; c makes
the due words meet the target. The whole part of that is certain. The fraction p is an
inclusion probability: documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with u
uniform from a hash of the document, and taken in that order until the words left over
from the whole copies are filled, the last one if that comes nearer. Repeated rows share
one draw and one rank, and the sample may end between them. So every source meets its
target to within half a document, and the same input and seed give the same sample.

Values are small positive integers, so a source's documents fall into few (value)
classes whose sums are exact longs; c is found from those sums. Ranking never sorts a
source: the order is cut into 256 ranges at a time by counting words with map-side
combine, and only the range in which the sample ends is opened further. A source with
a third of all rows costs 256 sums, like any other.

Nulls and other cases: null text has 0 words and is taken 0 times; a null source is a
source of its own, the last; null ids are hashed with the text; repeated rows share one
draw, and where the sample ends among them as many are taken as bring it nearest; a source without words has target 0; an empty table gives no rows. Other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
FAN = 256
DRAWN_BITS = 52
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    """1 for no word, then one more for every doubling: a value that favours long texts a little."""
    return (F.length(F.bin(size)) + 7).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    ``weights`` repeat over the sources in code point order, null last. The table has one
    row a source, so its two windows hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("at", (F.row_number().over(by_name) - 1) % len(weights))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") + 1).cast("int")).cast("double"))
    # filled in order of cap / weight: once a source is not capped at the common level, none after it is
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cap = most * F.col("source_size")
    level = ((share * F.col("all_size") - F.col("capped")) / F.col("open_weight"))
    leveled = weighted.withColumn("all_size", total).withColumn(
        "capped", F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn(
        "open_weight", F.sum("weight").over(rest)).withColumn("level", level)
    place = F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source", "level")
    first = leveled.where(F.col("level") * F.col("weight") <= cap).agg(F.min(place)["level"].alias("common"))
    return leveled.crossJoin(F.broadcast(first)).select(  # one row
        "source", "source_size",
        F.when(F.col("common").isNull(), cap).otherwise(
            F.least(cap.cast("double"), F.col("common") * F.col("weight"))).cast("double").alias("target"))


def copies_due(classes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(source, value, whole, part): certain copies and inclusion probability of each class.

    ``classes`` has (source, value, words). With values in falling order, the classes
    that reach ``most`` copies are a head; c follows from the words that are left.
    """
    down = Window.partitionBy("source").orderBy(F.desc("value"))
    head = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.sum(F.col("words") * F.col("value")).over(down.rowsBetween(0, Window.unboundedFollowing))
    with_c = classes.join(targets.select(F.col("source").alias("own"), "target"), F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn(
        "c", F.when(tail > 0, (F.col("target") - most * head) / tail).otherwise(F.lit(0.0)))
    # the first class in falling order that c leaves below the most is where the head ends
    ends = F.max(F.when(F.col("c") * F.col("value") < most, F.struct("value", "c"))).over(Window.partitionBy("source"))
    due = F.when(ends.isNull() | (F.col("value") > ends["value"]), F.lit(float(most))).otherwise(
        F.greatest(F.lit(0.0), ends["c"] * F.col("value")))
    return with_c.withColumn("due", due).select(
        "source", "value", F.floor("due").alias("whole"), (F.col("due") - F.floor("due")).alias("part"))


def _drawn(seed: int) -> Column:
    """52 hash bits of the document, the same on every run."""
    own = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                      F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, DRAWN_BITS // 4), 16, 10).cast("long")


def _range(level: int) -> Column:
    """Which of 256 parts of the order the document falls into, at one of the levels."""
    return F.expr(f"shiftrightunsigned(_mix_place, {8 * (LEVELS - 1 - level)}) & {FAN - 1}")


def _described(docs: DataFrame, seed: int, value: Column | None) -> DataFrame:
    """``docs`` with the columns _mix_row, _mix_source, _mix_drawn, _mix_size and _mix_value.

    ``_mix_row`` tells repeated rows apart: it holds from when the rows are written.
    """
    sized = docs.withColumns({"_mix_row": F.monotonically_increasing_id(), "_mix_source": F.col("source").cast("string"), "_mix_drawn": _drawn(seed),
                              "_mix_size": word_count(F.col("text"))})
    return sized.withColumn("_mix_value", (value if value is not None else length_class(F.col("_mix_size"))).cast("long"))


def _placed(described: DataFrame, due: DataFrame) -> DataFrame:
    """Adds _mix_whole, _mix_odds and _mix_place: certain copies, and the place in the order for one more."""
    own = due.select(*(F.col(c).alias(f"_due_{c}") for c in ("source", "value", "whole", "part")))
    u = (F.col("_mix_drawn") + 0.5) / float(2**DRAWN_BITS)
    odds = (u / (1 - u)) * ((1 - F.col("_due_part")) / F.col("_due_part"))
    return (
        described.join(own, F.col("_mix_source").eqNullSafe(F.col("_due_source")) & (F.col("_mix_value") == F.col("_due_value")), "left")
        .withColumn("_mix_whole", F.when(F.col("_mix_size") > 0, F.coalesce("_due_whole", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("_mix_odds", F.when((F.col("_due_part") > 0) & (F.col("_mix_size") > 0), odds))
        # 24 bits of odds / (1 + odds), which keeps the order of the odds
        .withColumn("_mix_place", F.when(F.col("_mix_odds").isNotNull(), F.least(
            F.floor(F.col("_mix_odds") / (1 + F.col("_mix_odds")) * FAN**LEVELS), F.lit(FAN**LEVELS - 1)).cast("int")))
        .drop("_due_source", "_due_value", "_due_whole", "_due_part"))


def _key() -> Column:
    """The place of a document in its source's order; repeated rows share it."""
    return F.struct(F.col("_mix_odds").alias("odds"), F.col("_mix_drawn").alias("drawn"), F.col("doc_id").cast("long").alias("doc_id"))


def _taken(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds _mix_copies: the certain copies, and one more up to the source's cut."""
    own = cuts.select(*(F.col(c).alias(f"_cut_{c}") for c in ("source", "place", "last", "row")))
    upto = (_key() < F.col("_cut_last")) | ((_key() == F.col("_cut_last")) & (
        F.col("_cut_row").isNull() | (F.col("_mix_row") <= F.col("_cut_row"))))
    more = (F.col("_mix_place") < F.col("_cut_place")) | (
        (F.col("_mix_place") == F.col("_cut_place")) & F.col("_cut_last").isNotNull() & upto)
    return placed.join(own, F.col("_mix_source").eqNullSafe(F.col("_cut_source")), "left").withColumn(
        "_mix_copies", (F.col("_mix_whole") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")).drop(
        "_cut_source", "_cut_place", "_cut_last", "_cut_row")


def plan(rows: DataFrame, weights: list[int], share: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, due, cuts) of described rows: written tables with a few rows a source.

    ``cuts`` has the place in the order where a source's sample ends and, in that place,
    the last document taken; where not all its repeats are, the last row taken of them.
    """
    classes = materialise(rows.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_value").alias("value")).agg(
        F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("docs")), "mix-classes")
    targets = materialise(source_targets(
        classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")
    due = materialise(copies_due(classes, targets, most), "mix-due")
    placed = materialise(_placed(rows.select("doc_id", "_mix_row", "_mix_source", "_mix_drawn", "_mix_size", "_mix_value"), due), "mix-placed")
    left = materialise(
        placed.groupBy("_mix_source").agg(F.sum(F.col("_mix_whole") * F.col("_mix_size")).alias("certain"))
        .join(targets, F.col("_mix_source").eqNullSafe(F.col("source")))
        .select("source", (F.col("target") - F.col("certain")).alias("room")), "mix-room")

    end = left.withColumn("prefix", F.lit(0))  # the range in which the sample ends, so far
    opened = placed.where("_mix_place is not null")
    for level in range(LEVELS):
        inside = opened.join(end, F.col("_mix_source").eqNullSafe(F.col("source")) & (
            F.expr(f"shiftrightunsigned(_mix_place, {8 * (LEVELS - level)})") == F.col("prefix")))
        sums = inside.groupBy("source", "room", "prefix", _range(level).alias("part_of")).agg(F.sum("_mix_size").alias("words"))
        upto = Window.partitionBy("source").orderBy("part_of").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.sum("words").over(upto))
        # the last range that starts within the room: all ranges before it are taken whole
        hit = run.where(F.col("upto") - F.col("words") < F.col("room")).groupBy("source", "room", "prefix").agg(
            F.max(F.struct("part_of", (F.col("upto") - F.col("words")).alias("before"))).alias("hit"))
        end = materialise(hit.select(
            "source", (F.col("room") - F.col("hit.before")).alias("room"),
            (F.col("prefix") * FAN + F.col("hit.part_of")).cast("int").alias("prefix")), "mix-end")

    # one 16.7 millionth of a source, repeats counted first: the only rows that are put in order one by one
    inside = opened.join(end, F.col("_mix_source").eqNullSafe(F.col("source")) & (F.col("_mix_place") == F.col("prefix"))).select(
        "source", "room", "_mix_row", F.col("_mix_size").alias("size"), _key().alias("key"))
    last = inside.groupBy("source", "room", "key").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("room") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    near = last.withColumn("fits", F.floor(room / F.col("size") + 0.5)).where("fits >= 1")
    ends = materialise(near.groupBy(F.col("source").alias("end_source")).agg(
        F.max(F.struct("key", F.least("fits", "n").alias("some"), "n")).alias("e")).select("end_source", "e.*"), "mix-ends")
    # the row up to which repeats are taken: first the part of the written rows that it lies in, then its place there
    parted = inside.withColumnRenamed("key", "own_key").join(
        ends.where("some < n"), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("own_key") == F.col("key"))).select(
        "source", "some", "_mix_row", F.shiftright("_mix_row", 33).alias("part_of"))
    counts = parted.groupBy("source", "some", "part_of").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part_of")) - F.col("n")
    inner = counts.withColumn("before", before).where((F.col("before") < F.col("some")) & (F.col("some") <= F.col("before") + F.col("n")))
    inner = inner.select(F.col("source").alias("hit_source"), F.col("part_of").alias("hit_part"), (F.col("some") - F.col("before")).alias("nth"))
    within = parted.join(inner, F.col("source").eqNullSafe(F.col("hit_source")) & (F.col("part_of") == F.col("hit_part")))
    rows_cut = within.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("_mix_row"))).where("i = nth").select(
        F.col("source").alias("row_source"), F.col("_mix_row").alias("row"))
    cuts = materialise(
        end.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
        .join(rows_cut, F.col("source").eqNullSafe(F.col("row_source")), "left")
        .select("source", F.col("prefix").alias("place"), F.col("key").alias("last"), "row"), "mix-cuts")
    return targets, due, cuts


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2, seed: int = 17,
        value: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    ``copies`` is how often the mix takes the document, ``taken`` the words of that.
    ``value`` is a positive integer expression over ``_mix_size``, the words of the
    document; by default ``length_class``.
    """
    rows = materialise(_described(docs.select("doc_id", "source", "text"), seed, value).drop("text", "source"), "mix-rows")
    targets, due, cuts = plan(rows, weights, share, most)
    taken = _taken(_placed(rows, due), cuts)
    return taken.join(targets, F.col("_mix_source").eqNullSafe(F.col("source")), "left").select(
        "doc_id", F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), "source_size", "target",
        F.col("_mix_copies").alias("copies"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2, seed: int = 17,
          value: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they are."""
    rows = materialise(_described(docs, seed, value), "mix-rows")
    _, due, cuts = plan(rows, weights, share, most)
    taken = _taken(_placed(rows, due), cuts)
    return taken.withColumn("_mix_copy", F.explode(F.expr("array_repeat(1, cast(_mix_copies as int))"))).select(*docs.columns)
