"""Fingerprints of documents from closed syncmers, and their likeness to edited texts.

A closed syncmer is a run of k code points whose least inner run of s code points, by
hash, is its first or its last. Whether a run is chosen depends on nothing outside it, so
equal passages choose equal anchors wherever they stand and whatever surrounds them; with
``k = 24`` and ``s = 8`` about two of 17 positions are anchors, and any 39 code points in
a row (k + (k - s) - 1) hold at least one.

An anchor is kept as one long: its place in code points above the low 32 bits of its hash.
A fingerprint is the hashes in text order as eight hex digits each. Fingerprints are
compared by their different anchors (Dice's share, 0 to 1); anchors at the same place in
both are counted beside that.

DataFrame functions only, whole texts. Minima over the 17 inner runs come from four
doublings, so work grows with the length and not with k. Texts are worked off in pieces
of ``PIECE`` code points that overlap by k - 1, which changes nothing: anchors are
context-free. For the same reason an edited text keeps the anchors of its parts, and only
the runs over the joint are looked at anew.

A document's successor in descending order of ids stands in the next row of a range of
ids. Rows are dealt by range (``blocks`` of them, hashed over the tasks), one exchange of
the texts; the first row of a range goes to the range before it as well, and the first of
all to the last. The ranges come from a bounded sample of ids; every row is dealt.

Nulls and other cases: a null text is empty; the empty text has the empty fingerprint, and
two empty ones are alike (1), an empty and another are not (0); a text in which no run is
chosen, such as one shorter than k, has one anchor, its whole; null ids come last, rows
with one id are ordered by a hash of their texts, and rows equal in both stay together in
one range; a lone document is its own successor; an empty table gives no rows. Other
columns are never read and never clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 24, 8
PIECE = 1 << 16
LOW = 0xFFFFFFFF
BLOCKS = 4096
OVERSAMPLED = 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _least(values: Column, step: int) -> Column:
    """Least of each value and the one ``step`` further on, if there is one."""
    return F.zip_with(values, F.slice(values, F.lit(step + 1), F.size(values)), lambda a, b: F.least(a, b))


def _minima(values: Column, width: int, use: Callable[[Column], Column], have: int = 1) -> Column:
    """``use`` of the least of every ``width`` values in a row (fewer at the end), by doubling."""
    if have == width:
        return use(values)
    step = min(have, width - have)
    return bound(_least(values, step), lambda wider: _minima(wider, width, use, have + step))


def _starts(code: Column, size: int) -> Column:
    """Byte offsets, from 1, of all runs of ``size`` code points in four bytes each."""
    last = F.octet_length(code) - 4 * size + 1
    return F.when(last > 0, F.sequence(F.lit(1), last, F.lit(4))).otherwise(F.array().cast("array<int>"))


def _chosen(code: Column, k: int, s: int) -> Column:
    """Byte offsets of the closed syncmers of a text in UTF-32."""
    inner = F.transform(_starts(code, s), lambda at: F.xxhash64(F.substring(code, at, F.lit(4 * s))))

    def pick(hashes: Column) -> Column:
        return bound(_least(hashes, k - s), lambda edge: _minima(hashes, k - s, lambda least: F.filter(
            _starts(code, k), lambda at, i: F.get(edge, i) <= F.get(least, i))))

    return bound(inner, pick)


def anchor(place: Column, code: Column) -> Column:
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(F.xxhash64(code).bitwiseAND(F.lit(LOW)))


def chosen(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text, in its order, as ``place * 2^32 + hash``."""
    pieces = F.sequence(F.lit(0), F.greatest(F.char_length(text) - k, F.lit(0)), F.lit(PIECE))

    def of_piece(start: Column) -> Column:
        code = F.encode(F.substring(text, start + 1, F.lit(PIECE + k - 1)), "UTF-32")
        return bound(code, lambda c: F.transform(_chosen(c, k, s), lambda at: anchor(
            F.shiftright(at, 2) + start, F.substring(c, at, F.lit(4 * k)))))

    return F.flatten(F.transform(pieces, of_piece))


def or_whole(found: Column, text: Column) -> Column:
    """``found``, or where no run was chosen the whole text as the one anchor, if it has any."""
    whole = F.when(F.char_length(text) > 0, F.array(anchor(F.lit(0), F.encode(text, "UTF-32")))).otherwise(
        F.array().cast("array<bigint>"))
    return bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text, in its order."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return or_whole(chosen(text, k, s), text)


def joined(left: Column, cut: Column, right: Column, text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of ``text``: the first ``cut`` code points of one text, then the
    start of another, whose closed syncmers are ``left`` and ``right``.

    Being context-free, those that lie in one part are the parts' own; only the runs over
    the joint are looked at.
    """
    def at(cut: Column) -> Column:  # lengths are computed once, not for each anchor
        shifted = lambda found, by: bound(F.shiftleft(by.cast("long"), 32), lambda b: F.transform(found, lambda x: x + b))
        start = F.greatest(cut - (k - 1), F.lit(0))
        over = F.substring(text, start + 1, cut - start + k - 1)
        first = bound(cut - k, lambda last: F.filter(left, lambda x: F.shiftright(x, 32) <= last))
        rest = bound(F.char_length(text) - cut - k, lambda last: F.filter(right, lambda x: F.shiftright(x, 32) <= last))
        return F.concat(first, shifted(bound(over, lambda t: chosen(t, k, s)), start), shifted(rest, cut))

    return bound(cut, at)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda x: x.bitwiseAND(F.lit(LOW)))


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(hashes(found), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the anchors that both have, of all different anchors of each; 1 where neither has any."""
    return bound(F.array_distinct(hashes(a)), lambda x: bound(F.array_distinct(hashes(b)), lambda y: F.when(
        F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(
            2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1)))))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, fingerprint, places): one row a document; places are those of its anchors."""
    found = docs.select("doc_id", anchors(F.col("text"), k, s).alias("found"))
    return found.select("doc_id", fingerprint(F.col("found")).alias("fingerprint"), F.transform(
        "found", lambda x: F.shiftright(x, 32)).alias("places"))


def order_key() -> Column:
    """Text that ascends with descending ids (null last), then with a hash of the text."""
    turned = F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(2**63 - 1)))
    own = F.hex(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.concat(F.coalesce(F.lpad(turned, 16, "0"), F.lit("G")), F.lpad(own, 16, "0"))


def _upto(bounds: Column, n: int, key: Column) -> Column:
    """How many of the n ascending ``bounds`` are at most ``key``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def with_successor(docs: DataFrame, value: Callable[[Column], Column], blocks: int | None = None) -> DataFrame:
    """(doc_id, text, value, next_text, next_value) by descending id, the first after the last.

    ``value`` is computed once for each row.
    """
    spark = docs.sparkSession
    blocks = min(BLOCKS, blocks or 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), order_key().alias("key"))
    size = keyed.agg(F.count("*").alias("n"), F.min("key").alias("first")).first()
    share = min(1.0, OVERSAMPLED * blocks / max(1, size["n"]))
    sample = sorted({r["key"] for r in keyed.sample(share, seed=1).select("key").toLocalIterator()})
    bounds = sample[:: max(1, -(-len(sample) // blocks))]
    cuts, n = F.split(F.lit(",".join(bounds)), ","), len(bounds)
    key, block = F.col("key"), F.col("block")
    at = lambda number, tail: F.struct(number.cast("int").alias("block"), F.lit(tail).alias("tail"))
    targets = F.array(at(block, False), F.when((block > 0) & (F.get(cuts, block - 1) == key), at(block - 1, True)),
                      F.when(key == F.lit(size["first"]), at(F.lit(n), True)))
    dealt = keyed.withColumn("block", _upto(cuts, n, key) if n else F.lit(0)).withColumn(
        "target", F.explode(F.filter(targets, lambda x: x.isNotNull()))).select(
            "doc_id", "text", "key", "target.block", "target.tail").repartition("block")
    order = Window.partitionBy("block").orderBy("tail", "key")
    valued = dealt.withColumn("value", value(F.col("text")))
    return valued.withColumns({"next_text": F.lead("text").over(order), "next_value": F.lead("value").over(order)}).where(
        ~F.col("tail")).select("doc_id", "text", "value", "next_text", "next_value")


def half(text: Column) -> Column:
    """Half the text's code points, rounded down."""
    return F.floor(F.char_length(text) / 2).cast("int")


def edited(text: Column, successor: Column) -> Column:
    """The text with its last half replaced by as much of its successor's start."""
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half(text)), F.substring(successor, F.lit(1), half(text)))


def compare(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    text, after = F.col("text"), F.col("next_text")
    rows = with_successor(docs, lambda text: chosen(text, k, s)).withColumn("edited", edited(text, after))
    cut = F.char_length(text) - half(text)
    rows = rows.withColumns({
        "own": or_whole(F.col("value"), text), "other": or_whole(F.col("next_value"), after),
        "new": or_whole(joined(F.col("value"), cut, F.col("next_value"), F.col("edited"), k, s), F.col("edited"))})
    own, new, other = F.col("own"), F.col("new"), F.col("other")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, other).alias("near_next"),
        F.size(F.array_intersect(own, new)).cast("long").alias("in_place_edited"),
        F.size(F.array_intersect(own, other)).cast("long").alias("in_place_next"))
