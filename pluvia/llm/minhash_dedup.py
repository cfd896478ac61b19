"""MinHash near-duplicates: many hash minima, bands, verification, connected components.

1. Each text becomes its set of word shingles, as 64-bit hashes, and the minima of 128
   universal hash functions (multiplication by odd numbers) over that set. Texts with
   the same set are one class from here on; copies cost no more work.
2. 32 bands of 4 minima are the buckets. Two sets at the least similarity of 0.8 share
   no bucket with a probability of 5e-8.
3. In each bucket every class is paired with the bucket's least class only. Pairs go on
   if their signatures agree well enough (five standard deviations below the limit) and
   are confirmed on the full sets. Components of these links follow by large-star and
   small-star.
4. What is left are classes of different components in one bucket, say documents that
   share a long passage and little else. They are joined exactly: two sets at the limit
   have a shingle in common among the rarest fifth of each, if shingles that no other
   open component has come first. Such shingles deal the classes anew. Up to
   ``pair_limit`` classes under one shingle are paired across components, each pair under
   its first common shingle only; more are compared in blocks of bounded size, as products
   of incidence matrices, and only links leave a block. Found links join the components.

So the links give the components that all pairs would give, but for pairs that share no
bucket, and without the pairs inside a group of near copies. Joins are between written
tables, which lets Spark split a hot bucket or class.

Nulls and other cases: a null, empty or blank text has no shingles and is linked with
nothing; fewer words than a shingle make one shingle of them all; words are lower-cased
in A-Z only; repeated rows are copies; rows that share an id count as one document with
the links of all of them; rows without id share the component of equal sets only, and
have a null component if no row with an id has their set; an empty table gives no rows.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.batches import small_batches
from pluvia.llm.components import components
from pluvia.llm.words import mixed, odd_numbers, runs, word_hashes
from pluvia.session import materialise

ROWS = 4
BANDS = 32
HASHES = ROWS * BANDS
BLOCK = 1 << 16
COLUMNS = 4096


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(runs(words, k))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set (32-bit)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    factors = (odd_numbers(11, HASHES) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, (factors[:, None] * x[None, lo:lo + 1024]).min(1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = values.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mixed(out + parts[:, j])
    return out


def _lowered(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (None if t is None else t.lower() for t in batch.column("text").to_pylist())


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, keys, marks = [], [], [], [], []
            for words in word_hashes(_lowered(batch)):
                s = shingle_set(words, k)
                sizes.append(len(s))
                first.append(mixed(s).sum(dtype=np.uint64))
                second.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                values = minima(s)
                keys.append(band_keys(values).view(np.int64) if len(s) else None)
                marks.append((values & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)),
                pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "keys", "marks"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = batch.column("doc_id").to_pylist(), [], 0
            done = 0
            for words in word_hashes(_lowered(batch)):
                sets.append(shingle_set(words, k).view(np.int64))
                size += len(sets[-1])
                if size > 1 << 20:
                    yield _set_batch(ids[done:done + len(sets)], sets)
                    done, sets, size = done + len(sets), [], 0
            yield _set_batch(ids[done:], sets)

    return run


def _set_batch(ids: list, sets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    return texts(docs).mapInArrow(
        _sign(k), "doc_id long, n_shingles long, k1 long, k2 long, keys array<bigint>, marks binary")


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("marks_a", "marks_b"))
        fits = (a == b).sum(1) >= least
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(fits)), batch.column("b").filter(pa.array(fits))], ["a", "b"])


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures agree well enough."""
    p, chance = percent / 100, 1 / 256
    expected = p + (1 - p) * chance
    least = int(np.floor(HASHES * expected - 5 * np.sqrt(HASHES * expected * (1 - expected))))
    marks = classes.select("node", "marks", "n_shingles")
    a = marks.select(F.col("node").alias("a"), F.col("marks").alias("marks_a"), F.col("n_shingles").alias("n_a"))
    b = marks.select(F.col("node").alias("b"), F.col("marks").alias("marks_b"), F.col("n_shingles").alias("n_b"))
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return materialise(
        pairs.join(b, "b").join(a, "a").where(sized).select("a", "b", "marks_a", "marks_b")
        .mapInArrow(lambda batches: _agreeing(batches, least), "a long, b long").distinct(), "near-pairs")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the documents whose id is a node; a row for each different set."""
    return texts(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(
        _sets(k), "node long, shingles array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    sets_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    return materialise(
        pairs.join(sets_b, "b").join(sets_a, "a").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
        .where(100 * F.col("both") >= percent * union).select("a", "b").distinct(), "links")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    near = agreeing(pairs, classes, percent)
    nodes = materialise(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "near-nodes")
    return similar(near, materialise(shingle_sets(docs, nodes, k), "sets"), percent)


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every one of ``b``, exactly."""
    flat = np.concatenate([*a, *b])
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # shingles that only one set has are in no intersection
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    held = times[place] > 1
    owner, at = owner[held], column[place][held]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        some = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        dense = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        dense[owner[some], at[some] - lo] = 1
        out += dense[:len(a)] @ dense[len(a):].T
    return out.astype(np.int64)  # float32 counts are exact under 2^24


def _block_links(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
        frame = frame.sort_values(["node", "sid"])
        left = frame[frame["chunk"] == lo]
        right = frame[frame["chunk"] == hi]
        sizes = [f["shingles"].map(len).to_numpy() for f in (left, right)]
        both = common_counts(list(left["shingles"]), list(right["shingles"]))
        link = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        link &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        i, j = np.nonzero(link)
        a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def remaining_links(open_nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, pair_limit: int) -> DataFrame:
    """All links (a, b) between different components among ``open_nodes`` (node, root)."""
    sets = shingle_sets(docs, open_nodes, k)
    own = materialise(sets.withColumn("sid", F.xxhash64("shingles")).dropDuplicates(["node", "sid"]).join(open_nodes, "node"), "open-sets")
    rows = own.select("node", "sid", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = materialise(
        rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r1"), F.max("root").alias("r2"))
        .where("r1 <> r2").select("shingle", "df"), "open-shingles")
    one = Window.partitionBy("node", "sid")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    first = materialise(
        rows.join(shared, "shingle").withColumn("rank", F.row_number().over(one.orderBy("df", "shingle")))
        .withColumn("others", F.count(F.lit(1)).over(one))
        .where(F.col("rank") + F.col("n") - F.col("others") <= length).select("shingle", "node", "sid", "root", "n"), "first-shingles")
    sizes = materialise(
        first.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"), F.min("root").alias("r1"), F.max("root").alias("r2"))
        .where("r1 <> r2").select("shingle", "size", "words"), "first-sizes")

    prefixes = materialise(first.groupBy("node", "sid").agg(F.collect_set("shingle").alias("pre")), "prefixes")
    dealt = first.join(sizes, "shingle")
    # a pair counts under its least common shingle, so a row needs the lesser ones of its prefix only
    small = materialise(
        dealt.where(F.col("size") <= pair_limit).drop("size", "words").join(prefixes, ["node", "sid"])
        .withColumn("pre", F.expr("filter(pre, x -> x < shingle)")), "small-groups")
    left = small.select("shingle", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("pre").alias("pre_a"), F.col("n").alias("n_a"))
    right = small.select("shingle", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("pre").alias("pre_b"), F.col("n").alias("n_b"))
    fits = ("a < b and root_a <> root_b and 100 * least(n_a, n_b) >= {0} * greatest(n_a, n_b) "
            "and not arrays_overlap(pre_a, pre_b)").format(percent)
    paired = materialise(left.join(right, "shingle").where(fits).select("a", "b").distinct(), "small-pairs")
    links = similar(agreeing(paired, classes, percent), own, percent)

    large = materialise(dealt.where(F.col("size") > pair_limit), "large-groups")
    if large.isEmpty():
        return links
    chunks = F.ceil(F.col("words") / BLOCK).cast("int")
    blocks = (
        large.withColumn("chunk", F.pmod(F.xxhash64("node", "sid"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("shingle", "node", "sid", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
        .join(own, ["node", "sid"]))
    found = blocks.groupBy("shingle", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")
    return materialise(links.unionByName(found).distinct(), "all-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, pair_limit: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    ``percent`` is the least share of common shingles in all shingles of two documents.
    """
    rows = materialise(signatures(docs, k), "signatures")
    classes = materialise(
        rows.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("marks").alias("marks")), "classes")
    linked = classes.where("node is not null")
    banded = linked.select("node", F.posexplode("keys").alias("band", "bucket"))
    buckets = materialise(
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center"))
        .where("size > 1").select("bucket", "center"), "buckets")
    members = materialise(banded.join(buckets, "bucket"), "members")
    first = confirmed(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(),
                      linked, docs, k, percent)
    roots = components(first)
    rooted = members.select("bucket", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # buckets whose members are in one component need no more pairs
    open_buckets = materialise(
        rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket"),
        "open-buckets")
    open_nodes = materialise(rooted.join(open_buckets, "bucket", "left_semi").select("node", "root").distinct(), "open-nodes")
    second = remaining_links(open_nodes, linked, docs, k, percent, pair_limit)
    if not second.isEmpty():
        roots = components(first.unionByName(second))
    ends = materialise(
        classes.select("k1", "k2", "n_shingles", "node").join(roots, "node", "left")
        .select("k1", "k2", "n_shingles", F.coalesce("root", "node").alias("component_id")), "class-components")
    return (rows.select("doc_id", "k1", "k2", "n_shingles").join(ends, ["k1", "k2", "n_shingles"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that of the least id, null last.

    Rows are told apart by a number of their own, so differing texts under one id, and rows
    without id, are documents like any other; repeated rows are copies of which one stays.
    A row without shingles stays, each time it occurs.
    """
    rows = materialise(docs.withColumn("_dedup_row", F.monotonically_increasing_id()), "dedup-rows")
    found = near_duplicates(rows.select(F.col("_dedup_row").alias("doc_id"), "text"), k, percent)
    placed = rows.select("_dedup_row", F.col("doc_id").alias("_dedup_id")).join(
        found.select(F.col("doc_id").alias("_dedup_row"), "component_id"), "_dedup_row")
    first = F.min(F.struct(F.col("_dedup_id").isNull().alias("last"), "_dedup_id", "_dedup_row"))["_dedup_row"]
    keep = materialise(placed.groupBy("component_id").agg(first.alias("_dedup_row")).select("_dedup_row"), "kept-rows")
    return rows.join(keep, "_dedup_row", "left_semi").select(*docs.columns)
