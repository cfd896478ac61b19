"""Sharding by extendible hashing: shards are hash prefixes, split only where too large.

A document's key is the first 60 bits of the MD5 of its id. A shard is a prefix of those
bits. The empty prefix is one shard; a shard over ``limit`` bytes splits on its next bit
until every shard fits. The directory maps the next eight bits of a still unsettled
prefix to the shard that holds them, so it grows with the shards and not with two to the
power of the deepest one.

DataFrame functions only. Each round sums bytes by prefix with map-side combine, rolls
the sums up to the eight depths in between, and settles the shallowest prefixes that fit.
Rows are read again only to be looked up in the written directories at the end.

Nulls and other cases: a null text counts 0 bytes, a null id hashes like the empty
string; documents that agree in all 60 bits (repeated ids) cannot be parted, so they
share a shard, as does a single document over the limit, and that shard has
``oversized`` true; a limit under 1 is refused; an empty table gives no rows and no
shards. Other columns are kept out of the result and never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import materialise

BITS = 60
STEP = 8


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, bits, bytes): hash bits as a long and UTF-8 bytes of the text."""
    hexed = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, BITS // 4)
    return docs.select(
        "doc_id", F.conv(hexed, 16, 10).cast("long").alias("bits"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))


def _prefix(bits, depth):
    """The first ``depth`` of the hash bits as a long (depth 0: 0)."""
    return F.shiftrightunsigned(bits, BITS - depth) if depth else F.lit(0).cast("long")


def directories(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Written directories [(known bits, (entry, depth, shard_bits, shard_bytes, oversized))].

    A directory's ``entry`` is a prefix of that many bits; its shard is the prefix of
    ``depth`` bits in ``shard_bits``. Entries that are still too large have no row here
    but rows in the next directory.
    """
    found: list[tuple[int, DataFrame]] = []
    open_rows, depth = rows, 0
    while True:
        known = min(depth + STEP, BITS)
        sums = materialise(
            open_rows.groupBy(_prefix(F.col("bits"), known).alias("entry"))
            .agg(F.sum("bytes").alias("bytes"), F.min("bits").alias("least"), F.max("bits").alias("most")),
            "prefix-sums")
        # depth + 1 .. known (and 0 at the start): an entry belongs to one prefix of each
        depths = list(range(depth + 1 if depth else 0, known + 1))
        rolled = (
            sums.select("entry", "bytes", "least", "most", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
            .withColumn("shard_bits", F.expr(f"shiftrightunsigned(entry, {known} - depth)"))
            .groupBy("depth", "shard_bits")
            .agg(F.sum("bytes").alias("shard_bytes"), F.min("least").alias("least"), F.max("most").alias("most")))
        # a shard of one hash value cannot split any more, however large
        fits = rolled.where((F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most")))
        settled = fits.select("depth", "shard_bits", "shard_bytes",
                              (F.col("shard_bytes") > limit).alias("oversized"))
        entries = (
            sums.select("entry", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
            .withColumn("shard_bits", F.expr(f"shiftrightunsigned(entry, {known} - depth)"))
            .join(settled, ["depth", "shard_bits"])
            .groupBy("entry")  # at most nine rows each: the shallowest that fits
            .agg(F.min(F.struct("depth", "shard_bits", "shard_bytes", "oversized")).alias("s"))
            .select("entry", "s.*"))
        directory = materialise(entries, "directory")
        found.append((known, directory))
        left = materialise(sums.select("entry").join(directory, "entry", "left_anti"), "unsettled")
        if left.isEmpty():
            return found
        depth = known
        open_rows = open_rows.join(
            left.withColumnRenamed("entry", "unsettled"),
            _prefix(F.col("bits"), known) == F.col("unsettled"), "left_semi")


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, oversized) of every document.

    ``shard`` is the prefix as text of 0s and 1s (empty for the only shard).
    """
    if limit < 1:
        raise ValueError("the byte limit of a shard must be positive")
    rows = materialise(keyed(docs), "shard-keys")
    found = directories(rows, limit)
    out, names = rows, ("depth", "shard_bits", "shard_bytes", "oversized")
    for k, (known, directory) in enumerate(found):
        own = directory.select(F.col("entry").alias(f"entry{k}"), *(F.col(n).alias(f"{n}{k}") for n in names))
        out = out.join(own, _prefix(F.col("bits"), known) == F.col(f"entry{k}"), "left")
    pick = {n: F.coalesce(*(F.col(f"{n}{k}") for k in range(len(found)))) for n in names}
    return (out.select("doc_id", "bytes", *(c.alias(n) for n, c in pick.items()))
            .select("doc_id", "bytes", F.when(F.col("depth") == 0, "").otherwise(
                F.expr("lpad(bin(shard_bits), depth, '0')")).alias("shard"),
                "depth", "shard_bytes", "oversized"))


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write the documents as Parquet, one folder for each shard.

    Every shard fits one task by its byte limit, so rows are dealt by shard. Repeated
    documents get repeated rows; the columns of ``docs`` are kept as they are.
    """
    shards = materialise(shard(docs, limit).groupBy("doc_id").agg(F.max("shard").alias("shard_prefix")), "shards")
    own = shards.select(F.col("doc_id").alias("shard_doc_id"), "shard_prefix")
    placed = docs.join(own, docs["doc_id"].eqNullSafe(own["shard_doc_id"])).drop("shard_doc_id")
    placed.repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)
