"""Merkle manifest of a table: digests of rows, trees by group, one root, proofs of rows.

Every row is a leaf of its group's tree (here a language), in ascending order of its id.
A level is one table of (tree, idx, digest). A node's siblings are found by an equijoin
of the level with itself, shifted: with two nodes a run the sibling's index is ``idx XOR
1``, with more it is the run's start plus the other slots. The rows in slot 0 then emit
the parents, hashed over the run in slot order. The roots of the trees are, ordered by
group, the leaves of one tree above them.

Proofs go back down: a node's path is its siblings followed by its parent's path, so each
level is one more equijoin, and the longest paths are written for half the rows only.

All digests are SHA-256; they are concatenated as lowercase hex text and stored as bytes.
Positions inside a group come from one range exchange by (group, id): the rows of a task
count up from the number of rows in the tasks before it, so a group that holds most rows
is spread like any other, and no join key is a group alone but in tables of one row a
group.

Nulls and other cases: a null field hashes as ``-``, different from any value; a null
group is a tree of its own, before the others; null ids come first in their tree; rows
with one id are ordered by their digest, and equal rows are leaves of their own whose
order among them does not matter; a tree of one leaf has that leaf as its root; a proof
without any sibling is the digest of the empty text; an empty table gives no rows. Texts
are hashed whole. Other columns are never read and never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = "documents"


def hashed(*parts: Column) -> Column:
    """SHA-256 of the concatenated texts, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """A row's digest over ``FIELDS``; ``changed`` replaces some of them."""
    values = {name: F.col(name) for name in FIELDS} | (changed or {})
    return hashed(*(field(values[name]) for name in FIELDS))


def tampered() -> Column:
    """The digest of the row with one more in n_chars, for a seventh of the ids; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(chosen & F.col("n_chars").isNotNull(), leaf({"n_chars": F.col("n_chars") + 1}))


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``idx``, the place in the node's tree from 0, and the tree's ``size``."""
    at = F.monotonically_increasing_id()  # task and row, in the order just sorted
    placed = materialise(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", at), f"{name}-sorted")
    task = F.shiftrightunsigned("at", 33).alias("task")
    own = Window.partitionBy("tree")  # as many rows as the tree has tasks
    runs = placed.groupBy("tree", task).agg(F.min("at").alias("first"), F.count("*").alias("rows")).select(
        "tree", "task", (F.coalesce(F.sum("rows").over(own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)),
                                    F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(own).alias("size"))
    return placed.select("*", task).join(materialise(runs, f"{name}-runs"), ["tree", "task"]).withColumn(
        "idx", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Each node with ``others``: the digests of the rest of its run, in slot order."""
    idx = F.col("idx")
    if arity == 2:
        shifted = nodes.select("tree", idx.bitwiseXOR(F.lit(1).cast("long")).alias("idx"), F.col("digest").alias("others"))
    else:
        slot = idx % arity
        targets = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda step: idx - slot + (slot + step) % arity)
        shifted = nodes.select("tree", F.explode(targets).alias("idx"), slot.alias("slot"), "digest").groupBy("tree", "idx").agg(
            F.sort_array(F.collect_list(F.struct("slot", F.col("digest").alias("other")))).alias("run"))
        shifted = shifted.select("tree", "idx", F.aggregate(
            "run", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["other"])).alias("others"))
    return nodes.join(shifted, ["tree", "idx"], "left").withColumn("others", F.coalesce("others", F.lit(b"").cast("binary")))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level, emitted by the rows in slot 0, whose siblings all follow them."""
    return level.where(F.col("idx") % arity == 0).select(
        "tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"),
        F.ceil(F.col("size") / arity).cast("long").alias("size"),
        hashed(hexed(F.col("digest")), hexed(F.col("others"))).alias("digest"))


@dataclass
class Forest:
    """``levels`` hold (tree, idx, size, digest, others) of trees that have more than one
    node there, from the leaves up; ``roots`` (tree, digest) has one row a tree."""

    arity: int
    levels: list[DataFrame]
    roots: DataFrame

    def paths(self) -> DataFrame | None:
        """(tree, idx, path) of the leaves of trees with two leaves and more."""
        path = None
        for k, level in reversed(list(enumerate(self.levels))):
            own = level.select("tree", "idx", "others")
            if path is None:
                path = own.select("tree", "idx", F.array("others").alias("path"))
            else:
                above = path.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"))
                path = (own.withColumn("up", F.floor(F.col("idx") / self.arity).cast("long"))
                        .join(above, ["tree", "up"], "left")
                        .select("tree", "idx", F.concat(F.array("others"), F.coalesce(
                            "rest", F.array().cast("array<binary>"))).alias("path")))
            if k:
                path = materialise(path, "merkle-paths")
        return path


def forest(leaves: DataFrame, arity: int = 2) -> Forest:
    """The trees over ``leaves`` (tree, idx, size, digest)."""
    if arity < 2:
        raise ValueError("a run has at least two slots")
    top = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    nodes, levels = leaves.select("tree", "idx", "size", "digest"), []
    roots = nodes.where("size = 1").select("tree", "digest")
    while top > 1:
        level = materialise(with_siblings(nodes.where("size > 1"), arity), "merkle-level")
        levels.append(level)
        nodes, top = parents(level, arity), -(-top // arity)
        roots = roots.union(nodes.where("size = 1").select("tree", "digest"))
    return Forest(arity, levels, materialise(roots, "merkle-roots"))


def folded(digest: Column, path: Column, idx: Column, arity: int) -> Column:
    """The root (as bytes) that a node's digest and its path lead to."""
    def step(acc: Column, others: Column) -> Column:
        cut = (acc["i"] % arity).cast("int") * 64
        text = hexed(others)
        joined = F.concat(F.substring(text, F.lit(1), cut), acc["d"], F.substring(text, cut + 1, F.lit(64 * arity)))
        return F.struct(F.sha2(joined, 256).alias("d"), F.floor(acc["i"] / arity).cast("long").alias("i"))

    start = F.struct(hexed(digest).alias("d"), idx.cast("long").alias("i"))
    return F.unhex(F.aggregate(path, start, step, lambda acc: acc["d"]))


def with_paths(leaves: DataFrame, trees: Forest) -> DataFrame:
    """``leaves`` with the path to the root of their tree, empty for a lone leaf."""
    empty, paths = F.array().cast("array<binary>"), trees.paths()
    if paths is None:
        return leaves.withColumn("path", empty)
    return leaves.join(paths, ["tree", "idx"], "left").withColumn("path", F.coalesce("path", empty))


@dataclass
class Manifest:
    """``leaves`` (doc_id, tree, idx, digest, tampered), their trees, and the tree above,
    whose ``groups`` (tree, rank, subroot, up, root) have one row a group."""

    leaves: DataFrame
    trees: Forest
    groups: DataFrame

    def proofs(self) -> DataFrame:
        """Every leaf with its ``path`` inside its tree and its group's row."""
        return with_paths(self.leaves, self.trees).join(self.groups, "tree")


def build(docs: DataFrame, group: str = "lang", arity: int = 2) -> Manifest:
    """The manifest of ``docs``; one scan of the texts."""
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        leaf().alias("digest"), tampered().alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    # equal rows may stand in any order; the last column only spreads them over tasks
    leaves = materialise(numbered(materialise(rows, "merkle-leaves"), ["doc_id", "digest", "tie"], "merkle").drop("tie"), "merkle-numbered")
    trees = forest(leaves, arity)
    tops = trees.roots.select(F.lit(TREE).alias("tree"), F.col("tree").alias("name"), "digest")
    tops = materialise(numbered(tops, ["name"], "merkle-tops"), "merkle-tops-numbered")
    above = forest(tops, arity)
    root = above.roots.select("tree", F.col("digest").alias("root"))
    groups = with_paths(tops, above).join(root, "tree").select(
        F.col("name").alias("tree"), F.col("idx").alias("rank"), F.col("digest").alias("subroot"), F.col("path").alias("up"), "root")
    return Manifest(leaves, trees, materialise(groups, "merkle-groups"))


def verified(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    arity = manifest.trees.arity
    rows = manifest.proofs()
    text = lambda path: F.array_join(F.transform(path, hexed), "")
    inner = folded(F.coalesce("tampered", "digest"), F.col("path"), F.col("idx"), arity)
    found = rows.withColumn("inner", inner)
    found = found.withColumn("folded", folded(F.col("inner"), F.col("up"), F.col("rank"), arity))
    return found.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(F.concat(text(F.col("path")), text(F.col("up"))), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
