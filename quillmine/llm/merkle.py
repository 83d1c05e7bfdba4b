"""Merkle manifest of a table: a hash tree for each group of rows, one over the groups' roots, and a proof for each row.

A node is the sha256 (lowercase hex) of its up to `ARITY` children, concatenated as hex text. The rows of a group are its
leaves in order; while more than one node remains, runs of `ARITY` consecutive ones become their hash. What remains is the
group's root, and the groups' roots, in the order of the groups, are hashed likewise.

Rows get their places from a sort by ranges, which is written with its row numbers; the starts of parts and groups are
added by joins, so no task has a group. A group's tree is then cut into aligned blocks of `ARITY` ** `BLOCK` leaves. Blocks are hashed to
their roots, those are the leaves of the next tier, and so on: three tiers hold 10 ** 10 rows. Downwards each tier's
proofs are those of the tier above, appended to the proofs within blocks, which a fractal traversal (`Traversal`) emits leaf by leaf: for each layer
of subtrees it holds one that covers the leaf and one that is being built for when that one is used up, so it never has all nodes of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmine.llm.common import persist

ARITY = 8
#: Levels of a block, and of a subtree in it.
BLOCK = 4
LAYER = 2
PROOF = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above so many leaves."""
    found = 0
    while ARITY**found < leaves:
        found += 1
    return found


class _Subtree:
    """Levels `low` to `high` of the tree above leaves from `first` on, taken in one by one from the left."""

    def __init__(self, low: int, high: int, first: int):
        self.low, self.high, self.first = low, high, first
        self.levels: list[list[str]] = [[] for _ in range(high - low + 1)]
        self.pending: list[list[str]] = [[] for _ in range(low)]

    def take(self, leaf: str) -> None:
        """Adds a leaf; below `low` only runs that aren't full are held."""
        node = leaf
        for level in range(self.low):
            self.pending[level].append(node)
            if len(self.pending[level]) < ARITY:
                return
            node = digest(*self.pending[level])
            self.pending[level] = []
        self._put(0, node)

    def _put(self, level: int, node: str) -> None:
        while True:
            nodes = self.levels[level]
            nodes.append(node)
            if len(nodes) % ARITY or level + 1 == len(self.levels):
                return
            node = digest(*nodes[-ARITY:])
            level += 1

    def close(self) -> None:
        """There are no more leaves: unfinished runs become nodes."""
        for level in range(self.low):
            if self.pending[level]:
                node, self.pending[level] = digest(*self.pending[level]), []
                if level + 1 < self.low:
                    self.pending[level + 1].append(node)
                else:
                    self._put(0, node)
        for level in range(len(self.levels) - 1):
            if rest := self.levels[level][len(self.levels[level + 1]) * ARITY :]:
                self.levels[level + 1].append(digest(*rest))


class Traversal:
    """Successive authentication paths of a block whose tree has `top` levels above its leaves.

    `leaf(i)` gives leaf i, of `n`. Layer k has levels k * layer to (k + 1) * layer. Its existing subtree covers the current leaf;
    the desired one is the next to its right and takes in one leaf a step, so it is ready when the existing one is used up.
    """

    def __init__(self, leaf, n: int, top: int, layer: int = LAYER):
        self.leaf, self.n, self.top = leaf, n, top
        cuts = list(range(0, top, layer))
        self.layers = [(low, min(low + layer, top)) for low in cuts]
        self.existing = [self._built(low, high, 0) for low, high in self.layers]
        self.desired = [_Subtree(low, high, ARITY**high) for low, high in self.layers]

    def _built(self, low: int, high: int, first: int) -> _Subtree:
        tree = _Subtree(low, high, first)
        for i in range(first, min(self.n, first + ARITY**high)):
            tree.take(self.leaf(i))
        tree.close()
        return tree

    @property
    def root(self) -> str:
        return self.existing[-1].levels[-1][0] if self.layers else self.leaf(0)

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf its siblings to the left and to the right, level by level, each side concatenated."""
        for i in range(self.n):
            path = []
            for (low, high), tree in zip(self.layers, self.existing):
                for level in range(low, high):
                    at = i // ARITY**level - tree.first // ARITY**level
                    nodes = tree.levels[level - low]
                    run = at - at % ARITY
                    path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
            yield path
            for k, (low, high) in enumerate(self.layers):
                width, ahead = ARITY**high, self.desired[k]
                at = ahead.first + i % width
                if at < self.n:
                    ahead.take(self.leaf(at))
                if (i + 1) % width == 0 and i + 1 < self.n:
                    ahead.close()
                    self.existing[k], self.desired[k] = ahead, _Subtree(low, high, ahead.first + width)


def placed(rows: DataFrame, group: list[Column], order: list[Column], name: str) -> DataFrame:
    """rows, written, with `tree` (one number for all of a group, in the order of the groups), `n` (rows of the group) and `pos` (place in it).

    Rows are sorted by ranges of (group, order), so equal groups follow each other; only counts of a part or a group are joined to them.
    """
    named = [c.alias(f"__g{i}") for i, c in enumerate(group)]
    keys = [f"__g{i}" for i in range(len(group))]
    laid = rows.select("*", *named).repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys), *order)
    laid = laid.sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys), *order).withColumn("__id", F.monotonically_increasing_id())
    laid = persist(laid, name).withColumn("__part", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND((1 << 33) - 1))
    # One row for each part and group: as many as there are of both together.
    runs = persist(laid.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__rows"), F.min("__row").alias("__first")), f"{name}-runs")
    sizes = runs.groupBy("__part").agg(F.sum("__rows").alias("__size"))
    starts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"))
    runs = runs.join(starts, "__part").withColumn("__at", F.col("__start") + F.col("__first"))
    whole = runs.groupBy(*(F.col(k).alias(f"{k}w") for k in keys)).agg(F.min("__at").alias("tree"), F.sum("__rows").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}w")) for k in keys]
    runs = runs.join(whole, same).select(F.col("__part").alias("__p"), *(F.col(k).alias(f"{k}r") for k in keys), "__start", "tree", "n")
    runs = persist(runs, f"{name}-starts")
    match = [F.col("__part") == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys)]
    out = laid.join(runs, match).withColumn("pos", F.col("__start") + F.col("__row") - F.col("tree"))
    return out.select(*rows.columns, "tree", "n", "pos")


def _block_height(n: int, block: int) -> int:
    """Levels of the blocks of a tree with n leaves: all of them where it is one block."""
    return min(height(n), block)


def _roots(levels: int):
    def run(part: pa.Table) -> pa.Table:
        n, block = part.column("n")[0].as_py(), part.column("pos")[0].as_py() // ARITY**levels
        held = _Subtree(0, _block_height(n, levels), 0)
        for leaf in part.sort_by("pos").column("node").to_pylist():
            held.take(leaf)
        held.close()
        above = -(-n // ARITY**levels)
        return pa.table({"tree": part.column("tree")[:1], "n": pa.array([above], pa.int64()), "pos": pa.array([block], pa.int64()), "node": [held.levels[-1][0]]})

    return run


def _proofs(keep: list[str], levels: int):
    def run(part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        leaves = part.column("node").to_pylist()
        n = part.column("n")[0].as_py()
        upper = above.column("proof")[0].as_py()
        upper = [(x["left"], x["right"]) for x in upper]
        top = _block_height(n, levels)
        left, right, ends = [], [], [0]
        for path in Traversal(leaves.__getitem__, len(leaves), top).paths():
            for a, b in (*path, *upper):
                left.append(a)
                right.append(b)
            ends.append(len(left))
        sides = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)
        own = pa.array([above.column("top")[0].as_py()] * len(leaves), pa.string())
        return pa.table([*(part.column(c).combine_chunks() for c in keep), own, proof], names=[*keep, "top", "proof"])

    return run


def _block(levels: int) -> Column:
    return F.shiftright("pos", 3 * levels)


def tier_up(nodes: DataFrame, name: str, levels: int = BLOCK) -> list[DataFrame]:
    """nodes (tree, n, pos, node), the roots of their blocks, the roots of blocks of those, and so on until each tree has one."""
    tiers = [nodes]
    while True:
        below = tiers[-1].select("tree", "n", "pos", "node")
        above = persist(below.groupBy("tree", _block(levels).alias("__block")).applyInArrow(_roots(levels), "tree long, n long, pos long, node string"), f"{name}-tier")
        tiers.append(above)
        if (above.agg(F.max("n")).first()[0] or 1) == 1:
            return tiers


def tier_down(tiers: list[DataFrame], top: DataFrame, keep: list[str], levels: int = BLOCK) -> DataFrame:
    """The columns `keep` of the lowest tier with top and the whole proof. top: tree, pos (0), the tree's root (top), and the proof of it."""
    found = top
    for k in range(len(tiers) - 2, -1, -1):
        kept = keep if k == 0 else ["tree", "pos"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiers[k].select(*kept).schema)
        below = tiers[k].select(*dict.fromkeys([*kept, "tree", "n", "pos", "node"]), _block(levels).alias("__block"))
        above = found.select(F.col("tree").alias("__tree"), F.col("pos").alias("__up"), "top", "proof")
        found = below.groupBy("tree", "__block").cogroup(above.groupBy("__tree", "__up")).applyInArrow(_proofs(kept, levels), f"{fields}, top string, proof {PROOF}")
    return found


def manifest(rows: DataFrame, group: Column, order: list[Column], node: Column, name: str = "merkle", levels: int = BLOCK) -> DataFrame:
    """rows with node, subroot (its group's root), root (of all) and proof: for each level up to the root the siblings on the left and on the right, each concatenated.

    group: rows of one tree, null being a group of its own that comes first. order: of the leaves; rows that tie must be alike. Repeated rows are leaves of
    their own. Columns named node, tree, n, pos, subroot, root, top or proof are replaced. An empty table has no rows.
    levels: of a block; a task holds the leaves of one block.
    """
    made = ("node", "tree", "n", "pos", "subroot", "root", "proof", "top")
    keep = [c for c in rows.columns if c.lower() not in made]
    leaves = placed(rows.select(*keep, node.alias("node")), [group], order, name)
    leaves = persist(leaves, f"{name}-leaves")
    tiers = tier_up(leaves, name, levels)
    roots = placed(tiers[-1].select(F.col("tree").alias("__of"), "node"), [F.lit(0)], [F.col("__of")], f"{name}-groups")
    upper = tier_up(persist(roots, f"{name}-roots"), f"{name}-groups", levels)
    summit = upper[-1].select("tree", "pos", F.col("node").alias("top"), F.array().cast(PROOF).alias("proof"))
    heads = tier_down(upper, summit, ["__of", "node"], levels)
    heads = persist(heads.select(F.col("__of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.to_json(F.struct("node", "top")).alias("top"), "proof"), f"{name}-heads")
    out = tier_down(tiers, heads, [*keep, "node"], levels)
    roots_of = F.from_json("top", "node string, top string")
    return out.select(*keep, "node", roots_of["node"].alias("subroot"), roots_of["top"].alias("root"), "proof")


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its proof lead to."""
    return F.aggregate(proof, node, lambda held, side: F.sha2(F.concat(side["left"], held, side["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The sha256 of all siblings of a proof, from the lowest level up."""
    return F.sha2(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def leaf(*columns: Column) -> Column:
    """The sha256 of columns: each its length in bytes, a colon and its text, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)
