"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and the proof of every row.

Rows are ordered by (group, order, leaf) once: range partitions, sorted, written with a running number per partition.
Counts per partition and group give each leaf its place in its group's tree. Inner nodes are built level by level, every
``2 ** BITS`` consecutive nodes being hashed together, and written: a sixteenth of the leaves, and less above.

Proofs come from an octopus multiproof. A leaf partition is at most ``2 ** PART_BITS`` neighbouring leaves of the written
order. It needs the siblings on the ways of all its leaves; what it can derive from its own leaves is not fetched. Since
its leaves are neighbours, the missing coordinates of a level are the rest of the first and the last run of sixteen. Their
union over all groups in the partition, and over the tree of groups, is fetched by one join; the partition then derives
its inner nodes once and writes the proof of each leaf from them.

A proof is ``places`` (the place in its run, a number per level) and ``siblings`` (the run's other hashes joined, a string
per level), from the leaf over the group's root to the root. ``fold`` recomputes the root from a leaf and a proof with
built-in functions.

Defined results: null groups and null orders come first; rows of equal group and order are ordered by leaf, and equal
leaves are interchangeable; repeated rows are leaves each; a lone leaf is its group's root and a lone group's root the
root, with no level in the proof; all columns of the rows are kept in the struct ``row``, so no name can clash; an empty
table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import materialise, prepare

#: A node has up to 2 ** BITS children; ``levels`` counts hexadecimal digits, so this is fixed.
BITS = 4
RUN = 1 << BITS
#: Leaves in one leaf partition at most.
PART_BITS = 12
#: Rows equal in group, order and leaf are dealt out by so many salts, so that they can be cut.
SALTS = 1024
TOP = -1
HEX = 64

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def levels(n: Column) -> Column:
    """Levels above the leaves in a tree of n leaves."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(F.lit(0))


def wide(n: str, level: str) -> str:
    """Nodes at a level of a tree of n leaves."""
    return f"shiftright({n} - 1, {BITS} * {level}) + 1"


def parents(nodes: DataFrame, level: int) -> DataFrame:
    """The next level from (tree, pos, hash, n) at ``level``, of the trees that have several nodes there."""
    several = nodes.where(F.expr(wide("n", str(level))) > 1)
    run = F.array_sort(F.collect_list(F.struct("pos", "hash")))  # sixteen at most
    joined = F.array_join(F.transform(run, lambda x: x["hash"]), "")
    return several.groupBy("tree", F.shiftright("pos", BITS).alias("parent"), "n").agg(F.sha2(joined.cast("binary"), 256).alias("hash")).select(
        "tree", F.col("parent").alias("pos"), "hash", "n"
    )


def grow(leaves: DataFrame, most: int) -> list[DataFrame]:
    """All levels above the leaves of trees of at most ``most`` leaves, each written."""
    out, level = [], 0
    while most > 1:
        leaves = materialise(parents(leaves, level), "level")
        out.append(leaves.withColumn("level", F.lit(level + 1)))
        level, most = level + 1, (most + RUN - 1) // RUN
    return out


NODE = ["tree", "level", "pos", "hash"]


def place(rows: DataFrame, group: str, order: str, leaf: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(leaves, segments)``: (row, at, tree, pos, hash, n, first, last), and one row per range partition and group."""
    spark = prepare(rows.sparkSession)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    slim = rows.select(F.struct(*rows.columns).alias("row"), F.col(group).alias("g"), F.col(order).alias("o"), F.col(leaf).alias("hash"), salt)
    keys = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("hash"), F.col("salt")]
    ordered = slim.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("o", "salt")
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")

    # a row per range partition and group
    found = ordered.groupBy(F.shiftright("at", 33).alias("pid"), "g").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("last") - F.col("first") + 1
    found = materialise(found.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0))), "segments")
    groups = found.groupBy("g").agg(F.sum(size).alias("n"), F.min("first").alias("head"))
    # groups are numbered in order: by partitions first (a row each), then inside one
    heads = groups.groupBy(F.shiftright("head", 33).alias("p")).agg(F.count("*").alias("c"))
    heads = heads.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy(F.shiftright("head", 33)).orderBy("head")) - 1
    numbered = groups.withColumn("inside", inside).join(heads, F.shiftright("head", 33) == F.col("p"))
    numbered = numbered.select(F.col("g").alias("k"), "n", (F.col("earlier") + F.col("inside")).alias("tree"))
    segments = materialise(found.join(numbered, F.col("g").eqNullSafe(F.col("k"))).drop("k"), "segments")

    names = segments.select("pid", F.col("g").alias("k"), "tree", "n", "first", "last", "start")
    same = (F.shiftright("at", 33) == F.col("pid")) & F.col("g").eqNullSafe(F.col("k"))
    leaves = ordered.join(names, same).select("row", "at", "tree", (F.col("start") + F.col("at") - F.col("first")).alias("pos"), "hash", "n", "first", "last")
    return materialise(leaves, "leaves"), segments


def missing(pieces: DataFrame) -> DataFrame:
    """(part, tree, level, pos) of all nodes that a part needs but cannot derive, from its pieces (part, tree, lo, hi, n)."""
    per_level = pieces.where("n > 1").select("*", F.explode(F.sequence(F.lit(0), levels(F.col("n")) - 1)).alias("level"))
    at = lambda x: f"shiftright({x}, {BITS} * level)"
    per_level = per_level.select("part", "tree", "level", F.expr(at("lo")).alias("l"), F.expr(at("hi")).alias("h"), F.expr(wide("n", "level")).alias("w"))
    left = f"if(l % {RUN} > 0, sequence(l - l % {RUN}, l - 1), array())"
    end = f"least(h - h % {RUN} + {RUN - 1}, w - 1)"
    right = f"if(h < {end}, sequence(h + 1, {end}), array())"
    return per_level.select("part", "tree", "level", F.explode(F.expr(f"concat({left}, {right})")).alias("pos"))


PROOF = [("subroot", T.StringType()), ("root", T.StringType()), ("places", T.ArrayType(T.IntegerType())), ("siblings", T.ArrayType(T.StringType()))]


class Branch:
    """What a part knows of one tree: its own nodes lo..hi of each level and the fetched ones."""

    def __init__(self, own: list[str], lo: int, n: int, fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, str]] = []  # per level: the joined hashes of a run by its number
        self.tails: dict[int, tuple[list[int], list[str]]] = {}
        while n > 1:
            level, hi = len(self.runs), lo + len(own) - 1
            known = {lo + i: h for i, h in enumerate(own)}
            joined = {}
            for run in range(lo >> BITS, (hi >> BITS) + 1):
                places = range(run * RUN, min((run + 1) * RUN, n))
                joined[run] = "".join(known[x] if x in known else fetched[level, x] for x in places)
            self.runs.append(joined)
            own = [hashlib.sha256(x.encode()).hexdigest() for x in joined.values()]
            lo, n = lo >> BITS, (n + RUN - 1) >> BITS
        self.root = own[0]

    def step(self, level: int, pos: int) -> tuple[int, str]:
        whole, i = self.runs[level][pos >> BITS], pos % RUN
        return i, whole[: HEX * i] + whole[HEX * (i + 1) :]

    def proof(self, pos: int) -> tuple[list[int], list[str]]:
        """Places and siblings; what lies above the first level is shared by the leaves of a run."""
        if not self.runs:
            return [], []
        above = pos >> BITS
        if above not in self.tails:
            steps = [self.step(k, pos >> (BITS * k)) for k in range(1, len(self.runs))]
            self.tails[above] = [i for i, _ in steps], [s for _, s in steps]
        i, s = self.step(0, pos)
        return [i, *self.tails[above][0]], [s, *self.tails[above][1]]


def expand(leaves: pa.Table, known: pa.Table) -> pa.Table:
    """Proofs of a part's leaves from its pieces (level -1, pos is the first place) and its fetched nodes."""
    lo, n = {}, {}
    fetched: dict[int, dict[tuple[int, int], str]] = {}
    for tree, level, pos, node, size in zip(*(known[c].to_pylist() for c in ("tree", "level", "pos", "hash", "n")), strict=True):
        if level < 0:
            lo[tree], n[tree] = pos, size
        else:
            fetched.setdefault(tree, {})[level, pos] = node
    leaves = leaves.sort_by([("tree", "ascending"), ("pos", "ascending")])
    trees, hashes = leaves["tree"].to_pylist(), leaves["hash"].to_pylist()
    own: dict[int, list[str]] = {}
    for tree, h in zip(trees, hashes, strict=True):
        own.setdefault(tree, []).append(h)
    branches = {tree: Branch(nodes, lo[tree], n[tree], fetched.get(tree, {})) for tree, nodes in own.items()}
    top = Branch([b.root for b in branches.values()], lo[TOP], n[TOP], fetched.get(TOP, {}))
    places, siblings = [], []
    upper = {tree: top.proof(tree) for tree in branches}
    for tree, pos in zip(trees, leaves["pos"].to_pylist(), strict=True):
        p, s = branches[tree].proof(pos)
        places.append(p + upper[tree][0])
        siblings.append(s + upper[tree][1])
    new = [pa.array([branches[t].root for t in trees], pa.string()), pa.array([top.root] * len(trees), pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.string()))]
    return pa.Table.from_arrays([leaves["row"], *new], ["row", *(k for k, _ in PROOF)])


def prove(rows: DataFrame, group: str, order: str, leaf: str, partitions: int | None = None, part_bits: int = PART_BITS) -> DataFrame:
    """(row, subroot, root, places, siblings) for every row; ``row`` is a struct of all its columns."""
    leaves, segments = place(rows, group, order, leaf, partitions)
    schema = T.StructType([leaves.schema["row"], *(T.StructField(k, t) for k, t in PROOF)])
    most, trees = segments.agg(F.max("n"), F.max("tree")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema)
    inner = [x.select(*NODE) for x in grow(leaves.select("tree", "pos", "hash", "n"), most)]
    sizes = segments.select(F.col("tree").alias("t"), "n").distinct()
    lone = leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "pos", "hash")
    all_inner = reduce(DataFrame.unionByName, [lone, *inner])
    # the last node of each tree
    roots = all_inner.where("pos = 0").join(sizes, (F.col("tree") == F.col("t")) & (F.col("level") == levels(F.col("n"))))
    roots = materialise(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash", F.lit(trees + 1).cast("long").alias("n")), "subroots")
    upper = [x.select(*NODE) for x in grow(roots, trees + 1)]

    first = F.greatest(F.col("first"), F.shiftleft("part", part_bits))
    last = F.least(F.col("last"), F.shiftleft("part", part_bits) + ((1 << part_bits) - 1))
    parts = F.explode(F.sequence(F.shiftright("first", part_bits), F.shiftright("last", part_bits)))
    pieces = segments.select("*", parts.alias("part")).select(
        "part", "tree", (F.col("start") + first - F.col("first")).alias("lo"), (F.col("start") + last - F.col("first")).alias("hi"), "n"
    )
    over = pieces.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("part", F.lit(TOP).cast("long").alias("tree"), "lo", "hi", F.lit(trees + 1).cast("long").alias("n"))
    pieces = materialise(pieces.unionByName(over), "pieces")

    # leaves are fetched only from the ends of a neighbouring piece
    part = F.shiftright("at", part_bits)
    near = (F.col("at") - F.greatest("first", F.shiftleft(part, part_bits)) < RUN) | (F.least(F.col("last"), F.shiftleft(part, part_bits) + ((1 << part_bits) - 1)) - F.col("at") < RUN)
    ends = leaves.where(near & (F.col("n") > 1)).select("tree", F.lit(0).alias("level"), "pos", "hash")
    nodes = reduce(DataFrame.unionByName, [ends, *inner, roots.select("tree", F.lit(0).alias("level"), "pos", "hash"), *upper])
    wanted = missing(pieces)
    fetched = wanted.join(nodes, ["tree", "level", "pos"]).select("part", "tree", "level", "pos", "hash", F.lit(None).cast("long").alias("n"))
    own = pieces.select("part", "tree", F.lit(-1).alias("level"), F.col("lo").alias("pos"), F.lit(None).cast("string").alias("hash"), "n")
    known = own.unionByName(fetched)
    held = leaves.select(part.alias("part"), "row", "tree", "pos", "hash")
    return held.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(expand, schema)


def fold(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def step(acc: Column, x: Column) -> Column:
        cut = x["places"] * HEX
        return digest(F.substring(x["siblings"], F.lit(1), cut), acc, F.substring(x["siblings"], cut + 1, F.lit(HEX * RUN)))

    return F.aggregate(F.arrays_zip(places.alias("places"), siblings.alias("siblings")), leaf, step)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, SMALL)
