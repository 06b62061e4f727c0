"""Manifest of a dataset: a hash tree over all rows, with the siblings that prove each row.

Every group is a tree of runs of three nodes, and the groups' roots are the leaves of one more tree. Levels are windows: nodes
are partitioned by group and parent, and the ordered list of a run over its full frame gives both what the parent hashes
and each node's siblings. One row a run goes on to the next level. Proofs are put together from the top down, where
every level is a third of the one below it, so that all joins together meet half as many rows again as there are leaves.
Texts are hashed where they lie; only digests are shuffled. Places of leaves come from a range sort and the parts' counts,
so that a group that holds most rows is sorted and numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import join_small, materialise

FANOUT = 3
#: Row columns of `documents`, in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(values: Sequence[Column]) -> Column:
    """sha256 of all values, each with its length in bytes, or as `-` where it is null."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*each), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds idx, a row's place in its group by `order` (from 0), and n, the rows of the group. Repeats of a row take places of their own.

    Rows are sorted by range and written with their number in their part. A part's first number and the rows of the group in
    earlier parts turn that into the place; the table of these has a row for each part and group that meet.
    """
    parted = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("number", F.monotonically_increasing_id())
    parted = materialise(parted.withColumn("part", F.shiftright("number", 33)), "numbered")
    counts = parted.groupBy(group, "part").agg(F.min("number").alias("low"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("low")).alias("offset"), F.sum("rows").over(whole).alias("n"))
    offsets = materialise(offsets.select(F.struct(group, "part").alias("at"), "offset", "n"), "offsets")
    met = join_small(parted.withColumn("at", F.struct(group, "part")), offsets, "at")
    return met.withColumn("idx", F.col("number") + F.col("offset")).drop("at", "number", "part", "offset")


def _runs(nodes: DataFrame) -> DataFrame:
    """Adds to nodes (grp, idx, n, hash) parent, up (the parent's hash) and side: what the parent hashes before and after the node."""
    run = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = (F.col("idx") % FANOUT).cast("int")
    listed = nodes.withColumn("parent", F.floor(F.col("idx") / FANOUT)).withColumn("run", F.collect_list("hash").over(run))
    before, after = F.slice("run", F.lit(1), own), F.slice("run", own + 2, F.lit(FANOUT))
    return listed.select(*nodes.columns, "parent", F.sha2(F.array_join("run", ""), 256).alias("up"), F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right")).alias("side"))


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, idx from 0, n nodes of the group, hash, more columns): (roots, proofs).

    roots: (grp, hash) of every group. proofs: nodes with `proof`, the sides on the way from the node to its group's root.
    The levels' number follows from the largest group.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, level, done = [], nodes, []
    while True:
        done.append(level.filter("n = 1").select("grp", "hash"))
        if most <= 1:
            break
        levels.append(materialise(_runs(level.filter("n > 1")), "level"))
        # one row a run: the first
        level = levels[-1].filter(F.col("idx") % FANOUT == 0).select("grp", F.col("parent").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), F.col("up").alias("hash"))
        most = -(-most // FANOUT)
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = None
    for k, lower in reversed(list(enumerate(levels))):
        own = lower if k == 0 else lower.select("grp", "idx", "parent", "side")
        if above is not None:
            own = own.join(above, ["grp", "parent"], "left")
        own = own.withColumn("proof", F.concat(F.array("side"), F.coalesce("higher", none) if above is not None else none))
        above = own if k == 0 else own.select("grp", F.col("idx").alias("parent"), F.col("proof").alias("higher"))
    alone = nodes.filter("n = 1").withColumn("proof", none)
    return roots, alone.unionByName(above.select(*alone.columns)) if levels else alone


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its sides lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """sha256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", more: Sequence[Column] = ()) -> DataFrame:
    """Per row: doc_id, the columns of `more` (computed on docs), leaf, subroot (its group's), root, and proof: sides (left, right) from the leaf to the root.

    Leaves of a group ascend by id, rows of equal id by their hash; while a group has several nodes, every FANOUT
    consecutive ones, or those left, become the hash of their digests. The groups' roots, in byte order with null first,
    become the root likewise. A group of one row has its leaf as its root. Nulls are values of their own (`-`), so texts may
    be null or empty; a null id comes first. Repeated rows are leaves of their own. Fields that docs doesn't have are an
    error, other columns are not read. An empty table gives an empty result.
    """
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("grp"), leaf_hash([F.col(f) for f in fields]).alias("hash"), *more)
    # the number keeps copies of one row apart, so that they need not meet in one part
    leaves = materialise(hashed.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    roots, proofs = tree(numbered(leaves, "grp", ["doc_id", "hash", "tie"]).drop("tie"))
    groups = numbered(materialise(roots, "roots").withColumn("all", F.lit(0)), "all", ["grp"]).select(F.col("all").alias("grp"), "idx", "n", "hash", F.col("grp").alias("name"))
    top, ways = tree(materialise(groups, "groups"))
    root = top.select("hash").first()
    ways = materialise(ways.select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), F.lit(root and root["hash"]).alias("root"), F.col("proof").alias("way")), "ways")
    met = join_small(proofs, ways, "grp")
    others = [c for c in hashed.columns if c not in ("doc_id", "grp", "hash")]
    return met.select("doc_id", *others, F.col("hash").alias("leaf"), "subroot", "root", F.concat("proof", "way").alias("proof"))


def verify(docs: DataFrame, changed: dict[str, Column], **options: object) -> DataFrame:
    """manifest() of docs, with folded_root, the root that each row leads to after the columns in `changed` are replaced, and verified: whether that is the root."""
    fields = options.get("fields", FIELDS)
    found = manifest(docs, more=[leaf_hash([changed.get(f, F.col(f)) for f in fields]).alias("leaf_now")], **options)
    return found.withColumn("folded_root", folded(F.col("leaf_now"), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root")).drop("leaf_now")
