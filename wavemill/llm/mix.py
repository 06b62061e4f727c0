"""Mixing sources to target weights by entropy balancing.

Rates r_d minimise sum of size_d * (r_d log r_d - r_d + 1) under the token constraints sum of size_d * r_d = target of
every group. The dual is convex and its optimum is an exponential tilt, r_d = exp(sum of the multipliers of d's groups).
Documents of equal groups share a tilt, so each Newton iteration aggregates a table of cells (combinations of groups),
not documents. Rates then become whole copies: in bounded slices of a group, sorted by size, the rounding error is carried
from document to document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm.common import join_small, materialise

#: No document is taken more often than this, and no target exceeds this many times its source.
MOST = 3
SLICE = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    """A key that is never null, in code-point order with null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("\U0010ffff"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """Of (name, source_size) the targets: sources in code-point order weigh `weights`, repeating, and share the whole size;
    a target stops at most times its source, and the excess is shared again by weight until none is above.

    That is the level L with sum of min(most * size, weight * L) = whole. Sources sorted by most * size / weight fill up in
    that order, so L shows at the first that doesn't. The table has a row a source; only it meets in one window.
    """
    order = Window.orderBy("name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    all_rows = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(all_rows) - before) / left
    found = ranked.withColumn("level", level)
    found = found.withColumn("level", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(all_rows))
    return found.select("name", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def balance(cells: DataFrame, margins: dict[str, DataFrame], tolerance: float = 1e-9, iterations: int = 60) -> DataFrame:
    """Adds `rate` to cells (group columns, tokens). margins: for each group column a table of (that column, target).

    Newton's steps on the dual, one margin at a time: its multipliers move by (target - mass) / mass, at most 1 up or down
    while far away, where mass = tokens * exp(multipliers). Stops when every constraint holds to tolerance; a sum and a maximum reach the
    driver each time. A target of 0 gives rate 0.
    """
    state = materialise(cells.withColumn("multiplier", F.lit(0.0)), "cells")
    for _ in range(iterations):
        worst = 0.0
        for column, targets in margins.items():
            mass = state.groupBy(column).agg(F.sum(F.col("tokens") * F.exp("multiplier")).alias("mass"))
            step = mass.join(targets.select(column, "target"), column).filter("mass > 0 and target > 0").withColumn("step", (F.col("target") - F.col("mass")) / F.col("mass"))
            step = materialise(step.select(column, "step"), "step")
            worst = max(worst, step.agg(F.max(F.abs("step"))).first()[0] or 0.0)
            moved = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("step"))), F.lit(0.0))
            state = materialise(join_small(state, step, column).withColumn("multiplier", F.col("multiplier") + moved).drop("step"), "cells")
        if worst <= tolerance:
            break
    else:
        raise RuntimeError(f"targets still missed by {worst} of their size after {iterations} rounds")
    for column, targets in margins.items():
        zero = targets.filter("target <= 0").select(column, F.lit(True).alias("none"))
        state = join_small(state, zero, column).withColumn("multiplier", F.when(F.col("none"), F.lit(float("-inf"))).otherwise(F.col("multiplier"))).drop("none")
    return state.withColumn("rate", F.exp("multiplier")).drop("multiplier")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size (words), source_size, target, copies and taken (copies * size).

    Null texts have size 0 and null sources are a source of their own, sorted last. A document of size 0 is taken as often
    as its rate rounds to, which adds no words. Repeated rows (equal doc_id, source and size) are rounded one by one, so
    that some may be taken once more than others. The same input gives the same result at any partitioning. An empty
    table gives an empty result.
    """
    done = _rated(docs, weights, most, id_col, text_col, source_col)
    # in two steps, so that no array grows with the repeats of a row
    each = done.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / SLICE))))
    first = F.col("part") * SLICE
    each = each.withColumn("row", F.explode(F.sequence(first + 1, F.least(first + SLICE, F.col("rows")))))
    each = each.withColumn("copies", F.col("low") + (F.col("row") <= F.col("more")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _rated(docs: DataFrame, weights: Sequence[float], most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per (doc_id, name, size), with rows: source_size, target, low (copies of every row) and more (how many rows get one more)."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), _name(F.col(source_col)).alias("name"), word_count(F.col(text_col).cast("string")).alias("size"))
    unit = materialise(sized.groupBy("doc_id", "name", "size").agg(F.count("*").alias("rows")), "sizes")
    sizes = materialise(unit.groupBy("name").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")), "sources")
    targets = materialise(source_targets(sizes, weights, most), "targets")
    cells = sizes.select("name", F.col("source_size").alias("tokens"))
    rates = balance(cells, {"name": targets.select("name", "target")}).select("name", "rate")
    source = materialise(sizes.join(targets.drop("source_size"), "name").join(rates, "name"), "rates")
    rated = join_small(unit, source, "name").withColumn("slice", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("units") / SLICE)))

    def carry(own: pa.Table) -> pa.Table:
        """Rounds one slice: largest documents first, each to the copies that bring the words taken nearest to the words due."""
        own = own.sort_by([("size", "descending"), ("doc_id", "ascending")])
        found, due = [], 0.0
        for size, rows, rate in zip(*(own.column(c).to_pylist() for c in ("size", "rows", "rate")), strict=True):
            low = min(int(rate), most)
            due += (rate - low) * size * rows
            more = min(rows, max(0, math.floor(due / size + 0.5))) if low < most and rate > low and size else 0
            due -= more * size
            found.append((low, more))
        for k, c in enumerate(("low", "more")):
            own = own.append_column(c, pa.array([x[k] for x in found], pa.int64()))
        return own

    extra = [T.StructField(c, T.LongType()) for c in ("low", "more")]
    return rated.groupBy("name", "slice").applyInArrow(carry, T.StructType([*rated.schema.fields, *extra]))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row repeated by its copies (none: it goes); the columns are those of docs. Of rows of equal doc_id, source and size, those of the smallest text hashes get one more copy."""
    rated = _rated(docs, weights, most, id_col, text_col, source_col)
    rated = materialise(rated.select(F.col("doc_id").alias("__id"), F.col("name").alias("__name"), F.col("size").alias("__size"), F.col("rows").alias("__rows"), F.col("low").alias("__low"), F.col("more").alias("__more")), "rated")
    own = docs.withColumn("__own_size", word_count(F.col(text_col).cast("string"))).withColumn("__own_name", _name(F.col(source_col)))
    met = own.join(rated, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own_name") == F.col("__name")) & (F.col("__own_size") == F.col("__size")))
    whole = met.filter("__more = 0 or __more = __rows").withColumn("__copies", F.col("__low") + (F.col("__more") > 0).cast("long"))
    order = Window.partitionBy("__id", "__name", "__size").orderBy(F.xxhash64(*docs.columns))
    parted = met.filter("__more > 0 and __more < __rows").withColumn("__copies", F.col("__low") + (F.row_number().over(order) <= F.col("__more")).cast("long"))
    out = whole.unionByName(parted).filter("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
