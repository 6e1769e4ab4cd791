"""Interval algebra over half-open [start, end) columns.

Everything works on intervals, never on exploded positions.  Joins by overlap get an equi-key, the bin
of a coordinate, so they shuffle like any join; sweeps run bin by bin, so one sequence doesn't
end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins of overlap joins and of sweeps.
JOIN_BIN, SWEEP_BIN = 1024, 65536


def nonempty(iv: DataFrame) -> DataFrame:
    return iv.where("end > start")


def length(start: Column, end: Column) -> Column:
    """Length of a region, 0 if it is empty or inverted."""
    return F.greatest(end - start, F.lit(0)).cast("long")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return length(F.greatest(a_start, b_start), F.least(a_end, b_end))


def bin_of(pos: str, width: int) -> Column:
    """The bin of a position; negative ones have bins of their own."""
    return F.expr(f"({pos} - pmod({pos}, {width})) div {width}")


def binned(iv: DataFrame, width: int, clip: bool = False) -> DataFrame:
    """A row per bin that an interval touches; ``clip`` cuts it to the bin."""
    out = nonempty(iv).withColumn("bin", F.explode(F.sequence(bin_of("start", width), bin_of("(end - 1)", width))))
    if clip:
        out = out.withColumn("start", F.greatest("start", F.col("bin") * width)).withColumn("end", F.least("end", (F.col("bin") + 1) * width))
    return out


def _islands(iv: DataFrame, keys: list[str], reach: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before + reach), 1).otherwise(0)
    return iv.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Positions of a bin in which intervals are joined by one task.
MERGE_BIN = 1 << 20


def _stitched(pieces: DataFrame, keys: list[str], reach: int, width: int) -> DataFrame:
    """Joins disjoint pieces (keys, bin, start, end), cut at the borders of bins wider than ``reach``, across these
    borders.  Only pieces within reach of a border, two for each bin, meet in a task for their key."""
    border = (F.col("start") - reach <= F.col("bin") * width) | (F.col("end") + reach >= (F.col("bin") + 1) * width)
    over = _islands(pieces.where(border), keys, reach, ["start"]).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return pieces.where(~border).select(*keys, "start", "end").unionByName(over.select(*keys, "start", "end"))


def merge(iv: DataFrame, keys: list[str], reach: int = 0) -> DataFrame:
    """Joins intervals that overlap or touch, or are at most ``reach`` apart: within bins first, so a task holds a bin
    and never a whole sequence, then across the borders of bins."""
    width = max(MERGE_BIN, 2 * reach)
    pieces = _islands(binned(iv.select(*keys, "start", "end"), width, clip=True), [*keys, "bin"], reach, ["start", "end"])
    pieces = pieces.groupBy(*keys, "bin", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return _stitched(pieces, keys, reach, width)


def closed(iv: DataFrame, keys: list[str]) -> DataFrame:
    """The intervals with their ends inside, joined where they overlap or touch then: a point lies in one at most."""
    return merge(iv.withColumn("end", F.col("end") + 1), keys)


def regions(points: DataFrame, keys: list[str], max_gap: int = 0) -> DataFrame:
    """Positions to regions: a position joins the region before it if pos <= end + max_gap."""
    return merge(points.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct(), keys, max_gap)


def depth_gaps(depth: DataFrame, keys: list[str], min_depth: int) -> DataFrame:
    """Maximal runs of positions whose depth is under the minimum."""
    return regions(depth.where(F.col("depth") < min_depth), keys)


def complement(iv: DataFrame, keys: list[str], length_col: DataFrame) -> DataFrame:
    """What the intervals leave of [0, length); ``length_col`` has (keys, length).  No interval leaves all.

    The next interval is looked up within its bin; a row for each bin carries the last end on to the next bin that has an
    interval."""
    merged = merge(iv, keys).withColumn("bin", bin_of("start", MERGE_BIN))
    inside = merged.select(*keys, F.col("end").alias("a"), F.lead("start").over(Window.partitionBy(*keys, "bin").orderBy("start")).alias("b")).where("b IS NOT NULL")
    bins = merged.groupBy(*keys, "bin").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    w = Window.partitionBy(*keys).orderBy("bin")
    steps = bins.withColumn("_next", F.lead("first").over(w)).withColumn("_head", F.lag("bin").over(w).isNull())
    on = length_col.select(*keys, F.col("length").cast("long").alias("length"))
    head = F.when(F.coalesce("_head", F.lit(True)), F.struct(F.lit(0).cast("long").alias("a"), F.coalesce("first", "length").alias("b")))
    tail = F.when(F.col("last").isNotNull(), F.struct(F.col("last").alias("a"), F.coalesce("_next", "length").alias("b")))
    same = keys or F.lit(True)  # without keys there is one length
    between = on.join(steps, same, "left").select(*keys, "length", F.inline(F.array_compact(F.array(head, tail))))
    rest = on.join(inside, same).select(*keys, "length", "a", "b").unionByName(between)
    return rest.select(*keys, F.greatest("a", F.lit(0)).cast("long").alias("start"), F.least("b", "length").alias("end")).where("end > start")


def sweep(iv: DataFrame, keys: list[str], width: int = SWEEP_BIN, weight: str = "1L") -> DataFrame:
    """(keys, start, end, k): segments covered by k intervals, k > 0, cut at bin borders; with a ``weight`` k sums it.

    Merge the intervals of a sample first, and k counts samples."""
    b = binned(iv.select(*keys, "start", "end", F.expr(weight).alias("w")), width, clip=True)
    events = b.select(*keys, "bin", F.explode(F.expr("array(struct(start AS pos, w AS d), struct(end AS pos, -w AS d))")).alias("e"))
    steps = events.groupBy(*keys, "bin", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys, "bin").orderBy("pos")
    seg = steps.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("k"))
    return seg.where("k > 0 AND end > start")


def level_runs(segments: DataFrame, keys: list[str], levels: list[int], width: int = SWEEP_BIN) -> DataFrame:
    """(keys, level, start, end): for each level, the maximal runs of ``segments`` (keys, start, end, k; as from ``sweep``) with k
    at least that level.

    The runs of a higher level lie in those of a lower one, so all come from one pass: a segment begins the runs of the
    levels above the k of the segment that it touches, and ends those above the k of the next."""
    seg = segments.withColumn("bin", bin_of("start", width))
    w = Window.partitionBy(*keys, "bin").orderBy("start")
    before = F.when(F.lag("end").over(w) == F.col("start"), F.lag("k").over(w)).otherwise(0)
    after = F.when(F.lead("start").over(w) == F.col("end"), F.lead("k").over(w)).otherwise(0)
    seg = seg.withColumn("_before", before).withColumn("_after", after)
    all_levels = F.array(*[F.lit(x).cast("long") for x in sorted(set(levels))])
    edges = lambda least, pos: F.transform(F.filter(all_levels, lambda x: (x > F.col(least)) & (x <= F.col("k"))), lambda x: F.struct(x.alias("level"), F.col(pos).alias("pos")))
    at = seg.select(*keys, "bin", F.inline(F.concat(edges("_before", "start"), edges("_after", "end"))))
    # Within a bin and level, beginnings and ends take turns.
    turn = Window.partitionBy(*keys, "bin", "level").orderBy("pos")
    runs = at.select(*keys, "bin", "level", F.col("pos").alias("start"), F.lead("pos").over(turn).alias("end"), F.row_number().over(turn).alias("_r")).where("_r % 2 = 1")
    return _stitched(runs.drop("_r"), [*keys, "level"], 0, width)


def locate(points: DataFrame, iv: DataFrame, keys: list[str], columns: list[str], width: int = JOIN_BIN, inclusive: bool = False) -> DataFrame:
    """Left join of points to the intervals that contain them: ``columns`` of the interval or nulls.
    ``inclusive`` counts the end as inside.  Disjoint intervals give a row per point."""
    right = iv.withColumn("end", F.col("end") + 1) if inclusive else iv
    right = binned(right, width).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bin").alias("_bin"), F.col("start").alias("_s"), F.col("end").alias("_e"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    on = (bin_of("pos", width) == F.col("_bin")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    out = points.join(right, on, "left")
    return out.select(*[points[c] for c in points.columns], F.col("_s").isNotNull().alias("inside"), *[F.col(f"_v_{c}").alias(c) for c in columns])


def pair_overlaps(iv: DataFrame, keys: list[str], item: str, width: int = JOIN_BIN) -> DataFrame:
    """(keys, a, b, shared): overlap length of each pair a < b of items that overlap.  Intervals are
    cut to their bins, so nothing counts twice.  Merge them per item first."""
    b = binned(iv.select(*keys, item, "start", "end"), width, clip=True)
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(item).alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("bin").alias("_bin"))
    on = (F.col("bin") == F.col("_bin")) & (F.col(item) < F.col("b")) & (F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return b.join(other, on).groupBy(*keys, F.col(item).alias("a"), "b").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))).alias("shared"))


def overlapping(left: DataFrame, right: DataFrame, columns: list[str], width: int = JOIN_BIN) -> DataFrame:
    """Inner join by overlap: all of left, and ``columns`` of right with its (r_start, r_end)."""
    lb = binned(left, width)
    rb = binned(right, width).select(F.col("bin").alias("_bin"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), *columns)
    on = (F.col("bin") == F.col("_bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    # A pair meets in every bin both touch; it counts in the first of them.
    first = bin_of("greatest(start, r_start)", width) == F.col("bin")
    return lb.join(rb, on & first).drop("bin", "_bin")


def offsets(contigs: DataFrame) -> DataFrame:
    """Contigs with ``offset``: their place in the concatenation in the order of contig_idx."""
    w = Window.partitionBy("sample").orderBy("contig_idx").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def density(iv: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, bin, bases, touches): bases of the intervals and number of them in each bin of a width."""
    b = binned(iv.select(*keys, "start", "end"), width, clip=True)
    return b.groupBy(*keys, "bin").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.count(F.lit(1)).alias("touches"))
