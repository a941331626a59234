"""Site hold-out, exact stratified split and folds, all keyed by a hash of the row id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import is_in

TRAIN_SHARE = (4, 5)


@dataclass(frozen=True)
class HoldOut:
    """Sites kept apart as the external set."""

    column: str
    sites: Sequence[str]


def hash_key(row_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(row_id).cast("string")))


def hash_cuts(df: DataFrame, label: str, row_id: str, seed: str, shares: Sequence[tuple[int, int]]) -> DataFrame:
    """Per class, the hash positions below which exactly ceil(share * n) of its rows lie.

    Rows are counted per class and leading four hex digits, then inside the slot that holds a cut by
    the next four: only one in 2^32 of the rows is ranked.  The result is one row per class.
    """
    keyed = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("__class"), F.col(row_id).alias("__id"), hash_key(row_id, seed).alias("__hash")
    )
    keyed = keyed.withColumn("__slot", F.conv(F.substring("__hash", 1, 4), 16, 10).cast("int"))
    slots = keyed.groupBy("__class", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    of_class = Window.partitionBy("__class")
    slots = slots.withColumn("__total", F.sum("__n").over(of_class)).withColumn(
        "__upto", F.sum("__n").over(of_class.orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0))
    )
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("cut"), F.expr(f"(__total * {num} + {den - 1}) div {den}").alias("target"))
            for i, (num, den) in enumerate(shares)
        ]
    )
    before = F.col("__upto") - F.col("__n")
    hit = (
        slots.select("*", F.inline(targets))
        .where((before < F.col("target")) & (F.col("target") <= F.col("__upto")))
        .select("__class", "__slot", "cut", (F.col("target") - before).alias("__need"))
    )
    # At most one row per class and share.
    near = keyed.join(F.broadcast(hit), ["__class", "__slot"]).withColumn(
        "__part", F.conv(F.substring("__hash", 5, 4), 16, 10).cast("int")
    )
    parts = near.groupBy("__class", "cut", "__need", "__part").agg(F.count(F.lit(1)).alias("__n"))
    of_cut = Window.partitionBy("__class", "cut").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__upto", F.sum("__n").over(of_cut))
    inside = parts.where((F.col("__upto") - F.col("__n") < F.col("__need")) & (F.col("__need") <= F.col("__upto")))
    # Again one row per class and share.
    inside = inside.select("__class", "cut", "__part", (F.col("__upto") - F.col("__n")).alias("__before"))
    ranked = near.join(F.broadcast(inside), ["__class", "cut", "__part"]).withColumn(
        "__rank",
        F.row_number().over(Window.partitionBy("__class", "cut").orderBy("__hash", "__id")) + F.col("__before"),
    )
    at_cut = ranked.where("__rank = __need")
    return at_cut.groupBy("__class").agg(
        F.map_from_entries(F.collect_list(F.struct("cut", F.struct("__hash", "__id")))).alias("__cuts")
    )


def cuts_passed(df: DataFrame, cuts: DataFrame, label: str, row_id: str, seed: str, shares: int, name: str):
    """Add ``name``: how many of its class's cuts lie below a row, NULL for a missing label."""
    joined = df.join(F.broadcast(cuts), F.col(label) == F.col("__class"), "left").withColumn(
        "__position", F.struct(hash_key(row_id, seed).alias("__hash"), F.col(row_id).alias("__id"))
    )
    passed = F.lit(0)
    for i in range(shares):
        passed = passed + (F.col("__position") > F.try_element_at("__cuts", F.lit(i))).cast("int")
    return joined.withColumn(name, passed).drop("__class", "__cuts", "__position")


def stratified_split(
    df: DataFrame, label: str, row_id: str, seed: str, share: tuple[int, int] = TRAIN_SHARE
) -> DataFrame:
    """Add ``split``: exactly ceil(share * n) rows of each class are 'train', the rest 'test'."""
    cuts = hash_cuts(df, label, row_id, seed, [share])
    passed = cuts_passed(df, cuts, label, row_id, seed, 1, "__passed")
    return passed.withColumn("split", F.when(F.col("__passed") == 0, "train").otherwise("test")).drop("__passed")


def assign_split(
    df: DataFrame, label: str, row_id: str, seed: str, hold_out: HoldOut, share: tuple[int, int] = TRAIN_SHARE
) -> DataFrame:
    """Add ``split``: 'external' for held-out sites, else the stratified 'train' / 'test'.

    Rows without a site belong to neither side and are left out; ``unassigned_rows`` counts them.
    """
    sited = df.where(F.col(hold_out.column).isNotNull())
    external = is_in(F.col(hold_out.column), hold_out.sites)
    cuts = hash_cuts(sited.where(~external), label, row_id, seed, [share])
    passed = cuts_passed(sited, cuts, label, row_id, seed, 1, "__passed")
    split = F.when(external, "external").when(F.col("__passed") == 0, "train").otherwise("test")
    return passed.withColumn("split", split).drop("__passed")


def unassigned_rows(df: DataFrame, site: str) -> DataFrame:
    return df.agg(F.count_if(F.col(site).isNull()).alias("rows_without_site"))


def stratified_folds(df: DataFrame, label: str, row_id: str, seed: str, folds: int, name: str = "fold") -> DataFrame:
    """Add ``name`` in 0..folds-1 with class counts equal to within one row across folds."""
    shares = [(i, folds) for i in range(1, folds)]
    return cuts_passed(df, hash_cuts(df, label, row_id, seed, shares), label, row_id, seed, folds - 1, name)


def site_split_counts(df: DataFrame, hold_out: HoldOut) -> DataFrame:
    """Rows held out, kept and without a site."""
    site = F.col(hold_out.column)
    part = F.when(site.isNull(), "no site").when(is_in(site, hold_out.sites), "external").otherwise("internal")
    return df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
