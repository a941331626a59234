"""Shards of bounded size by extendible hashing.

A row's shard is a prefix of its hash bits.  All rows start under the empty prefix; a prefix whose rows
exceed the byte limit splits on its next bit, the others stay.  Sizes are summed per cell (a prefix
somewhat longer than needed) and cells are what the directory is made of, so rows are read once for
the sums and once for their shard.  Only rows of cells that are still too large go another round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored, whole_text

BITS = 60


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", deeper: int = 4) -> DataFrame:
    """The id, ``n_bytes``, ``shard`` (bits), ``depth`` and ``shard_bytes`` of every row.

    The bits are the first 60 of the MD5 of id and text (a missing id is empty, a missing text too),
    so rows that share an id spread as well.  A shard has at most ``limit`` bytes unless its rows agree
    in all 60 bits: a single larger row, or equal rows, stay together at depth 60.  Other columns are
    ignored; an empty table gives no rows.
    """
    text = whole_text(text_col)
    name = F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit("|"), text)
    bits = F.lpad(F.bin(F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")), BITS, "0")
    rows = docs.select(col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), bits.alias("bits"))
    rows = stored(rows, "hashed")
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    done, above = 0, -1
    found = None
    step = min(BITS, max(deeper, math.ceil(math.log2(max(1, total / limit))) + 2))
    while True:
        at = min(BITS, done + step)
        cells = rows.groupBy(F.substring("bits", 1, at).alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"))
        # Every prefix of a cell beyond those already split.
        depths = F.explode(F.sequence(F.lit(above + 1), F.lit(at)))
        paths = cells.withColumn("depth", depths).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sizes = paths.groupBy("depth", "shard").agg(F.sum("cell_bytes").alias("shard_bytes"))
        fits = stored(sizes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)), "fits")
        parents = fits.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        leaves = fits.withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(parents, ["depth", "parent"], "left_anti")
        shallowest = leaves.agg(F.min("depth").alias("d")).first()["d"]
        if shallowest is not None:
            leaves = leaves.select("depth", "shard", "shard_bytes")
            owners = paths.where(F.col("depth") >= shallowest).select("cell", "depth", "shard").join(leaves, ["depth", "shard"])
            keyed = rows.withColumn("cell", F.substring("bits", 1, at))
            part = keyed.join(owners, "cell").select("id", "n_bytes", "shard", "depth", "shard_bytes")
            found = part if found is None else found.unionByName(part)
            open_cells = cells.join(owners.select("cell"), "cell", "left_anti")
        else:
            open_cells = cells
        if at == BITS or open_cells.isEmpty():
            break
        rows = stored(rows.withColumn("cell", F.substring("bits", 1, at)).join(open_cells.select("cell"), "cell", "left_semi").drop("cell"), "open")
        done = above = at
        step = 8
    if found is None:
        found = rows.select("id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    return found.withColumnRenamed("id", id_col)
