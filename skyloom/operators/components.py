"""Connected components: of cells of images, tile by tile, and of links by label passing for any graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.sources.shared import discard, saved

#: Side of a tile; a task holds the cells of one at a time.
TILE = 256


def merge_labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to ``count`` - 1 linked by pairs (a, b): the smallest node of each one's component."""
    label = np.arange(count)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])  # the larger root is hung below the smaller one
        while (label[label] != label).any():
            label = label[label]
    return label


def grid_labels(tile: np.ndarray, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
    """For cells of square tiles (numbers of tiles, places within them): the place in these arrays of the first cell, by
    tile, y and x, of the same 4-neighbour component of the tile."""
    key = (tile * side + y) * side + x
    known, first, of = np.unique(key, return_index=True, return_inverse=True)
    pairs = []
    for step, room in ((1, known % side < side - 1), (side, known // side % side < side - 1)):
        at = np.minimum(np.searchsorted(known, known + step), len(known) - 1)
        near = room & (known[at] == known + step)
        pairs.append((np.flatnonzero(near), at[near]))
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    return first[merge_labels(len(known), a, b)[of]]


def tile_components(cells: DataFrame, side: int = TILE) -> DataFrame:
    """cells: image_id, x, y, lum, cell.  Adds root, the first cell of the component within its tile, in one pass."""
    rows = cells.select("image_id", "x", "y", "lum", "cell", F.floor(F.col("x") / side).alias("_tx"), F.floor(F.col("y") / side).alias("_ty"))
    rows = rows.repartition("image_id", "_tx", "_ty").sortWithinPartitions("image_id", "_tx", "_ty")

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows with numbers of their tiles; a tile that a batch breaks off waits for its rest."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            new = np.zeros(table.num_rows, bool)
            for name in ("image_id", "_tx", "_ty"):
                column = table[name].combine_chunks()
                codes = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy() if name == "image_id" else column.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            number = np.cumsum(new)
            end = int(np.searchsorted(number, number[-1]))
            held = table.slice(end)
            if end:
                yield table.slice(0, end), number[:end]
        if held is not None:
            yield held, np.zeros(held.num_rows, np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches):
            x, y, cell = (table[c].to_numpy().astype(np.int64) for c in ("x", "y", "cell"))
            root = cell[grid_labels(number, x % side, y % side, side)]
            out = table.select(["image_id", "x", "y", "lum", "cell"]).append_column("root", pa.array(root))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(label, StructType([rows.schema[c] for c in ("image_id", "x", "y", "lum", "cell")]).add("root", "long"))


def cell_components(cells: DataFrame, link: Callable[[DataFrame], DataFrame], side: int = TILE) -> DataFrame:
    """image_id, x, y, lum, comp: 4-neighbour components, named by their smallest cell, of cells numbered by (y, x).

    Components are found within tiles first; then only cells on both sides of a tile's border link what they are part of,
    so the rounds of ``link`` depend on tiles, not on cells.
    """
    labelled = saved(tile_components(cells, side), "cells")
    node = F.struct("image_id", F.col("root").alias("cell"))
    pairs = None
    for axis, other in (("x", "y"), ("y", "x")):
        at = F.pmod(F.col(axis), F.lit(side))
        here = labelled.where(at == side - 1).select("image_id", (F.col(axis) + 1).alias(axis), other, node.alias("a"))
        there = labelled.where(at == 0).select("image_id", axis, other, node.alias("b"))
        p = here.join(there, ["image_id", axis, other]).select("a", "b")
        pairs = p if pairs is None else pairs.union(p)
    pairs = saved(pairs.distinct(), "borders")
    if pairs.isEmpty():
        discard(pairs)
        return labelled.select("image_id", "x", "y", "lum", F.col("root").alias("comp"))
    roots = link(pairs).select("node", F.col("root").alias("whole"))
    out = labelled.withColumn("node", node).join(roots, "node", "left").withColumn("comp", F.coalesce("whole.cell", "root"))
    return out.select("image_id", "x", "y", "lum", "comp")


def link_components(links: DataFrame, max_rounds: int = 100, salts: int = 16) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node of each component.  Labels double their reach every round.

    Nodes are of any type that has an order.  A root may be named by most nodes, so roots are looked up by salted keys.
    """
    both = saved(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = saved(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "labels")
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        named = labels.select(F.col("root").alias("node")).distinct()
        hop = labels.join(named, "node").select(F.col("node").alias("root"), F.col("root").alias("far"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        new = labels.join(near, "node").withColumn("salt", salt).join(hop, ["root", "salt"], "left")
        new = saved(new.select("node", F.least("root", "near", F.coalesce("far", "root")).alias("root"), F.col("root").alias("was")), "labels")
        discard(labels)
        labels = new.select("node", "root")
        labels._saved_at = new._saved_at
        if new.where("root <> was").isEmpty():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
