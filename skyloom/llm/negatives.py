"""Hard negatives: for each anchor's positives, the best rows of other labels within a window of their scores.

Vectors become integers (floor of 256 times each component) and a score is an inner product, exact.  Candidates are
written in the order of a Hilbert curve through a few projections, as Parquet rows that are blocks of up to 256 vectors
with the least and the greatest of each dimension and of the labels: zone maps.  Anchors are written in the same order,
as tiles.  A task takes a tile and a group of candidate files.  It reads their zone maps, bounds each anchor's scores in
each block by interval arithmetic, and reads, best bound first, only the row groups in which some window may still hold
a row that beats what it has.  The first search has the window of all scores and the anchor's own label (positives), the
second one window for each positive and the other labels.  Each task's best rows are few; windows over them give the
best of all.  Bounds only save reading: results are exact, whatever the order.

Rows without a vec_id, label or vector, or with a null or non-finite component, take no part; of rows that repeat a
vec_id one does.  Vectors of different lengths never meet; vectors of no length score 0.  Scores that exceed a long are
held at its ends.  Ties go to the smaller vec_id.  No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import discard, materialise
from skyloom.sources.shared import open_store

AXES, BITS = 8, 8  # of the Hilbert curve
BLOCK_ROWS = 256
#: Layout only: rows of a candidate file, files that a task takes, and bounds of an anchor tile.
FILE_ROWS, GROUP_FILES, TILES, TILE_ROWS = 16_384, 32, 64, (32, 4_096)
LONG = np.iinfo(np.int64).max
NONE = -LONG  # the score of no row
POINT = "vec_id long, label long, dims int, place binary, v binary"


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of coordinates below 2^bits, as an array of axis digits, most significant first."""
    x = coords.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns that the cells of each level make
        low = (1 << level) - 1
        for i in range(axes):
            turned = (x[i] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    levels = [(x >> level & 1) for level in range(bits - 1, -1, -1)]
    return np.concatenate(levels).T  # a row's bits, by level and then by axis


def places(q: np.ndarray) -> list[bytes]:
    """Keys that sort integer vectors along the curve, by the directions of their projections."""
    size = q.shape[1]
    if not size:
        return [b""] * len(q)
    axes = np.random.default_rng([20_250_301, size]).standard_normal((size, AXES)) / np.sqrt(size)
    unit = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
    cells = np.clip((unit @ axes * np.sqrt(size) / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    packed = np.packbits(hilbert(np.floor(cells)).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def packed_small(q: np.ndarray) -> bytes:
    """Integers in the smallest width that holds them; wider than four bytes as doubles."""
    most = np.abs(q).max(initial=0)
    return q.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def unpacked(raw: bytes, rows: int, dims: int) -> np.ndarray:
    width = len(raw) // max(1, rows * dims)
    return np.frombuffer(raw, {2: "<i2", 4: "<i4"}.get(width, "<f8")).astype(np.float64).reshape(rows, dims)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, dims, place, v of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            size = np.asarray([-1 if n is None else n for n in vectors.value_lengths().to_pylist()])
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            here = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
            for width in np.unique(size[size >= 0]):
                at = np.flatnonzero((size == width) & here)
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(flat[starts[at, None] + np.arange(width)] * 256)
                good = np.isfinite(q).all(1)
                at, q = at[good], q[good]
                with np.errstate(over="ignore"):
                    place = places(q)
                cols = [ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array(np.full(len(at), width), pa.int32()), pa.array(place, pa.binary()), pa.array([packed_small(x) for x in q], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "dims", "place", "v"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, POINT)


BLOCK = "part int, dims int, n int, low binary, high binary, low_label long, high_label long, ids binary, labels binary, data binary"


def blocks_of(points: DataFrame, parts: int, rows: int, name: str, group_bytes: int = 1 << 20) -> DataFrame:
    """Points in Hilbert order as saved Parquet blocks: ``rows`` at most each, with zone maps; part is the file's number.
    Row groups, the unit of reading, are of about ``group_bytes``."""
    ordered = points.repartitionByRange(parts, "dims", "place", "vec_id").sortWithinPartitions("dims", "place", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            dims = held[0][2]
            by_id = sorted(held)
            q = np.concatenate([unpacked(x[4], 1, dims) for x in by_id])
            labels = [x[1] for x in by_id]
            row = (part, dims, len(held), q.min(0).tobytes(), q.max(0).tobytes(), min(labels), max(labels), np.array([x[0] for x in by_id], "<i8").tobytes(), np.array(labels, "<i8").tobytes(), packed_small(q))
            held.clear()
            kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == rows or held[0][2] != row[2]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    options = {"parquet.block.size": str(group_bytes), "parquet.page.size": str(1 << 16), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}
    return materialise(ordered.mapInArrow(pack, BLOCK), name, **options)


def files_of(table: DataFrame) -> DataFrame:
    """part and path of the files of saved blocks or windows."""
    return table.select("part", F.col("_metadata.file_path").alias("path")).distinct()


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows as longs."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)


class Queries:
    """The windows of a tile's anchors, and the best rows of each so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.x, self.of, self.low, self.high, self.same = ids, labels, x, of, low, high, same
        self.scores = np.full((len(of), k), NONE, np.int64)
        self.rows = np.full((len(of), k), LONG, np.int64)
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)

    def wanted(self, zones: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(which queries may still find a row in which blocks, greatest scores that blocks may hold)."""
        low, high = zones["low"], zones["high"]
        slack = 1e-9 * (np.abs(self.x) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
        most = self.up @ high.T + self.down @ low.T + slack
        least = self.up @ low.T + self.down @ high.T - slack
        own = self.labels[:, None]
        fits = (zones["low_label"] <= own) & (own <= zones["high_label"]) if self.same else (zones["low_label"] != own) | (zones["high_label"] != own)
        floor = np.maximum(self.low, self.scores[:, -1]).astype(np.float64)
        floor -= 1e-9 * np.abs(floor)
        need = fits[self.of] & (most[self.of] >= floor[:, None]) & (least[self.of] <= self.high[:, None] * (1 + 1e-9 * np.sign(self.high[:, None])))
        return need, np.where(need, most[self.of], -np.inf).max(0, initial=-np.inf)

    def look(self, need: np.ndarray, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        """Scores the rows of a block for the queries that need it."""
        asked = np.flatnonzero(need)
        anchors, where = np.unique(self.of[asked], return_inverse=True)
        s = exact_scores(self.x[anchors], y)
        fits = (labels[None, :] == self.labels[anchors, None]) == self.same
        fits &= ids[None, :] != self.ids[anchors, None]
        s, fits = s[where], fits[where]
        fits &= (s >= self.low[asked, None]) & (s <= self.high[asked, None]) & (s >= self.scores[asked, -1:])
        hit = np.flatnonzero(fits.any(1))
        if not len(hit):
            return
        at, k = asked[hit], self.scores.shape[1]
        scores = np.concatenate([self.scores[at], np.where(fits[hit], s[hit], NONE)], 1)
        rows = np.concatenate([self.rows[at], np.where(fits[hit], ids[None, :], LONG)], 1)
        first = np.lexsort((rows, -scores), axis=1)[:, :k]
        self.scores[at] = np.take_along_axis(scores, first, 1)
        self.rows[at] = np.take_along_axis(rows, first, 1)


class CandidateFiles:
    """Zone maps of saved blocks, and their row groups on demand."""

    def __init__(self, paths: list[str]) -> None:
        self.files = [pq.ParquetFile(store.open_input_file(path)) for store, path in map(open_store, paths)]
        self.groups = [(f, i) for f in self.files for i in range(f.num_row_groups)]
        self.read = 0

    def zones(self, f: pq.ParquetFile, i: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
        """(dims, places in the row group, zone maps) for each length of vectors."""
        t = f.read_row_group(i, columns=["dims", "low", "high", "low_label", "high_label"])
        dims = t["dims"].to_numpy()
        for size in np.unique(dims):
            at = np.flatnonzero(dims == size)
            box = lambda c: np.frombuffer(b"".join(t[c].take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), size)  # noqa: E731, B023
            yield int(size), at, {"low": box("low"), "high": box("high"), "low_label": t["low_label"].to_numpy()[at], "high_label": t["high_label"].to_numpy()[at]}

    def rows(self, f: pq.ParquetFile, i: int) -> list[dict]:
        self.read += 1
        return f.read_row_group(i, columns=["n", "dims", "ids", "labels", "data"]).to_pylist()

    def close(self) -> None:
        for f in self.files:
            f.close(force=True)


def scan(queries: dict[int, Queries], paths: list[str]) -> int:
    """Fills the queries (by length of vectors) from the candidate files; returns how many row groups were read."""
    candidates = CandidateFiles(paths)
    ranked = []
    for f, i in candidates.groups:
        for size, _, zones in candidates.zones(f, i):
            if size in queries:
                need, most = queries[size].wanted(zones)
                if need.any():
                    ranked.append((-most.max(), len(ranked), size, f, i))
    for _, _, size, f, i in sorted(ranked, key=lambda r: r[:2]):
        q, rows = queries[size], None
        at, zones = next((at, z) for n, at, z in candidates.zones(f, i) if n == size)
        need = q.wanted(zones)[0]
        for j in np.flatnonzero(need.any(0)):
            rows = candidates.rows(f, i) if rows is None else rows
            row = rows[at[j]]
            q.look(need[:, j], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), unpacked(row["data"], row["n"], size))
    candidates.close()
    return candidates.read


FOUND = "part int, anchor_id long, positive_id long, positive_score long, found_id long, found_score long"


def search(work: DataFrame, k: int, share: tuple[int, int] | None) -> DataFrame:
    """work: part, tile (path), windows (path or null), paths.  With a share, the windows of the tile's positives: between
    these percentages of their scores, other labels; without one, all scores and the anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tile, windows, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given: dict[int, list[tuple[int, int]]] = {}
                if windows is not None:
                    store, path = open_store(windows)
                    for r in pq.read_table(path, filesystem=store, filters=[("part", "=", part)], partitioning=None).to_pylist():
                        given.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
                store, path = open_store(tile)
                queries, pairs = {}, {}
                for r in pq.read_table(path, filesystem=store, partitioning=None).to_pylist():
                    if r["part"] == part:
                        ids = np.frombuffer(r["ids"], "<i8")
                        own = [(i, p, s) for i, anchor in enumerate(ids.tolist()) for p, s in (given.get(anchor, ()) if share else [(None, None)])]
                        low = np.array([-((-share[0] * s) // 100) for *_, s in own] if share else [NONE] * len(own), np.int64)
                        high = np.array([share[1] * s // 100 for *_, s in own] if share else [LONG] * len(own), np.int64)
                        more = Queries(ids, np.frombuffer(r["labels"], "<i8"), unpacked(r["data"], r["n"], r["dims"]), np.array([i for i, *_ in own], np.int64), low, high, k, share is None)
                        queries.setdefault(r["dims"], []).append(more)
                        pairs[id(more)] = own
                for n in range(max(map(len, queries.values()), default=0)):
                    some = {size: q[n] for size, q in queries.items() if n < len(q) and len(q[n].of)}
                    if some:
                        scan(some, paths)
                    for q in some.values():
                        at, rank = np.nonzero(q.rows != LONG)
                        own = pairs[id(q)]
                        cols = [np.full(len(at), part, np.int32), q.ids[q.of[at]], [own[i][1] for i in at], [own[i][2] for i in at], q.rows[at, rank], q.scores[at, rank]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.int64()) for j, c in enumerate(cols)], names=[f.split()[0] for f in FOUND.split(", ")])

    return work.select("part", "tile", "windows", "paths").mapInArrow(run, FOUND)


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """With rank, the first k of each."""
    w = Window.partitionBy(*by).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of which ``anchors`` holds.

    embeddings: vec_id, label, embedding.  An anchor's positives are its best other rows of the same label; a negative's
    score lies between the given percentages of the positive's.
    """
    spark = embeddings.sparkSession
    points = quantised(embeddings).groupBy("vec_id").agg(F.min(F.struct("label", "dims", "place", "v")).alias("p"))
    points = materialise(points.select("vec_id", "p.*"), "points")
    size = points.agg(F.count("*").alias("rows"), F.count_if(anchors).alias("anchors")).first()
    cores = spark.sparkContext.defaultParallelism
    tile_rows = min(max(size["anchors"] // TILES, TILE_ROWS[0]), TILE_ROWS[1])
    candidates = blocks_of(points, max(1, size["rows"] // FILE_ROWS), BLOCK_ROWS, "blocks")
    tiles = blocks_of(points.where(anchors), max(1, size["anchors"] // tile_rows), tile_rows, "tiles")

    # Every tile meets every group of files; of both there are few.
    last = tiles.agg(F.coalesce(F.max("part"), F.lit(-1)).alias("part")).first()["part"]
    groups = files_of(candidates).groupBy(F.floor(F.col("part") / GROUP_FILES).alias("group")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups = materialise(groups, "groups")
    units = max(1, (last + 1) * groups.count())
    spread = min(units, max(4 * cores, units // 16))
    work = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)))) if last >= 0 else groups.withColumn("part", F.lit(-1))
    work = materialise(work.join(files_of(tiles).withColumnRenamed("path", "tile"), "part"), "work")

    found = search(work.withColumn("windows", F.lit(None).cast("string")).repartition(spread), positives, None)
    mine = best(found, ["part", "anchor_id"], positives).select("part", "anchor_id", F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))
    mine = materialise(mine.repartition("part").sortWithinPartitions("part", "anchor_id"), "windows")

    rest = work.join(files_of(mine).withColumnRenamed("path", "windows"), "part")
    found = best(search(rest.repartition(spread), negatives, share), ["anchor_id", "positive_id", "positive_score"], negatives)
    out = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))
    out = materialise(out, "negatives")
    discard(points, candidates, tiles, groups, work, mine)
    return out
