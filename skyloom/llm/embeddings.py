"""Near-duplicate embeddings by sorted projection passes.

A pass hashes each vector to the signs of random projections and sorts all vectors lexicographically by them; each vector
is compared, in exact cosine, with the ``window`` ones that follow it, and verified pairs are united over the passes.  A
pair at the threshold agrees in a sign with a probability that the angle alone gives, so in so many passes it shares the
first ``bits`` signs in one of them with the wanted probability, however the vectors lie.  Vectors that share them are
within a window of each other if they are not more than that.  Where more share them, a crowd, no window is enough: crowds
are compared in full, tile by tile - pass by pass, or, vectors that stand in great crowds in the passes over the whole
table, all of them with one another once.  ``bits`` are chosen by the crowds of a sample.  All sizes go the same way: up to
``window`` vectors, no sign is shared in vain and one pass compares all.

Equal vectors are folded into one before.  Direct links are counted in full within each component, by blocks of dot
products, so they do not depend on the passes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from skyloom.llm.common import components, discard, materialise
from skyloom.operators.components import merge_labels

BITS = 63


def planes(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng([20_240_501, seed, size]).standard_normal((size, BITS))


@functools.cache
def pass_planes(p: int, size: int) -> np.ndarray:
    """The projections of a pass."""
    return planes(p, size)


def passes_for(bits: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has agreed in all ``bits`` signs of one with probability ``recall``."""
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if together >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - together))


def raw_vectors(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, raw) and the code of raw's numbers: those of the column, as binary; null if a vector is null, empty, zero
    or holds a null or a non-finite component."""
    kind = embeddings.schema["embedding"].dataType
    code = "<f4" if isinstance(getattr(kind, "elementType", None), FloatType) else "<f8"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)  # nulls as NaN
            starts = np.cumsum(size) - size
            raw = np.full(len(size), None, object)
            for width in np.unique(size[size > 0]):
                at = np.flatnonzero(size == width)
                x = flat[starts[at, None] + np.arange(width)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                packed = x[good].astype(code).tobytes()
                step = int(width) * int(code[2])
                raw[at[good]] = [packed[i : i + step] for i in range(0, len(packed), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if code == '<f4' else 'double'}>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, raw binary"), code


def units(raw: Sequence[bytes], code: str) -> np.ndarray:
    """Vectors of one width at length one, in double precision."""
    x = np.frombuffer(b"".join(raw), code).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def least_work(crowds: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(comparisons, cap) for (crowd from, vectors, their crowds summed): vectors above the cap are compared in full with
    one another, the others with all they meet in the passes."""
    left = sum(n for _, n, _ in crowds)
    best, met = (left * left / 2, -1.0), 0.0
    for low, n, crowd in sorted(crowds):
        left, met = left - n, met + crowd
        best = min(best, (met + left * left / 2, low))
    return best


def choose_bits(sample: DataFrame, code: str, scale: float, threshold: float, window: int, recall: float, row_work: int, trials: int = 6) -> int:
    """Signs of a pass that make the least work, by the buckets of a sample of 1 in ``scale``."""
    room = next((b for b in range(1, BITS) if passes_for(b, threshold, recall) > 1_000), BITS) if threshold > -1 else 1

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        width = rows["raw"].str.len().to_numpy()
        crowds = np.zeros((room, len(rows)))
        for size in np.unique(width):
            at = np.flatnonzero(width == size)
            x = units(rows["raw"].to_numpy()[at], code)
            for p in range(trials):
                key = signs(x, BITS, p)
                for bits in range(1, room):
                    _, of, n = np.unique(key >> (BITS - bits), return_inverse=True, return_counts=True)
                    crowds[bits, at] += (1 + (n[of] - 1) * scale) / trials
        for bits in range(1, room):
            if crowds[bits].mean() < window:
                break
            low = np.floor(4 * np.log2(crowds[bits]))
            for step in np.unique(low):
                of = low == step
                out.append((bits, float(step), float(of.sum()), float(crowds[bits, of].sum())))
        return pd.DataFrame(out, columns=["bits", "low", "n", "crowd"])

    found = sample.select("raw").groupBy().applyInPandas(measure, "bits int, low double, n double, crowd double").collect()
    best = math.inf, 1
    for bits in sorted({r["bits"] for r in found}):
        passes = passes_for(bits, threshold, recall)
        steps = [(r["low"], r["n"] * scale, passes * (r["crowd"] + row_work * r["n"]) * scale) for r in found if r["bits"] == bits]
        best = min(best, (least_work(steps)[0], bits))
    return best[1]


def signs(x: np.ndarray, bits: int, p: int) -> np.ndarray:
    """Signs of the first projections of pass ``p`` as one number."""
    return (x @ planes(p, x.shape[1])[:, :bits] > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def spanning_links(
    ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, threshold: float, step: int = 512
) -> list[pd.DataFrame]:
    """A spanning forest (a, b) of the links between two tiles, or within one (``y is x``)."""
    same = y is x
    shift = 0 if same else len(x)
    label = np.arange(shift + len(y))
    out = []
    for start in range(0, len(x), step):
        hit = x[start : start + step] @ y.T >= threshold
        if same:
            hit[np.arange(len(hit)), np.arange(start, start + len(hit))] = False
        linked = np.flatnonzero(hit.any(1))
        for i in linked:
            at = np.flatnonzero(hit[i])
            own = label[start + i]
            there, first = np.unique(label[shift + at], return_index=True)
            new = first[there != own]
            if len(new):
                out.append(pd.DataFrame({"a": ids[start + i], "b": other_ids[at[new]]}))
                label[np.isin(label, there)] = own
    return out


def neighbour_links(rows: DataFrame, code: str, threshold: float, window: int, step: int = 256) -> DataFrame:
    """Links (a, b) of vectors to the ``window`` next ones in the order of their signs: spanning forests of every stretch.

    rows: pass, prefix, width, key, rep, raw.  Vectors of one prefix meet in one task, which reads them in order.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, 0))

        def stretch(last: bool) -> Iterator[pa.RecordBatch]:
            """Compares all that have their window behind them, and keeps the rest."""
            nonlocal ids, x
            end = len(ids) if last else max(0, len(ids) - window)
            found = []
            for start in range(0, end, step):
                stop = min(start + step, end)
                hit = x[start:stop] @ x[start : stop + window].T >= threshold
                i, j = np.nonzero(hit)
                ahead = (j > i) & (j <= i + window)
                found.append((start + i[ahead], start + j[ahead]))
            if found:
                a, b = (np.concatenate(side) for side in zip(*found, strict=True))
                label = merge_labels(len(ids), a, b)
                at = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at])], names=["a", "b"])
            ids, x = ids[end:], x[end:]

        for batch in batches:
            reps, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.array([len(r) for r in raw])
            cuts = np.flatnonzero(np.diff(size)) + 1
            for part in np.split(np.arange(len(raw)), cuts):
                y = units([raw[i] for i in part], code) if len(part) else x
                if len(part) and y.shape[1] != x.shape[1]:
                    yield from stretch(True)
                    x = y[:0]
                if len(part):
                    ids, x = np.concatenate([ids, reps[part]]), np.concatenate([x, y])
            if len(ids) > 2 * window:
                yield from stretch(False)
        yield from stretch(True)

    placed = rows.repartition("pass", "width", "prefix").sortWithinPartitions("width", "pass", "key", "rep")
    return placed.select("rep", "raw").mapInArrow(link, "a long, b long")


def bucket_links(rows: DataFrame, reps: DataFrame, code: str, threshold: float, block: int, slots: int, salts: int = 16) -> DataFrame:
    """Links (a, b) among the vectors of each bucket, of pairs with a ``main`` one: spanning forests only.

    rows: pass, prefix, width (the bucket), rep, main.  A bucket is cut into tiles, main vectors apart from the others;
    each pair of its tiles with a main one is a piece of work of its own.  Buckets of one tile share pieces.
    """
    key = ["pass", "prefix", "width"]
    sizes = rows.groupBy(*key).agg(F.count_if("main").alias("mains"), F.count_if(~F.col("main")).alias("others")).where("mains > 0 AND mains + others > 1")
    sizes = sizes.select(*key, *(F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("mains", "others")), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    tiled = rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(salts)).cast("int")).join(sizes, [*key, "salt"])
    own = F.xxhash64("rep")
    tiled = tiled.withColumn("tile", F.when(F.col("main"), F.pmod(own, "mains")).otherwise(F.col("mains") + F.pmod(own, F.greatest("others", F.lit(1)))).cast("int"))
    tiled = tiled.withColumn("slot", F.when(F.expr("mains + others = 1"), F.pmod(F.xxhash64(*key), F.lit(slots))).otherwise(F.xxhash64(*key)))
    places = F.expr(
        "explode(concat(if(main, transform(sequence(tile, mains + others - 1), j -> struct(tile AS x, j AS y, 0 AS side)), array()),"
        " if(tile > 0, transform(sequence(0, least(tile, mains) - 1), i -> struct(i AS x, tile AS y, 1 AS side)), array())))"
    )
    placed = tiled.select("slot", *key, "rep", places.alias("at")).select("slot", *key, "rep", "at.*").join(reps.select("rep", "raw"), "rep")

    def link(piece: pd.DataFrame) -> pd.DataFrame:
        links = []
        same = piece["x"].iloc[0] == piece["y"].iloc[0]
        for _, g in piece.groupby(key):
            a = g[g["side"] == 0]
            b = a if same else g[g["side"] == 1]
            if len(a) and len(b):
                x = units(a["raw"], code)
                y = x if same else units(b["raw"], code)
                links += spanning_links(a["rep"].to_numpy(), x, b["rep"].to_numpy(), y, threshold)
        return pd.concat([pd.DataFrame({"a": [], "b": []}).astype("int64"), *links])

    return placed.groupBy("slot", "x", "y").applyInPandas(link, "a long, b long")


def similar_vectors(
    embeddings: DataFrame, *, threshold: float = 0.9, window: int = 512, recall: float = 0.9999, block: int = 8_192, tile: int = 1_024
) -> DataFrame:
    """One row per vector: n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Rows repeating a
    vec_id are one vector id each, linked by any of them, and every row comes back; a null vec_id links with nothing and is
    kept.  Vectors of unlike lengths are never linked, however long.  Ties of cosines change nothing: all links at or over
    the threshold count.  An empty table gives an empty result.  Other columns are ignored.

    A pair at the threshold is compared with probability ``recall``, nearer ones with a higher one; no pair of up to
    ``window`` vectors is missed.
    """
    vectors, code = raw_vectors(embeddings)
    vectors = materialise(vectors, "vectors")
    good = vectors.where("raw IS NOT NULL AND vec_id IS NOT NULL")
    reps = materialise(good.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "reps")
    count = reps.count()
    bits = 0
    if count > window:
        share = min(1.0, 20_000 / count)
        sample = reps.where(F.pmod(F.xxhash64("rep", F.lit(29)), F.lit(1_000_000)) < math.ceil(share * 1e6))
        bits = choose_bits(sample, code, 1 / share, threshold, window, recall, block)
    passes = passes_for(bits, threshold, recall)

    def keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in rows:
            raw = batch.column(1).to_pylist()
            size = np.array([len(x) for x in raw], np.int64)
            for w in np.unique(size):
                at = np.flatnonzero(size == w)
                x = units([raw[i] for i in at], code)
                own = batch.column(0).take(pa.array(at))
                for p in range(passes):
                    key = (x @ pass_planes(p, x.shape[1]) > 0) @ weight
                    cols = [pa.array(np.full(len(at), p, np.int32)), pa.array(key >> (BITS - bits)), pa.array(np.full(len(at), w, np.int32)), pa.array(key), own]
                    yield pa.RecordBatch.from_arrays(cols, names=["pass", "prefix", "width", "key", "rep"])

    bucket = ["pass", "prefix", "width"]
    keyed = materialise(reps.select("rep", "raw").mapInArrow(keys, "pass int, prefix long, width int, key long, rep long"), "keyed")
    # Sizes of buckets are looked up by salted keys, as buckets may be large.
    salt = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(16)).cast("int").alias("salt")
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    sized = materialise(keyed.select("*", salt).join(sizes, [*bucket, "salt"]).drop("salt"), "sized")
    near = neighbour_links(sized.where(F.col("n") <= window).join(reps.select("rep", "raw"), "rep"), code, threshold, window)
    links = [materialise(near, "near")]
    discard(keyed)

    crowds = sized.where(F.col("n") > window)
    # A vector's crowd: all that it meets in the crowds of all passes.
    crowd = crowds.groupBy("rep").agg(F.sum("n").alias("crowd"))
    crowd = materialise(crowd.withColumn("low", F.floor(4 * F.log2("crowd")).cast("double")), "crowd")
    steps = [tuple(r) for r in crowd.groupBy("low").agg(F.count("*").cast("double"), F.sum("crowd").cast("double") + passes * float(block) * F.count("*")).collect()]
    if steps:
        crowd = crowd.select("rep", (F.col("low") <= least_work(steps)[1]).alias("main"))
        rows = crowds.join(crowd, "rep").select(*bucket, "rep", "main")
        once = reps.join(crowd.where("NOT main").select("rep"), "rep", "left_semi")
        once = once.select(F.lit(-1).alias("pass"), F.lit(0).cast("long").alias("prefix"), F.length("raw").alias("width"), "rep", F.lit(True).alias("main"))
        slots = max(1, count * passes // (4 * block))
        links.append(materialise(bucket_links(rows.unionByName(once), reps, code, threshold, block, slots), "links"))
    both = links[0] if len(links) == 1 else links[0].union(links[1])
    roots = materialise(components(both.select("a", "b")), "roots")
    member = materialise(reps.join(roots.withColumnRenamed("node", "rep"), "rep").select("root", "rep", "copies", "raw"), "member")
    found = materialise(count_links(member, code, threshold, tile), "counts")
    discard(sized, member, *links)
    whole = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(found, "rep", "left")
    salts = 16
    group = whole.select(
        "raw",
        F.coalesce("root", "rep").alias("component_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > 1, F.lit(salts - 1)).otherwise(F.lit(0)))).alias("salt"),
        "copies",
    )
    # Copies of one vector are looked up by salted keys; vectors without copies stand under salt 0.
    own = good.join(reps.where("copies > 1").select("raw"), "raw", "left_semi").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    many = own.join(group.where("copies > 1"), ["raw", "salt"]).select("vec_id", "n_links", "component_id")
    one = whole.where("copies = 1").select(F.col("rep").alias("vec_id"), F.coalesce("others", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rest = vectors.where("raw IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = one.unionByName(many).unionByName(rest)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def count_links(member: DataFrame, code: str, threshold: float, tile: int) -> DataFrame:
    """Direct links of every vector to others of its component, copies counted: rep, others.

    A component is cut into tiles; each pair of its tiles is a task's work, so that no component is held whole.
    """
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    small = member.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # A row of tile t goes to the pairs (t, j) as the one side and (j, t) as the other, for j from t on and up to t.
    left = small.withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).select("root", "tile", "other", "rep", "copies", "raw", F.lit(0).alias("side"))
    right = small.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("tile")))).where("mine < tile").select("root", F.col("mine").alias("tile"), F.col("tile").alias("other"), "rep", "copies", "raw", F.lit(1).alias("side"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        same = rows["tile"].iloc[0] == rows["other"].iloc[0]
        for _, g in rows.groupby(rows["raw"].str.len()):
            a = g[g["side"] == 0]
            b = a if same else g[g["side"] == 1]
            if not len(a) or not len(b):
                continue
            x, y = (units(s["raw"], code) for s in (a, b))
            hit = x @ y.T >= threshold
            if same:
                np.fill_diagonal(hit, False)
            out.append(pd.DataFrame({"rep": a["rep"].to_numpy(), "others": hit @ b["copies"].to_numpy()}))
            if not same:
                out.append(pd.DataFrame({"rep": b["rep"].to_numpy(), "others": hit.T @ a["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "others": []}).astype("int64")

    counted = left.unionByName(right).groupBy("root", "tile", "other").applyInPandas(count, "rep long, others long")
    return counted.groupBy("rep").agg(F.sum("others").alias("others"))
