"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

A set's shingle hashes are dealt into bins by their high bits, the smallest hash of a bin being its signature; an empty
bin borrows from a bin that a hash of (bin, attempt) picks, the same for all sets, until that one is not empty.
Signatures are cut into bands; sets that agree in a band share a bucket.  Within a bucket each set is compared with
one centre only, so a bucket of n sets makes n - 1 candidate pairs.  Buckets whose sets the stars of all bands have not
brought into one component - unlike sets with much wording in common - are settled by an exact prefix join across the
components.  Candidates are confirmed on full sets.

Equal sets are folded into one before, so that thousands of copies count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import components, discard, materialise, needs, settled, space_words, text_bytes

MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64
)
SEED = 20_240_501


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], size: int, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words, of the whole run; of none, empty."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - size + 1
    total = h[:n] * MULTIPLIERS[0]
    for j in range(1, size):
        if j % len(MULTIPLIERS) == 0:
            total = mix(total)
        total += h[j : j + n] * MULTIPLIERS[j % len(MULTIPLIERS)]
    return np.unique(mix(total))


class Signer:
    """One-permutation signatures of ``bins`` values."""

    def __init__(self, bins: int, attempts: int = 4_096) -> None:
        self.bins = bins
        rng = np.random.default_rng(SEED)
        self.probes = rng.integers(0, bins, (bins, attempts), dtype=np.int32)  # the shared hash of (bin, attempt)
        # First hash of each bin, as 64-bit bounds: equal parts of the range of hashes.
        self.bounds = np.array([(b << 64) // bins for b in range(bins)], np.uint64)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and not empty."""
        at = np.searchsorted(hashes, self.bounds)
        full = np.diff(np.r_[at, len(hashes)]) > 0
        out = hashes[np.minimum(at, len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            tries = full[self.probes[empty]]
            first = tries.argmax(1)
            lost = ~tries[np.arange(len(empty)), first]
            source = self.probes[empty, first]
            source[lost] = np.flatnonzero(full)[0]
            out[empty] = out[source]
        return out


def sign_texts(rows: Iterator[pa.RecordBatch], size: int, bands: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Per row: number of shingles, digest of the set, and a key per band."""
    signer, known = Signer(bands * depth), Hashes()
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in rows:
        n, digests, keys = [], [], []
        for text in batch.column(1):
            s = shingle_set(space_words(text.as_py()), size, known)
            n.append(len(s))
            if not len(s):
                digests.append(None)
                keys.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig = signer.sign(s).reshape(bands, depth)
            key = salt.copy()
            for j in range(depth):
                key = mix(key * MULTIPLIERS[1] + sig[:, j])
            keys.append(key.view(np.int64))
        flat = np.concatenate([k for k in keys if k is not None]) if any(k is not None for k in keys) else np.empty(0, np.int64)
        ends = np.cumsum([0, *(0 if k is None else bands for k in keys)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


def confirm(rows: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text a, text b) -> the pairs with 100 * intersection >= percent * union, and the others, marked."""
    known, centre, centre_set = Hashes(), None, np.empty(0, np.uint64)
    for batch in rows:
        linked = []
        for a, ta, tb in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
            if a.as_py() != centre:
                centre, centre_set = a.as_py(), shingle_set(space_words(ta.as_py()), size, known)
            other = shingle_set(space_words(tb.as_py()), size, known)
            at = np.searchsorted(centre_set, other)
            both = int((centre_set[np.minimum(at, len(centre_set) - 1)] == other).sum()) if len(centre_set) else 0
            linked.append(both > 0 and 100 * both >= percent * (len(centre_set) + len(other) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )


def near_duplicates(
    documents: DataFrame, *, size: int = 5, percent: int = 75, bands: int = 40, depth: int = 4
) -> DataFrame:
    """Classes of documents whose sets of ``size``-word shingles are linked, directly or over others.

    Words are runs outside ASCII white space after lower-casing A-Z.  Texts of fewer words are one shingle; null and
    empty texts have none and are linked with nothing, not even with one another.  Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable) and kept (doc_id = component_id).  Rows of one doc_id and different
    texts are all kept as rows of one document id; a null doc_id joins nothing and is kept (component null, kept
    true).  Whole texts count, however long.  Ties, of weights or of counts, go to the smallest doc_id and change no class.
    An empty table gives an empty result.  Other columns are ignored.

    A pair at the threshold shares no bucket with a probability of (1 - 0.75^4)^40 < 3e-7.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    signed = materialise(
        own.mapInArrow(
            lambda rows: sign_texts(rows, size, bands, depth), "doc_id long, n_shingles long, digest binary, bands array<long>"
        ),
        "signed",
    )
    named = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # One representative of each set; its copies are links of their own.
    sets = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    sets = materialise(sets, "sets")
    copies = (
        named.join(sets.where("n > 1").select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    buckets = sets.select("rep", F.explode("bands").alias("key"))
    # A bucket may hold a third of all sets.  What it is to know of its sets is summed before the shuffle, and comes back by
    # joins to one row a bucket, whose large side Spark splits.
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    company = materialise(buckets.join(shared, "key"), "company")
    # A bucket's centre is the set with the most company over all bands: of edited copies, the one nearest to them all.
    weight = company.groupBy("rep").agg(F.sum("n").alias("weight"))
    centres = company.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("low"))
    crowd = materialise(company.select("rep", "key").join(centres, "key"), "stars")
    discard(company)
    # The texts that take part, once; merged, not broadcast, as their number follows the corpus.
    involved = crowd.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = materialise(own.where("doc_id IS NOT NULL").join(involved, "doc_id", "left_semi"), "texts")
    stars = crowd.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    starred = compare(stars, texts, size, percent)
    links = settled(starred.where("linked").select("a", "b"), starred, "links")
    roots = materialise(components(links), "roots")
    # What no star has decided: buckets whose sets are not yet in one component.
    rooted = crowd.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialise(rooted.select("rep", "key", "root"), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_ = materialise(rooted.join(mixed, "key", "left_semi").select("rep", "root").distinct(), "open")
    discard(crowd, rooted)
    rest = compare(prefix_pairs(open_, texts, size, percent), texts, size, percent)
    rest = settled(rest.where("linked").select("a", "b"), rest, "rest")
    discard(texts, open_, roots)
    roots = components(links.union(rest).union(copies))
    discard(links, rest, sets)
    out = (
        signed.select("doc_id", "n_shingles")
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
        )
    )
    return needs(out, signed)


def prefix_pairs(open_: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs, across components, of the sets in question that can reach the threshold.

    Two linked sets share a shingle among the first n - ceil(n * percent / 100) + 1 of the larger and yet fewer of the
    smaller one (the prefix lemma of set-similarity joins), in one order of all shingles; from the rarest on, those few are shared by few.  A shingle whose sets are all in one component has nothing to decide and makes no pairs.
    """

    def shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in rows:
            sets = [shingle_set(space_words(t.as_py()), size, known).view(np.int64) for t in batch.column(1)]
            ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["rep", "h"])

    texts = own.join(open_.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    rows = materialise(texts.mapInArrow(shingles, "rep long, h long").distinct(), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("df"))
    ordered = rows.join(often, "h").selectExpr(
        "rep", "h", "row_number() OVER (PARTITION BY rep ORDER BY df, h) AS i", "count(*) OVER (PARTITION BY rep) AS n"
    )
    first = ordered.where(f"i <= n - ceil(n * {percent} / 100) + 1").join(open_, "rep").select("rep", "h", "root", "i", "n")
    first = materialise(first, "first")
    mixed = first.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("h")
    # The smaller set of a pair needs its first n - ceil(2 * percent * n / (100 + percent)) + 1 only.
    large = first.join(mixed, "h", "left_semi").select("h", *(F.col(c).alias(f"x_{c}") for c in ("rep", "root", "n", "i")))
    small = first.where(f"i <= n - ceil(2 * {percent} * n / (100 + {percent})) + 1").join(mixed, "h", "left_semi")
    small = small.select("h", *(F.col(c).alias(f"y_{c}") for c in ("rep", "root", "n", "i")))
    # At the first shingle in common, what is left of both must reach the overlap that the threshold asks for.
    reach = f"(100 + {percent}) * (1 + least(x_n - x_i, y_n - y_i)) >= {percent} * (x_n + y_n)"
    pairs = large.join(small, "h").where(f"x_root <> y_root AND {reach} AND (y_n < x_n OR (y_n = x_n AND y_rep < x_rep))")
    return needs(pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct(), rows, first)


def compare(pairs: DataFrame, texts: DataFrame, size: int, percent: int, slices: int = 64) -> DataFrame:
    """Texts meet their pairs: members one by one, centres once per slice of their star, so that no star is one task's."""
    sliced = materialise(pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(slices)).cast("int")), "pairs")
    members = sliced.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    centres = (
        sliced.select("a", "slice").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    )
    both = members.join(centres, ["a", "slice"]).select("a", "b", "text_a", "text_b")
    out = both.mapInArrow(lambda rows: confirm(rows, size, percent), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))
    return needs(out, sliced, *getattr(pairs, "_needs", ()))
