"""Benchmark decontamination over a positional inverted index of the training texts.

The index is built once, over all terms of all documents, and stored in the shared folder.  It is partitioned by
document: a shard holds some documents' postings, one sorted list of word positions per term, and is one row.  Positions
run through a shard's documents with a gap after each, so that no phrase crosses from one to the next.

Phrases are kept by one term each, the one that fewest phrases hold.  A shard looks only at the phrases of terms that it
holds, and of these only at those all of whose terms it holds.  It takes the list of a phrase's rarest term, shifted by
the term's offset in the phrase, and intersects it with the others' from the next rarest on, for all phrases together.
A shard answers on its own, so nothing is shuffled, and each shard is read once for a block of phrases.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, needs, plain_words, text_bytes

SHARD_WORDS = 600_000
AT_ONCE = 2_000_000  # places that a shard intersects at a time
BLOCK_WORDS = 1_000_000  # windows of benchmark items that are sent to the executors at a time
INDEX = "shard string, ids array<long>, starts binary, lengths binary, terms binary, sizes binary, postings binary"
FOUND = "shard string, place int, doc_id long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def build_index(documents: DataFrame, gap: int) -> DataFrame:
    """One row per shard: documents' ids, first positions and lengths; terms, list sizes and differences of positions."""

    def shard(docs: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
        lengths = np.array([len(w) for _, w in docs], np.int64)
        starts = np.cumsum(lengths + gap) - lengths - gap
        number: dict[bytes, int] = {}
        term = np.array([number.setdefault(w, len(number)) for _, words in docs for w in words], np.int32)
        place = np.arange(len(term), dtype=np.int32) + np.repeat((gap * np.arange(len(docs))).astype(np.int32), lengths)
        order = np.argsort(term, kind="stable")  # positions stay ascending within a term
        sizes = np.bincount(term, minlength=len(number)).astype("<i4")
        cells = [
            (uuid.uuid4().hex, pa.string()),
            ([d for d, _ in docs], pa.list_(pa.int64())),
            *((x, pa.binary()) for x in (starts.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), b"\n".join(number), sizes.tobytes())),
            (np.diff(place[order], prepend=np.int32(0)).astype("<i4").tobytes(), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in cells], names=["shard", "ids", "starts", "lengths", "terms", "sizes", "postings"])

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for batch in rows:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                docs.append((doc.as_py(), plain_words(text.as_py())))
                size += len(docs[-1][1]) + gap
                if size > SHARD_WORDS:
                    yield shard(docs)
                    docs, size = [], 0
        if docs:
            yield shard(docs)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    return rows.mapInArrow(build, INDEX)


@dataclass
class Block:
    """Phrases to look for.  Terms are numbered; a phrase is a row of numbers, -1 after its end."""

    terms: dict[bytes, int]
    phrases: np.ndarray  # distinct rows, those of one key term together
    keys: np.ndarray  # each phrase's key term
    owners: np.ndarray  # phrase and item of each window, as two columns, by phrase
    items: list[str]
    near: dict[str, tuple[bytes, ...]]  # the words that are to stand together, by item

    @staticmethod
    def of(terms: dict[bytes, int], rows: list[np.ndarray], owners: list[np.ndarray], items: list[str], near: dict[str, tuple[bytes, ...]]) -> Block:
        table = np.concatenate(rows) if rows else np.empty((0, 1), np.int32)
        phrases, of = np.unique(table, axis=0, return_inverse=True)
        flat = phrases[phrases >= 0]
        held = np.append(np.bincount(flat, minlength=len(terms)), np.iinfo(np.int64).max)  # the last one for -1
        keys = phrases[np.arange(len(phrases)), held[phrases].argmin(1)]
        order = np.argsort(keys, kind="stable")
        new = np.empty_like(order)
        new[order] = np.arange(len(order))
        pairs = np.c_[new[of.ravel()], np.concatenate(owners)] if owners else np.empty((0, 2), np.int64)
        return Block(terms, phrases[order], keys[order], np.unique(pairs, axis=0), items, near)


def blocks(benchmark: Iterable[tuple[str, bytes | None]], window: int, near_terms: int) -> Iterator[Block]:
    """Items' windows in blocks of BLOCK_WORDS; an item may go on in the next one.  There is one block at least."""
    terms: dict[bytes, int] = {}
    rows, owners, items, near, room = [], [], [], {}, BLOCK_WORDS
    for name, text in benchmark:
        words = plain_words(text)
        if len(set(words)) >= near_terms > 0:
            near[name] = tuple(sorted(set(words), key=lambda w: (-len(w), w))[:near_terms])
        at, n = 0, max(1, len(words) - window + 1) if words else 0
        while at < n:
            take = min(room, n - at)
            number = np.array([terms.setdefault(w, len(terms)) for w in words[at : at + take + window - 1]], np.int32)
            if len(number) < window:
                number = np.append(number, np.full(window - len(number), -1, np.int32))
            rows.append(np.lib.stride_tricks.sliding_window_view(number, window))
            owners.append(np.full(len(rows[-1]), len(items), np.int64))
            items.append(name)
            at, room = at + take, room - take
            if not room:
                yield Block.of(terms, rows, owners, items, near)
                terms, rows, owners, items, near, room = {}, [], [], [], {}, BLOCK_WORDS
    if items or near or room == BLOCK_WORDS:
        yield Block.of(terms, rows, owners, items, near)


class Shard:
    """One row of the index."""

    def __init__(self, row: dict) -> None:
        self.name, self.ids = row["shard"], row["ids"]
        self.starts, self.lengths = (np.frombuffer(row[k], "<i8") for k in ("starts", "lengths"))
        self.sizes = np.frombuffer(row["sizes"], "<i4")
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        self.places = np.cumsum(np.frombuffer(row["postings"], "<i4"), dtype=np.int64)
        self.terms = row["terms"].split(b"\n") if len(self.sizes) else []
        self.span = int(self.places.max(initial=0)) + 1
        self.keys = np.repeat(np.arange(len(self.sizes)) * self.span, self.sizes) + self.places  # ascending: all lists in one

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def matches(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact phrase."""
        here = np.full(len(block.terms) + 1, -1)  # the shard's number of each term; the last one for -1
        asked = np.array([block.terms.get(t, -1) for t in self.terms], np.int64)
        here[asked[asked >= 0]] = np.flatnonzero(asked >= 0)
        none = np.empty(0, np.int64)
        first, last = (np.searchsorted(block.keys, np.unique(asked[asked >= 0]), side=s) for s in ("left", "right"))
        alive = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True) if b > a] or [none])
        alive = alive[((here[block.phrases[alive]] >= 0) | (block.phrases[alive] < 0)).all(1)]
        if not len(alive):
            return none, none
        rarest = np.where(block.phrases[alive] >= 0, self.sizes[here[block.phrases[alive]]], np.iinfo(np.int32).max).min(1).astype(np.int64)
        parts = np.split(alive, np.flatnonzero(np.diff((np.cumsum(rarest) - rarest) // AT_ONCE)) + 1)
        found = [self.intersect(block, part, here) for part in parts]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def intersect(self, block: Block, alive: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of some phrases, all of whose terms the shard holds."""
        own = here[block.phrases[alive]]  # the shard's terms of each phrase
        size = np.where(own >= 0, self.sizes[own], np.iinfo(np.int32).max)
        order = np.argsort(size, axis=1, kind="stable")  # offsets, the rarest term's first
        rarest = own[np.arange(len(own)), order[:, 0]]
        n = self.sizes[rarest].astype(np.int64)
        row = np.repeat(np.arange(len(alive)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[rarest] - n, n)
        start = self.places[at] - order[row, 0]
        for rank in range(1, own.shape[1]):
            offset = order[row, rank]
            term, place = own[row, offset], start + offset
            want = term * self.span + place
            found = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want
            keep = (term < 0) | (found & (place >= 0) & (place < self.span))
            row, start = row[keep], start[keep]
        return alive[row], start

    def near(self, words: tuple[bytes, ...], width: int, number: dict[bytes, int]) -> np.ndarray:
        """Positions of words with which a stretch of ``width`` words of a document begins that holds all of them."""
        if any(w not in number for w in words):
            return np.empty(0, np.int64)
        lists = [self.places[self.ends[i] - self.sizes[i] : self.ends[i]] for i in {number[w] for w in words}]
        rarest = min(lists, key=len)
        out = []
        for k, base in enumerate(lists):
            # Only stretches that reach an occurrence of the rarest word, which may be the one they begin with.
            at = np.searchsorted(rarest, base)
            base = base[(at < len(rarest)) & (rarest[np.minimum(at, len(rarest) - 1)] < base + width)]
            doc = self.document(base)
            last = np.minimum(base + width, self.starts[doc] + self.lengths[doc]) - 1
            for got in lists[:k] + lists[k + 1 :]:
                at = np.searchsorted(got, base)
                held = (at < len(got)) & (got[np.minimum(at, len(got) - 1)] <= last)
                base, last = base[held], last[held]
            out.append(base)
        return np.sort(np.concatenate(out))


def by_document(docs: np.ndarray, values: list, n: int, kind: pa.DataType) -> pa.Array:
    """Values of ascending documents as one list per document."""
    ends = np.searchsorted(docs, np.arange(n + 1), side="left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def search(index: DataFrame, block: Block, width: int, every: bool) -> DataFrame:
    """Per document (with ``every``, of those without any match too): words, hit positions, items, items by nearness."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {w for words in block.near.values() for w in words}
        for batch in rows:
            for row in batch.to_pylist():
                s = Shard(row)
                n = len(s.ids)
                phrase, start = s.matches(block)
                doc = s.document(start)
                lengths = (block.phrases[phrase] >= 0).sum(1)
                place = np.repeat(start - s.starts[doc], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                hits = np.unique(np.c_[np.repeat(doc, lengths), place], axis=0)
                first, last = (np.searchsorted(block.owners[:, 0], phrase, side=x) for x in ("left", "right"))
                items = sorted({(d, block.items[i]) for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True) for i in block.owners[a:b, 1].tolist()})
                number = {t: i for i, t in enumerate(s.terms) if t in wanted} if wanted else {}
                near = sorted({(d, name) for name, words in block.near.items() for d in s.document(s.near(words, width, number)).tolist()})
                text = pa.string()
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array([s.name] * n),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(s.ids, pa.int64()),
                        pa.array(s.lengths),
                        by_document(hits[:, 0], hits[:, 1].astype(np.int32), n, pa.int32()),
                        *(by_document(np.array([d for d, _ in x], np.int64), [v for _, v in x], n, text) for x in (items, near)),
                    ],
                    names=["shard", "place", "doc_id", "n_words", "hits", "items", "near_items"],
                )
                if not every:
                    some = np.zeros(n, bool)
                    some[np.concatenate([doc, np.array([d for d, _ in near], np.int64)])] = True
                    out = out.filter(pa.array(some))
                yield out

    return index.mapInArrow(find, FOUND)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, near_terms: int = 3, near_width: int = 12) -> DataFrame:
    """Exact and proximity matches of every benchmark item in every whole document.

    Returns doc_id, n_words, hits (positions of words inside an exact window), items (item_ids with an exact window),
    near_items (items of which the ``near_terms`` longest words stand in one stretch of ``near_width`` words).
    Null and empty texts have no words; an item of fewer words than a window is one window; items without words match
    nothing.  A very long text is indexed whole, in a shard of its own size; a very long item may go over several blocks.
    Ties: a window that several items hold counts for all of them; of words of equal length the first by bytes are the
    longest.  Rows that repeat a doc_id come back one by one; items that repeat an item_id are one item.  No items or no
    documents: no matches, or no rows.  Other columns are ignored.

    The benchmark is taken in blocks of BLOCK_WORDS windows, so what is sent to the executors has a bound; one block,
    the usual case, needs no shuffle.  The corpus is read once, and its index once for every block.
    """
    index = materialise(build_index(documents, max(window, near_width) + 1), "index", compression="zstd")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes(benchmark).alias("text"))
    asked = blocks(((r["item_id"], r["text"] and bytes(r["text"])) for r in rows.toLocalIterator()), window, near_terms)
    block, following = next(asked), next(asked, None)
    if following is None:
        return needs(search(index, block, near_width, True).drop("shard", "place"), index)
    parts = []
    while block is not None:
        parts.append(materialise(search(index, block, near_width, False), "found"))
        block, following = following, next(asked, None)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    lists = ("hits", "items", "near_items")
    merged = found.groupBy("shard", "place").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists))
    every = index.select("shard", F.posexplode("ids").alias("place", "doc_id"), "lengths")
    little = F.reverse(F.substring("lengths", F.col("place") * 8 + 1, 8))  # little-endian
    every = every.select("shard", "place", "doc_id", F.conv(F.hex(little), 16, 10).cast("long").alias("n_words"))
    nothing = {"hits": "array<int>", "items": "array<string>", "near_items": "array<string>"}
    out = every.join(merged, ["shard", "place"], "left").select(
        "doc_id", "n_words", *(F.coalesce(F.col(c), F.array().cast(k)).alias(c) for c, k in nothing.items())
    )
    return needs(out, index, *parts)


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Digest of find_contamination: counts, the sha256 of the sorted item_ids joined by commas, and n_near, the items that stand
    near."""
    found = find_contamination(documents, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )
