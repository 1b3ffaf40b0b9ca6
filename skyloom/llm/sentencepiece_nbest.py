"""N-best segmentation over the piece lattice: forward Viterbi, then backward A* with the forward scores.

The lattice's nodes are places between characters, its edges pieces of the model; a path's score is the sum of its
pieces' scores.  The forward pass gives every node the best score of any path to it.  The backward search starts at the
end and always extends the hypothesis of greatest (score so far + forward score of its node); as the forward scores are
exact, hypotheses come out in order of their scores, and the first n to reach the start are the n best.

The backward search runs on the n - 1 chunks that can change in a text's n best (see text_n_best); all other chunks
stand in their best segmentation, which the forward pass has found, with the gap to the second best.

No piece crosses a place where a run of space marks begins (nor, in most vocabularies, where signs meet letters), so a
text's lattice falls apart into chunks there: each distinct chunk is searched once, and a text's n best are the n best
sums over its chunks.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_bytes, worker_cache

SPACE = "▁"
SIGNS = r"\x00-\x40\x5b-\x60\x7b-\x7f"
BYTE_PENALTY = 10.0  # what a character outside the vocabulary loses to the worst piece, per byte


def chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Where any text may be cut, as no piece of this vocabulary goes across.

    Space marks stand at the head of pieces only; and where no piece joins a sign (an ASCII character that is no
    letter) with anything else, runs of signs stand by themselves.
    """
    bare = [x.lstrip(SPACE) for x in pieces]
    if any(SPACE in x for x in bare):
        return re.compile("(?s).+")
    if any(re.search(f"[{SIGNS}]", x) and re.search(f"[^{SIGNS}]", x) for x in bare):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*[^{SPACE}{SIGNS}]+|{SPACE}*[{SIGNS}]+|{SPACE}+")


@dataclass
class Pieces:
    """The vocabulary of a SentencePiece model file, by path."""

    path: str
    ids: dict[str, int] = field(default_factory=dict)
    scores: list[float] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    bytes_: list[int] = field(default_factory=list)
    trie: dict = field(default_factory=dict)  # characters to nodes, '' to the id of the piece that ends here
    longest: int = 1
    joined: re.Pattern | None = None
    unknown_score: float = 0.0

    @staticmethod
    def load(path: str) -> Pieces:
        cache = worker_cache("pieces")
        if path not in cache:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            p, n = Pieces(path), model.get_piece_size()
            p.names = [model.id_to_piece(i) for i in range(n)]
            p.scores = [model.get_score(i) for i in range(n)]
            p.bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
            special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
            p.ids = {x: i for i, x in enumerate(p.names) if i not in special}
            p.longest = max(map(len, p.ids))
            p.joined = chunk_pattern(p.ids)
            for x, i in p.ids.items():
                node = p.trie
                for c in x:
                    node = node.setdefault(c, {})
                node[""] = i
            p.unknown_score = min(s for i, s in enumerate(p.scores) if i not in special and s > -1e8) - BYTE_PENALTY
            cache[path] = p
        return cache[path]

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trie as sorted keys (node, character), the node each leads to, and the piece that ends there or -1."""
        keys, to, piece, todo, n = [], [], [], [(0, self.trie)], 1
        while todo:
            at, node = todo.pop()
            for c, child in node.items():
                if c:
                    keys.append(at << 21 | ord(c))
                    to.append(n)
                    piece.append(child.get("", -1))
                    todo.append((n, child))
                    n += 1
        order = np.argsort(keys)
        return np.array(keys, np.int64)[order], np.array(to, np.int64)[order], np.array(piece, np.int32)[order]

    @cached_property
    def score_of(self) -> np.ndarray:
        """Scores of the pieces; the last one, for -1, is that of no piece."""
        return np.array([*self.scores, float("-inf")])

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for in UTF-8, space marks being spaces; a byte piece is its byte, a special piece nothing."""
        out = [b""] * len(self.names)
        for x, i in self.ids.items():
            out[i] = x.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids (little-endian int32), without the leading space that encoding adds."""
        return b"".join(map(self.spelled.__getitem__, array("i", ids))).removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(array("i", ids).tobytes()).decode("utf-8", "replace")


Edge = tuple[int, int, float, tuple[int, ...]]  # start, end, score, ids


def edges_into(p: Pieces, text: str, end: int) -> list[Edge]:
    """The edges that end at a place, the longest first.  A character that is no piece itself may go as its UTF-8 bytes."""
    ids, scores, out, i = p.ids, p.scores, [], None
    for start in range(max(0, end - p.longest), end):
        i = ids.get(text[start:end])
        if i is not None:
            out.append((start, end, scores[i], (i,)))
    if i is None:
        raw = text[end - 1].encode("utf-8", "replace")
        out.append((end - 1, end, p.unknown_score * len(raw), tuple(p.bytes_[b] for b in raw)))
    return out


def forward(p: Pieces, text: str) -> Sequence[float]:
    """Viterbi: the best score of any path to each place."""
    n, trie, scores = len(text), p.trie, p.scores
    best = array("d", [0.0]) + array("d", [float("-inf")]) * n
    for start in range(n):
        so_far, node, end, alone = best[start], trie, start, False
        while end < n:
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            i = node.get("")
            if i is not None:
                alone = alone or end == start + 1
                if so_far + scores[i] > best[end]:
                    best[end] = so_far + scores[i]
        if not alone:
            v = so_far + p.unknown_score * len(text[start].encode("utf-8", "replace"))
            if v > best[start + 1]:
                best[start + 1] = v
    return best


def best_and_gap(p: Pieces, text: str) -> tuple[float, list[int], float | None]:
    """Best score and ids, and how much less the second best scores (None where there is one path only).

    The forward pass keeps the two best paths to each place, without the list of edges: this is the common case.
    """
    n, trie, scores, low = len(text), p.trie, p.scores, float("-inf")
    best, second = array("d", [0.0]) + array("d", [low]) * n, array("d", [low]) * (n + 1)
    came, by = array("q", [0]) * (n + 1), array("i", [0]) * (n + 1)
    for start in range(n):
        first, other, node, end = best[start], second[start], trie, start
        alone = False
        for c in text[start : start + p.longest]:
            node = node.get(c)
            if node is None:
                break
            end += 1
            i = node.get("")
            if i is not None:
                s = scores[i]
                v, u = first + s, other + s
                b = best[end]
                if v >= b:
                    second[end] = u if u > b else b
                    best[end], came[end], by[end] = v, start, i
                elif v > second[end]:
                    second[end] = v
                if end == start + 1:
                    alone = True
        if not alone:
            end, s = start + 1, p.unknown_score * len(text[start].encode("utf-8", "replace"))
            v, u, b = first + s, other + s, best[end := start + 1]
            if v >= b:
                second[end] = max(u, b)
                best[end], came[end], by[end] = v, start, -1
            else:
                second[end] = max(second[end], v)
    path, place = [], n
    while place:
        i = by[place]
        if i >= 0:
            path.append(i)
        else:
            path += [p.bytes_[b] for b in reversed(text[place - 1].encode("utf-8", "replace"))]
        place = came[place]
    path.reverse()
    return best[n], path, None if second[n] == low else best[n] - second[n]


STOP = 0x1FFFFF  # stands after each chunk; no character


def best_and_gaps(p: Pieces, chunks: list[str]) -> list[tuple[float, list[int], float | None]]:
    """best_and_gap of many chunks, of like lengths at best: one step of the forward pass for the same place of all."""
    keys, to, piece = p.steps
    size, m = np.array([len(c) for c in chunks], np.int64), len(chunks)
    most = int(size.max())
    longest = min(p.longest, most)
    grid = np.full((m, most + 1), STOP, np.int64)
    grid[np.arange(most + 1) < size[:, None]] = np.frombuffer("".join(chunks).encode("utf-32-le", "replace"), "<u4")
    chars = grid.T.ravel()  # by place, then chunk
    came_by = np.full((longest, (most + 1) * m), -1, np.int32)  # the piece of each length that ends at a place
    gain = np.full((longest, (most + 1) * m), -np.inf)
    letters = start = np.flatnonzero(chars != STOP)
    node = np.zeros(len(start), np.int64)
    for length in range(longest):
        key = node << 21 | chars[start + length * m]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[at] == key
        start, at = start[there], at[there]
        if not len(start):
            break
        end = start + (length + 1) * m
        came_by[length, end] = piece[at]
        gain[length, end] = p.score_of[piece[at]]
        node = to[at]
    lone = letters[came_by[0, letters + m] < 0]  # characters that are no piece go as bytes
    gain[0, lone + m] = p.unknown_score * (1 + (chars[lone, None] >= (0x80, 0x800, 0x10000)).sum(1))
    gain = gain.reshape(longest, most + 1, m)
    used = (gain > -np.inf).any(2)

    best, second, came = np.full((most + 1, m), -np.inf), np.full((most + 1, m), -np.inf), np.zeros((most + 1, m), np.int64)
    best[0] = 0.0
    for place in range(1, most + 1):
        for length in range(min(place, longest)):
            if used[length, place]:
                s, b, o = gain[length, place], best[place], second[place]
                v = best[place - length - 1] + s
                better = v > b  # among equals the shortest piece
                second[place] = np.where(better, np.maximum(second[place - length - 1] + s, b), np.maximum(o, v))
                came[place][better] = length
                np.maximum(b, v, out=b)

    paths = np.empty((m, most), np.int32)
    every = np.arange(m)
    count, place, live, spelled = np.zeros(m, np.int64), size.copy(), every, np.zeros(m, bool)
    while len(live):
        now = place[live]
        length = came[now, live]
        count[live] += 1
        i = paths[live, -count[live]] = came_by[length, now * m + live]
        spelled[live[i < 0]] = True
        place[live] = now - length - 1
        live = live[place[live] > 0]
    total, other = best[size, every], second[size, every]
    out = []
    for c, ids, k, t, o, own in zip(chunks, paths.tolist(), count.tolist(), total.tolist(), other.tolist(), spelled.tolist(), strict=True):
        ids = ids[most - k :]
        out.append((t, with_bytes(p, c, ids) if own else ids, None if o == float("-inf") else t - o))
    return out


def with_bytes(p: Pieces, chunk: str, ids: list[int]) -> list[int]:
    """-1 becomes the bytes of the character that stands there."""
    out, place = [], 0
    for i in ids:
        if i >= 0:
            out.append(i)
            place += len(p.names[i])
        else:
            out += [p.bytes_[b] for b in chunk[place].encode("utf-8", "replace")]
            place += 1
    return out


def n_best(p: Pieces, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """Up to n segmentations by falling score, by backward A*.  Among equal scores the order is always the same.

    A place is left n times at most, as the n best paths use n of the ends from there at most: so ties cost no more than
    n visits of each place, and a long text needs no table of all its edges.
    """
    best = forward(p, text)
    found: list[tuple[float, tuple[int, ...]]] = []
    left: Counter = Counter()
    serial = 0
    heap = [(-best[-1], 0, len(text), 0.0, None)]
    while heap and len(found) < n:
        _, _, place, score, tail = heapq.heappop(heap)
        if place == 0:
            ids = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            found.append((score, tuple(ids)))
            continue
        left[place] += 1
        if left[place] <= n:
            for start, _, s, ids in edges_into(p, text, place):
                serial -= 1  # the newest first among equals: the search goes deep, as the Viterbi path does
                heapq.heappush(heap, (-(score + s + best[start]), serial, start, score + s, (ids, tail)))
    return found


class Chunks:
    """What is known of chunks: best score, its ids as bytes, gap to the second best; and n best lists of some.

    Each is kept in two generations of about ``most_bytes`` at most: when the young one is full, it becomes the old one,
    whose entries come back as they are asked for.  Chunks of over ``long`` characters are not kept.
    """

    def __init__(self, p: Pieces, n: int, most_bytes: int = 48 << 20, long: int = 1_000) -> None:
        self.p, self.n, self.most_bytes, self.long = p, n, most_bytes, long
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.size = 0

    def all(self, parts: list[str]) -> list[tuple]:
        got = list(map(self.young.get, parts))
        if None in got:
            for i, e in enumerate(got):
                if e is None:
                    got[i] = self.find(parts[i])
        return got

    def find(self, chunk: str) -> tuple:
        e = self.young.get(chunk)
        if e is None:
            e = self.old.get(chunk)
            e = self.keep(chunk, e or entry(*best_and_gap(self.p, chunk)))
        return e

    def keep(self, chunk: str, e: tuple) -> tuple:
        if len(chunk) <= self.long:
            if self.size >= self.most_bytes:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = e
            self.size += ENTRY_BYTES + 4 * len(chunk) + len(e[1])
        return e

    def learn(self, texts: list[list[str]], cells: int = 8_000, long: int = 64) -> None:
        """Search the new chunks of some texts together; long ones wait until their text's turn."""
        new = set().union(*texts).difference(self.young)
        again = [(c, e) for c in new if (e := self.old.get(c)) is not None]  # before any is kept, which may drop the old
        for c, e in again:
            self.keep(c, e)
            new.discard(c)
        short = sorted((c for c in new if len(c) <= long), key=len)
        while short:
            part = short[-max(1, cells // len(short[-1])) :]
            del short[-len(part) :]
            for c, found in zip(part, best_and_gaps(self.p, part), strict=True):
                self.keep(c, entry(*found))

    def n_best(self, chunk: str) -> list[tuple[float, Sequence[int]]]:
        """The n best of a chunk, the first being the one that ``find`` has, so that ties never give one path twice."""
        e = self.find(chunk)
        if len(e) == 3:
            top = (e[0], tuple(np.frombuffer(e[1], "<i4").tolist()))
            found = [top, *(x for x in n_best(self.p, chunk, self.n) if x[1] != top[1])][: self.n]
            e = self.keep(chunk, (*e, [(s, array("i", ids)) for s, ids in found]))
            self.size += len(chunk) <= self.long and 4 * ENTRY_BYTES
        return e[3]


ENTRY_BYTES = 300  # of Python objects about an entry, but for its characters and ids


def entry(score: float, ids: list[int], gap: float | None) -> tuple:
    return score, array("i", ids).tobytes(), float("inf") if gap is None else gap


def best_sums(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one option from each list (each falling): best-first over ranks, every choice made once."""
    top = sum(o[0] for o in options)
    heap, out = [(-top, (0,) * len(options), 0)], []
    while heap and len(out) < n:
        score, ranks, last = heapq.heappop(heap)
        out.append((-score, ranks))
        for i in range(last, len(options)):
            if ranks[i] + 1 < len(options[i]):
                new = -score - options[i][ranks[i]] + options[i][ranks[i] + 1]
                heapq.heappush(heap, (-new, (*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]), i))
    return out


def text_parts(p: Pieces, text: str) -> list[str]:
    """The chunks of a text as it is encoded: a space before it, spaces as marks."""
    return p.joined.findall(SPACE + text.replace(" ", SPACE)) if text else []


def text_n_best(chunks: Chunks, parts: list[str], n: int) -> tuple[list[tuple[float, dict[int, int]]], Sequence[bytes]]:
    """n best of a whole text, given in chunks: (score, {chunk's place: rank in that chunk's list, where not the best}) each.

    A hypothesis other than the best gives up at least a gap in every chunk it changes; so the n best change only
    chunks among those of the n - 1 smallest gaps.  Also the chunks' best ids.
    """
    if not parts:
        return [(0.0, {})], []
    found = chunks.all(parts)
    scores, ids, left = [e[0] for e in found], [e[1] for e in found], np.array([e[2] for e in found])
    total, at = sum(scores), []
    while len(at) < n - 1 and left[i := int(left.argmin())] < np.inf:
        at.append(i)
        left[i] = np.inf
    options = [[s - scores[i] for s, _ in chunks.n_best(parts[i])] for i in at]
    best = [(total + s, {i: r for i, r in zip(at, ranks, strict=True) if r}) for s, ranks in best_sums(options, n)]
    return best, ids


def segmentations(chunks: Chunks, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a text, as scores and ids."""
    parts = text_parts(chunks.p, text)
    found, best = text_n_best(chunks, parts, n)
    out = []
    for score, changed in found:
        ids: list[int] = []
        for i, raw in enumerate(best):
            r = changed.get(i)
            ids += np.frombuffer(raw, "<i4").tolist() if r is None else chunks.n_best(parts[i])[r][1]
        out.append((score, ids))
    return out


def in_groups(p: Pieces, chunks: Chunks, batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[int | None, bytes, str, list[str]]]:
    """(doc_id, text, chunks) of each row; the new chunks of about ``most`` characters are searched together."""
    group, size = [], 0
    for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
        raw = raw.as_py() or b""
        text = raw.decode("utf-8", "replace")
        group.append((doc.as_py(), raw, text, text_parts(p, text)))
        size += len(text)
        if size >= most:
            chunks.learn([parts for *_, parts in group])
            yield from group
            group, size = [], 0
    chunks.learn([parts for *_, parts in group])
    yield from group


def encode_n_best(documents: DataFrame, model_path: str, *, n: int = 3, with_ids: bool = False) -> DataFrame:
    """Segment whole texts; decode the best segmentation back and compare.

    Returns doc_id, n_chars, n_pieces (of the best), scores (up to n, falling), ids_crc32 (of the best ids as
    little-endian int32), changed (chunks in which the second best differs), round_trip (the best ids decode to the
    text's very bytes); ids with ``with_ids``.  Spaces are kept as they are, a leading one is added in encoding and taken
    off in decoding.  Null and empty texts have no pieces, one segmentation of score 0 and no ids.  Long texts, and long
    runs without any place to cut, are searched whole, in memory in proportion to their length.  Ties: the best
    segmentation has the shortest last pieces; others of equal scores come in one fixed order.  A literal U+2581 reads as
    a space and so does not survive the round trip (false); nor do bytes that are no UTF-8.  Repeated rows and null ids
    stay row by row; an empty table gives an empty result.  Other columns are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.load(model_path)
        chunks = worker_cache("chunks").setdefault((model_path, n), Chunks(p, n))
        for batch in rows:
            out = []
            for doc, raw, text, parts in in_groups(p, chunks, batch):
                found, best = text_n_best(chunks, parts, n)
                ids = b"".join(best)
                out.append(
                    (
                        doc,
                        len(text),
                        len(ids) // 4,
                        [s for s, _ in found],
                        zlib.crc32(ids),
                        len(found[1][1]) if len(found) > 1 else 0,
                        p.decode_bytes(ids) == raw,
                        ids if with_ids else None,
                    )
                )
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 3 + [pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "n_chars", "n_pieces", "scores", "ids_crc32", "changed", "round_trip", "ids"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(documents).alias("text"))
    schema = "doc_id long, n_chars long, n_pieces long, scores array<double>, ids_crc32 long, changed long, round_trip boolean, ids binary"
    out = rows.mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Decode a column of ids (little-endian int32 as binary) to texts; null ids give a null text.  All columns stay."""

    @F.pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        p = Pieces.load(model_path)
        return col.map(lambda x: None if x is None else p.decode_bytes(x).decode("utf-8", "replace"))

    return encoded.withColumn(out, decode(ids))
