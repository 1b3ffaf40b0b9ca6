"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihood by the scaled forward recursion.

The hidden states emit symbols: each word frequent in training is a symbol (at most ``max_symbols``, so that the
model's size is bounded whatever the corpus), and each rarer or unseen word is emitted through one of ``classes``
classes, by its last three bytes.  A word w of class s then has P(w | state) = P(s | state) * P(w | s), with P(w | s)
its add-one share among the training words of the class and one place for unseen words.  The second factor needs
counts of an unbounded vocabulary and comes from a join; the first from the recursion.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import crc_mod, materialise, space_words, text_bytes

END = b"\n"  # no word holds white space, so the end of a text is told apart from any word
SPAN = 512  # texts are worked on in spans of so many symbols side by side; the recursions run through from span to span
GROUP = 300_000  # symbols that are worked on at a time


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(rows: Iterator[pa.RecordBatch], classes: int, flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of words and ends; a new part starts whenever the dictionary is large."""

    def out(c: Counter) -> pa.RecordBatch:
        words = list(c)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()),
                pa.array([word_class(w, classes) for w in words], pa.int32()),
                pa.array(list(c.values()), pa.int64()),
            ],
            names=["word", "cls", "c"],
        )

    seen: Counter = Counter()
    for batch in rows:
        for text in batch.column(0):
            seen.update(space_words(text.as_py()))
            seen[END] += 1
            if len(seen) > flush:
                yield out(seen)
                seen = Counter()
    if seen:
        yield out(seen)


def encode(rows: Iterator[pa.RecordBatch], symbols: dict[bytes, int], classes: int, code: str) -> Iterator[pa.RecordBatch]:
    """Per document: its symbols as little-endian integers, and its words outside the symbol table with their counts."""
    top = len(symbols)
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, held, syms, rare = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(syms, pa.binary()), pa.array(rare, kind)],
            names=["doc_id", "held_out", "syms", "rare"],
        )

    for batch in rows:
        part, size = [], 0
        for doc, held, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = space_words(text.as_py())
            words.append(END)
            got = [symbols.get(w, -1) for w in words]
            rare: Counter = Counter()
            if -1 in got:
                for i, s in enumerate(got):
                    if s < 0:
                        rare[w := words[i]] += 1
                        got[i] = top + word_class(w, classes)
            part.append(
                (doc.as_py(), held.as_py(), np.array(got, code).tobytes(), [{"word": w, "n": n} for w, n in rare.items()])
            )
            size += len(got)
            if size > 500_000:
                yield out(part)
                part, size = [], 0
        if part:
            yield out(part)


@dataclass
class Spans:
    """Texts cut into spans, the longest first: a padded table of symbols, lengths, and the span before each (-1: none)."""

    table: np.ndarray
    lens: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray], size: int = SPAN) -> Spans:
        pieces = np.array([-(-len(t) // size) for t in texts])
        lens = np.concatenate([np.minimum(size, len(t) - np.arange(0, len(t), size)) for t in texts])
        starts = np.cumsum(lens) - lens
        before = np.arange(-1, len(lens) - 1)
        before[np.cumsum(pieces) - pieces] = -1
        order = np.argsort(-lens, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.where(before < 0, -1, place[before])[order]
        flat = np.concatenate(texts)
        at = np.minimum(starts[order][:, None] + np.arange(lens.max()), len(flat) - 1)
        return Spans(flat[at], lens[order], before)


def in_groups(batch: pa.RecordBatch, column: int, code: str, most: int = GROUP) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """(Rows, their symbols) of a batch, in groups of about ``most`` symbols."""
    texts: list[np.ndarray] = []
    size = start = 0
    for i, x in enumerate(batch.column(column)):
        texts.append(np.frombuffer(x.as_py(), code))
        size += len(texts[-1])
        if size >= most:
            yield slice(start, i + 1), texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield slice(start, start + len(texts)), texts


class Hmm:
    """pi (K), trans (K x K) and emit (symbols x K), all probabilities."""

    def __init__(self, pi: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> None:
        self.pi, self.trans, self.emit = (x.astype(np.float64) for x in (pi, trans, emit))

    @staticmethod
    def start(share: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """Each state starts from the words' shares, tilted at random; states tend to stay."""
        tilt = np.random.default_rng(seed).random((len(share), states))
        emit = share[:, None] * (0.25 + tilt)
        trans = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), trans, emit / emit.sum(0))

    def ends(self, s: Spans) -> tuple[np.ndarray, np.ndarray]:
        """For each span, the states' law before its first symbol, and how likely what follows it is by its last state.

        Each span of a text of several is one matrix, a product over its symbols; the laws go through the matrices of a
        text from the first on, the likelihoods from the last.  Each is exact but for a factor of its own.
        """
        k = len(self.pi)
        enter, leave = np.tile(self.pi, (len(s.lens), 1)), np.ones((len(s.lens), k))
        many = np.flatnonzero(s.before >= 0)
        if not len(many):
            return enter, leave
        several = np.unique(np.r_[many, s.before[many]])  # ascending: the longest first
        row = np.full(len(s.lens), -1)
        row[several] = np.arange(len(several))
        lens, emit, trans = s.lens[several], self.emit.astype(np.float32), self.trans.astype(np.float32)
        product = np.tile(np.eye(k, dtype=np.float32), (len(several), 1, 1))
        for t in range(int(lens[0])):
            n = int(np.searchsorted(-lens, -t, side="left"))
            p = product[:n] @ trans if t else product[:n]
            p = p * emit[s.table[several[:n], t]][:, None, :]
            product[:n] = p / p.sum((1, 2), keepdims=True)
        after = np.full(len(s.lens), -1)
        after[s.before[many]] = many
        now = np.setdiff1d(s.before[many], many)  # the first span of each such text
        chain = []
        while len(now):
            chain.append(now)
            to = after[now]
            now, to = now[to >= 0], to[to >= 0]
            v = np.einsum("ni,nij->nj", enter[now], product[row[now]]) @ self.trans
            enter[to] = v / v.sum(1, keepdims=True)
            now = to
        for now in reversed(chain[1:]):
            v = np.einsum("nij,nj->ni", product[row[now]], leave[now]) @ self.trans.T
            leave[s.before[now]] = v / v.sum(1, keepdims=True)
        return enter, leave

    def expected(self, s: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, transitions and emissions over whole texts, given in spans."""
        k, n_sym, table = len(self.pi), len(self.emit), s.table
        emit, trans = self.emit.astype(np.float32), self.trans.astype(np.float32)
        enter, leave = (x.astype(np.float32) for x in self.ends(s))
        steps = int(s.lens[0])
        live = np.searchsorted(-s.lens, -np.arange(steps), side="left").tolist()
        forward, scale, seen = [], [], []
        for t, n in enumerate(live):
            seen.append(emit[table[:n, t]])
            a = (enter if t == 0 else forward[-1][:n] @ trans) * seen[-1]
            total = a.sum(1, keepdims=True)
            forward.append(a / total)
            scale.append(total)
        last = np.empty((len(s.lens), k), np.float32)  # each span's forward law at its last symbol
        for t, n in enumerate(live):
            end = live[t + 1] if t + 1 < steps else 0
            last[end:n] = forward[t][end:n]
        leave /= (last * leave).sum(1, keepdims=True)
        moves = np.zeros((k, k))
        counts = np.zeros((n_sym, k))
        gammas = [None] * steps
        back = leave[: live[-1]]
        for t in range(steps - 1, -1, -1):
            gammas[t] = forward[t] * back
            ahead = seen[t] * back / scale[t]
            if t:
                moves += self.trans * (forward[t - 1][: live[t]].T @ ahead)
                back = leave[: live[t - 1]].copy()
                back[: live[t]] = ahead @ trans.T
        over = s.before >= 0
        moves += self.trans * (last[s.before[over]].T @ ahead[over])
        flat = np.concatenate([table[:n, t] for t, n in enumerate(live)])
        gamma = np.concatenate(gammas)
        for j in range(k):
            counts[:, j] = np.bincount(flat, gamma[:, j], n_sym)
        return gammas[0][~over].sum(0, dtype=np.float64), moves, counts

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each text: scaled forward recursion, all texts side by side."""
        lens = np.array([len(t) for t in texts])
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        flat = np.concatenate([texts[i] for i in order])
        starts = np.cumsum(lens) - lens
        live = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left")  # texts longer than t
        total = np.zeros(len(texts))
        a = self.pi * self.emit[flat[starts]]
        for t in range(int(lens[0])):
            n = live[t]
            if t:
                a = (a[:n] @ self.trans) * self.emit[flat[starts[:n] + t]]
            s = a.sum(1)
            a /= s[:, None]
            total[:n] += np.log10(s)
        out = np.empty(len(texts))
        out[order] = total
        return out


def baum_welch(coded: DataFrame, share: np.ndarray, states: int, rounds: int, code: str) -> Hmm:
    """Expectation in tasks, partial counts summed by symbol, maximisation on the bounded tables of the model."""
    model, n_sym = Hmm.start(share, states), len(share)
    schema = "sym int, " + ", ".join(f"c{j} float" for j in range(states))  # partial counts; their sums are doubles
    train = coded.where("NOT held_out").select("syms")
    for _ in range(rounds):

        def step(rows: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            first, moves, counts = np.zeros(states), np.zeros((states, states)), np.zeros((n_sym, states))
            for batch in rows:
                for _, texts in in_groups(batch, 0, code):
                    for total, more in zip((first, moves, counts), model.expected(Spans.of(texts)), strict=True):
                        total += more
            at = np.flatnonzero(counts.any(1))
            # Rows -1 and below hold first states and transitions.
            syms = np.concatenate([at, [-1], -2 - np.arange(states)]).astype(np.int32)
            rows_out = np.concatenate([counts[at], first[None], moves])
            yield pa.RecordBatch.from_arrays(
                [pa.array(syms), *(pa.array(rows_out[:, j].astype(np.float32)) for j in range(states))],
                names=["sym", *(f"c{j}" for j in range(states))],
            )

        sums = (
            train.mapInArrow(step, schema)
            .groupBy("sym")
            .agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(states)))
            .toPandas()  # at most one row per symbol of the bounded model
            .sort_values("sym")
        )
        table, at = sums.iloc[:, 1:].to_numpy(), sums["sym"].to_numpy()
        counts = share[:, None] * np.full(states, 50.0)  # emissions are smoothed towards the corpus' shares
        counts[at[at >= 0]] += table[at >= 0]
        first = np.full(states, 1.0)
        moves = np.eye(states) + 0.1
        if (at < 0).any():
            first += table[at == -1][0]
            moves += table[(at < -1)][::-1]
        model = Hmm(first / first.sum(), moves / moves.sum(1, keepdims=True), counts / counts.sum(0))
    return model


def hmm_scores(
    documents: DataFrame,
    *,
    folds: int = 7,
    held: int = 2,
    states: int = 6,
    rounds: int = 4,
    max_symbols: int = 63_000,
    classes: int = 2_048,
) -> DataFrame:
    """Score whole texts by a hidden Markov model trained on the whole documents outside the held-out fold.

    Words are runs outside ASCII white space after lower-casing A-Z, followed by one end.  A null or empty text is one
    end.  A null doc_id counts as the empty text in the fold's hash and keeps its row; rows that repeat an id are
    scored one by one.  Very long texts are learned from and scored whole, in groups of bounded size.  Ties in counts
    change no result: words of equal counts are symbols or not together.  An empty table gives an empty result; with no
    training rows every word is unseen.  Other columns are ignored.  Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    code = "<u2" if max_symbols + 1 + classes <= 1 << 16 else "<u4"
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_mod("doc_id", folds) == held).alias("held_out"),
        text_bytes(documents).alias("text"),
    )
    parts = docs.where("NOT held_out").select("text").mapInArrow(
        lambda rows: count_words(rows, classes), "word binary, cls int, c long"
    )
    counts = materialise(parts.groupBy("word", "cls").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The symbol table: the most frequent words, by steps of a sixteenth of a binary order of their counts, as many
    # whole steps as max_symbols has room for; words of one count are no symbols.
    order = F.floor(16 * F.log2("c")).cast("int")
    steps = counts.where("c > 1").groupBy(order.alias("step")).agg(F.count("*").alias("n")).collect()  # 1,008 at most
    room, least = max_symbols, 1_009
    for step, n in sorted(((r["step"], r["n"]) for r in steps), reverse=True):
        if n > room:
            break
        room, least = room - n, step
    frequent = (F.col("c") > 1) & (order >= least)
    top = counts.where(frequent & (F.col("word") != F.lit(END))).select("word", "c").collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    ends = counts.where(F.col("word") == F.lit(END)).first()
    symbols = {END: 0} | {bytes(r["word"]): i for i, r in enumerate(top, 1)}
    known = np.array([ends["c"] if ends else 0, *(r["c"] for r in top)], float)
    rare = counts.where(~frequent & (F.col("word") != F.lit(END)))
    by_class = np.zeros((classes, 2))
    for r in rare.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        by_class[r["cls"]] = r["c"], r["v"]
    size = len(symbols) + classes
    share = (np.concatenate([known, by_class[:, 0]]) + 1) / (total + size)

    coded = materialise(
        docs.mapInArrow(
            lambda rows: encode(rows, symbols, classes, code),
            "doc_id long, held_out boolean, syms binary, rare array<struct<word: binary, n: int>>",
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "coded",
    )
    model = baum_welch(coded, share, states, rounds, code)

    floor = float(np.log10(total + distinct + 1))
    base = np.concatenate([np.log10(known + 1) - floor, np.zeros(classes)])
    is_known = np.concatenate([known > 0, np.zeros(classes, bool)])

    def forward(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at, texts in in_groups(batch, 2, code):
                part = batch.slice(at.start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in (0, 1, 3)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([int(is_known[t].sum()) for t in texts], pa.int64()),
                        pa.array([float(base[t].sum()) for t in texts], pa.float64()),
                        pa.array(model.log10(texts), pa.float64()),
                    ],
                    names=["doc_id", "held_out", "row_id", "n_tokens", "n_top", "base_top", "hmm"],
                )

    scored = coded.select("doc_id", "held_out", "syms", "row_id").mapInArrow(
        forward,
        "doc_id long, held_out boolean, row_id long, n_tokens long, n_top long, base_top double, hmm double",
    )
    # Rare words: (document, word) pairs meet the words' counts; sums come back per document.
    pairs = coded.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.n")
    stats = documents.sparkSession.createDataFrame(
        [(i, float(c), float(v)) for i, (c, v) in enumerate(by_class.tolist())], "cls int, class_c double, class_v double"
    )
    within = (
        rare.join(F.broadcast(stats), "cls")
        .select("word", F.col("c").alias("got"), (F.log10(F.col("c") + 1) - F.log10(F.col("class_c") + F.col("class_v") + 1)).alias("lp"))
    )
    last3 = F.crc32(F.substring("word", -3, 3)) % classes
    unseen_stats = stats.select("cls", (-F.log10(F.col("class_c") + F.col("class_v") + 1)).alias("lp0"))
    looked = pairs.join(within.hint("shuffle_hash"), "word", "left").withColumn(
        "cls", F.when(F.length("word") < 3, F.crc32("word") % classes).otherwise(last3).cast("int")
    )
    sums = (
        looked.join(F.broadcast(unseen_stats), "cls")
        .groupBy("row_id")
        .agg(
            F.sum(F.when(F.col("got").isNotNull(), F.col("n")).otherwise(0)).alias("n_rare"),
            F.sum(F.col("n") * (F.log10(F.coalesce("got", F.lit(0)) + 1) - F.lit(floor))).alias("base_rare"),
            F.sum(F.col("n") * F.coalesce("lp", "lp0")).alias("within"),
        )
    )
    zero = F.lit(0.0)
    return scored.join(sums, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", zero)).alias("base_score"),
        (F.col("hmm") + F.coalesce("within", zero)).alias("score"),
    )
