"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, each of four orders, by absolute discounting:
- bigrams, by the number of a class's distinct texts that hold them, back off to
- the class's words, by continuation counts (distinct left neighbours), these to
- the class's stems, a word's first letters, by the continuation counts of their words, and these to
- the continuation counts of both classes together, which also share a stem's probability out among its words.
A count up to the discount leaves all its mass to the order below.  So rare expressions are smoothed by shared counts,
and the models can be kept whole as few entries: where no count is over its discount, the log ratio of the two classes
is the sum of those of the context's backoff mass and of the word's lower order.  Copies of a text count once.

A text's log-likelihoods are compared after normalisation by length: over the whole text, and over its most toxic
span of a few tokens, since a long text may be toxic in one line; the text's length goes along, as a long text has more
spans.  A logistic curve turns these into a probability.  It is fitted to ratios by models that have not seen the texts'
own part of the labelled rows; the final models have seen all parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm.common import crc_mod, discard, materialise, plain_words, text_bytes

START = b"^"
BIGRAM, WORD, STEM, SHARED = 4.0, 4.0, 8.0, 0.75  # discounts of the orders
LETTERS = 5  # of a stem


def expressions(text: bytes | None) -> list[bytes]:
    """Words of a text, a run of one word counting once."""
    return [w for w, _ in groupby(plain_words(text))]


def stem(word: bytes) -> bytes:
    return word.decode("utf-8", "replace")[:LETTERS].encode()


@dataclass
class Counts:
    """What two models are made of.  Pairs are of the classes ordinary and toxic.

    Tables may lack entries that the discounts leave without mass of their own: bigrams and contexts where no bigram is
    over the discount, words that are neither over it nor in such a bigram, and stems of no such word and not over theirs.
    """

    total: list[int]  # continuation counts of a class, and of both together
    mass: list[float]  # of words, the share of continuation counts that their discount leaves to stems
    stem_mass: list[float]  # the same of stems
    stems: int = 0
    discounts: tuple[float, float, float] = (BIGRAM, WORD, STEM)
    bigrams: dict[tuple[bytes, bytes], tuple[int, int]] = field(default_factory=dict)
    contexts: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)  # texts of all its bigrams, and what their discounts take
    words: dict[bytes, tuple[int, int, int]] = field(default_factory=dict)  # continuation counts: ordinary, toxic, both
    stem_words: dict[bytes, tuple[int, int, int, int]] = field(default_factory=dict)  # the same, and number of words

    def p_stem(self, s: bytes, y: int) -> float:
        c = self.stem_words.get(s)
        shared = SHARED * self.stems / self.total[2] if c is None else (c[2] - SHARED) / self.total[2]
        return (max(c[y] - self.discounts[2], 0) if c else 0) / self.total[y] + self.stem_mass[y] * shared

    def p_word(self, w: bytes, y: int) -> float:
        c, s = self.words.get(w), self.stem_words.get(stem(w))
        inside = 1.0 if s is None else (c[2] - SHARED) / s[2] if c else SHARED * s[3] / s[2]  # a new word has what the others leave
        return (max(c[y] - self.discounts[1], 0) if c else 0) / self.total[y] + self.mass[y] * self.p_stem(stem(w), y) * inside

    def p(self, left: bytes, w: bytes, y: int) -> float:
        """P(w | left) of class y."""
        c = self.contexts.get(left)
        if c is None or not c[y][0]:
            return self.p_word(w, y)
        own = self.bigrams.get((left, w), (0, 0))[y]
        return (max(own - self.discounts[0], 0) + c[y][1] * self.p_word(w, y)) / c[y][0]

    def model(self) -> KneserNey:
        ratio = lambda p: float(np.log(p(1) / p(0)))
        new = ratio(lambda y: self.mass[y] * self.stem_mass[y])
        stems = {s: ratio(lambda y: self.mass[y] * self.p_stem(s, y)) for s, c in self.stem_words.items() if max(c[:2]) > self.discounts[2]}
        words = {w: ratio(lambda y: self.p_word(w, y)) for w in self.words}
        left = {v: ratio(lambda y: c[y][1] / c[y][0] if c[y][0] else 1.0) for v, c in self.contexts.items() if all(x[1] or not x[0] for x in c)}
        pairs = {v + b" " + w: ratio(lambda y: self.p(v, w, y)) for v, w in self.bigrams}
        return KneserNey(pairs, words, stems, left, new)


@dataclass
class KneserNey:
    """log ratios toxic : ordinary of bigrams, words and stems, and of what contexts leave to lower orders."""

    bigrams: dict[bytes, float]
    words: dict[bytes, float]
    stems: dict[bytes, float]
    contexts: dict[bytes, float]
    new: float

    def sent(self, spark: SparkSession) -> Broadcast:
        """Its tables at every executor, where a worker unpacks them once for all its tasks; the training rows bound them."""
        return spark.sparkContext.broadcast((self.bigrams, self.words, self.stems, self.contexts, self.new))

    def word(self, w: bytes) -> float:
        r = self.words.get(w)
        return self.stems.get(stem(w), self.new) if r is None else r

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word given the one before."""
        bi, uni, left = self.bigrams, self.words, self.contexts
        prev, out = START, []
        for w in words:
            r = bi.get(prev + b" " + w)
            if r is None:
                r = uni.get(w)
                if r is None:
                    r = self.word(w)
                r += left.get(prev, 0.0)
            out.append(r)
            prev = w
        return np.array(out)


def features(model: KneserNey, words: list[bytes], span: int) -> tuple[float, float, float]:
    """Length-normalised log ratio of the whole text and of its most toxic span (shorter texts: over ``span`` too); log length."""
    if not words:
        return 0.0, 0.0, 0.0
    r = model.ratios(words)
    total = np.concatenate([[0.0], np.cumsum(r)])
    top = (total[span:] - total[:-span]).max() if len(r) > span else total[-1]
    return float(total[-1] / len(r)), float(top / span), float(np.log1p(len(r)))


def normal_texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = [b" ".join(expressions(t.as_py())) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *batch.columns[1:]], names=batch.schema.names)


def bigram_texts(rows: Iterator[pa.RecordBatch], flush: int = 100_000) -> Iterator[pa.RecordBatch]:
    """(left, word, toxic, part, n): number of texts that hold the bigram, in batches of bounded size."""

    def out(c: Counter) -> pa.RecordBatch:
        left, word, toxic, part = zip(*c, strict=True)
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((left, word, toxic, part, c.values()), kinds, strict=True)], names=["l", "w", "toxic", "part", "n"])

    seen: Counter = Counter()
    for batch in rows:
        for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            words = text.split()
            seen.update({(a, b, toxic, part) for a, b in zip([START, *words], words, strict=False)})
            if len(seen) > flush:
                yield out(seen)
                seen = Counter()
    if seen:
        yield out(seen)


def fit_kneser_ney(train: DataFrame, parts: list[int], discounts: tuple[float, float, float] = (BIGRAM, WORD, STEM)) -> Iterator[Counts | None]:
    """train: normal texts, toxic, part.  Models without each of the parts, and one of all; None where a class has no texts.

    Counts are made in Spark; the entries over their discounts are collected, which the sample of training rows bounds.
    Models come one at a time, so that not all need be held.
    """
    models = [[q for q in parts if q != p] for p in parts] + [parts]
    cells = [(y, p) for y in (0, 1) for p in parts]
    grams = materialise(
        train.mapInArrow(bigram_texts, "l binary, w binary, toxic int, part int, n long")
        .groupBy("l", "w")
        .agg(*(F.sum(F.when((F.col("toxic") == y) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"n{y}_{p}") for y, p in cells)),
        "grams",
    )
    n = {(m, y): sum((F.col(f"n{y}_{p}") for p in of), F.lit(0)) for m, of in enumerate(models) for y in (0, 1)}
    each = range(len(models))
    words = materialise(
        grams.groupBy("w", F.substring(F.col("w").cast("string"), 1, LETTERS).cast("binary").alias("s")).agg(
            *(F.count_if(n[m, y] > 0).alias(f"k{m}_{y}") for m in each for y in (0, 1)), *(F.count_if(n[m, 0] + n[m, 1] > 0).alias(f"k{m}_2") for m in each)
        ),
        "words",
    )
    names = [f"k{m}_{y}" for m in each for y in (0, 1, 2)]
    stems = materialise(words.groupBy("s").agg(*(F.sum(c).alias(c) for c in names), *(F.count_if(F.col(f"k{m}_2") > 0).alias(f"k{m}_3") for m in each)), "stems")
    taken = lambda t, d: [F.coalesce(F.sum(F.least(F.col(f"k{m}_{y}").cast("double"), F.lit(d))), F.lit(0.0)).alias(f"d{m}_{y}") for m in each for y in (0, 1)]
    of_words = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), *taken(words, discounts[1])).first()
    of_stems = stems.agg(*taken(stems, discounts[2]), *(F.count_if(F.col(f"k{m}_2") > 0).alias(f"s{m}") for m in each)).first()

    def any_over(columns: list[Column], least: float) -> Column:
        return F.greatest(*columns) > least

    over = grams.where(any_over(list(n.values()), discounts[0]))
    lefts = grams.join(over.select("l").distinct().hint("shuffle_hash"), "l", "left_semi").groupBy("l").agg(
        *(F.sum(x).alias(f"c{m}_{y}") for (m, y), x in n.items()), *(F.sum(F.least(x.cast("double"), F.lit(discounts[0]))).alias(f"d{m}_{y}") for (m, y), x in n.items())
    )
    kept = words.where(any_over([F.col(f"k{m}_{y}") for m in each for y in (0, 1)], discounts[1])).unionByName(
        words.join(over.select("w").distinct().hint("shuffle_hash"), "w", "left_semi")
    ).distinct()
    kept_stems = stems.where(any_over([F.col(f"k{m}_{y}") for m in each for y in (0, 1)], discounts[2])).unionByName(
        stems.join(kept.select("s").distinct().hint("shuffle_hash"), "s", "left_semi")
    ).distinct()
    of_bigrams, of_lefts = over.select("l", "w", *(x.alias(f"n{m}_{y}") for (m, y), x in n.items())).toPandas(), lefts.toPandas()
    of_kept, of_kept_stems = kept.toPandas(), kept_stems.toPandas()
    discard(grams, words, stems)

    def model(m: int) -> Counts | None:
        total = [of_words[f"k{m}_{y}"] for y in (0, 1, 2)]
        if not total[0] or not total[1]:
            return None
        c = Counts(total, [of_words[f"d{m}_{y}"] / total[y] for y in (0, 1)], [of_stems[f"d{m}_{y}"] / total[y] for y in (0, 1)], of_stems[f"s{m}"], discounts)
        pairs = of_bigrams[(of_bigrams[[f"n{m}_0", f"n{m}_1"]] > discounts[0]).any(axis=1)]
        c.bigrams = {(bytes(r[0]), bytes(r[1])): tuple(r[2:]) for r in pairs[["l", "w", f"n{m}_0", f"n{m}_1"]].itertuples(index=False)}
        near = {left for left, _ in c.bigrams}
        c.contexts = {
            bytes(r[0]): [(r[1], r[2]), (r[3], r[4])] for r in of_lefts[["l", f"c{m}_0", f"d{m}_0", f"c{m}_1", f"d{m}_1"]].itertuples(index=False) if bytes(r[0]) in near
        }
        there = of_kept[of_kept[f"k{m}_2"] > 0]
        c.words = {bytes(r[0]): tuple(r[1:]) for r in there[["w", *(f"k{m}_{y}" for y in (0, 1, 2))]].itertuples(index=False)}
        there = of_kept_stems[of_kept_stems[f"k{m}_2"] > 0]
        c.stem_words = {bytes(r[0]): tuple(r[1:]) for r in there[["s", *(f"k{m}_{y}" for y in (0, 1, 2, 3))]].itertuples(index=False)}
        return c

    yield from map(model, each)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1e-2, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of (1, *x), each row standing for ``rows`` (one), by Newton's method with a small ridge; steps are halved until the loss falls."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    c = np.ones(len(x)) if rows is None else rows

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(c @ np.logaddexp(0, m) - (c * y) @ m + ridge / 2 * w @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = z.T @ (c * (p - y)) + ridge * w
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def labelled_sample(labels: DataFrame, folds: int, parts: tuple[int, ...], rows: int, favour: float = 2.0) -> DataFrame:
    """Up to about ``rows`` labelled ids of the folds, by a hash of the id; all of them while there are no more.

    Above, the rarer class is taken up to ``favour`` times as often as a plain sample would, while it is less than an
    eighth of the rows.  Not oftener: what copies of a passage are in one class only because the other is thinned out
    looks like evidence.  ``stands_for``: the rows of its class for each taken.
    """
    own = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(crc_mod("doc_id", folds).isin(list(parts)))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    there = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share, total = F.lit(1.0), sum(there.values())
    if total > rows:
        rare = min(there, key=lambda y: there[y])
        plain = rows / total
        taken = {rare: min(there[rare], plain * there[rare] * min(favour, max(1.0, rows / 8 / (plain * there[rare]))))}
        taken |= {y: rows - taken[rare] for y in there if y != rare}
        for y, n in taken.items():
            share = F.when(F.col("toxic") == y, F.lit(min(1.0, n / there[y]))).otherwise(share)
    own = own.withColumn("stands_for", 1 / share)
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)


def own_ratios(train: DataFrame, model: KneserNey, span: int, names: list[str]) -> pd.DataFrame:
    """Class, weight and features of training texts by a model that has not seen them."""
    sent = model.sent(train.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = KneserNey(*sent.value)
        for batch in rows:
            got = [features(model, t.as_py().split(), span) for t in batch.column(0)]
            cols = [*batch.columns[1:], *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = train.select("text", "toxic", "stands_for").mapInArrow(run, "toxic int, stands_for double, whole double, top double, length double").toPandas()
    sent.destroy()
    return out


def toxicity_scores(
    documents: DataFrame,
    labels: DataFrame,
    *,
    folds: int = 4,
    held: int = 2,
    max_rows: int = 12_000,
    span: int = 2,
    threshold: float = 0.3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Probability that a whole text is toxic, for every document.

    Labels are learned from rows outside the held-out fold only: about ``max_rows`` labelled rows at most, by hash of the
    id, the rarer class somewhat oftener (weighted back in the curve); this bound keeps the models small enough to broadcast,
    whatever the corpus.  Each other fold is a part: its rows' ratios, for the curve, are by models of the other parts.

    Scoring reads the text alone, whole, however long.  Null and empty texts have no words and get the curve's value at
    zero; without toxic or without ordinary training rows (or without labels at all) every score is 0.  An id labelled
    twice is toxic if one label says so; labels other than 0 and 1 and null ids teach nothing.  Copies of a text with one
    label count once.  A null doc_id keeps its row; repeated rows are scored one by one; equal texts score equal.  An
    empty table gives an empty result.  Other columns are ignored, but for those named in ``keep``, which go along.
    Returns doc_id, held_out, score, predicted, and the features whole, top and length.
    """
    parts = [f for f in range(folds) if f != held]
    docs = documents.select(
        text_bytes(documents).alias("_bytes"), F.col("doc_id").cast("long").alias("doc_id"), *(documents[c].alias(f"kept_{c}") for c in keep)
    )
    # The sample's bound is a parameter, so its ids may be sent to every executor.
    chosen = F.broadcast(labelled_sample(labels, folds, tuple(parts), max_rows))
    rows = docs.join(chosen, "doc_id").select(F.col("_bytes").alias("text"), "toxic", crc_mod("doc_id", folds).cast("int").alias("part"), "stands_for")
    train = materialise(
        rows.mapInArrow(normal_texts, "text binary, toxic int, part int, stands_for double")
        .groupBy(F.sha2("text", 256), "toxic")
        .agg(F.any_value("text").alias("text"), F.min("part").alias("part"), F.sum("stands_for").alias("stands_for"))
        .select("text", "toxic", "part", "stands_for"),
        "train",
    )
    names = ["toxic", "stands_for", "whole", "top", "length"]
    fit, final = pd.DataFrame(columns=names, dtype=float), None
    # A model at a time, here and in the tasks.
    for part, counts in zip([*parts, None], fit_kneser_ney(train, parts), strict=True):
        final = counts.model() if counts else None
        del counts
        if part is not None and final:
            fit = pd.concat([fit, own_ratios(train.where(F.col("part") == part), final, span, names)])
    discard(train)
    score = F.lit(0.0)
    if final and fit["toxic"].nunique() == 2:
        w = fit_logistic(fit[names[2:]].to_numpy(), fit["toxic"].to_numpy(float), rows=fit["stands_for"].to_numpy())
        score = 1 / (1 + F.exp(-sum((F.lit(float(x)) * F.col(c) for x, c in zip(w[1:], names[2:], strict=True)), F.lit(float(w[0])))))

    sent = final.sent(documents.sparkSession) if final else None
    del final

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = KneserNey(*sent.value) if sent else None
        for batch in rows:
            got = [features(model, expressions(t.as_py()), span) if model else (0.0, 0.0, 0.0) for t in batch.column(0)]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *names[2:]])

    schema = StructType([docs.schema[c] for c in ["doc_id", *(f"kept_{c}" for c in keep)]])
    for c in names[2:]:
        schema = schema.add(c, "double")
    return docs.mapInArrow(measure, schema).select(
        "doc_id",
        (crc_mod("doc_id", folds) == held).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        *names[2:],
        *(F.col(f"kept_{c}").alias(c) for c in keep),
    )
