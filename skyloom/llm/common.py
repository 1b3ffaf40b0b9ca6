"""What the corpus operators share: words of a text, tables in the shared folder, links to components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.sources.shared import discard, needs, settled, shared_folder
from skyloom.sources.shared import saved as materialise

__all__ = ["components", "crc_mod", "discard", "materialise", "needs", "plain_words", "settled", "shared_folder", "space_words", "text_bytes", "worker_cache"]

#: Bytes that are not part of a word ([\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z) become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; no text has no words."""
    return text.translate(WORD_BYTES).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between runs of ASCII white space; no text has no words."""
    return text.lower().split() if text else []


def text_bytes(df: DataFrame, column: str = "text") -> Column:
    """The column as UTF-8 bytes, whatever its type."""
    return df[column].cast("string").cast("binary")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def worker_cache(name: str) -> dict:
    """A dictionary that lasts as long as the Python worker, over tasks."""
    holder = sys.modules.setdefault("_skyloom_worker", types.ModuleType("_skyloom_worker"))
    return holder.__dict__.setdefault(name, {})


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of links (a long, b long), in rounds of star contraction.

    Each round points every larger end at the smallest of its smaller neighbours and hands its other neighbours on
    to that one, so that the graph shrinks to one tree per component; the trees are then flattened by pointer jumping.
    Rounds end when nothing changes.  A larger end may have very many smaller neighbours: they are reduced before the
    shuffle, and meet the one row of their end in a join whose large side Spark splits.  Look-ups by the smaller end are
    salted, since one root may be named by a third of all rows.

    Returns (node long, root long) for every node with a link, root being the smallest node of its component.
    Null ends and self-links are ignored; no links give an empty table.
    """
    edges = (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialise(edges, "edges")
    for _ in range(max_rounds):
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        many = materialise(low.where("n > 1").drop("n"), "low")
        if many.isEmpty():
            break
        passed = edges.join(many, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.select("u", F.col("m").alias("v"))
        new = materialise(kept.union(passed).distinct(), "edges")
        discard(edges, many)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    return flatten_forest(edges, max_rounds)


def flatten_forest(edges: DataFrame, max_rounds: int = 200, salts: int = 32) -> DataFrame:
    """(u, v): each node's one parent, smaller than it.  Doubles the pointers until each names its root."""
    tree = edges
    for _ in range(max_rounds):
        # Only parents that have a parent themselves move on; they are few, and looked up by salted keys.
        inner = tree.join(
            tree.select(F.col("v").alias("u")).distinct(), "u", "left_semi"
        ).select(F.col("u").alias("v"), F.col("v").alias("up"))
        inner = materialise(inner, "inner")
        if inner.isEmpty():
            break
        left = tree.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
        right = inner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        new = materialise(left.join(right, ["v", "salt"], "left").select("u", F.coalesce("up", "v").alias("v")), "tree")
        discard(tree, inner)
        tree = new
    else:
        raise RuntimeError("forest did not settle")
    roots = tree.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
