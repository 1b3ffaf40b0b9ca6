"""Conversation repair at the least cost, by a suffix-shared automaton of role and fault signatures.

Each conversation becomes a signature, one symbol a row: the role's initial and the row's fault.  Signatures are sorted
by their reversal, so that those with a common end stand together: the suffixes are then the nodes of an automaton that
is walked from the end, and each node's cost-to-go and first edit of the best audit suffix, for each state of the
grammar, are computed once for all conversations that share it.  (An audit suffix is that edit and the suffix of the
node it leads to, so it is never copied.)  A second pass applies the audits to the rows.

Rows of a conversation are ordered by turn (nulls first), then by role and a digest of role and text.  Null columns count
as one space; a row of an empty role fits nowhere and is never kept.  A conversation's
rows pass in order through one task, as they are hashed in order, but are never gathered: what a task holds is a
signature of one byte a row.  Repeated rows are duplicates; rows without a conv_id are one conversation; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import materialise

SPACE = " \t\n\x0b\f\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What u and a lead to from each state, and the only role that may be put there.
MOVES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
NEED = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MUST_GO = "x"

Node = tuple[tuple[int, ...], str]  # of each state: the cost-to-go, and the edit to begin with (a blank: no more)


def with_inserts(best: list[tuple[float, str]]) -> Node:
    """Each state's best edit, once it may also insert the role that it needs."""
    found = list(best)
    for state in (USER, ASSISTANT, START, SYSTEM):
        ahead = best if state in (USER, ASSISTANT) else found  # two inserts in turn lead back to where they began
        found[state] = min(found[state], (INSERT + ahead[NEED[state]][0], "I"))
    return tuple(c for c, _ in found), "".join(e for _, e in found)


END = with_inserts([(0, " "), (float("inf"), "~"), (float("inf"), "~"), (0, " ")])


def node_before(symbol: str, after: Node) -> Node:
    """The node whose suffix is the symbol and then that of ``after``."""
    cost, best = after[0], []
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        edits = [(DELETE + cost[state], "D")]
        if symbol != MUST_GO:
            edits.append((REROLE + more + cost[NEED[state]], "R"))
            if role in MOVES[state]:
                edits.append((more + cost[MOVES[state][role]], "K"))
        best.append(min(edits))
    return with_inserts(best)


def walk(signature: str, nodes: list[Node]) -> str:
    """The best audit; nodes[n] has the suffix of n symbols."""
    out, state, left = [], START, len(signature)
    while (edit := nodes[left][1][state]) != " ":
        out.append(edit)
        if edit == "K":
            state = MOVES[state][signature[len(signature) - left].lower()]
        elif edit != "D":
            state = NEED[state]
        left -= edit != "I"
    return "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with faults by crc32(conv_id:turn) % 20.

    0 drops a row (it stays here as ``gone``, so that its conversation is known), 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"),
        (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("fault"),
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies).drop("col")


def row_key() -> Column:
    """Digest of role and text, by which rows are told apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, signature.

    A symbol is the role's initial (o for other ones than s, u and a), a capital for truncated rows, x for rows that
    must go.  Only digests of the texts are shuffled.
    """
    cut = F.rtrim("text", F.lit(SPACE))
    fault = F.when(cut == "", "blank").when(F.substring(cut, -1, 1).isin(".", "!", "?"), "none").otherwise("truncated")
    slim = rows.select("conv_id", "turn", "role", "gone", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), row_key().alias("key"))
    slim = slim.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "key").orderBy(F.asc_nulls_first("turn"))) > 1
    slim = slim.withColumn("seen", seen).sortWithinPartitions("conv_id", F.desc("gone"), F.asc_nulls_first("turn"), "role", "key", "seen")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        conv, low, last, turns, counts, before, signature = None, None, None, 0, [0] * 4, "", []

        def row() -> tuple:
            return (conv, 0 if low is None else last - low + 1 - turns, *counts, "".join(signature))

        for batch in batches:
            out = []
            for c, turn, gone, initial, fault, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(row())
                    begun, conv, low, last, turns, counts, before, signature = True, c, None, None, 0, [0] * 4, "", []
                if gone:
                    continue
                if turn is not None and turn != last:
                    low, last, turns = turn if low is None else low, turn, turns + 1
                if signature:
                    counts[3] += before + initial not in ("su", "ua", "au")
                before = initial
                if fault == "blank" or again:
                    counts[0 if fault == "blank" else 1] += 1
                    signature.append(MUST_GO)
                    continue
                counts[2] += fault == "truncated"
                symbol = initial if initial in ("s", "u", "a") else "o"
                signature.append(symbol.upper() if fault == "truncated" else symbol)
            yield as_batch(out, SIGNED)
        if begun:
            yield as_batch([row()], SIGNED)

    return slim.select("conv_id", "turn", "gone", "initial", "fault", "seen").mapInArrow(fold, SIGNED)


SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
PLANNED = SIGNED + ", cost long, audit string"
TURNS = "conv_id long, pos long, edit string, role string, text string"


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def planned(signed: DataFrame) -> DataFrame:
    """With cost and audit.  A range of reversed signatures is one walk over the automaton, whose path from the end it
    keeps; conv_id in the range lets many tasks share the conversations of one signature."""
    ends = signed.withColumn("ends", F.reverse("signature"))
    ends = ends.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").drop("ends")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, nodes = "", [END]  # from the end
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ends = row[-1][::-1]
                if ends != path:
                    shared = next((i for i, (x, y) in enumerate(zip(ends, path)) if x != y), min(len(ends), len(path)))  # noqa: B905
                    del nodes[shared + 1 :]
                    for symbol in ends[shared:]:
                        nodes.append(node_before(symbol, nodes[-1]))
                    path = ends
                out.append((*row, nodes[-1][0][START], walk(row[-1], nodes)))
            yield as_batch(out, PLANNED)

    return ends.mapInArrow(plan, PLANNED)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), edit, role, text of the repaired conversations: ordered within partitions, each conversation
    in one.  A conversation's audit comes ahead of its rows, which then pass one by one."""
    none = F.lit(None)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("key"), F.col("audit").alias("text"))
    body = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", row_key().alias("key"), "text")
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "key")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, pos, state = None, "", 0, 0, START
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal pos, state
            state = MOVES[state][role[0]]
            out.append((conv, pos, edit, role, text))
            pos += 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", ROLE[NEED[state]], "")
                at += 1

        for batch in batches:
            for c, kind, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    inserts()
                    conv, audit, at, pos, state = c, text, 0, 0, START
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(edit, ROLE[NEED[state]] if edit == "R" else role, text)
            yield as_batch(out, TURNS)
            out.clear()
        inserts()
        yield as_batch(out, TURNS)

    return both.select("conv_id", "kind", "role", "text").mapInArrow(apply, TURNS)


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of rows conv_id, turn, role, text, gone (a gone row only says that its conversation exists).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit.  A conversation without rows has
    zeros, no audit and no turns.  turns: see ``repaired_turns``.
    """
    report = materialise(planned(materialise(signatures(rows), "signatures")), "repairs")
    return report, repaired_turns(rows, report)


def text_digests(turns: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of ``role:text`` lines, of turns as ``repaired_turns`` orders them; hashed as they pass."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if h is None or c != conv:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield as_batch(out, "conv_id long, repaired_sha256 string")
        if h is not None:
            yield as_batch([(conv, h.hexdigest())], "conv_id long, repaired_sha256 string")

    return turns.select("conv_id", "role", "text").mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The contract's columns over damaged conversations: one row per conv_id."""
    report, turns = repair_conversations(damaged(conversations))
    digests = text_digests(turns).withColumnRenamed("conv_id", "of")
    none = F.lit(hashlib.sha256().hexdigest())
    out = report.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
