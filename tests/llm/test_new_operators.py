"""Conversation repair, hard negatives and main texts against brute force, and their defined results on odd rows."""

import hashlib
import html
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import conversations as C
from skyloom.llm import main_text as M
from skyloom.llm import negatives as N
from skyloom.llm.queries import QUERIES

TALK = "conv_id long, turn long, role string, text string, pos long, gone string, key string"  # names that clash with the operator's own


def grammar(roles):
    return re.fullmatch(r"(s?(ua)+)?", "".join(r or "-" for r in roles)) is not None


def cheapest(rows):
    """(cost, audit, lines) over all edits of rows (role, text, must go, truncated)."""
    best = None
    symbols = len(rows)
    for inserts in itertools.product(range(3), repeat=symbols + 1):
        if sum(inserts) > 3:
            continue
        for edits in itertools.product("DKR", repeat=symbols):
            if any(r[2] and e != "D" for r, e in zip(rows, edits, strict=True)):
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(inserts) + edits.count("R")):
                roles, cost, audit, lines = iter(roles), 0, "", []
                for i in range(symbols + 1):
                    for _ in range(inserts[i]):
                        cost, audit = cost + 3, audit + "I"
                        lines.append((next(roles), ""))
                    if i < symbols:
                        role, text, _, cut = rows[i]
                        audit += edits[i]
                        cost += {"D": 4, "K": 0, "R": 3}[edits[i]] + (3 if cut and edits[i] != "D" else 0)
                        if edits[i] != "D":
                            lines.append((next(roles) if edits[i] == "R" else role, text))
                if grammar(r[:1] for r, _ in lines) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def plain_report(rows):
    """One conversation's rows after damage, in order: the contract by its words."""
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        cut = text.rstrip(C.SPACE)
        kind = 0 if not cut else 1 if (role, text) in seen else 2 if cut[-1] not in ".!?" else None
        if kind is not None:
            counts[kind] += 1
        judged.append((role, text, kind in (0, 1), kind == 2))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(judged)
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(60))
def test_every_node_is_the_cheapest_of_all_edits(seed):
    import random

    rng = random.Random(seed)
    rows = [rng.choice([("system", "a."), ("user", "b."), ("assistant", "c."), ("tool", "d."), ("user", "cut"), ("assistant", "cut"), ("system", "cut"), ("", " ")]) for _ in range(rng.randrange(5))]
    signature, judged = "", []
    for role, text in rows:
        gone, cut = not text.strip(), text == "cut"
        judged.append((role, text, gone, cut))
        symbol = role[:1] if role[:1] in ("s", "u", "a") and role else "o"
        signature += "x" if gone else symbol.upper() if cut else symbol
    nodes = [C.END]
    for symbol in reversed(signature):
        nodes.append(C.node_before(symbol, nodes[-1]))
    assert (nodes[-1][0][C.START], C.walk(signature, nodes)) == cheapest(judged)[:2]


def test_conversation_repair_of_odd_rows(spark):
    long_text = "word " * 200_000
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 1, "user", "Hello."), (1, 5, "assistant", "Well"),
        (2, None, None, None), (2, 3, "user", " \t\x0b"), (2, None, "user", "No turn."),
        (3, 0, "user", long_text), (3, 1, "assistant", long_text + "."), (None, 0, "user", "Nobody's."), (None, 1, "assistant", "No?"),
        (4, 0, "tool", "x."), (5, 7, "", "!"), (6, 0, "assistant", "One."), (6, 1, "user", "Two."), (6, 2, "user", "Three\xa0"),
    ]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TALK)
    kept = C.damaged(table).collect()
    assert len({(r["conv_id"], r["turn"]) for r in kept}) == len({r[:2] for r in rows})
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_report(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, report in got.items():
        mine = [r for r in kept if r["conv_id"] == conv and not r["gone"]]
        mine.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], hashlib.sha256(f"{len(r['role'].encode())}:{r['role']}{r['text']}".encode()).digest()))
        assert report == plain_report([(r["turn"], r["role"], r["text"]) for r in mine]), conv


def test_no_conversations(spark):
    assert C.repair_report(spark.createDataFrame([], TALK)).collect() == []


def test_turns_are_the_repaired_ones(spark):
    rows = [(1, i, "user", f"Part {i}.", False) for i in range(3)] + [(2, 0, "user", "Gone.", True)]
    report, turns = C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean"))
    want = cheapest([("user", f"Part {i}.", False, False) for i in range(3)])
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: want[:2], 2: (0, "")}
    roles = [r["role"] for r in turns.orderBy("pos").collect()]
    assert grammar(r[0] for r in roles)


# ---------------------------------------------------------------- hard negatives


def test_hilbert_neighbours_are_adjacent():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        digits = N.hilbert(cells, bits)
        order = np.argsort(digits @ (1 << np.arange(digits.shape[1] - 1, -1, -1)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.normal(0, 60, (20, 9))), np.floor(rng.normal(5, 60, (30, 9)))
    q = N.Queries(np.arange(20), np.zeros(20, int), x, np.arange(20), np.full(20, N.NONE), np.full(20, N.LONG), 2, False)
    zone = {"low": y.min(0)[None], "high": y.max(0)[None], "low_label": np.array([1]), "high_label": np.array([2])}
    assert q.wanted(zone)[0].all()
    best = N.exact_scores(x, y).max(1)
    q.low[:] = best + 1
    need = q.wanted(zone)[0][:, 0]
    top = np.maximum(x, 0) @ y.max(0) + np.minimum(x, 0) @ y.min(0)
    assert (top >= best).all() and (need == (top + 1e-6 >= best + 1)).all()


def brute_negatives(rows, positives=5, negatives=10):
    out, good = set(), {}
    for vec, label, v in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[vec] = (label, [math.floor(256 * x) for x in v])
    score = lambda a, b: max(-N.LONG, min(N.LONG, sum(x * y for x, y in zip(a, b, strict=True))))
    for a, (label, q) in good.items():
        if a % 4:
            continue
        scored = sorted((-score(q, w), vec, lab == label) for vec, (lab, w) in good.items() if vec != a and len(w) == len(q))
        for p, pos, _ in [x for x in scored if x[2]][:positives]:
            hard = [(n, neg) for n, neg, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p]
            out |= {(a, pos, i + 1, neg, -p, -n) for i, (n, neg) in enumerate(hard[:negatives])}
    return out


ODD = "vec_id long, embedding array<double>, label int, part int, dims string, v long, path string"  # names that clash with the operator's own


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.2, (4, 6))
    rows = [(i, int(rng.integers(0, 3)), (base[i % 4] + rng.normal(0, 0.1, 6)).tolist()) for i in range(150)]
    rows += [(200 + i, i % 2, [0.5, 0.25, 0.1, 0.0, 0.0, 0.0]) for i in range(40)]  # equal vectors: ties
    rows += [(300, None, [0.1] * 6), (304, 1, None), (308, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (312, 1, [float("nan")] * 6), (316, 2, [float("inf")] * 6), (None, 1, [0.1] * 6)]
    rows += [(320, 1, []), (321, 1, []), (322, 2, []), (324, 0, [0.5, 0.5]), (325, 0, [0.5, 0.4]), (326, 1, [0.3, 0.3]), (328, 0, [1e200, 0.0, 1.0]), (329, 0, [1e200, 1.0, 0.0]), (330, 1, [1e8, 1.0, 0.0])]
    rows += [(332, 5, [0.0] * 6), (336, 2, [1e6] * 6), (337, 2, [1e6] * 6), (338, 0, [4e5] * 6)]
    table = spark.createDataFrame([(v, e, lab, 1, "x", 2, "y") for v, lab, e in [*rows, rows[0]]], ODD)
    got = N.hard_negatives(table, F.col("vec_id") % 4 == 0)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows) and got.count() == len(brute_negatives(rows))
    assert N.hard_negatives(table.limit(0), F.col("vec_id") % 4 == 0).collect() == []
    assert N.hard_negatives(table.where("vec_id = 1"), F.col("vec_id") % 4 == 0).collect() == []


def test_windows_read_few_blocks_of_clustered_rows(spark):
    """Tight clusters around axes of their own: most blocks cannot hold what a window asks for, and are not read."""
    rng = np.random.default_rng(8)
    rows = [(i, ((i % 16 == np.arange(16)) * 0.9 + rng.normal(0, 0.01, 16)).tolist(), i % 16 // 2) for i in range(8_000)]
    points = N.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    blocks = N.blocks_of(points, 1, 32, "blocks", 1 << 14)
    paths = [r["path"] for r in N.files_of(blocks).collect()]
    table = {r["vec_id"]: r for r in points.where("vec_id = 0").collect()}
    q = N.Queries(np.array([0]), np.array([0]), N.unpacked(table[0]["v"], 1, 16), np.array([0]), np.array([N.NONE]), np.array([N.LONG]), 5, True)
    files = N.CandidateFiles(paths)
    read = N.scan({16: q}, paths)
    want = sorted(((-int(s), r["vec_id"]) for r in points.where("vec_id <> 0 AND label = 0").collect() for s in N.exact_scores(q.x, N.unpacked(r["v"], 1, 16))[0]))[:5]
    assert list(zip((-q.scores[0]).tolist(), q.rows[0].tolist(), strict=True)) == want
    assert len(files.groups) > 8 and read <= len(files.groups) / 2


# ---------------------------------------------------------------- main texts


def test_region_is_the_best_of_all():
    import random

    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randrange(12))]
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        first, last = M.best_region(x)
        assert sum(x[first:last]) == max([0, *sums.values()])


def by_template(page):
    """The article of the tables' pages, whose markup is known: its heading, then its paragraphs."""
    body = re.sub(r"</?b>|<br>", " ", page[page.index("<article>") + 9 : page.index("</article>")])
    blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(x for x in blocks if x)


@pytest.fixture(scope="module")
def learned(spark):
    return M.learn_weights(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def test_all_articles_are_found_whole(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], by_template(pages[r["page_id"]]["html"]), len(r["text"]))


def test_articles_are_found_without_their_mark(spark, learned):
    """The weights alone find them: no page has an article element here."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    bare = [re.sub("article>", 'div class="entry">', p).replace('</div class="entry">', "</div>") for p in pages]
    assert all("article" not in p for p in bare)
    assert [M.extract(p, learned) for p in bare] == [by_template(p) for p in pages]


PAGES = {
    "": "", "no tags at all": "no tags at all", "<p>": "", "<script>var a = '<p>no</p>';</script>": "", "<!-- <p>no</p>": "",
    "<p>a &lt; b &amp;&#233;&eacute;&nbsp;c &amp d &am</p>": "a < b &éé c & d &am",
    "<p>One\n two<br>three <b>fo</b>ur<p>Next<div>Last": "One two three four\n\nNext\n\nLast",
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>": "a\n\nb\n\nc d\n\ne",
    "1 < 2 <3 and </ >x": "1 < 2 <3 and x",
    '<p title="a > b" class=\'x\'>Text</p><p title="open>Rest</p>': "Text\n\nRest",
    "<article><h1>T</h1><p>First words here.</p><div class=advert><p>Buy now, buy cheap!</p></div><p>End.</p></article><div id=comments><article><p>I like it very much indeed, thank you.</p></article></div>": None,
    "<main><header><h1>T</h1></header><p>Body of it.</p><aside>Other things.</aside><form><input><label>Your name</label></form><p>End.</p><footer>Tags</footer></main><p>About us and all.</p>": "T\n\nBody of it.\n\nEnd.",
    "<form id=all><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Body.</p></article></form>": "T\n\nBody.",
    "<header><h1>Site</h1></header><nav><a>One</a><a>Two</a></nav><div class=content><h2>Head</h2><p>Text <img src=x> of it.</p><pre><span class=comment># code</span></pre></div><div class='cookie-notice'>We use cookies</div><footer>Me</footer>": "Head\n\nText of it.\n\n# code",
    "<p>A<select><option>x</select>B <button>press</button></p><noscript>no</noscript>": "AB",
    "<P>Caps</P><SCRIPT>x</SCRIPT ><STYLE>y</style>": "Caps",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_of_other_shapes(page, learned):
    want = PAGES[page]
    for weights in ({}, learned):
        got = M.extract(page, weights)
        assert got == want if want is not None else "First words" in got and "End." in got and "Buy" not in got and "like it" not in got


def test_odd_pages(spark, learned):
    deep = "<div>" * 20_000 + "deep" + "<b>" * 20_000 + "text" + "</i>" * 20_000
    pages = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>one</p>", "y"), (2, "v", "<p>" + "word " * 300_000, "z"), (3, "w", deep, ""), (4, "w", "<a href=\"" * 20_000 + "<a " * 20_000, "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in M.main_texts(table, weights=learned).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (0, "one", 3), (2, ("word " * 300_000).strip(), 1_499_999), (3, "deeptext", 8), (4, "", 0)], key=str)
    assert M.main_texts(table.limit(0)).collect() == []
    assert M.learn_weights(table) == {}
