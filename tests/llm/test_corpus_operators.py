"""The corpus operators against brute force, and their defined results on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, embeddings, hmm, licenses, minhash, sharding, toxicity, url_templates, warc
from skyloom.llm import sentencepiece_nbest as sp
from skyloom.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, score double, root long, rep long"  # names that clash with the operators' own
SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "one", "One", BASE, BASE + " tail", BASE, LONG, " \n\t ", "é\x00x é", "a b c d", "a b c d", "x y z " * 40, "gnu general public license version 3"]


def docs(spark, texts=TEXTS, first=1):
    return spark.createDataFrame([(first + i, t, "en", 0.0, 1, 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture
def odd(spark):
    """With a null id and a repeated row."""
    return docs(spark).union(spark.createDataFrame([(None, "null id", None, None, None, None), (5, BASE, "en", 0.0, 1, 2)], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hmm_likelihood_is_exact():
    rng = np.random.default_rng(1)
    k, n = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((n, k)), 0))
    texts = [rng.integers(0, n, size) for size in (1, 2, 5, 3)]
    for text, got in zip(texts, m.log10(texts), strict=True):
        total = 0.0
        for path in np.ndindex(*[k] * len(text)):
            p = m.pi[path[0]] * m.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= m.trans[path[t - 1], path[t]] * m.emit[text[t], path[t]]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)


def test_hmm_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((4, 2)), 0))
    text = np.array([0, 3, 1, 1])
    first, moves, counts = m.expected(hmm.Spans.of([text]))
    want_first, want_moves, want_counts, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = m.pi[path[0]] * m.emit[text[0], path[0]]
        for t in range(1, 4):
            p *= m.trans[path[t - 1], path[t]] * m.emit[text[t], path[t]]
        total += p
        want_first[path[0]] += p
        for t in range(4):
            want_counts[text[t], path[t]] += p
            if t:
                want_moves[path[t - 1], path[t]] += p
    for got, want in ((first, want_first), (moves, want_moves), (counts, want_counts)):
        assert np.allclose(got, want / total, atol=1e-5)


def plain_forward_backward(m, text):
    """Scaled recursions over one whole text, step by step."""
    k = len(m.pi)
    a, c = np.zeros((len(text), k)), np.zeros(len(text))
    for t, w in enumerate(text):
        a[t] = (m.pi if t == 0 else a[t - 1] @ m.trans) * m.emit[w]
        c[t] = a[t].sum()
        a[t] /= c[t]
    b = np.ones((len(text), k))
    moves, counts = np.zeros((k, k)), np.zeros((len(m.emit), k))
    for t in range(len(text) - 2, -1, -1):
        ahead = m.emit[text[t + 1]] * b[t + 1] / c[t + 1]
        b[t] = m.trans @ ahead
        moves += m.trans * np.outer(a[t], ahead)
    for t, w in enumerate(text):
        counts[w] += a[t] * b[t]
    return a[0] * b[0], moves, counts, np.log10(c).sum()


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_hmm_recursions_run_through_the_spans_of_a_text(size):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(4), 0), norm(rng.random((4, 4)) ** 3, 1), norm(rng.random((9, 4)) ** 3, 0))
    texts = [rng.integers(0, 9, n) for n in (1, 2, 3, 4, 6, 7, 20, 21, 22, 50)]
    got = m.expected(hmm.Spans.of(texts, size))
    for g, w in zip(got, zip(*(plain_forward_backward(m, t)[:3] for t in texts), strict=True), strict=True):
        assert np.allclose(g, sum(w), rtol=2e-4, atol=2e-4)


@pytest.mark.parametrize("limit", [20, 70_000])
def test_hmm_scores_equal_brute_force(spark, odd, limit):
    """Training of two rounds over whole texts, and the score of every text, word by word."""
    states, classes = 3, 16
    got = hmm.hmm_scores(odd, states=states, rounds=2, max_symbols=limit, classes=classes).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows = [(r["doc_id"], re.findall(rb"[^\x20\x09-\x0d]+", (r["text"] or "").encode().lower()) + [b"\n"]) for r in odd.collect()]
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    by_step = collections.defaultdict(list)
    for w, n in c.items():
        if n > 1:
            by_step[math.floor(16 * math.log2(n))].append(w)
    top, room = [], limit
    for step in sorted(by_step, reverse=True):
        room -= len(by_step[step])
        if room < 0:
            break
        top += [w for w in by_step[step] if w != b"\n"]
    top = [b"\n", *sorted(top, key=lambda w: (-c[w], w))]
    symbol = {w: i for i, w in enumerate(top)}
    cls = lambda w: zlib.crc32(w[-3:]) % classes
    share, inside = np.array([*(c[w] for w in top), *[0] * classes], float), collections.defaultdict(lambda: [0, 0])
    for w, n in c.items():
        if w not in symbol:
            share[len(top) + cls(w)] += n
            inside[cls(w)][0] += n
            inside[cls(w)][1] += 1
    share = (share + 1) / (sum(c.values()) + len(share))
    code = lambda ws: [symbol.get(w, len(top) + cls(w)) for w in ws]
    m = hmm.Hmm.start(share, states)
    for _ in range(2):
        first, moves, counts = np.ones(states), np.eye(states) + 0.1, share[:, None] * np.full(states, 50.0)
        for i, ws in rows:
            if not held(i):
                for total, more in zip((first, moves, counts), plain_forward_backward(m, code(ws))[:3], strict=True):
                    total += more
        m = hmm.Hmm(first / first.sum(), moves / moves.sum(1, keepdims=True), counts / counts.sum(0))
    want = []
    for i, ws in rows:
        rare = sum(math.log10((c[w] + 1) / (inside[cls(w)][0] + inside[cls(w)][1] + 1)) for w in ws if w not in symbol)
        want.append((str(i), plain_forward_backward(m, code(ws))[3] + rare))
    for (i, x), (j, y) in zip(sorted((str(r["doc_id"]), r["score"]) for r in got), sorted(want), strict=True):
        assert i == j and math.isclose(x, y, rel_tol=1e-3, abs_tol=1e-3)


def test_hmm_base_scores(spark, odd):
    got = hmm.hmm_scores(odd, states=2, rounds=1, max_symbols=20, classes=16).collect()
    assert len(got) == odd.count()
    rows = odd.collect()
    words = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r["doc_id"]) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r["text"])), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_hmm_on_no_rows(spark):
    assert hmm.hmm_scores(empty(spark), states=2, rounds=1).count() == 0
    # Nothing to learn from: every word is unseen.
    held = spark.createDataFrame([(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")], "doc_id long, text string")
    r = hmm.hmm_scores(held, states=2, rounds=1).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_template_automaton():
    a = licenses.Automaton("x", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> delta <<var;name=v;words=1-2;match=[0-9]+>> end")
    ok = ["alpha delta 1 end", "alpha beta delta 1 2 end", "alpha beta gamma delta 9 end"]
    bad = ["alpha gamma delta 1 end", "alpha delta end", "alpha delta x end", "alpha delta 1 2 3 end", "alpha other delta 1 end"]
    for text in ok:
        assert a.match(text.encode().split(), 0)[0] == len(text.split())
    for text in bad:
        assert a.match(text.encode().split(), 0)[0] is None
    with pytest.raises(ValueError):
        licenses.Automaton("x", "a <<beginOptional>> b")


def test_license_scan(spark, odd):
    extra = docs(spark, ["Released under the MIT License.", "mit license mit license", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "apache license"], 100)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(odd.union(extra)).collect()}
    assert (got[100]["labels"], got[100]["score"], got[100]["first_word"]) == ("mit,mit-notice", 1.0, 3)
    assert (got[101]["n_base"], got[101]["first_word"], got[101]["last_word"], got[101]["labels"]) == (2, 0, 2, "mit")
    assert got[102]["labels"] == "apache,apache-2.0" and got[103]["labels"] == "cc-by,cc-by-nc"
    assert (got[104]["labels"], got[104]["score"] >= 0.5) == ("apache", True)
    assert (got[1]["n_words"], got[1]["labels"], got[1]["first_word"], got[1]["score"]) == (0, "", None, 0.0)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def template_tree(template):
    """Words, ('opt', nodes) and ('var', low, high, pattern), by recursive descent."""
    marks = re.split(r"(<<.*?>>)", template.replace("\n", " "))

    def level(at):
        nodes = []
        while at < len(marks):
            m = marks[at]
            if m == "<<endOptional>>":
                return nodes, at
            if m == "<<beginOptional>>":
                inner, at = level(at + 1)
                nodes.append(("opt", inner))
            elif m.startswith("<<var"):
                low, high = re.search(r"words=(\d+)-(\d+)", m).groups()
                nodes.append(("var", int(low), int(high), re.search(r"match=([^;>]*)", m)[1]))
            else:
                nodes += re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", m.lower())
            at += 1
        return nodes, at

    return level(0)[0]


def brute_accept(nodes, words, start):
    """(All ends of accepted runs, most mandatory words on the way), region by region."""
    most = 0

    def run(nodes, ends, inside):
        nonlocal most
        for node in nodes:
            if isinstance(node, str):
                ends = {(e + 1, d + (not inside)) for e, d in ends if e < len(words) and words[e] == node}
            elif node[0] == "opt":
                ends = ends | run(node[1], ends, True)
            else:
                now, every = ends, set(ends) if node[1] == 0 else set()
                for k in range(1, node[2] + 1):
                    now = {(e + 1, d) for e, d in now if e < len(words) and re.fullmatch(node[3], words[e])}
                    every |= now if k >= node[1] else set()
                ends = every
            most = max([most, *(d for _, d in ends)])
        return ends

    return {e for e, _ in run(nodes, {(start, 0)}, False)}, most


def test_license_scan_equals_brute_force(spark):
    """All templates over the small table and over whole, shortened and altered license texts."""
    rng = np.random.default_rng(21)
    trees = {label: template_tree(t) for label, t in licenses.TEMPLATES}

    def spell(nodes):
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n)
            elif n[0] == "opt":
                out += spell(n[1]) if rng.random() < 0.5 else []
            else:
                out += [str(rng.integers(1, 9)) if n[3] != ".+" else "acme"] * int(rng.integers(n[1], n[2] + 1))
        return out

    texts = []
    for tree in trees.values():
        for _ in range(3):
            w = spell(tree)
            texts.append(" ".join(["x", *w, "y"]))
            w[int(rng.integers(len(w)))] = "other"
            texts += [" ".join(w), " ".join(w[: len(w) // 2])]
    d = docs(spark, texts, 10_000).select("doc_id", "text")
    d = d.union(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    for r in d.collect():
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            n = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(n)] == n]
            places += at
            labels |= {label} if at else set()
        spans, share = set(), 0.0
        for label, tree in trees.items():
            mandatory = sum(isinstance(n, str) for n in tree)
            starts = {n for n in first_words(tree)}
            for i in (i for i, w in enumerate(words) if w in starts):
                ends, done = brute_accept(tree, words, i)
                share = max(share, done / mandatory)
                if ends:
                    spans.add((label, i, max(ends)))
        score = 1.0 if spans else max(0.5 * share, 0.5 if places else 0.0)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert g["base_labels"] == ",".join(sorted(labels)) and g["labels"] == ",".join(sorted(labels | {s[0] for s in spans}))
        assert {tuple(s) for s in g["spans"]} == spans and math.isclose(g["score"], score)
    assert {"mit-text", "isc-text", "0bsd-text", "bsd-2-text", "bsd-3-text", "zlib-text"} <= {x for r in got.values() for x in r["labels"].split(",")}
    plain = re.sub("<<[a-z]+Optional>>", "", licenses.ISC_GRANT + licenses.ISC_DISCLAIMER.replace(licenses._NAME, "the author"))
    assert [r["labels"] for r in licenses.scan_licenses(docs(spark, [plain, plain[:300]])).orderBy("doc_id").collect()] == ["0bsd-text", ""]


def first_words(tree):
    for n in tree:
        if isinstance(n, str):
            yield n
            return
        yield from first_words(n[1])


def brute_contamination(rows, items, size):
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = []
    for i, text in rows:
        w, hit, found, near = words(text), set(), set(), set()
        for name, item in items:
            x = words(item)
            for s in range(max(1, len(x) - size + 1)) if x else ():
                g = x[s : s + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add(str(name))
            terms = set(sorted(set(x), key=lambda t: (-len(t), t))[:3])
            if len(terms) == 3 and any(terms <= set(w[p : p + 12]) for p in range(len(w))):
                near.add(str(name))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [1_000_000, 7, 1])
def test_decontamination(spark, odd, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 3)
    items = [(1, " ".join(BASE.split()[5:20])), (2, "A b! c"), (3, None), (4, ""), (5, "x y z x y z x y z x y"), (6, "not in any text at all of these ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), *r[1:]) for r in decontaminate.contamination_report(odd, bench).collect())
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in odd.collect()], items, 10)
    assert decontaminate.contamination_report(empty(spark), bench).count() == 0
    twice = decontaminate.contamination_report(odd.union(odd), bench.union(bench))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in twice.collect()) == sorted(got * 2)
    none = decontaminate.contamination_report(odd, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == odd.count()


@pytest.mark.parametrize("block_words", [1_000_000, 1])
def test_proximity(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    d = docs(spark, ["zebra one two monkey three giraffe", "zebra " + "x " * 50 + "monkey giraffe"])
    bench = spark.createDataFrame([(7, "giraffe a zebra b monkey")], "item_id long, text string")
    got = {r["doc_id"]: r["near_items"] for r in decontaminate.find_contamination(d, bench, near_terms=3, near_width=6).collect()}
    assert got == {1: ["7"], 2: []}


def test_sharding(spark, odd):
    got = sharding.shard_records(odd, [1.0] * 5, [1.0] * 6, slices=4).collect()
    assert len(got) == odd.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["size"], by[1]["text_crc32"]) == (16, 0)
    assert (by[3]["size"], by[3]["text_crc32"]) == (19, zlib.crc32(b"one"))
    assert sharding.shard_records(empty(spark), [1.0]).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.shard_records(many, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.6 < n[1] / n[0] < 3.4


def test_url_judgements(spark):
    urls = [
        "http://a.com/x", "http://Spam.example.com/en/1", "http://www.example.com/en/2", "http://x.net/es/3.html", "nourl", None, "ftp://n.net", "http://b.org/q?x=1", "http://c.com?x", "http://d.com#f", "http://notnet/es/", "",
    ]
    p = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h", "x")], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge_urls(p).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("spam.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow") and got[3] == ("x.net", "/es/3.html", "net/es/", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[6][:2] == ("n.net", "")
    assert got[7][1:3] == ("/q", None) and got[8][:3] == ("c.com", "", None) and got[9][:3] == ("d.com", "", None) and got[10][2] is None
    assert url_templates.judge_urls(p.where("false")).count() == 0


def test_url_templates_learn_from_labelled_siblings(spark):
    """Rules label one section; the section's other urls, and hosts without any labels, follow the template."""
    rules = [("block", f"h{i}.net", "/a/bad/1") for i in range(12)] + [("allow", "net", "/b/1")]
    urls = [f"http://h{i}.net/{p}/{n}" for i in range(12) for p in ("a/bad", "b") for n in range(100, 130)]
    at = len(urls)
    urls += ["http://h3.net/a/bad/7", "http://other.org/a/bad/9", "http://other.org/b/9", "http://other.org/a/9", "http://h3.net/b/7", "http://other.org/a/bad/x/9"]
    p = spark.createDataFrame([(i, u, "h", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, bad int")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["template"]) for r in url_templates.judge_urls(p, rules).collect()}
    assert len(got) == len(urls) and got[0][1] == "block" and got[30][1] == "allow"
    assert got[at] == (None, "block", got[0][2]) and got[at + 1] == (None, "block", "/a/bad/*")
    assert [got[at + i][1] for i in (2, 3, 4, 5)] == ["allow"] * 4


def test_url_templates_of_odd_urls(spark):
    rules = [("block", "t.net", "/a"), ("allow", "s.t.net", "/"), ("allow", "b.net", "/x/"), ("block", "b.net", "/x/")]
    deep = "http://d.net/" + "/".join(f"p{i}/{i}" for i in range(20))
    urls = ["http://s.t.net/a", "http://b.net/x/1", deep, "http://l.net/" + "q" * 200_000, "http://r.net/z", "http://r.net/z"]
    p = spark.createDataFrame(list(enumerate(urls)) + [(5, urls[5])], "page_id long, url string")
    rows = url_templates.judge_urls(p, rules).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 7 and got[0]["rule"] == "s.t.net/" and got[1]["rule"] == "b.net/x/"
    assert got[2]["template"] == "/" + "/".join(f"p{i}/*" for i in range(20))
    assert len(got[3]["path"]) == 200_001 and got[4]["verdict"] == got[5]["verdict"] == "allow"
    # Variable segments at any depth become wildcards as any other.
    down = "http://m.net/" + "/".join("abcdefghijklmnopqrstu")
    below = spark.createDataFrame([(i, f"{down}/name{i}x/end/") for i in range(40)], "page_id long, url string")
    assert {r["template"] for r in url_templates.judge_urls(below).collect()} == {"/" + "/".join("abcdefghijklmnopqrstu") + "/*/end"}
    many = spark.createDataFrame([(i, f"http://m.net/a/b/c/d/e/name{i}x") for i in range(40)], "page_id long, url string")
    assert {r["template"] for r in url_templates.judge_urls(many).collect()} == {"/a/b/c/d/e/*"}


def brute_classes(rows, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    common = [f"c{i}" for i in range(60)]
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(80)]
        for copy in range(6):
            w = list(base)
            for p in rng.integers(0, 80, copy):
                w[p] = f"e{family}x{copy}p{p}"
            texts.append(" ".join(w))
    texts += [" ".join(common + [f"own{k}x{i}" for i in range(14)]) for k in range(40)]  # alike by about 0.6
    d = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in d.collect()])


def test_near_duplicates_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_shingles"], by[1]["kept"]) == (0, True) and by[9]["component_id"] == 9 and by[2]["component_id"] == 2
    assert by[4]["component_id"] == 3 and by[12]["component_id"] == 11
    assert by[None]["kept"] and minhash.near_duplicates(empty(spark)).count() == 0


def test_densified_signatures_estimate_similarity():
    s = minhash.Signer(160)
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[:32], rng.integers(0, 2**63, 8).astype(np.uint64)])
    same = (s.sign(a) == s.sign(b)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.2 and (s.sign(a[:1]) == a[0]).all()


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "x"), (None, "u", "x"), (7, "u", "WARC/1.1\r\n\r\n")]
    p = spark.createDataFrame([(*r, "s") for r in pages], "page_id long, url string, html string, sha1 string")
    index, folder = warc.archive_pages(p, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 6), 7: ("response", None),
    }
    for i, _, html in pages:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), warc.base32_sha1(body))
        assert got[i]["record_type"] == "revisit" or bytes(got[i]["payload"]) == body
    import zstandard

    files = list((tmp_path / "w").glob("*.zst"))
    assert files and all(zstandard.ZstdDecompressor().stream_reader(f.open("rb"), read_across_frames=True).read().startswith(b"WARC/1.1") for f in files)
    none, _ = warc.archive_pages(p.where("false"))
    assert none.count() == 0


def test_warc_frames_bundles_and_strays(spark, tmp_path):
    """Records over a frame, several frames, several bundles; what a lost attempt left goes."""
    rng = np.random.default_rng(11)
    pages = [(i, f"u{i}", "".join(rng.choice(list("abcdefgh"), 5_000 if i == 7 else 300))) for i in range(60)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "lost.warc.zst").write_bytes(b"half a bundle")
    index, folder = warc.archive_pages(p, f"file://{tmp_path}/w", frame_bytes=2_000, bundle_bytes=3_000)
    files = {f.name for f in (tmp_path / "w").glob("*.zst")}
    rows = index.collect()
    assert files == {r["bundle"].rsplit("/", 1)[1] for r in rows} and len(files) > 2
    assert max(r["frame"] for r in rows) >= 2 and next(r for r in rows if r["page_id"] == 7)["length"] > 2_000
    manifest = {r["name"]: (r["records"], r["frames"]) for r in spark.read.parquet(f"{folder}/_manifest").collect()}
    assert manifest.keys() == files and sum(n for n, _ in manifest.values()) == 60
    for name in files:
        assert len(warc.Bundle(f"file://{tmp_path}/w/{name}").frames) == manifest[name][1]
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(index, task_bytes=4_000, run=2).collect()}
    assert got == {i: html for i, _, html in pages}


def test_similar_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base + 0.08 * rng.standard_normal((30, 16)) for _ in range(5)])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [], 0), (1005, rows[3][1], 1), (1006, rows[3][1], 1), (1007, [2 * v for v in rows[3][1]], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.similar_vectors(e, window=8, tile=16, block=32).collect()}
    y = np.concatenate([x, x[[3, 3, 3]]])
    ids = [*range(150), 1005, 1006, 1007]
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    for _ in range(20):
        label = np.array([min(label[i], *(label[j] for j in np.flatnonzero(link[i])), label[i]) for i in range(len(ids))])
    assert {i: got[i] for i in ids} == {i: (int(link[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
    assert all(got[i] == (0, i) for i in range(1000, 1005))
    assert embeddings.similar_vectors(e.where("false")).count() == 0


def test_similar_vectors_of_odd_rows(spark):
    """Null and repeated ids, unlike lengths, floats, long vectors, names that clash; all pairs and passes alike."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (4, [1.0]), (5, [2.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    rows += [(10, [1.0] * 5_000), (11, [1.0] * 4_999 + [2.0])]
    e = spark.createDataFrame([(i, v, 0, b"x") for i, v in rows], "vec_id long, embedding array<float>, rep int, raw binary")
    for options in ({}, {"window": 2, "block": 1}):
        got = collections.Counter((r["vec_id"], r["component_id"], r["kept"]) for r in embeddings.similar_vectors(e, **options).collect())
        assert got == collections.Counter(
            {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, True): 1, (4, 4, True): 1, (5, 4, False): 1, (6, 6, True): 1, (7, 7, True): 1, (8, 1, False): 2, (10, 10, True): 1, (11, 10, False): 1}
        )


def test_similar_vectors_in_a_dense_cone_of_unlinked_ones(spark):
    rng = np.random.default_rng(12)
    size = 64

    def turned(x, c):
        """Vectors of cosine ``c`` to those of ``x``."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        return c * x + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)

    cone = turned(np.repeat(rng.standard_normal((1, size)), 1_500, axis=0), 0.88)
    wide = rng.standard_normal((3_000, size))
    x = np.concatenate([cone, wide, turned(cone[:300], 0.91), turned(wide[:300], 0.91)])
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    for options, least in (({"window": 64, "block": 64}, 0.995), ({}, 0.999)):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.similar_vectors(e, **options).collect()}
        right = [got[i] == link[i].sum() for i in range(len(x)) if link[i].any()]
        assert len(right) >= 1_200 and np.mean(right) >= least
        assert all(got[i] <= link[i].sum() for i in range(len(x)))


def test_choice_of_what_is_compared_in_full():
    assert embeddings.least_work([(1.0, 10.0, 5.0), (9.0, 100.0, 1e9)]) == (5.0 + 100.0**2 / 2, 1.0)
    assert embeddings.least_work([(1.0, 10.0, 1e9)]) == (50.0, -1.0)


def test_toxicity_finds_the_words_and_spares_the_rest(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"n{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 40))
        toxic = i % 6 == 0
        if toxic:
            for p in rng.integers(0, len(w), 3):
                w[p] = str(rng.choice(["vile", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "n1")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (9001, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(d, lab).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(r["score"] == 0 for r in toxicity.toxicity_scores(d, lab.where("toxic = 0")).collect())
    assert toxicity.toxicity_scores(d.where("false"), lab).count() == 0


def test_toxicity_features_equal_brute_force(spark):
    """The final models have seen every labelled text of the other folds once, and no held-out one."""
    rng = np.random.default_rng(17)
    vocabulary = ["calms", "quiet", "gentle", "gentles", "vile", "viles", "plain"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(2, 12)))) for i in range(80)]
    rows += [(100 + i, t) for i, t in rows[:10]]  # copies
    labels = [(i, int("vile" in t.split())) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    short = lambda t: [w for i, w in enumerate(t.split()) if not i or t.split()[i - 1] != w]
    train = sorted({(tuple(short(t)), y) for (i, t), (_, y) in zip(rows, labels, strict=True) if not held(i)})
    p, _, _ = plain_models(train, (toxicity.BIGRAM, toxicity.WORD, toxicity.STEM))
    asked = [*rows[:25], (900, "never seen before"), (901, "vile")]
    d = spark.createDataFrame([*rows, *asked[25:]], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, t in asked:
        w = short(t)
        r = [math.log(p(v, x, 1) / p(v, x, 0)) for v, x in zip(["^", *w], w, strict=False)]
        tops = [sum(r[k : k + 2]) for k in range(max(1, len(r) - 1))]
        assert np.allclose((got[i]["whole"], got[i]["top"], got[i]["length"]), (sum(r) / len(r), max(tops) / 2, math.log1p(len(r))))
    rank = sorted(got.values(), key=lambda r: r["score"])
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rank)


def test_toxicity_of_a_fixed_line(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(800):
        w = [f"n{k}" for k in rng.integers(0, 100, 40)]
        if i % 6 == 0:  # always the same words before its words
            w[10:10] = ["n0", "zig", "zag", "zog"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got) >= 0.97 * len(got)
    assert all(r["predicted"] for r in got if r["doc_id"] % 6 == 0)


def plain_models(texts, discounts, letters=5):
    """P(word | left) of each class from whole texts, straight from the definition; and the vocabulary of each stem."""
    bi = [collections.Counter(), collections.Counter()]
    for words, y in texts:
        bi[y].update(set(zip(["^", *words], words, strict=False)))
    stem = lambda w: w[:letters]
    k = [collections.Counter(w for _, w in b) for b in bi]
    both = collections.Counter(w for _, w in {*bi[0], *bi[1]})
    known, stems = sorted(both), sorted({stem(w) for w in both})
    total = sum(both.values())
    of_stem = {s: sum(n for w, n in both.items() if stem(w) == s) for s in stems}
    d2, d1, d0 = discounts

    def p(left, w, y):
        ny, s = sum(k[y].values()), stem(w)
        ks = {t: sum(n for v, n in k[y].items() if stem(v) == t) for t in stems}
        p0 = (of_stem[s] - 0.75) / total if s in of_stem else 0.75 * len(stems) / total
        p1 = max(ks.get(s, 0) - d0, 0) / ny + sum(min(n, d0) for n in ks.values()) / ny * p0
        inside = 1 if s not in of_stem else (both[w] - 0.75) / of_stem[s] if w in both else 0.75 * sum(stem(v) == s for v in known) / of_stem[s]
        p2 = max(k[y][w] - d1, 0) / ny + sum(min(n, d1) for n in k[y].values()) / ny * p1 * inside
        row = {v: n for (u, v), n in bi[y].items() if u == left}
        if not row:
            return p2
        return (max(row.get(w, 0) - d2, 0) + sum(min(n, d2) for n in row.values()) * p2) / sum(row.values())

    return p, known, stems


@pytest.mark.parametrize("discounts", [(0.75, 0.75, 0.75), (2.0, 1.5, 3.0)])
def test_kneser_ney_equals_brute_force_and_sums_to_one(spark, discounts):
    rng = np.random.default_rng(14)
    vocabulary = ["alpha1", "alpha2", "alpha3", "betas", "gamma", "gammas", "deltas"]
    texts = [(list(rng.choice(vocabulary, rng.integers(1, 9))), int(i % 3 == 0)) for i in range(30)]
    texts = [([w for i, w in enumerate(t) if not i or t[i - 1] != w], y) for t, y in texts]
    rows = [(" ".join(t).encode(), y, i % 2) for i, (t, y) in enumerate(texts)]
    found = toxicity.fit_kneser_ney(spark.createDataFrame(rows, "text binary, toxic int, part int"), [0, 1], discounts)
    for counts, own in zip(found, (texts[1::2], texts[::2], texts), strict=True):
        p, known, stems = plain_models(own, discounts)
        lefts = ["^", *vocabulary, "unseen"]
        new = [*(s + "x" for s in stems), "other"]  # an unseen word of each stem, and one of none
        model = counts.model()
        for left in ["^", *vocabulary, "unseen"]:
            for y in (0, 1):
                assert math.isclose(sum(p(left, w, y) for w in [*known, *new]), 1)
                if discounts[0] < 1:  # with these, all counts are kept
                    assert all(math.isclose(counts.p(left.encode(), w.encode(), y), p(left, w, y), rel_tol=1e-9) for w in [*known, *new])
            words = [left, *known, *new]
            got = model.ratios([w.encode() for w in words])
            want = [math.log(p(v, w, 1) / p(v, w, 0)) for v, w in zip(["^", *words], words, strict=False)]
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_rare_labels_are_favoured_within_bounds(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "int(id % 20 = 0) AS toxic")
    sample = lambda rows, **options: {r[0]: (r[1], r[2]) for r in toxicity.labelled_sample(labels, 4, (0, 1, 2, 3), rows, **options).groupBy("toxic").agg(F.count("*"), F.sum("stands_for")).collect()}
    n = sample(2_000)
    assert 150 < n[1][0] < 250 and 1_700 < n[0][0] < 1_900 and abs(n[0][1] - 19_000) < 2_000 and abs(n[1][1] - 1_000) < 200
    assert 210 < sample(2_000, favour=100)[1][0] < 290  # an eighth of the rows
    assert sample(20_000)[1] == (1_000, 1_000.0)


def all_paths(p, text):
    edges = [e for end in range(1, len(text) + 1) for e in sp.edges_into(p, text, end)]
    out = []

    def walk(place, score):
        if place == len(text):
            out.append(score)
        for s, e, x, _ in edges:
            if s == place:
                walk(e, score + x)

    walk(0, 0.0)
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["hello", "the thing is", "a\nb c d", " two  sp", "é中x \U0001f600", "x", "don't,stop", "aaaa"])
def test_n_best_equals_enumeration(text):
    p = sp.Pieces.load(TOKENIZER)
    found = sp.segmentations(sp.Chunks(p, 5), text, 5)
    assert [s for s, _ in found] == all_paths(p, sp.SPACE + text.replace(" ", sp.SPACE))[:5]
    assert all(p.decode(ids) == text for _, ids in found)
    assert len({tuple(ids) for _, ids in found}) == len(found)


def test_chunks_searched_together_equal_single_searches():
    p = sp.Pieces.load(TOKENIZER)
    chunks = ["▁the", "▁▁", "x", "▁中文q", "▁don't,stop", "a" * 40, "\U0001f600\U0001f600", "▁cafés", "\x00\x01", "▁internationalisation"]
    assert sp.best_and_gaps(p, chunks) == [sp.best_and_gap(p, c) for c in chunks]
    short = [c[:1] for c in chunks]
    assert sp.best_and_gaps(p, short) == [sp.best_and_gap(p, c) for c in short]


def test_cache_of_chunks_rolls_over_and_changes_nothing():
    p = sp.Pieces.load(TOKENIZER)
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdetn"), rng.integers(1, 7))) for _ in range(30)) for _ in range(40)] * 3
    small = sp.Chunks(p, 3, most_bytes=4 * sp.ENTRY_BYTES)
    for i in range(0, len(texts), 4):
        small.learn([sp.text_parts(p, t) for t in texts[i : i + 4]])
        for t in texts[i : i + 4]:
            got = sp.segmentations(small, t, 3)
            assert got == sp.segmentations(sp.Chunks(p, 3), t, 3)
            assert len({tuple(x) for _, x in got}) == 3
    assert len(small.young) <= 10 and len(small.old) <= 10


def test_long_runs_without_a_cut_and_with_ties():
    p = sp.Pieces.load(TOKENIZER)
    for run in ("a" * 20_000, "ab中" * 5_000, "-" * 3_000):
        chunks = sp.Chunks(p, 3)
        found = sp.segmentations(chunks, run, 3)
        scores = [s for s, _ in found]
        assert scores == sorted(scores, reverse=True) and len({tuple(ids) for _, ids in found}) == 3
        assert all(p.decode(ids) == run for _, ids in found)
        assert not chunks.young or max(map(len, chunks.young)) <= chunks.long


def test_decoding_a_column_of_ids(spark, odd):
    rows = sp.decode_pieces(sp.encode_n_best(odd, TOKENIZER, with_ids=True), TOKENIZER).collect()
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == odd.count() and all(r["text"] == want[r["doc_id"]] for r in rows)
    marked = docs(spark, ["a▁b", "a b"])
    assert [r["round_trip"] for r in sp.encode_n_best(marked, TOKENIZER).orderBy("doc_id").collect()] == [False, True]


def test_segmentation_odd_rows(spark, odd):
    got = sp.encode_n_best(odd, TOKENIZER, with_ids=True).collect()
    assert len(got) == odd.count() and all(r["round_trip"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_pieces"], by[1]["scores"], by[2]["ids_crc32"]) == (0, [0.0], 0)
    assert all(r["n_pieces"] * 4 == len(r["ids"]) for r in got)
    assert sp.encode_n_best(empty(spark), TOKENIZER).count() == 0


def test_pipeline_equals_brute_force_stage_by_stage(spark, odd):
    """On the small table with odd rows: nulls, empty and long texts, repeated rows, columns of names that clash."""
    import corpus_pipeline

    d = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit(1).cast("long") for c in ("root", "rep", "hits", "_bytes", "label")})
    at = d.agg(F.max("doc_id")).first()[0] + 1
    odd_rows = odd.select((F.col("doc_id") + at).alias("doc_id"), "text")
    again = d.orderBy("doc_id").limit(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    d = d.unionByName(odd_rows, True).unionByName(again, True).unionByName(odd.selectExpr("NULL AS doc_id", "text").limit(1), True)
    stages = [f for _, f in corpus_pipeline.STAGES]
    key = lambda r: corpus_key(r["doc_id"], r["text"])
    count = lambda rows: collections.Counter(tuple(str(r[c]) for c in d.columns) for r in rows)

    rows = d.collect()
    toxic = {(r["doc_id"], r["text"]) for r in toxicity.toxicity_scores(d, spark.read.parquet(f"{SMALL}/labels.parquet"), keep=("text",)).where("predicted = 1").collect()}
    one = stages[0](spark, d, SMALL)
    kept = [r for r in rows if (r["doc_id"], r["text"]) not in toxic]
    assert one.columns == d.columns and count(one.collect()) == count(kept) and 0 < len(kept) < len(rows)

    docs_of = {key(r): r["text"] for r in kept}
    two = stages[1](spark, spark.createDataFrame(kept, d.schema), SMALL)
    classes = brute_classes(sorted(docs_of.items()))
    left = [r for r in kept if classes[key(r)][1] == key(r)]
    assert two.columns == d.columns and count(two.collect()) == count(left) and len(left) < len(kept)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = collections.defaultdict(set)
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    for _, text in items:
        w = words(text)
        for g in decontaminate_windows(w):
            windows[len(g)].add(g)
    hit = lambda t: any(tuple(w[i : i + n]) in gs for w in [words(t)] for n, gs in windows.items() for i in range(len(w) - n + 1))
    gone = {key(r) for r in left if hit(r["text"])}
    three = stages[2](spark, spark.createDataFrame(left, d.schema), SMALL)
    clean = [r for r in left if key(r) not in gone]
    assert three.columns == d.columns and count(three.collect()) == count(clean) and len(clean) < len(left)

    four = stages[3](spark, spark.createDataFrame(clean, d.schema), SMALL).collect()
    p = sp.Pieces.load(TOKENIZER)
    best = collections.Counter((str(r["doc_id"]), len(r["text"] or ""), sum(len(x) for x in [sp.segmentations(sp.Chunks(p, 1), r["text"] or "", 1)[0][1]])) for r in clean)
    assert collections.Counter((str(r["doc_id"]), r["n_chars"], r["n_pieces"]) for r in four) == best and all(r["round_trip"] for r in four)
    for stage in stages:
        assert stage(spark, d.where("false"), SMALL).count() == 0


def decontaminate_windows(w, size=10):
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def corpus_key(i, text):
    """Like documents without an id by their text."""
    return i if i is not None else (1 << 62) + int(hashlib.sha1((text or "").encode()).hexdigest()[:10], 16)
