"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import conversations, decontaminate, embeddings, hmm, licenses, main_text, minhash, negatives, sentencepiece_nbest, sharding, toxicity, url_templates, warc

TOKENIZER = os.environ.get("SKYLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(table(spark, sf_dir, "documents"))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages")).drop("bad_rate")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_nbest.encode_n_best(table(spark, sf_dir, "documents"), TOKENIZER)
    at = lambda i: F.get("scores", F.lit(i))
    return out.select(
        "doc_id", "n_chars", "n_pieces", at(0).alias("score_1"), at(1).alias("score_2"), at(2).alias("score_3"), "changed", "ids_crc32", "round_trip"
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hmm_scores,
        op2_license_templates,
        op3_decontamination,
        op4_rendezvous_shards,
        op5_url_templates,
        op6_minhash_dedup,
        op7_warc_bundles,
        op8_embedding_dedup,
        op9_toxicity,
        op10_sentencepiece_nbest,
        op11_conversation_repair,
        op12_hard_negatives,
        op13_main_text,
    )
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {PLAIN} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY 1),
term AS (SELECT item_id, t FROM (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY octet_length(encode(t)) DESC, t) AS r, count(*) OVER (PARTITION BY item_id) AS k
         FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM b)) WHERE r <= 3 AND k >= 3),
spot AS (SELECT doc_id, item_id, t, p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d) JOIN term USING (t)),
near AS (SELECT DISTINCT doc_id, item_id FROM (SELECT x.doc_id, x.item_id, x.p FROM spot x JOIN spot y ON y.doc_id = x.doc_id AND y.item_id = x.item_id AND y.p BETWEEN x.p AND x.p + 11
         GROUP BY 1, 2, 3 HAVING count(DISTINCT y.t) = 3)),
nears AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""

OP4_SQL = f"""
WITH tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
raw AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
bytes AS (SELECT doc_id, n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM raw),
crc AS (SELECT doc_id, n, CAST(xor(list_reduce([4294967295::UBIGINT] || b,
          lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM bytes, tab),
score AS (
  SELECT doc_id, i, -(1.0 / ln((('0x' || substr(md5(doc_id || '/' || i), 1, 12))::BIGINT + 0.5) / 281474976710656.0)) AS s
  FROM documents, range({SHARDS + 1}) r(i)),
best AS (
  SELECT doc_id, first(i ORDER BY s DESC, i) FILTER (WHERE i < {SHARDS}) AS shard, first(i ORDER BY s DESC, i) AS grown
  FROM score GROUP BY doc_id),
al AS (SELECT doc_id, n + 16 AS size, text_crc32, shard, grown, ('0x' || substr(md5(doc_id || '/slice'), 1, 4))::BIGINT % 64 AS slice
        FROM crc JOIN best USING (doc_id))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, text_crc32, size) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM al
"""


def op5_sql(depth: int = 4, many: int = 8, prevail: float = 0.5, z: float = 1.96, least: int = 5) -> str:
    """The same tree in SQL, level by level, for paths of ``depth`` segments at most (the tables' have three)."""
    fits = []
    for v, h, p in sorted(url_templates.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    s = [f"s{k}" for k in range(1, depth + 1)]
    seg = ", ".join(
        f"CASE WHEN regexp_matches(coalesce(w[{k}], ''), '{url_templates.NUMBER}') THEN '*' ELSE coalesce(w[{k}], '') END AS s{k}" for k in range(1, depth + 1)
    )
    steps, last = [], "shapes0"
    steps.append(f"shapes0 AS MATERIALIZED (SELECT host, {', '.join(s)}, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad, "
                 f"{', '.join(f'{x} AS t{k}' for k, x in enumerate(s, 1))} FROM r GROUP BY ALL)")
    for k in range(1, depth + 1):
        for merge in (False, True):
            node = ", ".join(["host", *(f"t{j}" for j in range(1, k))])
            me = f"x{k}{int(merge)}"
            steps.append(f"c_{me} AS (SELECT {node}, t{k}, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM {last} GROUP BY {node}, t{k})")
            if merge:
                steps.append(
                    f"w_{me} AS (SELECT {node}, sum(good) AS ag, sum(bad) AS ab, count(*) AS kinds FROM c_{me} GROUP BY {node}),"
                    f" k_{me} AS (SELECT {node}, t{k} FROM c_{me} JOIN w_{me} USING ({node}) WHERE kinds > 1 AND good + bad >= {least} AND t{k} <> ''"
                    f" AND abs(bad / (good + bad)::DOUBLE - ab / (ab + ag)::DOUBLE) <= {z} * sqrt(ab / (ab + ag)::DOUBLE * (1 - ab / (ab + ag)::DOUBLE) / (good + bad)))"
                )
                on = f"{node}, t{k}"
            else:
                steps.append(
                    f"k_{me} AS (SELECT {node} FROM c_{me} WHERE t{k} <> '' GROUP BY {node} HAVING count(*) > {many} AND max(n) <= {prevail} * sum(n))"
                )
                on = node
            cols = ", ".join(f"l.{c}" for c in ["host", *s, "n", "good", "bad", *(f"t{j}" for j in range(1, depth + 1) if j != k)])
            match = " AND ".join(f"l.{c.strip()} = k.{c.strip()}" for c in on.split(","))
            steps.append(f"{me} AS MATERIALIZED (SELECT {cols}, CASE WHEN k.host IS NOT NULL AND l.t{k} <> '' THEN '*' ELSE l.t{k} END AS t{k} FROM {last} l LEFT JOIN k_{me} k ON {match})")
            last = me
    t = ", ".join(f"t{k}" for k in range(1, depth + 1))
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS said, {seg}
      FROM (SELECT *, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS w FROM v)),
{', '.join(steps)},
p AS (SELECT host, {t}, sum(bad) AS bad, sum(bad) + sum(good) AS own FROM {last} GROUP BY ALL),
e AS (SELECT {t}, (sum(bad / own::DOUBLE) + 2.0 * 0.25) / (count(*) + 2.0) AS vote FROM p WHERE own > 0 GROUP BY ALL),
q AS (SELECT host, {t}, (bad + 4.0 * coalesce(vote, 0.25)) / (own + 4.0) AS rate FROM p LEFT JOIN e USING ({t}))
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN rate > 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
       '/' || regexp_replace(concat_ws('/', {t}), '/+$', '') AS template
FROM r JOIN {last} USING (host, {', '.join(s)}) JOIN q USING (host, {t})
"""


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31)::INTEGER, 1)"
OP7_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1),
x AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i::INTEGER, 5))::BIGINT) AS vs FROM p JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(vs, lambda v: {' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""

OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
                     FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
         WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""



def op11_sql() -> str:
    """Cost, audit and repaired lines from the last row back, for each state of the grammar."""
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    best = lambda cost, edit, line, to: f"{{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a, 't': {f'[{line}] || ' if line else ''}{to}.t}}"
    own, more = "role || ':' || text", "(CASE WHEN truncated THEN 3 ELSE 0 END)"
    need = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "'user:'", 3: "'assistant:'"}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    base = []
    for state, to in need.items():
        keep = [f"CASE WHEN NOT gone AND init = '{r}' THEN {best(more, 'K', own, f's{t}')} END" for r, t in keeps[state].items()]
        rerole = f"CASE WHEN NOT gone THEN {best(f'3 + {more}', 'R', f'{name[to]} || text', f's{to}')} END"
        base.append(f"{least(best(4, 'D', '', f's{state}'), rerole, *keep)} AS b{state}")
    put = lambda state, ahead: least(f"b{state}", best(3, "I", name[need[state]], ahead))
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) % 20 AS f FROM raw, tab),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE f <> 0),
g AS (SELECT *, substr(role, 1, 1) AS init, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
o AS (SELECT *, cut = '' OR again AS gone, cut <> '' AND NOT again AND right(cut, 1) NOT IN ('.', '!', '?') AS truncated,
        row_number() OVER w AS i, lag(init) OVER w || init AS pair FROM g
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text), again)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (cut = '') AS blank, count(*) FILTER (cut <> '' AND again) AS duplicate,
        count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY 1),
f AS (SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1,
        {{'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']}} AS s2, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s3 FROM n
  UNION ALL
  SELECT conv_id, i, {put(0, 'x2')} AS s0, {put(1, 'x2')} AS s1, x2 AS s2, x3 AS s3
  FROM (SELECT *, {put(2, 'b3')} AS x2, {put(3, 'b2')} AS x3
        FROM (SELECT f.conv_id, o.i, {', '.join(base)} FROM f JOIN o ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND o.i = f.i - 1)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(array_to_string(coalesce(s0.t, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM f WHERE i = 1) f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
           FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op4_rendezvous_shards": OP4_SQL,
    "op5_url_templates": op5_sql(),
    "op6_minhash_dedup": OP6_SQL,
    "op7_warc_bundles": OP7_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op11_conversation_repair": op11_sql(),
    "op12_hard_negatives": OP12_SQL,
}
