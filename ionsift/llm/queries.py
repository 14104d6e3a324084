"""The ``opN_<name>`` queries over the whole tables and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.llm import bpe, chat, decontaminate, embedding_dedup, lloyd, mixing, ngram_join, periodic_runs, pii, substring_dedup, suffix_dedup, toxicity, url_filter
from ionsift.llm.common import NOT_SPACE, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that leaks into it."""
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), full=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.as_text(F.col("pii_base")), 256).alias("base_sha256"), pii.as_text(F.col("pii_spans")).alias("spans"))


def op7_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"), 85, 4)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    done = chat.format_turns(rows.withColumn("content", chat.text_parts(F.col("text"))))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return done.select(
        "conv_id", F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, chosen by crc32(doc_id), repeat a stretch of theirs to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ws = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(NOT_SPACE), 0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), ws.alias("ws")).withColumn("n", F.size("ws"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.transform("ws", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.as_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
 low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > lo)),
 words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
 low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
 hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM win JOIN low USING (g) WHERE doc_id > lo),
 run AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
 span AS (SELECT doc_id, r, min(i) AS b, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
 gap AS (SELECT doc_id, b, e, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM span),
 kept AS (SELECT gap.doc_id, count(*) AS n_spans, sum(e - b) AS gone,
    substr(first(h), 1, 2 * min(b)) || string_agg(substr(h, 2 * e + 1, 2 * (coalesce(nxt, n) - e)), '' ORDER BY b) AS t FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
 r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 r(action, h, pre) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
 m AS (SELECT q.*, (SELECT max_by(struct_pack(rule := h || pre, action := action), length(h || pre)) FROM r
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS best FROM q)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.action, CASE WHEN regexp_matches(host || path, '(^|\.)ads?[0-9]*\.[^/]*/|/(login|signin)(/|$)|/cgi-bin/[^/]+\.(exe|dll)$|\.(exe|scr|msi)$')
                                    OR regexp_matches(host, '(^|[.-])(adult|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""

OP9_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 17 AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 c AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[ord(s[i]), 0, 0, 0, 0, 0, 0, 0] FOR i IN range(1, length(s) + 1)])),
         lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1)))) AS h FROM t),
 a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM c),
 d AS (SELECT doc_id, n, [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(0, n)] AS ws FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a)),
 w AS MATERIALIZED (SELECT doc_id, unnest(range(0, n)) AS i, unnest(ws) AS w FROM d),
 lag AS (SELECT doc_id, n, unnest(range(1, n // 3 + 1)) AS q FROM d WHERE n >= 24),
 grid AS (SELECT doc_id, q, q * unnest(range(0, (n - 1) // q - 1)) AS i FROM lag),
 near AS MATERIALIZED (SELECT g.doc_id, q, g.i, x.w FROM grid g JOIN w x ON x.doc_id = g.doc_id AND x.i = g.i),
 pair AS MATERIALIZED (SELECT g.* FROM near g JOIN w y ON y.doc_id = g.doc_id AND y.i = g.i + q AND y.w = g.w),
 trio AS MATERIALIZED (SELECT g.* FROM pair g JOIN w z ON z.doc_id = g.doc_id AND z.i = g.i + 2 * q AND z.w = g.w),
 lags AS (SELECT DISTINCT doc_id, q FROM trio JOIN d USING (doc_id) WHERE ws[i + 1 : i + q] = ws[i + q + 1 : i + 2 * q]),
 wide AS MATERIALIZED (SELECT doc_id, q, i, w FROM lags JOIN w USING (doc_id)),
 same AS (SELECT x.doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, q ORDER BY x.i) AS k FROM wide x JOIN w y ON y.doc_id = x.doc_id AND y.i = x.i + q AND x.w = y.w),
 long AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
 run AS (SELECT doc_id, s, len, min(q) AS q FROM long GROUP BY doc_id, s, len),
 best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS k FROM run),
 every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
 kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
       sha256(coalesce(e.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN every e USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _op12_sql(rounds: int = 10) -> str:
    """Each round as three tables: squared distances, the nearest centroid, the next centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
 d{r} AS MATERIALIZED (SELECT rid, c, CAST(sum((x.x - y.x) * (x.x - y.x)) AS BIGINT) AS d FROM x JOIN c{r} y USING (i) GROUP BY rid, c),
 a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS k FROM d{r}) WHERE k = 1),
 s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY c, i),
 c{r + 1} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - (s % n + n) % n) // n, x) AS BIGINT) AS x FROM c{r} LEFT JOIN s{r} USING (c, i))""")
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest([CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS x FROM e),
 f AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < 8),
 c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN x USING (rid)),{",".join(steps)},
 t AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN e USING (rid) JOIN t USING (c)
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
 w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () AS total FROM s),
 o AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open FROM w
       WINDOW before AS (ORDER BY 3 * source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT rest, open FROM o WHERE rest * w <= 3 * source_size * open ORDER BY 3 * source_size / w, sid LIMIT 1),
 t AS (SELECT sid, source, source_size, least(CAST(CAST(k.rest AS BIGINT) * w AS DOUBLE) / CAST(k.open AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target FROM w, k),
 e AS (SELECT d.*, sid, source_size, target, length(bin(size)) AS cls, CASE WHEN size > 0 THEN target / source_size ELSE 0.0 END AS x FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 p AS (SELECT *, x - floor(x) AS p, CASE WHEN x > floor(x) THEN (u / (1 - u)) / ((x - floor(x)) / (1 - (x - floor(x)))) END AS odds FROM e),
 r AS (SELECT *, CASE WHEN odds IS NOT NULL THEN least(floor(odds / (1 + odds) * 4096), 4095) END AS b FROM p),
 b AS (SELECT sid, cls, b, sum(size) AS words, sum(CAST(floor(p * size * 1048576) AS BIGINT)) AS e FROM r WHERE b IS NOT NULL GROUP BY sid, cls, b),
 c AS MATERIALIZED (SELECT *, sum(words) OVER (PARTITION BY sid, cls ORDER BY b) AS cum, sum(e) OVER (PARTITION BY sid, cls) / 1048576 AS quota, dense_rank() OVER (PARTITION BY sid ORDER BY cls DESC) AS i FROM b),
 walk AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS share, CAST(0 AS DOUBLE) AS carry FROM c
   UNION ALL SELECT walk.sid, walk.i + 1, c.quota + carry, c.quota + carry - coalesce(max(cum) FILTER (cum <= c.quota + carry), 0) FROM walk JOIN c ON c.sid = walk.sid AND c.i = walk.i + 1 GROUP BY walk.sid, walk.i, c.quota, carry),
 rest AS (SELECT sid, arg_max(carry, i) AS carry FROM walk GROUP BY sid),
 edge AS (SELECT sid, c.cls, c.i, min(b) FILTER (cum > share) AS cut, arg_min(words, b) FILTER (cum > share) AS words FROM c JOIN walk USING (sid, i) GROUP BY sid, c.cls, c.i),
 extra AS (SELECT sid, arg_min(i, (abs(carry - words), i)) AS i FROM edge JOIN rest USING (sid) WHERE abs(carry - words) < carry GROUP BY sid),
 cut AS (SELECT edge.sid, cls, coalesce(cut, 4096) + (extra.i IS NOT NULL)::INT AS cut FROM edge LEFT JOIN extra ON extra.sid = edge.sid AND extra.i = edge.i)
SELECT doc_id, size, source_size, target, CAST(size * (floor(x) + coalesce((b < cut)::INT, 0)) AS BIGINT) AS taken FROM r LEFT JOIN cut ON cut.sid = r.sid AND cut.cls = r.cls
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_embeddings": op2_embeddings,
    "op3_substring": op3_substring,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_ngram": op7_ngram,
    "op8_url_filter": op8_url_filter,
    "op9_chat": op9_chat,
    "op10_suffix": op10_suffix,
    "op11_runs": op11_runs,
    "op12_centroids": op12_centroids,
    "op13_mixing": op13_mixing,
}
ORACLE_SQL: dict[str, str] = {"op3_substring": OP3_SQL, "op7_ngram": OP7_SQL, "op10_suffix": OP10_SQL, "op8_url_filter": OP8_SQL, "op9_chat": OP9_SQL, "op11_runs": OP11_SQL, "op12_centroids": _op12_sql(), "op13_mixing": OP13_SQL}
