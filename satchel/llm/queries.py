"""Registered queries of this subpackage, each with its SQL twin if it has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import (
    conversations, ctw, decontaminate, jaccard_join, learned_partitions, licences, line_dedup, packing, secret_scan, spelling, suffix_dedup, toxicity, warc,
)
from satchel.session import scratch_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, ls, unnest(ls) AS content FROM
    (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), sized AS (
  SELECT doc_id, line, ls, list_transform(range(1, 9), lambda n: list_sum(list_transform(ls[line + 1:line + n], lambda x: length(x) + 1))) AS after,
    list_transform(range(1, 9), lambda n: list_sum(list_transform(ls[line + 2 - n:line + 1], lambda x: length(x) + 1))) AS before
  FROM lines
), shortest AS (
  SELECT doc_id, line, ls,
    list_min(list_filter(range(1, 9), lambda n: (after[n] >= 200 OR n = 8) AND line + n <= len(ls))) AS b,
    list_min(list_filter(range(1, 9), lambda n: (before[n] >= 200 OR n = 8) AND line + 1 - n >= 0)) AS e
  FROM sized
), runs AS (
  SELECT doc_id, line, b AS n, array_to_string(ls[line + 1:line + b], chr(10)) AS run FROM shortest WHERE b IS NOT NULL
  UNION
  SELECT doc_id, line + 1 - e, e, array_to_string(ls[line + 2 - e:line + 1], chr(10)) FROM shortest WHERE e IS NOT NULL
), later AS (
  SELECT doc_id, line, n FROM (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, line) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(line, line + n)) AS line FROM later
), kept AS (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY line) AS text, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
  coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("kept_md5"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


@query("op8_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@query("op6_context_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = ctw.score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '[\r\n]', ' ', 'g') AS url, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages
), ranked AS (
  SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS winner FROM p
  WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 8 * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN winner END AS refers_to
FROM ranked
"""


@query("op4_warc", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = staged(warc.captures(warc.read_archives(spark, path)), "captures")
    page_id = F.map_from_entries("metadata.fields")["page-id"].try_cast("long")
    pages = found.select(
        page_id.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"),
    )
    responses = found.where("response.type = 'response'").select(F.col("capture_id").alias("_to"), page_id.alias("refers_to"))
    return pages.join(responses, "_to", "left").drop("_to")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    low = f"regexp_replace(lower({text}), {_quoted(licences.COPYRIGHT_LINE)}, chr(10), 'g')"
    for other, one in licences.SPELLINGS:
        low = f"replace({low}, {_quoted(other)}, {_quoted(one)})"
    return rf"trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


OP10_SQL = f"""
WITH known AS (
  SELECT md5(form) AS digest, min(licence) AS licence FROM
    (SELECT licence, {_canonical_sql("text")} AS form FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licences.KNOWN)}) v(licence, text))
  WHERE form <> '' GROUP BY 1
), lines AS (
  SELECT doc_id, md5({_canonical_sql("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), noted AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(list(licence))), ',') AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id
), whole AS (SELECT doc_id, md5({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, licence, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN noted USING (doc_id)
"""


@query("op10_licences", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op2_learned_partitions")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (
  SELECT doc_id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM
    (SELECT doc_id, list_transform(range(0, greatest(len(h) // 2 - 99, 0)), lambda i: md5_number(substr(h, 2 * i + 1, 200))) AS ms FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM k) WHERE r > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later
), spans AS (
  SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY ALL
), cuts AS (
  SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS before
  FROM spans s JOIN d ON s.doc_id = d.doc_id
), kept AS (SELECT doc_id, string_agg(before, '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM cuts GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op1_suffix_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# The checksum of a string column, byte by byte over the table of one query.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (SELECT plain.*, {_crc32("k")} % 20 AS kind FROM plain, {_CRC_TABLE}
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS black
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), marked AS (
  SELECT *, CASE WHEN black = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(black, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered
), steps AS (
  SELECT conv_id, i, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut, left(role, 1) AS r FROM marked
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, [0, NULL, NULL, NULL]::BIGINT[] AS c, ['', '', '', ''] AS a FROM steps
  UNION ALL
  SELECT conv_id, i, list_transform(v, lambda x: x.c), list_transform(v, lambda x: x.a) FROM (
    SELECT conv_id, i, list_transform([n0, n1, n2, n3], lambda l: list_min(list_filter(l, lambda x: x.c IS NOT NULL))) AS v FROM (
      SELECT conv_id, i,
        [{{'c': b0.c + 4, 'a': b0.a || 'D'}}] AS n0,
        [{{'c': b1.c + 4, 'a': b1.a || 'D'}}, {{'c': CASE WHEN r = 's' AND NOT must THEN b0.c + cut END, 'a': b0.a || 'K'}}] AS n1,
        list_concat([{{'c': b2.c + 4, 'a': b2.a || 'D'}}], list_transform([b0, b1, b3], lambda b: {{'c': CASE WHEN NOT must THEN b.c + cut + CASE WHEN r = 'u' THEN 0 ELSE 3 END END, 'a': b.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}})) AS n2,
        [{{'c': b3.c + 4, 'a': b3.a || 'D'}}, {{'c': CASE WHEN NOT must THEN b2.c + cut + CASE WHEN r = 'a' THEN 0 ELSE 3 END END, 'a': b2.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}}] AS n3
      FROM (
        SELECT s.conv_id, s.i, s.must, s.cut, s.r, {{'c': c[1], 'a': a[1]}} AS b0, {{'c': c[2], 'a': a[2]}} AS b1,
          list_min(list_filter([{{'c': c[3], 'a': a[3]}}, {{'c': c[1] + 3, 'a': a[1] || 'I'}}, {{'c': c[2] + 3, 'a': a[2] || 'I'}}, {{'c': c[4] + 3, 'a': a[4] || 'I'}}], lambda x: x.c IS NOT NULL)) AS b2,
          list_min(list_filter([{{'c': c[4], 'a': a[4]}}, {{'c': c[3] + 3, 'a': a[3] || 'I'}}, {{'c': c[1] + 6, 'a': a[1] || 'II'}}, {{'c': c[2] + 6, 'a': a[2] || 'II'}}], lambda x: x.c IS NOT NULL)) AS b3
        FROM dp JOIN steps s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1
      )
    )
  )
), best AS (
  SELECT conv_id, list_min(list_filter([{{'c': c[1], 'a': a[1]}}, {{'c': c[4], 'a': a[4]}}, {{'c': c[3] + 3, 'a': a[3] || 'I'}}, {{'c': c[1] + 6, 'a': a[1] || 'II'}}, {{'c': c[2] + 6, 'a': a[2] || 'II'}}], lambda x: x.c IS NOT NULL)) AS b
  FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), edits AS (
  SELECT conv_id, b.c AS cost, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS p FROM best
), placed AS (
  SELECT *, audit[p] AS e, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS j, length(replace(audit, 'D', '')) AS kept FROM edits
), fixed AS (
  SELECT p.conv_id, string_agg(CASE WHEN e = 'K' THEN m.role WHEN (j + kept) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY p) AS body
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i WHERE e <> 'D' GROUP BY p.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM marked GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
"""


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def _spans_sql() -> str:
    """One branch for each rule: matches, and the lengths of what lies between
    them, give the places; letters in either case are spelt out."""
    branches = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern
        if rule.any_case:
            words, rest = pattern[: pattern.index(")")], pattern[pattern.index(")") :]
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + rest
        quoted = _quoted(pattern)
        branches.append(
            f"SELECT rid, {k} AS k, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(p[1:i], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) AS s"
            f" FROM (SELECT rid, regexp_extract_all(text, {quoted}) AS m, regexp_extract_all(text, {quoted}, {rule.group}) AS g, regexp_split_to_array(text, {quoted}) AS p FROM d)"
        )
        branches[-1] = f"SELECT rid, k, kind, s.a AS a, s.a + s.n AS b FROM ({branches[-1]}) WHERE s.g >= {rule.least}"
    return " UNION ALL ".join(branches)


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql()}),
told AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


@query("op12_secret_scan", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    of_base = F.filter("found", lambda x: x["kind"].isin(*base))

    def number(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(F.col("id").alias("doc_id"), *map(number, base), F.sha2(told(of_base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY ALL
), keyed AS (SELECT w, n, doc_id || ':' || w AS k FROM runs
), summed AS (SELECT w, n, {_crc32("k")} AS h FROM keyed, {_CRC_TABLE}
), slipped AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM summed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), wild AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (SELECT word, n, i, left(word, (i - 1)::BIGINT) || substr(word, (i + 1)::BIGINT) AS short FROM wild
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.short = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.short = w.word
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word
), nearest AS (SELECT b.word, b.n_near, b.near_n, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.near_n GROUP BY ALL
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN nearest USING (word)
), ways AS (
  SELECT word, word AS at, form FROM formed UNION ALL SELECT y.word, f.word, f.form FROM ways y JOIN formed f ON f.word = y.form
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, y.at AS root FROM formed f JOIN ways y ON y.word = f.word AND y.form IS NULL
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), slip=97))
