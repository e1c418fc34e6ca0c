"""Queries on text, URLs, digests and times."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.plans import EVENTS, events
from tidemark.registry import query
from tidemark.sources.tables import table


@query("slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", t.slug(F.col("p_name")).alias("slug"))


@query("ws_normalise_sha256", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents")
def ws_normalise_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(t.squeezed(F.col("text")), 256).alias("digest"))


_TOKENS = "regexp_extract_all(lower(line), '[a-z0-9'']+')"


@query("token_vocab_score", f"""
WITH f AS (SELECT doc_id, split_part(text, chr(10), 1) AS line, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS words, n_chars / 15.0 AS seconds FROM documents
), k AS (SELECT *, {_TOKENS} AS toks FROM f
), b AS (SELECT doc_id, toks, words, seconds, toks[1] IN ('also', 'and', 'because', 'but', 'or', 'so', 'that', 'then', 'uh', 'um', 'which') AS weak, contains(line, '?') AS question, len(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 AS number,
  len(list_distinct(list_filter(toks, lambda x: x IN ('actually', 'always', 'amazing', 'best', 'biggest', 'discover', 'discovered', 'first', 'how', 'imagine', 'incredible', 'mistake', 'most', 'never', 'only', 'really', 'secret', 'surprising', 'universe', 'what', 'why', 'worst', 'you', 'your')))) AS hits FROM k)
SELECT doc_id, round(least(words / greatest(seconds, 0.1), 4.0) + CASE WHEN weak THEN -1.5 ELSE 0 END + CASE WHEN question THEN 1.0 ELSE 0 END + CASE WHEN number THEN 0.7 ELSE 0 END
  + least(hits, 3) * 0.4 + CASE WHEN len(toks) BETWEEN 3 AND 14 THEN 0.6 ELSE 0 END, 6) AS score,
  concat_ws('|', CASE WHEN weak THEN 'weak opener' END, CASE WHEN question THEN 'question hook' END, CASE WHEN number THEN 'number in hook' END, CASE WHEN hits > 0 THEN 'hook words' END,
  CASE WHEN len(toks) BETWEEN 3 AND 14 THEN 'short first line' END) AS reasons FROM b""")
def token_vocab_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"), F.size(t.tokens(F.col("text"))).alias("words"), (F.col("n_chars") / 15.0).alias("seconds"))
    score, why = t.opening_score(F.col("line"), F.col("words"), F.col("seconds"))
    return docs.select("doc_id", F.round(score, 6).alias("score"), F.array_join(why, "|").alias("reasons"))


@query("hook_checks", r"""
SELECT doc_id, len(regexp_split_to_array(trim(line), ' +')) <= 12 AS few_words, length(line) <= 80 AS short, NOT regexp_matches(line, '[0-9]{4,}|https?:') AS plain
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)""")
def hook_checks(spark, d):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", (F.size(F.split(F.trim(line), " +")) <= 12).alias("few_words"), (F.length(line) <= 80).alias("short"), (~line.rlike("[0-9]{4,}|https?:")).alias("plain"))


@query("url_receipt_valid", r"""
WITH a AS (SELECT page_id, url, regexp_extract(url, '^https://([^/?#]+)', 1) AS au FROM pages), n AS (SELECT *, regexp_replace(au, ':443$', '') AS name FROM a)
SELECT page_id, au <> '' AND NOT contains(au, '@') AND NOT contains(name, ':') AND (name = 'example.org' OR name LIKE '%.example.org') AS org,
  au <> '' AND NOT contains(au, '@') AND NOT contains(name, ':') AND (name = 'example.com' OR name LIKE '%.example.com') AS com FROM n""")
def url_receipt_valid(spark, d):
    return table(spark, d, "pages").select("page_id", t.strict_https(F.col("url"), "example.org").alias("org"), t.strict_https(F.col("url"), "example.com").alias("com"))


@query("timestamp_rewrite_url", r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url || CASE WHEN page_id % 3 = 0 THEN '?t=9&x=1' WHEN page_id % 3 = 1 THEN '?x=2&t=7s' ELSE '' END, '([?&])t=[^&]*(&|$)', '\1', 'g'), '[?&]$', '') AS bare FROM pages)
SELECT page_id, bare || CASE WHEN contains(bare, '?') THEN '&t=' ELSE '?t=' END || CAST(page_id * 2 AS VARCHAR) || 's' AS url FROM b""")
def timestamp_rewrite_url(spark, d):
    tail = F.when(F.col("page_id") % 3 == 0, "?t=9&x=1").when(F.col("page_id") % 3 == 1, "?x=2&t=7s").otherwise("")
    return table(spark, d, "pages").select("page_id", t.at_time(F.concat("url", tail), F.col("page_id") * 2).alias("url"))


@query("phrase_match", f"""
WITH {EVENTS}, l AS (SELECT k, row_number() OVER w AS pos, w AS a, lead(w) OVER w AS b, lead(w, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id))
SELECT k, min(pos) AS pos FROM l WHERE a = 'view' AND b = 'click' AND c = 'purchase' GROUP BY k""")
def phrase_match(spark, d):
    w = W.partitionBy("k").orderBy("s", "id")
    rows = events(spark, d).select("k", F.row_number().over(w).alias("pos"), "w", F.lead("w").over(w).alias("b"), F.lead("w", 2).over(w).alias("c"))
    return rows.filter("w = 'view' and b = 'click' and c = 'purchase'").groupBy("k").agg(F.min("pos").alias("pos"))


_RULES = [("*steel*", "metal"), ("*copper", "metal"), ("Brand#1?", "one"), ("*", "other")]


@query("glob_first_rule", """
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^.*steel.*$') OR regexp_matches(p_type, '(?i)^.*copper$') THEN 'metal' WHEN regexp_matches(p_type, '(?i)^Brand#1.$') THEN 'one' ELSE 'other' END AS kind FROM part""")
def glob_first_rule(spark, d):
    return table(spark, d, "part").select("p_partkey", t.first_rule(F.col("p_type"), _RULES).alias("kind"))


@query("profanity_mask", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\b(i)dio(t)\b', '\1***\2', 'g'), '(?i)\b(s)cu(m)\b', '\1**\2', 'g')) AS masked FROM documents""")
def profanity_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.masked(F.col("text"), ["idiot", "scum"])).alias("masked"))


@query("hms_format", """
SELECT o_orderkey, format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS hms, format('{:d}:{:02d}:{:02d}.{:02d}', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS ass
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)""")
def hms_format(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", t.hms(price).alias("hms"), t.subtitle_time(price).alias("ass"))


@query("canonical_digest", """
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || CASE WHEN p_size % 4 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}') AS digest FROM part""")
def canonical_digest(spark, d):
    fields = {"size": F.when(F.col("p_size") % 4 != 0, F.col("p_size")), "key": F.col("p_partkey"), "brand": F.col("p_brand")}
    return table(spark, d, "part").select("p_partkey", F.sha2(t.canonical_json(fields), 256).alias("digest"))


@query("tag_cleanup", """
WITH c AS (SELECT p_partkey, list_transform(regexp_split_to_array(p_type || ' #' || p_name || ',' || p_type, '[ ,#]+'), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS x FROM part
), k AS (SELECT p_partkey, list_filter(x, lambda y: y <> '' AND y NOT IN ('standard', 'promo')) AS x FROM c)
SELECT p_partkey, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i)[1:3], ',') AS tags FROM k""")
def tag_cleanup(spark, d):
    raw = F.concat("p_type", F.lit(" #"), "p_name", F.lit(","), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(t.first_tags(raw, ["standard", "promo"]), ",").alias("tags"))


@query("cut_at_word", """
SELECT doc_id, CASE WHEN length(line) <= 40 THEN line WHEN length(regexp_extract(line[1:41], '^(.*)[ ]', 1)) > 0 THEN regexp_extract(line[1:41], '^(.*)[ ]', 1) ELSE line[1:40] END AS head
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS line FROM documents)""".replace("\n\r", "\\n\\r").replace("\t", "\\t").replace("\f", "\\f").replace("\x0B", "\\x0B"))
def cut_at_word(spark, d):
    return table(spark, d, "documents").select("doc_id", t.cut_at_word(t.squeezed(F.col("text")), 40).alias("head"))


@query("turn_session_text", """
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asks, sum(CASE WHEN regexp_matches(text, '[.?!]$') THEN 1 ELSE 0 END)::BIGINT AS closed, max(length(text)) AS longest FROM conversations GROUP BY conv_id""")
def turn_session_text(spark, d):
    closed = F.sum(F.col("text").rlike("[.?!]$").cast("int"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asks"), closed.alias("closed"), F.max(F.length("text")).cast("long").alias("longest"))


@query("log_numbers", r"""
SELECT user_id, round(sum(list_sum(list_transform(regexp_extract_all('k=' || coalesce(regexp_extract(props, '([0-9]+)', 1), '0') || ' k: 2.5', 'k[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), lambda x: CAST(x AS DOUBLE)))), 3) AS total FROM events GROUP BY user_id""")
def log_numbers(spark, d):
    log = F.concat(F.lit("k="), F.coalesce(F.regexp_extract("props", "([0-9]+)", 1), F.lit("0")), F.lit(" k: 2.5"))
    total = F.aggregate(t.found_numbers(log, "k"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(total), 3).alias("total"))
