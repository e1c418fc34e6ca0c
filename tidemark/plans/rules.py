"""Queries of the rules over features, each with SQL written apart from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import rules as r
from tidemark.plans import EVENTS, events
from tidemark.registry import query
from tidemark.sources.tables import table

HOUR = 3_600_000_000

#: Features of a play, as expressions that Spark and DuckDB read alike, over the lines of orders.
_FEATURES = {
    "has_contact": "CASE WHEN l_linenumber % 3 <> 0 THEN 1 ELSE 0 END", "target_down": "l_discount * 10", "target_decel": "l_tax * 10", "defenders_at_contact": "l_linenumber % 4",
    "target_is_qb": "CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END", "path_length_h": "l_quantity / 5", "contact_gain_h": "l_quantity / 10 - 3", "los_known": "CASE WHEN l_partkey % 3 <> 0 THEN 1 ELSE 0 END",
    "los_confidence": "l_tax * 12", "special_teams_signature": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "first_to_contact": "l_suppkey % 2", "open_field": "(l_partkey % 5) / 4.0",
    "closing_speed_h": "l_quantity / 25", "pursuit_angle_cos": "l_quantity / 25 - 1", "qb_pressure": "l_discount * 8", "min_distance_h": "l_quantity / 8", "target_separation_event": "l_discount * 10",
    "ball_recovered_by_52": "l_tax * 10", "block_shed": "l_discount * 5", "coverage_drop": "l_tax * 6", "opponents_at_contact": "l_linenumber", "ball_track": "l_linenumber % 2", "closing_share": "l_tax * 10",
}
_PLAYS = "p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, " + ", ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in _FEATURES.items()) + " FROM lineitem)"
_KEYS = ["l_orderkey", "l_linenumber", "l_extendedprice"]
#: The order in which labels commit.
PRIORITY = (
    "forced_fumble fumble_recovery sack tackle_for_loss special_teams_tackle open_field_tackle run_stop_near_los block_shed qb_pressure solo_tackle assisted_tackle kickoff_coverage punt_coverage"
    " return_block coverage_play pursuit other_defense other_special_teams tackle other unclear"
).split()

_SCORES = _PLAYS + """, i AS (
  SELECT *, has_contact * (0.5 + 0.5 * greatest(target_down, 0.8 * target_decel)) AS hit, 1 - 0.5 * special_teams_signature AS half, 1 - 0.7 * special_teams_signature AS third,
    CASE WHEN los_known = 1 THEN least(1, greatest(0, (-contact_gain_h - 0.1) / 0.6)) ELSE 0 END AS back, CASE WHEN los_known = 1 THEN least(1, greatest(0, 1 - (abs(contact_gain_h) - 0.5) / 1.5)) ELSE 0 END AS close_by,
    CASE WHEN los_known = 1 THEN least(1, greatest(0, (contact_gain_h - 1.5) / 2)) ELSE 0.5 END AS far_off, 0.8 + 0.2 * los_known * los_confidence AS sure, least(1, path_length_h / 5) AS ran FROM p
), s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, has_contact, ball_track, target_separation_event, los_known, los_confidence,
  least(1, hit) AS tackle, least(1, hit * CASE defenders_at_contact WHEN 0 THEN 1 WHEN 1 THEN 0.35 ELSE 0.1 END * (0.7 + 0.3 * first_to_contact) * half) AS solo_tackle,
  least(1, hit * CASE WHEN defenders_at_contact >= 1 THEN least(1, 0.55 + 0.2 * defenders_at_contact) ELSE 0.1 END * half) AS assisted_tackle,
  least(1, hit * open_field * (0.3 + 0.7 * far_off) * half) AS open_field_tackle, least(1, hit * back * (1 - target_is_qb) * sure * third) AS tackle_for_loss,
  least(1, hit * target_is_qb * greatest(back, 0.6 * los_known) * sure) AS sack, least(1, hit * close_by * (1 - back) * (1 - target_is_qb) * sure * third) AS run_stop_near_los,
  least(1, greatest(0, target_is_qb * qb_pressure * (1 - 0.5 * has_contact * greatest(target_down, 0.8 * target_decel)) * least(1, greatest(0, 1.6 - min_distance_h / 1.5)))) AS qb_pressure,
  least(1, has_contact * target_separation_event) AS forced_fumble, least(1, ball_recovered_by_52) AS fumble_recovery, least(1, block_shed * (0.6 + 0.4 * has_contact)) AS block_shed,
  ran * least(1, 0.4 + closing_speed_h / 2) * least(1, 0.5 + 0.5 * greatest(0, pursuit_angle_cos)) * (1 - 0.6 * has_contact) AS pursuit, least(1, coverage_drop * (1 - has_contact) * 0.7) AS coverage_play,
  0.2 * (1 - special_teams_signature) AS other_defense, least(1, special_teams_signature * hit) AS special_teams_tackle, special_teams_signature * (1 - has_contact) * ran * 0.6 AS kickoff_coverage,
  special_teams_signature * (1 - has_contact) * ran * 0.6 AS punt_coverage, least(1, special_teams_signature * opponents_at_contact * (1 - has_contact) * 0.3) AS return_block,
  0.3 * special_teams_signature AS other_special_teams, CAST(0.1 AS DOUBLE) AS other, CAST(0.15 AS DOUBLE) AS unclear FROM i)"""


def _plays(spark, d):
    return table(spark, d, "lineitem").select(*_KEYS, *(F.expr(f"cast({x} as double)").alias(name) for name, x in _FEATURES.items()))


@query("event_rule_scores", f"WITH {_SCORES} SELECT l_orderkey, l_linenumber, l_extendedprice, " + ", ".join(f"round({k}, 9) + 0 AS {k}" for k in PRIORITY) + " FROM s")
def event_rule_scores(spark, d):
    rows = r.scored(_plays(spark, d), list(_FEATURES), "s_")
    return rows.select(*_KEYS, *((rounded(F.col(f"s_{k}"), 9) + 0).alias(k) for k in r.event_scores(r.features([]))))


@query("committed_and_possible_labels", f"""
WITH {_SCORES}, c AS (SELECT *, los_known = 1 AND los_confidence >= 0.5 AS ok, has_contact = 1 AND ball_track = 1 AND target_separation_event >= 0.5 AS ball FROM s
), g AS (SELECT *, CASE WHEN forced_fumble >= 0.85 AND ball THEN 'forced_fumble' WHEN fumble_recovery >= 0.85 AND ball THEN 'fumble_recovery' WHEN sack >= 0.8 AND ok THEN 'sack'
  WHEN tackle_for_loss >= 0.8 AND ok THEN 'tackle_for_loss' WHEN special_teams_tackle >= 0.7 THEN 'special_teams_tackle' WHEN open_field_tackle >= 0.7 THEN 'open_field_tackle'
  WHEN run_stop_near_los >= 0.7 AND ok THEN 'run_stop_near_los' WHEN block_shed >= 0.7 THEN 'block_shed' WHEN qb_pressure >= 0.7 THEN 'qb_pressure' WHEN solo_tackle >= 0.7 THEN 'solo_tackle'
  WHEN assisted_tackle >= 0.7 THEN 'assisted_tackle' WHEN kickoff_coverage >= 0.7 THEN 'kickoff_coverage' WHEN punt_coverage >= 0.7 THEN 'punt_coverage' WHEN return_block >= 0.7 THEN 'return_block'
  WHEN coverage_play >= 0.7 THEN 'coverage_play' WHEN pursuit >= 0.7 THEN 'pursuit' WHEN tackle >= 0.7 THEN 'tackle' ELSE 'unclear' END AS label FROM c
), u AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_extendedprice, label, {", ".join(f"round({k}, 9) AS {k}" for k in PRIORITY)} FROM g) ON {", ".join(PRIORITY)} INTO NAME k VALUE v
), l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, string_agg(CASE WHEN k IN ('forced_fumble', 'fumble_recovery') THEN 'possible_' || k ELSE k END, ',' ORDER BY v DESC, k) AS possible
  FROM u WHERE v >= 0.3 AND k <> label GROUP BY l_orderkey, l_linenumber, l_extendedprice)
SELECT g.l_orderkey, g.l_linenumber, g.l_extendedprice, g.label, coalesce(l.possible, '') AS possible FROM g LEFT JOIN l USING (l_orderkey, l_linenumber, l_extendedprice)""")
def committed_and_possible_labels(spark, d):
    x = r.features(list(_FEATURES))
    rows = r.scored(_plays(spark, d), list(_FEATURES), "s_")
    scores = {k: F.col(f"s_{k}") for k in r.event_scores(r.features([]))}
    line_ok = (x("los_known") != 0) & (x("los_confidence") >= 0.5)
    rows = rows.withColumn("label", r.committed_label(scores, PRIORITY, x, line_ok))  # thresholds are of scores as they are, what is possible goes by nine digits
    possible = r.possible_labels({k: rounded(v, 9) for k, v in scores.items()}, F.col("label"))
    return rows.select(*_KEYS, "label", F.array_join(possible, ",").alias("possible"))


@query("primary_actor_score", f"""
WITH {_PLAYS} SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN has_contact = 1 THEN least(1, 0.4 * first_to_contact + 0.3 / (1 + defenders_at_contact) + 0.3 * closing_share)
  ELSE 0.8 * least(1, 0.5 * least(1, greatest(0, 1.5 - min_distance_h / 3)) + 0.5 * closing_share) END, 9) AS actor FROM p""")
def primary_actor_score(spark, d):
    return _plays(spark, d).select(*_KEYS, F.round(r.primary_actor(r.features(list(_FEATURES))), 9).alias("actor"))


@query("snap_log_confidence", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(least(1, greatest(0, 0.5 + 0.5 * ln(l_quantity / 25) / ln(4))), 9) AS confidence FROM lineitem")
def snap_log_confidence(spark, d):
    return table(spark, d, "lineitem").select(*_KEYS, F.round(r.log_ratio_confidence(F.col("l_quantity") / 10, 2.5), 9).alias("confidence"))


@query("safe_central_fraction", """
WITH b AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS lo, CAST(l_linenumber + l_partkey % 40 AS DOUBLE) AS hi, l_quantity AS x FROM lineitem)
SELECT l_orderkey, round(avg(CASE WHEN hi > lo THEN CASE WHEN x >= lo + 0.2 * (hi - lo) AND x <= hi - 0.2 * (hi - lo) THEN 1.0 ELSE 0.0 END END), 9) AS inside FROM b GROUP BY l_orderkey""")
def safe_central_fraction(spark, d):
    low, high = F.col("l_linenumber").cast("double"), (F.col("l_linenumber") + F.col("l_partkey") % 40).cast("double")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(r.central_share(low, high, F.col("l_quantity"), 0.6), 9).alias("inside"))


@query("position_prior", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(exp(-power((l_quantity / 4 - 6) / 2.5, 2) / 2) * exp(-power((l_partkey % 21 - 10) / 5.0, 2) / 2), 9) AS prior FROM lineitem")
def position_prior(spark, d):
    return table(spark, d, "lineitem").select(*_KEYS, F.round(r.position_prior(F.col("l_quantity") / 4, (F.col("l_partkey") % 21 - 10).cast("double")), 9).alias("prior"))


@query("line_accepted", """
WITH o AS (SELECT l_orderkey, count(*) AS n, round(avg(l_tax) * 8, 9) AS sure, max(l_quantity) AS line FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n >= 3 AND sure >= 0.3 THEN line END AS line, CASE WHEN n < 3 THEN 'too_few_players' WHEN sure < 0.3 THEN 'los_uncertain' ELSE '' END AS notes FROM o""")
def line_accepted(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax") * 8, 9).alias("sure"), F.max("l_quantity").alias("q"))
    line, notes = r.line_or_null(F.col("n"), F.col("sure"), F.col("q"), least=3)
    return rows.select("l_orderkey", line.alias("line"), F.array_join(notes, ",").alias("notes"))


@query("best_evidence_row", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 1 END, l_extendedprice DESC, l_linenumber) = 1""")
def best_evidence_row(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_partkey")
    return r.best_evidence(rows, ["l_orderkey"], F.col("l_partkey") % 4 == 0, "l_extendedprice", "l_linenumber").drop("l_partkey")


@query("validated_scores", """
WITH v AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS t FROM events)
SELECT event_id, CASE WHEN regexp_full_match(t, '-?[0-9]+(\\.[0-9]+)?') AND TRY_CAST(t AS DOUBLE) BETWEEN 0 AND 40 THEN round(TRY_CAST(t AS DOUBLE), 2) END AS score FROM v""")
def validated_scores(spark, d):
    return table(spark, d, "events").select("event_id", r.valid_score(F.get_json_object("props", "$.k"), 40).alias("score"))


@query("gate_and_refill", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag = 'R' AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem
), b AS (SELECT *, bad AND r <= 2 AS g1 FROM a
), c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g1, r) AS r1 FROM b
), e AS (SELECT *, g1 OR (bad AND r1 <= 2) AS g2 FROM c
), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g2, r) AS r2 FROM e
), h AS (SELECT *, g2 OR (bad AND r2 <= 2) AS g3 FROM f
), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g3, r) AS r3 FROM h)
SELECT l_orderkey, l_linenumber, l_extendedprice, r3 AS rank FROM k WHERE r3 <= 2 AND NOT g3""")
def gate_and_refill(spark, d):
    rows = table(spark, d, "lineitem").select(*_KEYS, "l_returnflag")
    return r.refilled(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 2, F.col("l_returnflag") == "R").select(*_KEYS, "rank")


@query("speech_windows", f"""
WITH {EVENTS}, n AS (SELECT k, id, s, e, row_number() OVER (PARTITION BY k ORDER BY s, id) AS i, s - lag(e) OVER (PARTITION BY k ORDER BY s, id) > 12 * {HOUR} AS far FROM ev
), g AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, id) AS island FROM n)
SELECT a.k, a.id AS "first", z.id AS "last", z.e - a.s AS long FROM g a JOIN g z ON a.k = z.k AND a.island = z.island AND z.i >= a.i WHERE z.e - a.s BETWEEN 21 * {HOUR} AND 44 * {HOUR}""")
def speech_windows(spark, d):
    found = r.windows(events(spark, d).select("k", "id", "s", "e"), "k", "s", "e", "id", 21 * HOUR, 44 * HOUR, 12 * HOUR)
    return found.select("k", "first", "last", (F.col("end") - F.col("start")).alias("long"))


@query("window_score", """
WITH t AS (SELECT doc_id, text, lower(text) AS low, split_part(text, chr(10), 1) AS head, n_chars / 15.0 AS sec, doc_id % 9 / 4.0 AS pause, doc_id % 10 / 60.0 AS unsure FROM documents
), w AS (SELECT *, regexp_extract_all(lower(head), '[a-z0-9'']+') AS fw, regexp_extract_all(low, '[a-z0-9'']+') AS every, rtrim(text) LIKE '%?' AS ends, text LIKE '%? %' AS mid, rtrim(text) LIKE '%.' AS closed FROM t
), v AS (SELECT *, every[1:8] AS open, len(every) / greatest(sec, 1.0) AS pace, len(list_filter(fw, lambda x: x IN ('um', 'uh', 'uhm', 'erm', 'hmm', 'mm'))) AS dis FROM w
), m AS (SELECT *, list_filter(['next question', 'great question', 'question is for', 'our next', 'thank you so much', 'welcome to the', 'thanks for joining', 'we''re down to', 'last question', 'thank you both'], lambda x: contains(low, x)) AS mods,
  list_filter(['as i said', 'like i said', 'as i mentioned', 'we talked about', 'earlier', 'that question'], lambda x: contains(low, x)) AS backs,
  coalesce(fw[1], '') IN ('so', 'and', 'but', 'um', 'uh', 'yeah', 'well', 'okay', 'ok', 'like', 'because', 'or', 'right', 'anyway', 'also', 'then') AS filler,
  coalesce(fw[1], '') IN ('that', 'it', 'this', 'he', 'she', 'they', 'those', 'these', 'which', 'there') AS backref FROM v)
SELECT doc_id, CAST(round(CASE WHEN filler THEN -3 ELSE 0 END + CASE WHEN backref THEN -2 ELSE 0 END + CASE WHEN len(fw) < 4 THEN -1 ELSE 0 END + CASE WHEN len(fw) > 36 THEN -0.7 ELSE 0 END
  + CASE WHEN rtrim(head) LIKE '%?' THEN -1 ELSE 0 END + CASE WHEN list_has_any(open, ['you', 'your']) THEN 0.8 ELSE 0 END
  + CASE WHEN list_has_any(open, ['one', 'two', 'three', 'hundred', 'thousand', 'million']) OR len(list_filter(open, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 0.7 ELSE 0 END
  + 0.8 * least(3, len(list_distinct(list_filter(fw, lambda x: x IN ('never', 'first', 'only', 'most', 'best', 'worst', 'scared', 'afraid', 'died', 'dead', 'crazy', 'secret', 'wrong', 'actually', 'nobody', 'everyone', 'every', 'mistake',
    'fail', 'failed', 'failure', 'risk', 'dangerous', 'fire', 'explode', 'exploded', 'impossible', 'surprised', 'amazing', 'incredible', 'love', 'hate', 'fear', 'honestly', 'truth', 'real', 'biggest', 'hardest', 'favorite', 'weird', 'funny',
    'problem', 'why', 'how', 'what', 'mom', 'kids', 'home')))))
  + CASE WHEN closed THEN 0 ELSE -2 END + CASE WHEN ends THEN -2 ELSE 0 END + CASE WHEN mid THEN -2.5 ELSE 0 END - 3 * len(mods) - least(2, dis) - 1.5 * len(backs)
  + CASE WHEN pace < 1.8 THEN -2 WHEN pace BETWEEN 2.3 AND 3.8 THEN 0.8 ELSE 0 END + CASE WHEN pause / greatest(sec, 1) > 0.12 THEN -1.5 ELSE 0 END + CASE WHEN unsure > 0.12 THEN -2 ELSE 0 END
  + CASE WHEN sec BETWEEN 25 AND 40 THEN 0.5 ELSE 0 END, 6) AS DOUBLE) AS score,
  concat_ws('|', CASE WHEN filler THEN 'filler start' END, CASE WHEN backref THEN 'back-reference start' END, CASE WHEN len(fw) > 36 THEN 'long first sentence' END, CASE WHEN rtrim(head) LIKE '%?' THEN 'starts on the interviewer''s question' END,
    CASE WHEN NOT closed THEN 'open ending' END, CASE WHEN ends THEN 'ends on a question' END, CASE WHEN mid THEN 'new question mid-clip' END, nullif(array_to_string(list_transform(mods, lambda x: 'moderator line: ' || x), '|'), ''),
    CASE WHEN dis > 0 THEN 'disfluent hook' END, nullif(array_to_string(list_transform(backs, lambda x: 'refers back: ' || x), '|'), ''), CASE WHEN pace < 1.8 THEN 'slow' END, CASE WHEN pause / greatest(sec, 1) > 0.12 THEN 'long pauses' END,
    CASE WHEN unsure > 0.12 THEN 'low ASR confidence' END) AS notes FROM m""")
def window_score(spark, d):
    docs, head = table(spark, d, "documents"), F.split_part("text", F.lit("\n"), F.lit(1))
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9']+)"), 1)
    docs = docs.select("doc_id", "text", (F.col("n_chars") / 15.0).alias("sec"), head.alias("head"), words(head).alias("fw"), words(F.col("text")).alias("every"))
    text = F.col("text")
    score, notes = r.window_score(
        text, F.col("head"), F.col("fw"), F.slice("every", 1, 8), F.contains(text, F.lit("? ")), text, F.rtrim(text).endswith("."), F.size("every"), F.col("sec"), F.col("doc_id") % 9 / 4.0, F.col("doc_id") % 10 / 60.0
    )
    plain = F.transform(notes, lambda x: F.regexp_replace(x, r"^slow .*", "slow"))  # digits of halves differ between engines
    return docs.select("doc_id", F.round(score, 6).alias("score"), F.array_join(plain, "|").alias("notes"))


@query("blended_and_rejected", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 3 > 0 THEN round(0.25 * l_tax * 100 + 0.45 * (l_partkey % 11) + 0.35 * (l_suppkey % 11) + 0.2 * (l_partkey % 7), 6) ELSE round(l_tax * 100, 6) END AS final,
  CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 11 < 7 OR l_suppkey % 11 < 7 OR l_returnflag = 'R' ELSE l_tax * 100 < 1 END AS rejected FROM lineitem""")
def blended_and_rejected(spark, d):
    rated = lambda x: F.when(F.col("l_linenumber") % 3 > 0, F.expr(x))
    final, rejected = r.blended(F.col("l_tax") * 100, rated("l_partkey % 11"), rated("l_suppkey % 11"), rated("l_partkey % 7"), F.when(F.col("l_returnflag") == "R", "off topic").otherwise(" "))
    return table(spark, d, "lineitem").select(*_KEYS, F.round(final, 6).alias("final"), rejected.alias("rejected"))


@query("labels_with_features", """
WITH j AS (SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)) SELECT * FROM j WHERE (SELECT count(DISTINCT doc_id) >= 2 AND count(DISTINCT quality) >= 2 FROM j)""")
def labels_with_features(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    most = rows.agg(F.min("doc_id") < F.max("doc_id"), F.min("quality") < F.max("quality")).first()
    return rows if all(most) else rows.limit(0)


@query("eligible_for_mix", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'approved' ELSE 'review' END AS status, o_orderstatus <> 'F' AS renders, o_orderstatus = 'O' AND o_totalprice / 400000 >= 0.8 AS mixes
FROM orders WHERE o_custkey % 10 <> 0 OR o_orderstatus = 'O'""")
def eligible_for_mix(spark, d):
    """Canonical rows only (no canonical id of another), renderable unless rejected, for a mix only approved ones sure of identity."""
    orders = table(spark, d, "orders").withColumn("canonical", F.when((F.col("o_custkey") % 10 == 0) & (F.col("o_orderstatus") != "O"), F.col("o_custkey")))
    status = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "approved").otherwise("review")
    rows = orders.filter("canonical is null").select("o_orderkey", status.alias("status"), "o_totalprice")
    return rows.select("o_orderkey", "status", (F.col("status") != "rejected").alias("renders"), ((F.col("status") == "approved") & (F.col("o_totalprice") / 400000 >= 0.8)).alias("mixes"))


@query("all_frames_lit", "SELECT l_orderkey, bool_and(l_quantity > 8 AND l_tax * 100 > 3) AS lit, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS dropped FROM lineitem GROUP BY l_orderkey")
def all_frames_lit(spark, d):
    """Whether all samples of a key are bright and varied, and how many were flagged."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.bool_and((F.col("l_quantity") > 8) & (F.col("l_tax") * 100 > 3)).alias("lit"), F.count_if(F.col("l_returnflag") == "R").alias("dropped"))


@query("near_side", """
WITH a AS (SELECT l_orderkey, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_tax END) AS lt, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END) AS rt FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN round(coalesce(lt, 0), 9) >= round(coalesce(rt, 0), 9) THEN 'l' ELSE 'r' END AS side FROM a""")
def near_side(spark, d):
    """The side whose points are surer on average."""
    sure = lambda odd: F.round(F.coalesce(F.avg(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_tax"))), F.lit(0.0)), 9)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(sure(1) >= sure(0), "l").otherwise("r").alias("side"))


@query("body_scale", """
WITH a AS (SELECT user_id, event_type, quantile_cont(value, 0.9) AS q FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type
), b AS (SELECT user_id, count(*) AS n, sum(q) AS total FROM a GROUP BY user_id) SELECT user_id, CASE WHEN n = 4 AND total > 0 THEN round(total / 0.89, 6) END AS scale FROM b""")
def body_scale(spark, d):
    """The 90th percentiles of all four segments, summed, are 0.89 of a body; null where a segment is never seen."""
    kinds = ["click", "purchase", "signup", "view"]
    segments = [F.percentile(F.when(F.col("event_type") == k, F.col("value")), 0.9) for k in kinds]
    total = reduce(lambda a, b: a + b, segments)
    rows = table(spark, d, "events").filter("event_type <> 'error'")
    return rows.groupBy("user_id").agg(F.when(total > 0, F.round(total / 0.89, 6)).alias("scale"))


@query("visible_moment", """
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice % 4) AS INTEGER) + 1 AS n FROM orders
), g AS (SELECT o_orderkey, n, unnest(range(0, n * 15 + 1)) AS i FROM o
), s AS (SELECT o_orderkey, i, CASE WHEN (o_orderkey + i) % 7 < 4 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * (1 - (o_orderkey * i) % 5 / 5.0::DOUBLE) + 0.15::DOUBLE * i / (n * 15) AS score FROM g)
SELECT o_orderkey, round(arg_max(i, {'s': round(score, 9), 'i': -i}) / 15.0, 6) AS t FROM s GROUP BY o_orderkey""")
def visible_moment(spark, d):
    """The best moment of a grid of 15 a second: observed, not covered, rather late (ties: the earliest)."""
    n = F.expr("cast(floor(o_totalprice % 4) as int) + 1")
    rows = table(spark, d, "orders").select("o_orderkey", n.alias("n"))

    def score(i):
        seen = F.when((F.col("o_orderkey") + i) % 7 < 4, 1.0).otherwise(0.6)
        return F.round(seen * (1 - (F.col("o_orderkey") * i) % 5 / 5.0) + 0.15 * i / (F.col("n") * 15), 9)

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n") * 15), lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))
    return rows.select("o_orderkey", F.round(-best["i"] / 15.0, 6).alias("t"))


@query("game_of_source", "SELECT s_suppkey, sha1(s_name)[1:10] AS key, TRY_CAST(s_name AS DATE) IS NULL AS undated, 1080 / (CASE WHEN s_suppkey % 3 = 0 THEN 1080.0 ELSE 360.0 END) AS scale FROM supplier WHERE s_nationkey IN (1, 3, 5)")
def game_of_source(spark, d):
    """Games of the ids asked for, with a short key, a date check and the scale of their proxies (1 where there is none)."""
    rows = table(spark, d, "supplier").filter(F.col("s_nationkey").isin(1, 3, 5))
    proxy = F.when(F.col("s_suppkey") % 3 != 0, 360.0)
    return rows.select("s_suppkey", F.left(F.sha1("s_name"), F.lit(10)).alias("key"), F.try_to_date("s_name").isNull().alias("undated"), F.coalesce(1080 / proxy, F.lit(1.0)).alias("scale"))


@query("game_hint", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS hint FROM customer GROUP BY c_nationkey")
def game_hint(spark, d):
    """The first hint of each game."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("hint"))
