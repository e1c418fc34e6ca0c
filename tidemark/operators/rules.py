"""Rules over features of a row or a key: event scores, labels, gates, window scores, choices of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip01
from tidemark.sources.tables import spread

Get = Callable[..., Column]

#: Labels that need a known line, and those that need a ball track.
LINE_LABELS, FUMBLE_LABELS = ("tackle_for_loss", "sack", "run_stop_near_los"), ("forced_fumble", "fumble_recovery")
#: The score from which a label commits; what is possible at all.
THRESHOLDS, THRESHOLD, POSSIBLE = {"sack": 0.80, "tackle_for_loss": 0.80, "forced_fumble": 0.85, "fumble_recovery": 0.85}, 0.70, 0.30


def features(have: list[str]) -> Get:
    """Features by name: a column where there is one, its nulls and what is missing as the default."""

    def get(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    return get


def scored(df: DataFrame, have: list[str], prefix: str) -> DataFrame:
    """Adds the scores of ``event_scores`` as columns with ``prefix``, a few in a projection: code for all at once is one method too
    long for the JVM to compile, which then interprets it for each row."""
    names = list(event_scores(features([])))
    df = df.withColumns({f"_{c}": v for c, v in event_terms(features(have)).items()})
    for at in range(0, len(names), 4):
        scores = event_scores(features(have), lambda c: F.col(f"_{c}"))
        df = df.withColumns({prefix + k: scores[k] for k in names[at : at + 4]})
    return df.drop(*(f"_{c}" for c in event_terms(features([]))))


def event_terms(x: Get) -> dict[str, Column]:
    """What several scores of ``event_scores`` are made of."""
    known, contact, special = x("los_known"), x("has_contact"), x("special_teams_signature")
    way = clip01(x("path_length_h") / 5.0)
    gain, calm = x("contact_gain_h"), 1 - contact
    down = F.greatest(x("target_down"), 0.8 * x("target_decel"), 0.8 * x("pose_fall"))
    tackle = contact * (0.5 + 0.5 * down)
    usual, rarely = 1 - 0.5 * special, 1 - 0.7 * special
    by_line = lambda share, unknown=0.0: F.when(known != 0, clip01(share)).otherwise(unknown)
    behind, near = by_line((-gain - 0.1) / 0.6), by_line(1 - (F.abs(gain) - 0.5) / 1.5)
    beyond = by_line((gain - 1.5) / 2.0, 0.5)
    trust = 0.8 + 0.2 * F.when(known != 0, x("los_confidence")).otherwise(0.0)
    cover = special * calm * way * 0.6
    return {"tackle": tackle, "usual": usual, "rarely": rarely, "behind": behind, "near": near, "beyond": beyond, "trust": trust, "cover": cover, "down": down, "way": way, "calm": calm}


def event_scores(x: Get, term: Callable[[str], Column] | None = None) -> dict[str, Column]:
    """The confidence of each label, 0 to 1, from the features of a play; ``term`` gives the columns of ``event_terms`` where there are such."""
    known, contact, special = x("los_known"), x("has_contact"), x("special_teams_signature")
    helpers, passer = x("defenders_at_contact"), x("target_is_qb")
    tackle, usual, rarely, behind, near, beyond, trust, cover, down, way, calm = map(term or event_terms(x).get, "tackle usual rarely behind near beyond trust cover down way calm".split())
    chase = way * clip01(0.4 + x("closing_speed_h") / 2.0) * clip01(0.5 + 0.5 * F.greatest(F.lit(0.0), x("pursuit_angle_cos")))
    alone = F.when(helpers == 0, 1.0).when(helpers == 1, 0.35).otherwise(0.1)
    scores = {
        "tackle": tackle,
        "solo_tackle": tackle * alone * (0.7 + 0.3 * x("first_to_contact")) * usual,
        "assisted_tackle": tackle * F.when(helpers >= 1, F.least(F.lit(1.0), 0.55 + 0.2 * helpers)).otherwise(0.1) * usual,
        "open_field_tackle": tackle * x("open_field") * (0.3 + 0.7 * beyond) * usual,
        "tackle_for_loss": tackle * behind * (1 - passer) * trust * rarely,
        "sack": tackle * passer * F.greatest(behind, F.when(known != 0, 0.6).otherwise(0.0)) * trust,
        "run_stop_near_los": tackle * near * (1 - behind) * (1 - passer) * trust * rarely,
        "qb_pressure": passer * x("qb_pressure") * (1 - 0.5 * contact * down) * clip01(1.6 - x("min_distance_h", 99.0) / 1.5),
        "forced_fumble": contact * x("target_separation_event"),
        "fumble_recovery": x("ball_recovered_by_52"),
        "block_shed": x("block_shed") * (0.6 + 0.4 * contact),
        "pursuit": chase * (1 - 0.6 * contact),
        "coverage_play": x("coverage_drop") * calm * 0.7,
        "other_defense": 0.2 * (1 - special),
        "special_teams_tackle": special * tackle,
        "kickoff_coverage": cover,
        "punt_coverage": cover,
        "return_block": special * x("opponents_at_contact") * calm * 0.3,
        "other_special_teams": 0.3 * special,
        "other": F.lit(0.1),
        "unclear": F.lit(0.15),
    }
    return {label: clip01(score) for label, score in scores.items()}


def primary_actor(x: Get) -> Column:
    """How far the player made the play: share of a contact, else nearness and share of the closing."""
    share = x("closing_share")
    met = clip01(0.4 * x("first_to_contact") + 0.3 / (1 + x("defenders_at_contact")) + 0.3 * share)
    return F.when(x("has_contact") != 0, met).otherwise(0.8 * clip01(0.5 * clip01(1.5 - x("min_distance_h", 9.0) / 3.0) + 0.5 * share))


def gated(label: str, x: Get, line_ok: Column) -> Column:
    """Whether the evidence a label needs is there at all."""
    if label in LINE_LABELS:
        return line_ok
    if label in FUMBLE_LABELS:
        return (x("has_contact") != 0) & (x("ball_track") != 0) & (x("target_separation_event") >= 0.5)
    return F.lit(True)


def committed_label(scores: dict[str, Column], order: list[str], x: Get, line_ok: Column) -> Column:
    """Of the labels that pass threshold and gate the first in ``order``, else "unclear"."""
    return F.coalesce(*(F.when((scores[k] >= THRESHOLDS.get(k, THRESHOLD)) & gated(k, x, line_ok), k) for k in order), F.lit("unclear"))


def possible_labels(scores: dict[str, Column], committed: Column) -> Column:
    """Other labels that are possible, best first (ties by name); fumbles only as "possible_" ones."""
    named = F.array(*(F.struct((-v).alias("v"), F.lit(k).alias("k"), F.lit(("possible_" if k in FUMBLE_LABELS else "") + k).alias("shown")) for k, v in scores.items()))
    return F.transform(F.array_sort(F.filter(named, lambda p: (p["v"] <= -POSSIBLE) & (p["k"] != committed))), lambda p: p["shown"])


def log_ratio_confidence(ratio: Column, jump: float) -> Column:
    """0.5 at the threshold ``jump``, 1 at four times as much, by logarithm; 0 of nothing."""
    return F.when(ratio > 0, clip01(0.5 + 0.5 * F.log(ratio / jump) / F.log(F.lit(4.0)))).otherwise(0.0)


def central_share(low: Column, high: Column, x: Column, safe: float) -> Column:
    """The share of a key's points in the middle ``safe`` part of their ranges; null without a point in a range."""
    rim = (1 - safe) / 2 * (high - low)
    return F.avg(F.when(high > low, x.between(low + rim, high - rim).cast("double")))


def position_prior(depth: Column, side: Column) -> Column:
    """How likely a place is for the position: a Gaussian of the depth behind the line and of the distance from its middle."""
    return F.exp(-0.5 * F.pow((depth - 6.0) / 2.5, 2) - 0.5 * F.pow(side / 5.0, 2))


def line_or_null(players: Column, confidence: Column, line: Column, least: int = 6, sure: float = 0.30) -> tuple[Column, Column]:
    """The line where enough players stand and it is sure enough, and notes on why not."""
    few, unsure = players < least, (players >= least) & (confidence < sure)
    return F.when(~few & ~unsure, line), F.array_compact(F.array(F.when(few, "too_few_players"), F.when(unsure, "los_uncertain")))


def best_evidence(df: DataFrame, keys: list[str], own: Column, score: str, order: str) -> DataFrame:
    """One row of each key: the best of its ``own`` rows, if it has any, else the best of all; partial before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct((~F.coalesce(own, F.lit(False))).alias("_o"), (-F.col(score)).alias("_s"), F.col(order).alias("_i"), F.struct(*rest).alias("_r")))
    return df.groupBy(*keys).agg(first.alias("_b")).select(*keys, "_b._r.*")


def valid_score(value: Column, most: float) -> Column:
    """A score as given as text of JSON: a finite number from 0 to ``most`` with two digits, else null; true and "1" are no numbers."""
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), value.cast("double"))
    return F.when(number.between(0, most), F.round(number, 2))


def refilled(df: DataFrame, keys: list[str], order: list[Column], n: int, bad: Column, rounds: int = 3) -> DataFrame:
    """The ``n`` first rows of each key after ``rounds`` of gating: what is chosen and bad goes, and others move up.

    A round takes at most ``n`` rows of a key, so only its first ``n * (rounds + 1)`` can matter. What isn't gone keeps its order, so its
    rank is a running count: all rounds go over one sort of rows dealt out once. The last choice isn't gated again. What may be bad
    (null) is never chosen either.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    rows = spread(df.withColumns({"_bad": F.coalesce(bad, F.lit(True)), "_gone": F.lit(False)}), keys)
    rows = rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n * (rounds + 1))
    w = W.partitionBy(*keys).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(rounds):
        rows = rows.withColumn("_rank", F.count_if(~F.col("_gone")).over(w)).withColumn("_gone", F.col("_gone") | (F.col("_bad") & (F.col("_rank") <= n)))
    rows = rows.withColumn("rank", F.count_if(~F.col("_gone")).over(w).cast("int"))
    return rows.filter((F.col("rank") <= n) & ~F.col("_gone")).drop("_bad", "_gone", "_rank", "_place")


def windows(df: DataFrame, key: str, start: str, end: str, order: str, shortest, longest, gap) -> DataFrame:
    """Pairs (key, first, last, start, end) of a key's sentences that bound a window of ``shortest`` to ``longest``.

    No two neighbours within may be over ``gap`` apart, which numbers islands; pairs meet by key, island and a grid of
    ``longest``, so a sentence meets no others than those within reach.
    """
    w = W.partitionBy(key).orderBy(start, order)
    rows = df.withColumn("_new", (F.col(start) - F.lag(end).over(w) > gap).cast("int"))
    rows = rows.withColumns({"_island": F.sum(F.coalesce("_new", F.lit(0))).over(w), "_n": F.row_number().over(w), "_cell": F.floor(F.col(start) / longest)})
    one = rows.select(key, "_island", F.col(order).alias("first"), F.col(start).alias("start"), F.col("_n").alias("_a"), F.explode(F.array("_cell", F.col("_cell") + 1)).alias("_cell"))
    other = rows.select(key, "_island", "_cell", F.col(order).alias("last"), F.col(end).alias("end"), F.col("_n").alias("_z"))
    pairs = one.join(other, [key, "_island", "_cell"]).filter(F.col("_z") >= F.col("_a"))
    return pairs.filter((F.col("end") - F.col("start")).between(shortest, longest)).select(key, "first", "last", "start", "end")


#: Words that begin badly, refer back, are strong, or no words at all; lines of moderators; references back.
FILLERS = "so and but um uh yeah well okay ok like because or right anyway also then".split()
BACKREFS = "that it this he she they those these which there".split()
STRONG = (
    "never first only most best worst scared afraid died dead crazy secret wrong actually nobody everyone every mistake fail failed failure risk dangerous fire explode exploded impossible"
    " surprised amazing incredible love hate fear honestly truth real biggest hardest favorite weird funny problem why how what mom kids home"
).split()
DISFLUENT = "um uh uhm erm hmm mm".split()
NUMBERS = "one two three hundred thousand million".split()
MODERATOR = ["next question", "great question", "question is for", "our next", "thank you so much", "welcome to the", "thanks for joining", "we're down to", "last question", "thank you both"]
BACK = ["as i said", "like i said", "as i mentioned", "we talked about", "earlier", "that question"]


def window_score(text: Column, first: Column, words: Column, opening: Column, middle_question: Column, last: Column, closed: Column, n_words: Column, seconds: Column, pauses: Column, unsure: Column) -> tuple[Column, Column]:
    """The score of a window of speech, and notes on it.

    ``first`` and ``last`` are sentences, ``words`` the first one's normal words, ``opening`` those of the first three seconds;
    ``pauses`` is the sum of pauses beyond a second, ``unsure`` the share of words recognised badly.
    """
    head, low = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lower(text)
    among = lambda have, of: F.size(F.array_intersect(have, F.array(*map(F.lit, of))))
    asks = lambda x: F.rtrim(x).endswith("?")
    size, pace, long = F.size(words), n_words / F.greatest(seconds, F.lit(1.0)), F.greatest(seconds, F.lit(1.0))
    drops = F.size(F.filter(words, lambda w: w.isin(DISFLUENT)))
    counted = (among(opening, NUMBERS) > 0) | F.exists(opening, lambda w: w.rlike("[0-9]"))
    rules: list[tuple[Column, Column | float, Column | str | None]] = [
        (head.isin(FILLERS), -3.0, "filler start"),
        (head.isin(BACKREFS), -2.0, "back-reference start"),
        (size < 4, -1.0, None),
        (size > 36, -0.7, "long first sentence"),
        (asks(first), -1.0, "starts on the interviewer's question"),
        (among(opening, ["you", "your"]) > 0, 0.8, None),
        (counted, 0.7, None),
        (F.lit(True), 0.8 * F.least(F.lit(3), among(words, STRONG)), None),
        (~closed, -2.0, "open ending"),
        (asks(last), -2.0, "ends on a question"),
        (middle_question, -2.5, "new question mid-clip"),
        *((F.contains(low, F.lit(x)), -3.0, f"moderator line: {x}") for x in MODERATOR),
        (drops > 0, -1.0 * F.least(F.lit(2), drops), "disfluent hook"),
        *((F.contains(low, F.lit(x)), -1.5, f"refers back: {x}") for x in BACK),
        (pace < 1.8, -2.0, F.format_string("slow %.1f w/s", pace)),
        (pace.between(2.3, 3.8), 0.8, None),
        (pauses / long > 0.12, -1.5, "long pauses"),
        (unsure > 0.12, -2.0, "low ASR confidence"),
        (seconds.between(25, 40), 0.5, None),
    ]
    score = sum((F.when(when, by if isinstance(by, Column) else F.lit(by)).otherwise(0.0) for when, by, _ in rules), F.lit(0.0))
    return score, F.array_compact(F.array(*(F.when(when, note) for when, _, note in rules if note is not None)))


def blended(score: Column, hook: Column, alone: Column, interest: Column, reason: Column) -> tuple[Column, Column]:
    """The final score, and whether the row is rejected: by the rating where there is one (``hook`` not null), else by the score alone."""
    rated = hook.isNotNull()
    final = F.when(rated, 0.25 * score + 0.45 * hook + 0.35 * alone + 0.2 * interest).otherwise(score)
    return final, F.when(rated, (hook < 7) | (alone < 7) | (F.trim(F.coalesce(reason, F.lit(""))) != "")).otherwise(score < 1.0)


def deep_merged(base: dict, over: dict) -> dict:
    """Nested settings with those of ``over`` laid on top; lists and values are replaced whole."""
    both = {k: deep_merged(base[k], over[k]) for k in base.keys() & over.keys() if isinstance(base[k], dict) and isinstance(over[k], dict)}
    return {**base, **over, **both}
