"""Edit timelines of moments as rows of segments, in column expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the ident, of the end card and its least, of an angle at most, and what stays free beside an angle.
IDENT, CARD, LEAST_CARD, ANGLE, SPARE = 0.8, 2.5, 1.5, 8.0, 0.5


def edit_timelines(
    df: DataFrame, snap: Column, impact: Column, length: Column, angles: list[tuple[Column, Column]] = (), shortest: float = 15.0, longest: float = 60.0, rate: float = 30.0, slow: float = 0.55
) -> DataFrame:
    """The rows of ``df``, one for each segment of its edit: kind, source (time), speed, start and end (of the output, whole frames).

    Ident, live play and slow replay always; other angles (start, end; null where there is none) while half a second is
    lacking, a second replay while one and a half are; the end card takes up the rest. ``snap`` may be null or too late.
    """
    lit = F.lit
    lead = F.when(snap < impact, F.least(snap - 1.0, impact - 2.5)).otherwise(impact - 3.0)
    a = F.greatest(lit(0.0), impact - 8.0, lead)
    z = F.greatest(F.least(length - 1 / rate, impact + 1.5), F.least(length, impact + 0.5))
    again, slower = F.greatest(a, impact - 2.5), max(0.3, 0.75 * slow)
    twice = F.greatest(a, impact - 1.5)
    rows = df.withColumns({"_a": a, "_z": z, "_s0": lit(IDENT), "_s1": z - a, "_s2": (F.least(z, impact + 1.0) - again) / slow})
    rows = rows.withColumn("_spent", F.col("_s0") + F.col("_s1") + F.col("_s2"))
    lacking = lit(shortest - CARD) - F.col("_spent")
    plan = [("ident", F.col("_a"), 0.0), ("live", F.col("_a"), 1.0), ("replay", again, slow)]
    for start, end in angles:
        use = F.least(end - start, lit(ANGLE), lit(longest - CARD - SPARE) - F.col("_spent"))
        name = f"_s{len(plan)}"
        rows = rows.withColumn(name, F.when((lacking > SPARE) & (end > start) & (use >= 1), use))
        rows = rows.withColumn("_spent", F.col("_spent") + F.coalesce(name, lit(0.0)))
        plan.append(("angle", start + (end - start - F.col(name)) / 2, 1.0))
    name = f"_s{len(plan)}"
    rows = rows.withColumn(name, F.when(lacking > 1.5, (F.least(F.col("_z"), impact + 0.7) - twice) / slower))
    rows = rows.withColumn("_spent", F.col("_spent") + F.coalesce(name, lit(0.0)))
    plan.append(("replay2", twice, slower))
    rows = rows.withColumn(f"_s{len(plan)}", F.greatest(lit(LEAST_CARD), F.least(CARD + F.greatest(lit(0.0), lacking), lit(longest) - F.col("_spent"))))
    plan.append(("endcard", F.col("_z"), 0.0))
    frames = [F.coalesce(F.greatest(lit(1), F.round(F.col(f"_s{k}") * rate).cast("int")) * F.col(f"_s{k}").isNotNull().cast("int"), lit(0)) for k in range(len(plan))]
    segments = []
    for k, (kind, source, speed) in enumerate(plan):
        before = reduce(lambda x, y: x + y, frames[:k], lit(0))
        segments.append(F.struct(lit(kind).alias("kind"), source.alias("source"), lit(speed).alias("speed"), (before / rate).alias("start"), ((before + frames[k]) / rate).alias("end")))
    rows = rows.withColumn("_segment", F.explode(F.filter(F.array(*segments), lambda x: x["end"] > x["start"])))
    return rows.select(*(df[c] for c in df.columns), "_segment.*")
