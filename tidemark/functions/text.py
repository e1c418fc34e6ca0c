"""Text expressions: names, tokens, hooks, times, URLs, digests, scans of log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that weaken or strengthen an opening.
WEAK_OPENERS = ("and", "so", "but", "because", "which", "or", "um", "uh", "that", "then", "also")
HOOK_WORDS = (
    "you", "your", "never", "always", "why", "how", "what", "secret", "mistake", "first", "biggest", "only", "surprising", "incredible", "amazing", "most", "best", "worst",
    "imagine", "actually", "really", "universe", "discover", "discovered",
)


def slug(x: Column) -> Column:
    """Lower-case letters and digits, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def squeezed(x: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9']+)"), 1)


def normal_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^a-z0-9']", "")


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))


def cut_at_word(x: Column, most: int) -> Column:
    """At most ``most`` characters, cut after a whole word where there is one."""
    head = F.substring(x, 1, most)
    whole = F.regexp_extract(F.substring(x, 1, most + 1), r"^(.*)[ ]", 1)
    return F.when(F.length(x) <= most, x).when(F.length(whole) > 0, whole).otherwise(head)


def masked(x: Column, words: list[str]) -> Column:
    """The inner letters of the words become asterisks, whatever their case; words end where no letter, digit or _ of ASCII follows."""
    for w in words:
        x = F.regexp_replace(x, rf"(?i)(?<![A-Za-z0-9_])({w[0]}){w[1:-1]}({w[-1]})(?![A-Za-z0-9_])", f"$1{'*' * (len(w) - 2)}$2")
    return x


def first_tags(x: Column, blocked: list[str], most: int = 3) -> Column:
    """Distinct tags of letters only, without the blocked ones, the first ``most``."""
    cleaned = F.transform(F.split(x, r"[ ,#]+"), lambda t: F.regexp_replace(F.lower(t), r"[^a-z]", ""))
    kept = F.filter(F.array_distinct(cleaned), lambda t: (F.length(t) > 0) & ~t.isin(*blocked))
    return F.slice(kept, 1, most)


def hms(seconds: Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def subtitle_time(seconds: Column) -> Column:
    """h:mm:ss.cc, rounded to hundredths before it is split up."""
    c = F.round(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c % 360000 / 6000), F.floor(c % 6000 / 100), c % 100)


def known(x: Column) -> Column:
    """The trimmed text, null where it is blank or "unknown"."""
    t = F.trim(x)
    return F.when((t != "") & (F.lower(t) != "unknown"), t)


def at_time(url: Column, seconds: Column) -> Column:
    """The URL with its ``t`` parameter replaced by so many seconds."""
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])t=[^&]*(&|$)", "$1"), r"[?&]$", "")
    return F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&t=")).otherwise(F.lit("?t=")), seconds.cast("string"), F.lit("s"))


def strict_https(url: Column, host: str) -> Column:
    """Whether the URL is https, without user, on port 443 or none, at ``host`` or below it."""
    authority = F.regexp_extract(url, r"^https://([^/?#]+)", 1)
    name = F.regexp_replace(authority, r":443$", "")
    at_host = (name == host) | F.endswith(name, F.lit("." + host))
    return (authority != "") & ~F.contains(authority, F.lit("@")) & ~F.contains(name, F.lit(":")) & at_host


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys: strings quoted by to_json's rules, other values as they are written, null as null."""
    parts = []
    for k in sorted(fields):
        value = F.regexp_extract(F.to_json(F.struct(fields[k].alias("v"))), r'^\{"v":(.*)\}$', 1)
        parts += [F.lit(f'{"," if parts else ""}"{k}":'), F.when(fields[k].isNull(), F.lit("null")).otherwise(value)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def found_numbers(log: Column, name: str) -> Column:
    """All numbers that follow ``name:`` or ``name=`` in log text."""
    return F.transform(F.regexp_extract_all(log, F.lit(rf"{name}[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))


def glob_pattern(glob: str) -> str:
    """A regular expression that says what a glob of * and ? says, whatever the case."""
    special = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(special.get(c, "\\" + c if not c.isalnum() else c) for c in glob) + "$"


def first_rule(x: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The value of the first glob rule that matches."""
    out = F.lit(other)
    for glob, value in reversed(rules):
        out = F.when(x.rlike(glob_pattern(glob)), value).otherwise(out)
    return out


def opening_score(text: Column, words: Column, seconds: Column) -> tuple[Column, Column]:
    """Heuristic score of a clip by its first sentence, word count and length, and the reasons in order."""
    toks = tokens(text)
    first, hits = F.get(toks, F.lit(0)), F.size(F.array_intersect(toks, F.array(*map(F.lit, HOOK_WORDS))))
    weak, question, number = F.coalesce(first.isin(*WEAK_OPENERS), F.lit(False)), F.contains(text, F.lit("?")), F.exists(toks, lambda t: t.rlike("^[0-9]+$"))
    short = F.size(toks).between(3, 14)
    plus = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    score = F.least(words / F.greatest(seconds, F.lit(0.1)), F.lit(4.0)) + plus(weak, -1.5) + plus(question, 1.0) + plus(number, 0.7) + F.least(hits, F.lit(3)) * 0.4 + plus(short, 0.6)
    why = [(weak, "weak opener"), (question, "question hook"), (number, "number in hook"), (hits > 0, "hook words"), (short, "short first line")]
    return score, F.array_compact(F.array(*(F.when(w, F.lit(r)) for w, r in why)))
