"""Column expressions; all built-in, so they stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and texts that results must carry exactly.
NO_GENRE = "(no genres listed)"
EXPLAIN_TRENDING = "Currently trending in the community"
EXPLAIN_COLLABORATIVE = "Users with similar taste enjoyed this"
EXPLAIN_HYBRID = "Matches your taste and is popular in the community"
EXPLAIN_SIMILAR = "Similar movies you might enjoy"
ANONYMOUS_DOMAIN = "@anonymized.com"
USER_PREFIX = "user-"


def year_from_title(title: str) -> Column:
    """Year in the closing brackets of a title, null when the brackets hold anything else."""
    text = f"trim(replace(element_at(split({title}, '[(]'), -1), ')', ''))"
    return F.expr(f"CASE WHEN endswith({title}, ')') AND contains({title}, '(') THEN try_cast({text} AS int) END")


def split_values(column: str) -> Column:
    """Pipe-delimited text as a trimmed array without empties."""
    return F.filter(F.transform(F.split(F.col(column), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive literal containment (no wildcard meaning for % and _)."""
    return F.lower(F.col(column)).contains(text.lower())


def stars(vote: str) -> Column:
    """Half of the vote, rounded half up; 0 where there is none."""
    return F.coalesce(F.floor(F.col(vote) / 2 + 0.5), F.lit(0)).cast("int")


def user_key(column: str) -> Column:
    return F.regexp_replace(F.col(column), f"^{USER_PREFIX}", "")


def email_pseudonym(email: str) -> Column:
    return F.concat(F.sha2(F.col(email), 256), F.lit(ANONYMOUS_DOMAIN))


def age_band(age: str) -> Column:
    a = F.col(age)
    return F.when(a < 18, "under_18").when(a < 30, "18-29").when(a < 50, "30-49").when(a >= 50, "50+")


def mask_ip(ip: str) -> Column:
    return F.regexp_replace(F.col(ip), r"\.\d+$", ".0")


def day_part(ts: str) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def is_weekend(ts: str) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where the denominator is not positive."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def clamp_score(score: str) -> Column:
    return F.least(F.col(score), F.lit(1.0))


def confidence(score: str) -> Column:
    return F.least(F.col(score) * 1.2, F.lit(1.0))


def explanation(algorithm: str) -> Column:
    a = F.col(algorithm)
    return (
        F.when(a == "trending", EXPLAIN_TRENDING).when(a == "collaborative", EXPLAIN_COLLABORATIVE).otherwise(EXPLAIN_HYBRID)
    )


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: str) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: str) -> Column:
    """Vector of length 1; a zero vector stays as it is. The length is an array beside the vector, as inside a lambda it would be worked out per component."""
    length = norm(vector)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.zip_with(F.col(vector), F.array_repeat(safe, F.size(vector)), lambda x, n: x.cast("double") / n)


def bucket100(column: str) -> Column:
    """Stable bucket 0-99 of an id from its md5, the same in every engine."""
    return draw(F.col(column)) % 100


def draw(*parts: Column) -> Column:
    """Reproducible draw in [0, 2^32) from the md5 of the joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def card(prefix: Sequence[str] = ()) -> list[str]:
    """Columns of an item card."""
    return [*prefix, "title", "genres", "year", "poster_url", "vote_average"]


def round_to(value: str | Column, digits: int) -> Column:
    """Half-up rounding of a decimal quantity: binary noise beyond four more digits is cut first."""
    return F.round(F.round(value, digits + 4), digits)
