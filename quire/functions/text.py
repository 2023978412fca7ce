"""Column helpers with the text semantics that every operator shares: Unicode white space, words, case and counts."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stopwords. Words with an apostrophe never equal a `\w+` token but belong to the list.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
    "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into "
    "is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very "
    "was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's "
    "with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()
# Words that stay small in a title.
MINOR_WORDS = "a an and as at but by for in nor of on or the to via".split()

WORD = r"[\p{L}\p{N}_]+"
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def count_tokens(x: Column | str) -> Column:
    """Number of white-space separated tokens of a stripped text."""
    return F.when(_c(x) == "", F.lit(0)).otherwise(F.size(F.split(_c(x), r"(?U)\s+")))


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(WORD), F.lit(0))


def count(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(x), F.lit(pattern))


def is_upper(x: Column | str) -> Column:
    """Has a cased letter and none that is lower or title case."""
    return _c(x).rlike(r"\p{Lu}") & ~_c(x).rlike(r"[\p{Ll}\p{Lt}]")


def is_title(x: Column | str) -> Column:
    """Upper-case letters follow uncased characters alone, lower-case ones cased characters alone."""
    c = _c(x)
    return c.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]") & ~c.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]") & ~c.rlike(r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def literal_set(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def nfkc(x: Column | str) -> Column:
    """Unicode NFKC; Spark has no function for it. Texts of ASCII alone skip the Arrow call's work."""
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in col.to_pylist()], pa.string())

    return run(_c(x))
