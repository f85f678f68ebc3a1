"""Text rules as column expressions: secrets, personal data, entropy, markers, first-match ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that stand for a rule. All are free of look-around, so other engines read them too.
SECRET_PATTERNS = {
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access-key": r"AKIA[0-9A-Z]{16}",
    "assigned-token": r"(token|secret|password|passwd|pwd|api_?key) *[=:] *[\"'][^\"']{8,}[\"']",
    "connection-string": r"(Password|Pwd)=[^;\"' ]{4,}",
}
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "card": r"[0-9]{16}",
}
MARKERS = r"\b(TODO|FIXME|HACK|XXX|TEMPORARY|KLUDGE)\b"
#: The first that matches names the reason.
FLAKY = (
    ("sleep", r"Thread\.Sleep|time\.sleep|\bsleep\b"),
    ("delay", r"Task\.Delay|\bdelay\b"),
    ("local clock", r"DateTime\.Now|\bnow\b"),
    ("random", r"new Random\(\)|\brandom\b"),
    ("environment", r"Environment\.|\benv\b"),
    ("file system", r"File\.|\bfile\b"),
    ("network", r"HttpClient|\bhttp"),
)
LICENCE = r"(MIT|Apache|GNU|BSD|CC BY|CC0)[A-Za-z0-9 .,-]*"


def first_match(text: Column, rules=FLAKY) -> Column:
    """The name of the first rule that matches, else null."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """An array of (kind, n) of the patterns that match."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count(text, F.lit(p)).cast("bigint").alias("n")) for k, p in patterns.items()))
    return F.filter(found, lambda x: x["n"] > 0)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    distinct = F.array_distinct(chars)
    # count(c) over all characters, without a loop over pairs of texts
    p = F.transform(distinct, lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log2(x)))


def line_of(text: Column, needle: Column) -> Column:
    """The line, from 1, of a needle's first place; 0 where there is none."""
    before = F.substring_index(text, needle, 1)
    return F.when(F.contains(text, needle), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(0)


def camel_words(name: Column) -> Column:
    return F.split(name, "(?<=[a-z0-9])(?=[A-Z])")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)
