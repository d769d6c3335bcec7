"""Conditions and functions on text. Every one is an ordinary Column, so Catalyst sees through it."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DESCRIPTION = "description"


def _column(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _either(first, second) -> tuple[Column, object]:
    """One argument searches the description; with two, the first is the text."""
    return (_column(DESCRIPTION), first) if second is None else (_column(first), second)


def java_pattern(pattern: str) -> str:
    """The pattern as Spark takes it: ignoring case in all alphabets, named groups in Java's form."""
    re.compile(pattern)
    return "(?iU)" + pattern.replace("(?P<", "(?<")


def contains(first, second=None) -> Column:
    text, part = _either(first, second)
    return F.contains(F.upper(text), F.lit(part.upper()))


def anyof(*parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | contains(part)
    return found


def startswith(first, second=None) -> Column:
    text, part = _either(first, second)
    return F.startswith(F.upper(text), F.lit(part.upper()))


def matches(first, second=None) -> Column:
    """Regular expression found anywhere; a bad pattern fails here, not in the job."""
    text, pattern = _either(first, second)
    return text.rlike(java_pattern(pattern))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"[\s\-'.*]+", "")


def normalized(first, second=None) -> Column:
    """Contains, where neither side's blanks, dashes, apostrophes, dots and stars count."""
    text, part = _either(first, second)
    return F.contains(_plain(text), _plain(F.lit(part)))


def filled(value: Column) -> Column:
    """A captured field that is there and not blank."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def same(a: Column, b: Column | str) -> Column:
    """Equal text, ignoring case."""
    return F.lower(a) == F.lower(b if isinstance(b, Column) else F.lit(b))


def within(part: Column | str, text: Column) -> Column:
    """Substring, ignoring case."""
    return F.contains(F.upper(text), F.upper(part if isinstance(part, Column) else F.lit(part)))


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag.lower())


def extract(first, second=None) -> Column:
    """First group of the first match, '' if there is none."""
    text, pattern = _either(first, second)
    if not re.compile(pattern).groups:
        return F.lit("")
    return F.coalesce(F.regexp_extract(text, java_pattern(pattern), 1), F.lit(""))


def split_at(text: Column | str, delimiter: str, index: int) -> Column:
    """The index-th part, trimmed; '' out of range or for a negative index."""
    return F.lit("") if index < 0 else trimmed(F.split_part(_column(text), F.lit(delimiter), F.lit(index + 1)))


def slice_text(text: Column | str, start: int, end: int) -> Column:
    """Characters start to end; negative bounds count from the end."""
    text = _column(text)
    size = F.length(text)
    lo = F.least(F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0)), size)
    hi = F.least(F.lit(end) if end >= 0 else F.greatest(size + end, F.lit(0)), size)
    return F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))


def trimmed(text: Column | str) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(_column(text), r"^\s+|\s+$", "")


def replace_all(text: Column | str, pattern: str, by: str) -> Column:
    """All matches replaced, ignoring case; \\1 in `by` is the first group."""
    java = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
    return F.regexp_replace(_column(text), java_pattern(pattern), java)


def strip_prefix(text: Column | str, prefix: str) -> Column:
    """Ignoring case. The text is named once, so that a chain of prefixes stays as short as it is written."""
    return F.regexp_replace(_column(text), rf"(?iU)^{_literally(prefix)}", "")


def _literally(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def strip_suffix(text: Column | str, suffix: str) -> Column:
    """An empty suffix leaves the text as it is."""
    text = _column(text)
    ends = F.endswith(F.upper(text), F.lit(suffix.upper()))
    return F.when(ends & F.lit(bool(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def clean(text: Column | str) -> Column:
    """Single blanks, trimmed ends."""
    return trimmed(F.regexp_replace(_column(text), r"\s+", " "))


def capitalised(text: Column) -> Column:
    """First letter of each blank-separated word upper, the rest lower."""
    return F.initcap(F.lower(text))


def fallback_merchant(text: Column | str) -> Column:
    """First three words of letters, capitalised, or 'Unknown'."""
    words = F.filter(F.split(F.regexp_replace(_column(text), "[^A-Za-z ]", " "), " +"), lambda w: w != "")
    return F.when(F.size(words) > 0, capitalised(F.array_join(F.slice(words, 1, 3), " "))).otherwise("Unknown")


def currency(amount: Column, decimals: int = 2, template: str = "${}") -> Column:
    before, after = template.split("{}")
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(""), F.lit(before), F.format_number(F.abs(amount), decimals), F.lit(after))


def element_id(merchant: Column | str) -> Column:
    """Name without quotes, blanks as underscores."""
    return F.replace(F.translate(_column(merchant), "'\"", ""), F.lit(" "), F.lit("_"))


# What payment processors put before a merchant's name, and what varies after it, in the order in which they go.
PROCESSORS = ("APLPAY ", "SQ *", "TST*", "SP ", "PP*", "GOOGLE *")
ENDINGS = (r"\s+\d{4,}.*$", r"\s+[A-Z]{2}$", r"\s+\d{5}$", r"\s+#\d+")
NAME_ENDINGS = (*ENDINGS, r"\s+DES:.*$", r"\s+ID:.*$")


def _without(text: Column, patterns: tuple[str, ...]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    return text


def _without_processor(text: Column) -> Column:
    for prefix in PROCESSORS:
        text = strip_prefix(text, prefix)
    return text


def _first_words(text: Column, n: int = 3) -> Column:
    return F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n)


def suggested_pattern(text: Column | str) -> Column:
    """Regular expression of the first three words of the description in capitals, without what varies, escaped."""
    core = trimmed(_without_processor(_without(F.upper(_column(text)), ENDINGS)))
    return F.array_join(_first_words(F.regexp_replace(core, r"([.*+?^${}()|\[\]\\])", r"\\$1")), r"\s*")


def suggested_merchant(text: Column | str) -> Column:
    """First three words of the description without what varies, every run of letters capitalised, or 'Unknown'."""
    words = _first_words(_without(_without_processor(_column(text)), NAME_ENDINGS))
    runs = F.split(F.lower(F.array_join(words, " ")), r"(?<!\p{L})(?=\p{L})")
    titled = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")
    return F.when(F.size(words) > 0, titled).otherwise("Unknown")


def suggested_rule(text: Column | str, tags: Column | None = None) -> Column:
    """A rule to fill in; tags is an array of suggested tags."""
    pattern = F.replace(suggested_pattern(text), F.lit('"'), F.lit('\\"'))
    rule = F.format_string('[%s]\nmatch: contains("%s")\ncategory: CATEGORY\nsubcategory: SUBCATEGORY', suggested_merchant(text), pattern)
    return rule if tags is None else F.concat(rule, F.when(F.size(tags) > 0, F.concat(F.lit("\ntags: "), F.array_join(tags, ", "))).otherwise(""))


def register_sql_functions(spark: SparkSession) -> None:
    """The conditions as SQL temporary functions, which Catalyst inlines; rule texts use them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION has(t STRING, p STRING) RETURNS BOOLEAN RETURN contains(upper(t), upper(p))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION begins(t STRING, p STRING) RETURNS BOOLEAN RETURN startswith(upper(t), upper(p))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION finds(t STRING, p STRING) RETURNS BOOLEAN RETURN rlike(t, concat('(?iU)', p))")
    spark.sql(
        r"CREATE OR REPLACE TEMPORARY FUNCTION has_plain(t STRING, p STRING) RETURNS BOOLEAN RETURN "
        r"contains(regexp_replace(upper(t), '[\\s\\-\'.*]+', ''), regexp_replace(upper(p), '[\\s\\-\'.*]+', ''))"
    )
