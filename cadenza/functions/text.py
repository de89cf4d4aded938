"""Text and time expressions, all native. Lengths are code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
END_MARKS = "。！？!?…"
PUNCTUATION = r"[，。！？；：、,.!?;:]"

#: Clean-up rules, pattern and replacement, in order.
CLEANUP = (
    (r"<\|[^|]+?\|>", ""),
    (r"^[，,、；;：:]\s*", ""),
    (r"\s+([，。！？；：、,.!?;:])", "$1"),
    (r"([，。！？；：、])\s+", "$1"),
    (r"[，,、；;：:]+([。！？!?])", "$1"),
    (r"[，,]{2,}", "，"),
    (r"[。]{2,}", "。"),
    (r"[！!]{2,}", "！"),
    (r"[？?]{2,}", "？"),
    (r"\s{2,}", " "),
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clock(seconds: str | Column, comma: bool = False) -> Column:
    """HH:MM:SS.mmm; hours may pass 24."""
    ms = F.bround(_c(seconds) * 1000).cast("long")
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60]
    return F.concat(two(parts[0]), F.lit(":"), two(parts[1]), F.lit(":"), two(parts[2]), F.lit("," if comma else "."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_clock(text: str | Column) -> Column:
    """Seconds of [HH:]MM:SS[.mmm]; null if it isn't one."""
    part = lambda i: F.regexp_extract(_c(text), r"^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$", i)
    num = lambda i: F.coalesce(F.expr("try_cast(NULL AS double)"), F.replace(part(i), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    return F.when(part(3) != "", num(1) * 3600 + num(2) * 60 + num(3))


def auto_seconds(value: str | Column, threshold: float = 10_000.0) -> Column:
    """Milliseconds taken as such where the value is too large for seconds."""
    return F.when(_c(value) > threshold, _c(value) / 1000).otherwise(_c(value))


def cleaned(text: str | Column) -> tuple[Column, Column]:
    """Text after the clean-up rules, and how many characters they took."""
    x = _c(text)
    for pattern, to in CLEANUP:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x), F.greatest(F.lit(0), F.length(_c(text)) - F.length(x))


def cjk_count(text: str | Column) -> Column:
    return F.regexp_count(_c(text), F.lit(CJK))


def with_end_mark(text: str | Column) -> Column:
    """A full stop after six or more ideographs without an end mark."""
    t = F.rtrim(_c(text))
    bare = ~F.right(t, F.lit(1)).isin(*END_MARKS) & (cjk_count(t) >= 6)
    return F.when(bare, F.concat(t, F.lit("。"))).otherwise(_c(text))


def replaced_terms(text: str | Column, terms: dict[str, str]) -> tuple[Column, Column]:
    """How many terms occur, longer ones before shorter, and the text with each replaced by what it stands for."""
    longest = sorted(terms, key=lambda t: (-len(t), t))
    pattern = "|".join(re.escape(t) for t in longest)
    found = F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))
    other = F.create_map(*(F.lit(x) for t in longest for x in (t, terms[t])))
    parts = F.split(_c(text), pattern, -1)
    whole = F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(found, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, p: F.concat(other[m], p)), ""))
    return F.size(found), whole


def compact(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"\s+", "")


def scoring_form(text: str | Column) -> Column:
    """Without punctuation, separators and blanks."""
    return F.regexp_replace(_c(text), r"[\p{P}\p{Z}\s]", "")


def word_tokens(text: str | Column) -> Column:
    """Ideographs one by one, runs of other letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"{CJK}|[\p{{L}}\p{{N}}&&[^\x{{4e00}}-\x{{9fff}}]]+"), F.lit(0))


def repetitive(text: str | Column) -> Column:
    """Few different words, a short seed that fills most of the text, or one character that does."""
    t = F.trim(_c(text))
    n = F.length(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    few = (F.size(words) >= 3) & (F.size(F.array_distinct(words)) / F.size(words) < 0.4)

    def seeded(k: Column) -> Column:
        seed = F.left(t, k)
        times = (n - F.length(F.replace(t, seed, F.lit("")))) / k
        return (n >= k * 3) & (F.trim(seed) != "") & (times * k >= n * 0.6) & (times >= 3)

    bare = F.replace(t, F.lit(" "), F.lit(""))
    chars = F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != ""))
    most = F.array_max(F.transform(chars, lambda c: F.length(bare) - F.length(F.replace(bare, c, F.lit("")))))
    single = most / F.nullif(F.length(bare), F.lit(0)) > 0.6
    return (n >= 6) & (few | F.exists(F.sequence(F.lit(1), F.lit(8)), seeded) | F.coalesce(single, F.lit(False)))


def dense(text: str | Column, start: str, end: str) -> Column:
    """Ten characters or more at over twelve a second."""
    chars = F.length(F.replace(F.trim(_c(text)), F.lit(" "), F.lit("")))
    return (chars >= 10) & (chars / F.greatest(F.lit(0.001), F.col(end) - F.col(start)) > 12)


def repeated_unit(text: str | Column) -> Column:
    """The whole text is a unit of up to twelve characters, three times or more."""
    return _c(text).rlike(r"^(.{1,12}?)\1{2,}$")


def ngrams(text: str | Column, sizes: tuple[int, int]) -> Column:
    """All substrings of the sizes."""
    t = _c(text)
    of = lambda k: F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substr(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(k) for k in range(sizes[0], sizes[1] + 1)))


def suffix_prefix(left: str | Column, right: str | Column, limit: int) -> Column:
    """Longest end of left that begins right."""
    n = F.least(F.length(_c(left)), F.length(_c(right)), F.lit(limit))
    ks = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(ks, lambda k: F.right(_c(left), k) == F.left(_c(right), k))), F.lit(0))


def cue_weight(text: str | Column) -> Column:
    t = _c(text)
    return F.greatest(F.lit(1), F.length(compact(t))) + F.regexp_count(t, F.lit("[，、,]")) * 1.2 + F.regexp_count(t, F.lit("[。！？；：.!?;:]")) * 1.8


def suspicion(text: str | Column, start: str, end: str) -> Column:
    """Reasons to look at a segment again, in order."""
    t = _c(text)
    s, chars = F.trim(t), cjk_count(t)
    dur = F.greatest(F.col(end) - F.col(start), F.lit(0.001))
    many = F.filter(
        F.array(
            F.when((chars >= 10) & t.rlike(rf"({CJK}{{2,4}})\1"), "repeated word"),
            F.when(t.rlike(rf"({CJK})\1\1"), "repeated character"),
            F.when((dur >= 8) & (chars <= 6), "sparse"),
            F.when((dur >= 6) & (chars / dur >= 7.5), "fast"),
            F.when((chars >= 25) & ~t.rlike(PUNCTUATION), "no punctuation"),
        ),
        lambda r: r.isNotNull(),
    )
    return F.when(s == "", F.array(F.lit("empty"))).when(s.rlike(r"^[\p{P}\p{S}\s]+$"), F.array(F.lit("punctuation only"))).otherwise(many)


def without_tags(html: str | Column) -> Column:
    """Text between tags, blanks joined."""
    t = F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def paragraphs(text: str | Column, sentences: int = 4) -> Column:
    """Sentences joined by so many into paragraphs."""
    parts = F.filter(F.split(compact(text), r"(?<=[。！？.!?])"), lambda s: s != "")
    ks = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / sentences).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(ks, lambda k: F.array_join(F.slice(parts, k * sentences + 1, F.lit(sentences)), ""))


def measurements(text: str | Column) -> Column:
    """Numbers with their units."""
    return F.regexp_extract_all(_c(text), F.lit(r"\d+(?:\.\d+)?\s?(?:km|kg|cm|mm|m|g|%|s|h|元|米|公里|小时|分钟)"), F.lit(0))


def acronyms(text: str | Column) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?<![A-Za-z0-9_])[A-Z]{2,6}(?![A-Za-z0-9_])"), F.lit(0))


def safe_name(text: str | Column, most: int = 80) -> Column:
    """A file name's stem from any text."""
    return F.left(F.regexp_replace(F.regexp_replace(_c(text), r"[^\p{L}\p{N}._-]+", "_"), r"^[_.]+|[_.]+$", ""), F.lit(most))
