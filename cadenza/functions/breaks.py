"""Where texts break: sentences, cues and splits at a share of the length, all native.

Places are code points counted from the start; a break lies behind the character it counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, a cue and a side of a split, and the longest sentence and cue.
SENTENCE_MARKS, CUE_MARKS, SPLIT_MARKS = "。！？!?；;\n", "，。！？；：、,.!?;:", "。！？!?；;，,"
SENTENCE_CHARS, CUE_CHARS, CUE_SPAN = 80, 12, 3
#: Least and greatest share of a split, how far it may move to a mark, and the shortest side.
SHARE_LOW, SHARE_HIGH, REACH, SIDE_CHARS = 0.15, 0.85, 12, 4


def _ends(pieces: Column) -> Column:
    """Running sums of the pieces' lengths; of no pieces, one break at 0."""
    ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.length(p)))
    return F.when(F.size(pieces) == 0, F.array(F.lit(0))).otherwise(ends)


def _pieces(text: str, marks: str, least: int, most: int) -> Column:
    """The text cut behind each mark that ends a piece of at least ``least`` characters, and at ``most`` in any case."""
    head, rest = f".{{{least - 1}}}", most - least
    pattern = f"(?s){head}[^{marks}]{{0,{rest}}}[{marks}]|{head}[^{marks}]{{{rest + 1}}}|.+"
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))


def sentence_breaks(text: str, most: int = SENTENCE_CHARS) -> Column:
    """Ends of sentences; one without a mark ends after ``most`` characters."""
    return _ends(_pieces(text, SENTENCE_MARKS, 1, most))


def cue_breaks(text: str, most: int = CUE_CHARS) -> Column:
    """Ends of cues: at a mark, if the cue has three characters, or after ``most``."""
    return _ends(_pieces(text, CUE_MARKS, CUE_SPAN, most))


def split_by_share(text: str, share: str, at_mark: bool = False) -> Column:
    """(left, right) of a split near a share of the length, behind the nearest mark in reach, of equally near ones the first.

    Without a mark in reach it is at the share itself, or null with ``at_mark``; null also where a side is too short.
    """
    t, n = F.coalesce(F.col(text), F.lit("")), F.length(F.col(text))
    rough = F.rint(n * F.greatest(F.lit(SHARE_LOW), F.least(F.lit(SHARE_HIGH), F.col(share)))).cast("int")
    low, high = F.greatest(F.lit(SIDE_CHARS), rough - REACH), F.least(n - SIDE_CHARS, rough + REACH)
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    marked = F.filter(places, lambda i: F.instr(F.lit(SPLIT_MARKS), F.substring(t, i, F.lit(1))) > 0)
    near = F.array_min(F.transform(marked, lambda i: F.struct(F.abs(i - rough).alias("d"), i.alias("i"))))["i"]
    at = near if at_mark else F.coalesce(near, rough)
    left, right = F.regexp_replace(F.substring(t, F.lit(1), at), r"^\s+|\s+$", ""), F.regexp_replace(F.substring(t, at + 1, n), r"^\s+|\s+$", "")
    whole = (rough > 0) & (rough < n) & (F.length(left) >= SIDE_CHARS) & (F.length(right) >= SIDE_CHARS)
    return F.when(whole, F.struct(left.alias("left"), right.alias("right")))
