"""URL filters: host and path rules, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models are learnt from URLs that a rule accepts and
from URLs that a rule blocks; a URL without a rule gets the verdict of its
length-normalised log-likelihood difference against a threshold calibrated on held-back
URLs. The models count all distinct URLs that a rule decides but a fifth, by crc32, and that
fifth sets the threshold; the driver receives contexts with their counts and differences
rounded to ``DIGITS``, never URLs.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule, and is
judged as the empty text; with no URL of one kind to learn from, all others are allowed.
Repeated rows get repeated verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored

HELD = 5  #: one URL in so many is held back
FLUSH = 500_000  #: counts that a task holds before it hands them on
DIGITS = 4  #: of a difference, where it is compared with the threshold
ORDER = 5  #: longest context, in characters
MIN_CONTEXT = 4  #: occurrences a context of over two characters needs to be kept
ALPHABET = 256  #: outcomes of the uniform base distribution
END = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, rule), a rule being host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. For short rule lists."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def counted(texts: Iterable[str], seen: dict[tuple[str, str], int]) -> None:
    """Add to ``seen`` how often each character follows each context."""
    for t in texts:
        s = t + END
        for i, c in enumerate(s):
            for k in range(min(i, ORDER) + 1):
                seen[s[i - k : i], c] += 1


class CharModel:
    """Witten-Bell smoothed character model; contexts are kept at the lengths the data support."""

    def __init__(self, texts: Sequence[str]):
        seen: dict[tuple[str, str], int] = defaultdict(int)
        counted(texts, seen)
        after: dict[str, dict[str, int]] = defaultdict(dict)
        for (x, c), n in seen.items():
            after[x][c] = n
        self.next = {x: (sum(n.values()), n) for x, n in after.items() if len(x) <= 2 or sum(n.values()) >= MIN_CONTEXT}
        self.memo: dict[str, float] = {}

    @classmethod
    def of(cls, table: dict[str, tuple[int, dict[str, int]]]) -> CharModel:
        """A model of contexts that are counted already."""
        m = cls(())
        m.next = table
        return m

    def chance(self, context: str, c: str) -> float:
        p = 1 / ALPHABET
        for k in range(len(context) + 1):
            if (found := self.next.get(context[len(context) - k :])) is None:
                break
            total, after = found
            p = (after.get(c, 0) + len(after) * p) / (total + len(after))
        return p

    def per_char(self, text: str) -> float:
        """Mean log-likelihood of the characters and the end mark."""
        s, total, memo = text + END, 0.0, self.memo
        if len(memo) > 500_000:
            memo.clear()
        for i in range(len(s)):
            key = s[max(0, i - ORDER) : i + 1]
            if (v := memo.get(key)) is None:
                v = memo[key] = math.log(self.chance(key[:-1], key[-1]))
            total += v
        return total / len(s)


def fit(accepted: Sequence[str], rejected: Sequence[str]) -> tuple[CharModel, CharModel, float] | None:
    """Models and threshold of URLs in memory; a fifth of them, by crc32, is held back to set the threshold."""
    held = [[t for t in xs if zlib.crc32(t.encode()) % HELD == 0] for xs in (accepted, rejected)]
    rest = [[t for t in xs if zlib.crc32(t.encode()) % HELD] for xs in (accepted, rejected)]
    if not all(rest):
        return None
    good, bad = CharModel(rest[0]), CharModel(rest[1])
    scores: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for y, ts in ((1, held[0] or rest[0]), (0, held[1] or rest[1])):
        for t in ts:
            scores[round(good.per_char(t) - bad.per_char(t), DIGITS)][y] += 1
    return good, bad, best_cut([(d, n1, n0) for d, (n0, n1) in scores.items()])


def best_cut(scores: Sequence[tuple[float, int, int]]) -> float:
    """Threshold of the best balanced accuracy, given (difference, accepted URLs, rejected URLs) of each difference."""
    scored = sorted(scores)
    n1, n0 = sum(x[1] for x in scored), sum(x[2] for x in scored)
    best, cut, below1, below0 = -1.0, 0.0, 0, 0
    values = [-math.inf, *(x[0] for x in scored), math.inf]
    for i in range(len(scored) + 1):  # threshold between the i lowest and the rest
        if i:
            below1, below0 = below1 + scored[i - 1][1], below0 + scored[i - 1][2]
        balanced = (n1 - below1) / max(n1, 1) + below0 / max(n0, 1)
        if balanced > best:
            lo, hi = values[i], values[i + 1]
            best, cut = balanced, (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (hi if math.isfinite(hi) else lo)
    return cut


def _context_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(says, context, c, n) of (says, url) rows, added up within a task as far as memory goes."""
    seen: dict[str, dict[tuple[str, str], int]] = {"allow": defaultdict(int), "block": defaultdict(int)}

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(kind, x, c, n) for kind, t in seen.items() for (x, c), n in t.items()], columns=["says", "context", "c", "n"])
        for t in seen.values():
            t.clear()
        return out

    for batch in batches:
        for at in range(0, len(batch), 1000):
            for kind, urls in batch.iloc[at : at + 1000].groupby("says")["url"]:
                counted(urls, seen[kind])
            if sum(map(len, seen.values())) >= FLUSH:
                yield rows()
    yield rows()


def char_models(decided: DataFrame) -> dict[str, dict[str, tuple[int, dict[str, int]]]]:
    """The contexts of each kind that the models keep, of all (says, url) rows."""
    n = decided.select("says", "url").mapInPandas(_context_counts, "says string, context string, c string, n long")
    n = n.groupBy("says", "context", "c").agg(F.sum("n").alias("n"))
    n = n.groupBy("says", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("c", "n")).alias("after"))
    kept = n.where((F.length("context") <= 2) | (F.col("total") >= MIN_CONTEXT))
    found: dict[str, dict[str, tuple[int, dict[str, int]]]] = {"allow": {}, "block": {}}
    for r in kept.toLocalIterator():
        found[r.says][r.context] = (r.total, {x.c: x.n for x in r.after})
    return found


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, llr): llr is null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("says", says)
    known = stored(p.where("says is not null").select("says", "url").distinct().withColumn("held", F.crc32(F.col("url").cast("binary")) % HELD == 0), "url-rules")
    tables = char_models(known.where("not held"))
    if not all(tables.values()):
        return p.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"))
    shared = pages.sparkSession.sparkContext.broadcast((tables["allow"], tables["block"]))
    loaded: list[CharModel] = []

    @F.pandas_udf("double")
    def llr(urls: pd.Series) -> pd.Series:
        if not loaded:
            loaded.extend(CharModel.of(t) for t in shared.value)
        good, bad = loaded
        return pd.Series([good.per_char(u) - bad.per_char(u) for u in urls.fillna("")], dtype="float64")

    kinds = {r.says for r in known.where("held").select("says").distinct().collect()}  # two at most
    judged = known.where(F.col("held") | ~F.col("says").isin(*kinds) if kinds else F.lit(True))
    scores = judged.select("says", F.round(llr("url"), DIGITS).alias("d")).groupBy("d").agg(F.count_if(F.col("says") == "allow").alias("n1"), F.count_if(F.col("says") == "block").alias("n0"))
    cut = best_cut([tuple(r) for r in scores.collect()])  # differences are of DIGITS digits and of bounded size

    # Only rows that no rule decides are scored.
    decided = p.where("rule is not null").withColumn("llr", F.lit(None).cast("double"))
    scored = p.where("rule is null").withColumn("llr", llr("url"))
    method = F.when(F.round("llr", DIGITS) >= cut, "allow").otherwise("block")
    return decided.unionByName(scored).select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "llr")
