"""Secret scans by multipart credential linking, in DataFrame functions throughout.

Base patterns find assignments, access keys and long hex runs. Weak candidates
(identifiers, 40-character secrets, endpoints) are joined by interval to their complementary
parts within a scope, ``SCOPE`` characters around them in the same text, and reported only where these
occur: a weak secret beside an identifier, an identifier beside a secret, an endpoint
beside both. Intervals meet on a grid of cells with one row per text, cell and part, so
that texts with many matches make no pairs.

Positions come from the lengths of the pieces between matches, summed in order; equal texts
are scanned into the same few rows, kept once by their SHA-256.

Edge cases: a null text is empty and has no span; null ids are kept; repeated rows repeat;
other columns are passed by ``redact`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import fresh, stored

#: Base kinds in the order in which they are listed, then the linked kinds.
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
KINDS = BASE + WEAK
#: Patterns. Those with a least length match the same spans as their
#: unbounded forms with short matches dropped; the assignment's must not be bounded.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "identifier": r"""(?i)(?:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"https?://[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?[A-Za-z0-9._~/-]*",
}
#: A text without any of these (in lower case for the first) can't match.
NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "endpoint": ("http",), "identifier": ("id", "account", "user", "login")}
MIN_VALUE = 8  #: characters of an assignment's value
SCOPE = 200  #: characters between a weak candidate and its complement
MASK = "[SECRET]"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _has(text: Column, kind: str) -> Column:
    seen = F.lit(kind not in NEEDS)
    where = F.lower(text) if kind in ("assign", "identifier") else text
    for needle in NEEDS.get(kind, ()):
        seen = seen | where.contains(needle)
    return seen & text.rlike(PATTERNS[kind])


def _pieces(text: Column, kind: str) -> Column:
    """Of each match in order: kind, its number, characters between it and the one before, its own, whether it counts."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind == "assign":
        found = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
        match, good = (lambda x: x["m"]), (lambda x: F.length(x["v"]) >= MIN_VALUE)
    else:
        match, good = (lambda x: x), (lambda x: F.lit(True))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(g.alias("gap"), F.length(match(x)).alias("len"), good(x).alias("ok")))
    return F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))


def spans(texts: DataFrame) -> DataFrame:
    """(h, kind, start, end) of all reported spans of a column t of texts; h is the SHA-256 of t. Distinct."""
    t = F.col("t")
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    marked = texts.select("t", *(_has(t, k).alias(k) for k in BASE), _has(t, "identifier").alias("identifier"))
    # A weak secret needs an identifier, and identifiers and endpoints need a secret.
    marked = marked.withColumn("secret", (F.col("access") | F.col("identifier")) & _has(t, "secret"))
    part = F.col("assign") | F.col("hex") | F.col("secret")
    marked = marked.where(F.col("access") | part)
    marked = marked.withColumn("endpoint", part & (F.col("access") | F.col("identifier")) & _has(t, "endpoint")).withColumn("identifier", F.col("identifier") & part)
    every = F.concat(*(F.when(F.col(k), _pieces(t, k)).otherwise(none) for k in KINDS))
    rows = marked.select(F.sha2("t", 256).alias("h"), F.explode(every).alias("p")).select("h", "p.*").distinct()
    before = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("h", "kind").orderBy("i"))
    rows = rows.withColumn("end", before.cast("long")).where("ok").select("h", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    rows = stored(rows, "secret-spans")
    return rows.where(F.col("kind").isin(*BASE)).unionByName(linked(rows))


def linked(found: DataFrame) -> DataFrame:
    """The weak candidates among (h, kind, start, end) whose complementary parts occur within SCOPE characters."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SCOPE), F.floor(hi / SCOPE))).alias("cell")
    holder, key = F.col("kind").isin("access", "identifier"), F.col("kind").isin("assign", "hex", "secret")
    part = F.when(holder, "holder").when(key, "key")
    # One row for each text, cell and part. Within a cell the outermost ends decide as well as
    # all spans would: none can lie on both sides of a window that is wider than the cell.
    parts = found.select("h", "start", "end", part.alias("part")).where("part is not null")
    parts = parts.select("h", "part", "start", "end", cells(F.col("start"), F.col("end")))
    parts = parts.groupBy("h", "part", "cell").agg(F.min("start").alias("least"), F.max("end").alias("most"))
    needs = F.when(F.col("kind") == "secret", F.array(F.lit("holder"))).when(F.col("kind") == "identifier", F.array(F.lit("key"))).otherwise(F.array(F.lit("holder"), F.lit("key")))
    weak = found.where(F.col("kind").isin(*WEAK)).select("h", "kind", "start", "end", F.size(needs).alias("wanted"), F.explode(needs).alias("part"))
    weak = weak.select("*", cells(F.col("start") - SCOPE, F.col("end") + SCOPE))
    near = (F.col("least") <= F.col("end") + SCOPE) & (F.col("most") >= F.col("start") - SCOPE)
    met = weak.join(parts, ["h", "part", "cell"]).where(near)
    met = met.groupBy("h", "kind", "start", "end", "wanted").agg(F.count_distinct("part").alias("n"))
    return met.where("n = wanted").select("h", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = spans(d.select("t")).withColumn("rank", rank).withColumn("said", F.concat_ws(":", "kind", "start", "end"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["said"]), ",")
    one = F.struct("start", "rank", "end", "said")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    said = found.groupBy("h").agg(*counts, ordered(F.when(F.col("rank") <= len(BASE), one)).alias("base"), ordered(one).alias("spans"), F.count_if(F.col("rank") > len(BASE)).alias("n_linked"))
    # Stored, so that the join has plain exchanges on either side and a hot text's rows can be split.
    said = stored(said.select("h", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "n_linked"), "secret-texts")
    out = d.select("doc_id", F.sha2("t", 256).alias("h")).join(said, "h", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *(zero(f"n_{k}") for k in BASE), F.coalesce("base_sha256", F.lit(EMPTY_SHA)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span (overlapping ones as one) replaced; texts without any stay as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = spans(docs.select(text.alias("t")))
    w = W.partitionBy("h").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    joined = found.select("h", "start", "end").distinct()
    joined = joined.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    joined = joined.groupBy("h", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = joined.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = stored(cuts, "secret-cuts")
    key, mark = fresh(docs, "h"), fresh(docs, "cuts")
    hit = F.lit(False)
    for k in KINDS[:-1]:
        if k not in ("identifier",):
            hit = hit | _has(text, k)
    clean, rest = docs.where(~hit), docs.where(hit)
    last = F.element_at(mark, -1)["end"]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(mark, lambda c: c["end"]))
    ends = F.concat(F.transform(mark, lambda c: c["start"]), F.array(F.greatest(F.length(text).cast("long"), last)))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    rest = rest.withColumn(key, F.sha2(text, 256)).join(cuts.select(F.col("h").alias(key), F.col("cuts").alias(mark)), key, "left")
    rest = rest.withColumn(text_col, F.when(F.col(mark).isNull(), F.col(text_col)).otherwise(F.array_join(kept, mask)))
    return clean.unionByName(rest.select(*docs.columns))
