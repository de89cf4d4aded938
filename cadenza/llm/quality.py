"""Quality: a compression classifier from zstandard dictionaries of good and bad text.

Each text is cut into windows of ``WINDOW`` bytes, each compressed with a dictionary built
from good texts and with one built from bad texts; the difference of the two total sizes per
byte of text becomes a calibrated score. Dictionaries and calibration use a bounded sample
(``TRAIN_ROWS`` labelled texts of each class, by hash of the id, half for either); every
text is scored whole.

Edge cases: null and empty texts have difference 0; null ids count as held out and keep
their null; rows may repeat and get equal scores; a very long text is as many windows as it
takes, and long texts are learnt from like others; an empty table gives an empty result; with
labels of one class or none, every score is 1 (nothing is rejected without evidence). A score
equal to the threshold is accepted. Other columns are kept by ``score_texts`` as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cadenza.llm.common import bounded_batches, crc_fold, labelled_sample, lean
from cadenza.llm.toxicity import best_cut

TRAIN_ROWS = 2000  #: labelled texts of each class that the classifier is fitted on
WINDOW = 1024  #: bytes compressed at a time, so that a dictionary matters throughout a text
DICTIONARY = 1 << 16  #: bytes of a dictionary
SAMPLES = 20_000  #: windows that a dictionary is built from, at most; those of least hash
LEVEL = 3
THRESHOLD = 0.5


def windows(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on windows of all the texts, or the windows themselves where there are too few to train on."""
    parts = sorted((w for t in texts for w in windows(t)), key=lambda w: (zlib.crc32(w), w))[:SAMPLES]
    size = min(DICTIONARY, max(256, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts[: DICTIONARY // WINDOW]) or b"\0" * 8


class Sizer:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: str | None) -> float:
        """Bytes with the bad dictionary less bytes with the good one, per byte of text."""
        parts = windows(text)
        good, bad = self.tools
        return sum(len(bad.compress(w)) - len(good.compress(w)) for w in parts) / max(1, sum(map(len, parts)))


@dataclass
class Model:
    good: bytes
    bad: bytes
    cut: float
    slope: float

    def score(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (d - self.cut), -500, 500)))


def fit(rows: list[tuple[str, int]], sizes: list[int]) -> Model | None:
    """Dictionaries from one half of the texts (by crc32), cut and slope from the other, weighted to the classes' sizes."""
    if len({y for _, y in rows}) < 2:
        return None
    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t, _ in rows]
    first = [[t for (t, y), h in zip(rows, half, strict=True) if y == c and h] or [t for t, y in rows if y == c] for c in (0, 1)]
    m = Model(dictionary(first[1]), dictionary(first[0]), 0.0, 1.0)
    rest = [r for r, h in zip(rows, half, strict=True) if not h]
    rest = rest if len({y for _, y in rest}) == 2 else rows
    tool = Sizer(m.good, m.bad)
    d, y = np.array([tool.difference(t) for t, _ in rest]), np.array([v for _, v in rest], float)
    share = [sizes[c] / max(1, sum(sizes)) / (y == c).sum() for c in (0, 1)]
    weight = np.where(y == 1, share[1], share[0])
    m.cut = best_cut(d, y, weight)
    # The slope of least weighted log loss, of a fixed grid.
    loss = lambda k: float((weight * np.logaddexp(0, -k * (d - m.cut) * (2 * y - 1))).sum())
    m.slope = min((10.0**e for e in np.arange(0, 4.01, 0.1)), key=loss)
    return m


def score_texts(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in a new last column."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        return docs.withColumn(score_col, F.lit(1.0))
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sizer(model.good, model.bad)
        for batch in batches:
            d = np.array([tool.difference(t) for t in batch.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(d))], names)

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    return fit(*labelled_sample(docs, labels, "quality", rows))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_texts(docs.select("doc_id", "text"), trained(docs, labels))
    return scored.select("doc_id", (crc_fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
