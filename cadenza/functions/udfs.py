"""What SQL can't say: Unicode normal forms, sequence matching, alignments. Arrow-batched."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.alignments import edit_ops, local_alignment


def _ints(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, without the junk heuristic; 0 where one side is empty."""
    return pd.Series([SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


@F.pandas_udf(_ints("substitutions", "deletions", "insertions"))
def levenshtein_ops(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_ops(a or "", b or "") for a, b in zip(ref, hyp, strict=True)], columns=["substitutions", "deletions", "insertions"])


@F.pandas_udf(T.IntegerType())
def token_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of token lists."""
    return pd.Series([sum(edit_ops(list(a), list(b))) for a, b in zip(left, right, strict=True)], dtype="int32")


@F.pandas_udf(_ints("edits", "start", "stop"))
def best_local_alignment(ref: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([local_alignment(a or "", b or "") for a, b in zip(ref, text, strict=True)], columns=["edits", "start", "stop"])
