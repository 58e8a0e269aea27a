"""Places of query terms in a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

SPAN = "array<struct<term: string, start: long, end: long, context: string>>"


def find_spans(text: str | None, terms: list[str], most: int = 8, around: int = 40) -> list[dict]:
    """Up to `most` matches, term by term: byte offsets and the text around."""
    out: list[dict] = []
    for term in terms:
        for m in re.finditer(re.escape(term), text or "", re.IGNORECASE):
            if len(out) == most:
                return out
            a, b = m.span()
            size = lambda s: len(s.encode("utf-8", "surrogatepass"))
            out.append({"term": term, "start": size(text[:a]), "end": size(text[:b]), "context": text[max(0, a - around) : b + around]})
    return out


def spans(terms: list[str]):
    @F.pandas_udf(SPAN)
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda t: find_spans(t, terms))

    return found
