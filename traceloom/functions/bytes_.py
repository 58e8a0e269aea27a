"""Caps in bytes that never split a character: Arrow functions, as Spark's substring counts characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _floor(data: bytes, n: int) -> int:
    """The last character border at or before n."""
    while 0 < n < len(data) and data[n] & 0xC0 == 0x80:
        n -= 1
    return max(n, 0)


def _ceil(data: bytes, n: int) -> int:
    while n < len(data) and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def truncate_middle(text: str, most: int) -> str:
    """Three quarters of what fits from the head, a marker with the bytes left out, the tail."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= most:
        return text
    gone = len(data) - most
    for _ in range(8):  # the marker's own length depends on the number in it
        mark = f"\n... [{gone} bytes omitted] ...\n".encode()
        room = max(most - len(mark), 0)
        head = _floor(data, room * 3 // 4)
        tail = _ceil(data, len(data) - (room - head))
        if tail - head == gone:
            break
        gone = tail - head
    return (data[:head] + mark + data[tail:]).decode("utf-8", "surrogatepass")


def truncate_head(text: str, most: int) -> str:
    data = text.encode("utf-8", "surrogatepass")
    return text if len(data) <= most else data[: _floor(data, most)].decode("utf-8", "surrogatepass")


def cap_middle(most: int):
    @F.pandas_udf("string")
    def cap(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate_middle(t, most))

    return cap


def cap_head(most: int = 8192):
    @F.pandas_udf("string")
    def cap(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate_head(t, most))

    return cap
