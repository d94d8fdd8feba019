"""Payment card numbers inside longer digit runs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Test card numbers that card organisations publish.
TEST_CARDS = ["4111111111111111", "4012888888881881", "4222222222222", "4000056655665556", "5555555555554444", "5105105105105100", "5200828282828210", "378282246310005", "371449635398431", "378734493671000", "6011111111111117", "6011000990139424", "3530111333300000", "3566002020360505", "30569309025904", "38520000023237"]
#: Fixed pattern: digits with single separators inside one line.
CANDIDATE = r"(?<!\d)(?:\d(?:[-.]|[^\S\r\n])?){12,18}\d(?!\d)"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def card_windows(text: str | None) -> list[dict]:
    """(offset, digits) of each number in a text: cuts only between digit groups, the longest valid window first, then on after it."""
    found = []
    for match in re.finditer(CANDIDATE, text or ""):
        groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", match.group())]
        raw, i = match.group(), 0
        while i < len(groups):
            for j in range(len(groups), i, -1):
                digits = "".join(raw[a:b] for a, b in groups[i:j])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append({"offset": match.start() + groups[i][0], "digits": digits})
                    i = j
                    break
            else:
                i += 1
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("digits", T.StringType())])))
def card_numbers(text: pd.Series) -> pd.Series:
    return text.map(card_windows)
