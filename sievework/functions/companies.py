"""Keys of company labels for exact matching: stricter than text.company_key, as words that describe a company stay."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import C, text

# Legal forms that don't count at the end of a label.
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "company", "co", "llc", "llp", "lp", "ltd", "limited", "plc", "gmbh", "ag", "nv", "bv", "sa", "pte", "pty")
# Letters that have no decomposition, spelt out.
SPELT_OUT = (("Ø", "O"), ("ø", "o"), ("Ł", "L"), ("ł", "l"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Ð", "D"), ("ð", "d"), ("Þ", "TH"), ("þ", "th"))


@F.pandas_udf(StringType())
def _plain_words(labels: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks; what is no letter or digit is a blank; case folded."""

    def plain(s: str) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
        return " ".join("".join(c if c.isalnum() else " " for c in kept).casefold().split())

    return labels.map(plain)


def label_key(c: C) -> Column:
    """Words of a label, split at its inner capitals, without accents, case and legal forms at the end. Null is the empty key."""
    s = F.regexp_replace(text(c), r"(?i)(?<![\p{L}\p{N}_])gmbh(?![\p{L}\p{N}_])", "gmbh")
    s = F.regexp_replace(s, "(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", " ")
    for letter, spelt in SPELT_OUT:
        s = F.replace(s, F.lit(letter), F.lit(spelt))
    words = _plain_words(F.replace(s, F.lit("&"), F.lit(" and ")))
    return F.ltrim(F.regexp_replace(F.concat(F.lit(" "), words), f"( and)?( ({'|'.join(LEGAL_SUFFIXES)}))+$", ""))
