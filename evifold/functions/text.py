"""Text expressions, in the JVM as far as it has them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that NFKC leaves as they are, of the scripts in common use; texts of these alone need no normalising.
_NORMAL = r"\x00-\x7f\xa0\xab\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u052f\u2010-\u2023\u2030-\u2032\u2039\u203a\u3000-\u3002\u3005-\u3029\u3041-\u3096\u30a1-\u30fe\u3400-\u4dbf\u4e00-\u9fff"
NOT_WORD = r"[^\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters that full case folding changes still: those that become one character, and several."""
    low = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))) if c.lower() == c and c.casefold() != c]
    return {c: c.casefold() for c in low if len(c.casefold()) == 1}, {c: c.casefold() for c in low if len(c.casefold()) > 1}


def fold_case(c: Column) -> Column:
    """Unicode full case folding: ß equals SS, ς equals σ, µ equals μ; the dotless ı stays a letter of its own. NULL gives NULL.

    ASCII costs one mapping to lower case; only rows with one of the rare letters pay for more.
    """
    one, several = _foldings()
    rare = {k: v for k, v in several.items() if k != "ß"}
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    table = F.create_map(*(F.lit(x) for pair in (one | rare).items() for x in pair))
    spelled = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(low.rlike("[" + "".join(one) + "".join(rare) + "]"), spelled).otherwise(low)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """``c`` in Unicode's form NFKC. NULL gives NULL. Only texts with characters outside the common scripts leave the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(f"[^{_NORMAL}]"), c)), c)


def words_text(c: Column) -> Column:
    """The words of ``c`` (runs of letters and digits), case folded, with one blank between them. NULL gives NULL."""
    return fold_case(F.trim(F.regexp_replace(c, NOT_WORD, " ")))


def collapse_space(c: Column) -> Column:
    """Each run of ASCII white space becomes one blank; ends are trimmed. NULL gives NULL."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """``df`` with the column ``name``, evaluated once per row: filters on it are not pushed below, where they would repeat it."""
    return df.select("*", F.explode(F.array(expression)).alias(name))
