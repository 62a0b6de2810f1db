"""House numbers, postcodes, name folding and search keys (Column expressions; exact folding is an Arrow UDF)."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def _stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def house_numbers(text: Column) -> Column:
    """``12`` and ``12a`` give [12], ``12-16`` gives [12, 16], anything else gives none."""
    text = _stripped(text)
    pair = r"^([0-9]{1,18})\s*[A-Za-z]?\s*[-–/]\s*([0-9]{1,18})\s*[A-Za-z]?$"
    one = r"^([0-9]{1,18})\s*[A-Za-z]{0,2}$"
    number = lambda p, i: F.regexp_extract(text, p, i).try_cast("long")
    return F.when(text.rlike(pair), F.array(number(pair, 1), number(pair, 2))).when(text.rlike(one), F.array(number(one, 1))).otherwise(F.array().cast("array<bigint>"))


def postcode_key(code: Column) -> Column:
    """The outward part of a British code, else the first word if it is short and has a digit."""
    code = F.upper(_stripped(code))
    british = r"^([A-Z]{1,2}[0-9][A-Z0-9]?) ?[0-9][A-Z]{2}$"
    word = F.get(F.split(code, r"\s+"), 0)
    return F.when(code.rlike(british), F.regexp_extract(code, british, 1)).when(word.rlike(r"^[A-Z0-9-]{1,10}$") & word.rlike("[0-9]"), word)


def fold(name: Column, ae: str = "a") -> Column:
    """Lower case without accents; Danish and German letters spelled out. Latin letters only; see ``fold_exact``."""
    lowered = F.lower(name)
    for old, new in (("ø", "o"), ("æ", ae), ("ß", "ss"), ("ς", "σ")):
        lowered = F.replace(lowered, F.lit(old), F.lit(new))
    return F.translate(lowered, _ACCENTED, _PLAIN)


@cache
def _marks() -> dict[int, None]:
    """All combining marks, to be dropped."""
    return {c: None for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))}


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    def one(name):
        lowered = name.lower().replace("ø", "o").replace("æ", "a").replace("ß", "ss").replace("ς", "σ")
        return lowered if lowered.isascii() else unicodedata.normalize("NFKD", lowered).translate(_marks())
    return names.map(one, na_action="ignore")


def _west_european(name: Column) -> Column:
    """Whether ``fold`` alone is exact: names of letters and signs in ASCII and of West European letters."""
    return name.rlike(r"^[\x00-\x7FÀ-ÏÑ-ÖØ-Ýßà-ïñ-öø-ýÿ]*$")


def fold_exact(name: Column | str) -> Column:
    """``fold`` for all scripts: compatibility decomposition without combining marks. Only names with other letters and signs than those of
    West European languages go to Python."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(_west_european(name), fold(name)).otherwise(_decomposed(F.when(~_west_european(name), name)))


def key_words(name: Column, exact: bool = True) -> Column:
    """The words of each part of a name (parts end at ", ") as they stand in the search index, without the region in brackets at its end.
    ``exact``: letters of all scripts are decomposed (an Arrow UDF), else Latin ones only."""
    bare = F.regexp_replace(name, r"^(.*) \(.*\)$", "$1")
    bare = F.coalesce(_decomposed(F.when(~_west_european(bare), bare)), bare) if exact else bare  # parts are folded below
    return F.transform(F.split(bare, ", "), lambda p: F.filter(F.split(F.regexp_replace(F.regexp_replace(fold(p), "['’]", ""), "[^a-z0-9]", " "), r"\s+"), lambda w: w != ""))


def search_keys(name: Column, exact: bool = True) -> Column:
    """Every word and every part of several words of a name; distinct, sorted."""
    parts = key_words(name, exact)
    words = F.flatten(parts)
    phrases = F.transform(F.filter(parts, lambda p: F.size(p) > 1), lambda p: F.array_join(p, " "))
    return F.array_sort(F.array_distinct(F.concat(words, phrases)))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def title(text: Column) -> Column:
    """Every run of letters with a capital at its start, after signs and digits too; underscores are blanks."""
    runs = F.regexp_extract_all(F.replace(text, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def bare_number(text: Column) -> Column:
    """A number in its shortest form (``4.0`` is ``4``, ``2.50`` is ``2.5``); anything else stays."""
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    size = F.abs(number)
    return F.when((number == F.floor(number)) & (size < 1e15), F.floor(number).cast("long").cast("string")).when((size >= 1e-3) & (size < 1e7), number.cast("string")).otherwise(text)


def loose(name: Column) -> Column:
    """Letters and digits only, accents dropped."""
    return F.regexp_replace(fold(name), "[^a-z0-9]", "")
