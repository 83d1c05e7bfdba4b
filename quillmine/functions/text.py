"""Text functions as columns. They run in the JVM, except what needs compatibility forms of any script."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmine.functions import fixed
from quillmine.functions.conversion import Conversion

#: White space as Python's str.strip and \s see it, for Java patterns.
SPACE = r"[\s\x1c-\x1f]"
CJK = r"[一-鿿]"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, f"(?U){SPACE}+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def clean(text: Column) -> Column:
    return strip(squeeze(text))


def normalize_text(text: Column) -> Column:
    """Line ends, split course codes, runs of blanks and blank lines brought to one form."""
    for pattern, by in (
        ("\\x00", " "),
        ("\r\n|\r", "\n"),
        (rf"(?U)\b([A-Z]{{2,4}}){SPACE}+T{SPACE}*(\d{{4}}[A-Z]?)\b", "$1T$2"),
        (rf"(?U)\b([A-Z]{{2,4}}){SPACE}+(\d{{4}}[A-Z]?)\b", "$1$2"),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def _joined_codes(text: Column) -> Column:
    text = F.regexp_replace(text, rf"(?U)\b([a-z]{{2,4}}){SPACE}*t{SPACE}*(\d{{4}}[a-z]?)\b", "$1t$2")
    return F.regexp_replace(text, rf"(?U)\b([a-z]{{2,4}}){SPACE}+(\d{{4}}[a-z]?)\b", "$1$2")


_T2S = str.maketrans(fixed.TRADITIONAL)
_CODE = (re.compile(r"\b([a-z]{2,4})\s*t\s*(\d{4}[a-z]?)\b"), re.compile(r"\b([a-z]{2,4})\s+(\d{4}[a-z]?)\b"))


def search_form(text: str, conversion: Conversion | None = None) -> str:
    """The form in which texts are compared, for a Python string. conversion: a table in place of the built-in characters."""
    out = unicodedata.normalize("NFKC", text).lower()
    out = _CODE[1].sub(r"\1\2", _CODE[0].sub(r"\1t\2", out))
    return re.sub(r"\s+", " ", conversion.convert(out) if conversion else out.translate(_T2S)).strip()


def _search_form(text: Column, conversion: Conversion | None) -> Column:
    @F.pandas_udf(T.StringType())
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: search_form(t, conversion), na_action="ignore")

    return formed(text)


def search_text(text: Column, any_script: bool = True, conversion: Conversion | None = None) -> Column:
    """The form in which texts are compared: compatibility form, lower case, joined codes, simplified characters, single spaces.

    With any_script every row passes through Python, those of plain Latin letters as nulls whose form the JVM makes; without it all stays in the JVM.
    conversion: a table of phrases and characters in place of the built-in characters.
    """
    return _compared(text, clean(_joined_codes(F.lower(text))), any_script, conversion)


def _compared(text: Column, native: Column, any_script: bool, conversion: Conversion | None) -> Column:
    if not any_script:
        return native
    plain = text.rlike(r"\A[\x00-\x7EÀ-ÿ]*\z")
    return F.when(plain, native).otherwise(_search_form(F.when(~plain, text), conversion))


def tokens_of(form: Column) -> Column:
    """Words of two or more Latin letters or digits, each CJK character, and pairs of characters that follow each other."""
    latin = F.regexp_extract_all(form, F.lit("[a-z0-9]{2,}"), 0)
    single = F.regexp_extract_all(form, F.lit(CJK), 0)
    pairs = F.transform(
        F.array(single),
        lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))).otherwise(F.array().cast("array<string>")),
    )[0]
    return F.concat(latin, single, pairs)


def tokens(text: Column, any_script: bool = True, conversion: Conversion | None = None) -> Column:
    """The tokens of a text's form, which is made once. White space isn't brought to one kind for it, as no token has any."""
    return F.transform(F.array(_compared(text, _joined_codes(F.lower(text)), any_script, conversion)), tokens_of)[0]


def detect_language(text: Column) -> Column:
    chinese = F.length(F.regexp_replace(text, r"[^㐀-鿿]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(latin > chinese * 2, "en").otherwise("zh")


def bilingual_department(name: Column) -> Column:
    """struct(zh, en) of a department; an unknown one keeps its name, an empty one has none."""
    stripped = strip(name)
    out = F.struct(stripped.alias("zh"), F.lit(None).cast("string").alias("en"))
    for zh, en in fixed.DEPARTMENTS:
        out = F.when(F.lower(stripped).isin(zh, en.lower()), F.struct(F.lit(zh).alias("zh"), F.lit(en).alias("en"))).otherwise(out)
    return F.when(F.coalesce(F.length(name), F.lit(0)) > 0, out).otherwise(F.lit(None).cast("struct<zh:string,en:string>"))


def normalize_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))


def safe_filename(name: Column) -> Column:
    """Percent signs decoded, separators, control and reserved characters replaced, blanks and dots stripped."""
    decoded = F.url_decode(F.regexp_replace(F.replace(name, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.regexp_replace(F.regexp_replace(decoded, r'[/\\\x00-\x1f:*?"<>|]', "_"), r"\A[ .]+|[ .]+\z", "")


def is_aggregate_query(text: Column, any_script: bool = True) -> Column:
    form, out = search_text(text, any_script), F.lit(False)
    for pattern in fixed.AGGREGATE_PATTERNS:
        out = out | form.rlike(f"(?U){pattern}")
    return out


def classify_query(text: Column) -> Column:
    return (
        F.when(text.rlike(f"(?iu){fixed.LEARNING_PATTERN}"), fixed.LEARNING_PLAN)
        .when(text.rlike(f"(?iu){fixed.COURSE_PATTERN}"), fixed.COURSE_EXPLANATION)
        .otherwise(fixed.OFFICIAL_FACT)
    )


def contact_fields(text: Column) -> Column:
    """struct of emails, phones, office_hours and locations: distinct values in order of appearance, stripped."""
    return F.struct(
        *(
            F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?Uiu){p}"), F.lit(0)), strip)), 1, fixed.MOST_FIELD_VALUES).alias(k)
            for k, p in fixed.FIELD_PATTERNS.items()
        )
    )


_SPLIT_CODES = (re.compile(r"\b([A-Z]{2,4})\s+T\s*(\d{4}[A-Z]?)\b"), re.compile(r"\b([A-Z]{2,4})\s+(\d{4}[A-Z]?)\b"))


def normalized(text: str) -> str:
    """normalize_text for a Python string, for use inside UDFs."""
    out = re.sub("\r\n?", "\n", text.replace("\0", " "))
    out = _SPLIT_CODES[1].sub(r"\1\2", _SPLIT_CODES[0].sub(r"\1T\2", out))
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", out)).strip()


def found_fields(text: str) -> dict[str, list[str]]:
    """contact_fields for a Python string; kinds without a value are left out."""
    out = {}
    for kind, pattern in fixed.FIELD_PATTERNS.items():
        values = dict.fromkeys(m[0].strip() for m in re.finditer(pattern, text, re.IGNORECASE))
        if values:
            out[kind] = list(values)[: fixed.MOST_FIELD_VALUES]
    return out
