"""String operators over posting bodies. All are native expressions but for Unicode
normalisation and RFC link resolution, which have no built-in counterpart."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftwell.functions.batches import text_slices

# Fixed value: the characters that count as whitespace when a string is stripped.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as the body of a regex character class.
WS_CLASS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Bullets and middle dots that become a blank before normalisation.
BULLETS = "ㆍᆞ·•∙‧・"

# A line equal to one of these is dropped.
BOILERPLATE_LINES = (
    "포지션 및 자격요건",
    "모집분야 및 자격요건",
    "면접일정은 추후 통보됩니다.",
    "허위사실이 발견될 경우 채용이 취소될 수 있습니다.",
    "상세내용을 입력하세요",
    "학력 : 학력무관",
    "경력 : 경력무관",
    "서류전형 > 1차면접 > 2차면접 > 임원면접 > 최종합격",
)

# A line in which one of these patterns is found is dropped.
BOILERPLATE_PATTERNS = (
    r"^제\s*\d+\s*조\s*\(채용서류",
    r"채용서류의\s*반환",
    r"^[①-⑮]\s",
    r"대통령령으로\s*정하",
    r"^\(\s*[\d○]+\s*명\s*\)$",
)

MIN_CLEAN_LENGTH = 30


def java_pattern(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\d`` widened to their Unicode meaning."""
    return pattern.replace(r"\s", f"[{WS_CLASS}]").replace(r"\d", r"\p{Nd}")


def strip(col: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def present(col: Column) -> Column:
    """True where a text is neither missing nor empty."""
    return col.isNotNull() & (col != "")


def bullets_to_space(col: Column) -> Column:
    return F.translate(col, BULLETS, " " * len(BULLETS))


@F.arrow_udf(StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in text_slices(batch):
            normal = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
            yield pa.array(normal, pa.string())


def normalize_nfkc(col: Column) -> Column:
    """Unicode NFKC, for which Spark has no function; one Arrow hop over the whole text.

    Testing natively for texts that need no change costs more than sending all of them.
    """
    return _nfkc(col)


def collapse_blanks(col: Column) -> Column:
    """Runs of blanks and tabs become one blank."""
    return F.regexp_replace(col, r"[ \t]{2,}|\t", " ")


def stripped_lines(col: Column) -> Column:
    return F.transform(F.split(col, "\n"), strip)


def collapse_line_ws(col: Column) -> Column:
    """Per line: runs of blanks and tabs become one blank, both ends are stripped."""
    return F.array_join(stripped_lines(collapse_blanks(col)), "\n")


def keep_line(line: Column, exact: Sequence[str], patterns: Sequence[str]) -> Column:
    """Condition for a stripped line to stay: cheap tests first, regexes last."""
    keep = line != ""
    if exact:
        keep = keep & ~line.isin(*exact)
    for pattern in patterns:
        keep = keep & ~line.rlike(java_pattern(pattern))
    return keep


def drop_exact_lines(col: Column, exact: Sequence[str] = BOILERPLATE_LINES) -> Column:
    """Drop empty lines and lines equal to a listed one."""
    lines = F.filter(F.split(col, "\n"), lambda line: keep_line(line, exact, ()))
    return F.array_join(lines, "\n")


def drop_pattern_lines(col: Column, patterns: Sequence[str] = BOILERPLATE_PATTERNS) -> Column:
    """Drop empty lines and lines in which a pattern is found."""
    lines = F.filter(F.split(col, "\n"), lambda line: keep_line(line, (), patterns))
    return F.array_join(lines, "\n")


def clean_text(
    col: Column,
    exact: Sequence[str] = BOILERPLATE_LINES,
    patterns: Sequence[str] = BOILERPLATE_PATTERNS,
    strip_clause_numbers: bool = False,
) -> Column:
    """Normalise a posting body and drop its boilerplate lines.

    Bullets go first, since NFKC would turn some of them into other characters. For the same
    reason circled clause numbers never reach the patterns (NFKC makes them plain digits);
    ``strip_clause_numbers`` drops such lines beforehand.
    """
    text = bullets_to_space(col)
    if strip_clause_numbers:
        text = F.regexp_replace(text, r"(?m)^[ \t]*[①-⑮][ \t][^\n]*", "")
    text = collapse_blanks(normalize_nfkc(text))
    lines = F.filter(stripped_lines(text), lambda line: keep_line(line, exact, patterns))
    return F.array_join(lines, "\n")


def long_enough(col: Column, minimum: int = MIN_CLEAN_LENGTH) -> Column:
    """At least ``minimum`` code points, newlines counted."""
    return F.length(col) >= minimum


def flatten_newlines(col: Column) -> Column:
    return F.replace(col, F.lit("\n"), F.lit(" "))


def collapse_blank_lines(col: Column, blanks: bool = False) -> Column:
    """Three or more newlines become two; with ``blanks`` also runs of blanks become one."""
    text = F.regexp_replace(col, "\n{3,}", "\n\n")
    if blanks:
        text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(text)


def is_json_document(col: Column) -> Column:
    """True for exactly one complete JSON document.

    The built-in parsers read the first document and ignore what follows, so the text is checked
    inside an array and inside an object: a trailing document breaks at least one of them. What the parser of
    ``parse_json_ld`` would not take is no document either: single quotes, raw line breaks inside strings, and keys
    that occur twice in an object.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), col, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"d":'), col, F.lit("}")))
    single = (in_array == 1) & (F.size(in_object) == 1)
    return F.coalesce(single & F.try_parse_json(col).isNotNull(), F.lit(False))


def parse_json_ld(col: Column) -> Column:
    """VARIANT of a JSON document; null where the text is not exactly one document."""
    return F.when(is_json_document(col), F.try_parse_json(col))


def to_json_text(col: Column) -> Column:
    return F.to_json(col)


# The forms of posting addresses.
POSTING_ID_PATTERN = r"/GI_Read/(\d+)"
POSTING_CODE_PATTERN = r"Oem_Code=([^&]+)"
DEFAULT_CODE = "C1"


def extract_url_keys(
    url: Column,
    id_pattern: str = POSTING_ID_PATTERN,
    code_pattern: str = POSTING_CODE_PATTERN,
    default_code: str = DEFAULT_CODE,
) -> tuple[Column, Column]:
    """(posting number or null, partner code or the default) taken from a URL."""
    number = F.nullif(F.regexp_extract(url, id_pattern, 1), F.lit(""))
    code = F.nullif(F.regexp_extract(url, code_pattern, 1), F.lit(""))
    return number, F.coalesce(code, F.lit(default_code))


DETAIL_URL = (
    "https://www.jobkorea.co.kr/Recruit/GI_Read_Comt_Ifrm"
    "?Oem_Code=%s&Gno=%s&isHiringCenter=false&hideMapView=false"
)


def build_detail_url(number: Column, code: Column, template: str = DETAIL_URL) -> Column:
    """Address of the detail frame; null where the posting number is missing."""
    return F.when(number.isNotNull(), F.format_string(template, code, number))


def absolutize_url(href: Column, host: str) -> Column:
    """Prefix links that do not start with ``http`` by the host."""
    return (
        F.when(href.startswith("/"), F.concat(F.lit(host), href))
        .when(~href.startswith("http"), F.concat(F.lit(host + "/"), href))
        .otherwise(href)
    )


@F.pandas_udf(StringType())
def _urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href)])


def resolve_url(base: Column, href: Column) -> Column:
    """RFC 3986 resolution; absolute links do not travel to Python."""
    is_absolute = href.rlike(r"^https?://[^/?#]")
    joined = _urljoin(F.when(~is_absolute, base), F.when(~is_absolute, href))
    return F.when(is_absolute, href).otherwise(joined)


def truncate_preview(col: Column, size: int) -> Column:
    return F.substring(col, 1, size)


def join_parts(parts: Column, separator: str) -> Column:
    """Join the non-missing parts of an array."""
    return F.array_join(F.filter(parts, lambda part: part.isNotNull()), separator)
