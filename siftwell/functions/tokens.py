"""Word and morpheme splitting with native regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control tokens, in the order of their ids.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")

# Domain terms that are never split.
USER_TERMS = (
    "4대보험", "주5일", "연차수당", "퇴직연금", "포트폴리오",
    "백엔드", "프론트엔드", "데이터엔지니어", "풀스택",
    "B2B", "B2C", "CRM", "ERP", "KPI", "SQL", "AWS",
)

# Words are runs of letters, marks, digits and non-ASCII symbols; every other visible character, which
# is Unicode punctuation or an ASCII symbol, is a word of its own. The plain ranges come first since
# they settle most characters.
LETTERS = r"a-zA-Z0-9\p{L}\p{M}\p{N}[\p{S}&&[^\x00-\x7f]]"
MARKS = r"!-/:-@\[-`{-~\p{P}"
WORD_PATTERN = rf"[{LETTERS}]+|[{MARKS}]"

# Characters removed before splitting: controls other than tab and line ends, and U+FFFD.
CONTROL_PATTERN = r"[\p{C}\x{fffd}&&[^\t\n\r]]"

# One visible character.
VISIBLE = r"[^\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"


def _longest_first(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def pretokenize(col: Column, specials: Sequence[str] = ()) -> Column:
    """Words of a text: split at whitespace and around every punctuation mark.

    Case and accents are kept and Han runs stay whole. ``specials`` are matched as one word.
    """
    text = F.regexp_replace(col, CONTROL_PATTERN, "")
    pattern = f"{_longest_first(specials)}|{WORD_PATTERN}" if specials else WORD_PATTERN
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def segment_pattern(terms: Sequence[str] = USER_TERMS) -> str:
    """User terms first, then runs of one script, digits, or a single other mark."""
    runs = r"[가-힣\p{IsHangul}]+|[一-鿿\p{IsHan}]+|[a-zA-Z\p{IsLatin}]+|\p{L}+|\p{Nd}+"
    head = f"{_longest_first(terms)}|" if terms else ""
    return f"{head}{runs}|{VISIBLE}"


def segment_forms(col: Column, terms: Sequence[str] = USER_TERMS) -> Column:
    """Surface forms of a text: the built-in stand-in for a morphological analyzer."""
    return F.regexp_extract_all(col, F.lit(segment_pattern(terms)), F.lit(0))
