"""SQL fragments of the text operators, written apart from the Spark expressions."""

from __future__ import annotations

from siftwell.functions.text import BOILERPLATE_LINES, BOILERPLATE_PATTERNS, BULLETS, WHITESPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
LINES = ", ".join(quoted(line) for line in BOILERPLATE_LINES)
PATTERNS = [quoted(p) for p in BOILERPLATE_PATTERNS]


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def bullets(expr: str) -> str:
    return f"translate({expr}, {quoted(BULLETS)}, {quoted(' ' * len(BULLETS))})"


def nfkc(expr: str) -> str:
    """NFKC over the closed set of characters that the noise brings in."""
    single = f"translate({expr}, chr(160) || chr(12288) || '１①ＭＤㆍ', '  11MDᆞ')"
    return f"replace({single}, '㎡', 'm2')"


def blanks(expr: str) -> str:
    return f"regexp_replace({expr}, '[ \\t]+', ' ', 'g')"


def lines(expr: str) -> str:
    return f"list_transform(string_split({expr}, chr(10)), lambda x: {strip('x')})"


def keep_exact(expr: str) -> str:
    return f"list_filter({expr}, lambda x: x <> '' AND x NOT IN ({LINES}))"


def keep_pattern(expr: str) -> str:
    tests = " AND ".join(f"NOT regexp_matches(x, {p})" for p in PATTERNS)
    return f"list_filter({expr}, lambda x: x <> '' AND {tests})"


def join_lines(expr: str) -> str:
    return f"array_to_string({expr}, chr(10))"


def clean(expr: str) -> str:
    return join_lines(keep_pattern(keep_exact(lines(blanks(nfkc(bullets(expr)))))))


# words as in the pre-tokenizer, and surface forms as in the built-in segmentation
PUNCT = r"\p{P}$+<=>^`|~"
WORD = rf"[{PUNCT}]|[^\s{PUNCT}]+"


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, {quoted(WORD)})"
