"""Patterns and text measures as native expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns the features are defined by. Word boundaries are ASCII, written out.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
PATTERNS = {
    "ens": r"\.eth$",
    "random_numbers": r"[0-9]{4,}",
    "wallet_pattern": r"0x[a-fA-F0-9]{40}",
    "excessive_symbols": r"[_.\-]{2,}",
    "airdrop_terms": rf"(?i){_B}(airdrop|farm|degen|wojak){_E}",
    "has_year": rf"{_B}(19|20)[0-9]{{2}}{_E}",
    "emoji_run": r"[\x{1F300}-\x{1F9FF}]{5,}",
    "price": r"\$[0-9]+|[0-9]+\$",
    "handle": r"@[A-Za-z0-9_]+",
    "link": r"https?://",
    "symbol_run": r"[!$@#%]{2,}",
    "suspicious": r"[!$@#%]{2,}|[0-9]{10,}|[A-Z]{5,}",
}


def has(pattern: str, text: Column | str) -> Column:
    """Whether the named pattern occurs; null for null."""
    return (F.col(text) if isinstance(text, str) else text).rlike(PATTERNS[pattern])


def count_of(pattern: str, text: Column | str) -> Column:
    """How often the named pattern occurs; null for null."""
    return F.regexp_count(text, F.lit(PATTERNS[pattern]))


def char_diversity(text: Column | str) -> Column:
    """Distinct ASCII letters and digits, case folded, over the length plus one."""
    cleaned = F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", ""))
    chars = F.filter(F.split(cleaned, ""), lambda c: c != "")
    return F.size(F.array_distinct(chars)).cast("double") / (F.char_length(text) + 1)


def words(text: Column | str) -> Column:
    """Parts between single spaces."""
    return F.split(text, " ", -1)


def share_of_symbol(text: Column | str, symbol: str) -> Column:
    """Occurrences of one character over the length; null for null and empty texts."""
    n = F.char_length(text)
    return (n - F.char_length(F.replace(text, F.lit(symbol), F.lit("")))).cast("double") / F.nullif(n, F.lit(0))


def json_list_size(text: Column | str) -> Column:
    """Length of a JSON array of numbers or objects in a string; 0 for null, empty and malformed texts."""
    return F.coalesce(F.json_array_length(text), F.lit(0))


def url_parameter(url: Column | str, name: str) -> Column:
    """A parameter of a URL's query, null if absent or empty."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def hex_of(binary: Column | str) -> Column:
    """0x and lower-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(binary)))


def address_list(text: Column | str) -> Column:
    """Distinct well-formed addresses (0x and 42 characters) of a JSON array of strings; empty for anything else."""
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(parsed, lambda a: a.startswith("0x") & (F.char_length(a) == 42)))


def hex_amount(text: Column | str, decimals: int = 18) -> Column:
    """A hexadecimal whole number (0x optional) over 10^decimals, as a double; up to 30 significant digits.

    Null for null, empty and malformed texts, and for numbers with more digits.
    """
    digits = F.regexp_extract(text, r"^(?:0[xX])?0*([0-9a-fA-F]{0,30})$", 1)
    ok = (F.col(text) if isinstance(text, str) else text).rlike(r"^(0[xX])?0*[0-9a-fA-F]{0,30}$") & (F.char_length(text) > 0)
    full = F.lpad(digits, 30, "0")
    part = lambda at: F.conv(F.substring(full, at, 15), 16, 10).cast("decimal(20,0)")
    # added up as decimals: a sum of two doubles would be rounded twice
    whole = part(1) * F.lit(Decimal(16**15)) + part(16)
    return F.when(ok, whole.cast("double") / float(10**decimals))


def hex_whole(n: Column) -> Column:
    """0x and hexadecimal digits of a whole number from 0 on, bigint or decimal(38,0), below 2^123; null for null."""
    n, low = n.cast("decimal(38,0)"), F.lit(Decimal(16**15))
    high = F.call_function("div", n, low)
    return F.concat(F.lit("0x"), F.hex(high), F.lpad(F.hex((n % low).cast("bigint")), 15, "0"))
