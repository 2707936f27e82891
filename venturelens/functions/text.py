"""Text expressions: tokens, hash buckets, word-set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venturelens.schema import TOKEN_PATTERN, TOKEN_SPLIT_PATTERN


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def raw_tokens(col: Column | str) -> Column:
    """Maximal ASCII letter/digit runs of the whole text (case kept)."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def word_tokens(col: Column | str) -> Column:
    """Lower-case ASCII word runs of the whole text."""
    return F.transform(raw_tokens(col), F.lower)


def token_hash(token: Column) -> Column:
    """md5 of the lower-cased token, as 32 hex digits."""
    return F.md5(F.lower(token))


def _hex_digit(h: Column, pos: int) -> Column:
    code = F.ascii(F.substring(h, pos, 1))
    return code.bitwiseAND(F.lit(15)) + F.shiftright(code, 6) * 9


def hash_bucket(h: Column, dim: int) -> Column:
    """First 32 bits of an md5 hex digest, modulo ``dim``.

    For ``dim`` dividing 256 the value only depends on the 7th and 8th hex
    digits, decoded branch-free with integer arithmetic.
    """
    if 256 % dim == 0:
        byte = _hex_digit(h, 7) * 16 + _hex_digit(h, 8)
        return F.pmod(byte, F.lit(dim)).cast("int")
    head = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim)).cast("int")


def token_bucket(token: Column, dim: int) -> Column:
    """md5 bucket of one token (see ``hash_bucket``)."""
    return hash_bucket(token_hash(token), dim)


def word_set(col: Column | str) -> Column:
    """Distinct lower-case words of a text."""
    words = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), TOKEN_SPLIT_PATTERN)
    return F.array_remove(F.array_distinct(words), "")


def jaccard_percent(a: Column | str, b: Column | str) -> Column:
    """round(100 x |A and B| / |A or B|) over word sets; 0 when both are empty."""
    sa, sb = word_set(a), word_set(b)
    inter = F.size(F.array_intersect(sa, sb))
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(100.0) * inter / union, 0))


def shared_word_count(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(word_set(a), word_set(b))).cast("bigint")
