"""Text processing as native expressions on strings and ``array<string>``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# ASCII punctuation (symbols such as ^ and $ included) and the Unicode class P
PUNCTUATION = r"[\p{P}!-/:-@\[-`{-~]"
WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F\p{Z}]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F�]"

# fixed values: hyphen-like code points; the soft hyphen is dropped, the others become '-'
SOFT_HYPHEN = 0x00AD
HYPHENS = [
    0x002D, 0x007E, 0x00AD, 0x058A, 0x05BE, 0x2010, 0x2011, 0x2012, 0x2013,
    0x2014, 0x2015, 0x2053, 0x207B, 0x208B, 0x2212, 0x2E3A, 0x2E3B, 0x301C,
    0x3030, 0xFE31, 0xFE32, 0xFE58, 0xFE63, 0xFF0D,
]

_EMPTY = "array<string>"


def tokenize_simple(text: Column) -> Column:
    """Split on single spaces; trailing empty strings are dropped, inner ones kept."""
    trimmed = F.regexp_replace(text, " +$", "")
    only_spaces = (F.length(text) > 0) & (F.length(trimmed) == 0)
    return F.when(only_spaces, F.array().cast(_EMPTY)).otherwise(F.split(trimmed, " "))


def build_sentence(tokens: Column, delimiter: str = " ") -> Column:
    return F.array_join(tokens, delimiter)


def lower_case(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def _pieces(text: Column) -> Column:
    spaced = F.regexp_replace(text, f"({PUNCTUATION})", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda p: p != "")


def separate_punctuation(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, _pieces))


def text_chain(text: Column) -> Column:
    """The default processors (split, lower case, separate punctuation) on a whole
    string at once: splitting at spaces first changes nothing."""
    return _pieces(F.lower(text))


def normalize_hyphens(text: Column) -> Column:
    dashes = "".join(chr(c) for c in HYPHENS if c != SOFT_HYPHEN)
    # characters beyond the replacement string are deleted
    return F.translate(text, dashes + chr(SOFT_HYPHEN), "-" * len(dashes))


def clean_text(text: Column, char_class: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, char_class, replacement)


def terminate(tokens: Column, bos: str | None = "<bos>", eos: str | None = "<eos>") -> Column:
    parts = [F.array(F.lit(bos))] if bos is not None else []
    parts.append(tokens)
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def each_token(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda tokens: F.transform(tokens, lambda t: fn(t))


def unicode_normalize(form: str = "NFKC") -> Callable[[Column], Column]:
    """Normal forms are not among Spark's functions: one Arrow-batched UDF."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else unicodedata.normalize(form, s))

    return run


def strip_accents(text: Column) -> Column:
    """Decompose and drop non-spacing marks."""
    return F.regexp_replace(unicode_normalize("NFD")(text), r"\p{Mn}", "")


def bert_basic_tokenize(text: Column, lower: bool = True) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), WHITESPACE, " ")
    cleaned = F.trim(cleaned)
    if lower:
        cleaned = F.lower(cleaned)
    return _pieces(strip_accents(cleaned))


_WORD_AND_MARK = r"(\S+?)([.,?!])?(\s+|$)"


def bert_tokenize(text: Column) -> Column:
    """Words with a trailing mark split off."""
    words = F.regexp_extract_all(text, F.lit(_WORD_AND_MARK), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(_WORD_AND_MARK), F.lit(2))
    both = F.flatten(F.zip_with(words, marks, lambda w, m: F.array(w, m)))
    return F.filter(both, lambda t: t != "")


def bert_encode_pair(question: Column, paragraph: Column, max_length: int | None = None) -> dict[str, Column]:
    """Tokens, types, attention mask and valid length of a token pair.

    The valid length counts the tokens without the three special ones.
    """
    size = lambda c: F.size(c)
    tokens = F.concat(
        F.array(F.lit("[CLS]")), question, F.array(F.lit("[SEP]")), paragraph, F.array(F.lit("[SEP]"))
    )
    first = size(question) + 2
    types = F.transform(tokens, lambda t, i: (i >= first).cast("bigint"))
    attention = F.transform(tokens, lambda t: F.lit(1).cast("bigint"))
    valid = (size(question) + size(paragraph)).cast("bigint")
    if max_length is not None:
        pad = lambda v, x: F.concat(v, F.array_repeat(x, F.greatest(F.lit(max_length) - size(tokens), F.lit(0))))
        zero = F.lit(0).cast("bigint")
        types, attention = pad(types, zero), pad(attention, zero)
        tokens = pad(tokens, F.lit("[PAD]"))
    return {"tokens": tokens, "types": types, "attention": attention, "valid_length": valid}


def split_identifiers(line: Column) -> Column:
    """Camel-case words lower-cased; every non-letter is a token of its own."""
    parts = F.regexp_extract_all(line, F.lit(r"\p{Lu}?[\p{L}&&[^\p{Lu}]]+|\p{Lu}|\P{L}"), F.lit(0))
    lowered = F.transform(parts, lambda t: F.lower(t))
    return F.when(F.length(line) == 0, F.array().cast(_EMPTY)).when(F.length(line) == 1, F.array(line)).otherwise(lowered)


def normalize_lines(text: Column) -> Column:
    """Lines without trailing whitespace, empty ones dropped, indentation kept."""
    lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"\s+$", ""))
    return F.filter(lines, lambda s: s != "")


def truncate_pair(a: Column, b: Column, total: int) -> tuple[Column, Column]:
    """Drop last tokens of ``a`` and ``b`` in turn until ``total`` are left.

    With d tokens to drop, ``a`` gives ceil(d / 2) and ``b`` floor(d / 2) as far
    as they have them; what one side cannot give comes from the other.
    """
    na, nb = F.size(a), F.size(b)
    drop = F.greatest(na + nb - F.lit(total), F.lit(0))
    want_a, want_b = F.ceil(drop / 2).cast("int"), F.floor(drop / 2).cast("int")
    from_a = F.least(na, want_a + F.greatest(want_b - nb, F.lit(0)))
    from_b = F.least(nb, want_b + F.greatest(want_a - na, F.lit(0)))
    return F.slice(a, F.lit(1), na - from_a), F.slice(b, F.lit(1), nb - from_b)


def digest(tokens: Column) -> Column:
    """A hash of a token list that depends on order and boundaries."""
    return F.md5(F.array_join(tokens, "\u001f"))
