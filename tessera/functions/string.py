"""String functions with PostgreSQL-flavoured rules, as Column expressions where Spark can express them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def concat(*parts) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def concat_strict(*parts) -> Column:
    return F.concat(*parts)


def casefold(x) -> Column:
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def initcap(x) -> Column:
    """The first letter of each run of letters and digits is upper case, the others lower case."""
    parts = F.regexp_extract_all(_c(x), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.char_length(p))))), "")


def left(x, n: int) -> Column:
    """A negative n drops that many characters from the end."""
    c = _c(x)
    return F.left(c, F.lit(n)) if n >= 0 else c.substr(F.lit(1), F.greatest(F.lit(0), F.char_length(c) + n))


def right(x, n: int) -> Column:
    """A negative n drops that many characters from the start."""
    c = _c(x)
    return F.right(c, F.lit(n)) if n >= 0 else c.substr(F.lit(1 - n), F.greatest(F.lit(0), F.char_length(c) + n))


def substring(x, start: int, length: int | None = None) -> Column:
    """A start below 1 uses up length."""
    c = _c(x)
    if length is None:
        return c.substr(F.lit(max(start, 1)), F.char_length(c))
    return c.substr(F.lit(max(start, 1)), F.lit(max(0, length + min(start, 1) - 1)))


mid = substring


def position(x, part: str) -> Column:
    return F.locate(part, _c(x))


def quote_ident(x) -> Column:
    c = _c(x)
    return F.when(c.rlike(r"^[a-z_][a-z0-9_]*$"), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(x) -> Column:
    return F.concat(F.lit("'"), F.replace(_c(x), F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(x) -> Column:
    return F.coalesce(quote_literal(x), F.lit("NULL"))


def format(template: str, *args) -> Column:
    """%s, %I and %L, with an optional place as in %2$s; nulls are empty in %s."""
    parts, at, k = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            parts.append(F.lit("%"))
            continue
        i = int(m[1]) - 1 if m[1] else k
        k = i + 1
        value = _c(args[i]).cast("string")
        parts.append({"s": lambda v: F.coalesce(v, F.lit("")), "I": quote_ident, "L": quote_nullable}[m[2]](value))
    return F.concat(*parts, F.lit(template[at:]))


def _flagged(pattern: str, flags: str) -> str:
    own = "".join(f for f in flags if f in "imsx")
    return f"(?{own}){pattern}" if own else pattern


def regexp_like(x, pattern: str, flags: str = "") -> Column:
    return _c(x).rlike(_flagged(pattern, flags))


def regexp_count(x, pattern: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(substring(x, start) if start > 1 else _c(x), F.lit(_flagged(pattern, flags)))


def regexp_extract(x, pattern: str, group: int = 0) -> Column:
    """Null without a match."""
    c = _c(x)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def regexp_match(x, pattern: str, flags: str = "") -> Column:
    """The groups of the first match, or the whole match if there are none; null without a match."""
    p, c = _flagged(pattern, flags), _c(x)
    groups = re.compile(pattern).groups
    picked = [F.regexp_extract(c, p, g) for g in (range(1, groups + 1) if groups else (0,))]
    return F.when(c.rlike(p), F.array(*picked))


def regexp_replace(x, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match only, unless there is the flag g."""
    c, p, r = _c(x), _flagged(pattern, flags), re.sub(r"\\(\d)", r"$\1", replacement)
    if "g" in flags:
        return F.regexp_replace(c, p, r)
    groups = re.compile(pattern).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", r)
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{p})(.*)$" if not flags.strip("g") else f"(?s{flags})^(.*?)(?:{pattern})(.*)$", f"$1{shifted}${groups + 2}")


def regexp_split_to_array(x, pattern: str, flags: str = "") -> Column:
    return F.split(_c(x), _flagged(pattern, flags))


def regexp_substr(x, pattern: str, start: int = 1, n: int = 1) -> Column:
    """The n-th match, or null."""
    c = substring(x, start) if start > 1 else _c(x)
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(n - 1))


def regexp_instr(x, pattern: str) -> Column:
    return F.regexp_instr(_c(x), F.lit(pattern))


def split_part(x, delimiter: str, n: int) -> Column:
    return F.split_part(_c(x), F.lit(delimiter), F.lit(n))


def string_to_array(x, delimiter: str, null_string: str | None = None) -> Column:
    """Parts at a literal delimiter; an empty text has no parts."""
    c = _c(x)
    parts = F.split(c, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", delimiter))
    if null_string is not None:
        parts = F.transform(parts, lambda p: F.nullif(p, F.lit(null_string)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(parts)


def to_hex(x) -> Column:
    return F.lower(F.hex(_c(x)))


def to_bin(x) -> Column:
    return F.bin(_c(x))


def to_oct(x) -> Column:
    return F.conv(_c(x).cast("string"), 10, 8)


def trim(x, characters: str | None = None) -> Column:
    return F.btrim(_c(x), F.lit(characters)) if characters else F.trim(_c(x))


def ltrim(x, characters: str | None = None) -> Column:
    return F.ltrim(_c(x), F.lit(characters)) if characters else F.ltrim(_c(x))


def rtrim(x, characters: str | None = None) -> Column:
    return F.rtrim(_c(x), F.lit(characters)) if characters else F.rtrim(_c(x))


def chr_(x) -> Column:
    """The character of a code point."""
    return _CHR(_c(x).cast("int"))


def normalize(x, form: str = "NFC") -> Column:
    return _NORMAL[form.upper()](_c(x))


def to_ascii(x) -> Column:
    """Without combining marks, and without what is left beyond ASCII."""
    return _ASCII(_c(x))


def unistr(x) -> Column:
    return _UNISTR(_c(x))


def parse_ident(x) -> Column:
    return _IDENT(_c(x))


def _series(f, kind=T.StringType()):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _unistr(s: str) -> str:
    return re.sub(r"\\(?:\\|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))", lambda m: "\\" if m[0] == "\\\\" else chr(int(m[1] or m[2] or m[3] or m[4], 16)), s)


def _parse_ident(s: str) -> list[str]:
    parts = re.findall(r'\s*(?:"((?:[^"]|"")*)"|([^\W\d][\w$]*))\s*(?:\.|$)', s)
    return [a.replace('""', '"') if a else b.lower() for a, b in parts]


_NORMAL = {f: _series(lambda s, f=f: unicodedata.normalize(f, s)) for f in ("NFC", "NFD", "NFKC", "NFKD")}
_ASCII = _series(lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if ord(c) < 128))
_UNISTR = _series(_unistr)
_IDENT = _series(_parse_ident, T.ArrayType(T.StringType()))
_CHR = _series(lambda n: chr(int(n)))

# Words that a full-text query passes over.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()


def search_terms(x) -> Column:
    """Runs of letters and digits, lower-cased, of two characters or more, without stop words."""
    runs = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(runs, lambda t: (F.char_length(t) >= 2) & ~F.array_contains(stop, t))


def tsquery_match(text, query: str | Column) -> Column:
    """Every term of the query occurs in the text; a query without terms matches all.

    A text without the term's letters needs no splitting, which is what most texts are; the rest is compared by terms.
    """
    asked = F.lit(query) if isinstance(query, str) else query
    terms = search_terms(asked)
    low = F.lower(_c(text))
    may = F.forall(terms, lambda t: F.contains(low, t))
    if isinstance(query, str):
        known = [t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) >= 2 and t not in STOP_WORDS and all(c.isalpha() or c.isdecimal() for c in t)]
        may = F.lit(True)
        for t in known:
            may = may & F.contains(low, F.lit(t))
    return F.when(may, F.size(F.array_except(terms, search_terms(text))) == 0).otherwise(F.when(_c(text).isNotNull(), F.lit(False)))


def plainto_tsquery(x) -> Column:
    return _c(x)
