"""Text functions: Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import patterns as P


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def matches(text, pattern: str) -> Column:
    return F.regexp_like(F.col(text) if isinstance(text, str) else text, F.lit(pattern))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    """Lines with their terminators; their concatenation is the text."""
    return all_matches(text, P.LINE)


def mentions_failure(text: Column) -> Column:
    """Failure language, unless right after no, zero, without or not and one space."""
    return matches(text, P.FAILURE)


def mask_volatile(text: Column) -> Column:
    """Timestamps become <ts>; of hexadecimal runs those with a digit become <id>, others stay.

    The text is taken apart into runs and what lies between them, the runs are
    replaced where need be, and the parts are put together again.
    """
    stamped = F.regexp_replace(text, P.TIMESTAMP, "<ts>")
    runs = F.transform(all_matches(stamped, P.HEX_RUN), lambda run: F.when(run.rlike("[0-9]"), F.lit("<id>")).otherwise(run))
    between = F.split(stamped, P.HEX_RUN)
    pairs = F.zip_with(between, runs, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(F.size(runs) == 0, stamped).otherwise(F.array_join(pairs, ""))


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, P.NUMBER, "<n>")


def collapse_space(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, rf"(?U){P.SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{P.SPACE}+|{P.SPACE}+\z", "")


def normalize_volatile(text: Column) -> Column:
    return collapse_space(mask_numbers(mask_volatile(text)))


def normalize_apostrophes(text: Column) -> Column:
    return F.translate(text, "\u2018\u2019", "''")


# Characters that lower(upper(c)) folds otherwise than full case folding, by rule: final sigma, dotless i
# (through a private character, as upper case would lose it), and Cherokee, whose folded form is upper case.
_DOTLESS, _PRIVATE = "\u0131", "\ue131"
_FOLD_FROM = "\u03c2" + _PRIVATE + "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_FOLD_TO = "\u03c3" + _DOTLESS + "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))


def casefold(text: Column) -> Column:
    """Full case folding; ASCII texts are only lowered."""
    upper = F.replace(F.upper(F.translate(text, _DOTLESS, _PRIVATE)), F.lit("\u1e9e"), F.lit("SS"))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(upper), _FOLD_FROM, _FOLD_TO))


def canonical(text: Column) -> Column:
    """Case, apostrophes and white space folded, as facts are compared."""
    return casefold(collapse_space(normalize_apostrophes(text)))


_SPOT = "\x01"


def contains(text: Column, needle: Column) -> Column:
    """Whether needle occurs in text, not glued to word characters at an end that is one itself.

    Occurrences are marked by a plain replacement and their neighbours tested by
    fixed expressions. Only where that fails although the needle occurs, as
    occurrences may overlap, is an expression built for the needle.
    """
    starts, ends = needle.rlike(r"(?U)\A\w"), needle.rlike(r"(?U)\w\z")
    spots = F.replace(text, needle, F.lit(_SPOT))
    free = lambda before, after: F.regexp_like(spots, F.lit("(?dU)" + before + _SPOT + after))
    left, right = rf"(?<![\w{_SPOT}])", rf"(?![\w{_SPOT}])"
    marked = F.when(starts & ends, free(left, right)).when(starts, free(left, "")).when(ends, free("", right)).otherwise(F.lit(True))
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    own = F.concat(F.lit("(?dUs)"), F.when(starts, r"(?<!\w)").otherwise(""), quoted, F.when(ends, r"(?!\w)").otherwise(""))
    clean = ~F.contains(text, F.lit(_SPOT))
    return (needle == "") | (F.contains(text, needle) & ((clean & marked) | F.regexp_like(text, own)))


def is_stated(required: Column, text: Column) -> Column:
    """Whether canonical text contains every required string."""
    return F.forall(required, lambda r: contains(text, canonical(r)))


def identifiers(text: Column, expressions=P.IDENTIFIERS) -> Column:
    """Distinct matches, expression by expression, in order of appearance."""
    return F.array_distinct(F.concat(*[all_matches(text, p) for p in expressions]))



def severity(level: Column) -> Column:
    """Canonical severity of a level name, or null."""
    name = F.upper(strip(level))
    name = F.coalesce(F.element_at(literal_map(P.SEVERITY_ALIASES), name), name)
    return F.when(name.isin(*P.SEVERITY_RANKS), name)


def severity_rank(name: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(P.SEVERITY_RANKS), name), F.lit(0))


def terminator(line: Column) -> Column:
    """The carriage returns and line feeds a line ends with, or a line feed."""
    found = F.regexp_extract(line, r"[\r\n]*\z", 0)
    return F.when(found == "", "\n").otherwise(found)


def assertions(text: Column) -> Column:
    """array<struct<key,value>> of `key: value` and `key=value` claims in prose."""
    return F.arrays_zip(all_matches(text, P.ASSERTION, 1).alias("key"), all_matches(text, P.ASSERTION, 3).alias("value"))


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def quote_attribute(text: Column) -> Column:
    """XML attribute value with quotes chosen by content; line breaks and tabs as references."""
    safe = escape_xml(text)
    for raw, ref in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(raw), F.lit(ref))
    plain = F.concat(F.lit('"'), safe, F.lit('"'))
    single = F.concat(F.lit("'"), safe, F.lit("'"))
    both = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(~F.contains(safe, F.lit('"')), plain).when(~F.contains(safe, F.lit("'")), single).otherwise(both)
