"""Scalar functions on entries, identifiers and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where identifiers are split, and what a word of prose is.
CAMEL = "((?<!(^|[A-Z]))(?=[A-Z])|(?<!^)(?=[A-Z][a-z]))|_"
LETTER = r"[@+\p{javaLetterOrDigit}]"
JOINER = r"[-.:/'\u2019\p{M}\u2032\u00A0\u200C\u200D~]"
WORD = f"{LETTER}+({JOINER}+{LETTER}+)*"
#: Names that say nothing of what a source is about.
FAILURES = ("Throwable", "Error")


def cleaned(text: Column) -> Column:
    """text without line feeds, carriage returns and tabs."""
    return F.translate(text, "\n\r\t", "")


def trimmed(text: Column) -> Column:
    """text without the control characters and spaces at its ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def without_trailing_blanks(parts: Column) -> Column:
    last = F.array_max(F.transform(parts, lambda x, k: F.when(x != "", k + 1).otherwise(0)))
    return F.slice(parts, 1, last)


def entry_signature(entry: Column) -> Column:
    """Parts of path::method::type; the cleaned entry alone if it has no :: after its first character."""
    clean = cleaned(trimmed(entry))
    return F.when(F.instr(clean, "::") > 1, without_trailing_blanks(F.split(entry, "::", -1))).otherwise(F.array(clean))


def is_single(parts: Column) -> Column:
    return F.coalesce(F.size(parts) == 1, F.lit(False))


def replaced(text: Column, old: str, new: str, most: int = -1) -> Column:
    """Replaces old from left to right, `most` times at most if that is not negative; what is put in is not searched."""
    if most < 0:
        return F.replace(text, F.lit(old), F.lit(new))
    return F.array_join(F.split(text, "\\Q" + old + "\\E", most + 1), new)


def method_signature(signature: Column) -> Column:
    """Name, then type and name of each parameter; of a cast receiver, its type and what follows. Null without a closing bracket."""
    opened = F.instr(signature, "(") > 1
    inside = F.regexp_extract(signature, r"(?s)^[^(]+\((.*)\)", 1)

    def parts(parameter: Column) -> Column:
        found = F.split(replaced(cleaned(trimmed(parameter)), "  ", " "), " ", -1)
        first = F.element_at(found, 1)
        kind = F.regexp_extract(first, r"\(([^)]+)\)", 1)
        cast = F.when(kind != "", F.array(kind, F.regexp_extract(first, r"(?s)^.*\)(.*)$", 1))).otherwise(F.array().cast("array<string>"))
        return F.when(F.contains(first, F.lit("(")), cast).otherwise(found)

    full = F.concat(F.array(F.substring_index(signature, "(", 1)), F.flatten(F.transform(F.split(inside, ",", -1), parts)))
    return F.when(~opened, F.array(signature)).when(F.instr(signature, ")") > 0, full)


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def unix_lines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n", "\n")


def is_identifier_of_interest(name: Column) -> Column:
    """Longer than two, and not an exception's name."""
    return (F.length(name) > 2) & ~(F.endswith(name, F.lit("Exception")) | name.isin(*FAILURES))


def identifier_parts(name: Column) -> Column:
    """Pieces of a camel-case or underscored name, without blank ones."""
    return F.filter(F.split(name, CAMEL), lambda x: (x != "") & (x != " "))


def words(text: Column) -> Column:
    """Words of prose in lower case, in order; none of a null text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def only_consonants(word: Column) -> Column:
    """Not empty and without a lower-case vowel."""
    return F.rlike(word, F.lit("^[^aeiou]+$"))


def is_number(word: Column) -> Column:
    return F.rlike(word, F.lit("^[0-9]+$"))
