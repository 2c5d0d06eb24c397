"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space besides Unicode White_Space: the information separators.
SEPARATORS = "\x1c-\x1f"
SPACE = rf"[\s{SEPARATORS}]"
NON_SPACE = rf"[^\s{SEPARATORS}]"
#: Unicode White_Space and these separators, one by one.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
HYPHEN_MARK, COMMA_MARK = " @-@ ", " @,@ "


def tokens(text: Column) -> Column:
    """White-space tokens of ``text``; an empty array for null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U){NON_SPACE}+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))  # looks at the ends only, where a pattern would try every run of blanks


def unmark(text: Column) -> Column:
    """Joins the hyphen and comma marks of tokenised wiki text; the decimal mark stays."""
    return F.replace(F.replace(text, F.lit(HYPHEN_MARK), F.lit("-")), F.lit(COMMA_MARK), F.lit(","))


def clean(text: Column) -> Column:
    """Joins marks, then collapses white space to single blanks and strips it."""
    return F.trim(F.regexp_replace(unmark(text), rf"(?U){SPACE}+", " "))


def lines(text: Column) -> Column:
    """Lines of ``text`` with any Unicode line end."""
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def sentences(line: Column) -> Column:
    """Pieces of ``line`` after ``.``, ``!`` or ``?`` and white space."""
    return F.split(line, rf"(?U)(?<=[.!?]){SPACE}+")


def heading(line: Column) -> Column:
    """``struct(level, name)`` of a spaced heading such as ``= = Name = =``, else null.

    The line must begin and end with the same number of ``=`` tokens and have
    something between them; a line of ``=`` tokens only is text.
    """
    words = tokens(line)
    other = lambda a: F.array_position(F.transform(a, lambda w: w != F.lit("=")), True) - 1
    lead, trail = other(words), other(F.reverse(words))
    is_heading = F.ltrim(line).startswith("=") | line.rlike(rf"(?U)^{SPACE}*=")
    name = F.array_join(F.slice(words, lead.cast("int") + 1, F.greatest((F.size(words) - lead - trail).cast("int"), F.lit(0))), " ")
    return F.when(is_heading, F.when((lead > 0) & (lead == trail), F.struct(lead.cast("int").alias("level"), name.alias("name"))))


def relation_type(name: Column) -> Column:
    """Edge type of a relation name: blanks, hyphens and slashes become ``_``, apostrophes go, upper case."""
    return F.upper(F.translate(name, " -/'", "___"))


def file_name(title: Column) -> Column:
    """File name of an article title."""
    return F.concat(F.translate(title, " /", "__"), F.lit(".json"))


def fold(text: Column) -> Column:
    """Lower case, letters and digits only.

    A single mark that is not blank and stands directly between two of 0-9 stays
    (``3.84``, ``17-118``). Null stays null; text of marks only becomes empty.
    """
    drop = r"(?U)(?<![0-9])[^\p{L}\p{N}]|[^\p{L}\p{N}](?![0-9])|\s"
    return F.regexp_replace(F.lower(text), drop, "")
