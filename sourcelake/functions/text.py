"""Text rendering: token counts, quoting, XML escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_tokens(text: Column) -> Column:
    """Four characters to a token, rounded up."""
    return tokens_of_length(F.length(text))


def tokens_of_length(chars: Column) -> Column:
    """Integer form of ``ceil(chars / 4)``."""
    return F.floor((chars.cast("bigint") + 3) / 4).cast("bigint")


def newlines(text: Column) -> Column:
    """Universal newlines: CRLF and lone CR become LF."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def xml_text(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def xml_attr(text: Column) -> Column:
    out = F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))
    for char, entity in (("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def quoted(text: Column) -> Column:
    """A string literal as Python prints it: single quotes unless the text has
    single quotes and no double ones."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    has_single = F.contains(text, F.lit("'"))
    has_double = F.contains(text, F.lit('"'))
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def quoted_list(items: Column) -> Column:
    """An array of strings as Python prints a list; NULL prints as ``[]``."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(items, quoted), ", "), F.lit("")), F.lit("]"))
