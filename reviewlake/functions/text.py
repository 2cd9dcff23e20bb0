"""Line splitting and path parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# The separators that end a line of text, and those that end a line of
# bytes. CR LF is one separator.
TEXT_SEPARATORS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
BYTES_SEPARATORS = ("\n", "\r")

SEPARATORS = {"text": TEXT_SEPARATORS, "bytes": BYTES_SEPARATORS}


def line_feeds(text: Column, mode: str = "text") -> Column:
    """The text with every separator turned into a line feed.

    Plain byte searches decide whether there is anything to do: they cost a tenth of
    a regular expression, which then only runs on the rare text that needs it.
    """
    other = [mark for mark in SEPARATORS[mode] if mark != "\n"]
    odd = reduce(lambda a, b: a | b, [text.contains(mark) for mark in other])
    return F.when(odd, F.regexp_replace(text, "\r\n|[" + "".join(other) + "]", "\n")).otherwise(text)


def split_lines(text: Column, mode: str = "text") -> Column:
    """Array of lines without their separators; a final separator opens no new line."""
    pieces = F.split(line_feeds(text, mode), "\n", -1)
    return let(pieces, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def count_lines(text: Column, mode: str = "text") -> Column:
    """Number of lines, without building them."""
    def counted(plain: Column) -> Column:
        ended = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
        return (ended + F.when((plain != "") & ~plain.endswith("\n"), 1).otherwise(0)).cast("int")
    return let(line_feeds(text, mode), counted)


def path_parts(path: Column) -> Column:
    """Parts of a POSIX path; empty and ``.`` parts carry no meaning."""
    return F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))


def parent_parts(path: Column) -> Column:
    return let(path_parts(path), lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))


def file_name(path: Column) -> Column:
    """Last part of a path, or the empty string."""
    return F.coalesce(F.get(F.reverse(path_parts(path)), F.lit(0)), F.lit(""))


def suffix(name: Column) -> Column:
    """Last dot and what follows; a leading dot is not a suffix, nor is a trailing one."""
    return F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)\z", 1)


def escaped_length(text: Column) -> Column:
    """Length of the text inside a JSON string with non-ASCII characters escaped.

    Two characters for a quote, a backslash and the five short escapes, six for other
    control characters and for the Basic Multilingual Plane, twelve beyond it.
    """
    size = F.length(text)
    short = F.regexp_count(text, F.lit(r'["\\\x08\x0C\n\r\t]'))
    control = F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    plane = F.regexp_count(text, F.lit(r"[\x{80}-\x{FFFF}]"))
    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return (size + short + 5 * control + 5 * plane + 11 * astral).cast("int")
