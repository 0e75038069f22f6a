"""HTML evidence column expressions: a linear tokeniser of regexes, no parser.

A token regex consumes a page from left to right, one construct a match: comments, script and style elements
with their raw text, start tags of any name with quoted values, CDATA sections, declarations and end tags.
What one construct holds is never seen as another (a tag in an attribute value, a comment mark in a script).
Repetitions are possessive, so no match recurses or backtracks whatever the length of a tag.

Rules for markup that is not well formed (those of the tolerant standard parser): a quote opens a value only
after ``=``; an unquoted value ends at white space or ``>`` and may hold quotes; a tag with an unclosed quote,
and a comment without an end, are text up to the next ``>``; an unclosed script or style takes the rest of
the page, and its text is dropped; a self-closed script has no text; the last of equal attributes counts;
an attribute without a value has the empty one.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+)"""
_GIVEN = rf"(?:\s*=+\s*{_VALUE})?+"
_NAME = r"""(?<=['"\s/])[^\s/>][^\s/=>]*+"""
_ATTRS = rf"(?:\s++|/(?!>)|{_NAME}{_GIVEN})*+"


def _open(tag: str) -> str:
    return rf"<{tag}(?=[\s/>]){_ATTRS}"


def _raw(tag: str) -> str:
    """An element of raw text, closed or up to the end of the page."""
    return rf"{_open(tag)}>(?:.*?</\s*+{tag}\s*+>|.*+)"


_COMMENT = r"<!--.*?--\s*+>|<!(?!--|\[|doctype)[^>]*+>"
_OTHER = "|".join([r"<!--[^>]*+>?+", "{script}", _raw("style"), rf"<[a-z][^\s/>]*+{_ATTRS}(?:/?+>|\z)", r"<[a-z][^>]*+>",
                   r"<!\[CDATA\[.*?\]\s*+\]\s*+>", r"<[!?/][^>]*+>"])
# Group 1 is what is wanted; every other token gives an empty string.
COMMENT_RX = f"(?is)({_COMMENT})|" + _OTHER.replace("{script}", _raw("script"))
SCRIPT_RX = f"(?is){_COMMENT}|" + _OTHER.replace("{script}", f"({_raw('script')})")


def tag_rx(tags) -> str:
    wanted = _open("(?:" + "|".join(tags) + ")")
    return f"(?is)(?=({wanted}/?+>)?+)(?:{_COMMENT}|" + _OTHER.replace("{script}", _raw("script")) + ")"


def _wanted(page, rx: str) -> Column:
    found = F.regexp_extract_all(F.col(page) if isinstance(page, str) else page, F.lit(rx), F.lit(1))
    return F.filter(found, lambda t: t != "")


def start_tags(page, tags) -> Column:
    """Array of the start tags named in ``tags`` (whole, with their brackets), in document order."""
    return _wanted(page, tag_rx(tags))


def comments(page) -> Column:
    """Array of the texts of the page's comments."""
    return F.transform(_wanted(page, COMMENT_RX), lambda c: F.when(
        c.startswith("<!--"), F.regexp_replace(F.substring(c, 5, 1 << 30), r"--\s*+>\z", "")).otherwise(c.substr(F.lit(3), F.length(c) - 3)))


def scripts(page) -> Column:
    """Array of (tag, body) of the page's script elements; the body of an unclosed one is empty."""
    tag = lambda s: F.regexp_extract(s, "(?is)^" + _open("script") + ">", 0)
    closed = lambda s: s.rlike(r"(?i)</\s*+script\s*+>\z")
    return F.transform(_wanted(page, SCRIPT_RX), lambda s: F.struct(tag(s).alias("tag"), F.when(closed(s), F.regexp_replace(
        s.substr(F.length(tag(s)) + 1, F.length(s)), r"(?i)</\s*+script\s*+>\z", "")).otherwise(F.lit("")).alias("body")))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^<([A-Za-z]+)", 1))


# --- attributes ----------------------------------------------------------------
def _attr_rx(name: str) -> str:
    """Group 1: an attribute called ``name``; other attributes are consumed whole, values included."""
    return rf"""(?is)(?<=['"\s/])(?:({name}(?=[\s/=>]|\z){_GIVEN})|[^\s/>][^\s/=>]*+{_GIVEN})"""


def attr_raw(tag: Column, name: str) -> Column:
    """The last attribute ``name`` of a start tag as written (``name=value``); NULL if absent."""
    return F.try_element_at(F.filter(F.regexp_extract_all(tag, F.lit(_attr_rx(name)), F.lit(1)), lambda a: a != ""), F.lit(-1))


def _unquoted(value: Column) -> Column:
    quoted = F.substring(value, 1, 1).isin('"', "'") & (F.length(value) > 1)
    return F.when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def clean_attr(raw: Column, name: str) -> Column:
    """The value of a raw attribute, unquoted and decoded."""
    return unescape(_unquoted(F.regexp_replace(F.substring(raw, len(name) + 1, 1 << 30), r"\A\s*+=*+\s*+", "")))


def attr(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` (last duplicate wins), unquoted and decoded; NULL if absent."""
    return clean_attr(attr_raw(tag, name), name)


def has_attr(tag: Column, name: str) -> Column:
    return attr_raw(tag, name).isNotNull()


_PAIR_RX = rf"""(?is)({_NAME})(?:\s*=+\s*({_VALUE}))?+"""


def attributes(tag: Column) -> Column:
    """Array of (name, value) of a start tag, in order, names lower-cased, values unquoted but not decoded."""
    part = lambda group: F.regexp_extract_all(tag, F.lit(_PAIR_RX), F.lit(group))
    return F.transform(F.arrays_zip(part(1).alias("name"), part(2).alias("value")), lambda a: F.struct(
        F.lower(a["name"]).alias("name"), _unquoted(a["value"]).alias("value")))


# --- character references ----------------------------------------------------------
#: Named references: the standard table, with the names that need no semicolon.
NAMED = html.entities.html5
_BARE = sorted((n for n in NAMED if not n.endswith(";")), key=len, reverse=True)
#: Code points that a numeric reference means instead of its number (fixed values: Windows-1252 from 0x80 on).
_CP1252 = {0x80 + i: c if c != "\ufffd" else chr(0x80 + i) for i, c in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace"))}


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")  # one literal, folded at planning


def _code_point(n: Column) -> Column:
    """The character a numeric reference stands for; invalid numbers give U+FFFD, forbidden ones nothing."""
    special = _table({str(k): v for k, v in _CP1252.items()})[n.cast("string")]
    control = ((n >= 1) & (n <= 8)) | ((n >= 0xE) & (n <= 0x1F)) | ((n >= 0x7F) & (n <= 0x9F)) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n == 0xB) | ((n % 0x10000) >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(special.isNotNull(), special)
            .when((n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF), F.lit("�"))
            .when(control, F.lit("")).otherwise(char))


def _decoded(piece: Column) -> Column:
    """A piece of text that followed an ampersand: its reference decoded, or the ampersand put back."""
    number = F.regexp_extract(piece, r"\A#(?:[xX]([0-9a-fA-F]++)|[0-9]++);?+", 0)
    hexadecimal = F.regexp_extract(piece, r"\A#[xX]0*+([0-9a-fA-F]++)", 1)
    decimal = F.regexp_extract(piece, r"\A#0*+([0-9]++)", 1)
    # ten digits are beyond every code point
    n = F.when(hexadecimal != "", F.conv(F.substring(hexadecimal, 1, 10), 16, 10)).otherwise(F.substring(decimal, 1, 10))
    n = F.coalesce(n.try_cast("long"), F.lit(0).cast("long"))
    table, bare = _table({k: v for k, v in NAMED.items() if k.endswith(";")}), _table({k: NAMED[k] for k in _BARE})
    full = F.regexp_extract(piece, r"\A[A-Za-z][A-Za-z0-9]{1,31};", 0)
    short = F.regexp_extract(piece, r"\A(?:" + "|".join(_BARE) + ")", 0)
    rest = lambda m: piece.substr(F.length(m) + 1, F.length(piece))
    return (F.when(number != "", F.concat(_code_point(n), rest(number)))
            .when(table[full].isNotNull(), F.concat(table[full], rest(full)))
            .when(short != "", F.concat(bare[short], rest(short)))
            .otherwise(F.concat(F.lit("&"), piece)))


def unescape(v: Column) -> Column:
    """Every character reference decoded, named (the longest that fits) and numeric."""
    parts = F.split(v, "&")
    decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _decoded), ""))
    return F.when(F.contains(v, F.lit("&")), decoded).otherwise(v)
