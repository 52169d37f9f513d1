"""Text cleaning as built-in column expressions (patterns take ``\\n`` alone as line end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of notes and mails.
DATAVIEW = r"(?s)```dataview\s*\n.*?\n```"
EMBED = r"!\[\[([^\]]+)\]\]"
LINK = r"\[\[([^\]]+)\]\]"
FENCED, INLINE_CODE, HEADING_MARK = r"(?s)```.*?```", r"`[^`]+`", r"(?dm)^#{1,6}\s+"
INLINE_TAG = r"(?:^|\s)#([A-Za-z0-9_][A-Za-z0-9_/\-]*)"
QUOTED_LINE, WROTE = r"(?dm)^>.*$", r"(?dim)^On\s+.{10,80}\s+wrote:\s*$"
DASHES, SENT_FROM, OUTLOOK = r"(?dm)^-- $", r"(?dim)^Sent from my (?:iPhone|iPad|Android|Galaxy).*$", r"(?dim)^Get Outlook for .*$"
FRONTMATTER = r"(?s)\A---\s*\n(.*?\n)---\s*\n?"
SPACE = r"(?U)^\s+|\s+$"


def trim(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, SPACE, "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse_newlines(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_dataview(text: Column) -> Column:
    return F.regexp_replace(text, DATAVIEW, "")


def strip_embeds(text: Column) -> Column:
    return F.regexp_replace(text, EMBED, "")


def convert_wikilinks(text: Column) -> Column:
    """``[[target|shown]]`` to ``shown (target)``, ``[[target]]`` to ``target``."""
    shown = F.regexp_replace(text, r"\[\[\s*([^\]|]+?)\s*\|\s*([^\]]+?)\s*\]\]", "$2 ($1)")
    return F.regexp_replace(shown, r"\[\[\s*([^\]]+?)\s*\]\]", "$1")


def link_targets(text: Column) -> Column:
    """Targets in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(F.substring_index(x, "|", 1)))


def inline_tags(text: Column) -> Column:
    """Tags outside code and headings, first seen first."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, FENCED, ""), INLINE_CODE, ""), HEADING_MARK, "")
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(INLINE_TAG), F.lit(1)))


def strip_quoted_replies(text: Column) -> Column:
    cut = F.regexp_replace(text, WROTE + r"(?s:.*)", "")
    return collapse_newlines(F.regexp_replace(cut, QUOTED_LINE, ""))


def strip_signature(text: Column) -> Column:
    out = text
    for pattern in (DASHES, SENT_FROM, OUTLOOK):
        out = F.regexp_replace(out, pattern + r"(?s:.*)", "")
    return trim(out)


def display_address(name: Column, address: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", address).when(F.coalesce(address, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" <"), address, F.lit(">")))


def fallback_message_id(sender: Column, subject: Column, date: Column) -> Column:
    """32 hex digits of a digest of sender, subject and date."""
    blank = [F.coalesce(c, F.lit("")) for c in (sender, subject, date)]
    return F.substring(F.sha2(F.concat_ws("|", *blank), 256), 1, 32)


def html_to_text_basic(html: Column) -> Column:
    """Tags to line ends, scripts and styles dropped, the common entities decoded. The exact parser is
    ``parsers.html_to_text``."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)", 1)


def merge_unique(a: Column, b: Column) -> Column:
    """Both lists in order, each value once."""
    return F.array_distinct(F.concat(a, b))


def truncate(text: Column, size: int) -> Column:
    """At most the first ``size`` bytes of the UTF-8 text, without a character that would be cut; null stays null."""
    cut = F.substring(text.cast("binary"), 1, int(size))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\uFFFD+$", ""))
