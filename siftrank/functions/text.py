"""Text rules as ``Column -> Column`` builders.

All of them are built-in Spark functions, so they stay inside one projection
next to the scan.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which text and which terms come out.
INDEX_PAGE = r"(?i)/index\.[a-z]{3,4}$"
PROTOCOL_HEADER = r"(?s)\A.*?<"
SCRIPT = r"(?is)<script(.*?)</script>"
TAG = r"<[^>]+>"
WHITESPACE = r"[ \n\r\t]+"
TAG_OR_WHITESPACE = r"<[^>]+>|[ \n\t\r]+"
DOCUMENT_TERM = r"[0-9a-z]+"
NO_TERM = r"[^0-9a-z]+"
QUERY_DELIMITER = r"[^0-9A-Za-z]+"


def decode_utf8(content: Column) -> Column:
    """Bytes to text, bad sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def strip_index_page(url: Column) -> Column:
    """``…/index.html`` to ``…/`` (any case)."""
    return F.regexp_replace(url, INDEX_PAGE, "/")


def strip_protocol_header(content: Column) -> Column:
    """Drop all that precedes the first ``<``; unchanged when there is none.

    ``\\A`` ties the match to the start of the text: ``regexp_replace`` replaces
    every match, and a line anchor would also hit later lines.
    """
    return F.regexp_replace(content, PROTOCOL_HEADER, "<")


def strip_scripts(html: Column) -> Column:
    """Closed script elements to one space; an unclosed one survives."""
    return F.regexp_replace(html, SCRIPT, " ")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def html_to_text(content: Column) -> Column:
    """Protocol header, scripts, tags and runs of white space, in that order."""
    return collapse_whitespace(strip_tags(strip_scripts(strip_protocol_header(content))))


def clean_anchor_text(text: Column) -> Column:
    """Each tag and each run of white space becomes one space of its own."""
    return F.regexp_replace(text, TAG_OR_WHITESPACE, " ")


def document_terms(text: Column) -> Column:
    """All maximal runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(DOCUMENT_TERM), F.lit(0))


def query_terms(text: Column) -> Column:
    """Terms of a query, by position.

    Differs from :func:`document_terms` in one respect: a leading delimiter
    leaves an empty first term (which no document holds). Text of delimiters
    only has no terms.
    """
    parts = F.split(F.lower(text), QUERY_DELIMITER)
    any_term = F.exists(parts, lambda t: t != "")
    kept = F.filter(parts, lambda t, i: (t != "") | ((i == 0) & any_term))
    return F.when(text == "", F.array(F.lit(""))).otherwise(kept)
