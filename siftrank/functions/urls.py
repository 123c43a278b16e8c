"""URL rules as ``Column -> Column`` builders."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and prefix that decide which URLs come out.
DIRECTORY_OR_INDEX_PAGE = r"/$|/index\.[a-z][a-z][a-z][a-z]?$"
SCHEME = r"^[a-z]+://"
HREF_WHITESPACE = r"[ \n\r\t]"
AFTER_HOST = r"/.*$"
LAST_SEGMENT = r"/[^/]+$"
PARENT_STEP_OR_DOUBLE_SLASH = r"/.[^/]+/\.\./|//"
LINK_SCHEME = "http://"


def page_url(url: Column) -> Column:
    """URL under which a page collects its links: no final slash or index page."""
    return F.regexp_replace(url, DIRECTORY_OR_INDEX_PAGE, "")


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, SCHEME, "")


def absolute_url(base: Column, href: Column) -> Column:
    """Target of a link found on the page ``base`` (see :func:`page_url`).

    Three kinds of link: from the host's root, with a scheme of its own, and
    relative to the page's directory. One pass then resolves ``/xx/../`` and
    double slashes. Every target gets the same scheme, whatever the link had.
    """
    host_and_path = without_scheme(base)
    link = F.regexp_replace(href, HREF_WHITESPACE, "")
    joined = (
        F.when(
            link.startswith("/"),
            F.concat(F.regexp_replace(host_and_path, AFTER_HOST, ""), link),
        )
        .when(link.rlike(SCHEME), without_scheme(link))
        .otherwise(
            F.concat(F.regexp_replace(host_and_path, LAST_SEGMENT, ""), F.lit("/"), link)
        )
    )
    resolved = F.regexp_replace(joined, PARENT_STEP_OR_DOUBLE_SLASH, "/")
    return F.concat(F.lit(LINK_SCHEME), page_url(resolved))


def one_scheme(url: Column) -> Column:
    """Page URL with the scheme that link targets carry.

    Not part of the default rules, under which pages reached by another scheme
    keep it and so meet no link.
    """
    return F.concat(F.lit(LINK_SCHEME), without_scheme(url))
