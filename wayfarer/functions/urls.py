"""URL helpers mirroring Python's ``urllib.parse`` on well-formed URLs (H6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_scheme(x) -> Column:
    """Scheme, lower-cased ('' when absent)."""
    return F.lower(F.regexp_extract(_c(x), _URL_RE, 1))


def url_netloc(x) -> Column:
    """Authority (``netloc``): between '//' and the next '/', '?' or '#'."""
    return F.regexp_extract(_c(x), _URL_RE, 2)


def url_path_segment(x, i: int) -> Column:
    """The i-th (1-based) path segment of an absolute URL ('' when absent)."""
    path = F.regexp_extract(_c(x), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(F.element_at(F.split(path, "/"), i + 1), F.lit(""))


def absolutize(link, page_url) -> Column:
    """Root-relative links ('/x') become scheme://netloc/x of the page."""
    link, page_url = _c(link), _c(page_url)
    return F.when(
        link.startswith("/"), F.concat(url_scheme(page_url), F.lit("://"), url_netloc(page_url), link)
    ).otherwise(link)


def html_unescape_basic(x) -> Column:
    """Decode the five XML entities (ampersand last)."""
    c = _c(x)
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
