"""Scalar text functions (Column -> Column), all JVM-side built-ins.

Python's ``str.strip``/``split`` treat every Unicode whitespace as blank;
Spark's ``trim`` only strips spaces, so stripping is a Unicode-aware regex.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfarer.schemas import NULL_LIKE, NULL_LIKE_AGENT, PLACEHOLDER_PHRASES

# Unicode whitespace plus the ASCII separators Python also counts as space.
_WS = r"[\s\x1c-\x1f]"
_RUNS_RE = rf"(?U){_WS}+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Every code point Python's str.isspace() accepts (the set str.strip() removes),
# built by rule rather than listed.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(x) -> Column:
    """H1: Python ``str.strip()`` (all Unicode whitespace), as a set-based trim
    (linear, codegen-friendly) rather than a regex."""
    return F.trim(_c(x), F.lit(PY_WHITESPACE))


def collapse_ws(x) -> Column:
    """H2: every whitespace run becomes one space."""
    return F.regexp_replace(_c(x), _RUNS_RE, " ")


def capitalize(x) -> Column:
    """H1: Python ``str.capitalize`` (first upper, rest lower), not ``initcap``."""
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def word_count(x) -> Column:
    """``len(text.split())``."""
    s = strip(x)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, _RUNS_RE)))


def clean_text(x) -> Column:
    """NULL -> ''; strip; nan/none/null (any case) -> ''."""
    s = strip(x)
    return F.when(_c(x).isNull() | F.lower(s).isin(*NULL_LIKE), F.lit("")).otherwise(s)


def clean_text_agent(x) -> Column:
    """C4: like C3, also 'n/a', and whitespace runs collapse to one space."""
    s = strip(x)
    return F.when(_c(x).isNull() | F.lower(s).isin(*NULL_LIKE_AGENT), F.lit("")).otherwise(collapse_ws(s))


def contains_placeholder(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.instr(lowered, p) > 0 for p in PLACEHOLDER_PHRASES])


def is_placeholder(x) -> Column:
    """After strip+lower, empty or containing a filler phrase.

    A NULL input is not a placeholder here (the source rendered it as the
    text 'nan'); callers clean first (C6) so NULL never reaches this.
    """
    s = F.lower(strip(x))
    return F.coalesce((s == "") | contains_placeholder(s), F.lit(False))


def is_placeholder_agent(x) -> Column:
    """C1 applied after the agent cleaner C4 (so 'n/a' and line breaks count)."""
    s = F.lower(clean_text_agent(x))
    return (s == "") | contains_placeholder(s)


def nullif_blank(x) -> Column:
    """NULL when NULL or blank after strip, else the stripped text."""
    s = strip(x)
    return F.when(s == "", F.lit(None)).otherwise(s)


def split_blank_line(x) -> Column:
    """H5: split on a blank line."""
    return F.split(_c(x), "\n\n", -1)


def join_blank_line(arr) -> Column:
    return F.array_join(_c(arr), "\n\n")


def safe_name(x) -> Column:
    """File-name safe: space -> underscore."""
    return F.replace(_c(x), F.lit(" "), F.lit("_"))


def bullet_list(arr) -> Column:
    """``"- a\\n- b"``."""
    return F.array_join(F.transform(_c(arr), lambda d: F.concat(F.lit("- "), d)), "\n")


def latin1_clean(x) -> Column:
    """H8: typographic quotes/dashes/degree to ASCII, drop code points > 255, strip."""
    c = _c(x)
    # --- fixed values: replacement table for the Latin-1 export ---
    for src, dst in [
        ("\u2019", "'"),
        ("\u2018", "'"),
        ("\u201c", '"'),
        ("\u201d", '"'),
        ("\u2013", "-"),
        ("\u2014", "-"),
        ("\xb0", " deg "),
    ]:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return strip(F.regexp_replace(c, "[^\\x{0000}-\\x{00FF}]", ""))


def xml_escape(x) -> Column:
    """H9: escape &, <, > (the source's escape was a no-op; we escape for real)."""
    c = F.replace(_c(x), F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))
