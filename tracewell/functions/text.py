"""Column functions on names, HTML and plain text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import rules


def glob_to_like(glob: str) -> str:
    """``*`` and ``?`` name pattern as an escaped SQL LIKE pattern."""
    escaped = re.sub(r"([\\%_])", r"\\\1", glob)
    return escaped.replace("*", "%").replace("?", "_")


def glob_matches(name: Column, pattern: Column) -> Column:
    """Does ``name`` match the glob held in another column?"""
    quoted = F.regexp_replace(pattern, r"([\\^$.|+()\[\]{}])", r"\\$1")
    regex = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    # \z, since $ also stands in front of a last line end
    return F.rlike(name, F.concat(F.lit("(?s)^"), regex, F.lit(r"\z")))


def glob_pieces(pattern: Column) -> Column:
    """The literal texts between the wildcards; a match must contain them all."""
    return F.split(pattern, r"[*?]+")


def strip_whitespace(text: Column) -> Column:
    """Cut Unicode whitespace off both ends."""
    return F.btrim(text, F.lit(rules.WHITESPACE_CHARS))


def strip_html(html: Column) -> Column:
    """Visible text: style and script blocks cut, tags to blanks, blanks joined."""
    text = F.regexp_replace(html, r"(?s)<style[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, rules.WHITESPACE_RUN, " "))


def extract_title(html: Column, default: str = rules.DEFAULT_TITLE) -> Column:
    """First one-line ``<title>``; an empty one stays empty, a missing one is the default."""
    # UNIX_LINES: only \n ends a line.
    pattern = r"(?id)<title>(.*?)</title>"
    return F.when(
        F.rlike(html, F.lit(pattern)), strip_whitespace(F.regexp_extract(html, pattern, 1))
    ).otherwise(F.lit(default))


def split_chunks(
    text: Column, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP
) -> Column:
    """Array of overlapping pieces, in order, short ones included.

    One regex sweep: each match takes ``size - overlap`` characters and a
    look-ahead captures up to ``size``. The sweep is linear in the text, where
    one ``substring`` per piece would rescan the text from its start each time.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")
    sweep = f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    return F.regexp_extract_all(text, F.lit(sweep), F.lit(1))


def is_long_chunk(chunk: Column, min_chars: int = rules.MIN_CHUNK_CHARS) -> Column:
    """More than ``min_chars`` characters once the ends are stripped."""
    return F.length(strip_whitespace(chunk)) > min_chars
