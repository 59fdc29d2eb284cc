"""Scalar text functions as JVM-side column expressions (no Python UDFs).

Every regular expression that scans user text uses possessive or bounded
constructs so that a single 100 kB line cannot overflow the Java regex stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reposcope.functions import patterns as P

# Whitespace as Python's str.strip() sees it for ASCII input.
WS = r"[ \t\n\x0B\f\r]"
# Default regex tokenizer: runs of letters/digits, or runs of other
# non-space characters (``Tokenizer`` takes any other expression).
TOKEN = r"[\p{L}\p{N}]++|[^\p{L}\p{N} \t\n\x0B\f\r]++"
TOKEN_RE2 = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]+"
# A token together with the whitespace before it; concatenating the first n
# pieces gives the exact text prefix that ends with the n-th token.
PIECE = WS + r"*+(?:" + TOKEN + ")"
PIECE_RE2 = WS + r"*(?:" + TOKEN_RE2 + ")"
# Word tokens for reference truncation (letters/digits/apostrophes, or one
# punctuation character).
WORD = r"[\p{L}\p{N}_']++|[^\p{L}\p{N}_' \t\n\x0B\f\r]"
WORD_RE2 = r"[\p{L}\p{N}_']+|[^\p{L}\p{N}_' \t\n\x0B\f\r]"
WORD_PIECE = WS + r"*+(?:" + WORD + ")"
WORD_PIECE_RE2 = WS + r"*(?:" + WORD_RE2 + ")"
# Header block: leading run of blank lines and lines starting with '#'.
HEADER = r"^(?:(?:[ \t\x0B\f\r]*+|#[^\n]*+)(?:\n|$))++"
HEADER_RE2 = r"^(?:(?:[ \t\x0B\f\r]*|#[^\n]*)(?:\n|$))+"
# 13a punctuation class: { to ~, [ to `, space to &, ( to +, : to @, and /
BLEU_PUNCT = r"([{-~\[-`\x20-&(-+:-@/])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_match(c, words: list[str]) -> Column:
    """Whole-word any-of matcher."""
    return col(c).rlike(P.word_matcher(words))


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(col(c), r"^" + WS + r"++|" + WS + r"++$", "")


def rstrip_ws(c) -> Column:
    """Right-trim (``rtrim`` only removes spaces)."""
    return F.regexp_replace(col(c), WS + r"++$", "")


def collapse_newlines(c) -> Column:
    """CR -> LF, runs of >= 2 LF -> exactly 2."""
    return F.regexp_replace(F.translate(col(c), "\r", "\n"), r"\n\n++", "\n\n")


def strip_header(c) -> Column:
    """Drop the leading blank/'#' line block iff it mentions a license or
    copyright word (lower-cased, whole word)."""
    x = col(c)
    head = F.regexp_extract(x, HEADER, 0)
    drop = (F.length(head) > 0) & F.lower(head).rlike(P.word_matcher(P.HEADER_WORDS))
    # the header block includes its line terminators, so the remainder starts
    # right after it (same as joining the remaining lines)
    return F.when(drop, F.substring(x, F.length(head) + 1, 1 << 30)).otherwise(x)


def strip_imports(c) -> Column:
    """T4: remove every import statement."""
    return F.regexp_replace(col(c), P.IMPORT_JAVA, "")


def cleanse_file(c) -> Column:
    """Newlines -> header -> imports -> newlines -> strip."""
    x = collapse_newlines(c)
    x = strip_header(x)
    x = strip_imports(x)
    x = F.regexp_replace(x, r"\n\n++", "\n\n")
    return strip_ws(x)


@dataclass(frozen=True)
class Tokenizer:
    """What a token is, as an expression that matches one; white space separates tokens and is
    no part of them. Possessive or bounded constructs keep long texts safe."""

    token: str = TOKEN

    def count(self, c) -> Column:
        return F.size(F.regexp_extract_all(col(c), F.lit(self.token), 0))

    def pieces(self, c) -> Column:
        """Tokens with the white space before them; the first n make the exact prefix of n tokens."""
        return F.regexp_extract_all(col(c), F.lit(f"{WS}*+(?:{self.token})"), 0)


DEFAULT_TOKENIZER = Tokenizer()


def token_count(c, tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> Column:
    """Number of tokens."""
    return tokenizer.count(c)


def truncate_tokens(c, n, tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> Column:
    """Text prefix holding the first ``n`` tokens; unchanged when it fits."""
    x = col(c)
    pieces = tokenizer.pieces(x)
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(pieces) <= n, x).otherwise(
        F.array_join(F.slice(pieces, 1, F.greatest(n, F.lit(0))), ""))


def truncate_words(c, n: int) -> Column:
    """First ``n`` word tokens; 0 -> ''; fewer than n tokens -> unchanged."""
    x = col(c)
    if n == 0:
        return F.lit("")
    pieces = F.regexp_extract_all(x, F.lit(WORD_PIECE), 0)
    return F.when(F.size(pieces) < n, x).otherwise(F.array_join(F.slice(pieces, 1, n), ""))


def html_escape(c) -> Column:
    """& < > " ' escaped, newline -> <br/>."""
    x = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    x = F.replace(x, F.lit('"'), F.lit("&quot;"))
    x = F.replace(x, F.lit("'"), F.lit("&#x27;"))
    return F.replace(x, F.lit("\n"), F.lit("<br/>"))


def parse_iso_timestamp(c) -> Column:
    """ISO-8601 with an optional trailing 'Z' (UTC session zone)."""
    s = F.regexp_replace(col(c), "Z+$", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def python_base_name(c) -> Column:
    """Base name of a Python file, '' if the whole name does not match."""
    return F.regexp_extract(col(c), P.PYTHON_FILE, 1)


def bleu_tokens(c) -> Column:
    """13a-style tokenisation (punctuation split off, '.' and ',' split
    unless between digits, '-' split after a digit)."""
    x = F.replace(col(c), F.lit("<skipped>"), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    x = F.replace(x, F.lit("&quot;"), F.lit('"'))
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))
    x = F.replace(x, F.lit("&lt;"), F.lit("<"))
    x = F.replace(x, F.lit("&gt;"), F.lit(">"))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    x = F.regexp_replace(x, BLEU_PUNCT, " $1 ")
    x = F.regexp_replace(x, r"([^0-9])([\.,])", "$1 $2 ")
    x = F.regexp_replace(x, r"([\.,])([^0-9])", " $1 $2")
    x = F.regexp_replace(x, r"([0-9])(-)", "$1 $2 ")
    x = strip_ws(x)
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, WS + "++"))


def rouge_tokens(c) -> Column:
    """ROUGE tokenisation: lower-case, non [a-z0-9] runs are separators."""
    x = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]++", " ")
    x = F.trim(x)
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, " "))
