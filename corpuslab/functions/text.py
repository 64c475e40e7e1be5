"""Column-expression builders for the scalar and per-token functions.

Every function returns a ``pyspark.sql.Column`` built only from built-in Spark
SQL functions, so it stays inside whole-stage code generation and runs the same
on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns that must equal the analysed script's behaviour.
# ---------------------------------------------------------------------------
COAUTHOR_SEPARATORS = (" and ", " & ", ", ")
DATE_PATTERN = "M/d/yyyy"  # the script's %m/%d/%Y (one or two digit month/day accepted, as in R)
DATE_FORMAT_OUT = "MM/dd/yyyy"
DATELINE_WINDOW = 20
DATELINE_FLAG_RE = r"[ ]+\p{Pd}"
# (?d): only "\n" ends a line, so "." crosses "\r" exactly like PCRE and RE2.
DATELINE_STRIP_RE = r"(?d).*\p{Pd}"
URL_RE = r" ?(f|ht)(tp)(s?)(://)(.*)[.|/](.*)"
EMAIL_RE = r"[^\s]*@[^\s]*"
PUNCT_RE = r"\p{Punct}"
CODEPOINT_FIRST_RE = r"^(.*?)<U\+\w+>"
DIGITS_RE = r"[0-9]+"
NON_LETTER_RE = r"[^a-zA-Z]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_false(pred: Column) -> Column:
    """R's grepl / %in% never return NA: a null predicate becomes FALSE."""
    return F.coalesce(pred, F.lit(False))


# --- authors ---------------------------------------------------------------
def has_coauthor(author="author") -> Column:
    a = _col(author)
    pred = None
    for sep in COAUTHOR_SEPARATORS:
        p = F.instr(a, sep) > 0
        pred = p if pred is None else (pred | p)
    return null_false(pred)


def first_author(author="author") -> Column:
    """Cut at the first " and ", then " & ", then ", " (in that order)."""
    a = _col(author)
    for sep in COAUTHOR_SEPARATORS:
        a = F.regexp_replace(a, "(?s)" + sep + ".*", "")
    return a


# --- labels / dates ----------------------------------------------------------
def topic_count(topics="topics") -> Column:
    """Commas in the label list minus one (may be -1), as the script computes it."""
    t = _col(topics)
    return (F.length(t) - F.length(F.regexp_replace(t, ",", "")) - F.lit(1)).cast("long")


def parse_date(date="date") -> Column:
    """``%m/%d/%Y``; unparsable strings give null like R's ``as.Date``."""
    return F.try_to_date(_col(date), DATE_PATTERN)


def month_key(date="date") -> Column:
    """Year-month key ``yyyyMM`` from an ``MM/dd/yyyy`` string (chars 7..11, then 1..2)."""
    d = _col(date)
    return F.concat(F.substring(d, 7, 5), F.substring(d, 1, 2))


def lead_type_class(lead="post_lead_type") -> Column:
    lt = _col(lead)
    return (
        F.when(null_false(F.instr(lt, "Video") > 0), F.lit("Video"))
        .when(null_false(F.instr(lt, "Default") > 0), F.lit("Article"))
        .otherwise(F.lit("Gallery"))
    )


def pad_id(n: Column, width: int = 5) -> Column:
    """``str_pad``: left-pad with zeros, never truncate (Spark's lpad would)."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def digit_count(x="shares") -> Column:
    return F.length(_col(x).cast("string")).cast("long")


def text_length(x="text") -> Column:
    return F.length(_col(x)).cast("long")


# --- dateline ---------------------------------------------------------------
def dateline_flag(text="text", window: int = DATELINE_WINDOW) -> Column:
    return null_false(F.substring(_col(text), 1, window).rlike(DATELINE_FLAG_RE))


def dateline_strip(text="text", window: int = DATELINE_WINDOW) -> Column:
    """Delete up to the last dash in the first ``window`` characters; applied to every row."""
    t = _col(text)
    head = F.regexp_replace(F.substring(t, 1, window), DATELINE_STRIP_RE, "")
    return F.concat(head, F.substring(t, window + 1, 2147483647))


# --- token cleansing ----------------------------------------------------------
def normalise_ws(text="text") -> Column:
    """Newline, tab and carriage return become spaces (by byte search: ``translate`` makes a string of every character)."""
    t = _col(text)
    for blank in "\n\t\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    return t


def strip_urls(tok="token") -> Column:
    """URL pattern; it needs a literal "://", so tokens without one skip the regex."""
    t = _col(tok)
    return F.when(F.instr(t, "://") > 0, F.regexp_replace(t, URL_RE, " ")).otherwise(t)


def strip_emails(tok="token") -> Column:
    """E-mail pattern; it needs an "@", so tokens without one skip the (backtracking) regex."""
    t = _col(tok)
    return F.when(F.instr(t, "@") > 0, F.regexp_replace(t, EMAIL_RE, " ")).otherwise(t)


def strip_punct(tok="token") -> Column:
    return F.regexp_replace(_col(tok), PUNCT_RE, " ")


def strip_codepoints(tok="token") -> Column:
    """First ``<U+XXXX>`` escape only (the script uses ``sub``)."""
    return F.regexp_replace(_col(tok), CODEPOINT_FIRST_RE, "$1 ")


def letters_only(tok="token") -> Column:
    """Digits, punctuation and every other non-letter are dropped, then lower case.

    The script turns them into spaces and deletes all spaces at the end, so a
    single delete of ``[^a-zA-Z]`` gives the same word.
    """
    return F.lower(F.regexp_replace(_col(tok), NON_LETTER_RE, ""))


def clean_word(tok="token", codepoints_first: bool = False) -> Column:
    """Token -> word: URL, e-mail, (optional code-point escape), letters only, lower case."""
    x = strip_emails(strip_urls(tok))
    if codepoints_first:
        x = strip_codepoints(x)
    return letters_only(x)
