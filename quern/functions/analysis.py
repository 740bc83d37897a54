"""Text to terms, as Column expressions: the same ones for documents and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleaning steps, in order (applied before and after lower-casing), and the term length.
URL = r"https?://\S+\s?"
TAG = r"<[^>]*>"
PUNCTUATION = r"\p{Punct}"
NOT_ASCII = r"[^\x00-\x7F]"
SPACES = r"\s+"
TERM_LENGTH = 20

#: The default list of function words; a configuration may bring any other.
STOPWORDS = tuple(
    "a about above after again against all am an and any are as at b be because been before being below between both but by c can could d "
    "did do does doing down during e each f few for from further g h had has have having he her here hers him his how i if in into is it "
    "its j just k l m me more most my n no nor not now o of off on once only or other our out over own p q r s same she should so some "
    "such t than that the their them then there these they this those through to too u under until up v very w was we were what when "
    "where which while who whom why will with would x y you your z".split()
)


def clean_text(text: Column) -> Column:
    """URLs to a space, lower case, tags away, punctuation and all above ASCII to spaces, spaces collapsed.

    URLs go before lower-casing, so an upper-case scheme stays; a tag leaves no space behind. Null stays null.
    """
    c = F.lower(F.regexp_replace(text, URL, " "))
    for pattern, to in ((TAG, ""), (PUNCTUATION, " "), (NOT_ASCII, " "), (SPACES, " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def tokenize(cleaned: Column) -> Column:
    """Non-empty tokens of a cleaned text; a null text has none."""
    return F.coalesce(F.filter(F.split(cleaned, " "), lambda t: t != ""), F.array().cast("array<string>"))


def remove_stopwords(tokens: Column, words: tuple[str, ...] = STOPWORDS) -> Column:
    """All occurrences of the words go; what stays keeps its order and repeats."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def tokens_of(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Cleaned tokens, without the stopwords given."""
    return remove_stopwords(tokenize(clean_text(text)), stopwords)


def truncated(term: Column) -> Column:
    """A document term as the index keeps it."""
    return F.substring(term, 1, TERM_LENGTH)


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
