"""Rows that every operator must bear, and a plain word splitter."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(start=0):
    """Null and empty texts, nulls in every column, a very long text, repeated rows, odd characters."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (start, None, "en", "s1", 0), (start + 1, "", "en", "s1", 0), (start + 2, " \t\n ", None, None, None), (None, "some words without an id here", None, "s2", 1),
        (start + 3, long, "en", "s1", len(long)), (start + 4, "the same row twice is fine with me", "en", "s3", 9), (start + 4, "the same row twice is fine with me", "en", "s3", 9),
        (start + 5, "ünïcödé     \U0001f600 <|endoftext|> text", "fr", "s2", 3), (start + 6, "one", "de", "s2", 3), (start + 7, "x" * 5000, "de", "s2", 5000),
    ]
