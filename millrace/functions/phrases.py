"""Wordings as phrases of plain words, and counts before a noun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def said(phrases: tuple[str, ...]) -> str:
    """A pattern of phrases: slots parted by ` + `, each one of its wordings parted by `|`, all between word edges, in any case; any white space parts words."""
    slot = lambda x: "(?:" + "|".join(r"\s+".join(w.replace(".", r"\.") for w in wording.split()) for wording in x.split("|")) + ")"
    return r"(?i)\b(?:" + "|".join(r"\s+".join(slot(x) for x in phrase.split(" + ")) for phrase in phrases) + r")\b"


def counted(text: Column, noun: str, gap: int) -> Column:
    """A text counts something: a number of up to five digits (or so many behind a comma), plain words of at most gap characters, then the noun.

    The text is cut at the noun; the words before each cut are looked through for a number near enough. What lies further off than that can't matter.
    """
    near = F.transform(F.slice(F.split(F.lower(text), noun), F.lit(1), F.greatest(F.size(F.split(F.lower(text), noun)) - 1, F.lit(0))), lambda piece: F.right(piece, F.lit(gap + 24)))

    def has_count(piece: Column) -> Column:
        words = F.split(F.rtrim(piece), r"\s+")
        rest = lambda i: F.array_join(F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))), " ")
        plain = lambda r: (F.char_length(r) + 1 <= F.lit(max(gap, 1))) & ~r.rlike(r"[^\w ,&/+.-]")
        found = F.transform(words, lambda w, i: w.rlike(r"(?:^|\W)\d{1,5}\+?$") & plain(rest(i)))
        return piece.rlike(r"\s$") & F.exists(found, lambda x: x)

    return F.coalesce(F.exists(near, has_count), F.lit(False))


def counted_sql(text: str, noun: str, gap: int) -> str:
    """The same in SQL: pieces before the noun that end in a number and plain words."""
    tail = rf"(^|[^0-9a-z_])[0-9]{{1,5}}\+?\s+[a-z0-9_ ,&/+.-]{{0,{gap}}}$" if gap else r"(^|[^0-9a-z_])[0-9]{1,5}\+?\s+$"
    return f"(len(list_filter(string_split_regex(lower({text}), '{noun}')[:-2], lambda p: regexp_matches(p, '{tail}'))) > 0)"
