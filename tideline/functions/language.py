"""Language tagging by lexicon counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import words_of
from tideline.functions.vector import let


@dataclass(frozen=True)
class Lexicon:
    """What speaks for one language: listed words, word beginnings, elisions.

    A beginning counts only on words of five letters or more that no language in
    ``not_in`` lists.
    """

    lang: str
    words: frozenset[str]
    prefix: str | None = None
    elision: str | None = None
    not_in: frozenset[str] = frozenset()
    min_prefix_len: int = 5


def lexicon_hits(words: Column, lex: Lexicon) -> Column:
    def counts(w):
        listed = w.isin(*sorted(lex.words))
        if lex.prefix:
            listed = listed | ((F.char_length(w) >= lex.min_prefix_len)
                               & ~w.isin(*sorted(lex.not_in)) & w.rlike(lex.prefix))
        return listed

    hits = F.size(F.filter(words, counts))
    if lex.elision:
        hits = hits + F.size(F.filter(words, lambda w: w.rlike(lex.elision)))
    return hits


def tag_language(text, lexicons: Sequence[Lexicon], default, pattern: str = r"[a-zA-Z']+") -> Column:
    """The language with strictly most hits; no words or a tie gives ``default``.

    ``default`` may be a column, so a known language survives an undecided message.
    """
    words = F.filter(F.transform(words_of(text, pattern), lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")
    default = default if isinstance(default, Column) else F.lit(default)
    scores = let(words, lambda ws: F.array(*[
        F.struct(lexicon_hits(ws, lx).alias("hits"), F.lit(lx.lang).alias("lang")) for lx in lexicons]))

    def decide(found):
        top = F.array_max(found)
        level = F.filter(found, lambda s: s["hits"] == top["hits"])
        return F.when(F.size(level) == 1, top["lang"]).otherwise(default)

    return let(scores, decide)
