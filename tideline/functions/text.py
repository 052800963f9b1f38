"""Text expressions: normal forms, cleaning, whole-word predicates, glossary terms.

Every function takes and returns columns, so Catalyst sees one expression tree and a filter on
the result stays in the same stage as the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.vector import let

# Letters, digits and underscore of every script. Java's \w and \b know ASCII only.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """White space of every kind off both ends (``trim`` takes spaces only)."""
    return F.btrim(_col(text), F.lit(" \t\n\r\f\x0b"))


def norm_text(text) -> Column:
    """Comparison key of a text: lower case, every run of non-word characters one space."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), NON_WORD, " "))


def text_key(text) -> Column:
    """Fixed-width stand-in for ``norm_text`` when rows are shuffled by it.

    Texts may be long; 32 bytes travel instead.
    """
    return F.unhex(F.sha2(norm_text(text), 256))


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition leaves ASCII, by rule.

    Returns the one-to-one part of the basic plane as two aligned strings, and the rest as a map.
    """
    single_from, single_to, many = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1 and cp < 0x10000:
            single_from.append(ch)
            single_to.append(folded)
        elif folded:
            many[ch] = folded
    return "".join(single_from), "".join(single_to), many


def fold_key(text) -> Column:
    """Whole-message key: trimmed, lower case, accents off, ASCII only, end punctuation off."""
    base = F.lower(strip(text))
    src, dst, many = _ascii_folds()
    # Ligatures and fractions become several letters, and letters beyond the basic plane are no single
    # character to ``translate``. They are rare, so only rows that contain one pay for the character map.
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in many.items())), F.lit("\x02"), F.lit("\x01"))
    widened = F.array_join(
        F.transform(F.split(base, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    to_ascii = lambda t: F.regexp_replace(F.translate(t, src, dst), r"[^\x00-\x7F]+", "")
    folded = (F.when(~base.rlike(r"[^\x00-\x7F]"), base)
               .when(F.translate(base, "".join(many), "") == base, to_ascii(base))
               .otherwise(to_ascii(widened)))
    return F.btrim(folded, F.lit(" .!?"))


def norm_phone(raw, country: str = "256") -> Column:
    """One international form for every way of writing a number."""
    p = F.regexp_replace(F.coalesce(_col(raw), F.lit("")), r"[^\p{Nd}+]", "")
    return (F.when(p.startswith("00"), F.concat(F.lit("+"), F.substr(p, F.lit(3))))
             .when(p.startswith("0"), F.concat(F.lit("+" + country), F.substr(p, F.lit(2))))
             .when((p != "") & ~p.startswith("+"), F.concat(F.lit("+"), p))
             .otherwise(p))


def clean_inbound(text, cap: int = 1000) -> Column:
    """Trimmed and capped message; the cap is the inbound rule of the service, not a short cut."""
    return F.substring(strip(F.coalesce(_col(text), F.lit(""))), 1, cap)


def whole(body: str, ending: str = "") -> str:
    """Pattern for ``body`` between word boundaries of any script, case-insensitive."""
    return rf"(?i)(?<!{WORD})(?:{body}){ending}(?!{WORD})"


def whole_words(phrases: Sequence[str], plural: bool = False) -> str:
    """Pattern for any of the phrases as whole words, case-insensitive."""
    return whole(("|".join(re.escape(p) for p in phrases)), "s?" if plural else "")


def is_price_intent(text, phrases: Sequence[str]) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(whole_words(phrases))


def needs_translation(text, lang, target: str = "en") -> Column:
    return (_col(lang) != target) & _col(text).rlike(r"\p{L}")


def words_of(text, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(pattern), F.lit(0))


def glossary_terms(text, glossary: dict[str, str], word_pattern: str = "[a-z]+") -> Column:
    """English terms for the stems found in the text, each once, in order of appearance.

    A stem of more than three letters may sit anywhere in a word, a shorter one only at its end.
    Per word the first stem counts whose term is not listed yet, so the fold carries the list.
    """
    stem_re = "|".join(s if len(s) > 3 else s + "$" for s in glossary)
    table = F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(e).alias("term"), F.lit(len(s) > 3).alias("inside"))
                      for s, e in glossary.items()])
    hits = F.filter(words_of(text, word_pattern), lambda w: w.rlike(stem_re))

    def step(found, word):
        usable = F.filter(table, lambda g: F.when(g["inside"], word.contains(g["stem"]))
                          .otherwise(word.endswith(g["stem"])) & ~F.array_contains(found, g["term"]))
        return F.concat(found, F.slice(F.transform(usable, lambda g: g["term"]), 1, 1))

    return F.aggregate(hits, F.array().cast("array<string>"), step)


def append_missing_terms(english, terms) -> Column:
    """The translation, with the terms it does not contain added in brackets."""
    english = _col(english)
    missing = F.filter(_col(terms), lambda t: ~F.lower(english).contains(t))
    return (F.when(F.size(missing) > 0, F.concat(english, F.lit(" ("), F.array_join(missing, ", "), F.lit(")")))
             .otherwise(english))


def _has_phrase(low: Column, phrase: str) -> Column:
    """Whole-word test on lower-case text. Most texts lack a phrase, so a plain byte search goes
    first; the pattern then leads with the literal and checks the word start behind it."""
    p = re.escape(phrase)
    return low.contains(phrase) & low.rlike(rf"{p}(?<!{WORD}{p})s?(?!{WORD})")


def phrase_hits(text, phrases: Sequence[str]) -> Column:
    """How many different phrases occur as whole words, plural s allowed."""
    return let(F.lower(F.coalesce(_col(text), F.lit(""))), lambda low: _count_phrases(low, phrases))


def _count_phrases(low: Column, phrases: Sequence[str]) -> Column:
    total = F.lit(0)
    for phrase in phrases:
        total = total + _has_phrase(low, phrase.lower()).cast("int")
    return total


def has_any_phrase(text, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases occurs; the first one found ends the search."""
    return let(F.lower(F.coalesce(_col(text), F.lit(""))),
               lambda low: reduce(lambda x, y: x | y, [_has_phrase(low, p.lower()) for p in phrases]))


def hint_score(text, hints: dict[str, Sequence[str]]) -> Column:
    """Best label by phrase hits; the first label wins a tie. Struct of label and hits."""
    def best_of(low):
        scores = F.array(*[F.struct(_count_phrases(low, ph).alias("hits"), F.lit(-i).alias("rank"), F.lit(lab).alias("label"))
                           for i, (lab, ph) in enumerate(hints.items())])
        return let(F.array_max(scores), lambda best: F.struct(best["label"].alias("label"), best["hits"].alias("hits")))

    return let(F.lower(F.coalesce(_col(text), F.lit(""))), best_of)


def flag_terms(texts, pattern: str) -> Column:
    """Sorted distinct lower-case matches of a pattern over an array of texts."""
    found = F.flatten(F.transform(_col(texts), lambda t: F.regexp_extract_all(F.lower(t), F.lit(pattern), F.lit(0))))
    return F.array_sort(F.array_distinct(found))


def clean_generated(text) -> Column:
    """White space to single spaces, quotes at both ends off."""
    return F.btrim(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), F.lit('"“”'))


def generated_reason(cleaned, banned: str, longest: int = 320) -> Column:
    """Why a cleaned text is dropped, or null."""
    c = _col(cleaned)
    return (F.when((c == "") | (F.char_length(c) > longest), "empty_or_long")
             .when(c.rlike(banned), "banned"))


def length_window(text, words: tuple[int, int] = (3, 30), longest: int = 160) -> Column:
    t = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    n = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    return n.between(*words) & (F.char_length(_col(text)) <= longest)


def image_number(source_id) -> Column:
    """The number at the end of a file name, or null."""
    return F.regexp_extract(_col(source_id), r"_(\d+)\.[A-Za-z0-9]+$", 1).try_cast("bigint")


def unit_key(kind, source_id, label, group, block: int = 100) -> Column:
    """The unit a split moves as a whole: a block of file numbers for photos, else the group."""
    n = F.when(_col(kind) == "photo", image_number(source_id))
    blocked = F.format_string("%s-blk%04d", _col(label), F.floor(n / block))
    return F.when(n.isNull(), _col(group)).otherwise(blocked)


def topic_slug(topic, longest: int = 28) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(_col(topic)), "[^a-z]+", "-"), F.lit("-")), 1, longest)


def number_scope(phone, prefix: str, allow: str | None = None) -> Column:
    """Row scope: keys with the prefix, or one allowed key."""
    inside = _col(phone).startswith(prefix)
    return inside | (_col(phone) == allow) if allow else inside


def menu_route(text) -> Column:
    """Entry and free text of a menu session whose steps are joined by ``*``."""
    parts = F.split(F.nullif(F.trim(F.coalesce(_col(text), F.lit(""))), F.lit("")), r"[*]")
    choice, said = F.get(parts, F.lit(0)), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    entry = (F.when(choice == "1", "prices")
              .when((choice == "2") & (said == ""), "ask_report")
              .when(choice == "2", "report")
              .when(choice == "3", "agent")
              .otherwise("menu"))
    return F.struct(entry.alias("entry"), F.when(entry == "report", said).alias("free_text"))
