"""Settings for the generated test tables.

Their texts are invented words mixed with real function words, so every list here holds words
that do occur in them. The operators are the same ones the service settings use.
"""

from tideline.functions.language import Lexicon

WORD_PATTERN = r"[\p{L}']+"
WORDS = {
    "en": "the of and to in is it that with for by was are this",
    "fr": "le la les et des du un une que qui est dans ou",
    "de": "der die und das den von zu mit nicht ist ein",
    "es": "el los las y una por para con no se",
}
LEXICONS = (
    Lexicon("en", frozenset(WORDS["en"].split())),
    Lexicon("fr", frozenset(WORDS["fr"].split()), elision=r"^[a-z]{1,3}'[aeiou]"),
    Lexicon("de", frozenset(WORDS["de"].split()), prefix="^(sch|ein|ung)",
            not_in=frozenset(w for ws in WORDS.values() for w in ws.split())),
    Lexicon("es", frozenset(WORDS["es"].split()), prefix="^(ción)",
            not_in=frozenset(w for ws in WORDS.values() for w in ws.split())),
)

# First words of messages and documents, as whole-message keywords: word, route, language.
KEYWORDS = [
    ("the", "PRICE", None), ("to", "HELP", None), ("of", "AGENT", None), ("in", "STOP", None),
    ("is", "START", None), ("la", "PRICE", "fr"), ("de", "HELP", "es"), ("der", "STOP", "de"), ("du", "START", "fr"),
]
PRICE_PHRASES = ("asci", "tion", "of the", "nicht die")
HINTS = {
    "alpha": ("erreth", "that the", "das"),
    "beta": ("inonth", "dans", "con los"),
    "gamma": ("to", "nicht", "une"),
}
OUT_OF_SCOPE = ("for", "les", "para", "mit")
GLOSSARY = {
    "tion": "action", "ment": "state", "ciones": "actions", "ing": "doing", "lich": "like", "heit": "hood",
    "ción": "action", "eau": "water", "os": "many",
}
FLAG_WORDS = ("licen[a-z]*", "asci", "clown", "nicht")
BANNED_WORDS = ("clown", "erreth")
LABELS = ("alpha", "beta", "gamma", "other")
