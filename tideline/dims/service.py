"""Ready-made settings of the message service, built from the fixed values."""

from tideline.dims import fixed
from tideline.functions.language import Lexicon
from tideline.functions.text import whole

ENGLISH = Lexicon("en", frozenset(fixed.ENGLISH_WORDS))
LOCAL = Lexicon(
    fixed.LOCAL_LANG, frozenset(fixed.LOCAL_WORDS), prefix="^(" + "|".join(fixed.LOCAL_WORD_BEGINNINGS) + ")",
    elision=fixed.ELISION, not_in=frozenset(fixed.ENGLISH_WORDS))
LEXICONS = (ENGLISH, LOCAL)

KEYWORD_ROWS = [(word, route, fixed.LOCAL_LANG if word in fixed.LOCAL_KEYWORDS else None)
                for route, words in fixed.KEYWORDS.items() for word in words]
FLAG_PATTERN = whole("|".join(fixed.FLAGGED_WORDS))
BANNED_PATTERN = whole("|".join(fixed.BANNED_WORDS)) + "|(?i)" + "|".join(fixed.BANNED_PHRASES)
