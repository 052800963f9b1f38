"""Fixed values of the message service: they must be exactly these for its results to come out.

Word lists, lookup tables and patterns only; no logic lives here.
"""

# ---- fixed values: whole-message keywords -> route ------------------------------------------
KEYWORDS = {
    "PRICE": ("price", "prices", "prix", "bbeeyi", "beeyi"),
    "HELP": ("help", "aide", "yamba", "nnyamba"),
    "AGENT": ("agent", "omulimisa"),
    "STOP": ("stop", "komya"),
    "START": ("start", "tandika"),
}
LOCAL_KEYWORDS = ("bbeeyi", "beeyi", "yamba", "nnyamba", "omulimisa", "komya", "tandika")
LOCAL_LANG = "lg"

# ---- fixed values: phrases that make a message a price question -----------------------------
PRICE_PHRASES = (
    "price", "prices", "prix", "cost", "costs", "sell", "selling", "market rate", "how much", "pay for",
    "bbeeyi", "beeyi", "ssente mmeka", "emiwendo", "bagula", "tunda",
)
FOLLOWUP_ANSWERS = {"1": "better", "2": "same", "3": "worse"}

# ---- fixed values: language lexicons --------------------------------------------------------
ENGLISH_WORDS = (
    "the", "a", "an", "is", "are", "was", "my", "on", "of", "and", "with", "in", "to", "it", "they", "what", "how", "there", "some",
    "under", "have", "has", "i", "me", "you", "this", "that", "not", "no", "yes", "look", "looks", "see", "leaf", "leaves", "coffee",
    "spots", "spot", "yellow", "orange", "brown", "black", "powder", "tree", "trees", "plant", "plants", "green", "dry", "dying", "turning",
    "price", "much", "hello", "hi", "please", "help", "berries", "berry", "today", "bad", "good", "strange", "wrong", "something",
)
LOCAL_WORDS = (
    "nga", "ku", "mu", "era", "naye", "oba", "kiki", "ki", "leero", "nnyo", "bulungi", "bubi", "zange", "byange", "wange", "kyange",
    "gyange", "zino", "bino", "emmwanyi", "mmwanyi", "kaawa", "kawa", "ebikoola", "ekikoola", "amabala", "ssente", "mmeka", "bbeeyi",
    "beeyi", "wansi", "waggulu", "oli", "otya", "gyebale", "ssebo", "nnyabo", "webale", "kale", "tewali", "langi", "kyenvu", "kacungwa",
    "nzirugavu", "maddugavu", "kiragala",
)
LOCAL_WORD_BEGINNINGS = (
    "eki", "ebi", "emi", "omu", "aba", "ama", "oku", "olu", "obu", "ag", "eb", "ez", "ek", "zi", "bi", "gi", "ki", "ly", "by", "zz", "mm",
    "nn", "ss", "tt", "bb", "kk", "gg",
)
ELISION = r"^[a-z]{1,3}'[aeiou]"

# ---- fixed values: hint phrases per label, and words outside the service's scope ------------
HINTS = {
    "leaf_rust": ("rust", "orange", "yellow spot", "yellow powder", "powder", "underside"),
    "phoma": ("phoma", "black spot", "dark spot", "brown spot", "brown lesion", "dieback", "necrosis", "lesion"),
    "healthy": ("healthy", "no problem", "looks good", "looks fine", "all good"),
}
OUT_OF_SCOPE = (
    "berry", "berries", "cherry", "cherries", "branch", "branches", "twig", "twigs", "stem", "stems", "trunk",
    "root", "roots", "insect", "insects", "bug", "bugs", "ant", "ants", "borer", "beetle", "caterpillar",
    "weevil", "worm", "mealybug", "pest", "pests",
)
LABELS = ("leaf_rust", "phoma", "healthy", "other")
FOLLOWED_UP = ("leaf_rust", "phoma")
QUESTIONS = (
    "ask_plant_part", "ask_leaf_look", "ask_powder_or_dark_patches", "ask_yellow_pattern", "ask_black_tips_cold",
    "ask_any_marks", "clarify",
)

# ---- fixed values: stem -> English term, in matching order ----------------------------------
GLOSSARY = {
    "mmwanyi": "coffee", "kaawa": "coffee", "kawa": "coffee", "bikoola": "leaves", "kikoola": "leaf",
    "buwunga": "powder", "nfuufu": "dust", "kacungwa": "orange", "kyenvu": "yellow", "zirugavu": "black",
    "ddugavu": "black", "kitaka": "brown", "kiragala": "green", "mabala": "spots", "bbala": "spot",
    "bubonero": "marks", "wansi": "underneath", "nsonda": "tips", "mbiriizi": "edges", "kala": "drying",
    "gwa": "falling", "bigwa": "falling", "bibala": "berries", "matabi": "branches", "kikolo": "stem",
    "mirandira": "roots", "biwuka": "insects", "butuli": "holes", "mpewo": "cold", "nkuba": "rain",
    "bulungi": "fine", "masamasa": "shiny",
}

# ---- fixed values: corpus curation ----------------------------------------------------------
SPLITS = ("train", "calib", "test")
RATIOS = {"train": 0.70, "calib": 0.15, "test": 0.15}
PROTECTED_ORDER = ("test", "calib", "train")
FLAGGED_WORDS = ("rust\\w*", "phoma", "hemileia", "fungus", "fungal", "disease\\w*", "infect\\w*", "upside",
                 "mirror\\w*", "flipped")
BANNED_WORDS = ("rust\\w*", "phoma", "hemileia")
BANNED_PHRASES = ("orange powder", "orange dust")
TOPIC_LABELS = {
    "orange or yellow powder under coffee leaves": "leaf_rust",
    "dark brown or black spots on coffee leaves": "phoma",
    "questions about coffee prices": "other",
    "replies to an advisor: better": "other",
    "coffee leaves that look green and healthy": "other",
    "coffee shoot tips dying back and turning black": "phoma",
    "coffee leaves with no marks at all": "healthy",
}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
FOLDER_LABELS = (("health", "healthy"), ("rust", "leaf_rust"), ("phoma", "phoma"))

# ---- fixed values: evaluation and cost ------------------------------------------------------
SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
C_GRID = (1, 3, 10, 30, 100, 300, 1000)
TEMPERATURE_BOUNDS = (0.05, 20.0)
CHARS_PER_TOKEN = 3.5
IMAGE_PIXELS_PER_TOKEN, IMAGE_LONG_EDGE, IMAGE_TOKEN_CAP = 750, 1568, 1600
BATCH_DISCOUNT = 0.5
