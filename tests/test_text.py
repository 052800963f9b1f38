"""Text functions on the service's own settings."""

import pytest
from pyspark.sql import functions as F

from tideline.dims import fixed, service
from tideline.functions import text as tx
from tideline.functions.decision import keyword_decide
from tideline.functions.language import tag_language
from tideline.operators.routing import keyword_dim, route_keyword


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_fold_key_drops_accents_and_end_marks(spark):
    cases = {" Príx!! ": "prix", "AIDE.": "aide", "ﬁn": "fin", "½ kg": "12 kg", "ＳＴＯＰ": "stop", "ñandú?": "nandu", "日本": "", "a…b": "a...b"}
    assert column(spark, list(cases), tx.fold_key("t")) == list(cases.values())


def test_norm_phone_forms_are_one_sender(spark):
    cases = {"0799 123": "+256799123", "256799123": "+256799123", "+256-799-123": "+256799123", "00256799123": "+256799123", "abc": "", "": ""}
    assert column(spark, list(cases), tx.norm_phone("t")) == list(cases.values())


def test_norm_text_keeps_letters_of_all_scripts(spark):
    assert column(spark, ["  Café — no_1! ", "..."], tx.norm_text("t")) == ["café no_1", ""]


@pytest.mark.parametrize("text,lang", [
    ("my leaves are yellow", "en"), ("emmwanyi zange zino", "lg"), ("by'emmwanyi", "lg"), ("ok", "xx"), ("1", "xx"), ("", "xx"),
    ("'the' leaf", "en"), ("the ku", "xx")])
def test_tag_language(spark, text, lang):
    assert column(spark, [text], tag_language("t", service.LEXICONS, "xx")) == [lang]


def test_whole_message_keywords(spark):
    df = spark.createDataFrame([(1, "STOP"), (2, "stop it"), (3, "Bbeeyi?"), (4, "Aide!")], "i int, t string")
    rows = route_keyword(df, keyword_dim(spark, service.KEYWORD_ROWS), "t").orderBy("i").collect()
    assert [(r.route, r.kw_lang) for r in rows] == [("STOP", None), (None, None), ("PRICE", "lg"), ("HELP", None)]


def test_price_intent_is_whole_word(spark):
    texts = ["What PRICE today?", "priceless", "how much is it", "Ssente mmeka", "prix.", ""]
    assert column(spark, texts, tx.is_price_intent("t", fixed.PRICE_PHRASES)) == [True, False, True, True, True, False]


def test_keyword_chain(spark):
    texts = ["orange powder on leaves", "my plants look odd", "ants on the stem", "black spots, brown lesions", "rust and phoma"]
    v = column(spark, texts, keyword_decide("t", fixed.HINTS, fixed.OUT_OF_SCOPE))
    assert [(r.label, r.decision) for r in v] == [("leaf_rust", "answer"), ("other", "clarify"), ("other", "escalate"), ("phoma", "answer"), ("leaf_rust", "answer")]
    second = column(spark, ["my plants look odd"], keyword_decide("t", fixed.HINTS, fixed.OUT_OF_SCOPE, True))
    assert second[0].decision == "escalate"


def test_glossary_takes_the_next_stem_when_a_term_is_listed(spark):
    # Both words hold the first stem; the second word then goes on to a later stem it also holds.
    glossary = {"aaaa": "one", "bbbb": "two", "cc": "three"}
    got = column(spark, ["xaaaabbbb aaaabbbb ccx xcc"], tx.glossary_terms("t", glossary))
    assert got == [["one", "two", "three"]]
    assert column(spark, ["ebikoola bya kyenvu"], tx.glossary_terms("t", fixed.GLOSSARY)) == [["leaves", "yellow"]]


def test_append_missing_terms(spark):
    df = spark.createDataFrame([("The Leaf", ["leaf", "spots"]), ("spots", ["spots"])], "e string, g array<string>")
    assert [r[0] for r in df.select(tx.append_missing_terms("e", "g")).collect()] == ["The Leaf (spots)", "spots"]


def test_flags_and_cleaning(spark):
    assert column(spark, ["Rusty FUNGUS crusty rusty"], F.array_join(tx.flag_terms(F.array("t"), service.FLAG_PATTERN), "|")) == ["fungus|rusty"]
    assert column(spark, ['  "a \n b"  '], tx.clean_generated("t")) == ["a b"]
    why = [tx.generated_reason(tx.clean_generated("t"), service.BANNED_PATTERN)]
    assert column(spark, ["", "x" * 321, "Orange  dust here", "fine", "phoma"], why[0]) == ["empty_or_long", "empty_or_long", "banned", None, "banned"]


def test_units_slugs_and_menu(spark):
    df = spark.createDataFrame([("photo", "a/2300_276.jpg", "phoma", "g1"), ("photo", "a/x.jpg", "phoma", "g2"), ("sms", "a_1.jpg", "phoma", "g3")],
                               "k string, s string, l string, g string")
    assert [r[0] for r in df.select(tx.unit_key("k", "s", "l", "g")).collect()] == ["phoma-blk0002", "g2", "g3"]
    assert column(spark, ["Replies to an advisor: better!"], tx.topic_slug("t")) == ["replies-to-an-advisor-better"]
    menu = column(spark, ["", "1", "2", "2* rust ", "3*x", "9"], tx.menu_route("t"))
    assert [(m.entry, m.free_text) for m in menu] == [("menu", None), ("prices", None), ("ask_report", None), ("report", "rust"), ("agent", None), ("menu", None)]


def test_fold_key_beyond_the_basic_plane(spark):
    rows = [("\U0001d42c\U0001d42d\U0001d428\U0001d429.",), ("Stóp ﬁn",), ("\U0001f600 hi",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.fold_key("t")).collect()] == ["stop", "stop fin", "hi"]
