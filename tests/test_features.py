"""Golden features, worked out by hand from the rules, and edge inputs."""

import pytest
from conftest import texts

from warywire.functions import vocabulary as V
from warywire.operators import extractors as E
from warywire.operators import features as FE

FLAGS = ("has_price", "has_quantity", "has_location", "has_urgency", "has_discretion", "has_quality",
         "has_transaction", "has_payment", "has_time", "has_normal_greeting")
# text, emojis, drug emojis, slang, chars, words, flags, combos, score, category, type-token ratio
GOLDEN = [
    ("Hello, how are you today?", 0, 0, 0, 25, 5, "0000000001", "0000000", 0, "LOW", 1.0),
    ("got that good work 💊, $30 per half, dm", 1, 1, 1, 38, 9, "1000011000", "1000010", 24, "HIGH", 1.0),
    ("Let's meet for coffee tomorrow", 0, 0, 0, 30, 5, "0010000010", "0000000", 2, "LOW", 1.0),
    ("fresh batch just landed, limited time only 🔥", 1, 1, 1, 44, 8, "0001001000", "0000010", 16, "HIGH", 1.0),
    ("What's the weather like?", 0, 0, 0, 24, 4, "0000000000", "0000000", 0, "LOW", 1.0),
    ("need that 🔌 asap, got cash", 1, 1, 0, 26, 6, "0001001110", "0000000", 11, "HIGH", 1.0),
    ("quality stuff available, dm for menu", 0, 0, 3, 36, 6, "0000011000", "0000000", 8, "HIGH", 1.0),
    ("🔥 pure grade, $100 per g, meet at usual spot", 1, 1, 1, 44, 10, "1010010000", "1010011", 31, "HIGH", 1.0),
    ("$50 per gram, meet at the usual place", 0, 0, 0, 37, 8, "1010000000", "0000001", 9, "HIGH", 1.0),
    ("Have a great day!", 0, 0, 0, 17, 4, "0000001000", "0000000", 3, "LOW", 1.0),
    ("yo got fire 💊 dm me $30 cash only asap", 1, 1, 1, 38, 10, "1001111110", "1000110", 35, "HIGH", 1.0),
    ("🔌 💊 💵", 3, 2, 0, 5, 3, "0000000000", "0000000", 4, "MEDIUM", 1.0),
    ("grow a 🪴 and 5 ounce", 0, 0, 1, 20, 6, "0000000000", "0000000", 3, "LOW", 1.0),
    ("mary jane, weed weed", 0, 0, 2, 20, 4, "0000000000", "0000000", 3, "LOW", 0.75),
    ("5 guys know this stop", 0, 0, 0, 21, 5, "0101010011", "0000000", 7, "MEDIUM", 1.0),
    ("", 0, 0, 0, 0, 0, "0000000000", "0000000", 0, "LOW", 0.0),
    ("   \t ", 0, 0, 0, 5, 0, "0000000000", "0000000", 0, "LOW", 0.0),
    ("price list\nline 5", 0, 0, 0, 17, 4, "0000000000", "0000000", 0, "LOW", 1.0),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = FE.final_features(texts(spark, *[g[0] for g in GOLDEN])).collect()
    return {r["message_id"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(golden, i):
    text, emo, drug, slang, chars, words, flags, combos, score, category, ttr = GOLDEN[i]
    r = golden[i]
    assert (r["emoji_count"], r["drug_emoji_count"], r["slang_count"], r["char_count"], r["word_count"]) == (
        emo, drug, slang, chars, words)
    assert "".join(str(int(r[f])) for f in FLAGS) == flags
    assert "".join(str(int(r[c])) for c in V.COMBOS) == combos
    assert (r["weighted_risk_score"], r["risk_category"]) == (score, category)
    assert r["text_complexity"] == pytest.approx(ttr)


def test_lexicon_facts():
    assert len(V.slang_rows()) == 200 and len(V.slang_terms()) == 197
    assert sum(" " in t for t in V.slang_terms()) == 19
    assert len(V.emoji_rows()) == 200 and len(V.emoji_terms()) == 157
    assert sum(len(e) > 1 for e in V.emoji_terms()) == 17


def test_score_range():
    assert sum(V.FLAG_WEIGHTS.values()) + sum(w for _, _, w in V.COMBOS.values()) == V.MAX_SCORE


def test_null_and_long_texts(spark):
    long = "weed deal " * 4000
    rows = FE.final_features(texts(spark, None, long)).orderBy("message_id").collect()
    assert rows[0]["word_count"] == 0 and rows[0]["risk_category"] == "LOW"
    assert rows[1]["word_count"] == 8000 and rows[1]["slang_count"] == 8000
    for fn in (E.features_v1, E.features_v2, E.features_v3, E.features_lexicon):
        assert fn(texts(spark, None, "", " ", long, "🔥")).count() == 5


def test_unicode_white_space_and_digits(spark):
    # no-break space separates words; a full-width digit is a digit
    r = FE.final_features(texts(spark, "weed pot gas", "５ bags")).orderBy("message_id").collect()
    assert r[0]["word_count"] == 3 and r[0]["slang_count"] == 3
    assert r[1]["has_quantity"]


def test_custom_lexicon(spark):
    r = FE.final_features(texts(spark, "zorp zorp weed"), slang=["zorp"]).first()
    assert r["slang_count"] == 2


def test_lexicon_hits_take_longest_term_at_word_borders(spark):
    r = E.features_lexicon(texts(spark, "crystal meth, weed weed seaweed ₹ 50 and $7", "❄️😮💨⚡")).orderBy("message_id").collect()
    assert r[0]["slang_hits"] == 3 and r[0]["currency_count"] == 2
    assert r[1]["emoji_hits"] == 3


def test_v2_behaviour(spark):
    rows = spark.createDataFrame(
        [(0, "hit me 💊💵 weed pot", "Signal", "1/5/2024 23:10"), (1, "", None, "bad"), (2, "candy dragon", "x", "01/05/2024 04:59")],
        "message_id long, message_text string, platform string, ts_text string")
    a, b, c = E.features_v2(rows).orderBy("message_id").collect()
    assert a["suspicious_sequence"] and a["drug_money_combo"] and a["urgent_time"] and a["late_night"] and a["secure_platform"]
    assert a["slang_proximity"] == pytest.approx(0.5)
    assert b["urgency_score"] == 0 and not b["late_night"] and not b["secure_platform"]
    assert c["late_night"] and c["slang_categories"] == 4  # cocaine + mdma, heroin + fentanyl
    bare = E.features_v2(texts(spark, "hello")).first()
    assert not bare["late_night"] and not bare["secure_platform"]
