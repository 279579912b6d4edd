"""Row-wise rules against hand-made cases and plain-Python statements of the rules."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import pii, quality, text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_masks_count_and_leave_placeholders(spark):
    assert tuple(one(spark, pii.mask_emails, "mail a@b.com or c.d@e.org |||EMAIL_ADDRESS|||")) == ("mail |||EMAIL_ADDRESS||| or |||EMAIL_ADDRESS||| |||EMAIL_ADDRESS|||", 2)
    for number in ("2831823829", "(283)-182-3829", "(283) 182 3829", "283-182-3829"):
        assert tuple(one(spark, pii.mask_phone_numbers, f"call {number} now")) == ("call |||PHONE_NUMBER||| now", 1)
    assert tuple(one(spark, pii.mask_ips, "at 192.0.2.146 today")) == ("at |||IP_ADDRESS||| today", 1)


def test_package_masks_apply_in_order(spark):
    assert one(spark, pii.mask_pii, "4242 4242 4242 4242, 123-45-6789, x@y.de, 10.0.0.1") == "<CREDIT_CARD>, <SSN>, <EMAIL>, <IP_ADDRESS>"
    assert one(spark, pii.mask_pii, "4111 1111 1111 1111") == "4111 <PHONE> 1111"
    assert one(spark, pii.pii_counts, "x@y.de and <EMAIL> and 555-1234") == 2


@pytest.mark.parametrize(("value", "lang"), [("plain words", "en"), ("欢迎来到我们的网站", "zh"), ("ひらがな", "ja"), ("漢字とかな", "zh"), ("한국어", "ko"), ("", "en")])
def test_script_language(spark, value, lang):
    assert one(spark, text.script_language, value) == lang


def test_words_follow_unicode_white_space(spark):
    value = "a b c　d\x1ce\u0085f  g"
    assert one(spark, text.words, value) == value.split()
    assert one(spark, text.words, "") == []


def test_html_to_text_matches_plain_python(spark):
    page = "<html><style>p{}</style><SCRIPT>var x = '<p>';</SCRIPT><p>A &amp;amp; B &quot;q&quot;</p>\n\n<b>c</b>&copy;"
    out = re.sub(r"(?is)<script[^>]*>.*?</script>", "", page)
    out = re.sub(r"(?is)<style[^>]*>.*?</style>", "", out)
    out = re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", out))).strip()
    assert one(spark, text.html_to_text, page) == out


def test_malformed_bytes_are_dropped(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xffc\xc3\xa9"),)], "b binary")
    assert df.select(text.decode_utf8(F.col("b"))).first()[0] == "abcé"


@pytest.mark.parametrize(("value", "kept"), [("word " * 49, False), ("word " * 50, True), ("ab " * 60, False), ("wordwordword " * 60, False), ("word# " * 60, False), ("word " * 60 + "•" * 55, False), ("word " * 60 + "•" * 54, True), ("long word ... " * 40, False), ("long word " * 35 + "... " * 30, True), ("long word " * 35 + "... " * 31, False), ("long... " * 60, False), ("", False)])
def test_gopher_pkg(spark, value, kept):
    assert one(spark, quality.gopher_pkg, value) is kept


@pytest.mark.parametrize(("value", "kept"), [("word " * 50, True), ("word " * 49, False), ("word " * 45 + "1234 " * 15, False), ("word " * 50 + "1234 " * 12, True), ("\n".join(["some word here..."] * 20), False), ("\n".join(["some word here..."] * 5 + ["some word here"] * 15), True)])
def test_gopher_strict(spark, value, kept):
    assert one(spark, quality.gopher_strict, value) is kept


def test_keyword_verdicts(spark):
    assert one(spark, quality.nsfw_pkg, "an Adult film") is True
    assert one(spark, quality.nsfw_strict, "first class")["label"] == "nsfw"
    assert one(spark, quality.nsfw_strict, "what a c*ck-up")["label"] == "nsfw"
    assert one(spark, quality.nsfw_strict, "a quiet day")["label"] == "non-nsfw"
    assert tuple(one(spark, quality.toxic_strict, "you idiot, you MORON")) == ("toxic", 2.0)
    assert tuple(one(spark, quality.toxic_strict, "you idiot")) == ("non-toxic", 1.0)


def test_quality_class(spark):
    menu = "\n".join(["FAQ", "Search", "Register", "Log in", "Profile", "Powered by x"])
    assert tuple(one(spark, quality.quality_class, menu)) == ("cc", 10.0)
    assert tuple(one(spark, quality.quality_class, "word " * 120)) == ("wiki", 1.0)


def test_null_in_null_out(spark):
    for f in (pii.mask_pii, text.html_to_text):
        assert one(spark, f, None) is None
    assert one(spark, quality.gopher_pkg, None) is False
