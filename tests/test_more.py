import io

import numpy as np
import pytest

from lexmill.functions import pii, quality, register, text
from lexmill.operators import dedup, scorers
from lexmill.plans import clean
from lexmill.sources import readers
from pyspark.sql import functions as F

TEXTS = ["mail a.b@c.de or call 555-123-4567 from 10.0.0.1", "a stupid idiot, moron", "XXX nude", "日本語のテキスト", "", None, "fuck, asshole"]


def test_sql_functions_equal_the_columns(spark):
    register.register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for name, f in {"mask_pii": pii.mask_pii, "mask_emails": pii.mask_emails, "mask_phone_numbers": pii.mask_phone_numbers, "mask_ips": pii.mask_ips, "nsfw_pkg": quality.nsfw_pkg, "toxic_pkg": quality.toxic_pkg, "nsfw_strict": quality.nsfw_strict, "toxic_strict": quality.toxic_strict, "script_language": text.script_language}.items():
        got = df.select(F.expr(f"{name}(t)").alias("a"), f(F.col("t")).alias("b")).filter("t is not null").collect()
        assert all(r.a == r.b for r in got), name


@pytest.mark.parametrize(("page", "want"), [("<p>it&#8217;s caf&eacute; &amp;amp; &#x1F600;</p>", "it’s café &amp; 😀"), ("<b>plain</b>", "plain"), ("&lt;b&gt;", "<b>"), ("a&nbsp;&nbsp;b", "a b"), (None, None), ("&rsquo;&notanentity;", "’¬anentity;")])
def test_all_character_references(spark, page, want):
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(text.html_to_text(F.col("h"))).first()[0] == want


def test_npy(spark, tmp_path):
    for k, kind in enumerate((np.uint16, np.int32)):
        np.save(tmp_path / f"{k}.npy", np.arange(5, dtype=kind) + 65530 * (k == 0))
    got = {r.name.rsplit("/", 1)[1]: r.tokens for r in readers.npy_files(spark, str(tmp_path)).collect()}
    assert got == {"0.npy": [65530, 65531, 65532, 65533, 65534], "1.npy": [0, 1, 2, 3, 4]}


def test_pluggable_scorer(spark):
    def load():
        return lambda texts: [(f"__label__{'de' if 'und' in t else 'en'}", len(t) / 100) for t in texts]

    df = spark.createDataFrame([(1, "Hund\nund Katze", "x"), (2, None, "y"), (3, "the cat", "z")], "doc_id long, text string, given string")
    got = {r.doc_id: (r.text, r.language, r.language_score, r.given) for r in scorers.identify_language(df, load).collect()}
    assert got == {1: ("Hund\nund Katze", "de", 0.14, "x"), 2: (None, None, None, "y"), 3: ("the cat", "en", 0.07, "z")}


def test_sample_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b, c = ({r.doc_id for r in scorers.sample_documents(docs, 20, s).collect()} for s in (1, 1, 2))
    assert len(a) == 20 and a == b != c


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "b", "y"), (None, "c", "z"), (2, "a", "w"), (None, "a", "v"), (3, None, "u"), (4, None, "t")]
    got = sorted(map(str, ((r.doc_id, r.text, r.lang) for r in dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())))
    assert got == sorted(map(str, [(1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (3, None, "u")]))


def test_the_mask_is_evaluated_once(spark, sf):
    plan = clean.run(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(") == 1 and plan.count("<SSN>") <= 4
