import pytest
from pyspark.sql import functions as F

from lexivane.functions.text import tokenize, tokenize_text

CASES = [
    ("", None, []),
    (" -- ~ ;; ", None, []),
    ("Harbour LIGHTS", None, ["harbour", "lights"]),
    ("pier7b", None, ["pier7b"]),
    ("out-of-season", (), ["out", "of", "season"]),
    ("out-of-season", None, ["out", "season"]),
    ("tide_table", None, ["tide", "table"]),
    ("A boat in the bay and to sea", None, ["boat", "bay", "sea"]),
    ("a BOAT, the Bay", ("BAY",), ["a", "boat", "the"]),
    ("سـفيـنة", None, ["سفينة"]),
    ("أمل إبل آخر ٱسم", None, ["امل", "ابل", "اخر", "اسم"]),
    ("مرسى", None, ["مرسي"]),
    ("٧ ٢٥ ٠", None, ["7", "25", "0"]),
    ("ميناء سفينة", None, ["ميناء", "سفينة"]),
    ("سَفِينَةٌ كُبْرَى", None, ["سفينة", "كبري"]),
    ("Kai، مَوْج ٣", None, ["kai", "موج", "3"]),
    ("Straße Ñandú", None, ["straße", "ñandú"]),
]


def test_column_and_driver_tokenizers(spark):
    for stop in {c[1] for c in CASES}:
        own = [c for c in CASES if c[1] == stop]
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(own)], "i int, t string")
        got = {r["i"]: r["x"] for r in df.select("i", tokenize(F.col("t"), stop).alias("x")).collect()}
        for i, (text, _, want) in enumerate(own):
            assert got[i] == want, text
            assert tokenize_text(text, stop) == want, text


def test_null_text_has_no_terms(spark):
    assert spark.sql("select cast(null as string) t").select(tokenize(F.col("t")).alias("x")).first()["x"] == []


@pytest.mark.parametrize("text", ["x" * 100_000, "a " * 50_000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokenize(F.col("t"), ()).alias("x")).first()["x"] == text.split()
