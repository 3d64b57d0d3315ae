"""Languages of scripts beyond the common ones, and a script for every letter."""

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from datagauge.llm import language, words


def test_every_letter_has_a_script():
    letters = [chr(p) for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p))[0] == "L"]
    got = np.concatenate([language._scripts(piece) for piece in words.pieces(pa.array(letters))])
    assert len(got) == len(letters) and (got > 0).all() and got.max() < language._SCRIPTS
    one = dict(zip(letters, got.tolist()))
    assert len({one[c] for c in "aяλאعกកລမአᠮꀀᎣ"}) == 13 and one["ﬁ"] == one["ａ"] == one["a"] and one["ﺍ"] == one["ع"]


def test_languages_of_further_scripts(spark):
    train = [
        ("en", "the cat sat on the mat and then the dog came " * 50), ("lo", "ແມວ ນັ່ງ ຢູ່ ເທິງ ເສື່ອ ແລະ ຫມາ ມາ " * 5), ("km", "ឆ្មា អង្គុយ លើ កន្ទេល និង ឆ្កែ " * 5),
        ("am", "ድመት ምንጣፍ ላይ ተቀመጠ ውሻ መጣ እና ነው " * 5), ("ti", "ድሙ ኣብ ልዕሊ ምንጻፍ ኮፍ ኢሉ ከልቢ መጺኡ " * 5),
    ]
    model = language.train(spark.createDataFrame(train, "lang string, text string"))
    texts = ["ແມວ ນັ່ງ ຢູ່", "ឆ្មា និង ឆ្កែ cat", "ውሻ መጣ እና ድመት", "ከልቢ መጺኡ ድሙ ኮፍ ኢሉ", "the dog ແມວ came", "ᠮᠣᠩᠭᠣᠯ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["x"] for r in rows.select("i", language.label_languages(model, F.col("text"), penalty=1.0).alias("x")).orderBy("i").collect()]
    assert [g["lang"] for g in got] == ["lo", "km", "am", "ti", "en", "en"]
    assert [round(g["score"], 2) for g in got] == [1.0, 0.75, 1.0, 1.0, 0.75, 0.0]
