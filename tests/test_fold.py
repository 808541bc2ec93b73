import re

import pytest
from pyspark.sql import functions as F

from kiln.functions import text as tx
from kiln.operators.index import tokenise

CASES = {
    "Москва и Щёлково": "Moskva i Shchiolkovo",
    "Юлия Чехов": "Iuliia Chekhov",
    "Αθήνα Ψυχή φως": "Athena Psukhe phos",
    "ＦＵＬＬ　width１２": "FULL　width12",
    "x² + y₃": "x2 + y3",
    "oﬃce ﬁne Ⅷ": "office fine VIII",
    "naïve Łódź Straße Æsir": "naive Lodz Strasse AEsir",
    "a–b — “c” d’e…": "a-b -- \"c\" d'e...",
    "Ước tiếng Việt": "Uoc tieng Viet",
    "日本 plain": "日本 plain",
    "": "",
}


def test_fold_of_any_script(spark):
    d = spark.createDataFrame(list(enumerate(CASES)), "i int, text string")
    got = {r.text: r.f for r in d.select("text", tx.ascii_fold(F.col("text")).alias("f")).collect()}
    assert got == CASES
    assert spark.range(1).select(tx.ascii_fold(F.lit(None).cast("string")).alias("f")).first().f is None


def test_every_target_is_ascii():
    assert len(tx.FOLD_FROM) == len(tx.FOLD_TO) == len(set(tx.FOLD_FROM)) and tx.FOLD_TO.isascii()
    assert all(v.isascii() and not k.isascii() for k, v in tx.FOLD_SEVERAL.items()) and not set(tx.FOLD_SEVERAL) & set(tx.FOLD_FROM)
    assert all(re.match(tx.SEVERAL, k) for k in tx.FOLD_SEVERAL)


@pytest.mark.parametrize(("text", "tokens"), [("Привет Мир", ["privet", "mir"]), ("jeu–concours Ⅷ", ["jeu-concours", "viii"])])
def test_tokens_of_other_scripts(spark, text, tokens):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokenise(d).first().tokens == tokens
