import pytest

from kiln.functions import words


@pytest.mark.parametrize(("word", "stem"), [x.split(":") for x in "dies:die died:die dying:die lies:lie skies:sky flying:fli say:say enjoy:enjoy happy:happi ponies:poni cried:cri tied:tie news:news proceed:proceed generally:gener hopefully:hope psychology:psycholog possibly:possibl running:run agreed:agre controlling:control owed:owe innings:inning relational:relat at:at bled:bled feed:feed".split()])
def test_extended_stems(word, stem):
    assert words.porter_stem(word) == stem


@pytest.mark.parametrize(("word", "stem"), [x.split(":") for x in "dies:di say:sai enjoy:enjoi news:new conformabli:conform ponies:poni hopping:hop".split()])
def test_rules_of_1980(word, stem):
    assert words.porter_stem(word, extended=False) == stem


def test_irregular_nouns(spark):
    v = spark.createDataFrame([(x,) for x in ("geese", "mice", "dogs", "dog", "glass", "wolves", "wolf", "novel")], "token string")
    got = {r.token: r.lemma for r in words.lemmas(v).collect()}
    assert got == {"geese": "goose", "mice": "mouse", "dogs": "dog", "dog": "dog", "glass": "glass", "wolves": "wolf", "wolf": "wolf", "novel": "novel"}
    own = spark.createDataFrame([("novel", "book"), ("novel", "story")], "token string, base string")
    assert {r.token: r.lemma for r in words.lemmas(v, exceptions=own).collect()}["novel"] == "book"
