import pytest
from pyspark.sql import functions as F

from sparkloom.functions.dsl import boolean_column, filter_column, normalize, tokenize
from sparkloom.functions.scalars import code_words, glob_regex, language, money_of, plain_number


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "rust", 50, "a and b"), (2, "rust", 500, "x"), (3, "Python", 200, None)], "id int, lang string, loc int, note string")


FIELDS = {"lang": "lang", "language": "lang", "loc": "loc", "lines": "loc", "note": "note"}


@pytest.mark.parametrize("text, want", [("lang = rust AND loc > 100", [2]), ("lines <= 200", [1, 3]), ("lang LIKE pyth", [3]), ("loc != 50", [2, 3]), ("", [1, 2, 3]), ("note = 'x'", [2]), ("lang LIKE 'r%t'", [1, 2])])
def test_filter(rows, text, want):
    assert [r["id"] for r in rows.where(filter_column(text, FIELDS)).orderBy("id").collect()] == want


@pytest.mark.parametrize("text", ["size > 3", "lang", "lang ~ x", "lang = "])
def test_filter_refuses(text):
    with pytest.raises(ValueError):
        filter_column(text, FIELDS)


@pytest.mark.parametrize("text, want", [("lang:rust NOT loc:50", [2]), ("lang:python OR loc:50", [1, 3]), ("(lang:rust OR lang:python) AND loc:200", [3]), ('note:"a and b"', [1]), ("NOT note:x", [1, 3]), ("pyth", [3]), ("", [1, 2, 3])])
def test_boolean(rows, text, want):
    assert [r["id"] for r in rows.where(boolean_column(text, FIELDS)).orderBy("id").collect()] == want


@pytest.mark.parametrize("text", ["(lang:rust", "lang:rust OR", "nope:1", "lang:rust )"])
def test_boolean_refuses(text):
    with pytest.raises(ValueError):
        boolean_column(text, FIELDS)


def test_text_forms():
    assert tokenize('a:b (c "d e")') == ["a:b", "(", "c", '"d e"', ")"]
    assert normalize("a  b or ( not c )") == "a AND b OR (NOT c)"


@pytest.mark.parametrize("text, want", [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", 1234), ("12,5", 12.5), ("1.234.567", 1234567), ("7", 7)])
def test_numbers(text, want):
    assert plain_number(text) == want


def test_money():
    found = money_of("é R$ 1.500,00, US$ 2 million, then 3 billion euros, not 5% of $7%")
    assert [(x["amount"], x["currency"]) for x in found] == [(1500, "BRL"), (2e6, "USD"), (3e9, "EUR")]
    assert found[0]["start"] == 3 and money_of("") == [] and money_of(None) == []


def test_paths(spark):
    import re

    assert re.match(glob_regex("src/**/*.rs"), "src/a/b/x.rs") and re.match(glob_regex("src/**/*.rs"), "src/x.rs")
    assert not re.match(glob_regex("src/*.rs"), "src/a/x.rs")
    d = spark.createDataFrame([("a/b.rs",), ("Makefile",), ("x.unknown",)], "p string").select(language("p").alias("l"))
    assert [r["l"] for r in d.collect()] == ["rust", None, None]
    w = spark.createDataFrame([("parseHTTPRequest2_fooBar/x",)], "p string").select(code_words("p").alias("w")).first()["w"]
    assert w == ["parse", "http", "request2", "foo", "bar", "x"]
