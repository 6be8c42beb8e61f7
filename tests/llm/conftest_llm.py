import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = {
    "en": "the of and to in that is was for with house river morning people answer children window between garden several thought",
    "de": "der die und das nicht ist ein mit sich auf haus fluss morgen leute antwort kinder fenster zwischen garten mehrere gedanke",
    "fr": "le la les et des est une dans pour que maison rivière matin gens réponse enfants fenêtre entre jardin plusieurs pensée",
}


def sentence(lang: str, seed: int, n: int = 60) -> str:
    """Invented prose: the words of a language in an order that the seed gives."""
    words = WORDS[lang].split()
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(words[(x >> 8) % len(words)])
        if i % 12 == 11:
            out[-1] += "." if i % 24 == 11 else ",\n"
    return " ".join(out)


#: Nulls, empty and blank texts, one very long text, no words, repeated rows, ties in the text, invalid-looking characters.
ODD = [
    (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, "x", "en", "a", 1), (5, "12 34 !!", "en", "a", 8), (6, "the house " * 30_000, "en", "b", None), (7, "a\x00b \U0001f600 ñandú\u00a0x\r\n\r\n", "fr", "b", 1),
    (8, "same text in two rows", "en", "c", 1), (8, "same text in two rows", "en", "c", 1), (9, "same text in two rows", "de", "c", 1), (8, "another text of the same id", "en", "c", 1), (None, "no id at all", "en", None, None), (None, "no id at all", "en", None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose(spark):
    rows = [(i, sentence(lang, i), lang, "s", 1) for i, lang in enumerate(["en", "de", "fr"] * 50)]
    return spark.createDataFrame(rows, SCHEMA)
