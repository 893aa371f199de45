import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LANGUAGE = {"en": "the and of with hearing other stone water", "de": "und der schön über nicht wald straße weg",
            "ru": "и не что вода камень дорога лес река", "el": "και το νερό δρόμος δάσος ποτάμι πέτρα φως"}


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in all columns, empty and blank texts, a very long text, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977} the and" for i in range(40_000))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "b"), (4, "one", "en", "a"), (5, "one", "en", "a"),
            (6, "one two", "en", "a"), (7, long, "en", "a"), (8, long + " end", "en", None), (9, "!!! ... 123", "de", "b"),
            (10, "x" * 5000, "en", "b"), (11, "İ ẞ 中文 日本 \u0000 zero", "en", "ä"), (12, "one", "en", "a"), (12, "one", "en", "a"),
            (None, "one two", None, None)]
    return spark.createDataFrame([(*r, 7, 7, "k", 1, "s", 1.5, 0, "p") for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n bigint, size bigint, class string, bucket int, "
                                 "score string, linear double, place int, spans string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
