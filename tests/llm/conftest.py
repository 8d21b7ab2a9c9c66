import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, kind string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    text = [line, line, line + " end", "", None, "Word", "x" * 30000, " ".join(f"w{i}" for i in range(4000)), f"head\n{line}\n{line}\ntail", "héllo 🙂 wörld\n\n漢字 a@b.co 1.2.3.4", "a  b\t c\n <|endoftext|> x", "token = 'abcdefghijklmnop'"]
    rows = [(i, t, "en", "s", 1, 5, "k", 0.5) for i, t in enumerate(text)]
    rows += [rows[0], rows[9], (None, line, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "other text of id three", "en", "s", 1, 5, "k", 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 0, 1), (7, 1, 0), (7, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    return spark.createDataFrame([(1, long), (2, "w5 W6 w7"), (3, ""), (4, None), (2, "w5 W6 w7"), (None, long)], "item_id long, text string")


def rows_of(df):
    return sorted(map(str, df.collect()))
