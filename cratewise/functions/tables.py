"""Rule lists as tables: rows (list, priority, pattern, value), applied in the order of priority.

A table is configuration: MOST_RULES rows at most, an error beyond. Its rows become expressions, so a user's row works
like a built-in one, and data meets no rule by a join.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.functions import rules
from cratewise.functions.text import Text

SCHEMA = "list string, priority double, pattern string, value string"
#: Lists of patterns by the names that tables give them, and the list of words that tell a genre.
LISTS = {
    "site": "SITE_PATTERNS", "promotion": "PROMO_PATTERNS", "kept": "KEPT_PATTERNS", "polluted": "POLLUTED", "download": "DOWNLOAD_PATTERNS", "strict_site": "STRICT_SITES",
    "strict_word": "STRICT_WORDS", "domain": "DOMAINS", "mix_label": "MIX_LABELS", "stop_word": "STOP_WORDS", "comment_keyword": "COMMENT_KEYWORDS",
}
GENRE = "genre_word"
MOST_RULES = 2_000


def defaults(spark: SparkSession) -> DataFrame:
    """The built-in lists; priorities count from 0 in each."""
    rows = [(name, float(n), p, None) for name, own in LISTS.items() for n, p in enumerate(getattr(rules, own))]
    words = [(word, genre) for genre, own in rules.GENRE_WORDS for word in own]
    return spark.createDataFrame([*rows, *((GENRE, float(n), word, genre) for n, (word, genre) in enumerate(words))], SCHEMA)


def ordered(table: DataFrame, name: str | None = None) -> list:
    """A table's rows (of one list), by priority, then pattern."""
    rows = table.select("list", F.col("priority").cast("double").alias("priority"), "pattern", "value").where("list IS NOT NULL AND pattern IS NOT NULL AND pattern <> ''")
    found = (rows if name is None else rows.where(F.col("list") == name)).orderBy("list", "priority", "pattern").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"a rule table has {MOST_RULES} rows at most")
    return found


def text_with(table: DataFrame) -> Text:
    """Text functions with a table's lists; a list without a row is empty."""
    found = ordered(table)
    lists = {own: [r["pattern"] for r in found if r["list"] == name] for name, own in LISTS.items()}
    rest = {n: getattr(rules, n) for n in dir(rules) if n.isupper() and n not in lists}
    return Text(lists=SimpleNamespace(**rest, **lists))


def genre_of(text: Column, table: DataFrame, other: str = "Indian") -> Column:
    """The genre of the first rule, by priority, whose word stands in the text."""
    found = ordered(table, GENRE)
    hits = F.array(*(F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(r["pattern"])), F.struct(F.lit(n).alias("at"), F.lit(r["value"]).alias("value"))) for n, r in enumerate(found)))
    return F.coalesce(F.array_min(F.array_compact(hits))["value"], F.lit(other)) if found else F.lit(other)
