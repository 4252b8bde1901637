"""Lexicon sentiment of whole texts: tokens, lexicon join, normalised sum."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A small valence list for demonstrations; callers pass their own (word, valence) table.
DEMO_LEXICON = {
    "gain": 1.6, "gains": 1.6, "growth": 1.6, "beat": 1.2, "beats": 1.2, "strong": 2.3,
    "profit": 1.9, "record": 1.0, "good": 1.9, "great": 3.1, "upgrade": 1.4, "rally": 1.5,
    "loss": -1.3, "losses": -1.5, "weak": -1.9, "miss": -0.6, "misses": -0.9, "cut": -1.1,
    "cuts": -1.2, "fraud": -2.8, "bad": -2.5, "crash": -1.7, "downgrade": -1.4, "worthless": -1.9,
}
NORMALISER = 15.0
#: About 10 MB in memory.
BROADCAST_WORDS = 200_000


def lexicon_table(spark, words: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(words.items()), "word string, valence double")


def compound(total: Column) -> Column:
    """Sum of valences squeezed into (-1, 1)."""
    return total / F.sqrt(total * total + F.lit(NORMALISER))


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z]+")


def lexicon_sentiment(texts: DataFrame, lexicon: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, compound, n_hits) for every text.

    A text without a lexicon word scores 0; a NULL text has no score. A lexicon of at most ``BROADCAST_WORDS`` words
    (it is counted) is sent to the tasks, which sum a text's words before the shuffle: one row per text and task.
    Beyond that, words are joined by a shuffle.
    """
    if lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        lexicon = F.broadcast(lexicon)
    present = F.col(text).isNotNull()
    words = texts.select(*keys, present.alias("_present"), F.explode_outer(words_of(F.col(text))).alias("word"))
    hits = words.join(lexicon, "word", "left")
    total = F.coalesce(F.sum("valence"), F.lit(0.0))
    return hits.groupBy(*keys).agg(
        F.when(F.bool_or("_present"), compound(total)).alias("compound"), F.count("valence").alias("n_hits")
    )
