"""Text measures of a page body.

White space is the class that JavaScript's ``\\s`` means. :func:`plain_spaces` turns the members
outside ASCII into blanks first, so that the measures can use short ASCII patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE_SPACE = (
    r"[\u00a0-\uffff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
)
_CONSONANT = "[bcdfghjklmnpqrstvwxz]"


def plain_spaces(text: Column) -> Column:
    """Every white-space character outside ASCII becomes a blank; the length stays the same."""
    return F.when(text.rlike(WIDE_SPACE), F.regexp_replace(text, WIDE_SPACE, " ")).otherwise(text)


def squeeze(plain: Column) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def special_characters(plain: Column) -> Column:
    return F.length(F.regexp_replace(plain, r"[a-zA-Z0-9\s]+", ""))


def punctuation_marks(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^.,;:!?]+", ""))


def sentences(clean: Column) -> Column:
    """Sentences of squeezed text that have three characters and a letter."""
    parts = F.split(clean, r"[.!?]++(?: |$)", -1)
    return F.filter(parts, lambda s: (F.length(F.trim(s)) >= 3) & s.rlike("[a-zA-Z]"))


def word_count(clean: Column) -> Column:
    """Words of squeezed text; a word has a letter or digit.

    All pieces less the few without one: ``regexp_count`` would build an array of every match.
    """
    padded = F.concat(F.lit(" "), clean, F.lit(" "))
    blanks = F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))
    wordless = F.regexp_count(padded, F.lit(" [^ a-zA-Z0-9]++(?= )"))
    return F.when(clean == "", 0).otherwise(blanks - 1 - wordless)


def words_per_sentence(kept: Column) -> Column:
    """Mean number of words of the given sentences, 0 for none."""
    joined = F.array_join(F.transform(kept, lambda s: F.trim(s)), " ")
    return F.coalesce(F.try_divide(word_count(joined), F.size(kept)), F.lit(0.0))


def syllables_of_word(word: Column) -> Column:
    """Syllables of one word: vowel groups, silent final e, consonant + le, at least one."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = (letters.endswith("e") & (groups > 1)).cast("int")
    ending = letters.rlike(f"{_CONSONANT}le$").cast("int")
    return (
        F.when(F.length(letters) == 0, 0)
        .when(F.length(letters) <= 3, 1)
        .otherwise(F.greatest(groups - silent + ending, F.lit(1)))
    )


def letter_words(clean: Column) -> Column:
    """Lower-case words of squeezed text with nothing but a-z kept."""
    return F.split(F.regexp_replace(F.lower(clean), "[^a-z ]+", ""), " +")


def long_words(words: Column) -> Column:
    """Words of more than three letters, each followed by a blank, as one string."""
    return F.concat(
        F.lit(" "), F.array_join(F.filter(words, lambda w: F.length(w) > 3), " "), F.lit(" ")
    )


def syllables(words: Column, longer: Column) -> Column:
    """Sum of :func:`syllables_of_word`, by counting patterns over all long words in one go.

    ``words`` comes from :func:`letter_words` and ``longer`` from :func:`long_words`; a word of one
    to three letters counts one.
    """
    short = F.size(F.filter(words, lambda w: F.length(w).between(1, 3)))

    def count(pattern: str) -> Column:
        return F.regexp_count(longer, F.lit(pattern))

    gaps = F.regexp_replace(longer, "[^aeiouy]+", " ")
    groups = F.length(gaps) - F.length(F.replace(gaps, F.lit(" "), F.lit(""))) - 1
    return (
        short
        + groups
        - count(rf"[aeiouy]{_CONSONANT}++[aeiouy]*e(?= )")
        + count(rf"{_CONSONANT}le(?= )")
        + count(rf" {_CONSONANT}++(?= )")
    )


def half_up(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def flesch(n_sentences: Column, n_words: Column, n_syllables: Column) -> Column:
    """Flesch reading ease, two decimals; 0 without a sentence or a word."""
    score = (
        F.lit(206.835)
        - F.lit(1.015) * F.try_divide(n_words, n_sentences)
        - F.lit(84.6) * F.try_divide(n_syllables, n_words)
    )
    return F.coalesce(half_up(score, 2), F.lit(0.0))


def with_readability(df: DataFrame, clean: str, kept: str) -> DataFrame:
    """Add readability_score, avg_sentence_len and the counts behind them.

    ``clean`` holds squeezed text and ``kept`` its sentences. Each step is a column of its own, so
    nothing is computed twice.
    """
    return (
        df.withColumns(
            {
                "n_words": word_count(F.col(clean)),
                "n_sentences": F.size(kept),
                "avg_sentence_len": words_per_sentence(F.col(kept)),
                "_words": letter_words(F.col(clean)),
            }
        )
        .withColumn("_long_words", long_words(F.col("_words")))
        .withColumn("n_syllables", syllables(F.col("_words"), F.col("_long_words")))
        .withColumn(
            "readability_score",
            flesch(F.col("n_sentences"), F.col("n_words"), F.col("n_syllables")),
        )
        .drop("_words", "_long_words")
    )


def unique_words_ratio(pieces: Column) -> Column:
    """Distinct share of the lower-case white-space pieces, empty edge pieces included."""
    return F.size(F.array_distinct(pieces)) / F.size(pieces)
