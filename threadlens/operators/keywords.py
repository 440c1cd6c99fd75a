"""Keyword lists of any size (J3): distinct words of the texts, and an index of the keywords by their rarest gram.

A keyword of letters, digits and other characters above ASCII lies inside one word of a text, so such keywords are looked for
once in every distinct word of all texts, and a message has the keywords of its words.  Keywords that hold
a space or another separator are looked for in the whole texts.

Either way a text (or word) that contains a keyword contains every gram (GRAM characters, fewer for
shorter keywords) of it.  Each keyword is filed under the one of its grams that occurs in the fewest texts; a text's grams
fetch the keywords filed under them, and only those are looked for in the text.  Grams are long, so that a
keyword of up to GRAM characters is its own gram and a longer one meets few texts without it.  Keywords one of whose
grams occurs in no text are dropped beforehand.  The keywords are rows of a table, so the plan is the same
for four or a hundred thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

GRAM = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower-cased texts, what words do not hold
KEY_CHARS = 64  # a word of fewer characters is its own key, a longer one has its hash (of so many) as key


def message_text() -> Column:
    """What keywords are looked for in: lower-cased subject, a space, body."""
    return F.lower(F.concat_ws(" ", F.coalesce(F.col("subject"), F.lit("")), F.coalesce(F.col("body"), F.lit(""))))


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of these sizes.  The characters are bound once as a lambda's variable: a gram is
    put together from an array, never searched from the start of the text."""
    def of_size(chars, n):
        last = F.size(chars) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    bound = F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(
        F.concat(*[of_size(chars, n) for n in sizes])))
    return F.get(bound, F.lit(0))


def keyword_index(texts: DataFrame, keywords: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, list_name, keyword): each keyword under its rarest gram.  ``texts``: (.., text)."""
    some = keywords.select("list_name", "keyword").distinct()
    kw_grams = some.select("list_name", "keyword", F.explode(grams(F.col("keyword"), sizes)).alias("gram")) \
        .where(F.length("gram") == F.least(F.length("keyword"), F.lit(max(sizes))))
    seen = texts.select(F.explode(grams(F.col("text"), sizes)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = kw_grams.join(seen.hint("merge"), "gram", "left").groupBy("list_name", "keyword").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    return ranked.where("rarest.n > 0").select("rarest.gram", "list_name", "keyword")


def contained(texts: DataFrame, keywords: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, list_name, keyword) of every keyword contained in a text of ``texts`` (key, text; a row per
    key).  A keyword has one gram and a text each gram once, so no pair is a candidate twice.  Merge joins: what
    grows with texts and keywords is never broadcast, however small its files are."""
    index = keyword_index(texts, keywords, sizes).hint("merge")
    candidates = texts.select("key", F.explode(grams(F.col("text"), sizes)).alias("gram")).join(index, "gram").drop("gram")
    return texts.join(candidates.hint("merge"), "key").where(F.col("text").contains(F.col("keyword"))).select("key", "list_name", "keyword")


def words_of(text: Column, least: int) -> Column:
    """The distinct words of at least so many characters."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(text, SEPARATORS, " "), " ")), lambda w: F.length(w) >= least)


def word_key(word: Column) -> Column:
    return F.when(F.length(word) < KEY_CHARS, word).otherwise(F.sha2(word, 256))


def keyword_table_hits(messages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(message_id, list_name, keyword) for every keyword of the table ``keywords`` (list_name, keyword)
    contained in a message's text; null and empty keywords are left out, and messages without an id.  Messages meet
    the keywords of their words by word; texts cross an exchange only for keywords with separators."""
    # texts are lower-cased: a keyword with A-Z is in none
    keywords = keywords.where("keyword <> ''").where(~F.col("keyword").rlike("[A-Z]")).select(
        "list_name", "keyword", F.col("keyword").rlike(SEPARATORS).alias("separated"))
    # from the shortest keyword on, whatever lengths occur: the plan is the same for few and many
    sizes = {r.separated: list(range(r.n, GRAM + 1)) for r in keywords.groupBy("separated").agg(
        F.min(F.least(F.length("keyword"), F.lit(GRAM))).alias("n")).collect()}
    if not sizes:
        nobody = F.lit(None).cast(messages.schema["message_id"].dataType).alias("message_id")
        return keywords.limit(0).select(nobody, "list_name", "keyword")
    plain, separated = sizes.get(False), sizes.get(True)
    texts = messages.where(F.col("message_id").isNotNull()).select("message_id", message_text().alias("text"))
    words = words_of(F.col("text"), plain[0] if plain else 1).alias("words")
    # rows are numbered in a written table: equal messages stay rows of their own
    rows = written(texts.select(F.monotonically_increasing_id().alias("key"), "message_id", *([words] if plain else []),
                                *(["text"] if separated else [])), "keyword-texts")
    found = []
    if plain:
        held = rows.select(F.col("key").alias("row"), "message_id", F.explode("words").alias("word")) \
            .withColumn("key", word_key(F.col("word")))
        distinct = written(held.select("key", F.col("word").alias("text")).distinct(), "keyword-words")
        of_words = contained(distinct, keywords.where("NOT separated"), plain)
        found.append(held.drop("word").join(of_words.hint("merge"), "key").select("row", "message_id", "list_name", "keyword").distinct())
    if separated:
        of_texts = contained(rows.select("key", "text"), keywords.where("separated"), separated)
        found.append(rows.select("key", "message_id").join(of_texts.hint("merge"), "key")
                     .select(F.col("key").alias("row"), "message_id", "list_name", "keyword"))
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).select("message_id", "list_name", "keyword")
