"""Lookups in dictionaries: headwords, inflected forms, roots, and books under their several codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns under which a book can be asked for.
BOOK_CODES = ("cst_filename", "cst_book_name", "gui_book_code", "dpd_book_code")


def headwords(words: DataFrame, prefix: str, column: str = "lemma_1") -> DataFrame:
    """Words that begin with a prefix, case aside."""
    return words.where(F.lower(column).startswith(prefix.lower()))


def inflected(forms: DataFrame, wanted: DataFrame, words: DataFrame) -> DataFrame:
    """form and the columns of words for each id in the JSON list `headwords` of the wanted forms (form)."""
    ids = forms.join(wanted, forms.lookup_key == wanted.form).select("form", F.explode(F.from_json("headwords", "array<bigint>")).alias("id"))
    return ids.join(words, "id")


def with_root(words: DataFrame, roots: DataFrame) -> DataFrame:
    """words with the columns of their root, null where it isn't there."""
    return words.join(roots, "root_key", "left")


def books(asked: DataFrame, table: DataFrame) -> DataFrame:
    """asked and the columns of each book that has the asked value under any of its codes; ``stem_type`` counts as
    ``stem.type``.  One code may stand for several books."""
    query = F.when(~F.contains("asked", F.lit(".")) & F.col("asked").rlike("^.+_(mul|att|tik|nrf)$"), F.regexp_replace("asked", "_(mul|att|tik|nrf)$", ".$1")).otherwise(F.col("asked"))
    codes = table.select("*", F.explode(F.array_distinct(F.array(*[F.col(c) for c in BOOK_CODES]))).alias("code"))
    return asked.select("asked", query.alias("code")).where("asked <> ''").join(codes, "code").select("asked", *BOOK_CODES, F.replace("cst_filename", F.lit("."), F.lit("_")).alias("cst_table"))


def metadata_prefix(books_: DataFrame, data: DataFrame, authors: DataFrame, author_links: DataFrame, tags: DataFrame, tag_links: DataFrame) -> DataFrame:
    """path and prefix of each stored format of a book: its number, authors and tags, empty parts left out."""
    by_author = author_links.join(authors, author_links.author == authors.id).groupBy("book").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("author_names"))
    by_tag = tag_links.join(tags, tag_links.tag == tags.id).groupBy("book").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("tag_names"))
    all_ = data.join(books_, data.book == books_.id).join(by_author, "book", "left").join(by_tag, "book", "left")
    parts = F.array_compact(F.array(F.concat(F.lit("Calibre #"), F.col("book").cast("string")), F.concat(F.lit("Authors: "), F.nullif("author_names", F.lit(""))), F.concat(F.lit("Tags: "), F.nullif("tag_names", F.lit("")))))
    return all_.select(F.concat_ws("/", "path", F.concat("name", F.lit("."), F.lower("format"))).alias("path"), F.concat(F.lit("["), F.array_join(parts, " | "), F.lit("]")).alias("prefix"))
