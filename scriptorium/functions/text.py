"""Text functions as column expressions; Catalyst folds and prunes them like any built-in."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

SPACES = r"(?U)\s+"
TAG = "<[^>]+>"
WORD = r"[\p{L}\p{N}]+"
#: The entities that are decoded, in the order in which they are.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def _bare_letters() -> tuple[str, str]:
    """Latin letters with marks, and the same letters without."""
    marked, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        rest = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(parts) > 1 and len(rest) == 1:
            marked.append(chr(code))
            bare.append(rest)
    return "".join(marked), "".join(bare)


MARKED, BARE = _bare_letters()


def collapsed(text: Column) -> Column:
    """White space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stripped_markup(text: Column) -> Column:
    """Without tags (nothing in their place), with five entities decoded one after the other, white space collapsed."""
    out = F.regexp_replace(text, TAG, "")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return collapsed(out)


def without_marks(text: Column) -> Column:
    """Latin letters without their marks, and no combining marks."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), r"\p{Mn}+", "")


def folded(text: Column) -> Column:
    """Lower case without marks: what full-text terms are compared by.  Sharp s and ligatures stay."""
    return without_marks(F.lower(text))


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def spaced_terms(text: Column) -> Column:
    """The terms of a text in order, in one string with a space between them."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "))


def match_form(text: Column) -> Column:
    """What phrases are matched in: no tags, dotted m and eng made one letter, white space collapsed, case folded.

    The text is taken to be in composed form; ``composed`` brings it there.
    """
    out = F.translate(F.regexp_replace(text, TAG, ""), "ṁŋ", "ṃṃ")
    return F.replace(F.lower(collapsed(out)), F.lit("ß"), F.lit("ss"))


def dotted_above(text: Column) -> Column:
    """m with a dot below written with a dot above, in both cases."""
    return F.translate(text, "ṃṂ", "ṁṀ")


def leading_int(text: Column) -> Column:
    """The whole number that a text begins with, else 0; null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0)))


def without_ordinal(text: Column) -> Column:
    """Without a leading number with a point and a space."""
    return F.trim(F.regexp_replace(text, r"^\d+\.\s+", ""))


def text_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text; null for a blank one."""
    plain = collapsed(text)
    return F.when(plain != "", F.sha2(plain, 256))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading point starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")


def suffix(name: Column) -> Column:
    """The last suffix with its point, in lower case; empty for none."""
    return F.lower(F.regexp_extract(name, r".(\.[^./]+)$", 1))


def title_key(name: Column) -> Column:
    """A file's stem without marks, in lower case, with runs of other than letters and digits as one space."""
    plain = F.replace(F.lower(without_marks(stem(name))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def name_key(name: Column) -> Column:
    """title_key without a copy mark and then a version mark at the end."""
    key = F.trim(F.regexp_replace(title_key(name), r"\s+(?:copy|duplicate)(?:\s+\d+)?$", ""))
    return F.trim(F.regexp_replace(key, r"\s+(?:v|ver|version)\s*\d+$", ""))


#: Names and suffixes that hint at nothing.
STOP_NAMES = ("metadata", "picasa", "index", "contents", "cover", "title")
SKIPPED_SUFFIXES = (".ini", ".opf")


def hint_key(name: Column) -> Column:
    """name_key of a file whose name says something, else empty."""
    key = name_key(name)
    return F.when(suffix(name).isin(*SKIPPED_SUFFIXES) | key.isin(*STOP_NAMES), "").otherwise(key)


def clipped(text: Column, most: int = 200) -> Column:
    """The first `most` characters and how many are left out, of a longer text."""
    more = F.concat(F.substring(text, 1, most), F.lit("… (+"), (F.length(text) - most).cast("string"), F.lit(" more characters)"))
    return F.when(F.length(text) <= most, text).otherwise(more)


def snippet_of_line(line: Column, most: int = 300) -> Column:
    """A trimmed line, cut to `most` characters with three points."""
    plain = F.trim(line)
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 3), F.lit("..."))).otherwise(plain)


def composed(text: Column) -> Column:
    """Text in Unicode composed form, by the ICU library that Spark brings for its collations.

    Characters below U+0300 are in that form and join with nothing, so texts of these alone are not given to it.
    """
    form = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    return F.when(text.rlike(r"[^\x00-\u02FF]"), form).otherwise(text)


def clipped_values(column: Column, kind, most: int = 200) -> Column:
    """A value of a type with every string in it clipped, however deep it lies."""
    if isinstance(kind, StringType):
        return clipped(column, most)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: clipped_values(x, kind.elementType, most))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, v: clipped_values(v, kind.valueType, most))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[clipped_values(column[f.name], f.dataType, most).alias(f.name) for f in kind]))
    return column


def dated_slug(slug: Column, day: Column | None = None) -> Column:
    """A slug with the date before it (today's if not given), unless it begins with one."""
    today = F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd")
    return F.when(slug.rlike(r"^\d{4}-\d{2}-\d{2}-"), slug).otherwise(F.concat_ws("-", today, slug))
