"""Parallel passages: groups of references, their texts and translations.

A reference is written ``~uid#range``; ~ says resemblance only.  A uid may be a range of texts, ``sn12.1-2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The widest range that is expanded, and how a range is written.
WIDEST = 400
_RANGE = r"^(.*?)(\d+)-(\d+)$"


def uid_of(ref: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(ref, "^~+", ""), "#", 1))


def is_resemblance(ref: Column) -> Column:
    return ref.startswith("~")


def paragraph_range(ref: Column) -> Column:
    """What follows the first # of a reference; empty for none."""
    return F.trim(F.regexp_extract(ref, "(?s)^[^#]*#(.*)$", 1))


def members(uid: Column) -> Column:
    """The texts of a range uid; an empty array for what is no range, is turned round, too wide, or has no letter first."""
    head, low, high = F.regexp_extract(uid, _RANGE, 1), F.regexp_extract(uid, _RANGE, 2).try_cast("int"), F.regexp_extract(uid, _RANGE, 3).try_cast("int")
    good = uid.rlike(_RANGE) & head.rlike(r"\p{L}") & (high > low) & (high - low <= WIDEST)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(F.sequence(F.when(good, low), F.when(good, high)), lambda n: F.concat(head, n.cast("string")))).otherwise(F.array().cast("array<string>"))


def edges(groups: DataFrame) -> DataFrame:
    """group_id, ord, uid, resemblance, paragraph_range of groups (group_id, parallels array<string>)."""
    rows = groups.select("group_id", F.posexplode("parallels").alias("ord", "ref"))
    return rows.select("group_id", "ord", uid_of(F.col("ref")).alias("uid"), is_resemblance(F.col("ref")).alias("resemblance"), paragraph_range(F.col("ref")).alias("paragraph_range"))


def parallels(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """asked, nth, ref, resemblance, paragraph_range for wanted (asked): what shares a group with each asked text.

    A text is found under its own uid and under a range that holds it; that range is not one of its parallels.  Each ref comes
    once, where it stands first.  One join on the uid finds the groups and one on the group their members.
    """
    e = edges(groups)
    asked = wanted.select(F.lower(F.trim("asked")).alias("asked")).where("asked <> ''").distinct()
    known = e.select("group_id", "uid").union(e.select("group_id", F.explode(members(F.col("uid"))))).distinct()
    at = asked.join(known, asked.asked == known.uid).select("asked", "group_id").distinct()
    found = at.join(e, "group_id").where((F.col("uid") != F.col("asked")) & ~F.array_contains(members(F.col("uid")), F.col("asked")))
    first = found.groupBy("asked", "uid").agg(F.min_by(F.struct("resemblance", "paragraph_range"), F.struct("group_id", "ord")).alias("x"), F.min(F.struct("group_id", "ord")).alias("place"))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy("place")).cast("long")
    return first.select("asked", nth.alias("nth"), F.col("uid").alias("ref"), "x.resemblance", "x.paragraph_range")


LANGUAGES = (("pli", "text_pali"), ("lzh", "text_lzh"), ("san", "text_san"), ("pra", "text_pra"))


def with_texts(found: DataFrame, segments: DataFrame) -> DataFrame:
    """found with the root texts in four languages, the English translation, and text_gaps saying what is missing.

    segments: lang, is_root, uid, ord, text.  Blank segments are left out, the others joined by line ends.
    """
    joined = segments.where(F.trim("text") != "").groupBy("uid", "lang", "is_root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    wide = joined.groupBy("uid").agg(*[F.max(F.when(F.col("is_root") & (F.col("lang") == lang), F.col("text"))).alias(c) for lang, c in LANGUAGES], F.max(F.when(~F.col("is_root") & (F.col("lang") == "en"), F.col("text"))).alias("translation_en"))
    out = found.join(wide, found.ref == wide.uid, "left").drop("uid")
    none = F.coalesce(*[F.col(c) for _, c in LANGUAGES]).isNull()
    gaps = F.array_compact(F.array(F.when(none, "no root text in offline archive"), F.when(F.col("translation_en").isNull(), "no en translation in offline archive")))
    return out.withColumn("text_gaps", gaps)


def preferred(wanted: DataFrame, files: DataFrame, order: tuple[str, ...] = ("patton", "patton_", "bdk"), most: int = 5) -> DataFrame:
    """asked, code, path, translator for the first `most` parallels of each asked text; null where no file has one.

    wanted: asked, nth, code.  files: code, source, path; the source that stands first in `order` wins.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = files.withColumn("rank", rank).where("rank > 0").groupBy("code").agg(F.min_by(F.struct("path", "source"), F.struct("rank", "path")).alias("f"))
    return wanted.where(F.col("nth") <= most).join(best, "code", "left").select("asked", "nth", "code", "f.path", F.col("f.source").alias("translator"))


def overview_code(code: Column) -> Column:
    """The codes to look a card up by, in order: Sn in mixed case may be SNP first."""
    plain = F.translate(F.upper(F.trim(code)), " -_", "")
    letters = F.regexp_extract(F.regexp_replace(code, r"(?U)\s+", ""), "^([A-Za-z]+)", 1)
    mixed = (F.lower(letters) == "sn") & (letters != "SN")
    return F.when(mixed, F.array(F.concat(F.lit("SNP"), F.substring(plain, 3, 99)), plain)).otherwise(F.array(plain))


def overviews(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """asked and the first card (card_code, fields map<string, array<string>>) that one of its codes names."""
    asked = wanted.select("asked", F.posexplode(overview_code(F.col("asked"))).alias("nth", "card_code"))
    return asked.join(cards, "card_code").groupBy("asked").agg(F.min_by(F.struct("card_code", "fields"), "nth").alias("c")).select("asked", "c.card_code", "c.fields")
