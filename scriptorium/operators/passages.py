"""Ordered rows of books: owners, headings, nearest earlier entries, ranges, and phrase search.

Segments have: book_code, id (rising in a book), rend, paranum ('' on a continuation), and texts.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

HEADINGS = ("chapter", "title", "subhead")


#: Positions that are put in order in one task; a key with more rows than this is dealt to several.
BLOCK = 20_000


def with_carried(df: DataFrame, part: list[str], position: Column, values: dict[str, Column], ties: tuple[Column, ...] = (), width: float = BLOCK, strict: bool = True) -> DataFrame:
    """df and, for each of `values`, its last non-null value in earlier rows of the same part, by a numeric position.

    Rows are put in order in blocks of `width` positions, so no task gets all rows of a key, however many it has.  The last
    values of each block are carried over the blocks, of which there are few, and joined to the rows that found none in their own.
    strict: the row itself does not count.  ties: what orders rows of one position.
    """
    held = df.withColumns({"__at": position, "__block": F.floor(position / width), **{f"__v_{k}": v for k, v in values.items()}})
    inside = Window.partitionBy(*part, "__block").orderBy("__at", *ties).rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    order = F.struct("__at", *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    ends = held.groupBy(*part, "__block").agg(*[F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), order)).alias(f"__e_{k}") for k in values])
    over = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(c).alias(f"__p_{c}") for c in part], F.col("__block").alias("__p_block"), *[F.last(f"__e_{k}", ignorenulls=True).over(over).alias(f"__c_{k}") for k in values])
    same = F.col("__block") == F.col("__p_block")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    found = held.withColumns({f"__i_{k}": F.last(f"__v_{k}", ignorenulls=True).over(inside) for k in values})
    return found.join(carry, same, "left").select(*df.columns, *[F.coalesce(f"__i_{k}", f"__c_{k}").alias(k) for k in values])


def with_owner(segments: DataFrame, part: str = "book_code", order: str = "id", number: str = "paranum") -> DataFrame:
    """segments and owner: the row's own number, else that of the nearest earlier row that has one, else ''."""
    own = F.when(F.col(number) != "", F.col(number))
    return with_carried(segments, [part], F.col(order), {"owner": own}).withColumn("owner", F.coalesce(own, "owner", F.lit("")))


def with_next_owner(segments: DataFrame, part: str = "book_code", order: str = "id", number: str = "paranum") -> DataFrame:
    """segments and next_owner: the number of the nearest later row that has one; null for none."""
    return with_carried(segments, [part], -F.col(order), {"next_owner": F.when(F.col(number) != "", F.col(number))})


def with_headings(segments: DataFrame, part: str = "book_code", order: str = "id", text: str = "pali_text", rend: str = "rend") -> DataFrame:
    """segments with sections (the chapter, title and subhead above each row), near (the nearest heading of any level, '' for none)
    and book_title.

    A level counts only if it stands after the level found above it; blank headings and the book's own title are left out
    of the list, though a blank one still bounds the next level.
    """
    plain = T.stripped_markup(F.coalesce(F.col(text), F.lit("")))
    levels = {f"__{h}": F.when(F.col(rend) == h, F.struct(F.col(order).alias("at"), plain.alias("text"))) for h in HEADINGS}
    out = with_carried(segments, [part], F.col(order), {**levels, "near": F.when(F.col(rend).isin(*HEADINGS), plain)})
    titles = segments.where(F.col(rend) == "book").groupBy(F.col(part).alias("__book")).agg(F.min_by(plain, order).alias("book_title"))
    out = out.join(titles, F.col(part) == F.col("__book"), "left").drop("__book").withColumns({"book_title": F.coalesce("book_title", F.lit("")), "near": F.coalesce("near", F.lit(""))})
    floor, parts = F.lit(-1).cast("long"), []
    for h in HEADINGS:
        kept = F.col(f"__{h}")["at"] > floor
        parts.append(F.when(kept & (F.col(f"__{h}")["text"] != "") & (F.col(f"__{h}")["text"] != F.col("book_title")), F.col(f"__{h}")["text"]))
        floor = F.when(kept, F.col(f"__{h}")["at"]).otherwise(floor)
    return out.withColumn("sections", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop(*[f"__{h}" for h in HEADINGS])


def heading_candidates(segments: DataFrame, number: int) -> DataFrame:
    """book_code, ord, heading: for each row of that number the nearest heading of any level, runs of the same taken once."""
    out = with_headings(segments)
    named = out.where((T.leading_int(F.col("paranum")) == number) & (F.col("near") != "") & (F.col("near") != F.col("book_title")))
    order = Window.partitionBy("book_code").orderBy("id")
    once = named.withColumn("previous", F.lag("near").over(order)).where("not (near <=> previous)")
    return once.select("book_code", F.row_number().over(order).cast("long").alias("ord"), F.col("near").alias("heading"))


def nearest_earlier(probes: DataFrame, entries: DataFrame, keys: list[str], at: str, start: str, ties: list[Column], value: list[str], blocks: int = 200) -> DataFrame:
    """probes with the columns `value` of the entry of the same keys that starts last at or before `at`; null for none.

    Both sides are brought in one order by (keys, position), entries before probes, and the last entry is carried on: no pairs,
    however many entries a key has, and no task with all rows of a key.  Of entries with one start the first by `ties` wins.
    at and start are numbers (exact up to 2^53) or times; blocks: into how many equal parts their range is cut.
    """
    best = F.min(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)], *[F.col(v).alias(f"v_{v}") for v in value])).alias("__best")
    one = entries.where(F.col(start).isNotNull()).groupBy(*keys, start).agg(best)
    kind = _value_type(one, value)
    left = probes.select(*keys, _number(probes, at).alias("__pos"), F.lit(1).alias("__side"), F.struct("*").alias("__probe"), F.lit(None).cast(kind).alias("__entry"))
    right = one.select(*keys, _number(one, start).alias("__pos"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), F.struct(*[F.col("__best")[f"v_{v}"].alias(v) for v in value]).alias("__entry"))
    ends = entries.select(_number(entries, start).alias("x")).agg(F.min("x"), F.max("x")).first()
    width = max((ends[1] - ends[0]) / blocks, 1e-6) if ends[0] is not None else 1.0
    # A probe before all entries, or without a position, stands in a block of its own end.
    both = left.withColumn("__pos", F.least(F.greatest(F.coalesce("__pos", F.lit((ends[0] or 0.0) - 1)), F.lit((ends[0] or 0.0) - 1)), F.lit((ends[1] or 0.0) + 1))).unionByName(right)
    found = with_carried(both, keys, F.col("__pos"), {"__found": F.col("__entry")}, (F.col("__side"),), width, strict=False).where("__side = 1")
    return found.select("__probe.*", *[F.col("__found")[v].alias(v) for v in value])


def _number(df: DataFrame, column: str) -> Column:
    """A number or a time as a number."""
    kind = df.schema[column].dataType.simpleString()
    return (F.col(column).cast("timestamp") if kind in ("date", "timestamp_ntz") else F.col(column)).cast("double")


def _value_type(one: DataFrame, value: list[str]) -> object:
    """The type of the chosen values."""
    return one.select(F.struct(*[F.col("__best")[f"v_{v}"].alias(v) for v in value]).alias("x")).schema["x"].dataType


def within_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, step: int = 64) -> DataFrame:
    """Pairs of points and ranges with equal keys (nulls equal) and low <= at <= high.

    A range is dealt into blocks of a size that suits its width (step, or that times a power of 16), so into 17 at most, and
    joined by equality on block and size; no pair outside a block is made.  The sizes in use, 13 at most, are asked for at once.
    """
    sizes = F.array(*[F.lit(step * 16**k).cast("long") for k in range(13) if step * 16**k < 1 << 55])
    width = F.element_at(F.filter(sizes, lambda x: x >= (F.col(high) - F.col(low)) / 16), 1)
    sized = ranges.where(F.col(low) <= F.col(high)).withColumn("__size", F.coalesce(width, F.element_at(sizes, -1)))
    blocks = sized.withColumn("__block", F.explode(F.sequence(F.floor(F.col(low) / F.col("__size")), F.floor(F.col(high) / F.col("__size")))))
    right = blocks.select(*[F.col(k).alias(f"__{k}") for k in keys], "__block", "__size", *[c for c in ranges.columns if c not in keys])
    used = sorted(r[0] for r in blocks.select("__size").distinct().collect())
    left = points.withColumn("__at_size", F.explode(F.array(*[F.lit(x) for x in used]).cast("array<bigint>"))).withColumn("__at_block", F.floor(F.col(at) / F.col("__at_size")))
    on = (F.col("__at_block") == F.col("__block")) & (F.col("__at_size") == F.col("__size"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on & F.col(at).between(F.col(low), F.col(high))).drop("__block", "__size", "__at_block", "__at_size", *[f"__{k}" for k in keys])


def glob_pattern(spec: str) -> str:
    """The anchored regular expression of a case-sensitive glob with * ? and [sets]."""
    out, k = "", 0
    while k < len(spec):
        c = spec[k]
        end = spec.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = spec[k + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def chosen_books(books: DataFrame, specs: list[str] | None, column: str = "book_code") -> DataFrame:
    """(book_code, book_ord): the books that the specifiers name, in their order and then by name, each once.

    A specifier with * or ? is a glob, any other an exact name; names that aren't there are left out.  None stands for the
    books that begin with s and end in _mul.
    """
    names = books.select(F.col(column).alias("book_code")).distinct()
    if specs is None:
        picked = names.where(F.col("book_code").startswith("s") & F.col("book_code").endswith("_mul")).withColumn("nth", F.lit(0))
    else:
        tests = [F.when(F.col("book_code").rlike(glob_pattern(s)) if re.search(r"[*?]", s) else F.col("book_code") == s, F.lit(k)) for k, s in enumerate(specs)]
        picked = names.withColumn("nth", F.coalesce(*tests, F.lit(None)) if tests else F.lit(None).cast("int")).where("nth is not null")
    return picked.select("book_code", (F.row_number().over(Window.orderBy("nth", "book_code")) - 1).cast("long").alias("book_ord"))


def find_phrase(segments: DataFrame, phrase: str, columns: tuple[str, ...] = ("pali_text", "english_translation"), limit: int = 50, order: tuple[str, ...] = ("book_code", "id")) -> DataFrame:
    """The first `limit` rows, in order, in which a column holds the phrase in match form; a blank phrase finds nothing.

    Owners are filled in before rows are chosen, since a continuation's owner may itself not match.  Phrase and texts are
    brought to composed form, so it doesn't matter how either writes its accents.
    """
    needle = T.match_form(F.lit(unicodedata.normalize("NFC", phrase)))
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(T.match_form(T.composed(F.coalesce(F.col(c), F.lit("")))), needle)
    # Rows without a hit only lend their numbers: their texts go no further than the test.
    slim = segments.select("book_code", "id", "paranum", F.when(test & (needle != ""), F.struct("*")).alias("__row"))
    found = with_owner(slim).where("__row is not null").select("__row.*", "owner")
    return found.orderBy(*order).limit(limit)


def lines_with(files: DataFrame, needle: str, path: str = "path", text: str = "text", limit: int | None = None) -> DataFrame:
    """path, line, snippet of the lines that hold a fixed string, by path and line; an empty one is in every line."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")).alias("at", "line_text"))
    found = rows.where(F.contains("line_text", F.lit(needle))).select("path", (F.col("at") + 1).cast("long").alias("line"), T.snippet_of_line(F.col("line_text")).alias("snippet"))
    return found if limit is None else found.orderBy("path", "line").limit(limit)


def id_window(segments: DataFrame, first: int, last: int, before: int = 50, after: int = 200, text: str = "pali_text") -> DataFrame:
    """The rows with text from `before` ids ahead of a cluster of hits to `after` behind it, by id."""
    return segments.where(F.col("id").between(first - before, last + after) & (F.coalesce(F.col(text), F.lit("")) != "")).orderBy("id")
