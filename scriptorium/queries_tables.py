"""Queries of operators on books, citations, parallels, dictionaries, notes and names, over relations derived from whole tables.

The columns of a relation are expressions that Spark and DuckDB both read; what the operator makes of it is computed in SQL
there.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align, citations, lexicon, notes, parallels, passages, runlog
from .queries import NORMAL, _conversation_segments, query
from .storage import table


def pick(key: str, *cases: str) -> str:
    """An expression that takes one of some expressions by a number."""
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def relation(columns: dict[str, str], source: str = "documents") -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})"


def derived(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str = "documents") -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def whole(number: str) -> str:
    return f"CAST({number} AS STRING)"


ID = whole("doc_id")

# ---- names and numbers in texts

NUMBERS = {"doc_id": "doc_id", "n": pick("doc_id", ID, f"{ID} || '-15'", f"' ' || {ID} || ' x'", "''", f"'x' || {ID}", f"'-' || {ID}", "CAST(NULL AS STRING)", f"'+' || {ID} || 'a'")}
LEADING = "CASE WHEN n IS NOT NULL THEN coalesce(TRY_CAST(replace(nullif(regexp_extract(n, '^\\s*([+-]?\\d+)', 1), ''), '+', '') AS BIGINT), 0) END"


@query(f"SELECT doc_id, n, {LEADING} AS value FROM {relation(NUMBERS)}")
def leading_int(spark, sf_dir):
    return derived(spark, sf_dir, NUMBERS).select("doc_id", "n", T.leading_int(F.col("n")).alias("value"))


@query(f"SELECT doc_id, n AS paranum FROM {relation(NUMBERS)} WHERE n IS NOT NULL ORDER BY {LEADING}, doc_id LIMIT 50")
def numeric_text_order(spark, sf_dir):
    """The first rows in the order of numbers that are written as texts."""
    return derived(spark, sf_dir, NUMBERS).where("n is not null").orderBy(T.leading_int(F.col("n")), "doc_id").limit(50).select("doc_id", F.col("n").alias("paranum"))


NAMES = {"doc_id": "doc_id", "name": pick("doc_id", f"'Mahā Book ' || {ID} || ' copy.pdf'", "'Maha_Book ' || source || ' (copy 2).txt'", f"'maha  book ' || {ID} || ' v2.txt'", f"'Straße ' || {ID} || ' Version 10.md'", "'metadata.opf'", "'Cover.jpg'", f"'.hidden' || {ID}", f"'a.b.c' || {ID}", "'Title ' || lang || ' duplicate 3 ver 2.txt'")}


@query(
    f"WITH n AS (SELECT doc_id, name, trim(regexp_replace(replace(lower(strip_accents(regexp_replace(name, '(.)\\.[^./]*$', '\\1'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title FROM {relation(NAMES)})"
    ", k AS (SELECT doc_id, name, title, trim(regexp_replace(trim(regexp_replace(title, '\\s+(?:copy|duplicate)(?:\\s+\\d+)?$', '')), '\\s+(?:v|ver|version)\\s*\\d+$', '')) AS key FROM n)"
    " SELECT doc_id, name, title, key, CASE WHEN lower(name) LIKE '%.opf' OR lower(name) LIKE '%.ini' OR key IN ('metadata', 'picasa', 'index', 'contents', 'cover', 'title') THEN '' ELSE key END AS hint FROM k"
)
def filename_key(spark, sf_dir):
    n = derived(spark, sf_dir, NAMES)
    return n.select("doc_id", "name", T.title_key(F.col("name")).alias("title"), T.name_key(F.col("name")).alias("key"), T.hint_key(F.col("name")).alias("hint"))


FORMS = {"doc_id": "doc_id", "t": pick("doc_id", f"'Evaṃ ME sutaṂ ' || {ID}", f"{ID} || '. Apaṇṇakasuttaṃ'", f"source || '/' || lang || '/File.' || {ID} || '.TXT'", "''", f"'.hidden' || {ID}", f"{ID} || ' . x'")}


@query(f"SELECT doc_id, t, replace(replace(t, 'ṃ', 'ṁ'), 'Ṃ', 'Ṁ') AS above, trim(regexp_replace(t, '^\\d+\\.\\s+', '')) AS plain, regexp_extract(t, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(t, '([^/]*)$', 1), '.(\\.[^./]+)$', 1)) AS suffix, upper(t) AS upper FROM {relation(FORMS)}")
def scalar_forms(spark, sf_dir):
    t = F.col("t")
    return derived(spark, sf_dir, FORMS).select("doc_id", "t", T.dotted_above(t).alias("above"), T.without_ordinal(t).alias("plain"), T.file_name(t).alias("name"), T.suffix(T.file_name(t)).alias("suffix"), F.upper("t").alias("upper"))


# ---- books of segments: forty documents are a book, some of them its headings

BOOK = "CAST(floor(doc_id / 40) AS BIGINT)"
PLACE = "doc_id % 40"
SEGMENTS = {
    "book_code": f"'s' || lpad({whole(BOOK)}, 7, '0') || CASE WHEN {BOOK} % 3 = 0 THEN '_att' ELSE '_mul' END",
    "id": "doc_id",
    "rend": f"CASE WHEN {PLACE} = 0 THEN 'book' WHEN {PLACE} % 13 = 1 THEN 'chapter' WHEN {PLACE} % 7 = 2 THEN 'title' WHEN {PLACE} % 5 = 3 THEN 'subhead' ELSE 'bodytext' END",
    "paranum": f"CASE WHEN {PLACE} = 0 OR {PLACE} % 13 = 1 OR {PLACE} % 7 = 2 OR {PLACE} % 5 = 3 OR doc_id % 3 = 0 THEN '' ELSE {whole(f'1 + {PLACE} % 11')} END",
    "pali_text": f"CASE WHEN {PLACE} = 0 THEN 'Book ' || {whole(BOOK)} WHEN {PLACE} % 13 = 1 THEN CASE WHEN {PLACE} = 14 THEN '' ELSE 'Chapter ' || {ID} END WHEN {PLACE} % 7 = 2 THEN 'Title <b>' || {ID} || '</b>' WHEN {PLACE} % 5 = 3 THEN CASE WHEN {PLACE} = 8 THEN 'Book ' || {whole(BOOK)} ELSE 'Head of ' || source END"
    " ELSE CASE doc_id % 9 WHEN 1 THEN 'Evaṃ me su<pb n=\"1\"/>taṃ ' WHEN 4 THEN 'EVAṂ  ME SUTAṂ ' WHEN 5 THEN 'evaṁ me sutaŋ ' ELSE '' END || text END",
    "english_translation": "CASE WHEN doc_id % 17 = 0 THEN 'so evaṃ  me sutaṃ again' ELSE lang END",
}
SEG_SQL = f"seg AS {relation(SEGMENTS)}"
PLAIN = "trim(regexp_replace(regexp_replace(pali_text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
LAST = "IGNORE NULLS) OVER (PARTITION BY book_code ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
HEADS = f"""{SEG_SQL}, b AS (SELECT book_code, min({PLAIN}) AS book_title FROM seg WHERE rend = 'book' GROUP BY book_code),
h AS (SELECT *, {', '.join(f"coalesce(last_value(CASE WHEN rend = '{h}' THEN id END {LAST}, -1) AS {h}_id, last_value(CASE WHEN rend = '{h}' THEN {PLAIN} END {LAST} AS {h}" for h in ('chapter', 'title', 'subhead'))},
  coalesce(last_value(CASE WHEN rend IN ('chapter', 'title', 'subhead') THEN {PLAIN} END {LAST}, '') AS near FROM seg),
s AS (SELECT h.*, coalesce(book_title, '') AS book_title, title_id > chapter_id AS second, subhead_id > greatest(chapter_id, CASE WHEN title_id > chapter_id THEN title_id ELSE -1 END) AS third FROM h LEFT JOIN b USING (book_code))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SEGMENTS)


@query(
    f"WITH {HEADS} SELECT book_code, id, near, array_to_string(list_filter([CASE WHEN chapter_id >= 0 THEN chapter END, CASE WHEN second THEN title END, CASE WHEN third THEN subhead END], lambda x: x IS NOT NULL AND x <> '' AND x <> book_title), ' / ') AS sections FROM s"
)
def heading_chain(spark, sf_dir):
    return passages.with_headings(segments(spark, sf_dir)).select("book_code", "id", "near", F.array_join("sections", " / ").alias("sections"))


@query(
    f"WITH {SEG_SQL}, o AS (SELECT *, coalesce(nullif(paranum, ''), last_value(nullif(paranum, '') {LAST}, '') AS owner FROM seg)"
    f" SELECT book_code, id, owner FROM o WHERE contains({NORMAL.format('pali_text')}, 'evaṃ me sutaṃ') OR contains({NORMAL.format('english_translation')}, 'evaṃ me sutaṃ')"
)
def canon_phrase(spark, sf_dir):
    return passages.find_phrase(segments(spark, sf_dir), unicodedata.normalize("NFD", "evaṁ me  sutaṁ"), limit=1 << 30).select("book_code", "id", "owner")


@query(
    f"WITH {SEG_SQL}, o AS (SELECT *, coalesce(nullif(paranum, ''), last_value(nullif(paranum, '') {LAST}, '') AS owner FROM seg)"
    f" SELECT book_code, id, owner FROM o WHERE contains({NORMAL.format('pali_text')}, 'evaṃ me sutaṃ') AND (book_code GLOB 's*_att' OR book_code = 's0000001_mul') ORDER BY book_code GLOB 's*_att' DESC, book_code, id LIMIT 7"
)
def canon_federated(spark, sf_dir):
    """The first hits over several books, in the order of the books asked for; the limit ends within one of them."""
    rows = segments(spark, sf_dir)
    chosen = passages.chosen_books(rows, ["s*_att", "s0000001_mul", "none"])
    return passages.find_phrase(rows.join(chosen, "book_code"), "evaṁ me sutaṁ", ("pali_text",), 7, ("book_ord", "id")).select("book_code", "id", "owner")


@query(
    f"WITH {HEADS}, n AS (SELECT book_code, id, near, lag(near) OVER (PARTITION BY book_code ORDER BY id) AS before FROM s WHERE paranum = '1' AND near <> '' AND near <> book_title)"
    " SELECT book_code, CAST(row_number() OVER (PARTITION BY book_code ORDER BY id) AS BIGINT) AS ord, near AS heading FROM n WHERE near IS DISTINCT FROM before"
)
def heading_candidates(spark, sf_dir):
    return passages.heading_candidates(segments(spark, sf_dir), 1)


# ---- citations and the dictionary that verifies them

INFO = {
    "book_code": pick("doc_id", "'MN'", "'AN'", "'SNP'", "'DHP'", "'TH'"),
    "sc_code": pick("doc_id", f"'MN' || {ID}", f"'AN' || {whole('doc_id % 11')} || '.' || {ID} || '-' || {whole('doc_id + 3')}", f"'SNP' || {whole('doc_id % 5')} || '.' || {ID}", f"'DHP' || {whole('doc_id * 10')} || '-' || lpad({whole('(doc_id * 10 + 7) % 100')}, 2, '0')", f"'TH' || {whole('doc_id % 9')} || '.' || {ID}"),
    "cst_code": f"'cst' || {whole('doc_id % 211')}",
    "dpd_code": pick("doc_id", f"'MN' || {ID}", f"'AN' || {whole('doc_id % 11')} || '.' || {ID}", f"'SNP' || {ID} || 'x'", f"'DHP' || {ID} || 'v'", f"'TH' || {ID} || 't'"),
    "dpr_code": "CAST(NULL AS STRING)",
    "bjt_sutta_code": f"'bjt' || {whole('doc_id % 97')}",
    "cst_file": f"CASE WHEN {BOOK} % 2 = 0 THEN 'S' ELSE 's' END || lpad({whole(BOOK)}, 7, '0') || '.mul.xml'",
    "cst_paranum": f"CASE WHEN doc_id % 4 = 0 THEN '' ELSE {whole(f'1 + {PLACE} % 11')} END",
    "cst_sutta": f"CASE WHEN doc_id % 7 = 2 THEN 'Title ' || {ID} ELSE {whole('doc_id % 20')} || '. Suttaṃ ' || {ID} END",
}
REFS = {
    "ref": pick("doc_id", f"'MN' || {whole('doc_id')}", f"'mn ' || {whole('doc_id + 1')}", f"'AN' || {whole('(doc_id - 1) % 11')} || '.' || {whole('doc_id')}", f"'Sn ' || {whole('doc_id % 5')} || '.' || {ID}", f"'Dhp ' || {whole('doc_id * 10 - 6')}", f"'SN' || {whole('doc_id % 5')} || '.' || {ID}", f"'Thag ' || {ID}", f"'MN' || {whole('doc_id - 2')} || '-' || {whole('doc_id + 3')}", f"'Snp ' || {ID}", f"'Kp ' || {ID}", f"'Thag ' || {whole('doc_id % 9')} || '.' || {whole('doc_id - 1')}", f"'AN ' || {whole('doc_id % 11')} || '.' || {ID} || '-' || {whole('doc_id + 1')}"),
}
CITED = f"'See ' || {REFS['ref']} || ' and (MN ' || {whole('doc_id % 30')} || '), not MN' || {ID} || 'x; ' || {pick('doc_id', 'text', 'source', 'lang')}"


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(t, '(?i)\\b(?:DN|MN|SN|AN|SNP|Snp?|Dhp|Ud|Iti|Thag|Thig|Vv|Pv|Bv|Ja|Mil|Khp|Kp)\\s?(?:\\d+(?:\\.\\d+)?(?:-\\d+)?)\\b'), '|') AS refs FROM {relation({'doc_id': 'doc_id', 't': CITED})}")
def citation_extract(spark, sf_dir):
    return derived(spark, sf_dir, {"doc_id": "doc_id", "t": CITED}).select("doc_id", F.array_join(citations.extracted(F.col("t")), "|").alias("refs"))


@query(
    f"WITH r AS (SELECT ref, regexp_extract(replace(ref, ' ', ''), '^([A-Za-z]+)(.*)$', 1) AS p, regexp_extract(replace(ref, ' ', ''), '^([A-Za-z]+)(.*)$', 2) AS tail FROM {relation(REFS)})"
    " SELECT ref, concat_ws('|', upper(p) || tail, CASE WHEN lower(p) = 'sn' AND p <> 'SN' THEN 'SNP' || tail END, CASE upper(p) WHEN 'THAG' THEN 'TH' || tail WHEN 'THIG' THEN 'THI' || tail WHEN 'KP' THEN 'KHP' || tail WHEN 'KHP' THEN 'KP' || tail END) AS candidates FROM r"
)
def citation_normalise(spark, sf_dir):
    return derived(spark, sf_dir, REFS).select("ref", F.array_join(citations.candidates(F.col("ref")), "|").alias("candidates"))


VERIFIED = f"""
info AS (SELECT row_number() OVER () AS k, * FROM {relation(INFO)}),
given AS {relation(REFS)},
asked AS (SELECT DISTINCT ref, regexp_extract(replace(ref, ' ', ''), '^([A-Za-z]+)(.*)$', 1) AS p, regexp_extract(replace(ref, ' ', ''), '^([A-Za-z]+)(.*)$', 2) AS tail FROM given),
cand AS (SELECT ref, upper(p) || tail AS code FROM asked UNION SELECT ref, 'SNP' || tail FROM asked WHERE lower(p) = 'sn' AND p <> 'SN' UNION SELECT ref, 'TH' || tail FROM asked WHERE upper(p) = 'THAG' UNION SELECT ref, 'KHP' || tail FROM asked WHERE upper(p) = 'KP'),
ends AS (SELECT ref, code AS whole, unnest([regexp_replace(code, '^([A-Z]+(?:\\d+\\.)?)(\\d+)-(\\d+)$', '\\1\\2'), regexp_replace(code, '^([A-Z]+(?:\\d+\\.)?)(\\d+)-(\\d+)$', '\\1\\3')]) AS code FROM cand WHERE regexp_matches(code, '^[A-Z]+(?:\\d+\\.)?\\d+-\\d+$')),
codes AS (SELECT k, unnest([sc_code, cst_code, dpd_code, dpr_code, bjt_sutta_code]) AS code FROM info),
spans AS (SELECT DISTINCT k, book_code, nullif(regexp_extract(s, '^[A-Z]+(?:(\\d+)\\.)?\\d+-\\d+$', 1), '') AS chapter, CAST(regexp_extract(s, '(\\d+)-\\d+$', 1) AS BIGINT) AS lo, regexp_extract(s, '-(\\d+)$', 1) AS e FROM (SELECT k, book_code, unnest([sc_code, dpd_code]) AS s FROM info) WHERE regexp_matches(s, '^[A-Z]+(?:\\d+\\.)?\\d+-\\d+$')),
fixed AS (SELECT k, book_code, chapter, lo, CASE WHEN CAST(e AS BIGINT) < lo THEN CAST(e AS BIGINT) + CAST(ceil((lo - CAST(e AS BIGINT)) / 10.0 ** length(e)) AS BIGINT) * CAST(10 ** length(e) AS BIGINT) ELSE CAST(e AS BIGINT) END AS hi FROM spans),
wanted AS (SELECT code FROM cand UNION SELECT code FROM ends),
exact AS (SELECT DISTINCT w.code, k FROM wanted w JOIN codes c ON w.code = c.code),
single AS (SELECT code, CASE regexp_extract(code, '^[A-Z]+') WHEN 'THAG' THEN 'TH' WHEN 'KP' THEN 'KHP' ELSE regexp_extract(code, '^[A-Z]+') END AS book_code, nullif(regexp_extract(code, '^[A-Z]+(?:(\\d+)\\.)?\\d+$', 1), '') AS chapter, CAST(regexp_extract(code, '(\\d+)$', 1) AS BIGINT) AS n FROM wanted WHERE regexp_matches(code, '^[A-Z]+(?:\\d+\\.)?\\d+$') AND code NOT IN (SELECT code FROM exact)),
res AS (SELECT code, k FROM exact UNION SELECT s.code, f.k FROM single s JOIN fixed f ON s.book_code = f.book_code AND s.chapter IS NOT DISTINCT FROM f.chapter AND s.n BETWEEN f.lo AND f.hi),
byends AS (SELECT ref, whole FROM ends LEFT JOIN res USING (code) GROUP BY ref, whole HAVING count(DISTINCT CASE WHEN k IS NOT NULL THEN ends.code END) = count(DISTINCT ends.code)),
hit AS (SELECT ref, k FROM cand JOIN res USING (code) UNION SELECT e.ref, r.k FROM byends b JOIN ends e ON b.ref = e.ref AND b.whole = e.whole JOIN res r ON e.code = r.code),
verdicts AS (SELECT a.ref, CASE WHEN count(k) > 0 THEN 'verified' WHEN max(CASE WHEN c.ref IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'unverifiable-form' ELSE 'rejected' END AS verdict, CAST(count(DISTINCT k) AS BIGINT) AS entries
  FROM (SELECT DISTINCT ref FROM asked) a LEFT JOIN hit USING (ref) LEFT JOIN (SELECT DISTINCT ref FROM cand WHERE regexp_matches(code, '^(SNP|THAG|THIG)\\d+$')) c ON c.ref = a.ref GROUP BY a.ref)
"""


@query(f"WITH {VERIFIED} SELECT * FROM verdicts")
def citation_verify(spark, sf_dir):
    return citations.verified(derived(spark, sf_dir, REFS), derived(spark, sf_dir, INFO))


NOTED = {"note": ID, "ref": REFS["ref"], "text": f"'In ' || {REFS['ref']} || ', they say, and so again: ' || {REFS['ref']}"}


@query(
    f"WITH {VERIFIED}, said AS (SELECT n.*, n.ref || ' ' || CASE verdict WHEN 'verified' THEN '{citations.VERDICTS['verified']}' WHEN 'rejected' THEN '{citations.VERDICTS['rejected']}' ELSE '{citations.VERDICTS['unverifiable-form']}' END AS stamped FROM {relation(NOTED)} n JOIN verdicts v USING (ref))"
    " SELECT note, 'In ' || stamped || ', they say, and so again: ' || stamped AS text FROM said"
)
def citation_annotate(spark, sf_dir):
    return citations.annotated(derived(spark, sf_dir, NOTED).select("note", "text"), derived(spark, sf_dir, INFO))


@query()
def resolve_label(spark, sf_dir):
    """A label for each paragraph that a document asks for; the rules are tested on a small table with labels written out."""
    asked = {"book_code": f"CASE WHEN doc_id % 19 = 0 THEN 'dn1' WHEN doc_id % 23 = 0 THEN 'vin01m_mul' ELSE {SEGMENTS['book_code']} END", "paranum": f"CASE WHEN doc_id % 5 = 0 THEN {whole('1 + doc_id % 14')} ELSE {whole('1 + doc_id % 7')} || '-' || {whole('2 + doc_id % 7')} END"}
    return citations.labels(derived(spark, sf_dir, asked).distinct(), segments(spark, sf_dir), derived(spark, sf_dir, INFO))


CODED = {"c": pick("doc_id", f"'mn ' || {ID}", f"'MN-' || {ID}", f"'snp_' || {ID}", f"'thag' || {ID}", f"' sa ' || {ID}", f"'x' || {ID}")}


@query(f"SELECT c, replace(replace(replace(upper(trim(c)), ' ', ''), '-', ''), '_', '') AS code, CASE upper(left(trim(c), 2)) WHEN 'MN' THEN 'MN' WHEN 'SN' THEN 'SNP' WHEN 'TH' THEN 'THAG' WHEN 'SA' THEN 'SA' END AS family FROM {relation(CODED)}")
def code_family(spark, sf_dir):
    return derived(spark, sf_dir, CODED).select("c", citations.text_code(F.col("c")).alias("code")).withColumn("family", citations.family(F.col("code")))


@query(f"WITH asked AS (SELECT {pick('doc_id', chr(39) + 'MN' + chr(39) + ' || ' + ID, chr(39) + 'cst' + chr(39) + ' || ' + ID, chr(39) + 'bjt' + chr(39) + ' || ' + ID)} AS code FROM labels) SELECT DISTINCT dpd_code FROM {relation(INFO)} i JOIN asked ON asked.code IN (sc_code, cst_code, dpd_code, dpr_code, bjt_sutta_code)")
def five_code_lookup(spark, sf_dir):
    asked = derived(spark, sf_dir, {"code": pick("doc_id", f"'MN' || {ID}", f"'cst' || {ID}", f"'bjt' || {ID}")}, "labels")
    codes = derived(spark, sf_dir, INFO).select("dpd_code", F.explode(F.array_distinct(F.array(*citations.CODES))).alias("code"))
    return codes.join(asked, "code", "left_semi").select("dpd_code").distinct()


@query(f"SELECT sc_code FROM {relation(INFO)} WHERE lower(cst_file) LIKE '%s0000002.mul%'")
def file_containment(spark, sf_dir):
    return derived(spark, sf_dir, INFO).where(F.contains(F.lower("cst_file"), F.lit("S0000002.mul".lower()))).select("sc_code")


# ---- parallels and alignment

UIDS = {"uid": pick("doc_id", f"'sn' || {ID} || '.1-2'", f"'an3.' || {ID} || '-' || {whole('doc_id + doc_id % 30')}", f"'an1.1-' || {whole('doc_id + 300')}", f"'sn' || {whole('doc_id % 9 + 2')} || '-1'", f"'ea-2.' || {ID}", f"{ID} || '-' || {whole('doc_id + 2')}", f"'dhp' || {ID} || '-' || {whole('doc_id + 1')}")}


@query(f"WITH u AS (SELECT uid, regexp_extract(uid, '^(.*?)(\\d+)-(\\d+)$', 1) AS p, TRY_CAST(regexp_extract(uid, '^(.*?)(\\d+)-(\\d+)$', 2) AS BIGINT) AS lo, TRY_CAST(regexp_extract(uid, '^(.*?)(\\d+)-(\\d+)$', 3) AS BIGINT) AS hi FROM {relation(UIDS)}) SELECT uid, p || unnest(range(lo, hi + 1)) AS member FROM u WHERE regexp_matches(p, '[a-z]') AND hi > lo AND hi - lo <= 400")
def parallels_expand(spark, sf_dir):
    return derived(spark, sf_dir, UIDS).select("uid", F.explode(parallels.members(F.col("uid"))).alias("member"))


FILES = {"code": f"'MA' || {whole('doc_id % 61')}", "source": pick("doc_id", "'bdk'", "'patton'", "'patton_'", "'other'"), "path": f"'p/' || lpad({ID}, 9, '0') || '.md'"}
WANTED = {"asked": f"'c' || {whole('conv_id')}", "nth": "CAST(turn AS BIGINT) + 1", "code": f"'MA' || {whole('(conv_id * 7 + turn) % 67')}"}


@query(
    f"WITH w AS (SELECT DISTINCT * FROM {relation(WANTED, 'conversations')}), f AS (SELECT code, source, path, row_number() OVER (PARTITION BY code ORDER BY CASE source WHEN 'patton' THEN 1 WHEN 'patton_' THEN 2 ELSE 3 END, path) AS n FROM {relation(FILES)} WHERE source IN ('patton', 'patton_', 'bdk'))"
    " SELECT asked, nth, w.code, path, source AS translator FROM w LEFT JOIN f ON w.code = f.code AND n = 1 WHERE nth <= 5"
)
def preferred_translation(spark, sf_dir):
    return parallels.preferred(derived(spark, sf_dir, WANTED, "conversations").distinct(), derived(spark, sf_dir, FILES))


@query(
    "WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)),"
    " hits AS (SELECT turn // 2 AS seg, min(turn) AS pos FROM c WHERE role = 'user' AND contains(lower('\"c' || conv_id || ':' || (turn // 2) || '\": \"' || text || '\"'), 'e') GROUP BY turn // 2),"
    " keys AS (SELECT seg, row_number() OVER (ORDER BY pos) AS nth FROM hits)"
    " SELECT CASE WHEN role = 'user' THEN '**Pāḷi**' ELSE upper(left(role, 1)) || lower(substr(role, 2)) || ' (Bilara)' END AS label, string_agg(trim(text), ' … ' ORDER BY nth, trim(text)) AS text FROM c JOIN keys ON turn // 2 = seg WHERE nth <= 20 AND trim(text) <> '' GROUP BY label"
)
def align_segments(spark, sf_dir):
    """The turns of the first conversation that hold a letter, and what the others said to them."""
    lines = _conversation_segments(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").agg(F.min("conv_id")).first()[0]
    return align.renderings(lines, align.located(lines.where(F.col("uid") == f"c{first}"), "E"), f"c{first}")


# ---- dictionaries

LOOKUP = {"lookup_key": f"'form' || {ID}", "headwords": f"CASE WHEN doc_id % 9 = 0 THEN '[]' ELSE '[' || {whole('1 + doc_id % 170')} || ', ' || {whole('1 + doc_id % 23')} || ']' END"}


@query(f"SELECT DISTINCT form, id, lemma_1 FROM (SELECT lookup_key AS form, unnest(CAST(headwords AS BIGINT[])) AS id FROM {relation(LOOKUP)} WHERE lookup_key IN (SELECT 'form' || doc_id FROM labels)) JOIN (SELECT p_partkey AS id, p_name AS lemma_1 FROM part) USING (id)")
def inflection_lookup(spark, sf_dir):
    wanted = derived(spark, sf_dir, {"form": f"'form' || {ID}"}, "labels").distinct()
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("lemma_1"))
    return lexicon.inflected(derived(spark, sf_dir, LOOKUP), wanted, words).select("form", "id", "lemma_1").distinct()


@query("WITH roots AS (SELECT p_brand AS root_key, min(p_type) AS meaning FROM part WHERE p_brand NOT LIKE '%5' GROUP BY p_brand) SELECT p_partkey AS id, p_brand AS root_key, meaning FROM part LEFT JOIN roots ON p_brand = root_key")
def root_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    roots = part.where("p_brand not like '%5'").groupBy(F.col("p_brand").alias("root_key")).agg(F.min("p_type").alias("meaning"))
    return lexicon.with_root(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("root_key")), roots).select("id", "root_key", "meaning")


BOOKS = {"cst_filename": f"'s' || lpad({ID}, 6, '0') || {pick('doc_id', chr(39) + 'm.mul' + chr(39), chr(39) + 'a.att' + chr(39), chr(39) + 't.tik' + chr(39))}", "cst_book_name": f"'Vagga ' || {whole('doc_id % 300')}", "gui_book_code": f"'g' || {ID}", "dpd_book_code": f"'DN' || {whole('doc_id % 50')}"}
ASKED = {"asked": pick("doc_id", f"'s' || lpad({ID}, 6, '0') || 'm_mul'", f"'Vagga ' || {whole('doc_id % 400')}", f"'g' || {ID}", f"'DN' || {whole('doc_id % 60')}", f"'s' || lpad({ID}, 6, '0') || 'a.att'", "''")}


@query(
    f"WITH a AS (SELECT DISTINCT asked, CASE WHEN NOT contains(asked, '.') THEN regexp_replace(asked, '^(.+)_(mul|att|tik|nrf)$', '\\1.\\2') ELSE asked END AS code FROM {relation(ASKED, 'labels')} WHERE asked <> ''),"
    f" b AS (SELECT DISTINCT cst_filename, unnest([cst_filename, cst_book_name, gui_book_code, dpd_book_code]) AS code FROM {relation(BOOKS)}) SELECT asked, replace(cst_filename, '.', '_') AS cst_table FROM a JOIN b USING (code)"
)
def code_translate(spark, sf_dir):
    return lexicon.books(derived(spark, sf_dir, ASKED, "labels").distinct(), derived(spark, sf_dir, BOOKS)).select("asked", "cst_table")


# ---- logs and notes

GATES = {"run": f"'u' || {whole('user_id')}", "seq": "event_id", "phase": pick("event_id", *[f"'{p}'" for p in runlog.PHASES]), "kind": pick("event_id", "'gate'", "'entry'", "'entry'", "'skip'", "'entry'")}


@query(f"WITH e AS {relation(GATES, 'events')} SELECT run, phase FROM (SELECT DISTINCT run FROM e) r, (SELECT DISTINCT phase FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in runlog.PHASES)}) t(phase)) p WHERE (run, phase) NOT IN (SELECT (run, phase) FROM e WHERE kind IN ('gate', 'skip'))")
def missing_gates(spark, sf_dir):
    log = derived(spark, sf_dir, GATES, "events")
    return runlog.missing_gates(log, log.select("run").distinct())


#: Parts of a note by its document's number: whether each is there, and how it is written.
NOTE_LINES = [
    "CASE WHEN doc_id % 11 <> 0 THEN '---' END", "CASE WHEN doc_id % 2 = 0 THEN 'tool: \"https://example.org/tool\"' ELSE 'tool: other' END", "CASE WHEN doc_id % 3 <> 0 THEN 'agent: someone' ELSE 'x: y' END",
    "CASE doc_id % 5 WHEN 0 THEN 'topic:' WHEN 1 THEN 'topic: a: b' WHEN 2 THEN 'topic: \"a: b\"' ELSE 'topic: plain' END", "'web_refs:'", "CASE WHEN doc_id % 7 = 0 THEN '- https://x.org a note' ELSE '- https://x.org/' || source END", "'library_refs:'",
    "CASE WHEN doc_id % 4 = 0 THEN '- Book: part' ELSE '- \"Book: part\"' END", "'canon_refs:'", "CASE WHEN doc_id % 6 = 0 THEN 'z: 1' ELSE '- MN 10' END", "'---'",
    *[f"CASE WHEN doc_id % {n} <> 0 THEN '{s}' ELSE 'none' END" for s, n in zip(notes.SECTIONS, (8, 9, 10, 12, 13, 14), strict=True)], "CASE WHEN doc_id % 15 = 0 THEN 'MN 1 [REJECTED]' ELSE '> quoted' END", "CASE WHEN doc_id % 16 = 0 THEN '[^1]: early' ELSE lang END", "'---'", "'[^1]: source'",
]


def _note_lines() -> str:
    return ", ".join(f"CASE WHEN doc_id % 11 = 0 AND {k} IN (0, 10) THEN 'plain' ELSE {line} END" for k, line in enumerate(NOTE_LINES))


FRONT, BODY = "doc_id % 11 <> 0", "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 12 END"
NOTE_FAULTS = [
    ("missing-frontmatter", "1", "error", f"NOT ({FRONT})"), ("invalid-tool", "2", "error", f"{FRONT} AND doc_id % 2 <> 0"), ("missing-agent", "1", "error", f"{FRONT} AND doc_id % 3 = 0"), ("missing-topic", "1", "error", f"{FRONT} AND doc_id % 5 = 0"), ("invalid-topic", "4", "error", f"{FRONT} AND doc_id % 5 = 1"),
    ("invalid-web-ref", "6", "error", f"{FRONT} AND doc_id % 7 = 0"), ("invalid-library-ref", "8", "error", f"{FRONT} AND doc_id % 4 = 0"), ("rejected-citation", "18", "error", "doc_id % 15 = 0"), ("invalid-footnote-placement", "19", "error", "doc_id % 16 = 0"),
    *[("missing-section", BODY, "warning" if s == notes.SOFT else "error", f"doc_id % {n} = 0") for s, n in zip(notes.SECTIONS, (8, 9, 10, 12, 13, 14), strict=True)],
    # Of the first tier's section the next line is text where the next section is lacking; then there are no references either.
    ("missing-canon-ref", "1", "error", "doc_id % 10 <> 0 AND doc_id % 12 = 0"),
]


@query("WITH d AS (SELECT doc_id FROM documents) " + " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS note, '{code}' AS code, CAST({line} AS BIGINT) AS line, '{severity}' AS severity FROM d WHERE {test}" for code, line, severity, test in NOTE_FAULTS))
def note_issues(spark, sf_dir):
    """A note for each document, whose faults follow from its number."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note"), F.posexplode(F.expr(f"array({_note_lines()})")).alias("at", "text"))
    return notes.issues(rows.select("note", (F.col("at") + 1).cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text")), "https://example.org/tool")
