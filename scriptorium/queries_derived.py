"""Queries over relations that are derived from the driver's tables: the shape is made by expressions that both engines read,
the result is computed by the operator here and by SQL there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import align, citations, lexicon, notes, parallels, runlog
from .queries import _conversation_segments, inline, query, values
from .sources import files
from .storage import table

# ---- text columns

RANGE_END = "CASE doc_id % 3 WHEN 0 THEN lpad(CAST(doc_id * 7 % 100 AS STRING), 2, '0') WHEN 1 THEN CAST(doc_id % 10 AS STRING) ELSE lpad(CAST(doc_id * 31 % 1000 AS STRING), 3, '0') END"


@query(
    f"WITH r AS (SELECT doc_id, doc_id * 13 % 5000 AS low, {RANGE_END} AS written FROM documents), n AS (SELECT *, CAST(written AS BIGINT) AS e, CAST(power(10, length(written)) AS BIGINT) AS unit FROM r)"
    " SELECT doc_id, low, written, CASE WHEN e >= low THEN e ELSE e + (low - e + unit - 1) // unit * unit END AS high FROM n"
)
def range_ends(spark, sf_dir):
    r = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id * 13 % 5000 AS low", f"{RANGE_END} AS written")
    return r.select("doc_id", "low", "written", citations.repaired_end(F.col("low"), F.col("written")).alias("high"))


RAW_REFS = "CASE doc_id % 4 WHEN 0 THEN '[[' || doc_id || ']]; [[ x' || (doc_id % 5) || ' ]], [[' || doc_id || ']]' WHEN 1 THEN doc_id || ', b; ' || doc_id || ',[c]' WHEN 2 THEN '[[ ]]' ELSE '' END"


@query(
    f"WITH r AS (SELECT doc_id, {RAW_REFS} AS raw FROM documents), p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(raw, '\\[([^\\[\\]]*)\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS inner_refs,"
    " list_filter(list_transform(regexp_split_to_array(raw, '[,;]'), lambda x: regexp_replace(trim(x), '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), lambda x: x <> '') AS parts FROM r),"
    " l AS (SELECT doc_id, CASE WHEN len(inner_refs) > 0 THEN inner_refs ELSE parts END AS refs FROM p)"
    " SELECT doc_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), '|') AS refs FROM l"
)
def bracketed_refs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(citations.bracketed_refs(F.expr(RAW_REFS)), "|").alias("refs"))


CITED = "'see MN' || doc_id || '.' || (doc_id % 9) || ' and AN ' || (doc_id % 11) || '.' || (doc_id % 7) || '; `DN1.2` https://x.org/sn1.2.3 there' || CASE WHEN doc_id % 5 = 0 THEN ', SN 5.' || doc_id || '.20 too' ELSE '' END"


@query(
    "SELECT 'n' AS note, doc_id AS line, 'MN' || doc_id || '.' || (doc_id % 9) AS ref, 'MN' AS collection, CAST(1 AS BIGINT) AS expected_segments, CAST(2 AS BIGINT) AS found_segments FROM documents"
    " UNION ALL SELECT 'n', doc_id, 'SN 5.' || doc_id || '.20', 'SN', 2, 3 FROM documents WHERE doc_id % 5 = 0"
)
def citation_shape(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").selectExpr("'n' AS note", "doc_id AS line_no", f"{CITED} AS text")
    return citations.misshapen(lines).drop("context")


# ---- small files

VIDEO = "CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE 'v' || event_id || '|||T|||' || event_type || '|||U' || (user_id % 9) || '|||' || CASE event_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN '12.5' ELSE CAST(event_id % 600 AS STRING) END END"
VIDEO_TIERS = "('excluded', '', 'U3'), ('trusted', 'Click', ''), ('excluded', 'error', '')"


@query(
    f"WITH r AS (SELECT string_split({VIDEO}, '|||') AS p FROM events), v AS (SELECT p[1] AS video_id, p[3] AS channel, p[4] AS channel_id, TRY_CAST(p[5] AS DOUBLE) AS duration FROM r WHERE len(p) >= 5),"
    f" a AS (SELECT CASE tier WHEN 'excluded' THEN 0 WHEN 'trusted' THEN 1 ELSE 2 END AS rank, lower(name) AS name, id FROM {values('tier string, name string, id string', VIDEO_TIERS)}),"
    " t AS (SELECT v.*, (SELECT min(rank) FROM a WHERE (a.id <> '' AND a.id = v.channel_id) OR (a.name <> '' AND a.name = lower(v.channel))) AS rank FROM v)"
    " SELECT video_id, channel, duration, CASE rank WHEN 1 THEN 'trusted' ELSE 'probationary' END AS tier FROM t WHERE rank IS DISTINCT FROM 0"
)
def video_search_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr(f"{VIDEO} AS text")
    return files.not_excluded(files.video_hits(lines), inline(spark, "tier string, name string, channel_id string", VIDEO_TIERS)).select("video_id", "channel", "duration", "tier")


REPORT = """CASE WHEN page_id % 5 = 0 THEN 'No matches found.' ELSE 'note: starting ' || chr(10) || '[{"file": "p' || page_id || '.md", "matches": [{"line": 3, "text": " x' || page_id || ' "}, {"line": ' || (page_id % 50) || ', "text": "y"}]}, {"file": "e.md", "matches": []}]' END"""


@query("SELECT 'p' || page_id || '.md' AS path, CAST(3 AS INTEGER) AS line, 'x' || page_id AS snippet FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT 'p' || page_id || '.md', CAST(page_id % 50 AS INTEGER), 'y' FROM pages WHERE page_id % 5 <> 0")
def vault_hits(spark, sf_dir):
    return files.flattened_hits(table(spark, sf_dir, "pages").selectExpr(f"{REPORT} AS text"))


TIER_LINE = "CASE doc_id % 50 WHEN 0 THEN '## Trusted' WHEN 10 THEN '```' WHEN 12 THEN '```' WHEN 20 THEN '## Notes' WHEN 30 THEN '## Excluded' WHEN 40 THEN '## Probationary' ELSE CASE doc_id % 3 WHEN 0 THEN '- Name ' || doc_id || ' | UC' || doc_id WHEN 1 THEN '- Only ' || doc_id ELSE 'text' END END"


@query(
    f"WITH l AS (SELECT doc_id AS n, {TIER_LINE} AS t FROM documents), f AS (SELECT *, sum(CASE WHEN t = '```' THEN 1 ELSE 0 END) OVER (ORDER BY n) AS fences FROM l),"
    " g AS (SELECT *, last_value(CASE WHEN starts_with(t, '## ') THEN lower(substr(t, 4)) END IGNORE NULLS) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS tier FROM f WHERE fences % 2 = 0 AND t <> '```')"
    " SELECT tier, trim(split_part(substr(t, 3), '|', 1)) AS name, trim(split_part(substr(t, 3), '|', 2)) AS channel_id FROM g WHERE tier IN ('trusted', 'excluded', 'probationary') AND starts_with(t, '- ')"
)
def channel_allowlist(spark, sf_dir):
    return files.channels(table(spark, sf_dir, "documents").selectExpr("doc_id AS line_no", f"{TIER_LINE} AS text"))


FRONT = """CASE WHEN doc_id % 3 = 0 THEN 'no front matter' ELSE '---' || chr(10) || 'tool: x' || doc_id || chr(10) || 'refs:' || chr(10) || '- a' || doc_id || chr(10) || '- "b"' || chr(10) || '---' || chr(10) || 'body: no' END"""


@query("SELECT doc_id AS note, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'refs=a' || doc_id || ',b;tool=x' || doc_id END AS fields FROM documents")
def front_matter(spark, sf_dir):
    found = files.front_matter(table(spark, sf_dir, "documents").selectExpr("doc_id AS note", f"{FRONT} AS text"))
    each = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(k, F.lit("="), F.array_join(F.element_at("fields", k), ",")))
    return found.select("note", F.array_join(each, ";").alias("fields"))


@query("SELECT doc_id AS note, CAST(CASE WHEN doc_id % 4 IN (1, 2) THEN 2 ELSE 3 END AS BIGINT) AS footnotes, CAST(2 AS BIGINT) AS quotes FROM documents")
def evidence_counts(spark, sf_dir):
    parts = "array('---', 'tool: x', '---', '## Canon Evidence (T1)', '> q [^1] [^' || (doc_id % 4) || ']', '> more', 'x [^2] [^1]: no', '## Bibliography', '> outside [^9]')"
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id AS note", f"posexplode({parts}) AS (at, text)").selectExpr("note", "at + 1L AS line_no", "text")
    return notes.evidence_counts(notes.marked(lines))


# ---- parallels, cards, alignment, library metadata

CARD = "CASE p_partkey % 3 WHEN 0 THEN 'SN' || p_partkey WHEN 1 THEN 'SNP' || p_partkey ELSE 'MN' || p_partkey END"
ASKED_CARD = "CASE p_partkey % 4 WHEN 0 THEN 'Sn ' || (p_partkey % 1000) WHEN 1 THEN 'SN' || (p_partkey % 1000) WHEN 2 THEN 'mn-' || (p_partkey % 1000) ELSE 'dn' || p_partkey END"


@query(
    f"WITH cards AS (SELECT {CARD} AS code FROM part), a AS (SELECT DISTINCT {ASKED_CARD} AS asked FROM part), p AS (SELECT asked, replace(replace(upper(asked), ' ', ''), '-', '') AS plain FROM a),"
    " c AS (SELECT asked, plain AS code, 2 AS nth FROM p UNION ALL SELECT asked, 'SNP' || substr(plain, 3), 1 FROM p WHERE starts_with(asked, 'Sn'))"
    " SELECT asked, min_by(c.code, nth) AS card_code FROM c JOIN cards ON c.code = cards.code GROUP BY asked"
)
def overview_cards(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cards = part.select(F.expr(CARD).alias("card_code"), F.create_map(F.lit("sutta_theme"), F.array("p_name")).alias("fields"))
    return parallels.overviews(part.select(F.expr(ASKED_CARD).alias("asked")).distinct(), cards).select("asked", "card_code")


UID = "['a' || (doc_id % 97), '~b' || (doc_id % 89) || '#1-2', 'c' || (doc_id % 50) || '.1-3', 'a' || (doc_id % 31)]"
WANTED_UIDS = "('A5'), ('b7'), ('c9.2'), ('c9.1-3'), ('a30'), ('zz')"


@query(
    f"WITH e AS (SELECT doc_id AS g, unnest({UID}) AS ref, unnest(range(4)) AS ord FROM documents), u AS (SELECT g, ord, regexp_replace(split_part(ref, '#', 1), '^~+', '') AS uid, starts_with(ref, '~') AS resemblance, split_part(ref, '#', 2) AS paragraph_range FROM e),"
    " known AS (SELECT g, uid AS named FROM u UNION SELECT g, regexp_extract(uid, '^(.*\\.)1-3$', 1) || n FROM u, (VALUES (1), (2), (3)) m(n) WHERE uid LIKE 'c%.1-3'),"
    f" asked AS (SELECT lower(asked) AS asked FROM {values('asked string', WANTED_UIDS)}), spot AS (SELECT DISTINCT asked, g FROM asked JOIN known ON asked = named),"
    " found AS (SELECT asked, u.* FROM spot JOIN u USING (g) WHERE uid <> asked AND NOT (uid LIKE 'c%.1-3' AND regexp_matches(asked, '^' || regexp_extract(uid, '^(.*)\\.', 1) || '\\.[123]$'))),"
    " first AS (SELECT asked, uid, min((g, ord)) AS place FROM found GROUP BY ALL)"
    " SELECT f.asked, CAST(row_number() OVER (PARTITION BY f.asked ORDER BY place) AS BIGINT) AS nth, f.uid AS ref, resemblance, paragraph_range FROM first f JOIN found x ON f.asked = x.asked AND f.uid = x.uid AND f.place = (x.g, x.ord)"
)
def parallels_lookup(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("group_id"), F.expr(UID.replace("[", "array(").replace("]", ")")).alias("parallels"))
    return parallels.parallels(groups, inline(spark, "asked string", WANTED_UIDS))


@query(
    "WITH s AS (SELECT DISTINCT 'c' || conv_id AS uid, ['pli', 'en', 'xx'][conv_id % 3 + 1] AS lang, role = 'user' AS is_root, turn, CASE WHEN turn % 3 = 2 THEN ' ' ELSE text END AS text FROM conversations),"
    " t AS (SELECT uid, string_agg(text, chr(10) ORDER BY turn, text) FILTER (is_root AND lang = 'pli' AND trim(text) <> '') AS pali, string_agg(text, chr(10) ORDER BY turn, text) FILTER (NOT is_root AND lang = 'en' AND trim(text) <> '') AS en FROM s GROUP BY uid),"
    " f AS (SELECT DISTINCT 'c' || (conv_id + conv_id % 2 * 100000) AS ref FROM conversations)"
    " SELECT ref, md5(pali) AS pali_md5, md5(en) AS en_md5, concat_ws('; ', CASE WHEN pali IS NULL THEN 'no root text in offline archive' END, CASE WHEN en IS NULL THEN 'no en translation in offline archive' END) AS gaps FROM f LEFT JOIN t ON ref = uid"
)
def text_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    found = c.selectExpr("'c' || (conv_id + conv_id % 2 * 100000) AS ref").distinct()
    segments = c.selectExpr("'c' || conv_id AS uid", "array('pli', 'en', 'xx')[int(conv_id % 3)] AS lang", "role = 'user' AS is_root", "turn AS ord", "if(turn % 3 = 2, ' ', text) AS text").distinct()
    return parallels.with_texts(found, segments).select("ref", F.md5("text_pali").alias("pali_md5"), F.md5("translation_en").alias("en_md5"), F.array_join("text_gaps", "; ").alias("gaps"))


LOCATED = "c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), h AS (SELECT {0} AS phrase, conv_id FROM (SELECT * FROM c WHERE role = 'user' AND contains(lower('\"c' || conv_id || ':' || (turn // 2) || '\": \"' || text || '\"'), lower({0})) ORDER BY conv_id, turn LIMIT 500))"


@query(
    f"WITH {LOCATED.format(chr(39) + 'Thing' + chr(39))}, u AS (SELECT coalesce(string_agg(uid, ',' ORDER BY uid), '') AS uids, count(*) AS n, min(uid) AS one FROM (SELECT DISTINCT 'c' || conv_id AS uid FROM h))"
    " SELECT 'Thing' AS phrase, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN one ELSE '' END AS uid, uids AS candidates FROM u"
    " UNION ALL SELECT 'Thing@C 99999999', 'not_in_scope', 'c99999999', uids FROM u UNION ALL SELECT 'zzqqzz', 'not_found', '', ''"
)
def align_status(spark, sf_dir):
    rows, out = _conversation_segments(spark, sf_dir), None
    for phrase, scope, shown in (("Thing", None, "Thing"), ("Thing", "C 99999999", "Thing@C 99999999"), ("zzqqzz", None, "zzqqzz")):
        one = align.status(align.located(rows, phrase), scope).select(F.lit(shown).alias("phrase"), "status", "uid", F.array_join("candidates", ",").alias("candidates"))
        out = one if out is None else out.union(one)
    return out


@query(
    "WITH au AS (SELECT part, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM (SELECT DISTINCT l_partkey AS part, l_suppkey FROM lineitem WHERE l_linenumber = 1) JOIN supplier ON l_suppkey = s_suppkey GROUP BY part),"
    " tg AS (SELECT p_partkey AS part, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM part, nation WHERE p_partkey % 3 = 0 AND n_nationkey IN (p_partkey % 25, (p_partkey + 7) % 25) GROUP BY p_partkey)"
    " SELECT 'A/' || p_partkey || '/' || p_name || '.pdf' AS path, '[Calibre #' || p_partkey || coalesce(' | Authors: ' || au.names, '') || coalesce(' | Tags: ' || tg.names, '') || ']' AS prefix FROM part LEFT JOIN au ON p_partkey = au.part LEFT JOIN tg ON p_partkey = tg.part"
)
def calibre_prefix(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    tags = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    tag_links = part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS book", "explode(array_distinct(array(p_partkey % 25, (p_partkey + 7) % 25))) AS tag")
    return lexicon.metadata_prefix(part.selectExpr("p_partkey AS id", "'A/' || p_partkey AS path"), part.selectExpr("p_partkey AS book", "p_name AS name", "'PDF' AS format"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), lines.selectExpr("l_partkey AS book", "l_suppkey AS author").distinct(), tags, tag_links)


# ---- run logs

PHASE = "(event_id % 1009) % 12"
ORDERED = "(VALUES (0, '0'), (1, '1'), (2, '2'), (3, '2.5'), (4, '3'), (5, '3b'), (6, '4'), (7, '4b'), (8, '4c'), (9, '5'), (10, '6'), (11, '7')) p(ord, phase)"
KIND = "CASE WHEN event_id % 5 < 3 THEN 'gate' WHEN event_id % 5 = 3 AND event_id % 12 < 3 THEN 'skip' ELSE 'entry' END"
PAYLOAD = "CASE event_id % 7 WHEN 0 THEN 'The vault would be searched here' WHEN 1 THEN 'would searching still be found' ELSE 'found' END"
#: A run for each user; the higher its number by 14, the further its phases go.
LOGGED = f"SELECT 'u' || user_id AS run, event_id AS seq, ord, phase, {KIND} AS kind, {PAYLOAD} AS payload FROM events JOIN {ORDERED} ON ord = {PHASE} WHERE {PHASE} < user_id % 14 AND (event_id % 3 = 0 OR user_id % 2 = 0)"
RUN_ROWS = "SELECT DISTINCT 'u' || user_id AS run, CASE WHEN user_id % 4 < 2 THEN 'thematic' ELSE 'sutta' END AS run_class, CASE WHEN user_id % 5 = 0 THEN 'a [REJECTED] tag' ELSE '' END AS note_text FROM events"
SQL_LOG = f"log AS ({LOGGED}), dim AS (SELECT * FROM {ORDERED}), runs AS ({RUN_ROWS}), gates AS (SELECT DISTINCT run, ord, phase FROM log WHERE kind IN ('gate', 'skip'))"


def _log(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    phase = F.get(F.array(*map(F.lit, runlog.PHASES)), F.expr(f"int({PHASE})"))
    rows = events.where(f"{PHASE} < user_id % 14 and (event_id % 3 = 0 or user_id % 2 = 0)").select(F.expr("'u' || user_id").alias("run"), F.col("event_id").alias("seq"), phase.alias("phase"), F.expr(KIND).alias("kind"), F.lit("t").alias("tool"), F.expr(PAYLOAD).alias("payload"))
    return rows, events.selectExpr("'u' || user_id AS run", "if(user_id % 4 < 2, 'thematic', 'sutta') AS run_class", "if(user_id % 5 = 0, 'a [REJECTED] tag', '') AS note_text").distinct()


@query(
    f"WITH {SQL_LOG}, last AS (SELECT run, max(ord) AS last_ord, max_by(phase, ord) AS last_gate FROM gates GROUP BY run), spot AS (SELECT r.run, run_class, last_ord, last_gate FROM runs r LEFT JOIN last USING (run))"
    " SELECT a.run, any_value(last_gate) AS last_gate, min_by(d.phase, d.ord) AS next_phase FROM spot a LEFT JOIN dim d ON d.ord > coalesce(last_ord, -1) AND NOT (last_ord IS NOT NULL AND run_class = 'thematic' AND d.phase IN ('2.5', '3b')) GROUP BY a.run"
)
def resume_phase(spark, sf_dir):
    return runlog.resumed(*_log(spark, sf_dir))


@query(
    f"WITH {SQL_LOG}, w AS (SELECT run, phase, bool_or(kind = 'skip') AS skipped, bool_or(kind = 'gate') AS gated, bool_or(kind = 'entry' AND contains(lower(payload), 'would be searched')) AS promised, count(*) FILTER (kind = 'entry') AS evidence FROM log GROUP BY run, phase)"
    " SELECT run, phase, CASE WHEN promised THEN 'placeholder' ELSE 'empty' END AS issue FROM w WHERE gated AND NOT skipped AND phase IN ('1', '2', '2.5', '3', '3b', '4', '4b', '4c', '6') AND (promised OR evidence = 0)"
)
def phase_issues(spark, sf_dir):
    return runlog.content_issues(_log(spark, sf_dir)[0])


@query(
    f"WITH {SQL_LOG}, asked AS (SELECT run, run_class, note_text, ord, phase FROM runs, dim WHERE phase IN ('1', '4', '6', '7')),"
    " lack AS (SELECT a.run, a.phase, min_by(d.phase, d.ord) AS missing_phase FROM asked a JOIN dim d ON d.ord < a.ord WHERE NOT (run_class = 'thematic' AND d.phase IN ('2.5', '3b')) AND NOT EXISTS (SELECT 1 FROM gates g WHERE g.run = a.run AND g.phase = d.phase) GROUP BY a.run, a.phase),"
    " w AS (SELECT run, phase, count(*) FILTER (kind = 'entry') AS entries, count(*) FILTER (kind = 'gate') AS gate FROM log GROUP BY run, phase),"
    " r AS (SELECT a.run, a.phase, missing_phase, CASE WHEN missing_phase IS NOT NULL THEN 'earlier gate missing' WHEN coalesce(gate, 0) > 0 THEN NULL WHEN a.phase = '7' THEN 'self-audit missing' WHEN coalesce(entries, 0) = 0 THEN 'no evidence' END AS reason FROM asked a LEFT JOIN lack USING (run, phase) LEFT JOIN w USING (run, phase))"
    " SELECT run, phase, reason IS NULL AS ok, missing_phase, reason FROM r"
)
def gate_check(spark, sf_dir):
    log, runs = _log(spark, sf_dir)
    requests = runs.select("run", F.explode(F.array(*map(F.lit, ("1", "4a", "6", "7")))).alias("phase"))
    return runlog.gate_checks(requests, log, runs)


@query(
    f"WITH {SQL_LOG}, old AS (SELECT * FROM log WHERE seq % 3 = 0), new AS (SELECT * FROM log WHERE seq % 3 = 1), last AS (SELECT run, max(seq) AS upto FROM old GROUP BY run)"
    " SELECT run, CAST(seq AS BIGINT) AS seq, phase FROM old UNION ALL SELECT n.run, CAST(coalesce(upto, 0) + row_number() OVER (PARTITION BY n.run ORDER BY n.seq) AS BIGINT), phase FROM new n LEFT JOIN last USING (run)"
)
def log_append(spark, sf_dir):
    log = _log(spark, sf_dir)[0]
    spelt = F.when(F.col("phase") == "4", "4a").otherwise(F.col("phase"))
    return runlog.appended(log.where("seq % 3 = 0"), log.where("seq % 3 = 1").withColumn("phase", spelt)).select("run", "seq", "phase")


@query(
    "WITH h AS (SELECT 'c' || c_custkey AS run, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['question_polished', 'scope_assumptions'] ELSE ['question_polished', 'scope_assumptions', 'ambiguity_status'] END) AS tool FROM customer)"
    " SELECT run, '0' AS phase, 'header' AS kind, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY run UNION ALL SELECT run, '0', 'gate', 1 FROM h GROUP BY run HAVING count(*) = 3"
)
def log_start(spark, sf_dir):
    fields = "if(c_custkey % 3 = 0, array('question_polished', 'scope_assumptions'), array('question_polished', 'scope_assumptions', 'ambiguity_status'))"
    head = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS run", f"posexplode({fields}) AS (at, tool)").selectExpr("run", "at + 1L AS seq", "'0' AS phase", "'header' AS kind", "tool", "'x' AS payload")
    once = runlog.started(head.limit(0), head)
    return runlog.started(once, head).groupBy("run", "phase", "kind").agg(F.count("*").alias("n"))


ANSWERS = "CASE user_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 7 END"
USERS = "users AS (SELECT DISTINCT user_id FROM events)"


@query(
    f"WITH {USERS}, g AS (SELECT 'u' || user_id AS run, {ANSWERS} AS n, user_id % 8 = 2 AS blank, user_id % 3 = 0 AS before FROM users),"
    " r AS (SELECT run, CASE WHEN before THEN 'audited before' WHEN n <> 6 OR blank THEN 'answers missing or too many' END AS reason FROM g)"
    " SELECT r.run, coalesce(reason = 'audited before', true) AS ok, reason IS NULL AS recorded, reason, CAST(CASE WHEN reason IS NULL THEN 7 ELSE 1 END AS BIGINT) AS entries FROM r"
)
def self_audit(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    log = users.selectExpr("'u' || user_id AS run", "1L AS seq", "'7' AS phase", "if(user_id % 3 = 0, 'audit', 'entry') AS kind", "'x' AS payload")
    answers = users.selectExpr("'u' || user_id AS run", f"explode(sequence(1L, {ANSWERS})) AS at", "user_id").selectExpr("run", "at", "if(user_id % 8 = 2 AND at = 4, ' ', ' yes ') AS answer")
    entries = runlog.audited(log, answers).groupBy("run").agg(F.count("*").alias("entries"))
    return runlog.audits(log, answers).join(entries, "run")


@query(
    f"WITH {USERS} SELECT 'u' || user_id AS run, CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN 'n' || user_id ELSE 'old' END AS note_path,"
    " CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 AND user_id % 4 = 0 THEN 'new.pdf' ELSE 'old.pdf' END AS pdf FROM users"
)
def set_note(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    runs = users.selectExpr("'u' || user_id AS run", "'old' AS note_path", "'old.pdf' AS pdf")
    requests = users.where("user_id % 3 = 0").selectExpr("'u' || user_id AS run", "'n' || user_id AS note_path", "if(user_id % 4 = 0, 'new.pdf', null) AS pdf")
    return runlog.with_notes(runs, requests, users.where("user_id % 2 = 0").selectExpr("'n' || user_id AS path"))


@query(
    "WITH r AS (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN 's' || (user_id % 97) ELSE '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || '-s' || (user_id % 97) END AS run FROM events WHERE user_id % 97 < 90 AND NOT (event_id % 7 = 0 AND user_id % 97 > 40)),"
    " s AS (SELECT DISTINCT 's' || (user_id % 97) AS slug FROM events)"
    " SELECT slug, coalesce((SELECT run FROM r WHERE run = slug), (SELECT max(run) FROM r WHERE regexp_matches(run, '^[0-9]{4}-[0-9]{2}-[0-9]{2}-') AND substr(run, 12) = slug)) AS run FROM s"
)
def which_run(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.where("user_id % 97 < 90 and not (event_id % 7 = 0 and user_id % 97 > 40)").selectExpr("if(event_id % 7 = 0, 's' || (user_id % 97), '2024-01-' || lpad(string(event_id % 28 + 1), 2, '0') || '-s' || (user_id % 97)) AS run")
    return runlog.named(events.selectExpr("'s' || (user_id % 97) AS slug"), runs)


CALLED = "CASE event_id % 5 WHEN 0 THEN 'gate' WHEN 1 THEN 'which' ELSE 'search' END"
RESULT = "CASE event_id % 4 WHEN 0 THEN '[1, {\"a\": [2]}, \"x\"]' WHEN 1 THEN '[]' WHEN 2 THEN '{\"n\": 1}' ELSE NULL END"
PINNED = "CASE event_id % 6 WHEN 0 THEN '4a' WHEN 1 THEN '6' ELSE NULL END"


@query(
    f"WITH c AS (SELECT 'u' || user_id AS run, user_id, event_id, {CALLED} AS tool, {RESULT} AS result, {PINNED} AS phase FROM events)"
    " SELECT run, CAST(10 + row_number() OVER (PARTITION BY run ORDER BY event_id) AS BIGINT) AS seq, CASE phase WHEN '4a' THEN '4' ELSE coalesce(phase, CASE WHEN user_id % 4 = 0 THEN '3' END, '?') END AS phase, tool,"
    " CASE event_id % 4 WHEN 0 THEN CAST(3 AS BIGINT) WHEN 1 THEN 0 END AS hits, phase IS NOT NULL AS pinned FROM c WHERE tool = 'search' AND user_id % 2 = 0"
)
def call_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    users = events.select("user_id").distinct()
    log = users.where("user_id % 2 = 0").selectExpr("'u' || user_id AS run", "10L AS seq", "'0' AS phase", "'header' AS kind")
    calls = events.select(F.expr("'u' || user_id").alias("run"), F.col("event_id").alias("seq"), F.expr(CALLED).alias("command"), F.lit("-q x").alias("args"), F.expr(RESULT).alias("result"), F.expr(PINNED).alias("phase"))
    at = users.where("user_id % 4 = 0").selectExpr("'u' || user_id AS run", "'3' AS phase")
    return runlog.logged_calls(log, calls, at).where("kind = 'entry'").select("run", "seq", "phase", "tool", "hits", "pinned")
