"""Labels, notes and renderings over small tables, with what they have to be written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import align, citations, notes


def relation(spark, columns, values):
    names = [c.split()[0] for c in columns.split(", ")]
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return raw.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in columns.split(", ")])


def equal(spark, got, columns, values):
    want = relation(spark, columns, values)
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*want.columns).collect())))
    assert rows(got) == rows(want)


INFO = "book_code string, sc_code string, cst_code string, dpd_code string, dpr_code string, bjt_sutta_code string, cst_file string, cst_paranum string, cst_sutta string"
SEG = "book_code string, id long, rend string, paranum string, pali_text string, english_translation string"
SEGMENT_COLUMNS = "kind string, author string, file_stem string, uid string, seg_key string, line_no int, path string, text string"
SEGMENTS = """
('s0202m_mul', 1, 'book', '', 'Majjhimanikāyo', ''),
('s0202m_mul', 2, 'chapter', '', '1. Gahapativaggo', ''),
('s0202m_mul', 3, 'title', '', '10. Apaṇṇakasuttaṃ', ''),
('s0202m_mul', 4, 'bodytext', '92', 'Evaṃ me su<pb n="1"/>taṃ', 'Thus  have I heard'),
('s0202m_mul', 5, 'bodytext', '', 'ekaṃ samayaṁ', 'one time'),
('s0202m_mul', 6, 'subhead', '', 'Vaṇṇanā', ''),
('s0202m_mul', 7, 'bodytext', '93', 'Bhagavā', 'The Blessed One'),
('s0202m_mul', 8, 'chapter', '', '2. Bhikkhuvaggo', ''),
('s0202m_mul', 9, 'bodytext', '94', 'atha kho', 'then'),
('s0501m_mul', 1, 'chapter', '', 'Khuddakapāṭho', ''),
('s0501m_mul', 2, 'title', '', 'Saraṇattayaṃ', ''),
('s0501m_mul', 3, 'gatha', '1', 'buddhaṃ saraṇaṃ', 'refuge'),
('s0501m_mul', 4, 'title', '', 'Dasasikkhāpadaṃ', ''),
('s0501m_mul', 5, 'gatha', '1', 'pāṇātipātā', 'precept'),
('s0501m_mul', 6, 'gatha', '2-3', 'EVAṂ ME SUTAṂ', 'again'),
('e0101n_nrf', 1, 'book', '', 'Visuddhimaggo', ''),
('e0101n_nrf', 2, 'chapter', '', '8. Anussati', ''),
('e0101n_nrf', 3, 'subhead', '', 'Maraṇassati', ''),
('e0101n_nrf', 4, 'bodytext', '176', 'maraṇaṃ', 'death')
"""
DICTIONARY = """
('MN', 'MN60', 'mn2.1.10', 'MN60', NULL, NULL, 's0202m.mul.xml', '92', '10. Apaṇṇakasuttaṃ'),
('MN', 'MN61', 'mn2.2.1', 'MN61', NULL, NULL, 's0202m.mul.xml', '107', '1. Rāhulovādasuttaṃ'),
('DN', 'DN1', 'dn1.1', 'DN1-13', NULL, NULL, 's0101m.mul.xml', '', 'Brahmajālasuttaṃ'),
('DHP', 'DHP116-128', NULL, 'DHP9', NULL, NULL, 's0502m.mul.xml', '116', 'Pāpavaggo'),
('DHP', 'DHP90-00', NULL, 'DHP7', NULL, NULL, 's0502m.mul.xml', '90', 'Arahantavaggo'),
('AN', 'AN2.21-31', NULL, 'AN2.3', NULL, NULL, 's0402m1.mul.xml', '22', 'Bālavaggo'),
('AN', 'AN8.117-626', NULL, 'AN8.117', NULL, NULL, 's0404m1.mul.xml', '1', 'Rāgapeyyālaṃ'),
('SN', 'SN56.27', 'sn5', 'SN56.27', NULL, NULL, 's0305m.mul.xml', '1', 'Tathasuttaṃ'),
('SN', 'SN56.28', 'sn6', 'SN56.28', NULL, NULL, 's0305m.mul.xml', '2', 'Lokasuttaṃ'),
('SN', 'SN4.8', 'sn7', 'SN4.8', NULL, NULL, 's0301m.mul.xml', '5', 'Nandatisuttaṃ'),
('SNP', 'SNP4.8', 'snp1', 'SNP48', NULL, NULL, 's0505m.mul.xml', '830', 'Pasūrasuttaṃ'),
('TH', 'TH5', NULL, 'TH5', NULL, NULL, 's0508m.mul.xml', '5', 'Dabbattheragāthā'),
('KHP', 'KHP1', NULL, 'KHP1', NULL, NULL, 's0501m.mul.xml', '1', 'Saraṇattayaṃ')
"""
ASKED = """
('s0202m_mul', '97'),
('s0202m_mul', '92'),
('s0202m_mul', '93-94'),
('s0202a_att', '92'),
('s0501m_mul', '1'),
('s0501m_mul', '2'),
('e0101n_nrf', '176'),
('vin01m_mul', '5'),
('dn1', '3')
"""
NOTE_ROWS = """
('good', 1, '---'),
('good', 2, 'tool: "https://example.org/tool"'),
('good', 3, 'agent: someone'),
('good', 4, 'topic: plain topic'),
('good', 5, 'canon_refs:'),
('good', 6, '  - MN 10'),
('good', 7, 'web_refs:'),
('good', 8, '- https://x.org/a'),
('good', 9, '---'),
('good', 10, '## Question'),
('good', 11, '## Findings'),
('good', 12, '## Canon Evidence (T1)'),
('good', 13, '> quoted [^1]'),
('good', 14, '## Sources Investigated, Not Used'),
('good', 15, '## Critical Gaps'),
('good', 16, '## Bibliography'),
('good', 17, '---'),
('good', 18, '[^1]: source'),
('bad', 1, '---'),
('bad', 2, 'tool: other'),
('bad', 3, 'topic: a: b'),
('bad', 4, 'web_refs:'),
('bad', 5, '- https://x.org a note'),
('bad', 6, 'library_refs:'),
('bad', 7, '- Book: part'),
('bad', 8, '---'),
('bad', 9, '## Question'),
('bad', 10, '## Pali Evidence (T1)'),
('bad', 11, 'a[^1] b[^2] c[^3]'),
('bad', 12, '[^1]: early'),
('bad', 13, 'MN 1 [REJECTED]'),
('bad', 14, '## Critical Gaps'),
('bare', 1, '## Question')
"""
LINES = """
('root', '', 'mn1', 'mn1', 'mn1:1.1', 1, 'a', 'Evaṁ me sutaṁ'),
('root', '', 'mn1', 'mn1', 'mn1:1.2', 2, 'a', 'ekaṁ samayaṁ'),
('root', '', 'dhp273-289', 'dhp277', 'dhp277:1', 1, 'b', 'Sabbe saṅkhārā'),
('root', '', 'dhp273-289', 'dhp278', 'dhp278:1', 2, 'b', 'Sabbe dukkhā'),
('translation', 'sujato', 'mn1', 'mn1', 'mn1:1.1', 1, 'c', 'So I have heard. '),
('translation', 'sujato', 'mn1', 'mn1', 'mn1:1.2', 2, 'c', ' '),
('translation', 'thanissaro', 'dhp273-289', 'dhp277', 'dhp277:1', 1, 'd', 'All fabrications')
"""
LABELS_COLUMNS = "book_code string, paranum string, human string, paranum_exists boolean"
LABELS = """
('s0202m_mul', '97', 'MN 02 §97 — not citable: paragraph 97 does not occur in s0202m_mul', false),
('s0202m_mul', '92', 'MN60 Apaṇṇakasuttaṃ para 92', true),
('s0202m_mul', '93-94', 'MN60 Apaṇṇakasuttaṃ para 93–94', true),
('s0202a_att', '92', 'MNa60 para 92', NULL),
('s0501m_mul', '1', 'KN 01 §1 — Khuddakapāṭho; several paragraphs have this number, under Saraṇattayaṃ / Dasasikkhāpadaṃ', true),
('s0501m_mul', '2', 'KN 01 §2 — Khuddakapāṭho, Dasasikkhāpadaṃ', true),
('e0101n_nrf', '176', 'Extra 0101 §176 (non-canonical) — Visuddhimaggo, 8. Anussati, Maraṇassati', true),
('vin01m_mul', '5', 'Vinaya 01 §5', NULL),
('dn1', '3', NULL, NULL)
"""
FAULTS_COLUMNS = "note string, code string, line long, severity string"
FAULTS = """
('bad', 'invalid-tool', 2, 'error'),
('bad', 'missing-agent', 1, 'error'),
('bad', 'invalid-topic', 3, 'error'),
('bad', 'invalid-web-ref', 5, 'error'),
('bad', 'invalid-library-ref', 7, 'error'),
('bad', 'rejected-citation', 13, 'error'),
('bad', 'missing-section', 9, 'error'),
('bad', 'missing-section', 9, 'error'),
('bad', 'missing-section', 9, 'error'),
('bad', 'missing-canon-ref', 1, 'error'),
('bad', 'invalid-footnote-placement', 12, 'error'),
('bad', 'under-quoted-evidence', 9, 'error'),('bare', 'missing-frontmatter', 1, 'error'),
('bare', 'missing-section', 1, 'error'),
('bare', 'missing-section', 1, 'warning'),
('bare', 'missing-section', 1, 'error'),
('bare', 'missing-section', 1, 'error'),
('bare', 'missing-section', 1, 'error')
"""
RENDERED_COLUMNS = "label string, text string"
RENDERED = """
('**Pāḷi**', 'Evaṁ me sutaṁ … ekaṁ samayaṁ'),
('Sujato (Bilara)', 'So I have heard.')
"""


def test_labels(spark):
    asked = relation(spark, "book_code string, paranum string", ASKED)
    equal(spark, citations.labels(asked, relation(spark, SEG, SEGMENTS), relation(spark, INFO, DICTIONARY)), LABELS_COLUMNS, LABELS)


def test_note_issues(spark):
    equal(spark, notes.issues(relation(spark, "note string, line_no long, text string", NOTE_ROWS), "https://example.org/tool"), FAULTS_COLUMNS, FAULTS)


def test_renderings(spark):
    lines = relation(spark, SEGMENT_COLUMNS, LINES)
    equal(spark, align.renderings(lines, align.located(lines, "a"), "mn1"), RENDERED_COLUMNS, RENDERED)
