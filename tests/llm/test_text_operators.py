import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from scriptorium.llm import decontaminate, html_extract, langid

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    """(words, hit, item ids) by comparing every window with every place."""
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(len(x), window)
        for i in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=5), st.lists(st.sampled_from("abcde"), max_size=40), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_automaton_finds_what_brute_force_does(items, text, window):
    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    automaton = decontaminate.Automaton([(n, decontaminate.words_of(t.encode())) for n, t in named], window)
    doc = " ".join(text)
    matches = list(automaton.matches(decontaminate.words_of(doc.encode())))
    hit = decontaminate.joined([(a, b) for a, b, _ in matches])
    assert (len(text), sum(b - a for a, b in hit), sorted(set().union(*(n for _, _, n in matches)) if matches else [])) == brute(doc, named, window)


def test_decontamination(spark):
    r = random.Random(3)
    items = [(k, " ".join(r.choice("alpha Beta gamma delta éps".split()) + str(r.randint(0, 9)) for _ in range(r.choice([12, 15, 30])))) for k in range(6)] + [(10, "short item here"), (2, "second text of item two, the same id"), (11, None), (12, "...")]
    docs = [(1, f"intro words {items[0][1]}! outro words that are more than the passage is long " + "filler text " * 20), (2, items[1][1].upper().replace(" ", "\n") + " x"), (3, "clean text"), (4, None), (5, ""), (6, "a Short, ITEM\there " + "more words " * 9), (7, " ".join(items[2][1].split()[:9]) + " end"), (8, "clean text"), (None, items[0][1] + " pad" * 80)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    table = spark.createDataFrame([(d, t, None if t is None else len(t), 1) for d, t in docs], "doc_id long, text string, n_chars long, found int")
    got = {(x.doc_id, x.n_words, x.n_hit): (x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.report(table, benchmark).collect()}
    want = {}
    for d, t in docs:
        n, hit, found = brute(t, items)
        want[(d, n, hit)] = (len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    assert got == want
    cleaned = {x.doc_id: x for x in decontaminate.decontaminate(table, benchmark).collect()}
    assert set(cleaned) == {1, 3, 4, 5, 6, 7, 8, None} and decontaminate.decontaminate(table, benchmark).columns == table.columns
    for x in cleaned.values():
        assert brute(x.text, items)[1] == 0 and (x.text is None or x.n_chars == len(x.text))
    assert cleaned[3].text == "clean text" and cleaned[1].text.startswith("intro words \n! outro words")
    assert decontaminate.report(table.limit(0), benchmark).collect() == []
    blocks = list(decontaminate.automata(benchmark, block_words=20))
    assert len(blocks) > 3
    split = table.select("doc_id", decontaminate.contamination(F.col("text"), blocks, cleaned=False).alias("f")).select("doc_id", "f.n_hit").collect()
    assert sorted((str(x.doc_id), x.n_hit) for x in split) == sorted((str(d), hit) for d, _, hit in want)
    assert {x.n_hit for x in decontaminate.report(table, benchmark.limit(0)).collect()} == {0}
    passes = {"block_words": 20, "pass_blocks": 1}
    assert sorted(map(str, decontaminate.report(table, benchmark, **passes).collect())) == sorted(map(str, decontaminate.report(table, benchmark).collect()))
    assert sorted(map(str, decontaminate.decontaminate(table, benchmark, **passes).collect())) == sorted(map(str, cleaned.values()))
    longer = {x.doc_id: x.text for x in decontaminate.decontaminate(table, benchmark, longest=12).collect()}
    assert longer[6] == dict(docs)[6] and longer[1] == cleaned[1].text


def language_rows():
    r = random.Random(8)
    parts = {"en": "the and ing tion ed er th wh".split(), "fr": "le la eau oui ment que é ç".split(), "de": "sch ung keit ein der ü ß ch".split()}
    out = []
    for i in range(240):
        lang = r.choice(sorted(parts))
        out.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang))
    return out


def test_language(spark):
    rows = language_rows()
    docs = spark.createDataFrame([*[(*x, "y") for x in rows], (900, None, "en", "y"), (901, "12 ²½ !!", "fr", "y"), (902, "", None, "y"), (None, rows[0][1], None, "y"), (903, rows[1][1], None, "y")], "doc_id long, text string, lang string, score string")
    got = langid.report(docs).collect()
    assert len(got) == len(rows) + 5
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
    truth = {d: lang for d, _, lang in rows}
    tested = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(tested) > 50 and sum(x.lang_pred == truth[x.doc_id] for x in tested) / len(tested) > 0.95
    by = {x.doc_id: x for x in got}
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred == by[rows[1][0]].lang_pred and by[903].score == by[rows[1][0]].score
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got} - {900, 901, 902}
    assert kept.where("doc_id = 903").first().lang == by[903].lang_pred
    none = langid.report(docs.limit(0))
    assert none.collect() == [] and {x.lang_pred for x in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


RUSSIAN = "Сегодня утром на площади собрались люди чтобы послушать музыку и поговорить о погоде. Потом пошёл дождь и все разошлись по домам, а оркестр продолжал играть под навесом до самого вечера, пока не стемнело"


def test_short_texts_of_no_known_language(spark):
    r = random.Random(4)
    noise = [" ".join("".join(r.choice("bcdfgjkmpqvxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (2, 3, 5, 30, 30, 30, 30, 30)]
    foreign = [RUSSIAN[:n] for n in (8, 15, 90, 130, 190)] + noise
    rows = [*language_rows(), *[(1000 + k, x, None) for k, x in enumerate(foreign)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    found = {x.doc_id: x.f for x in docs.select("doc_id", langid.predicted(F.col("text"), model, spark.sparkContext).alias("f")).collect()}
    kept = {x.doc_id: x.lang for x in langid.accepted(docs).collect()}
    assert {d for d, _, lang in rows if lang} <= set(kept)
    assert not {1002, 1003, 1004} & set(kept) and sum(d in kept for d in range(1008, 1013)) <= 1
    unsure = {d for d in kept if d >= 1000 and found[d].score < 0.54}
    assert unsure and all(kept[d] is None for d in unsure)


def test_learning_and_prediction_by_brute_force(spark):
    rows = language_rows()[:60]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "Une seule ligne, sans langue", None)], "doc_id long, text string, lang string")

    def bundle(text):
        padded = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        runs: dict = {}
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            runs[a, b, c] = runs.get((a, b, c), 0) + 1
        v = np.zeros(langid.DIMENSION)
        for (a, b, c), n in runs.items():
            v += n * np.roll(langid.letter_vector(ord(a)), 2).astype(float) * np.roll(langid.letter_vector(ord(b)), 1) * langid.letter_vector(ord(c))
        return v, sum(n * n for n in runs.values()) ** 0.5

    sums: dict = {}
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1:
            v, size = bundle(text)
            sums[lang] = sums.get(lang, 0) + v / size
    names = sorted(sums)
    m = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    m -= m.mean(0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for x in langid.report(docs).collect():
        text = {d: t for d, t, *_ in [*rows, (900, None), (901, "Une seule ligne, sans langue")]}[x.doc_id]
        if text is None:
            assert (x.lang_pred, x.score) == ("und", 0)
            continue
        cosines = m @ bundle(text)[0] / np.linalg.norm(bundle(text)[0])
        assert abs(x.score - (1 + cosines.max()) / 2) < 1e-4 and cosines[names.index(x.lang_pred)] > cosines.max() - 1e-4


def test_very_long_texts(spark):
    rows = language_rows()
    long = {i: " ".join(t for _, t, lang in rows if lang == name) for i, name in enumerate(["en", "fr", "de"])}
    docs = spark.createDataFrame([*rows, *((5000 + i, (t + " ") * (4_000_000 // len(t)), None) for i, t in long.items())], "doc_id long, text string, lang string")
    found = {x.doc_id: x.lang_pred for x in langid.report(docs).where("doc_id >= 5000").collect()}
    assert found == {5000: "en", 5001: "fr", 5002: "de"}
    body = STORY * 8000
    assert html_extract.extract_many([page(MENU + f"<article>{body}</article>")], html_extract.trained()) == [" ".join([SAID] * 8000)]


def test_language_by_brute_force():
    text = "Ab b²c, é!"
    runs = [" ab", "ab ", "b b"[0:0] or " b ", " c ", " é "]
    expected = np.zeros(langid.DIMENSION)
    padded = " ab b²c é "
    del runs
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        expected += np.roll(langid.letter_vector(ord(a)), 2).astype(int) * np.roll(langid.letter_vector(ord(b)), 1) * langid.letter_vector(ord(c))
    assert (langid.bundle(text) == expected).all()


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='</p>';</script></head><body>{body}</body></html>"


MENU = "<nav><ul>" + "".join(f'<li><a href="/{k}">item {k}</a></li>' for k in range(6)) + "</ul></nav>"
STORY = "<p>The first paragraph says something about the matter, at length. It has two sentences.</p><p>The second one goes on &amp; on, with <b>bold</b> words<br>and a break.</p>"
WARNED = "The part stands out from the rest, though it belongs to the text. It says what readers should know before they go on."
SAID = "The first paragraph says something about the matter, at length. It has two sentences. The second one goes on & on, with bold words and a break."


def test_pages():
    model = html_extract.trained()
    cases = {
        page(MENU + f"<article><h1>A title here</h1>{STORY}</article><footer>&copy; me &middot; all rights</footer>"): "A title here " + SAID,
        page(f'<div class="cookie-notice"><p>We use cookies, accept them all.</p></div>{MENU}<div class="ad">Buy this thing now.</div><main><article><h1>A title</h1>{STORY}</article><section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with the author of this at all, sorry.</p></div><div class="comment"><p>Nice one, thank you for the text.</p></div></section></main><aside class="sidebar"><h3>More</h3><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></aside><form><label>Mail</label><input><button>Go</button></form><footer>Foot</footer>'): "A title " + SAID,
        "": "",
        "<html><body></body></html>": "",
    }
    assert html_extract.extract_many([*cases, None], model) == [*cases.values(), ""]


def test_elements_without_an_end_tag():
    model = html_extract.trained()
    story = f"<article><h1>A title here</h1>{STORY}</article>"
    want = f"A title here {SAID}"
    foot = "<footer>&copy; me &middot; all rights</footer>"
    before = ["<button>Menu", "<div><button class=x>Menu</div>", "<object data=a.swf>", "<select><option>One<option>Two", "<video src=a>", "<canvas>", "<svg><path d='M0 0'>", "<noscript>No", "<button><b>Menu</b><button>More", "<template>", "<audio>x"]
    after = ["", "<form><button>Go</button></form>", "<div><object><p>plug</p></object></div>"]
    pages = [page(b + MENU + story + a + foot) for b in before for a in after]
    assert html_extract.extract_many(pages, model) == [want] * len(pages)
    whole = "<svg><g><svg></svg><text>no</text></g></svg> <button><div>no</div></button> <object><object><p>no</p></object>no</object> <select><option>no</select> <video><p>no</p></video>"
    inside = html_extract.Page(f"<article><p>One {whole}two <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><script>no</article>")
    assert inside.text([True] * len(inside.tag)) == "One two x=1."
    deep = html_extract.Page("<object><div>" * 3000 + "text" + "<button>" * 3000)
    assert deep.text([True] * len(deep.tag)) == "text"


def test_parts_of_an_article_with_everyday_names():
    model = html_extract.trained()
    parts = [f'<p class=warning>{WARNED}</p>', f'<section class=more><p>{WARNED}</p><p>{WARNED}</p><p>{WARNED}</p></section>', f'<aside class=pullquote>{WARNED}</aside>', f'<p data-id="ad" data-class=footer title="class=ad">{WARNED}</p>', f'<div class=popular><p>{WARNED}</p></div>']
    for part in parts:
        want = f"A title here {SAID} {' '.join([WARNED] * part.count(WARNED))} {SAID}"
        source = page(MENU + f"<article><h1>A title here</h1>{STORY}{part}{STORY}</article><footer>&copy; me &middot; all rights</footer>")
        assert html_extract.extract_many([source], model) == [want], part


def test_articles_of_the_given_pages():
    """Against the article elements, found here by the standard library's parser, without what is no main text in them."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.depth, self.skip = [], 0, []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if self.skip or tag in ("script", "style", "form", "aside", "nav") or {"ad", "comments"} & set((dict(attrs).get("class") or "").split()):
                self.skip += [tag] if tag not in html_extract.VOID else []
            if tag in html_extract.BLOCK or tag == "br":
                self.out.append(" ")

        def handle_endtag(self, tag):
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()
            elif tag == "article":
                self.depth -= 1
            if tag in html_extract.BLOCK:
                self.out.append(" ")

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.out.append(data)

    sources = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    found = html_extract.extract_many(sources, html_extract.trained())
    right = 0
    for source, text in zip(sources, found, strict=True):
        p = Article()
        p.feed(source or "")
        right += " ".join("".join(p.out).split()) == text
    assert len(sources) > 200 and right == len(sources)


def test_time_grows_with_the_page():
    def seconds(make, n):
        taken = []
        for _ in range(2):
            began = time.perf_counter()
            p = html_extract.Page(make(n))
            p.features()
            p.text([True] * len(p.tag))
            taken.append(time.perf_counter() - began)
        return min(taken)

    makes = [
        lambda n: "<b>" * n + "<p>x</p>" * n,
        lambda n: "<p><x-y>" + "<b>" * n + "<p>x</p>" * n,
        lambda n: "<ul>" + "<b>" * n + "<li>x</li>" * n,
        lambda n: "<b>" * n + "<a>x</a>" * n,
        lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
        lambda n: "<head/>" * n,
        lambda n: f"<article>{STORY}</article>" * (n // 20),
    ]
    for k, make in enumerate(makes):
        small, large = seconds(make, 30_000), seconds(make, 60_000)
        assert large < 2.5 * small + 0.3, (k, small, large)


def test_made_up_pages_not_learned_from():
    model = html_extract.trained()
    right = 0
    for k in range(60):
        p = html_extract.Page(html_extract.training_page(5_000_000 + k))
        x, want = p.features()
        right += p.text(html_extract.decode(p, model.log_odds(x).tolist())) == p.text(want)
    assert right >= 54


def test_decoding_never_contradicts():
    r = random.Random(1)
    for k in range(20):
        p = html_extract.Page(html_extract.training_page(6_000_000 + k))
        kept = html_extract.decode(p, [r.uniform(-4, 4) for _ in p.tag])
        assert all(kept[p.parent[i]] for i in range(1, len(kept)) if kept[i])


@given(st.text("<>/pabdivul !-\"'=&;nx\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_parser_takes_anything(source):
    p = html_extract.Page(source)
    p.text([True] * len(p.tag))
    p.features()


def test_page_table(spark):
    rows = [(1, "u", page(f"<article>{STORY}</article>")), (2, None, None), (2, "v", ""), (3, "w", "plain text only, no markup")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url or "", r.text, r.n_chars) for r in html_extract.report(df).collect()))
    assert [g[:2] for g in got] == [(1, "u"), (2, ""), (2, "v"), (3, "w")] and got[0][2:] == (SAID, len(SAID)) and got[1][2:] == ("", 0)
    assert html_extract.report(df.limit(0)).collect() == []


_STORY = {
    "plain": [
        "The river rose for three days, and on the fourth it left its bed and took the lower road with it.", "Nobody in the village had seen such water before. The old people spoke of a flood in their own childhood, but that one had come slowly.",
        "When the bridge went, the two halves of the town could only shout to each other. Boats were brought from the lake.", "On the fifth day the rain stopped. Men from the county came to measure the damage, and they wrote long lists.",
        "It took until autumn to rebuild the road, and the bridge was not open again before the next spring.", "Today a stone by the mill shows how high the water stood. Children are told to touch it, and few of them can reach the line.",
    ],
    "short": ["Short one.", "A second line here.", "Third thing, said plainly.", "Four words are enough.", "Five of them now.", "And the last."],
}
_STORY["long"] = [p * 3 for p in _STORY["plain"]]
_AROUND = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header class="site-header"><h2>NOISE</h2></header>',
    '<aside class="sidebar"><h3>NOISE</h3><ul><li><a href="/1">One link</a></li><li><a href="/2">Two links</a></li></ul></aside><div class="cookie-notice">NOISE We use cookies.</div>'
    '<section class="comments"><h3>Comments</h3><div class="comment"><b>Jo</b><p>NOISE nice story.</p></div><div class="comment"><b>Al</b><p>NOISE I liked it.</p></div></section><footer>&copy; 2024 NOISE</footer>',
)


def _story_shapes(t: list[str]):
    """(shape, inner markup) of a story of six paragraphs, built as pages build them."""
    ps = lambda x: "".join(f"<p>{y}</p>" for y in x)
    for tag in ("section", "div"):
        for name in ("", ' class="chapter"', ' class="text"', ' class="body"', ' class="more"', ' class="review"', ' class="info"', ' class="message"', ' class="note"', ' class="summary"', ' class="content"', ' id="x7"'):
            for h in ("", "<h2>A head</h2>"):
                box = lambda x, tag=tag, name=name, h=h: f"<{tag}{name}>{h}{ps(x)}</{tag}>"
                yield "boxes", box(t[:2]) + box(t[2:4]) + box(t[4:])
                yield "lead and body", ps(t[:1]) + box(t[1:])
                yield "end", ps(t[:4]) + box(t[4:])
                yield "middle", ps(t[:2]) + box(t[2:4]) + ps(t[4:])
                yield "nested", f"<{tag}{name}><div>{h}{ps(t[:3])}</div><div>{ps(t[3:])}</div></{tag}>"
    yield "details at the end", ps(t[:4]) + "<details><summary>More of it</summary>" + ps(t[4:]) + "</details>"
    yield "details in the middle", ps(t[:2]) + "<details><summary>More of it</summary>" + ps(t[2:4]) + "</details>" + ps(t[4:])


@pytest.mark.parametrize("kind", _STORY)
def test_articles_stay_whole_whatever_they_are_built_of(kind):
    pages, names = [], []
    for shape, inner in _story_shapes(_STORY[kind]):
        for outer in ("article", "main", 'div class="content"'):
            for before, after in (("", ""), _AROUND):
                pages.append(f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}<{outer}><h1>The title</h1>{inner}</{outer.split()[0]}>{after}</body></html>")
                names.append((shape, outer, bool(before)))
    texts = html_extract.extract_many(pages, html_extract.trained())
    lost = [n for n, got in zip(names, texts, strict=True) if not all(p in got for p in _STORY[kind]) or not got.startswith("The title")]
    assert not lost and not any("NOISE" in got for got in texts)
