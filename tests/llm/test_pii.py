import hashlib
import random
import re
import time

from scriptorium.llm import pii

#: The base patterns as the contract has them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(spans)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def texts():
    r = random.Random(11)
    bits = ["a", "b.c", "@", ".", "..", "-", " ", "+", "1", "22", "255", "256", "0", "4539 1488 0343 6467", "4111111111111111", "(", ")", "é", "日", "x@y.z", "+1 (555) 555-2485", "10.0.0.1", "%", "_", "\n", "999", "😀"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    return [*out, None, "", "a" * 40000, "1" * 40000, "1 " * 20000, "a." * 20000 + "@" + "b." * 20000 + "c", "a@b.c+x@d.e", "1.2.3.4.5.6.7.8", "+" * 3000, "+1" + "(" * 30000, "\U0001f600 me@site.org \U0001f600 4111-1111-1111-1111"]


def test_base_against_python(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pii string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, r = base(t), got[i]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (t or "")[:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in PATTERNS)
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def masked_by_hand(text, spans):
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_masking_by_brute_force(spark):
    more = ["a@b.co 1.2.3.4 " * 400, "\U0001f600 4111-1111-1111-1111 +1 (555) 555-2485é" * 90, "1.1.1.1.1.1@x.y" * 50]
    rows = list(enumerate([*texts(), *more]))
    got = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Of these texts none has a span of the further kinds.
    assert got == {i: t if t is None else masked_by_hand(t, base(t)) for i, t in rows}


def test_time_grows_with_the_matches(spark):
    def seconds(text):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = pii.report(docs).collect()
        (clean,) = pii.masked(docs).collect()
        return time.perf_counter() - began, row, clean.text

    for unit, kind in (("12 ab ", None), ("a@b.co ", "n_email"), ("4111111111111111, ", "n_card")):
        tail = " 4111 1111 1111 1111"
        (small, _, _), (large, row, clean) = seconds(unit * 100_000 + tail), seconds(unit * 200_000 + tail)
        assert large < 2.5 * small + 1, (unit, small, large)
        assert row.n_card == (200_001 if kind == "n_card" else 1) and (kind is None or row[kind] >= 200_000) and clean.endswith("<CARD>")


def test_further_kinds_and_masking(spark):
    rows = [(1, "Pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "DE89370400440532013001 is wrong"), (3, "account GB82WEST12345698765432"), (4, "SSN 123-45-6789"), (5, "part 123-45-6789"), (6, None), (7, "mail a@b.co, a@b.co"), (8, "Konto " + "x" * 41 + " DE89370400440532013001 123-45-6789"), (9, "ssn 123-45-6789, id number: 987-65-4321 and DE89370400440532013000@x.yz")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "p", "c") for i, t in rows], "doc_id long, text string, n_chars long, pii string, row string")
    found = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert found == {1: "iban:12:39", 2: "", 3: "iban:8:30", 4: "national_id:4:15", 5: "", 6: "", 7: "email:5:11,email:13:19", 8: "", 9: "national_id:4:15,national_id:28:39,email:44:71"}
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.masked(docs).collect()}
    assert {(r.pii, r.row) for r in pii.masked(docs).collect()} == {("p", "c")}
    assert clean[7] == ("mail <EMAIL>, <EMAIL>", 21) and clean[6] == (None, 0) and clean[1][0] == "Pay to IBAN <IBAN> now"
    assert pii.report(docs.limit(0)).collect() == [] and pii.masked(docs).columns == docs.columns
