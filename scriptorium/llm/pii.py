"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Everything is DataFrame expressions.  Matches come from ``regexp_extract_all``; their places from the lengths of what
``split`` leaves between them, since both walk a text with the same matcher, summed in blocks (``_running``), so the time
grows with the text and its matches, not with their product.  The patterns are written so that Java's matcher needs neither
deep recursion nor repeated scans of a long run: repetitions that nothing follows are possessive, a match starts inside a
run only where the one before it ended (``\\G``), and runs of digits too short for a card are not taken up.  That
changes no match that stays.

Kinds and scores.  email, ip, card and phone are the base kinds: a match that passes its test (parts up to 255; Luhn and
14 to 19 digits; 10 to 15 digits) always stays.  The further kinds are iban (country, two check digits, 11 to 30 letters
and digits, valid by mod 97: 0.6, with a context word 0.9, without a valid checksum 0.3 or 0.6) and national_id (three, two
and four digits with hyphens: 0.3, with a context word 0.8).  A span of these stays from a score of 0.6, if it overlaps no
base span.  A context word counts if it ends at most 40 characters before a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
FURTHER = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {"iban": r"(?:iban|account|konto|kontonummer|compte|cuenta|bank|banque|banco)", "national_id": r"(?:ssn|social security|identification|id number|national id)"}
#: What a match of a further kind begins with; context is only looked for there.
_BEGINS = {"iban": r"[A-Z]{2}[0-9]{2}", "national_id": r"[0-9]{3}-[0-9]{2}-"}
LEAST_SCORE = 0.6
KINDS = [*BASE, *FURTHER]
SPAN = "struct<start: int, order: int, end: int, kind: string, score: double>"

# Expressions are SQL text: built in one call, where column functions take thousands.


def _let(value: str, name: str, body: str) -> str:
    """body with name for a value that is computed once, however often body uses it (a lambda's body would compute it for
    each element)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn test."""
    each = f"transform(split(reverse({digits}), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, int(d) * 2 - 9, int(d) * 2)))"
    return f"aggregate({each}, 0, (a, b) -> a + b) % 10 = 0"


def mod97(iban: str) -> str:
    """Whether an IBAN, in capitals and digits with or without spaces, has a remainder of 1."""
    plain = f"replace({iban}, ' ', '')"
    values = f"transform(split(concat(substring({plain}, 5, 99), substring({plain}, 1, 4)), ''), c -> if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55))"
    return f"aggregate({values}, 0, (a, v) -> if(v > 9, (a * 100 + v) % 97, (a * 10 + v) % 97)) = 1"


def _passes(kind: str, match: str) -> str:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return rf"{match} rlike r'^{part}(?:\.{part}){{3}}$'"
    n = f"length({_digits(match)})"
    if kind == "card":
        return f"if({n} between 14 and 19, {luhn(_digits(match))}, false)"
    return f"{n} between 10 and 15" if kind == "phone" else "true"


def _score(kind: str, match: str, near: str) -> str:
    if kind in BASE:
        return "1.0D"
    if kind == "iban":
        return f"round(if({mod97(match)}, 0.6D, 0.3D) + if({near}, 0.3D, 0.0D), 2)"
    return f"if({near}, 0.8D, 0.3D)"


def _running(values: str, plus: str, block: int = 256) -> str:
    """For each of an array of integers, what those before it come to by plus (of a and b), from 0.

    Blocks are summed by themselves and then begun with what the blocks before them come to, so no long array is copied
    for each of its elements.
    """
    simple = lambda array, start: f"aggregate({array}, struct({start} as at, cast(array() as array<int>) as out), (s, b) -> {_let('s.at', 'a', f'struct({plus} as at, concat(s.out, array(a)) as out)')}).out"
    cut = _let(values, "v", f"transform(sequence(0, int(greatest(floor((size(v) - 1) / {block}), 0))), k -> slice(v, k * {block} + 1, {block}))")
    sums = f"transform(p, x -> aggregate(x, 0, (a, b) -> {plus}))"
    return _let(cut, "p", f"flatten(zip_with(p, {simple(sums, '0')}, (x, o) -> {simple('x', 'o')}))")


def _found(text: str, kind: str) -> str:
    """Array of SPAN: the matches of a kind that pass, in order; empty for none."""
    pattern = (BASE | FURTHER)[kind]
    flags = "cast(array() as array<string>)"
    if kind in FURTHER:
        # The first group holds a character if a context word is near; it is looked for behind what a match begins with.
        marked = rf"(?=(?<![0-9A-Za-z-]){_BEGINS[kind]})(?:(?<=(?iu:\b{CONTEXT[kind]}\b)(?s:.{{0,40}}))(?=(.)))?{pattern}"
        flags = f"regexp_extract_all({text}, r'{marked}', 1)"
    held = f"struct(regexp_extract_all({text}, r'{pattern}', 0) as m, transform(split({text}, r'{pattern}', -1), t -> length(t)) as gaps, {flags} as flags)"
    sized = _let(held, "h", "struct(h.m as m, slice(h.gaps, 1, size(h.m)) as gaps, transform(h.m, t -> length(t)) as sizes, h.flags as flags)")
    summed = _let(sized, "h", f"struct(h.m as m, h.gaps as gap, h.sizes as n, {_running('zip_with(h.gaps, h.sizes, (x, y) -> x + y)', 'a + b')} as before, h.flags as flag)")
    placed = _let(summed, "h", "arrays_zip(h.m, h.gap, h.n, h.before, h.flag)")
    kept = f"filter({placed}, x -> {_passes(kind, 'x.m')})"
    near = "coalesce(x.flag, '') <> ''"
    spans = f"transform({kept}, x -> struct(x.before + x.gap as start, {KINDS.index(kind)} as order, x.before + x.gap + x.n as end, '{kind}' as kind, {_score(kind, 'x.m', near)} as score))"
    if kind in FURTHER:
        spans = f"filter({spans}, x -> x.score >= {LEAST_SCORE})"
    maybe = f"contains({text}, '{_NEEDS[kind]}')" if kind in _NEEDS else f"{text} rlike r'{pattern_head(kind)}'"
    return f"if({maybe}, {spans}, cast(array() as array<{SPAN}>))"


def pattern_head(kind: str) -> str:
    """What a match of a kind has at least; cheaper to look for than the kind itself."""
    return {"card": r"[0-9](?:[\x20-]?[0-9]){13}", "iban": r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]", "national_id": r"[0-9]-[0-9]{2}-[0-9]"}[kind]


def _free(base: str, more: str) -> str:
    """Those of more that overlap none of base; both are in order of starts."""
    # reach[n] is how far the first n base spans go; how many start before an end is found by bisection.
    reach = _let("transform(x.base, t -> t.end)", "e", f"concat({_running('e', 'greatest(a, b)')}, array(coalesce(array_max(e), 0)))")
    steps = f"array({', '.join(str(1 << b) for b in reversed(range(31)))})"
    before = f"aggregate({steps}, 0, (at, step) -> if(step <= size(y.base) - at and get(y.base, at + step - 1).start < m.end, at + step, at))"
    return _let(f"struct({base} as base, {more} as more)", "x", _let(f"struct(x.base as base, {reach} as reach, x.more as more)", "y", f"filter(y.more, m -> get(y.reach, {before}) <= m.start)"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and two more columns: pii_base and pii, arrays of (start, order, end, kind, score) by start, then kind.

    Starts and ends are code points, ends exclusive.  A null or empty text has none.  pii holds pii_base and the spans of
    the further kinds that overlap none of it.  Rows are kept one for one with all their columns, repeated ones too; a column
    named pii_base or pii is replaced; an empty table gives no rows.
    """
    whole = f"coalesce(`{text}`, '')"
    found = docs.withColumns({f"__{k}": F.expr(_found(whole, k)) for k in KINDS})
    found = found.withColumn("pii_base", F.expr(f"array_sort(concat({', '.join(f'__{k}' for k in BASE)}))"))
    more = f"array_sort(concat({', '.join(f'__{k}' for k in FURTHER)}))"
    every = f"if({' and '.join(f'size(__{k}) = 0' for k in FURTHER)}, pii_base, array_sort(concat(pii_base, {_free('pii_base', more)})))"
    return found.withColumn("pii", F.expr(every)).drop(*[f"__{k}" for k in KINDS])


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, string(x.start), string(x.end))), ',')"


def report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, a count of each base kind, the digest of the base spans, all spans.

    A null text counts as empty, and both have no spans; repeated rows are kept; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    counts = [f"bigint(size(filter(pii_base, x -> x.kind = '{kind}'))) as n_{kind}" for kind in BASE]
    return found.selectExpr("doc_id", *counts, f"sha2({_listed('pii_base')}, 256) as base_sha256", f"{_listed('pii')} as spans")


def _replaced(text: str, spans: str, block: int = 64) -> str:
    """text with each group of overlapping spans replaced by the kind of its first."""

    def part(begin: str, end: str) -> str:
        """What stands between two places: of the blocks that they are in."""
        held = f"array_join(slice(x.blocks, r.f + 1, int(floor({end} / {block})) - r.f + 1), '')"
        cut = _let(f"struct({begin} as at, int(floor({begin} / {block})) as f)", "r", f"substring({held}, r.at - r.f * {block} + 1, {end} - r.at)")
        return f"if({end} > {begin}, {cut}, '')"

    reach = _running("transform(x.spans, t -> t.end)", "greatest(a, b)")
    fresh = f"filter(zip_with(x.spans, {reach}, (t, e) -> struct(t.start as start, t.kind as kind, e as reach)), t -> t.start >= t.reach)"
    pieces = f"transform({fresh}, t -> concat({part('t.reach', 't.start')}, '<', upper(t.kind), '>'))"
    tail = _let("array_max(transform(x.spans, t -> t.end))", "z", part("z", "x.n"))
    return _let(f"struct({spans} as spans, regexp_extract_all({text}, r'(?s).{{1,{block}}}', 0) as blocks, length({text}) as n)", "x", f"concat(array_join({pieces}, ''), {tail})")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; n_chars, if there, follows.

    Where spans overlap, they are replaced as one, by the kind of the first.  Null and empty texts stay as they are; columns and
    rows, repeated ones too, stay as they are otherwise, whatever other columns are named; an empty table gives no rows.
    """
    found = find(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    out = found.selectExpr("row", "size(pii) as n", f"if(size(pii) > 0, {_replaced('text', 'pii')}, text) as clean")
    changed = {text: F.col("clean")}
    if "n_chars" in docs.columns and text != "n_chars":
        changed["n_chars"] = F.when(F.col("n") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
