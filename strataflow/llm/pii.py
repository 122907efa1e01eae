"""Personal data in text, by DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit counts for
the rest), words near a span adjust its score: words of its kind raise it, words against it lower it.  A text is split at
a kind's matches; the lengths of the stretches between them give the spans' places, in code points, without a loop over
the text.  Time is linear in a text and its matches up to about a million of them (running).

Kinds, in order: email, ip, card, phone (the base kinds, found whatever their score) and iban and ssn, found if their
checks hold and their score reaches the threshold: an IBAN unless words speak against it, a social security number only
with words for it.  Redaction leaves out spans below its threshold: an ip near the word version, for example.

The base kinds' patterns are the plain ones with possessive quantifiers and a look-behind: the same matches, but in time
linear in the text and without recursion, so one very long word or number costs no more than its length.  An IBAN has
exactly its country's length, so what follows it, words in capitals and numbers too, isn't taken for a part of it.

Defined results: null text is empty and has no spans; repeated rows give equal rows; an empty table gives none; null
ids are kept; columns other than the id and text are not read, their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import text_of

#: Characters on either side of a span, up to the next match of its kind, in which context words count.
WINDOW = 40
#: What words for a span add to its score, and words against it take.
CONTEXT = 0.2
#: A span of a kind outside the base kinds needs this score.
THRESHOLD = 0.5
_OCTET = r"0*[0-9]{1,2}|0*1[0-9]{2}|0*2[0-4][0-9]|0*25[0-5]"
#: Characters of an IBAN by country, those of countries outside the registry that use one too.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG NE SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Whether an IBAN's check digits hold: its first four characters moved to the end, letters as 10 to 35, mod 97."""
    plain = F.upper(F.regexp_replace(match, " ", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    codes = F.transform(F.split(moved, ""), F.ascii)
    value = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97)
    return F.length(plain).between(15, 34) & (value == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str  # a text without it has no match
    pattern: str
    score: float
    context: str  # words near a span that add to its score
    against: str = ""  # words that take from it

    def confirm(self, match: Column) -> Column:
        if self.name == "ip":
            return match.rlike(rf"^(?:{_OCTET})(?:\.(?:{_OCTET})){{3}}$")
        if self.name == "card":
            return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
        if self.name == "phone":
            return F.length(_digits(match)).between(9, 15)
        if self.name == "iban":
            return _mod97(match)
        if self.name == "ssn":  # no such areas, groups and numbers are given out
            return ~match.rlike("^(?:000|666|9)|-00-|0000$")
        return F.lit(True)


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", 0.9, "mail|e-mail|contact|write"),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|adresse", "version|release|build|firmware|section|chapter"),
    Kind("card", "", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+", 0.7, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax|telefon"),
    Kind("iban", "", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", 0.6, "iban|account|bank|konto|compte|cuenta", "example|sample|specimen|fictitious|beispiel|exemple|ejemplo"),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security|taxpayer", "part|order|serial|isbn"),
)
BASE = ("email", "ip", "card", "phone")


#: Items that running combines at a time.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """An array whose item i combines the first i + 1 values, chunk by chunk: n values take about n CHUNK / 2 steps and
    half the square of n / CHUNK."""

    def chunk(v: Column, c: Column) -> Column:
        return F.slice(v, c * CHUNK + 1, F.lit(CHUNK))

    def each(v: Column, sums: Column, c: Column) -> Column:
        base = F.aggregate(F.slice(sums, F.lit(1), c), zero, combine)
        return let(base, lambda at: let(chunk(v, c), lambda own: F.transform(own, lambda _, i: F.aggregate(F.slice(own, F.lit(1), i + 1), at, combine))))

    def whole(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        sums = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(chunk(v, c), zero, combine))
        return let(sums, lambda s: F.flatten(F.transform(s, lambda _, c: each(v, s, c))))

    return let(values, whole)


def _near(kind: Kind, between: Column, i: Column) -> Column:
    """The score of a kind's match number i, by the words in the stretches before and after it."""
    words = F.lower(F.concat(F.right(between[i], F.lit(WINDOW)), F.lit(" "), F.left(between[i + 1], F.lit(WINDOW))))

    def scored(w: Column) -> Column:
        score = F.lit(kind.score) + F.when(w.rlike(rf"\b(?:{kind.context})\b"), CONTEXT).otherwise(0.0)
        return score - F.when(w.rlike(rf"\b(?:{kind.against})\b"), CONTEXT).otherwise(0.0) if kind.against else score

    return F.round(let(words, scored), 2)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind: array of (start, end, score), starts from 0, ends exclusive, by start."""

    def placed(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(between[i]) + F.length(m))

        def spans(ends: Column) -> Column:
            every = F.transform(found, lambda m, i: F.struct(m.alias("match"), i.alias("i"), ends[i].alias("end")))
            good = F.filter(every, lambda s: kind.confirm(s["match"]))
            return F.transform(good, lambda s: F.struct((s["end"] - F.length(s["match"])).alias("start"), s["end"].alias("end"), _near(kind, between, s["i"]).alias("score")))

        return let(running(steps, F.lit(0), lambda a, x: a + x), spans)

    out = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: let(F.split(text, kind.pattern, -1), lambda between: placed(found, between)))
    if kind.name not in BASE:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,score:double>>")
    needed = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike(r"[0-9]")
    return F.when(needed, out).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column pii: a struct of one span array per kind."""
    text = text_of(text_col)
    return docs.withColumn("pii", F.struct(*[_spans(text, k).alias(k.name) for k in KINDS]))


def _each(kind: str, make) -> Column:
    """make(span) of each span of a kind; a span's own fields alone."""
    return F.transform(F.col("pii")[kind], lambda s: make(s))


def _name(kind: str, *more: str) -> Column:
    return _each(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"], *[s[x] for x in more]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts of the base kinds, base_sha256, spans and scores (kind:start:end:score)."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    every = tuple(k.name for k in KINDS)
    return found.select(
        "doc_id",
        *[F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*map(_name, BASE)), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(_name, every)), ",").alias("spans"),
        F.array_join(F.concat(*[_name(k, "score") for k in every]), ",").alias("scores"),
    )


#: Code points of the blocks from which redact cuts a text.
BLOCK = 1024


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    inner = start - first * BLOCK
    across = F.concat(F.substring(blocks[first], inner + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(blocks[last], F.lit(1), end - last * BLOCK))
    return F.when(end <= start, "").when(first == last, F.substring(blocks[first], inner + 1, end - start)).otherwise(across)


def redact(docs: DataFrame, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """docs with each span of score least or more replaced by its kind's name in angle brackets.

    Overlapping spans of different kinds merge into one, named for the kind of the span that begins first.  Other
    columns keep their values and order; null text stays null, an empty table stays empty."""
    columns = docs.columns

    def named(kind: str) -> Column:
        return _each(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["score"].alias("score")))

    spans = F.concat(*[named(k.name) for k in KINDS])
    spans = F.array_sort(F.filter(spans, lambda s: s["score"] >= least))
    text = F.col(text_col)

    def masked(s: Column, reach: Column, blocks: Column) -> Column:
        """reach: the furthest end among the first spans; a span that begins before it belongs to the one that began."""
        begun = F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.when(i > 0, reach[i - 1]).otherwise(0).alias("at")))
        begun = F.filter(begun, lambda x: x["start"] >= x["at"])
        parts = F.transform(begun, lambda x: F.concat(_cut(blocks, x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), _cut(blocks, F.element_at(reach, -1), F.length(text)))

    def whole(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return F.when(F.size(s) > 0, let(reach, lambda r: let(blocks, lambda b: masked(s, r, b)))).otherwise(text)

    return with_spans(docs, text_col).withColumn(text_col, let(spans, whole)).select(*columns)
