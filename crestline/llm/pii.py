"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Column expressions only, no shuffle: every document is handled in its scan.
Matches and the gaps between them give the places: the text is split by the
pattern, and lengths are summed up in runs of about the square root of their
number, so a text of many matches takes little more than its share. The patterns
are written so that no text makes them backtrack or recurse at length: repeated parts are
possessive, and a match starts at the beginning of a run of its characters or
where the last match ended, which is where the leftmost match lies anyway.

Base kinds: e-mail addresses, IPv4 addresses (parts up to 255), payment cards
(14 to 19 digits that pass Luhn), phone numbers (+ and 10 to 15 digits). Added
kinds: IBANs (mod 97), social security numbers, access keys, and secrets
(opaque runs of letters and digits). A span's score is its kind's own, higher
with a checksum or a telling form, and rises when one of the kind's context words stands in
the 40 characters before it, back to the last match of the kind. Added kinds
need ``least_score``: a number like a social security number or an opaque run
reaches it only by its context. The four base kinds are always reported.

Defined results: null and empty texts have no spans; places count code points,
ends are exclusive; spans of different kinds may overlap, and of two that
start together the kind listed first comes first; an IBAN, social security
number or access key must not touch a letter or digit of the text between
matches of its kind; every row is handled by itself, so repeated rows and null ids are of no
account; very long texts are handled whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a cheap pattern without which the other can't match
    pattern: str
    score: int  # in hundredths
    bonus: int  # for a context word
    context: str
    base: bool = True
    alone: bool = False  # must not touch other letters or digits


# The patterns' languages, and the order in which kinds are listed.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90, 10, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 70, 20, r"\bip\b|address|host|server|login|adresse|direcci"),
    Kind("card", "[0-9][\\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", 80, 20, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 70, 20, r"phone|\btel|call|mobile|fax|anruf|appel|llama"),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", 80, 10, "iban|account|bank|konto|compte|cuenta", base=False, alone=True),
    Kind("ssn", "[0-9]-[0-9][0-9]-[0-9]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, 30, "ssn|social sec|sozialvers|seguridad social|curit. sociale", base=False, alone=True),
    Kind("access_key", "AKIA", "AKIA[0-9A-Z]{16}", 80, 10, "key|secret|aws", base=False, alone=True),
    Kind("secret", "[0-9A-Za-z+/_-]{16}", "[0-9A-Za-z+/_-]{16,}", 30, 40, "passw|contrase|mot de passe|secret|token|api.?key|credential", base=False),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a compact IBAN passes its check (letters count as 10 to 35, the first four signs go last)."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    signs = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97) == 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column) -> Column:
    """Running sums of an array of numbers: folded over runs of about the square root of its size, and over the runs' sums."""

    def folded(xs: Column, begin: Column) -> Column:
        return F.aggregate(xs, F.array(begin), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def of(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))

        def joined(c: Column) -> Column:
            before = folded(F.transform(c, lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long"))
            return F.flatten(F.zip_with(c, F.slice(before, F.lit(1), F.size(c)), lambda run, b: F.slice(folded(run, b), F.lit(2), F.size(run))))

        return F.when(F.size(v) > 0, _let(runs, joined)).otherwise(F.array().cast("array<bigint>"))

    return _let(values, of)


def _confirmed(kind: Kind, value: Column, before: Column, after: Column) -> Column:
    sound = F.lit(True)
    if kind.name == "ip":
        sound = F.forall(F.split(value, "\\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind.name == "card":
        sound = F.length(_digits(value)).between(14, 19) & luhn(_digits(value))
    if kind.name == "phone":
        sound = F.length(_digits(value)).between(10, 15)
    if kind.name == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        sound = F.length(compact).between(15, 34) & mod97(compact)
    if kind.name == "secret":
        sound = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind.alone:
        sound = ~before.rlike("[0-9A-Za-z]$") & ~after.rlike("^[0-9A-Za-z]") & sound
    return sound


def spans_of(text: Column, kind: Kind, number: int, least_score: float = LEAST_SCORE) -> Column:
    """Array of (start, number, kind, end, value, score) of one kind."""
    nothing = F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint,value:string,score:double>>")

    def placed(values: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: (F.length(v) + F.length(g)).cast("long")))
        # each match with the text before it, back to the match before, and after it, up to the next
        matches = F.zip_with(ends, values, lambda e, v: F.struct(e.alias("end"), v.alias("value")))
        beside = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), F.slice(gaps, F.lit(2), F.size(values)), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        found = F.zip_with(matches, beside, lambda m, b: F.struct(m["end"].alias("end"), m["value"].alias("value"), b["before"].alias("before"), b["after"].alias("after")))
        sound = F.filter(found, lambda s: _confirmed(kind, s["value"], s["before"], s["after"]))
        near = lambda s: F.lower(F.substring(s["before"], -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(kind.context)
        score = lambda s: (F.lit(kind.score) + F.when(near(s), kind.bonus).otherwise(0)) / 100.0
        spans = F.transform(sound, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), F.lit(number).alias("number"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score(s).alias("score")))
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= least_score)

    values, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    spans = _let(values, lambda v: F.when(F.size(v) > 0, _let(gaps, lambda g: placed(v, g))).otherwise(nothing))
    return F.when(text.rlike(kind.hint), spans).otherwise(nothing)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document: doc_id, base (spans of the base kinds) and spans (all), each sorted by start, then kind."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.select("doc_id", *[spans_of(F.col("text"), k, i, least_score).alias(k.name) for i, k in enumerate(KINDS)])
    return found.select("doc_id", F.array_sort(F.concat(*[F.col(k.name) for k in KINDS if k.base])).alias("base"), F.array_sort(F.concat(*[F.col(k.name) for k in KINDS])).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scored(spans: Column) -> Column:
    """The spans' scores in hundredths, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
