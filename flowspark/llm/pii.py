"""PII: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is DataFrame expressions.  A pattern's matches and the pieces between
them come from one regular expression (extract and split walk the same matches),
so positions are running sums of lengths, in code points.  A kind's candidates
must pass its validator (Luhn for cards, mod-97 for IBANs, the value range of IP
parts, numbers of digits); context words in the REACH code points before a span or
after it raise its score, and kinds that are ambiguous alone (`ssn`, `local_phone`)
only pass the threshold with such a word.  These windows are cut from the text, so
they hold whatever stands there, other spans among it; a word that a window's outer
end cuts counts by what is left of it.

Defined results: a null text has no spans; an empty table gives an empty one; spans at one start go in the order of
KINDS; the base kinds never overlap themselves but may overlap others, and
`redact` replaces a run of overlapping spans by the mark of its first one;
repeated rows are handled one by one; other columns are left as they are.
Patterns use possessive runs and look-behinds that change no match, so that texts
of any length take linear time and no deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prepare

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
#: Code points before and after a span in which context words count, and the pieces that a text is cut into to find them.
REACH, PIECE = 40, 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, F.lit(2)).otherwise(F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN (letters, digits, spaces) has the remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(a, c):
        digit = c.rlike("[0-9]")
        return F.when(digit, (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A pattern with its validator, score and context words; `hint` says cheaply that a text has no match."""

    name: str
    pattern: str
    hint: str
    score: float
    bonus: float
    context: str
    valid: object


def _ip_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, r"e-?mail|contact|correo|courriel", lambda v: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, 0.3, r"\bip\b|host|server|addr", _ip_parts),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", "", 0.8, 0.2, r"card|visa|karte|carte|tarjeta|credit|kredit", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.3, r"phone|tel|call|mobil|fax", lambda v: F.length(_digits(v)).between(10, 15)),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.9, 0.1, r"iban|konto|account|compte|cuenta", mod97),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.2, 0.6, r"\bssn\b|social security", lambda v: ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-|-0000$")),
    Kind("local_phone", r"(?<![0-9+.()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "", 0.3, 0.4, r"phone|\btel\b|call|mobil|fax", lambda v: F.lit(True)),
)
_SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double,value:string>>"


def _window(pieces: Column, low: Column, high: Column) -> Column:
    """Code points [low, high) of a text that is cut into pieces; high is at most REACH beyond low."""
    first = F.floor(low / PIECE).cast("int")
    near = F.concat(*(F.coalesce(F.get(pieces, first + i), F.lit("")) for i in range(REACH // PIECE + 2)))
    return F.substring(near, (low - first * PIECE + 1).cast("int"), (high - low).cast("int"))


def _candidates(text: Column, place: int, kind: Kind) -> Column:
    """Spans of one kind, confirmed and scored."""
    pattern = F.lit(kind.pattern)

    def spans(found: Column, pieces: Column, cut: Column) -> Column:
        def add(acc, x):
            start = acc["at"] + F.length(x["piece"])
            end = start + F.length(x["value"])
            around = F.lower(F.concat(_window(cut, F.greatest(start - REACH, F.lit(0)), start), F.lit("\n"), _window(cut, end, end + REACH)))
            score = F.lit(kind.score) + F.when(around.rlike(kind.context), F.lit(kind.bonus)).otherwise(F.lit(0.0))
            span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), x["value"].alias("value"))
            keep = kind.valid(x["value"]) & (score >= THRESHOLD)
            return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        joined = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
        return F.aggregate(joined, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")), add, lambda acc: acc["spans"])

    matched = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda cut: spans(found, F.split(text, kind.pattern, -1), cut))))
    return F.when(F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True), matched).otherwise(F.array().cast(_SPAN))


def spans_of(text: Column) -> Column:
    """All spans of a text: array<struct<start, place, end, kind, score, value>>, by start and kind."""
    # texts without a digit can only hold e-mail addresses
    digit = F.coalesce(text, F.lit("")).rlike("[0-9]|@")
    return F.when(digit, F.sort_array(F.concat(*(_candidates(text, i, k) for i, k in enumerate(KINDS))))).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text: str = "text", column: str = "pii") -> DataFrame:
    """The documents with their spans in a further column."""
    prepare(docs.sparkSession)
    return docs.withColumn(column, spans_of(F.col(text)))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by `<KIND>`, and `length` corrected; the columns stay as they were."""

    def replaced(t: Column, spans: Column) -> Column:
        def add(acc, s):
            fresh = s["start"] >= acc["at"]
            return F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))

    original = F.col(text)
    clean = let(spans_of(original), lambda s: F.when(F.size(s) == 0, original).otherwise(replaced(original, s)))
    out = docs.withColumn(text, clean)
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for `documents`."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    spans = F.col("pii")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(span_text(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
