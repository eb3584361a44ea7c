"""Personal data by DataFrame functions alone: expressions propose spans, checksums confirm them, context words move their score.

Java's possessive quantifiers and \\G keep the search linear in the text; the
matches are those of the plain patterns in PATTERNS, leftmost and without
overlap within a kind. A match's place is the length of what splitting by the
same expression leaves before it, summed up in chunks so that a text with many
matches costs little more than its length. All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: What the four base kinds look like, plainly.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: How long an IBAN is, by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban_search() -> str:
    """A country's letters, two digits and just as many more signs as the country has, in groups of four that spaces may part."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    ways = []
    for length, countries in by_length.items():
        fours, rest = divmod(length - 4, 4)
        ways.append(f"(?:{'|'.join(countries)})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{fours}}}" + f"\\x20?[A-Z0-9]{{{rest}}}" * bool(rest))
    return f"(?<![A-Za-z0-9])(?:{'|'.join(ways)})(?![A-Za-z0-9])"


#: The same matches in linear time: a match that fails from the start of a run fails from within it, too.
SEARCHES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
    "iban": _iban_search(),
    "short_card": r"[0-9](?:[\x20-]?[0-9])++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "ssn")
#: A text without a match of this has no span of the kind (a cheap first look).
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
LOOKS = {"card": "[0-9][\\x20-]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "short_card": "[0-9][\\x20-]?[0-9]", "ssn": "[0-9]-[0-9]"}
#: Words that, near a span, make its kind more or less likely.
FOR_WORDS = {
    "email": "mail|e-mail|email|contact|write|correo",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "short_card": "card|visa|amex|diners|credit|payment|karte|tarjeta|carte",
    "ssn": "ssn|social security|taxpayer|tax id",
}
AGAINST_WORDS = "version|release|isbn|order|serial|test|example|sample"
#: Characters looked at on either side; what a span is worth by kind; what context adds or takes; what is kept. A checksum
#: over many digits (iban) holds but for words against it; kinds that chance meets often need words for them.
WINDOW, PRIOR, STEP, KEEP_AT = 40, {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.6, "short_card": 0.4, "ssn": 0.4}, 0.2, 0.5
#: Elements that a running sum goes over at once.
CHUNK = 256


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """The checksum of a string of digits: every second digit from the right doubled, cross-summed, the total a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, the number modulo 97 is 1."""
    bare = F.upper(F.regexp_replace(iban, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))

    def take(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97).cast("int")

    return F.length(bare).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), take) == 1)


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits_of(match)
        return F.when(F.length(d).between(16, 19), luhn_ok(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(match)).between(8, 15)
    if kind == "iban":
        return mod97_ok(match)
    if kind == "short_card":
        d = digits_of(match)
        return F.when(F.length(d).between(13, 15), luhn_ok(d)).otherwise(False)
    if kind == "ssn":  # numbers that are never given out
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once even if lambdas within the body use it again and again."""
    return F.transform(F.array(value), body)[0]


def before_each(values: Column, zero: Column, combine) -> Column:
    """For each element, what the elements before it combine to (an associative function, zero its neutral element), chunk by chunk."""

    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))

        def joined(c: Column) -> Column:
            starts = F.aggregate(F.transform(c, lambda x: F.aggregate(x, zero, combine)), F.array(zero), add)
            return F.flatten(F.zip_with(c, F.slice(starts, F.lit(1), F.size(c)), lambda x, s: F.slice(F.aggregate(x, F.array(s), add), F.lit(1), F.size(x))))

        return let(chunks, joined)

    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.slice(v, F.lit(1), F.lit(0))))


def spans(text: Column, kind: str) -> Column:
    """SPANS: the confirmed matches of a kind in a text, in code points, end exclusive, in order, each with its score."""
    search = SEARCHES[kind]
    first_look = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(LOOKS[kind])
    both = F.struct(F.regexp_extract_all(text, F.lit(search), F.lit(0)).alias("m"), F.split(text, search, -1).alias("g"))

    def place(b: Column) -> Column:
        sure = F.filter(F.sequence(F.lit(0), F.size(b["m"]) - 1), lambda i: confirmed(kind, b["m"][i]))
        lengths = F.zip_with(b["g"], b["m"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

        def span(at: Column, i: Column) -> Column:
            start = at[i] + F.length(b["g"][i])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(b["m"][i])).alias("end"), _score(kind, b["g"], i).alias("score"))

        return F.when(F.size(sure) > 0, let(before_each(lengths, F.lit(0), lambda x, y: x + y), lambda at: F.transform(sure, lambda i: span(at, i)))).otherwise(F.array().cast(SPANS))

    found = let(both, lambda b: F.when(F.size(b["m"]) > 0, place(b)).otherwise(F.array().cast(SPANS)))
    return F.when(first_look, found).otherwise(F.array().cast(SPANS))


def _score(kind: str, gaps: Column, i: Column) -> Column:
    """What span i of the kind is worth, and more or less by the words near it: WINDOW characters on either side of what lies between it and its neighbours, or beyond them."""
    before = F.right(F.concat_ws(" ", F.right(F.get(gaps, i - 1), F.lit(WINDOW)), F.right(gaps[i], F.lit(WINDOW))), F.lit(WINDOW))
    after = F.left(F.concat_ws(" ", F.left(F.get(gaps, i + 1), F.lit(WINDOW)), F.left(F.get(gaps, i + 2), F.lit(WINDOW))), F.lit(WINDOW))
    near = F.lower(F.concat_ws(" ", before, after))
    likely, unlikely = near.rlike(rf"\b(?:{FOR_WORDS[kind]})\b"), near.rlike(rf"\b(?:{AGAINST_WORDS})\b")
    return F.lit(PRIOR[kind]) + F.when(likely, STEP).otherwise(0.0) - F.when(unlikely, STEP).otherwise(0.0)


def find_spans(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds `into` (SPANS): all spans of a text, by kind in the order of KINDS and then by start.

    Base kinds stay whatever their score; others need KEEP_AT. A null text has
    none. A column already called `into` is an error; other columns pass through.
    """
    if into.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {into}")
    whole = text_of(df, text)
    found = [spans(whole, k) if k in BASE else F.filter(spans(whole, k), lambda x: x["score"] >= KEEP_AT) for k in KINDS]
    return df.withColumn(into, F.concat(*found))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_iban, n_short_card, n_ssn, base_sha256, spans, scores) of each row's whole text.

    A null or empty text has no spans; repeated rows and null ids stay, other
    columns are ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(docs).alias("text"))
    found = find_spans(source, "text", "pii")

    def of(*kinds: str) -> Column:
        return F.filter("pii", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )


#: Binary text in UTF-32, four bytes a code point, can be cut anywhere at once; the mark in front is what decoding drops.
_MARK = bytes.fromhex("0000feff")


def mask(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with every span of the text column replaced by its kind in angle brackets; `length`, where there is such a column, becomes the new number of characters.

    Spans that overlap, or that others connect, are replaced together by the kind
    of the first. Null texts, and the length of those without a span, stay as they
    are; so do repeated rows and other columns; an empty table gives no rows.
    """
    at, whole = fresh(df, "pii"), text_of(df, text)
    order = F.array_sort(F.transform(at, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def cut(points: Column, start: Column, n: Column) -> Column:
        return F.decode(F.concat(F.lit(_MARK), F.substring(points, 4 * start + 1, 4 * n)), "UTF-32")

    def new_text(b: Column) -> Column:
        spans_, points = b["spans"], b["points"]
        ends = F.transform(spans_, lambda x: -x["back"])

        def joined(before: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(spans_) - 1), lambda i: spans_[i]["start"] >= before[i])
            parts = F.transform(heads, lambda i: F.concat(cut(points, before[i], spans_[i]["start"] - before[i]), F.lit("<"), F.upper(spans_[i]["kind"]), F.lit(">")))
            last = F.array_max(ends)
            return F.concat(F.array_join(parts, ""), cut(points, last, F.octet_length(points)))

        return let(before_each(ends, F.lit(0), lambda x, y: F.greatest(x, y)), joined)

    new = let(F.struct(order.alias("spans"), F.encode(whole, "UTF-32").alias("points")), new_text)
    out, has = find_spans(df, text, at), F.size(at) > 0
    masked = out.withColumn(text, F.when(has, new).otherwise(F.col(text).cast("string")))
    if length in df.columns:
        masked = masked.withColumn(length, F.when(has, F.length(text).cast(df.schema[length].dataType)).otherwise(F.col(length)))
    return masked.select(*[F.col(f"`{c}`") for c in df.columns])
