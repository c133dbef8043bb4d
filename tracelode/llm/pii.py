r"""Personal data spans (native: built-in functions only).

Regular expressions propose spans, checksums and formats confirm them (Luhn for
cards, mod-97 for IBANs, octet and digit counts for addresses and phones,
assigned numbers for social security numbers, mixed characters for secrets),
and words within ``NEAR`` code points on either side of a span raise its score.
Base kinds are email, ip, card and phone.  The method adds iban, ssn, secret
(a value assigned to a name such as ``token`` or ``password``) and key (access
keys, web tokens and private keys of well-known form).  An added span is
returned if its score reaches ``min_score``; base spans always are.

Each pattern is written so that matching is linear in the text: a candidate
starts where the previous one ended (``\G``) or where no character of its own
class precedes, and runs are possessive.  Both changes leave the leftmost
matches of the plain patterns as they are.  The card pattern takes whole runs
of digits only, so it can ask for 13 to 19 of them at once: other runs would
be dropped by the digit count, with no retry within them.

An IBAN is proposed at the length of its country (ISO 13616), so what follows
it is not taken in; a code outside that registry has no valid length.  Its
pattern consumes the first four code points only and looks ahead for the rest,
so a proposal that mod-97 rejects hides no other.

Positions are code points, from prefix sums over the lengths of the pieces
between matches.  The code points near a span are those of the text before and
behind it, other matches included.

Defined results: a null text counts as empty; empty texts have no spans; a
very long text is searched whole; repeated rows get equal results; a null id
stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, in their linear form.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The countries of each IBAN length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?=((?:{_BY_LENGTH})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
SECRET = rf"(?i)(?<![a-z0-9])(?:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([A-Za-z0-9+/_.~-]{{12,}}+=*+)"
KEY = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[opsur]_[A-Za-z0-9]{36,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?+"
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Words that raise a span's score, by kind (lower case).
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server|client",
    "card": "card|visa|credit|payment|account",
    "phone": r"phone|\btel\b|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
    "ssn": r"\bssn\b|social security|tax id",
    "secret": "login|bearer|auth|api|access|deploy",
    "key": "key|token|aws|github|secret|auth",
}
#: Code points on either side of a span that are searched for context words.
NEAR = 40
#: A span may reach so far beyond what its pattern consumes.
_BEYOND = 48


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, texts of which any match holds one, its score and its confirmation."""

    name: str
    pattern: str
    quick: tuple[str, ...]
    score: float
    #: The group that is the span; group 0 is what the pattern consumes.
    group: int = 0
    #: The span ends where the match does; otherwise it starts where the match does.
    at_end: bool = False

    def confirmed(self, m: Column) -> Column:
        digits = F.regexp_replace(m, "[^0-9]", "")
        if self.name == "ip":
            return F.regexp_like(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        if self.name == "card":
            return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
        if self.name == "phone":
            return F.length(digits).between(9, 15)
        if self.name == "iban":
            return mod97(m) == 1
        if self.name == "secret":
            mixed = F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]"))
            return mixed & (F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), "(?!^)(?!$)"))) >= 8)
        return F.lit(True)


BASE = (
    Kind("email", EMAIL, ("@",), 0.9),
    Kind("ip", IP, (".",), 0.6),
    Kind("card", CARD, (), 0.8),
    Kind("phone", PHONE, ("+",), 0.5),
)
ADDED = (
    Kind("iban", IBAN, (), 0.9, 1),
    Kind("ssn", SSN, ("-",), 0.3),
    Kind("secret", SECRET, ("=", ":"), 0.7, 1, True),
    Kind("key", KEY, ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "sk_live_", "AIza", "xox", "eyJ", "-----BEGIN "), 0.9),
)


def mod97(iban: Column) -> Column:
    """The ISO 7064 remainder of an IBAN: 1 if its check digits hold."""
    plain = F.replace(iban, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        n = F.ascii(ch)
        return F.when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97).cast("int")

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step)


_BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def block_sums(steps: Column) -> Column:
    """For each block of ``_BLOCK`` elements the sum of all before it."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(steps) / F.lit(float(_BLOCK))).cast("int") - 1)
    return F.aggregate(
        blocks,
        F.array(F.lit(0)),
        lambda a, k: F.array_append(a, F.element_at(a, -1) + _sum(F.slice(steps, k * _BLOCK + 1, _BLOCK))),
    )


def sums_before(steps: Column, bases: Column) -> Column:
    """For each element the sum of all before it; near linear.

    Both arguments have to be columns of the input, as a lambda evaluates what
    it holds for every element.  ``bases`` is named twice, since the optimizer
    would move an expression that is used once into the lambda.
    """

    def at(_, i: Column) -> Column:
        block = F.floor(i / F.lit(float(_BLOCK))).cast("int")
        return F.element_at(bases, block + 1) + _sum(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK))

    return F.when(F.size(bases) > 0, F.transform(steps, at))


def _pieces(text: Column, kind: Kind) -> Column:
    """array<struct<m, before, step, tail, head, mid, next>> of the pattern's matches.

    m: the span; before: code points since the last match; step: those and what
    is consumed; tail and head: the last ``NEAR`` of either; mid and next: the
    first ones of what is consumed and of what follows up to the next match.
    """
    taken = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    both = F.arrays_zip(
        F.slice(pieces, 1, F.size(taken)).alias("p"),
        F.slice(pieces, 2, F.size(taken)).alias("n"),
        taken.alias("c"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("m"),
    )
    return F.transform(
        both,
        lambda x: F.struct(
            x["m"].alias("m"),
            F.length(x["p"]).alias("before"),
            (F.length(x["p"]) + F.length(x["c"])).alias("step"),
            F.right(x["p"], F.lit(NEAR)).alias("tail"),
            F.right(x["c"], F.lit(NEAR)).alias("head"),
            F.left(x["c"], F.lit(NEAR)).alias("mid"),
            F.left(x["n"], F.lit(NEAR + _BEYOND)).alias("next"),
        ),
    )


_PIECES = "array<struct<m:string,before:int,step:int,tail:string,head:string,mid:string,next:string>>"
#: Every pattern consumes four code points at least, so so many matches before a span hold the ``NEAR`` before it.
_BACK = NEAR // 4


def _near(pieces: Column) -> Column:
    """For each piece the text around its match; ``pieces`` has to be a column of the input.

    That is ``NEAR`` code points before the match, a blank, and ``NEAR`` after
    the span, earlier and later matches included.
    """

    def at(x: Column, i: Column) -> Column:
        back = F.least(i, F.lit(_BACK))
        earlier = F.transform(F.slice(pieces, i - back + 1, back), lambda y: F.concat(y["tail"], y["head"]))
        later = F.transform(F.slice(pieces, i + 2, F.lit(_BACK)), lambda y: F.concat(y["mid"], y["next"]))
        beyond = F.greatest(F.lit(0), F.length(x["m"]) - (x["step"] - x["before"]))
        after = F.substring(F.concat(x["next"], F.array_join(later, "")), beyond + 1, F.lit(NEAR))
        return F.concat(F.right(F.concat(F.array_join(earlier, ""), x["tail"]), F.lit(NEAR)), F.lit(" "), after)

    return F.transform(pieces, at)


def _span_of(kind: Kind):
    """The function that turns a piece and the text around it into a span."""

    def span(x: Column, place: Column) -> Column:
        skipped = x["step"] - F.length(x["m"]) if kind.at_end else x["before"]
        start = place["at"] + skipped
        near = F.regexp_like(F.lower(place["near"]), F.lit(CONTEXT[kind.name]))
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + F.length(x["m"])).alias("end"),
            F.round(F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0)), 2).alias("score"),
            kind.confirmed(x["m"]).alias("ok"),
        )

    return span


def _likely(kind: Kind) -> Column:
    """A cheap test that every text with a match passes."""
    out = F.lit(not kind.quick)
    for part in kind.quick:
        out = out | F.contains("text", F.lit(part))
    return out


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per document: doc_id and, for each kind, its confirmed spans (kind, start, end, score) by start.

    Spans of the added kinds need a score of ``min_score``.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = BASE + ADDED
    some = {k.name: _likely(k) & F.regexp_like("text", F.lit(k.pattern)) for k in kinds}
    none = F.array().cast(_PIECES)
    df = df.select("doc_id", *[F.when(some[k.name], _pieces(F.col("text"), k)).otherwise(none).alias(k.name) for k in kinds])
    some_found = lambda k, c: F.when(F.size(k.name) > 0, c).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({k.name + "_by": F.transform(k.name, lambda x: x["step"]) for k in kinds})
    df = df.withColumns({k.name + "_base": some_found(k, block_sums(F.col(k.name + "_by"))) for k in kinds})
    df = df.withColumns({k.name + "_at": some_found(k, sums_before(F.col(k.name + "_by"), F.col(k.name + "_base"))) for k in kinds})
    df = df.withColumns({k.name + "_near": F.when(F.size(k.name) > 0, _near(F.col(k.name))) for k in kinds})
    out = [F.col("doc_id")]
    for k in kinds:
        every = F.zip_with(F.col(k.name), F.arrays_zip(F.col(k.name + "_at").alias("at"), F.col(k.name + "_near").alias("near")), _span_of(k))
        good = F.transform(
            F.filter(every, lambda s: s["ok"] & (s["score"] >= (0.0 if k in BASE else min_score))), lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"])
        )
        out.append(F.when(F.size(k.name) > 0, good).otherwise(F.array().cast(_SPAN)).alias(k.name))
    return df.select(*out)


def joined(*spans: str) -> Column:
    """``kind:start:end`` of all spans of the named columns, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.concat(*[F.col(c) for c in spans]), one), ",")



def scores(*spans: str) -> Column:
    """The scores of all spans of the named columns, comma-joined in the order of ``joined``."""
    return F.array_join(F.transform(F.concat(*[F.col(c) for c in spans]), lambda s: s["score"].cast("string")), ",")
