"""Extraction of signatures as a column expression, without Python, so that it can run inside transform()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe.functions.text import java, let, lines, trim

# Delimiters, sign-offs, markers and limits.
DELIMITERS = (
    (r"^-- \s*$", "m"),
    (r"^--\s*$", "m"),
    (r"^Sent from my ", "mi"),
    (r"^Sent from Mail for ", "mi"),
    (r"^Sent from Outlook", "mi"),
    (r"^Sent via ", "mi"),
    (r"^Gesendet von ", "mi"),
    (r"^Envoyé de mon ", "mi"),
    (r"^Enviado desde mi ", "mi"),
    (r"^Get Outlook for ", "mi"),
)
SIGN_OFFS = (
    "Best( regards)?|Kind regards|Regards|Cheers|Thanks|Thank you|Sincerely|Yours truly|Warm regards|With thanks|Many thanks|All the best|Take care",
    "Mit freundlichen Grüßen|Beste Grüße|Viele Grüße|Liebe Grüße|MfG",
    "Cordialement|Bien cordialement|Merci|Cdlt",
    "Saludos|Atentamente|Gracias",
)
PHONE = r"\+?\d[\d\s\-()]{6,}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SHORT, LONG, LINE_BYTES = 10, 60, 200

_ANY_DELIMITER = "|".join(f"(?:{java(p, flags)})" for p, flags in DELIMITERS)
#: A line that is a sign-off, in a whole body.
_ANY_SIGN_OFF = java(r"^(?:" + "|".join(SIGN_OFFS) + r"),?\s*$", "mi")
_SIGN_OFF = java(r"\A(?:" + "|".join(SIGN_OFFS) + r"),?\s*\z", "i")


def corporate_markers(block: Column) -> Column:
    """How many of phone number, e-mail address and link a block of text has."""
    link = F.contains(block, F.lit("http://")) | F.contains(block, F.lit("https://")) | F.contains(block, F.lit("www."))
    return F.rlike(block, F.lit(java(PHONE))).cast("int") + F.rlike(block, F.lit(java(EMAIL))).cast("int") + link.cast("int")


def looks_like_signature(tail: Column) -> Column:
    """Whether lines from a sign-off on read as a signature."""
    plain = F.forall(tail, lambda x: F.octet_length(x) < LINE_BYTES) & F.exists(F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))), lambda x: trim(x) != "")
    return F.when(~plain, F.size(tail) <= 2).when(F.size(tail) <= SHORT, True).otherwise(corporate_markers(F.array_join(tail, "\n")) >= 2)


def _delimited(body: Column, pattern: str, flags: str) -> Column:
    """(text, signature) by the first match of a delimiter, if few enough lines follow."""

    def cut(parts: Column) -> Column:
        text = F.get(parts, F.lit(0))
        tail = F.substring(body, F.length(text) + 1, F.length(body))
        found = F.struct(text.alias("text"), trim(tail).alias("signature"))
        return F.when((F.size(parts) == 2) & (F.size(lines(tail)) <= SHORT), found)

    return let(F.split(body, java(pattern, flags), 2), cut)


def _signed_off(body: Column) -> Column:
    """(text, signature) from the first sign-off among the last lines whose tail reads as a signature."""

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        tail = lambda i: F.slice(ls, i, n - i + 1)
        at = F.filter(F.sequence(F.greatest(F.lit(1), n - (LONG - 1)), n), lambda i: F.rlike(F.get(ls, i - 1), F.lit(_SIGN_OFF)) & looks_like_signature(tail(i)))
        found = let(F.get(at, F.lit(0)), lambda i: F.when(i.isNotNull(), F.struct(F.array_join(F.slice(ls, F.lit(1), i - 1), "\n").alias("text"), F.array_join(tail(i), "\n").alias("signature"))))
        return F.when(n > 0, found)

    # one look for any sign-off spares most bodies their lines
    return F.when(F.rlike(body, F.lit(_ANY_SIGN_OFF)), let(lines(body), cut))


def extract_signature(body: Column) -> Column:
    """struct<text, signature>; signature is null where none is found."""
    none = F.struct(body.alias("text"), F.lit(None).cast("string").alias("signature"))
    # one look for any delimiter spares most bodies the ten
    delimited = F.when(F.rlike(body, F.lit(_ANY_DELIMITER)), F.coalesce(*(_delimited(body, *d) for d in DELIMITERS)))
    return F.when(body == "", none).otherwise(F.coalesce(delimited, _signed_off(body), none))
