"""Format-only masking of structured personal data (PRV-1) and e-mail token
decoding (PRV-4, PRV-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import code_point
from .urls import let

# Masking rules and their order.  An IBAN contains digit runs that
# a later rule would take.  Classes are Unicode ones, hence (?U).
GREEK_RULES = (
    ("iban", r"(?U)\bGR\d{2}[\s\d]{16,30}\b", "[redacted-iban]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted-email]"),
    ("mobile", r"(?U)\b69\d{8}\b", "[redacted-phone]"),
    ("landline", r"(?U)\b2\d{9}\b", "[redacted-phone]"),
    ("id", r"(?U)\b\d{11}\b", "[redacted-id]"),
)
# Extra rules for North-American phone numbers and 16-digit card numbers.
NANP_CARD_RULES = (
    ("nanp", r"\+1 \(\d{3}\) \d{3}-\d{4}", "[redacted-phone]"),
    ("card", r"(?U)\b\d{16}\b", "[redacted-card]"),
)
DEFAULT_RULES = GREEK_RULES
TEST_RULES = GREEK_RULES + NANP_CARD_RULES


# What a text must hold for a rule to match at all: a cheap test before the pattern.
# A replacement never adds it, so the test may look at the text as it came.
NEEDS = {"iban": lambda c: F.contains(c, F.lit("GR")), "email": lambda c: F.contains(c, F.lit("@")),
         "nanp": lambda c: F.contains(c, F.lit("+1 ("))}
LONG_RUN = r"(?U)\d{10}"
RUN_RULES = ("mobile", "landline", "id", "card")


def _apply(text: Column, ok: Column, pat: str, repl: str) -> Column:
    return let(text, lambda t: F.when(ok, F.regexp_replace(t, pat, repl)).otherwise(t))


def scrub(c: Column, rules=DEFAULT_RULES) -> Column:
    """PRV-1: apply every rule in order, each only to texts that it can match."""
    def chain(x):
        text = x["t"]
        for name, pat, repl in rules:
            ok = NEEDS[name](x["t"]) if name in NEEDS else x["run"] if name in RUN_RULES else F.lit(True)
            text = _apply(text, ok, pat, repl)
        return text

    return let(F.struct(c.alias("t"), c.rlike(LONG_RUN).alias("run")), chain) if rules else c


def rule_hits(c: Column, rules=DEFAULT_RULES) -> list[Column]:
    """Matches per rule, each counted on the text the earlier rules left."""
    out = []
    for name, pat, repl in rules:
        out.append(F.regexp_count(c, F.lit(pat)).cast("bigint").alias(f"n_{name}"))
        c = F.regexp_replace(c, pat, repl)
    return out


def shift_chars(c: Column, shift: int) -> Column:
    """Shift every code point by ``shift``; null when one leaves the code points."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    points = F.transform(chars, lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int") + F.lit(shift))
    bad = F.exists(points, lambda n: (n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF))
    return F.when(~bad, F.array_join(F.transform(points, code_point), ""))


def decode_mail_token(token: Column, shift: int = -1) -> Column:
    """PRV-4: shift back, drop a leading 'mailto' and separator quirks,
    keep only results holding '@'."""
    # Separators between "mailto" and the address.
    dec = shift_chars(token, shift)
    dec = F.when(F.lower(F.substring(dec, 1, 6)) == "mailto",
                 F.regexp_replace(F.substring(dec, 7, 1 << 30), r"^[:;+* \x{A0}]+", "")).otherwise(dec)
    return F.when((token.isNotNull()) & (token != "") & (F.instr(dec, "@") > 0), dec)


# Visible address obfuscations and their replacements.
VISIBLE_AT = ("<στο>", "[στο]", " στο ", "<at>", "[at]", " at ")
VISIBLE_DOT = ("<τελεία>", " τελεία ")


def email_from_visible(v: Column) -> Column:
    """PRV-5: restore an address from its visible obfuscated form."""
    s = v
    for a in VISIBLE_AT:
        s = F.replace(s, F.lit(a), F.lit("@"))
    for d in VISIBLE_DOT:
        s = F.replace(s, F.lit(d), F.lit("."))
    return F.when((v.isNotNull()) & (v != "") & (F.instr(s, "@") > 0), s)
