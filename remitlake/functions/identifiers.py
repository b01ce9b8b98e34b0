"""Account, tax, company and customer identifiers, e-mail domains and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def iban_clean(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "\\s", ""))


def mod97(rotated: Column) -> Column:
    """Remainder by 97 of the digits that letters and digits stand for."""
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) >= 65, (a * 100 + code(c) - 55) % 97).otherwise((a * 10 + code(c) - 48) % 97)
    return F.aggregate(F.split(rotated, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def iban_valid(text: Column) -> Column:
    """Shape, length 15 to 34 and check digits of a cleaned account number; null is not valid."""
    ok = lambda clean: F.when(clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(F.concat(F.substring(clean, 5, 40), F.substring(clean, 1, 4))) == 1)
    return F.coalesce(let(iban_clean(text), ok), F.lit(False))


def iban_mask(text: Column) -> Column:
    clean = iban_clean(text)
    return F.when(F.length(clean) >= 6, F.concat(F.left(clean, F.lit(2)), F.lit("…"), F.right(clean, F.lit(4))))


def iban_ocr_fix(text: Column) -> Column:
    """Letters read for digits in the digit places of a Dutch account number."""
    clean = iban_clean(text)
    fix = lambda c: F.translate(c, "OISZ", "0152")
    return F.when(clean.rlike("^NL.{16}$"), F.concat(F.lit("NL"), fix(F.substring(clean, 3, 2)), F.substring(clean, 5, 4), fix(F.substring(clean, 9, 10)))).otherwise(clean)


def vat_compact(text: Column) -> Column:
    """Canonical tax number: letters and digits only, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def vat_shape(text: Column) -> Column:
    return F.coalesce(vat_compact(text).rlike("^(?:NL[0-9]{9}B[0-9]{2}|DE[0-9]{9}|[A-Z]{2}[0-9A-Z]{8,12})$"), F.lit(False))


def kvk(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).isin(7, 8), digits)


def email_domain(text: Column) -> Column:
    """Domain in lower case without ``www.``; null without a dot."""
    domain = F.regexp_replace(F.regexp_extract(F.lower(F.trim(text)), "([^@\\s]+)$", 1), "^www\\.", "")
    return F.when(domain.contains("."), domain)


def customer_code(text: Column) -> Column:
    """Digits if there are four or more, else the lower-cased text."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lower(F.trim(text)))


def k_code(text: Column) -> Column:
    """``K 014135`` as ``K014135``; null if it is no such code."""
    compact = F.upper(F.regexp_replace(text, "\\s", ""))
    return F.when(compact.rlike("^K[0-9]{4,}$"), compact)


def clean_name(text: Column) -> Column:
    """Lower-case words of letters, without a leading page mark, legal forms joined."""
    s = F.regexp_replace(F.lower(F.trim(text)), "^\\s*[0-9]+\\s*/\\s*[0-9]+\\s+", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z\\s]", " "), "\\s+", " "))
    return F.regexp_replace(F.regexp_replace(s, "\\bb v\\b", "bv"), "\\bn v\\b", "nv")


def alias_in(hint: Column, alias: Column) -> Column:
    """Equal, or a run of whole words of the hint; single words need three letters."""
    inside = F.concat(F.lit(" "), hint, F.lit(" ")).contains(F.concat(F.lit(" "), alias, F.lit(" ")))
    return F.coalesce((hint != "") & (alias != "") & ((hint == alias) | (inside & (alias.contains(" ") | (F.length(alias) >= 3)))), F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
