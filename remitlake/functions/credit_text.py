"""Credit notes told from their wording, and the invoices they refer to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of a credit note with their weight, and wording of references.
SIGNALS = (
    ("keyword_strong", 70, r"(?i)\b(?:credit\s?nota|creditfactuur|credit note|gutschrift)\b"),
    ("title_credit_banner", 60, r"(?i)\*{2,}\s*credit\s*\*{2,}"),
    ("negative_total_label", 55, r"(?i)\b(?:factuurbedrag|totaal|te betalen|amount due)\b[^\n]{0,40}?-\s*\d+[.,]\d{2}\b"),
    ("negative_amount_line", 40, r"(?i)(?:EUR|€)\s*-\s*\d+[.,]\d{2}\b"),
    ("negative_vat_line", 25, r"(?i)\bbtw\b[^\n]{0,30}?-\s*\d[\d.,]*"),
)
STRONG = ("keyword_strong", "title_credit_banner", "negative_total_label")
THRESHOLD = 50
REFERENCE = r"(?i)\b(?:fact\.?\s*nr\.?|factuurnr\.?|onze factuur|referentie factuur|credit (?:naar|voor|van) factuur)\s*:?\s*([A-Z0-9][A-Z0-9./_-]{2,})"


def signals(text: Column) -> Column:
    """Names of the signals found, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, _, p in SIGNALS]))


def score(text: Column) -> Column:
    """Sum of weights up to 100; creditor wording costs 30 unless a strong signal stands."""
    found = signals(text)
    weights = F.create_map(*[F.lit(x) for n, w, _ in SIGNALS for x in (n, w)])
    total = F.aggregate(F.transform(found, lambda n: weights[n]), F.lit(0), lambda a, x: a + x)
    strong = F.arrays_overlap(found, F.array(*[F.lit(s) for s in STRONG]))
    false_friend = text.rlike(r"(?i)\bcreditor\b|\bcredit\s*transfer\b")
    return F.least(F.lit(100), F.when(~strong & false_friend, F.greatest(F.lit(0), total - 30)).otherwise(total))


def references(text: Column) -> Column:
    """Invoice numbers referred to: with a digit, not a credit's own number, each once."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda v: F.upper(F.regexp_replace(v, r"\++$", "")))
    return F.array_distinct(F.filter(raw, lambda v: v.rlike("[0-9]") & ~v.rlike("^(?:VCR|CN|CREN|CR|C[0-9])")))


# The complete set of signals with their weight and the part of the text they are sought in,
# what tells creditors and transfers apart, and the wording of references with the context they need.
TOKEN_NEGATIVE = r"-\s*(?!\d{2}-)\d+(?:[.,]\d{2})\b"
ALL_SIGNALS = (
    ("metadata_type_credit_note", 80, "type", r"(?i)^\s*credit_note\s*$"),
    ("keyword_strong", 70, "text", r"(?i)\b(?:creditnota|credit\s*note|creditfactuur|verkoopcredit(?:nota)?|credit\s*invoice|cren|gutschrift|storno|reversal|correctiefactuur|correctie)\b"),
    ("title_credit_factuur", 65, "head", r"(?i)\b(?:credit\s*factuur|creditfactuur|credit\s*invoice)\b"),
    ("title_credit_banner", 60, "text", r"(?i)\*{2,}\s*credit\s*\*{2,}"),
    ("creditnota_title_line", 65, "text", r"(?i)^\s*(?:creditnota|verkoopcreditnota|credit\s*note)\b"),
    ("weak_credit_with_context", 45, "text", r"(?is)^(?=.*\bcredit\b)(?=.*\b(?:nota|factuur|invoice|volgens\s+afspraak|slechte|terug|crediteren)\b)"),
    ("negative_total_label", 55, "text", rf"(?i)\b(?:factuurbedrag|totaal(?:\s*te\s*betalen)?|te\s*betalen|total\s*due|gesamtbetrag|amount\s*due)\b[^\n]{{0,40}}?{TOKEN_NEGATIVE}"),
    ("negative_amount_line", 40, "text", rf"(?i)(?:EUR|€)\s*{TOKEN_NEGATIVE}|{TOKEN_NEGATIVE}(?:\s*(?:EUR|€))?"),
    ("negative_vat_line", 25, "text", r"(?i)\bbtw\b[^\n]{0,30}?-\s*\d[\d.,]*"),
)
ALL_STRONG = ("keyword_strong", "title_credit_factuur", "title_credit_banner", "creditnota_title_line", "metadata_type_credit_note", "negative_total_label")
FALSE_FRIEND = r"(?i)\bcreditor\b|\bcredit\s*transfer\b"
OWN_NUMBER = r"(?i)^(?:VCR|CN|CREN|CR|C\d)"
PARENT_CONTEXT = r"(?i)\b(?:fact\.?\s*nr\.?|vereffening\s+met\s+factuurnr|betr\.?:?\s*(?:onze\s+)?factuur|onze\s+factuur|referentie\s+factuur|credit\s+(?:naar|voor|van)\s+factuur)\b"
PARENT_REFERENCES = (
    r"(?i)\b(?:fact\.?\s*nr\.?|factuurnr\.?|factuurnummer|invoice\s*(?:no\.?|number)?)\s*[:\s]+([A-Z0-9][A-Z0-9./+\-_]{2,})",
    r"(?i)\b(?:betr\.?:?\s*)?(?:onze\s+)?factuur\s+([A-Z0-9][A-Z0-9./+\-_]{2,})",
    r"(?i)\bvereffening\s+met\s+factuurnr\.?\s*([A-Z0-9][A-Z0-9./+\-_]{2,})",
    r"(?i)\bcredit\s+(?:naar|voor|van)\s+factuur\s+([A-Z0-9][A-Z0-9./+\-_]{2,})",
    r"(?i)\breferentie\s+factuur\s*[:\s]+([A-Z0-9][A-Z0-9./+\-_]{2,})",
)


def all_signals(text: Column, doc_type: Column) -> Column:
    """Names of all signals found in a text (titles in its first 15 lines) and its type."""
    place = {"text": F.coalesce(text, F.lit("")), "head": F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 15), "\n"), "type": F.coalesce(doc_type, F.lit(""))}
    return F.array_compact(F.array(*[F.when(place[at].rlike(p), n) for n, _, at, p in ALL_SIGNALS]))


def confidence(found: Column, text: Column) -> Column:
    """Sum of the signals' weights up to 100; wording of creditors and transfers costs 30 where no strong one stands."""
    total = sum((F.when(F.array_contains(found, n), w).otherwise(0) for n, w, _, _ in ALL_SIGNALS), F.lit(0))
    strong = F.arrays_overlap(found, F.array(*[F.lit(s) for s in ALL_STRONG]))
    return F.least(F.lit(100), F.when(~strong & text.rlike(FALSE_FRIEND), F.greatest(F.lit(0), total - 30)).otherwise(total))


def parents(text: Column) -> Column:
    """Invoice numbers that a credit note refers to: on lines of that context, with a digit, not its own, each once."""
    def of(line: Column) -> Column:
        raw = F.flatten(F.array(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in PARENT_REFERENCES]))
        return F.when(line.rlike(PARENT_CONTEXT), raw).otherwise(F.array().cast("array<string>"))

    raw = F.transform(F.flatten(F.transform(F.split(text, "\n"), of)), lambda v: F.upper(F.regexp_replace(v, r"\++$", "")))
    return F.array_distinct(F.filter(raw, lambda v: (F.length(v) >= 3) & v.rlike("[0-9]") & ~v.rlike(OWN_NUMBER)))
