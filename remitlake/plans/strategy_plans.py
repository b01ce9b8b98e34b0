"""All string and amount strategies over texts of several layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strategies as st
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import DOCS, w

LAY = """lay AS (SELECT doc_id, c, CASE order_id % 7 WHEN 0 THEN concat('Factuurnummer: ', doc_id, chr(10), 'Totaal te betalen: ', a) WHEN 1 THEN concat('Factuur ', doc_id, ' Pagina 1', chr(10), 'Totaal EUR 12,34 ', a) WHEN 2 THEN concat('Ons kenmerk:', chr(10), doc_id, chr(10), 'Te betalen', chr(10), a)
  WHEN 3 THEN concat('Nr [O+7] ', doc_id, chr(10), 'excl. btw ', replace(CAST(amount - 1 AS VARCHAR), '.', ','), chr(10), 'btw 21% 1,00') WHEN 4 THEN concat('Kenmerk ', lower(doc_id), chr(10), 'som EUR ', a, ' 5,00') WHEN 5 THEN concat(doc_id, chr(10), a) ELSE 'zonder' END AS text
  FROM (SELECT *, replace(CAST(amount AS VARCHAR), '.', ',') AS a, CAST(amount * 100 AS BIGINT) AS c FROM docs))"""


def _layouts(spark, sf):
    d, k, lit = fx.documents(spark, sf), F.col("order_id") % 7, F.lit
    a = F.replace(F.col("amount").cast("string"), lit("."), lit(","))
    less = F.replace((F.col("amount") - 1).cast("decimal(18,2)").cast("string"), lit("."), lit(","))
    text = (
        F.when(k == 0, F.concat(lit("Factuurnummer: "), "doc_id", lit("\nTotaal te betalen: "), a)).when(k == 1, F.concat(lit("Factuur "), "doc_id", lit(" Pagina 1\nTotaal EUR 12,34 "), a)).when(k == 2, F.concat(lit("Ons kenmerk:\n"), "doc_id", lit("\nTe betalen\n"), a))
        .when(k == 3, F.concat(lit("Nr [O+7] "), "doc_id", lit("\nexcl. btw "), less, lit("\nbtw 21% 1,00"))).when(k == 4, F.concat(lit("Kenmerk "), F.lower("doc_id"), lit("\nsom EUR "), a, lit(" 5,00"))).when(k == 5, F.concat("doc_id", lit("\n"), a)).otherwise("zonder")
    )
    return d.select("doc_id", (F.col("amount") * 100).cast("long").alias("cents"), text.alias("text"))


SPLIT = "s AS (SELECT *, string_split(text, chr(10)) AS l FROM lay), p AS (SELECT *, list_position(list_transform(l, lambda x: contains(lower(x), lower(doc_id))), true) AS i FROM s), q AS (SELECT *, l[i] AS line, CASE WHEN i > 1 THEN l[i - 1] END AS up, instr(lower(l[i]), lower(doc_id)) AS pos FROM p), r AS (SELECT *, trim(substr(line, 1, pos - 1)) AS pre, substr(line, pos, length(doc_id)) AS act, CASE WHEN length(trim(split_part(up, ':', 1))) >= 2 THEN trim(split_part(up, ':', 1)) END AS above FROM q), z AS (SELECT *, CASE WHEN contains(pre, ':') THEN trim(split_part(line, ':', 1)) END AS colon, CASE WHEN length(pre) >= 2 THEN pre END AS own FROM r)"
STRINGS = r"""SELECT doc_id, 'token_matching_confirmed_value' AS strategy, CASE WHEN own IS NULL THEN 'next_line_first_token' WHEN contains(pre, ':') THEN 'same_line_after_colon' ELSE 'same_line_value_after_label' END AS rule, coalesce(own, above) AS label, act AS candidate FROM z
  UNION ALL SELECT doc_id, 'same_line_value_after_label', 'same_line_value_after_label', CASE WHEN pre <> '' THEN pre END, act FROM z
  UNION ALL SELECT doc_id, 'factuur_inline_pagina', 'factuur_inline_pagina', CASE WHEN lower(regexp_extract(text, '(?i)\bFactuur\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s+Pagina\b', 1)) = lower(doc_id) THEN 'Factuur' END, act FROM z
  UNION ALL SELECT doc_id, 'generic_label_same_line_after_colon', 'same_line_after_colon', colon, act FROM z
  UNION ALL SELECT doc_id, 'label_then_next_line', 'next_line_first_token', above, act FROM z
  UNION ALL SELECT doc_id, 'last_token_on_line', 'last_token_on_line', coalesce(colon, CASE WHEN length(pre) >= 3 THEN pre END), act FROM z
  UNION ALL SELECT doc_id, 'ocr_tag_extraction', 'ocr_tag_extraction', CASE WHEN regexp_matches(line, '\[O\+[^\]]+\]') THEN trim(split_part(line, '[O+', 1)) END, act FROM z
  UNION ALL SELECT doc_id, 'fallback_value_locate_minimal_label', CASE WHEN contains(line, ':') THEN 'same_line_after_colon' ELSE 'next_line_first_token' END, CASE WHEN contains(line, ':') THEN coalesce(own, above) ELSE coalesce(above, own) END, act FROM z"""


@query("ln_str_all", w(DOCS, LAY, SPLIT) + f"SELECT doc_id, strategy, rule, label, candidate FROM ({STRINGS}) WHERE label IS NOT NULL")
def ln_str_all(spark, sf):
    """What all nine string strategies propose; ``ln_str_strategies`` is the narrow form."""
    t = _layouts(spark, sf)
    known = t.select("doc_id", F.lit("invoice_number").alias("field_id"), F.col("doc_id").alias("confirmed"))
    return st.strings(t, known).where("status = 'proposed'").select("doc_id", "strategy", "rule", "label", "candidate")


AMOUNTS = r"""u AS (SELECT doc_id, c, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM lay),
  v AS (SELECT *, list_transform(regexp_extract_all(line, '\d{1,3}(?:[.,]\d{3})+[.,]\d{2}|\d+[.,]\d{2}'), lambda x: CAST(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT)) AS sums, regexp_extract(line, '(?i)\b(te\s+betalen|te\s+voldoen|totaal\s+factuurbedrag|factuurbedrag|factuurtotaal|eindbedrag|amount\s+due|totaal|total)\b') AS tot, regexp_matches(line, '(?i)\bexcl\. btw\b') AS ex, regexp_matches(line, '(?i)\bbtw\s*(\d{1,2}\s*%|:)') AS vt FROM u),
  h AS (SELECT *, CASE WHEN len(sums) >= 2 AND sums[1] = c THEN 'same_line_first_amount' ELSE 'same_line_last_amount' END AS rule, CASE WHEN line LIKE '%:%' THEN trim(split_part(line, ':', 1)) WHEN tot <> '' THEN tot END AS near, CASE WHEN line LIKE 'Totaal te%' THEN 'te betalen' WHEN tot <> '' THEN tot WHEN line LIKE '%EUR%' THEN 'EUR' END AS scan,
    trim(substr(line, 1, length(line) - length(regexp_extract(line, CASE WHEN sums[len(sums)] = c THEN '\d+[.,]\d{2}$' ELSE '\d+[.,]\d{2} \S+$' END)))) AS pre FROM v WHERE list_contains(sums, c) AND NOT ex AND NOT vt),
  o AS (SELECT doc_id, 'token_matching_confirmed_amount' AS strategy, arg_min(rule, i) AS rule, arg_min(near, i) AS label FROM h WHERE near IS NOT NULL GROUP BY 1
  UNION ALL SELECT doc_id, 'amount_fallback_scan', arg_min(rule, i), arg_min(scan, i) FROM h WHERE scan IS NOT NULL GROUP BY 1
  UNION ALL SELECT doc_id, 'unlabeled_prefix_amount', arg_min(rule, i), arg_min(pre, i) FROM h WHERE length(pre) >= 3 GROUP BY 1
  UNION ALL SELECT v.doc_id, 'amount_label_next_line', CASE WHEN len(n.sums) > 1 AND (n.sums[len(n.sums)] = v.c OR n.sums[1] <> v.c) THEN 'next_line_last_amount' ELSE 'next_line_first_token' END, v.tot FROM v JOIN v n ON v.doc_id = n.doc_id AND n.i = v.i + 1 WHERE v.tot <> '' AND list_contains(n.sums, v.c)
  UNION ALL SELECT e.doc_id, 'derived_excl_plus_vat', 'derived_excl_plus_vat', concat('excl. btw', ' + ', 'btw 21%') FROM v e JOIN v t ON e.doc_id = t.doc_id AND e.ex AND t.vt AND e.sums[len(e.sums)] + t.sums[len(t.sums)] = e.c)"""


@query("ln_amt_all", w(DOCS, LAY, AMOUNTS) + "SELECT doc_id, strategy, rule, label FROM o")
def ln_amt_all(spark, sf):
    """What the amount strategies propose; ``ln_amt_strategies`` is the narrow form."""
    t = _layouts(spark, sf)
    return st.amounts(t, t.select("doc_id", "cents", F.lit(None).cast("string").alias("context"))).where("status = 'proposed'").select("doc_id", "strategy", "rule", "label")
