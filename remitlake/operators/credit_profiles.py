"""Suppliers' own rules for credit notes: corrections of the text, then number, amount and references.

A profile is a row (supplier_key, patterns, replacements, number_rule, amount_rule, reference_patterns);
the rules are structs (strategy, label) as the learning operators store them. So the program that
runs on a text is data of its row. Patterns have the syntax of Python's ``re``, as suppliers'
profiles are written so; one that does not compile is left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import credit_text, money
from ..sources.shared import ship
from .joins import lookup
from .learning import STRATEGIES

#: Fixed value: confidence from which a credit note's own profile applies.
THRESHOLD = 50
PROFILE = "supplier_key string, patterns array<string>, replacements array<string>, number_rule struct<strategy:string,label:string>, amount_rule struct<strategy:string,label:string>, reference_patterns array<string>"


def _compiled(pattern: str | None):
    import re

    try:
        return re.compile(pattern.strip()) if pattern and pattern.strip() else None
    except re.error:
        return None


def _corrected(text: pd.Series, patterns: pd.Series, replacements: pd.Series) -> pd.Series:
    import re
    from functools import lru_cache

    known, out = lru_cache(4096)(_compiled), []
    for t, ps, rs in zip(text, patterns, replacements, strict=True):
        for p, r in zip(() if ps is None else ps, () if rs is None else rs, strict=False):
            if found := known(p):
                try:
                    t = found.sub(r or "", t)
                except (re.error, IndexError):  # a replacement that names a group which is not there
                    continue
        out.append(t)
    return pd.Series(out, dtype=object)


def _referred(text: pd.Series, patterns: pd.Series) -> pd.Series:
    from functools import lru_cache

    known, out = lru_cache(4096)(_compiled), []
    for t, ps in zip(text, patterns, strict=True):
        seen: dict[str, str] = {}
        found = [x for x in (known(p) for p in (() if ps is None else ps)) if x]
        for line in t.splitlines():
            for x in found:
                for m in x.finditer(line):
                    raw = ((m.group(1) if x.groups else m.group(0)) or "").strip()
                    if len(raw) >= 3:
                        seen.setdefault(raw.upper(), raw)
        out.append(list(seen.values()))
    return pd.Series(out, dtype=object)


def read_rule(text: Column, rule: Column) -> Column:
    """What a rule (strategy, label) reads from the first line that begins with its label; null where it reads nothing."""
    def of(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(x), F.lower(rule["label"]))), True).cast("int")
        line, after = F.get(lines, at - 1), F.get(lines, at)
        rest = F.trim(F.substr(line, F.length(rule["label"]) + 1, F.length(line)))
        value = (
            F.when(rule["strategy"] == STRATEGIES[0], F.trim(F.regexp_extract(line, r":\s*(.*)$", 1))).when(rule["strategy"] == STRATEGIES[1], rest)
            .when(rule["strategy"] == STRATEGIES[2], F.element_at(F.split(F.trim(line), r"\s+"), -1)).when(rule["strategy"] == STRATEGIES[3], F.get(F.split(F.trim(after), r"\s+"), F.lit(0)))
        )
        return F.when((at > 0) & (value != ""), value)

    return F.get(F.transform(F.array(F.split(text, "\n")), of), F.lit(0))


def may_apply(doc_type: Column, supplier_key: Column, has_profile: Column, is_credit: Column, confidence: Column, user_override: Column) -> Column:
    """Only a credit note of a known supplier with a profile, told surely enough or confirmed by a user."""
    sure = F.coalesce(user_override, F.lit(False)) | (F.coalesce(is_credit, F.lit(False)) & (F.coalesce(confidence, F.lit(0)) >= THRESHOLD))
    return F.coalesce(doc_type == "credit_note", F.lit(False)) & (F.trim(F.coalesce(supplier_key, F.lit(""))) != "") & F.coalesce(has_profile, F.lit(False)) & sure


def apply(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``docs`` with number, amount and references as their suppliers' credit profiles read them.

    ``docs``: doc_id, doc_type, supplier_key, text, is_credit, confidence, user_override, number, amount,
    references (list) and more; ``profiles``: :data:`PROFILE`, one row a supplier. Every document stays
    one row: without a profile, or where it :func:`may_apply` not, it is as before. A value that
    a rule does not read stays. General wording of references goes before a profile's patterns, which
    count only below :data:`THRESHOLD` (a user's word stands for it). ``profile_fields`` lists what changed.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rules = F.struct("patterns", "replacements", "number_rule", "amount_rule", "reference_patterns")
    named = profiles.where("supplier_key is not null").select("supplier_key", rules.alias("__p"))
    candidates = may_apply(F.col("doc_type"), F.col("supplier_key"), F.lit(True), F.col("is_credit"), F.col("confidence"), F.col("user_override"))
    # others do not go through the join: their key is set aside
    keyed = docs.withColumn("__k", F.when(candidates, F.col("supplier_key")))
    joined = lookup(keyed, named.withColumnRenamed("supplier_key", "__k"), "__k", "doc_id")
    on, p = F.col("__p").isNotNull(), F.col("__p")
    # texts go to Python only where a profile has a pattern for them
    to_mend = F.when(on & (F.size(F.coalesce(p["patterns"], F.array().cast("array<string>"))) > 0), p["patterns"])
    mend = F.pandas_udf(_corrected, T.StringType())
    x = joined.withColumn("__text", F.when(to_mend.isNotNull(), mend(F.when(to_mend.isNotNull(), text).otherwise(F.lit("")), to_mend, p["replacements"])).otherwise(text))
    refs = credit_text.parents(F.col("__text"))
    x = x.withColumns({"__refs": F.when(on, refs), "__number": F.when(on, read_rule(F.col("__text"), p["number_rule"]))})
    x = x.withColumn("__amount", F.when(on, money.european(F.regexp_extract(read_rule(F.col("__text"), p["amount_rule"]), r"(-?[0-9][0-9.]*[.,][0-9]{2})(?![0-9])", 1)).cast("decimal(18,2)")))
    open_ = on & (F.size("__refs") == 0) & (F.coalesce("confidence", F.lit(0)) < THRESHOLD) & (F.size(F.coalesce(p["reference_patterns"], F.array().cast("array<string>"))) > 0)
    refer = F.pandas_udf(_referred, T.ArrayType(T.StringType()))
    x = x.withColumn("__more", refer(F.when(open_, F.col("__text")).otherwise(F.lit("")), F.when(open_, p["reference_patterns"])))
    x = x.withColumn("__refs", F.when(open_, F.col("__more")).otherwise(F.col("__refs")))
    some = F.coalesce(F.size("__refs") > 0, F.lit(False))
    fields = F.array_compact(F.array(F.when(F.col("__amount").isNotNull(), "amount"), F.when(F.col("__number").isNotNull(), "credit_number"), F.when(some, "references")))
    return x.select(
        *[c for c in docs.columns if c not in ("text", "number", "amount", "references")], F.when(on, F.col("__text")).otherwise(F.col("text")).alias("text"),
        F.coalesce("__number", "number").alias("number"), F.coalesce("__amount", "amount").cast("decimal(18,2)").alias("amount"), F.when(some, F.col("__refs")).otherwise(F.col("references")).alias("references"), fields.alias("profile_fields"),
    )
