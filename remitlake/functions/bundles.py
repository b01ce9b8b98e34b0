"""Bundles of learned orders as JSON texts: building, structural fingerprint, and the contract's errors by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of a bundle and of its scoring entries.
KEYS = ("version", "patch", "semantic_scoring")
FIELD_KEYS = ("enabled", "adjustments", "trigger_observed")
ADJUSTMENTS = ("incl_btw_boost", "payable_label_boost", "totaal_anchor_boost", "vat_line_penalty", "excl_without_payable_penalty", "multi_amount_penalty")
SCORING = "map<string,map<string,variant>>"


def build(version: Column, golden_hash: Column, orders: Column, scoring: Column) -> Column:
    """A bundle: ``orders`` maps fields to lists of strategies, ``scoring`` maps fields to JSON texts of their entry."""
    entry = F.transform_values(scoring, lambda k, v: F.parse_json(v))
    return F.to_json(F.struct(version.alias("version"), golden_hash.alias("golden_hash"), F.struct(orders.alias("order")).alias("patch"), entry.alias("semantic_scoring")))


def _part(bundle: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(bundle), path, kind)


def _sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def structure(bundle: Column) -> Column:
    """What a fingerprint covers, as text: version, strategies by field, and keys of enabled adjustments; no tuned values."""
    text = lambda x: F.array_join(F.array_sort(x), ",")
    order = F.transform(_sorted_entries(_part(bundle, "$.patch.order", "map<string,array<string>>")), lambda e: F.concat(e["key"], F.lit("="), text(e["value"])))
    # variants have no order, so fields are sorted and looked up
    scoring = _part(bundle, "$.semantic_scoring", SCORING)
    def entry(k: Column) -> Column:
        on = F.coalesce(F.try_variant_get(F.try_element_at(F.try_element_at(scoring, k), F.lit("enabled")), "$", "boolean"), F.lit(False))
        keys = F.map_keys(F.try_variant_get(F.try_element_at(F.try_element_at(scoring, k), F.lit("adjustments")), "$", "map<string,variant>"))
        return F.concat(k, F.when(on, F.concat(F.lit("=on:"), F.coalesce(text(keys), F.lit("")))).otherwise(F.lit("=off")))
    schema = F.transform(F.array_sort(F.map_keys(scoring)), entry)
    blank = lambda x: F.coalesce(F.array_join(x, ";"), F.lit(""))
    return F.concat(F.lit("v"), F.coalesce(_part(bundle, "$.version", "int"), F.lit(0)).cast("string"), F.lit("|"), blank(order), F.lit("|"), blank(schema))


def fingerprint(bundle: Column) -> Column:
    return F.sha2(structure(bundle), 256)


def errors(bundle: Column, registry: dict[str, tuple[str, ...]]) -> Column:
    """All breaches of the contract, as sorted ``path:kind``; none for a bundle that fits.

    ``registry`` maps every known field to its strategies: an order has to be a permutation of them.
    A null, empty or unreadable text, and one that is no object, gives ``$:empty``.
    """
    top = _part(bundle, "$", "map<string,variant>")
    order, scoring = _part(bundle, "$.patch.order", "map<string,array<string>>"), _part(bundle, "$.semantic_scoring", SCORING)
    lit, say = F.lit, lambda when, what: F.when(when, F.lit(what))
    known = F.array(*[lit(f) for f in registry])
    found = [say(~F.map_contains_key(top, k), f"$.{k}:missing") for k in KEYS]
    has = lambda k: F.map_contains_key(top, k)
    found += [say(has("patch") & order.isNull(), "$.patch.order:no_lists_by_field"), say(has("semantic_scoring") & scoring.isNull(), "$.semantic_scoring:no_entries_by_field")]
    for field, strategies in registry.items():
        mine, at, own = F.try_element_at(order, lit(field)), f"$.patch.order.{field}", F.array(*[lit(s) for s in strategies])
        found += [
            say(order.isNotNull() & mine.isNull(), f"{at}:missing"), say(F.size(F.array_except(own, mine)) > 0, f"{at}:missing_strategies"),
            say(F.size(F.array_except(mine, own)) > 0, f"{at}:unknown_strategies"), say(F.size(mine) > F.size(F.array_distinct(mine)), f"{at}:repeated_strategies"),
        ]
        entry, at = F.try_element_at(scoring, lit(field)), f"$.semantic_scoring.{field}"
        on = F.coalesce(F.try_variant_get(F.try_element_at(entry, lit("enabled")), "$", "boolean"), lit(False))
        more = F.try_variant_get(F.try_element_at(entry, lit("adjustments")), "$", "map<string,variant>")
        found += [
            say(scoring.isNotNull() & entry.isNull(), f"{at}:missing"), say(~F.map_contains_key(entry, "enabled"), f"{at}:no_enabled"), say(on & more.isNull(), f"{at}:no_adjustments"),
            say(F.size(F.array_except(F.map_keys(entry), F.array(*[lit(k) for k in FIELD_KEYS]))) > 0, f"{at}:unknown_keys"),
            say(on & (F.size(F.array_except(F.map_keys(more), F.array(*[lit(k) for k in ADJUSTMENTS]))) > 0), f"{at}:unknown_adjustments"),
        ]
    none = F.array().cast("array<string>")
    strange = lambda m, at: F.coalesce(F.transform(F.array_except(F.map_keys(m), known), lambda f: F.concat(lit(at), f, lit(":unknown_field"))), none)
    out = F.array_sort(F.concat(F.array_compact(F.array(*found)), strange(order, "$.patch.order."), strange(scoring, "$.semantic_scoring.")))
    return F.when(top.isNull() | (F.size(F.map_keys(top)) == 0), F.array(lit("$:empty"))).otherwise(out)
