"""Learning pass: orders of strategies by field, changed round by round and kept where no field loses.

Of every document and field only the outcomes of its strategies matter, so documents with the same
outcomes are counted together first. That table is as small as there are combinations of outcomes,
and the rounds go over it alone, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def outcomes(attempts: DataFrame) -> DataFrame:
    """(field_id, outcomes, n): how many documents have which outcomes, a list of (strategy, valid).

    ``attempts``: doc_id, field_id, strategy, status. A strategy that was tried more than once on a document
    is valid if it was so once; skipped attempts and other states do not count.
    """
    tried = attempts.where("status in ('valid', 'invalid')").groupBy("doc_id", "field_id", "strategy").agg(F.max(F.col("status") == "valid").alias("valid"))
    per = tried.groupBy("doc_id", "field_id").agg(F.array_sort(F.collect_list(F.struct("strategy", "valid"))).alias("outcomes"))
    return per.groupBy("field_id", "outcomes").agg(F.count("*").alias("n"))


def winners(counted: DataFrame, orders: DataFrame) -> DataFrame:
    """(field_id, strategy, n_valid, n_wrong): what the first strategy of an order (field_id, strategies) that was tried gives."""
    first = F.get(F.filter("strategies", lambda s: F.exists("outcomes", lambda o: o["strategy"] == s)), F.lit(0))
    won = counted.join(orders, "field_id").withColumn("strategy", first).where("strategy is not null")
    valid = F.exists("outcomes", lambda o: (o["strategy"] == F.col("strategy")) & o["valid"])
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return won.withColumn("__v", valid).groupBy("field_id", "strategy").agg(n(F.col("__v")).alias("n_valid"), n(~F.col("__v")).alias("n_wrong"))


def _correct(won: DataFrame, name: str) -> DataFrame:
    return won.groupBy("field_id").agg(F.sum("n_valid").alias(name))


def by_success(counted: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with the strategies of the best rate of valid outcomes first; untried ones last, ties by name."""
    o = counted.select("field_id", "n", F.inline("outcomes")).groupBy("field_id", "strategy").agg((F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    each = orders.select("field_id", F.explode("strategies").alias("strategy")).join(o, ["field_id", "strategy"], "left")
    ranked = F.array_sort(F.collect_list(F.struct((-F.coalesce("rate", F.lit(-1.0))).alias("__k"), "strategy")))
    return each.groupBy("field_id").agg(F.transform(ranked, lambda x: x["strategy"]).alias("strategies"))


def demoted(won: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with the strategy that is most often wrong as a winner put last."""
    worst = won.where("n_wrong > 0").groupBy("field_id").agg(F.min(F.struct((-F.col("n_wrong")).alias("__k"), "strategy"))["strategy"].alias("__w"))
    moved = F.concat(F.array_remove(F.col("strategies"), F.col("__w")), F.array("__w"))
    return orders.join(worst, "field_id", "left").select("field_id", F.when(F.col("__w").isNotNull(), moved).otherwise(F.col("strategies")).alias("strategies"))


def run(attempts: DataFrame, orders: DataFrame, rounds: int = 4) -> DataFrame:
    """States (round, field_id, strategies, correct, accepted) of all rounds; the last of a field is its result.

    ``orders``: field_id, strategies (each once). Round 0 is the start; round 1 proposes :func:`by_success`, later ones
    :func:`demoted`. A field's proposal is accepted if more documents come out right, so no
    field ever loses. It ends after ``rounds``, or when no field gains. Fields without attempts stay as they are.
    """
    counted = checkpointed(outcomes(attempts))
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = orders.select("field_id", "strategies").join(_correct(winners(counted, orders), "correct"), "field_id", "left")
    state = checkpointed(state.select(F.lit(0).alias("round"), "field_id", "strategies", zero("correct").alias("correct"), F.lit(False).alias("accepted")))
    history = state
    for r in range(1, rounds + 1):
        now = state.select("field_id", "strategies")
        proposal = by_success(counted, now) if r == 1 else demoted(winners(counted, now), now)
        proposal = checkpointed(proposal)
        then = proposal.join(_correct(winners(counted, proposal), "__c"), "field_id", "left").select("field_id", F.col("strategies").alias("__s"), zero("__c").alias("__c"))
        better = F.col("__c") > F.col("correct")
        state = checkpointed(state.join(then, "field_id").select(
            F.lit(r).alias("round"), "field_id", F.when(better, F.col("__s")).otherwise(F.col("strategies")).alias("strategies"), F.greatest("__c", "correct").alias("correct"), better.alias("accepted"),
        ))
        history = history.unionByName(state)
        # the first round may gain nothing where the next ones do
        if r > 1 and not state.where("accepted").limit(1).count():
            break
    return history
