"""Mixing sources to target weights by hierarchical budgeting (operator 5)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, cut

#: Buckets of the seeded order of a leaf; a leaf's prefix ends inside one of them.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Target weights of a domain-language-source tree.

    A node's weight is relative to its siblings; names that aren't listed have weight 1, and one of weight 0 gives nothing. domains maps the last digits of a
    source's name, divided by five, to a domain. The budget is a fraction of all tokens; a leaf can give its tokens up to
    max_epochs times.
    """

    domain: Mapping[str, float] = field(default_factory=lambda: {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 2.0})
    lang: Mapping[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 3.0, "fr": 3.0, "es": 2.0})
    source: Mapping[str, float] = field(default_factory=lambda: {"src0": 3.0})
    budget: float = 0.9
    max_epochs: int = 2
    seed: int = 7


LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def leaf_columns() -> dict[str, Column]:
    """domain, lang and source of a document; a null name is the empty one."""
    source = F.coalesce(F.col("source"), F.lit(""))
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int")
    return {
        "domain": F.coalesce(F.concat(F.lit("d"), F.floor(number / 5).cast("string")), F.lit("d")),
        "lang": F.coalesce(F.col("lang"), F.lit("")),
        "source": source,
    }


def _weight(name: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, float(v)).otherwise(out)
    return out


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children with given: the part of the parent's budget that each gets. Columns used: budget, cap and weight.

    Every child gets its weight's part of the budget, but no more than cap; what is over goes to its siblings by weight, and
    so on. In the order of cap / weight the children that are full come first, so one pass over a parent's children finds
    them. A parent's own budget is at most the sum of its children's caps, so a shortage stays among siblings as long as
    they can take it and reaches ancestors only beyond that.
    """
    of = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    up = of.orderBy(F.try_divide("cap", "weight").asc_nulls_first(), F.col(name).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caps, weights = F.sum("cap").over(up) - F.col("cap"), F.sum("weight").over(up) - F.col("weight")
    rows = children.withColumn("_level", F.try_divide(F.col("budget") - caps, F.sum("weight").over(of) - weights))
    rows = rows.withColumn("_full", (F.col("weight") == 0) | F.coalesce(F.col("_level") * F.col("weight") >= F.col("cap"), F.lit(False)))
    over = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(of)
    left = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(of)
    rows = rows.withColumn("given", F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("budget") - over) * F.col("weight"), left), F.lit(0.0)))))
    return rows.drop("_level", "_full")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, given (tokens, down to an integer), epochs (whole ones) and rest of every leaf.

    leaves: domain, lang, source, tokens. The tables have a row for each node of the tree; the top one has the domains.
    """
    # What hangs on a weight of zero can give nothing, so its part goes to siblings like any shortage.
    asked = F.lit(True)
    for n in LEVELS:
        asked = asked & (_weight(n, getattr(mix, n)) > 0)
    caps = leaves.withColumn("cap", F.when(asked, F.col("tokens") * mix.max_epochs).otherwise(F.lit(0).cast("long")))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = F.least(F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * mix.budget), F.sum("cap").over(Window.partitionBy(F.lit(0))))
    top = share_out(domains.withColumn("budget", whole.cast("double")).withColumn("weight", _weight("domain", mix.domain)), [], "domain")
    mid = langs.drop("tokens").join(top.select("domain", F.col("given").alias("budget")), "domain").withColumn("weight", _weight("lang", mix.lang))
    mid = share_out(mid, ["domain"], "lang")
    low = caps.join(mid.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]).withColumn("weight", _weight("source", mix.source))
    low = share_out(low, ["domain", "lang"], "source")
    given = F.floor(F.col("given") + 1e-6).cast("long")
    epochs = F.coalesce(F.try_divide(given, F.col("tokens")).cast("long"), F.lit(0).cast("long"))
    out = low.select(*LEVELS, "tokens", given.alias("given"))
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens")).withColumn("given", F.col("given"))


def _order(mix: Mix) -> Column:
    """The place of a document in the order of the epoch that is taken in part."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source and tokens (words) of every row."""
    names = leaf_columns()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in names.items()), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def mixture_plan(counts: DataFrame, mix: Mix) -> DataFrame:
    """The leaf budgets with last: the order key up to which a leaf's documents are in its partial epoch (null: none).

    counts: checkpointed token_counts. The prefix is the longest whose tokens are within rest. Buckets of the order are
    summed first; only the documents of the bucket in which a leaf's prefix ends are ranked, so a leaf with a third of all
    rows is summed in parts and no task gathers it.
    """
    budgets = cut(leaf_budgets(counts.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), mix))
    placed = counts.join(broadcast_if_small(budgets.select(*LEVELS, "epochs", "rest")), [*LEVELS]).withColumn("at", _order(mix))
    bucket = F.substring("at", 1, BUCKET_DIGITS)
    sums = placed.groupBy(*LEVELS, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("tokens"))
    whole = ends.where("upto <= rest").groupBy(*LEVELS).agg(F.max("bucket").alias("bucket"))
    cross = cut(ends.where("before <= rest and upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("b")).select(*LEVELS, "b.bucket", "b.before"))
    inside = placed.withColumn("bucket", bucket).join(broadcast_if_small(cross), [*LEVELS, "bucket"])
    ranked = inside.groupBy(*LEVELS, "rest", "before", "at").agg(F.sum("tokens").alias("tokens"))
    so_far = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = ranked.withColumn("upto", so_far).where("upto <= rest").groupBy(*LEVELS).agg(F.max("at").alias("in_bucket"))
    # All of a whole bucket is below the first key of the next one.
    plan = budgets.join(whole.withColumnRenamed("bucket", "whole"), [*LEVELS], "left").join(last, [*LEVELS], "left")
    return plan.withColumn("last", F.coalesce("in_bucket", F.concat("whole", F.lit("~")))).drop("in_bucket", "whole")


def _copies(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """rows with times: in how many epochs each is."""
    narrow = plan.select(*(F.col(n).alias(f"_{n}") for n in LEVELS), "epochs", "last")
    names = leaf_columns() if "domain" not in rows.columns else {n: F.col(n) for n in LEVELS}
    on = [names[n] == F.col(f"_{n}") for n in LEVELS]
    return rows.join(broadcast_if_small(narrow), on).withColumn("times", F.col("epochs") + F.coalesce((_order(mix) <= F.col("last")).cast("long"), F.lit(0).cast("long")))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, domain, lang, source, tokens and epoch (from 0) of every selected document, once for each epoch.

    Budgets go down the tree; each leaf gives whole epochs of its documents and, of one more, a prefix of whole documents in
    a seeded order. Null names form leaves of their own. Null and empty texts have no tokens and go wherever the prefix
    holds their place. Rows with equal doc_id in a leaf have one place and go together. Other columns are ignored; an empty
    table gives an empty result.
    """
    counts = cut(token_counts(docs))
    plan = cut(mixture_plan(counts, mix))
    taken = _copies(counts, plan, mix).where("times > 0")
    return taken.select("doc_id", *LEVELS, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))


def mixed_corpus(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of mix_documents with all their columns, once for each epoch that has them."""
    plan = cut(mixture_plan(cut(token_counts(docs)), mix))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "lang", "source")
    taken = _copies(rows, plan, mix).where("times > 0").withColumn("_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return taken.select("_row.*")
