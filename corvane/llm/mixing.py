"""Mixing sources to target weights down a domain - language - source tree.

Supplies are summed up the tree, then a token budget is poured down it: at each
node the children share by weight, and what one child cannot supply goes to
its siblings in proportion before the node itself falls short of its parent's
share.  Each level is one closed-form water level over windows of siblings, so
no driver-side loop runs over nodes.  A leaf then takes whole passes over its
documents and a token-prefix of one more pass in an order seeded by epoch.

Where that prefix ends is found digit by digit of the order's key: tokens are
summed by the first two hex digits, then, within the two that hold the end, by the next
two, and so on; rows are ordered only within the last of these.  So no task holds
a leaf, however large, and no text moves: documents are compared with the last
key of their leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, quoted, written

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that the end of a prefix is narrowed down to before rows are ordered: 16 million parts of a leaf.
DIGITS = (2, 4, 6)
#: Up to so many leaves the table of budgets is sent to every task (some 10 MB).
BROADCAST_LEAVES = 50_000
WORD = r"[^\x20\x09-\x0D]+"

#: Which source belongs to which domain: by the number in its name.
DOMAIN = "concat('dom', cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint), 0) % 4 as string))"
WEIGHTS = {"domain": {"dom0": 4.0, "dom1": 3.0, "dom2": 2.0, "dom3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(None).cast("double")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def poured(children: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """Adds ``share`` to rows with ``supply`` and the parent's ``budget``.

    A child is full when the water level reaches supply / weight; the level is
    what remains of the budget over the weights of those that are not full.
    A child of weight 0 or less gets nothing.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = siblings.orderBy("_level").rangeBetween(Window.unboundedPreceding, 0)
    rows = children.withColumn("_w", F.greatest(weight, F.lit(0.0))).withColumn("_level", F.when(F.col("_w") > 0, F.col("supply") / F.col("_w")).otherwise(float("inf")))
    rows = rows.withColumn("_open", F.sum("_w").over(siblings) - F.sum("_w").over(upto)).withColumn("_below", F.sum(F.when(F.col("_w") > 0, F.col("supply")).otherwise(0.0)).over(upto))
    rows = rows.withColumn("_full", (F.col("_w") > 0) & (F.col("_below") + F.when(F.col("_open") > 1e-12, F.col("_level") * F.col("_open")).otherwise(0.0) <= F.col("budget") + 1e-9))
    rest = F.col("budget") - F.sum(F.when(F.col("_full"), F.col("supply")).otherwise(0.0)).over(siblings)
    rows = rows.withColumn("_rest", rest).withColumn("_wide", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(siblings))
    share = F.when(F.col("_full"), F.col("supply")).when(F.col("_wide") > 0, F.least("supply", F.col("_rest") * F.col("_w") / F.col("_wide"))).otherwise(0.0)
    return rows.withColumn("share", F.greatest(share, F.lit(0.0))).drop("_w", "_level", "_open", "_below", "_full", "_rest", "_wide")


def budgets(leaves: DataFrame, share_of_supply: float, max_epochs: float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from the leaves' tokens: whole tokens each."""
    leaves = leaves.withColumn("supply", F.col("tokens") * float(max_epochs))
    total = Window.partitionBy(F.lit(0))
    top = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("_t")).withColumn("budget", F.sum("_t").over(total) * float(share_of_supply)).drop("_t")
    top = poured(top, [], _weight("domain", weights)).select("domain", F.col("share").alias("budget"))
    mid = poured(leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(top, "domain"), ["domain"], _weight("lang", weights)).select("domain", "lang", F.col("share").alias("budget"))
    low = poured(leaves.join(mid, ["domain", "lang"]), ["domain", "lang"], _weight("source", weights))
    return low.select(*LEVELS, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def cutoffs(keyed: DataFrame, leaf: DataFrame) -> DataFrame:
    """(domain, lang, source, _cut): the last key of each leaf's prefix of ``_rest`` tokens; leaves without a prefix have no row.

    ``keyed``: (domain, lang, source, _key, _tokens).  Rows that share a key
    enter together or not at all.
    """
    here = leaf.where("_rest > 0").select(*LEVELS, "_rest", F.lit(0).cast("long").alias("_before"), F.lit("").alias("_prefix"))
    upto = Window.partitionBy(*LEVELS).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    within = lambda: keyed.join(here, [*LEVELS]).where(F.col("_key").startswith(F.col("_prefix")))

    def summed(key: Column) -> DataFrame:
        sums = within().groupBy(*LEVELS, "_rest", "_before", "_prefix", key.alias("_next")).agg(F.sum("_tokens").alias("_sum"))
        return sums.withColumn("_upto", F.col("_before") + F.sum("_sum").over(upto))

    for digits in DIGITS:
        end = summed(F.substring("_key", 1, digits)).where("_upto > _rest and _upto - _sum <= _rest")
        narrower = written(end.select(*LEVELS, "_rest", (F.col("_upto") - F.col("_sum")).alias("_before"), F.col("_next").alias("_prefix")))
        drop(here)
        here = narrower
    last = F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_next")))
    out = written(summed(F.col("_key")).groupBy(*LEVELS, "_prefix").agg(last.alias("_cut")).select(*LEVELS, F.coalesce("_cut", "_prefix").alias("_cut")))
    drop(here)
    return out


def mixed(docs: DataFrame, share_of_supply: float = 0.6, max_epochs: float = 2.0, weights: dict[str, dict[str, float]] | None = None, domain: str = DOMAIN, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """One row per document: the columns of ``carry``, then mix_domain, mix_lang, mix_source, mix_tokens, mix_budget, mix_copies.

    mix_copies: how many times the document is taken (0: left out).  Tokens
    are words between ASCII white space, of whole texts; a null or empty text
    has none.  A null language or source belongs to the node ``unknown``.  The
    order within a leaf is by a seeded hash of doc_id, or of the text where
    that is null; rows that share a doc_id are taken together or not at all.
    A leaf whose budget ends inside a document stops before it.  An empty
    table gives no rows.  Carried columns keep their names, but mix_* ones are
    replaced.
    """
    weights = WEIGHTS if weights is None else weights
    carry = ["doc_id"] if carry is None else [c for c in carry if not c.lower().startswith("mix_")]
    text = F.coalesce(F.col("text"), F.lit(""))
    node = [F.coalesce(F.expr(domain), F.lit("unknown")).alias("domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"), F.coalesce(F.col("source"), F.lit("unknown")).alias("source")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))))
    counted = [*node, name.alias("_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens")]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("_full"), F.col("_id")).cast("binary"))

    small = written(docs.select(F.col("doc_id").alias("_c0"), *counted))
    leaves = written(small.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens")))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    leaf = written(budgets(leaves, share_of_supply, max_epochs, weights).withColumn("_full", full).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens")).drop("tokens"))
    few = leaf.count() <= BROADCAST_LEAVES
    near = lambda df: F.broadcast(df) if few else df
    keyed = small.join(near(leaf.where("_rest > 0").select(*LEVELS, "_full")), [*LEVELS]).select(*LEVELS, key.alias("_key"), "_tokens")
    leaf = leaf.join(cutoffs(keyed, leaf), [*LEVELS], "left").drop("_rest")
    # Only doc_id: what was written says it all; else the documents are read once more.
    rows = small if carry == ["doc_id"] else docs.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)], *counted)
    rows = rows.join(near(leaf), [*LEVELS])
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.col(x).alias(f"mix_{x}") for x in LEVELS],
        F.col("_tokens").alias("mix_tokens"),
        F.col("budget").alias("mix_budget"),
        (F.col("_full") + F.coalesce(key <= F.col("_cut"), F.lit(False)).cast("long")).alias("mix_copies"),
    )
