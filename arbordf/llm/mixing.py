"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated down a domain - language - source tree. At every node it is shared among the
children by weight; a child that can't supply its share (its documents' tokens times the permitted epochs)
gives what it has, and its shortage goes to its siblings by weight. Since a node's capacity is the sum of its
leaves', only what a whole family can't supply passes to the family's own siblings, one level up.

Each leaf then supplies whole seeded epochs and, of its last epoch, the longest prefix in that epoch's
seeded order whose tokens fit. All arithmetic is in integers. The end of a prefix is closed in on by slices of
hash order: sums per leaf and slice show the slice where it ends, which is sliced again until it holds at most
EDGE_ROWS rows, however large the leaf. Only sums are shuffled, and the rows of those last slices, which
are ordered. Siblings in the tree are ordered in one task per family, a row of a few numbers for each source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, n_words

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order hash that a round of slicing adds.
SLICE = 2
#: Rows that are ordered in one task at most, but for rows alike in id, tokens and text.
EDGE_ROWS = 10_000
#: Digits of the order hash: 32 by seed, epoch and id, then the token count, then a hash of the text.
DIGITS = 64


def weight_of(weights: Mapping[str, int], c: str) -> Column:
    """The weight of a node by its name at its level; 1 where none is given, 0 leaves the node out."""
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(F.col(c) == k, F.lit(int(v))).otherwise(out)
    return out.cast("long")


def shared(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Give every row of ``children`` (w, cap and its parent's budget) its part of the budget as ``part``:
    min(cap, w * level) with the level at which the parts add up to the budget, or cap where caps don't."""
    wide = lambda c: c.cast("decimal(20,0)")
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), child)
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.where("w > 0").withColumn("caps_before", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("w_rest", F.sum("w").over(after))
    full = wide(F.col("cap")) * F.col("w_rest").cast("decimal(17,0)") <= wide(F.col("budget") - F.col("caps_before")) * F.col("w").cast("decimal(17,0)")
    rows = rows.withColumn("full", full)
    whole = Window.partitionBy(*parents)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    run = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("w_run", run)
    step = lambda w: f"bigint((cast(left as decimal(20,0)) * cast({w} as decimal(17,0))) div w_left)"
    part = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr(f"{step('w_run')} - {step('w_run - w')}")))
    return rows.withColumn("part", part.cast("long")).drop("caps_before", "w_rest", "full", "left", "w_left", "w_run")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], total: int | Column, max_epochs: int) -> DataFrame:
    """leaves: (domain, lang, source, tokens). Adds ``target``, the tokens to take from each leaf."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("w", weight_of(weights.get("source", {}), "source"))
    langs = leaves.where("w > 0").groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(weights.get("lang", {}), "lang"))
    domains = langs.where("w > 0").groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(weights.get("domain", {}), "domain"))
    domains = shared(domains.withColumn("root", F.lit(0)).withColumn("budget", F.lit(total).cast("long") if isinstance(total, int) else total), ["root"], "domain")
    langs = shared(langs.join(domains.select("domain", F.col("part").alias("budget")), "domain"), ["domain"], "lang")
    out = shared(leaves.join(langs.select("domain", "lang", F.col("part").alias("budget")), ["domain", "lang"]), ["domain", "lang"], "source")
    return out.select(*LEVELS, "tokens", F.col("part").alias("target"))


def mixed(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int] = (6, 10), max_epochs: int = 2, seed: int = 1, tokens: Column | None = None, small: int = 100_000, edge_rows: int = EDGE_ROWS, own_only: bool = False) -> DataFrame:
    """Select rows of ``docs`` (doc_id, text, lang, source and any others) for a budget of share[0] / share[1]
    of all tokens. Adds mix_domain, n_tokens and epoch (from 0); a row that several epochs have comes out
    once for each. ``tokens`` is a row's token count (default: words).

    Null domains, languages and sources are nodes named "". Rows without tokens cost nothing and come
    with every epoch that reaches them. Rows that repeat a doc_id are taken as separate rows. Of columns named mix_domain,
    n_tokens and epoch in ``docs`` the new ones win; with ``own_only`` the columns of ``docs`` come out and no
    others. An empty table gives no rows."""
    ws = Workspace(docs.sparkSession, "mixing")
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # the row itself travels as one column, so that no name of it clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.col("doc_id").alias("mix_id"), text_of(domain).alias("mix_domain"), text_of(F.col("lang")).alias("mix_lang"), text_of(F.col("source")).alias("mix_source"), (n_words() if tokens is None else tokens).cast("long").alias("n_tokens"), F.xxhash64(F.col("text").cast("string")).alias("mix_tie"))
    keys = [f"mix_{k}" for k in LEVELS]
    thin = ws.written(rows.select("mix_id", *keys, "n_tokens", "mix_tie"), "thin")
    leaves = ws.written(thin.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).toDF(*LEVELS, "tokens"), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    goals = budgets(leaves, weights, total * share[0] // share[1], max_epochs).where("tokens > 0").withColumn("whole", F.expr("target div tokens")).withColumn("rest", F.expr("target % tokens"))
    goals = goals.toDF(*keys, "tokens", "target", "whole", "rest").select(*keys, "whole", "rest", F.lit("").alias("mix_cut"), F.lit(0).cast("long").alias("mix_before"))
    goals = ws.written(goals, "goals")
    few = goals.count() <= small
    by_id = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), text_of(F.col("mix_id"))))
    whole_order = F.concat(by_id, *[F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("n_tokens", "mix_tie")])

    def at(df: DataFrame, goals: DataFrame, digits: int) -> DataFrame:
        """Rows with their leaf's goal and the first ``digits`` of their order; texts aren't read for those of the id."""
        out = df.join(F.broadcast(goals) if few else goals, keys)
        return out.withColumn("mix_hash", by_id if digits <= 32 else whole_order).withColumn("mix_head", F.expr("left(mix_hash, length(mix_cut))"))

    narrow = goals  # those whose slice is still to be cut
    for digits in range(SLICE, DIGITS + 1, SLICE):
        slices = at(thin, narrow, digits).where("mix_head = mix_cut").groupBy(*keys, "whole", "rest", "mix_before", F.substring("mix_hash", 1, digits).alias("mix_slice")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        run = Window.partitionBy(*keys).orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, 0)
        cut = slices.withColumn("upto", F.sum("n").over(run) + F.col("mix_before")).where("upto > rest").groupBy(*keys, "whole", "rest").agg(F.min(F.struct("mix_slice", (F.col("upto") - F.col("n")).alias("before"), "rows")).alias("c"))
        cut = ws.written(cut.select(*keys, "whole", "rest", F.col("c.mix_slice").alias("mix_cut"), F.col("c.before").alias("mix_before"), "c.rows"), "cuts")
        goals = goals.join(F.broadcast(cut.select(*keys)) if few else cut.select(*keys), keys, "left_anti").unionByName(cut.drop("rows"))
        narrow = cut.where(F.col("rows") > edge_rows).drop("rows")
        if narrow.isEmpty():
            break
    goals = ws.written(goals, "cut")
    ws.drop(thin)

    full = at(rows, goals, digits)
    sure = full.where("mix_head <> mix_cut").withColumn("copies", F.col("whole") + F.when(F.col("mix_head") < F.col("mix_cut"), 1).otherwise(0))
    inside = Window.partitionBy(*keys).orderBy("mix_hash", "mix_id", "n_tokens", "mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = full.where("mix_head = mix_cut").withColumn("upto", F.sum("n_tokens").over(inside) + F.col("mix_before"))
    edge = edge.withColumn("copies", F.col("whole") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).drop("upto")
    out = sure.unionByName(edge).where("copies > 0")
    out = out.withColumn("mix_epoch", F.explode(F.expr("sequence(0, int(copies) - 1)")))
    own = [F.col("mix_row").getField(c).alias(c) for c in docs.columns if own_only or c not in ("mix_domain", "n_tokens", "epoch")]
    return out.select(*own) if own_only else out.select(*own, "mix_domain", "n_tokens", F.col("mix_epoch").alias("epoch"))
