"""Joins on node predicates as equi joins.

A node predicate between two relations is a theta join that would pair all rows. Each predicate but the rank
comparisons is an equality of paths: children meet parents on the parent's path, siblings on their common one,
descendants meet each of their ancestors on one of the prefixes of their own path. Those plan as hash or
sort-merge joins, for every kind of join, in the Python API and in SQL.

For the prefix predicates the top side's rows get the keys of the deep side's nodes below them, and meet its rows on
these. Those keys come from the deep side's distinct nodes, each with the keys of its path's prefixes, so that rows which
repeat a node are not multiplied by prefixes. A key is the SHA-256 digest of a path, 32 bytes at any depth, and decides
alone: rows carry no paths. A node with many below it, like a root, is dealt to several tasks by salted keys, and
a large hierarchy's keys to more tasks than the session's shuffles have.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import nodes as N
from ..functions.nodes import CELLS_KEY, NODE_KEY
from .tables import tasks

#: predicate -> the same with sides swapped
FLIPPED = {"is_ancestor": "is_descendant", "is_ancestor_or_self": "is_descendant_or_self", "is_child": "is_parent", "is_preceding": "is_following"}
UNFLIPPED = {v: k for k, v in FLIPPED.items()}
RANKS = ("is_following", "is_preceding")
#: Nodes below one node that meet it in one task; above that they are dealt to several.
HEAVY = 100_000
SEMI = {"left_semi": "left_semi", "leftsemi": "left_semi", "semi": "left_semi", "left_anti": "left_anti", "leftanti": "left_anti", "anti": "left_anti"}


def same_hierarchy(left: DataFrame, lnode: str, right: DataFrame, rnode: str) -> None:
    a, b = (df.schema[c].metadata.get(NODE_KEY) for df, c in ((left, lnode), (right, rnode)))
    if a and b and a != b:
        raise AnalysisError("a node predicate mixes different hierarchies")


def path_sql(node: str) -> str:
    """SQL of a node's path without trailing nulls; null for a null node."""
    return f"CASE WHEN {node} IS NOT NULL THEN {N._path(node)} END"


#: SQL of whether a path p needs its elements' lengths, and of the text of one that doesn't.
ODD = "(size(p) = 0 OR contains(array_join(p, '', '\\u0002'), '\\u0001') OR contains(array_join(p, '', '\\u0002'), '\\u0002'))"
JOINED = "array_join(p, '\\u0001')"


def _digest(path: str) -> str:
    """SQL of the key of a path: the digest of a text that no other path has. That is its elements, kept apart by a sign that
    none of them holds; where one does or is null, or there is none, their lengths keep them apart. ``transform`` names the path
    once, as its own SQL is long."""
    lengths = "concat('\\u0002', array_join(transform(p, e -> coalesce(concat(octet_length(e), ':', e), '-')), ''))"
    return f"transform(array({path}), p -> unhex(sha2(CASE WHEN {ODD} THEN {lengths} ELSE {JOINED} END, 256)))[0]"


def digest_sql(node: str) -> str:
    """SQL of the key of a node's path; null for a null node."""
    return _digest(path_sql(node))


def _prefix_digests(path: str, strict: bool) -> str:
    """SQL of the keys of all prefixes of a path, itself included unless ``strict``. Where the path's text holds a sign between
    elements, the beginnings of that text are its prefixes' texts."""
    many = f"sequence(1, size(p) - {int(strict)})"
    text = f"transform(array({JOINED}), t -> transform({many}, n -> unhex(sha2(substring_index(t, '\\u0001', n), 256))))[0]"
    each = f"transform(transform({many}, n -> slice(p, 1, n)), s -> {_digest('s')})"
    keys = f"CASE WHEN {ODD} THEN {each} ELSE {text} END"
    return f"if(size({path}) > {int(strict)}, transform(array({path}), p -> {keys})[0], array())"


def dealt(df: DataFrame, node: str) -> int | None:
    """Tasks for the keys of prefixes of ``df``'s nodes; None where the session's shuffles have enough. The hierarchy's path elements
    are known since it was made, and its distinct nodes have no more prefixes."""
    n = tasks(df.sparkSession, df.schema[node].metadata.get(CELLS_KEY))
    return n if n > tasks(df.sparkSession, None) else None


def in_tasks(rows: str, key: str, n: int | None) -> str:
    """SQL of ``rows``, dealt to ``n`` tasks by ``key``, if given. For inner joins: others keep rows without a key, which would meet in one."""
    return f"(SELECT /*+ REPARTITION({n}, `{key}`) */ * FROM {rows})" if n else rows


def _halves(top: str, tn: str, deep: str, dn: str, strict: bool, n: int | None, columns: str = "*") -> tuple[str, str]:
    """SQL of the rows of ``top`` with their key (__own), and of the distinct nodes of ``deep`` (__deep) with the keys of those
    above them (__of), both with a salt. Ranks tell only how many salts a key gets, which are looked up for both sides in one
    table of a row for each ``HEAVY`` nodes of a level; it is broadcast. Both meet in ``n`` tasks, if given."""
    hint = lambda key: f"/*+ BROADCAST(__w){f', REPARTITION({n}, {key}, __salt)' if n else ''} */"
    below = f"{tn}.postRank - {tn}.preRank + size({path_sql(tn)}) - 1"
    heavy = f"(SELECT __own AS __h, cast(ceil(max(__n) / {HEAVY}) AS int) AS __s FROM (SELECT {digest_sql(tn)} AS __own, {below} AS __n FROM {top}) WHERE __n > {HEAVY} GROUP BY __own)"
    tops = f"(SELECT {columns}, {digest_sql(tn)} AS __own FROM {top})" if columns else f"(SELECT DISTINCT {digest_sql(tn)} AS __own FROM {top})"
    tops = f"(SELECT {hint('__own')} __r.*, explode(sequence(0, coalesce(__w.__s, 1) - 1)) AS __salt FROM {tops} AS __r LEFT JOIN {heavy} AS __w ON __r.__own = __w.__h)"
    nodes = f"(SELECT __path, {_digest('__path')} AS __deep FROM (SELECT DISTINCT {path_sql(dn)} AS __path FROM {deep}))"
    up = f"(SELECT __deep, __of FROM {nodes} LATERAL VIEW explode({_prefix_digests('__path', strict)}) __e AS __of)"
    return tops, f"(SELECT {hint('__of')} __u.__deep, __u.__of, cast(pmod(xxhash64(__u.__deep), coalesce(__w.__s, 1)) AS int) AS __salt FROM {up} AS __u LEFT JOIN {heavy} AS __w ON __u.__of = __w.__h)"


def prefix_pairs_sql(top: str, tn: str, deep: str, dn: str, strict: bool, n: int | None = None) -> str:
    """SQL of the distinct pairs (__deep, __of) of the keys of a node of ``deep`` and of one of ``top`` above it, found in ``n`` tasks."""
    tops, up = _halves(top, tn, deep, dn, strict, n, "")
    return f"(SELECT __d.__deep, __d.__of FROM {up} AS __d JOIN {tops} AS __t ON __t.__own = __d.__of AND __t.__salt = __d.__salt)"


def with_deep_sql(top: str, tn: str, deep: str, dn: str, strict: bool, key: str, n: int | None, alone: bool = False) -> str:
    """SQL of the rows of ``top``, each once for every node of ``deep`` below it with that node's ``digest_sql`` as ``key``;
    ``alone``: those with none once, with a null."""
    if alone:
        pairs = prefix_pairs_sql(top, tn, deep, dn, strict, n)
        return f"(SELECT __t.* EXCEPT (__own), __d.__deep AS `{key}` FROM (SELECT *, {digest_sql(tn)} AS __own FROM {top}) AS __t LEFT JOIN {pairs} AS __d ON __t.__own = __d.__of)"
    tops, up = _halves(top, tn, deep, dn, strict, n)
    return f"(SELECT __t.* EXCEPT (__own, __salt), __d.__deep AS `{key}` FROM {tops} AS __t JOIN {up} AS __d ON __t.__own = __d.__of AND __t.__salt = __d.__salt)"


def any_pairs_sql(predicates: list[tuple[str, bool]], left: str, ln: str, right: str, rn: str, n: int | None = None) -> str:
    """SQL of distinct pairs (__l, __r) of the keys of nodes of ``left`` and ``right``, all among them that meet one of ``predicates``:
    (name, whether its first node is the left one)."""
    parts = []
    for name, straight in predicates:
        (a, an), (b, bn) = ((left, ln), (right, rn)) if straight else ((right, rn), (left, ln))
        first, second = ("__l", "__r") if straight else ("__r", "__l")
        if keys := keys_sql(name, "__x", "__y"):
            x, y = (f"(SELECT DISTINCT named_struct('path', {path_sql(n)}) AS {as_} FROM {rel})" for rel, n, as_ in ((a, an, "__x"), (b, bn, "__y")))
            pairs = f"(SELECT {digest_sql('__x')} AS {first}, {digest_sql('__y')} AS {second} FROM {x} JOIN {y} ON {keys[0]} = {keys[1]})"
        else:
            (top, tn), (deep, dn) = ((b, bn), (a, an)) if deep_first(name) else ((a, an), (b, bn))
            up, down = (second, first) if deep_first(name) else (first, second)
            pairs = f"(SELECT __of AS {up}, __deep AS {down} FROM {prefix_pairs_sql(top, tn, deep, dn, strict(name), n)})"
        parts.append(f"SELECT __l, __r FROM {pairs}")
    return f"(SELECT DISTINCT __l, __r FROM ({' UNION ALL '.join(parts)}))"


def keys_sql(predicate: str, u: str, v: str) -> tuple[str, str] | None:
    """SQL of two keys, of u and of v, that are equal wherever ``predicate(u, v)`` holds; None for those that need
    prefixes or have no key."""
    up = lambda x: f"slice({path_sql(x)}, 1, greatest(size({path_sql(x)}), 1) - 1)"
    if predicate == "is_self":
        return path_sql(u), path_sql(v)
    if predicate in ("is_sibling", "is_sibling_or_self"):
        return up(u), up(v)
    if predicate == "is_parent":
        return path_sql(u), up(v)
    return (up(u), path_sql(v)) if predicate == "is_child" else None


def deep_first(predicate: str) -> bool | None:
    """Whether the first node of a prefix predicate is the deep one; None for other predicates."""
    return {"is_descendant": True, "is_descendant_or_self": True, "is_ancestor": False, "is_ancestor_or_self": False}.get(predicate)


def strict(predicate: str) -> bool:
    """Whether a prefix predicate leaves out the node itself."""
    return not predicate.endswith("_or_self")


def predicate_sql(predicate: str, u: str, v: str) -> str:
    args = {"u": u, "v": v}
    return re.sub(r"\b([uv])\b", lambda m: args[m[1]], N._body(predicate))


def node_join(left: DataFrame, lnode: str, right: DataFrame, rnode: str, predicate: str, how: str = "inner") -> DataFrame:
    """Join on predicate(left.lnode, right.rnode). Column names of both sides must differ. ``how``: inner, left,
    right, full, left_semi, left_anti. Rows that repeat stay as often as in any join."""
    predicate, how = predicate.lower(), how.lower().removesuffix("_outer").removesuffix("outer") or "full"
    how = SEMI.get(how, how)
    if predicate not in N.BINARY:
        raise AnalysisError(f"unknown node predicate {predicate}")
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise AnalysisError(f"unknown kind of join {how}")
    if clash := set(left.columns) & set(right.columns):
        raise AnalysisError(f"columns on both sides: {sorted(clash)}")
    same_hierarchy(left, lnode, right, rnode)
    u, v = f"`{lnode}`", f"`{rnode}`"
    exact = F.expr(predicate_sql(predicate, u, v))
    if predicate in RANKS:
        # a rank comparison pairs most rows with most others; there is no key to meet on
        return left.join(right, exact, how)
    if keys := keys_sql(predicate, u, v):
        return left.withColumn("_lk", F.expr(keys[0])).join(right.withColumn("_rk", F.expr(keys[1])), (F.col("_lk") == F.col("_rk")) & exact, how).drop("_lk", "_rk")
    if how == "right":
        other = FLIPPED.get(predicate) or UNFLIPPED[predicate]
        return node_join(right, rnode, left, lnode, other, "left").select(*_quoted(left), *_quoted(right))
    if how == "full":
        other = FLIPPED.get(predicate) or UNFLIPPED[predicate]
        alone = node_join(right, rnode, left, lnode, other, "left_anti")
        return node_join(left, lnode, right, rnode, predicate, "left").unionByName(alone, allowMissingColumns=True)
    below = deep_first(predicate)
    (top, tn), (deep, dn) = ((right, v), (left, u)) if below else ((left, u), (right, v))
    n = dealt(deep, lnode if below else rnode)
    if not below and how in ("left_semi", "left_anti"):
        pairs = _sql(prefix_pairs_sql("{top}", tn, "{deep}", dn, strict(predicate), n), top, deep)
        return left.withColumn("_lk", F.expr(digest_sql(u))).join(pairs, F.col("_lk") == F.col("__of"), how).drop("_lk")
    top = _sql(with_deep_sql("{top}", tn, "{deep}", dn, strict(predicate), "_tk", n, alone=not below and how == "left"), top, deep)
    deep = deep.withColumn("_dk", F.expr(digest_sql(dn)))
    if n and how == "inner":
        top, deep = top.repartition(n, "_tk"), deep.repartition(n, "_dk")
    l, r = (deep, top) if below else (top, deep)
    return l.join(r, F.col("_tk") == F.col("_dk"), how).drop("_tk", "_dk")


def _sql(text: str, top: DataFrame, deep: DataFrame) -> DataFrame:
    return top.sparkSession.sql(f"SELECT * FROM {text}", top=top, deep=deep)


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def rank_counts(df: DataFrame, node: str = "node") -> DataFrame:
    """``df`` with n_following and n_preceding: how many nodes of its tree stand after a node in pre-order but not
    below it, and before it but not above it. That is what joins on is_following and is_preceding would count,
    taken from the ranks: a row per node instead of a row per pair. Rows that repeat a node count once."""
    root, level = F.col(node)["path"][0], F.expr(f"size({N._path(f'`{node}`')})")
    totals = df.where(F.col(node).isNotNull()).groupBy(root.alias("_root")).agg(F.max(F.col(node)["preRank"]).alias("_last"))
    pre, post = F.col(node)["preRank"], F.col(node)["postRank"]
    out = df.withColumn("_own_root", root).join(totals, F.col("_own_root") == F.col("_root"), "left")
    # below a node stand post - pre + level - 1 others, above it level - 1
    return out.withColumn("n_following", F.col("_last") - post - level + 1).withColumn("n_preceding", pre - level).drop("_own_root", "_root", "_last")
