"""Functions of hierarchy nodes, as Column expressions and as SQL functions that Catalyst inlines.

A node is STRUCT<path, dataType, preRank, postRank, isLeaf>; path elements are strings, so one struct type
serves keys of any type. Trailing nulls of a path don't count. A null node gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NODE_TYPE = "STRUCT<path: ARRAY<STRING>, dataType: STRING, preRank: INT, postRank: INT, isLeaf: BOOLEAN>"
#: Metadata key of node columns; the value identifies the hierarchy.
NODE_KEY = "__node"
#: Metadata key of the path elements of all nodes of the hierarchy together; more tasks are planned for many.
CELLS_KEY = "__cells"


def _path(u: str) -> str:
    """The path without trailing nulls: up to its last element that isn't null."""
    return f"IF(try_element_at({u}.path, -1) IS NOT NULL, {u}.path, slice({u}.path, 1, coalesce(array_max(transform({u}.path, (x, i) -> IF(x IS NULL, 0, i + 1))), 0)))"


def _size(u: str) -> str:
    return f"CASE WHEN {u} IS NOT NULL THEN size({_path(u)}) END"


def _starts(u: str, v: str) -> str:
    return f"slice({_path(u)}, 1, size({_path(v)})) = {_path(v)}"


def _parent(u: str, v: str) -> str:
    """u is the parent of v."""
    return f"size({_path(v)}) = size({_path(u)}) + 1 AND {_starts(v, u)}"


def _sibling(u: str, v: str) -> str:
    return (f"size({_path(u)}) > 0 AND size({_path(u)}) = size({_path(v)}) AND slice({_path(u)}, 1, size({_path(u)}) - 1) = slice({_path(v)}, 1, size({_path(v)}) - 1)"
            f" AND try_element_at({_path(u)}, -1) <> try_element_at({_path(v)}, -1)")


def _self(u: str, v: str) -> str:
    return f"{u} <=> {v}"


def _below(u: str, v: str) -> str:
    return f"size({_path(u)}) > size({_path(v)}) AND {_starts(u, v)}"


def _following(u: str, v: str) -> str:
    return f"{u}.preRank > {v}.preRank AND NOT ({_below(u, v)})"


#: name -> (SQL type, body of u)
UNARY = {
    "level": ("INT", _size("u")),
    "pre_rank": ("INT", "u.preRank"),
    "post_rank": ("INT", "u.postRank"),
    "is_root": ("BOOLEAN", f"({_size('u')}) = 1"),
    "is_leaf": ("BOOLEAN", "u.isLeaf"),
    "name": ("STRING", f"CASE WHEN u IS NOT NULL THEN coalesce(try_element_at({_path('u')}, -1), '') END"),
}
#: name -> body of u and v; null if either node is null
BINARY = {
    "is_descendant": _below("u", "v"),
    "is_descendant_or_self": _starts("u", "v"),
    "is_ancestor": _below("v", "u"),
    "is_ancestor_or_self": _starts("v", "u"),
    "is_parent": _parent("u", "v"),
    "is_child": _parent("v", "u"),
    "is_sibling": _sibling("u", "v"),
    "is_self": _self("u", "v"),
    "is_sibling_or_self": f"{_self('u', 'v')} OR ({_sibling('u', 'v')})",
    "is_following": _following("u", "v"),
    "is_preceding": _following("v", "u"),
}


def _body(name: str) -> str:
    return UNARY[name][1] if name in UNARY else f"CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN {BINARY[name]} END"


def register(spark: SparkSession) -> None:
    """Define all node functions as temporary SQL functions of the session."""
    for name, (kind, _) in UNARY.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u {NODE_TYPE}) RETURNS {kind} RETURN {_body(name)}")
    for name in BINARY:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u {NODE_TYPE}, v {NODE_TYPE}) RETURNS BOOLEAN RETURN {_body(name)}")


def call(name: str, *nodes: str | Column) -> Column:
    """The function ``name`` of one or two node columns, without any registration."""
    import re

    args = dict(zip("uv", nodes, strict=False))
    if name not in UNARY and name not in BINARY or len(nodes) != (1 if name in UNARY else 2):
        raise ValueError(f"{name} takes {'one node' if name in UNARY else 'two nodes'}" if name in UNARY or name in BINARY else f"unknown node function {name}")
    if all(isinstance(n, str) for n in nodes):
        return F.expr(re.sub(r"\b([uv])\b(?!')", lambda m: args[m[1]], _body(name)))
    return F.call_function(name, *nodes)


def path(u: str) -> Column:
    """The path without trailing nulls."""
    return F.expr(_path(u))
