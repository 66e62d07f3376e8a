"""Hierarchies: a node column for the rows of an adjacency list or of level columns.

Paths are found by pointer doubling: a round joins the rows still unresolved with the ancestor they point to,
twice, and so quadruples the distance; a tree of depth d takes about log4(d) rounds. A round that resolves
nothing shows that what is left hangs on a cycle or on nothing; those rows drop out, as cycles are cut.

Ranks follow from two orders of the same paths of sibling numbers: depth-first order compares the paths,
and post-order compares them with a last element above all siblings. Trees and families of many nodes are
numbered by a range shuffle with offsets per range, which gets more ranges the more there is, small ones by a window.

A node carries its path, as its functions demand, so that a hierarchy takes (nodes x mean depth) path elements on
disk: fine for the trees of organisations, parts or threads at any width, but a chain of n nodes takes n^2 / 2.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from ..errors import AnalysisError
from ..functions.nodes import CELLS_KEY, NODE_KEY
from .tables import dropped, tasks, written

#: Trees and families up to this many nodes are numbered by a window, larger ones by ranges.
WINDOW_NODES = 200_000
#: Sources of at most this size by the planner's estimate are not counted: they hold no family worth it.
SMALL_BYTES = 8 << 20
#: Path elements (all rows together) up to which the ancestors' side of a round is broadcast, some 20 MB.
BROADCAST_CELLS = 1_000_000
Order = Sequence[str | Column]


def _asc(order: Order) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def _tag(*parts: object) -> dict:
    return {NODE_KEY: md5(repr(parts).encode()).hexdigest()}


def _key_type(t: DataType) -> str:
    name = t.simpleString()
    if name not in ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "timestamp", "date") and not name.startswith(("varchar", "char")):
        raise AnalysisError(f"{name} can't be a key of a hierarchy")
    return t.json()


def _text(c: Column, t: DataType) -> Column:
    """A key as path element; timestamps as microseconds."""
    return F.unix_micros(c).cast("string") if t.simpleString() == "timestamp" else c.cast("string")


def numbered(rows: DataFrame, group: str, order: list[Column], name: str, largest: int, window_nodes: int = WINDOW_NODES, cells: int | None = None) -> DataFrame:
    """``rows`` with their numbers from 1 in each ``group`` by ``order`` (which has no ties) as ``name``. ``largest``:
    a bound of the largest group's rows; ``cells``: the path elements of all rows, where they are known."""
    if largest <= window_nodes:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    n = max(2, tasks(rows.sparkSession, cells))
    # a range is sorted where it lands, and its rows' ids there follow each other; to meet the offsets they need no order
    dealt = rows.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_of"), F.col("_range").alias("_in"), (before - F.col("_first") + 1).alias("_before"))
    near = (F.col(group) == F.col("_of")) & (F.col("_range") == F.col("_in"))
    return dealt.join(counts, near).withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_at", "_before", "_range", "_of", "_in")


def _largest(rows: DataFrame, group: str) -> int:
    """Rows of the largest group; 0 where the planner's estimate shows that none can matter."""
    if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES:
        return 0
    return rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0


def ranked(nodes: DataFrame, window_nodes: int = WINDOW_NODES, total: int | None = None, cells: int | None = None) -> DataFrame:
    """nodes: (id, root, path, opath). Adds preRank, postRank, isLeaf; ranks start at 1 in every tree.
    ``total``, ``cells``: the number of nodes and of their path elements, where it is known already."""
    nodes = nodes.withColumn("_post", F.concat("opath", F.array(F.lit(2**31 - 1))))
    largest = total if total is not None and total <= window_nodes else nodes.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    for c, rank in (("opath", "preRank"), ("_post", "postRank")):
        nodes = numbered(nodes, "root", [F.col(c).asc()], rank, largest, window_nodes, cells)
    below = F.col("postRank") - F.col("preRank") + F.size("path") - 1
    return nodes.withColumn("isLeaf", below == 0).drop("_post")


def _node(nodes: DataFrame, kind: str, alias: str, tag: dict) -> Column:
    return F.struct(F.col("path"), F.lit(kind).alias("dataType"), F.col("preRank").cast("int").alias("preRank"), F.col("postRank").cast("int").alias("postRank"), F.col("isLeaf")).alias(alias, metadata=tag)


def adjacency_nodes(df: DataFrame, pred: str, succ: str, start: str | Column | None = None, order: Order = (), strict: bool = False, window_nodes: int = WINDOW_NODES) -> DataFrame:
    """One row per reachable key: (id, root, path, opath, preRank, postRank, isLeaf)."""
    start = F.expr(start) if isinstance(start, str) else start
    kt = df.schema[succ].dataType
    _key_type(kt)
    is_start = F.coalesce(start, F.lit(False)) if start is not None else F.col(pred).isNull()
    rows = df.withColumn("_start", is_start).withColumn("_id", F.col(succ)).withColumn("_up", F.col(pred).cast(kt)).where("_id is not null")
    if start is None:
        known = rows.select(F.col("_id").alias("_up")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "_up", "left").withColumn("_start", F.col("_start") | F.col("_known").isNull()).drop("_known")
    else:
        rows = rows.where(F.col("_start") | F.col("_up").isNotNull())
    first = Window.partitionBy("_id").orderBy(F.desc("_start"), *_asc(order), F.col("_up"))
    rows = rows.withColumn("_r", F.row_number().over(first))
    if strict and not rows.where(F.col("_r") > 1).isEmpty():
        raise AnalysisError("a key has several rows")
    rows = rows.where(F.col("_r") == 1)
    rows = rows.withColumn("_up", F.when(~F.col("_start"), F.col("_up")))
    below = rows.where("_up is not null")
    # roots need no order among themselves: ranks start anew in each tree
    rows = numbered(below, "_up", [*_asc(order), F.col("_id").asc()], "_sib", _largest(below, "_up"), window_nodes).unionByName(rows.where("_up is null").withColumn("_sib", F.lit(0)))
    # no root reaches a row that is its own parent
    rows = rows.where("_up is null or _up <> _id")
    state = written(rows.select(F.col("_id").alias("id"), F.col("_up").alias("up"), F.array(_text(F.col("_id"), kt)).alias("path"), F.array(F.col("_sib").cast("int")).alias("opath")))
    found = 0
    while True:
        n = state.agg(F.count(F.when(F.col("up").isNull(), 1)).alias("found"), F.count("up").alias("todo"), F.sum(F.size("path")).alias("cells")).first()
        if not n.todo or n.found == found:
            break
        found = n.found
        small = n.cells <= BROADCAST_CELLS
        before, state = state, written(_doubled(_doubled(state, small), small))
        dropped(before)
    out = ranked(state.where("up is null").select("id", F.col("path")[0].alias("root"), "path", "opath"), window_nodes, n.found, n.cells)
    out._arbordf_cells = n.cells or 0
    return out


def _doubled(state: DataFrame, small: bool) -> DataFrame:
    """Every row that still points to an ancestor takes over the ancestor's path and pointer; rows whose
    ancestor doesn't exist drop out. ``small``: the table was found small enough to broadcast."""
    anc = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("p"), F.col("opath").alias("o"))
    near = state.where("up is not null").join(F.broadcast(anc) if small else anc, "up").select("id", F.col("up2").alias("up"), F.concat("p", "path").alias("path"), F.concat("o", "opath").alias("opath"))
    return state.where("up is null").unionByName(near)


def hierarchy(df: DataFrame, pred: str, succ: str, start: str | Column | None = None, order: Order = (), node: str = "node", strict: bool = False) -> DataFrame:
    """The rows of ``df`` that a root reaches, with a node column. ``pred`` is a row's parent key, ``succ`` its
    own. Roots: rows that match ``start``, or else those whose parent key no row has. ``order`` sorts
    siblings. Of rows that repeat a key the first by ``order`` and parent key makes the node (``strict``
    raises), and all of them get it."""
    nodes = adjacency_nodes(df, pred, succ, start, order, strict)
    # what makes two hierarchies the same is how they are made, not of what
    tag = _tag("adjacency", pred, succ, str(start), [str(o) for o in order]) | {CELLS_KEY: nodes._arbordf_cells}
    kind = _key_type(df.schema[succ].dataType)
    nodes = nodes.select(F.col("id").alias("_node_id"), _node(nodes, kind, node, tag))
    out = df.join(nodes, df[succ] == nodes["_node_id"]).drop("_node_id")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(node).alias(node, metadata=tag))


def level_hierarchy(df: DataFrame, levels: Sequence[str], order: Order = (), start: str | Column | None = None, node: str = "node", match: str = "PATH", window_nodes: int = WINDOW_NODES) -> DataFrame:
    """The rows of ``df`` with a node for the path of their level columns, and one generated row for each inner
    node that no row has (other columns null). Rows without any level drop out; a null between levels
    raises when rows are read. ``start`` keeps the trees of the rows that match it."""
    if match.upper() != "PATH":
        raise AnalysisError(f"MATCH {match} is not supported")
    types = {df.schema[c].dataType.simpleString() for c in levels}
    if len(types) != 1:
        raise AnalysisError(f"level columns differ in type: {sorted(types)}")
    kt = df.schema[levels[0]].dataType
    kind = _key_type(kt)
    start = F.expr(start) if isinstance(start, str) else start
    full = F.array(*[_text(F.col(c), kt) for c in levels])
    depth = F.expr(f"size(filter(array({', '.join(f'`{c}`' for c in levels)}), x -> x is not null))")
    hole = F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)).otherwise(F.lit(0)) for i, c in enumerate(levels)], F.lit(0)) != depth
    rows = df.withColumn("_full", full).withColumn("_depth", F.when(hole, F.raise_error(F.lit("a level is null above one that isn't"))).otherwise(depth)).where("_depth > 0")
    rows = rows.withColumn("_path", F.expr("slice(_full, 1, _depth)"))
    if start is not None:
        roots = rows.where(start).select(F.col("_path")[0].alias("_root")).distinct()
        rows = rows.join(roots, rows["_path"][0] == roots["_root"], "left_semi")
    keys = _asc(order)
    names = [f"_o{i}" for i in range(len(keys))]
    pre = rows.select(*[k_expr.alias(n) for k_expr, n in zip((_plain(k) for k in order), names, strict=True)], F.explode(F.expr("transform(sequence(1, _depth), n -> slice(_path, 1, n))")).alias("path"))
    directed = [_directed(k, n) for k, n in zip(order, names, strict=True)]
    if names:
        pre = pre.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(*directed))).where("_r = 1").drop("_r")
    else:
        pre = pre.distinct()
    pre = pre.withColumn("n", F.size("path")).withColumn("parent", F.expr("slice(path, 1, n - 1)"))
    below = pre.where("n > 1")
    # first-level nodes are roots: they need no order among themselves
    pre = numbered(below, "parent", [*directed, F.expr("path[n - 1]").asc()], "sib", _largest(below, "parent"), window_nodes).unionByName(pre.where("n = 1").withColumn("sib", F.lit(0)))
    pre = written(pre.select("path", "parent", "n", F.col("sib").cast("int").alias("sib")))
    cells = pre.agg(F.sum("n")).first()[0] or 0
    at = pre.where("n = 1").select("path", F.array("sib").alias("opath"))
    nodes = at
    for i in range(2, len(levels) + 1):
        at = pre.where(F.col("n") == i).join(at.toDF("parent", "o"), "parent").select("path", F.concat("o", F.array("sib")).alias("opath"))
        nodes = nodes.unionByName(at)
    nodes = ranked(nodes.select(F.col("path").alias("id"), F.col("path")[0].alias("root"), "path", "opath"), window_nodes, cells=cells)
    tag = _tag("levels", list(levels), [str(o) for o in order], str(start)) | {CELLS_KEY: cells}
    pad = F.concat("path", F.expr(f"array_repeat(cast(null as string), {len(levels)} - size(path))"))
    nodes = nodes.select(F.col("id"), F.struct(pad.alias("path"), F.lit(kind).alias("dataType"), F.col("preRank").cast("int").alias("preRank"), F.col("postRank").cast("int").alias("postRank"), "isLeaf").alias("_node"))
    out = nodes.join(rows.withColumnRenamed("_path", "id"), "id", "left")
    cols = []
    for c in df.columns:
        i = levels.index(c) if c in levels else -1
        cols.append(F.coalesce(F.col(f"`{c}`"), _back(F.expr(f"try_element_at(id, {i + 1})"), kt)).alias(c) if i >= 0 else F.col(f"`{c}`"))
    return out.select(*cols, F.col("_node").alias(node, metadata=tag))


def _back(c: Column, t: DataType) -> Column:
    return F.timestamp_micros(c.cast("bigint")) if t.simpleString() == "timestamp" else c.cast(t)


def _plain(o: str | Column) -> Column:
    """An order expression without its direction."""
    if isinstance(o, str):
        return F.col(o)
    text = str(o._jc.toString()) if hasattr(o, "_jc") else str(o)
    for end in (" ASC NULLS FIRST", " ASC NULLS LAST", " DESC NULLS FIRST", " DESC NULLS LAST", " ASC", " DESC"):
        text = text.removesuffix(end)
    return F.expr(text)


def _directed(o: str | Column, name: str) -> Column:
    text = "" if isinstance(o, str) else str(o._jc.toString())
    return F.desc(name) if " DESC" in text else F.asc(name)
