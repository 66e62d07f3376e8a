"""Registered queries of the engine's own operators and their SQL in DuckDB's dialect.

All run over whole tables. SQL that both engines read alike is given once, in SAME.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_queries as catalog
from .functions import nodes as N
from .functions.stats import spearman
from .operators.currency import convert
from .operators.hierarchy import hierarchy, level_hierarchy
from .operators.node_joins import node_join
from .plans.partial_aggregation import Aggregate, final, partial
from .session import AnalyticsSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
HEAP = "HIERARCHY (USING (SELECT p_partkey AS succ, p_partkey div 2 AS pred, p_retailprice, p_brand FROM part) AS v JOIN PRIOR u ON v.pred = u.succ {tail} SET node) AS H"
BY_PRICE = "ORDER SIBLINGS BY p_retailprice DESC, succ"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str, *sql: str) -> AnalyticsSession:
    """A session of the dialect that knows the base tables that ``sql`` names, in the directory asked for; Spark's own
    views of these names stay as they are."""
    s = AnalyticsSession(spark)
    for name in TABLES:
        if any(name in text for text in sql):
            s.register(name, t(spark, sf_dir, name))
    return s


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("succ"), F.expr("p_partkey div 2").alias("pred"), "p_retailprice", "p_brand")


def heap(spark: SparkSession, sf_dir: str, start: str = "succ = 1", node: str = "node") -> DataFrame:
    return hierarchy(parts(spark, sf_dir), "pred", "succ", start, [F.desc("p_retailprice"), F.col("succ")], node)


def geo(spark: SparkSession, sf_dir: str, node: str = "node") -> DataFrame:
    """Regions and nations as a level hierarchy."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    return level_hierarchy(n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name"), ["r_name", "n_name"], ["n_name"], node=node)


# --- hierarchies ------------------------------------------------------------------------------------

DIALECT: dict[str, str] = {
    "h1_ranks": f"SELECT succ, level(node) AS lvl, pre_rank(node) AS pre, post_rank(node) AS post, is_leaf(node) AS leaf FROM {HEAP.format(tail=BY_PRICE + ' START WHERE succ = 1')}",
    "h1_forest_restart": f"SELECT succ, level(node) AS lvl, pre_rank(node) AS pre, post_rank(node) AS post FROM {HEAP.format(tail=BY_PRICE + ' START WHERE succ IN (2, 3)')}",
    "h1_unreachable_dropped": f"SELECT succ, level(node) AS lvl FROM {HEAP.format(tail='START WHERE succ = 2')}",
    "h1_default_roots": "SELECT succ, level(node) AS lvl, is_root(node) AS root FROM HIERARCHY (USING (SELECT p_partkey AS succ, CASE WHEN p_partkey >= 4 THEN p_partkey div 2 END AS pred FROM part) AS v JOIN PRIOR u ON v.pred = u.succ SET node) AS H",
    "h1_cycle_cut": "SELECT k, level(node) AS lvl FROM HIERARCHY (USING (SELECT * FROM VALUES (1L, 3L), (2L, 1L), (3L, 2L), (4L, 2L), (8L, 9L), (9L, 8L) AS e(k, p)) AS v JOIN PRIOR u ON v.p = u.k ORDER SIBLINGS BY k START WHERE k = 1 SET node) AS H",
    "h3_sibling_keys": f"SELECT succ, pre_rank(node) AS pre FROM {HEAP.format(tail='ORDER SIBLINGS BY p_brand, p_retailprice DESC, succ START WHERE succ = 1')}",
    "n4_n6_root_name": f"SELECT succ, is_root(node) AS root, name(node) AS label FROM {HEAP.format(tail='START WHERE succ = 1')}",
    "f1_f12_scalars": "SELECT o_orderkey, remainder(o_orderkey, 7) AS rem, add_days(to_date(o_orderdate), 3) AS d3, add_years(to_date(o_orderdate), 1) AS y1, days_between(to_date(o_orderdate), DATE '1998-01-01') AS gap, to_integer(o_totalprice) AS whole, to_varchar(o_orderkey) AS text, replace(o_orderpriority, '-', NULL) AS prio, round(ln(o_totalprice), 6) AS l FROM orders",
    "f4_add_seconds": "SELECT event_id, add_seconds(ts, 90) AS later FROM events",
    "f13_extract": "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events",
    "a4_distinct_star": "SELECT count(DISTINCT *) AS n FROM (SELECT c_nationkey, c_mktsegment FROM customer) AS q",
    "a6_approx": "SELECT event_type, count(DISTINCT user_id) AS users, abs(APPROXIMATE(0.02) COUNT(DISTINCT user_id) - count(DISTINCT user_id)) <= 0.08 * count(DISTINCT user_id) AS close, abs(APPROXIMATE COUNT(DISTINCT user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type",
}

#: The heap in DuckDB: edges e with sibling numbers s, and all nodes reached from the roots.
TREE = """WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 2 AS p, p_retailprice AS price, p_brand AS brand,
        row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY {order}, p_partkey) AS s FROM part),
    h AS (SELECT k, [k] AS path, [0::BIGINT] AS op FROM e WHERE {start}
        UNION ALL SELECT e.k, list_append(path, e.k), list_append(op, s) FROM h JOIN e ON e.p = h.k WHERE NOT ({estart}) AND NOT list_contains(path, e.k)),
    r AS (SELECT k, path, len(path)::INT AS lvl, row_number() OVER (PARTITION BY path[1] ORDER BY op)::INT AS pre,
        row_number() OVER (PARTITION BY path[1] ORDER BY list_append(op, 2147483647))::INT AS post FROM h)"""


def tree(start: str = "k = 1", order: str = "p_retailprice DESC") -> str:
    return TREE.format(start=start, estart=start.replace("k ", "e.k ", 1), order=order)


LEAF = "(post - pre + lvl - 1 = 0)"
GEO = """WITH g AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT [r_name] AS path FROM g UNION SELECT [r_name, n_name] FROM g),
    r AS (SELECT path, row_number() OVER (PARTITION BY path[1] ORDER BY path) AS pre FROM p)"""


def pair_query(predicate: str, source: Callable = heap, key: str = "succ") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = source(spark, sf_dir)
        name = N.call("name", "node")
        a = h.select(name.alias("a"), F.col("node").alias("na"))
        b = h.select(name.alias("b"), F.col("node").alias("nb"))
        return node_join(a, "na", b, "nb", predicate).select("a", "b")

    return run


def pair_sql(cond: str) -> str:
    return f"{tree()} SELECT x.k::VARCHAR AS a, y.k::VARCHAR AS b FROM r x JOIN r y ON {cond}"


def geo_pair_sql(cond: str) -> str:
    return f"{GEO} SELECT x.path[-1] AS a, y.path[-1] AS b FROM r x JOIN r y ON {cond}"


UP = "x.path[1:len(x.path) - 1] = y.path[1:len(y.path) - 1] AND len(x.path) = len(y.path)"
PAIRS = {
    "n7_is_descendant": ("is_descendant", "list_contains(x.path, y.k) AND x.k <> y.k"),
    "n8_is_descendant_or_self": ("is_descendant_or_self", "list_contains(x.path, y.k)"),
    "n9_is_ancestor": ("is_ancestor", "list_contains(y.path, x.k) AND x.k <> y.k"),
    "n10_is_ancestor_or_self": ("is_ancestor_or_self", "list_contains(y.path, x.k)"),
    "n11_is_parent": ("is_parent", "len(y.path) > 1 AND y.path[-2] = x.k"),
    "n12_is_child": ("is_child", "len(x.path) > 1 AND x.path[-2] = y.k"),
    "n13_is_sibling": ("is_sibling", f"{UP} AND x.k <> y.k"),
    "n14_is_self": ("is_self", "x.k = y.k"),
    "n15_is_sibling_or_self": ("is_sibling_or_self", UP),
}


def h2_levels_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    rows = rows.select("r_name", "n_name", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    h = level_hierarchy(rows, ["r_name", "n_name", "c_name"])
    return h.select("r_name", "n_name", "c_name", "c_acctbal", N.call("level", "node").alias("lvl"), N.call("pre_rank", "node").alias("pre"), N.call("is_leaf", "node").alias("leaf"))


H2_SQL = """WITH g AS (SELECT r_name, n_name, CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS c_name, c_acctbal
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT *, CASE WHEN c_name IS NULL THEN [r_name, n_name] ELSE [r_name, n_name, c_name] END AS path FROM g),
    p AS (SELECT [r_name] AS path FROM g UNION SELECT [r_name, n_name] FROM g UNION SELECT path FROM f),
    r AS (SELECT path, row_number() OVER (PARTITION BY path[1] ORDER BY path)::INT AS pre FROM p),
    l AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM p q WHERE len(q.path) = len(r.path) + 1 AND q.path[1:len(r.path)] = r.path) AS leaf FROM r)
    SELECT l.path[1] AS r_name, l.path[2] AS n_name, l.path[3] AS c_name, c_acctbal, len(l.path)::INT AS lvl, pre, leaf FROM l LEFT JOIN f USING (path)"""


def h10_rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of every part with all its descendants: sums per part first, then along ancestors."""
    revenue = t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    h = heap(spark, sf_dir).select("succ", F.explode("node.path").alias("top"))
    return h.join(revenue, h.succ == revenue.l_partkey).groupBy(F.col("top").cast("long").alias("part")).agg(F.sum("cents").cast("long").alias("cents"))


def hv_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy in a view, joined from outside, with parts that no root reaches."""
    s = session(spark, sf_dir, "part")
    s.sql(f"CREATE VIEW heap_view AS SELECT succ, node FROM {HEAP.format(tail='START WHERE succ = 2')}")
    return s.sql("SELECT p_partkey, level(hv.node) AS lvl FROM part LEFT OUTER JOIN heap_view AS hv ON p_partkey = hv.succ")


# --- currency ---------------------------------------------------------------------------------------

RATES_SQL = """SELECT c AS src, 'CHF' AS tgt, strftime(DATE '1996-01-01' + (30 * i)::INT, '%Y-%m-%d') AS since,
    (0.5 + i * 0.01 + j * 0.1)::DECIMAL(20,6) AS rate FROM range(41) a(i), (VALUES ('USD', 0), ('EUR', 1)) v(c, j)
    UNION ALL SELECT 'CHF', 'GBP', strftime(DATE '1996-01-01' + (30 * i)::INT, '%Y-%m-%d'), (1.25 + i * 0.01)::DECIMAL(20,6) FROM range(41) a(i)"""


def rates(spark: SparkSession) -> DataFrame:
    i = spark.range(41).select(F.col("id").alias("i"), F.date_format(F.expr("date_add(DATE '1996-01-01', int(id * 30))"), "yyyy-MM-dd").alias("since"))
    direct = i.join(spark.createDataFrame([("USD", 0), ("EUR", 1)], "src STRING, j INT")).select("src", F.lit("CHF").alias("tgt"), "since", F.expr("cast(0.5BD + i * 0.01BD + j * 0.1BD AS decimal(20,6))").alias("rate"))
    return direct.union(i.select(F.lit("CHF"), F.lit("GBP"), "since", F.expr("cast(1.25BD + i * 0.01BD AS decimal(20,6))")))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").alias("amount"), cur.alias("src"), F.lit("CHF").alias("tgt"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


def currency_query(**how) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = convert(amounts(spark, sf_dir), "amount", "src", "tgt", "d", rates(spark), **how)
        return out.select("o_orderkey", F.round(F.col("converted").cast("double"), 4).alias("value"))

    return run


def currency_sql(value: str) -> str:
    return f"""WITH rates AS ({RATES_SQL}), o AS (SELECT o_orderkey, o_totalprice::DECIMAL(20,2) AS amount,
        ['USD', 'EUR', 'GBP'][o_custkey % 3 + 1] AS src, 'CHF' AS tgt, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
    a AS (SELECT o.*, rates.rate AS r1 FROM o ASOF LEFT JOIN rates ON o.src = rates.src AND o.tgt = rates.tgt AND o.d >= rates.since),
    b AS (SELECT a.*, rates.rate AS r2 FROM a ASOF LEFT JOIN rates ON a.tgt = rates.src AND a.src = rates.tgt AND a.d >= rates.since)
    SELECT o_orderkey, round({value}, 4) AS value FROM b"""


#: amount / r2 rounded half even at two digits, in integers.
_N, _D = "(amount * 100)::HUGEINT * 1000000", "(r2 * 1000000)::HUGEINT"
INVERSE = f"(({_N} // {_D}) + CASE WHEN 2 * ({_N} % {_D}) > {_D} OR (2 * ({_N} % {_D}) = {_D} AND ({_N} // {_D}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100"
DIRECT = "(amount::DOUBLE * r1::DOUBLE)"


def c2_cc_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register("cc_rates", rates(spark))
    s.basic.options["table"] = "cc_rates"
    s.register("cc_amounts", amounts(spark, sf_dir))
    return s.sql("SELECT src, count(cc(amount, src, tgt, d)) AS n, round(cast(sum(cc(amount, src, tgt, d)) AS double), 2) AS total FROM cc_amounts GROUP BY src")


def c4_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cc with inverse rates in SQL: rounded at the amount's scale, like convert."""
    s = session(spark, sf_dir)
    s.register("cc_rates", rates(spark))
    s.register("cc_amounts", amounts(spark, sf_dir))
    s.basic.options |= {"table": "cc_rates", "allow_inverse": "true"}
    return s.sql("SELECT o_orderkey, round(cast(cc(amount, src, tgt, d) AS double), 4) AS value FROM cc_amounts")


def c2_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of ten and more digits, amounts of eight, amounts over 10^18; every digit of the result."""
    big = t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.expr("""array(named_struct('src', 'A', 'amount', cast(o_orderkey * 0.12345678BD AS decimal(28,8))),
        named_struct('src', 'B', 'amount', cast(1000000000000000000BD + o_orderkey AS decimal(28,8))), named_struct('src', 'C', 'amount', cast(-1.00000001BD * o_custkey AS decimal(28,8))))""")).alias("x"))
    rate = spark.sql("SELECT * FROM VALUES ('A', 'X', '1990-01-01', 1.0123456789BD), ('B', 'X', '19900101', 0.0000004BD), ('C', 'X', '1990-01-01', 123.45678901234BD) AS r(f, t, d, rate)").withColumn("rate", F.col("rate").cast("decimal(24,14)"))
    out = convert(big.select("o_orderkey", "x.*"), "amount", "src", F.lit("X"), F.lit("2020-02-02"), rate)
    return out.select("o_orderkey", "src", F.col("converted").cast("string").alias("value"))


#: The same in integers: amounts of 8 decimals, rates of 14, rounded half up at 15.
PRECISION_SQL = """WITH x AS (SELECT o_orderkey, 'A' AS src, (o_orderkey::HUGEINT * 12345678) * 101234567890000 AS u FROM orders
    UNION ALL SELECT o_orderkey, 'B', ((1000000000000000000::HUGEINT + o_orderkey) * 100000000) * 40000000 FROM orders
    UNION ALL SELECT o_orderkey, 'C', -(100000001::HUGEINT * o_custkey) * 12345678901234000 FROM orders),
    z AS (SELECT o_orderkey, src, u < 0 AS minus, abs(u) // 10000000 + CASE WHEN abs(u) % 10000000 >= 5000000 THEN 1 ELSE 0 END AS v FROM x)
    SELECT o_orderkey, src, CASE WHEN minus AND v > 0 THEN '-' ELSE '' END || (v // 1000000000000000)::VARCHAR || '.' || lpad((v % 1000000000000000)::VARCHAR, 15, '0') AS value FROM z"""

# --- aggregation, push-down, statistics --------------------------------------------------------------

PARTIALS = [Aggregate("avg", "l_quantity", "q"), Aggregate("count", "*", "n"), Aggregate("max", "l_tax", "tax"), Aggregate("sum", "l_linenumber", "lines")]


def a9_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly partial results put together per flag."""
    li = t(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    out = final(partial(li, ["l_returnflag", "month"], PARTIALS), ["l_returnflag"], PARTIALS)
    return out.select("l_returnflag", F.round("q", 6).alias("q"), F.col("n").cast("long").alias("n"), "tax", "lines")


def t1_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of renamed and aggregated columns of a view, with an annotation by region."""
    s = session(spark, sf_dir, "orders")
    keys = ", ".join(f"k{r.r_regionkey} = '{r.r_name}'" for r in t(spark, sf_dir, "region").collect())
    s.sql(f"CREATE VIEW sales AS SELECT o_custkey AS cust @({keys}), o_totalprice, o_orderdate FROM orders")
    return s.sql("SELECT COLUMN_NAME, ORIGINAL_COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, ANNOTATION_KEY, ANNOTATION_VALUE FROM describe_table(SELECT cust, sum(o_totalprice) AS total, max(o_orderdate) AS newest FROM sales GROUP BY cust)")


def g5_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(t(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"))


#: SQL that Spark and DuckDB read alike.
SAME: dict[str, str] = {
    "j1_inner": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "j2_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "j2_full": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "j4_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "a1_groupby": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "a3_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "pf2_distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "pf4_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "pf_predicates": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 25 AND p_brand LIKE 'Brand%' AND p_type NOT IN ('SMALL', 'x') AND NOT (p_retailprice <= 950.0) AND p_name IS NOT NULL",
    "pf13_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS parity FROM part",
    "o4_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "u1_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "u2_union": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier",
    "u3_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u4_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12",
    "u5_set_precedence": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey + 10 FROM customer INTERSECT SELECT s_nationkey + 12 FROM supplier EXCEPT SELECT r_regionkey FROM region",
    "j2_right": "SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey",
    "a5_distinct_functions": "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "pf4_having_alone": "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders HAVING count(*) > 1",
    "pf12_unary": "SELECT o_orderkey, -o_orderkey AS minus, ~o_orderkey AS flipped, -(-o_totalprice) AS same FROM orders",
    "pf14_casts": "SELECT o_orderkey, CAST(o_orderkey AS INT) AS i, CAST(o_orderkey AS DOUBLE) AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS dec, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey > 9 AS INT) AS flag FROM orders",
    "pf19_keyword_names": "SELECT o_orderkey AS level, o_custkey AS hierarchy, o_orderstatus AS node FROM orders",
    "sc3_no_from": "SELECT 1 + 1 AS two, 'x' AS x, NULL AS nothing",
    "w1_windows": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "b7_window_functions": "SELECT c_custkey, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS q, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS f, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS l, round(percent_rank() OVER w, 9) AS pr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
    "b1_conditional": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_nationkey, 7) AS g, least(c_nationkey, 7) AS l, CASE WHEN c_acctbal < 0 THEN 'debt' END AS debt, nullif(c_nationkey, 3) IS NULL AS three FROM customer",
    "b6_aggregates": "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS v, round(corr(c_acctbal, c_nationkey), 6) AS r, max_by(c_custkey, c_acctbal) AS richest, count_if(c_acctbal < 0) AS debtors, bool_or(c_acctbal > 9000) AS any_rich FROM customer GROUP BY c_mktsegment",
    "u6_with": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_custkey, round(total, 2) AS total FROM big JOIN customer ON o_custkey = c_custkey",
    "b2_math": "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(sign(s_acctbal) AS DOUBLE) AS sg, round(exp(s_acctbal / 10000), 6) AS e FROM supplier",
    "b3_strings": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INT) AS n, substring(c_name, 2, 3) AS s, trim(concat('  ', c_name, ' ')) AS t, reverse(c_mktsegment) AS r, lpad(c_mktsegment, 12, '*') AS p FROM customer",
}


def same_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir, sql).sql(sql)


#: (dialect's SQL, DuckDB's) where the same thing is spelt in two ways.
SPELT: dict[str, tuple[str, str]] = {
    "pf5_null_safe": ("SELECT c_custkey, (nullif(c_nationkey, 3) <=> NULL) AS none, (c_nationkey <=> 4) AS four FROM customer", "SELECT c_custkey, nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL AS none, c_nationkey IS NOT DISTINCT FROM 4 AS four FROM customer"),
    "pf7_rlike": ("SELECT p_partkey FROM part WHERE p_brand RLIKE '[1-3]$' AND p_type NOT LIKE '%A%'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[1-3]$') AND p_type NOT LIKE '%A%'"),
    "pf11_operators": ("SELECT o_orderkey, o_orderkey * 3 - o_custkey % 5 AS a, o_totalprice / 4 AS q, o_orderkey & 12 AS b, o_orderkey | 9 AS o, o_orderkey ^ 6 AS x FROM orders", "SELECT o_orderkey, o_orderkey * 3 - o_custkey % 5 AS a, o_totalprice / 4 AS q, o_orderkey & 12 AS b, o_orderkey | 9 AS o, xor(o_orderkey, 6) AS x FROM orders"),
    "pf15_access": ("SELECT o_orderkey, array(o_custkey, o_orderkey)[1] AS second, named_struct('p', o_totalprice, 's', o_orderstatus).s AS field, map(o_orderstatus, o_custkey)['F'] AS entry FROM orders", "SELECT o_orderkey, [o_custkey, o_orderkey][2] AS second, {'p': o_totalprice, 's': o_orderstatus}.s AS field, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS entry FROM orders"),
    "o2_sort_by": ("SELECT o_custkey, o_orderkey FROM orders SORT BY o_orderkey", "SELECT o_custkey, o_orderkey FROM orders"),
    "f2_f8_f11": ("SELECT o_orderkey, mod(o_orderkey, 7) AS m, to_double(concat(o_custkey, '.5')) AS d, to_double('x') AS none, rand(3) < 1 AS below FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, o_custkey + 0.5::DOUBLE AS d, NULL::DOUBLE AS none, TRUE AS below FROM orders"),
    "b4_dates": ("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, last_day(o_orderdate) AS last, date_add(to_date(o_orderdate), 40) AS later, datediff(o_orderdate, DATE '1996-02-29') AS gap, date_format(o_orderdate, 'yyyy/MM') AS ym, trunc(o_orderdate, 'MM') AS m, add_months(to_date(o_orderdate), -1) AS before FROM orders",
                 "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS doy, last_day(o_orderdate) AS last, (o_orderdate::DATE + 40) AS later, date_diff('day', DATE '1996-02-29', o_orderdate::DATE)::INT AS gap, strftime(o_orderdate, '%Y/%m') AS ym, date_trunc('month', o_orderdate)::DATE AS m, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS before FROM orders"),
    "b5_arrays_json": ("SELECT event_id, size(split(event_type, 'i')) AS parts, array_contains(split(event_type, ''), 'k') AS has, array_join(sort_array(split(event_type, '')), '') AS sorted, substring_index(event_type, 'i', 1) AS head, size(map('a', 1, 'b', 2)) AS two FROM events",
                       "SELECT event_id, len(string_split(event_type, 'i'))::INT AS parts, contains(event_type, 'k') AS has, array_to_string(list_sort(string_split(event_type, '')), '') AS sorted, string_split(event_type, 'i')[1] AS head, 2 AS two FROM events"),
}

#: Node predicates as users write them, over the heap's nodes.
NODES_ON = "SELECT name(x.node) AS a, name(y.node) AS b FROM heap_nodes AS x JOIN heap_nodes AS y ON {}(x.node, y.node)"


def sql_pairs(predicate: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: with_heap(spark, sf_dir).sql(NODES_ON.format(predicate.upper()))


def with_heap(spark: SparkSession, sf_dir: str) -> AnalyticsSession:
    """Nodes of the heap, its small parts alone, and order lines (several of a part) with their part's node."""
    s = AnalyticsSession(spark)
    nodes = heap(spark, sf_dir)
    s.register("heap_nodes", nodes)
    s.register("small_parts", t(spark, sf_dir, "part").where("p_size <= 3").join(nodes.select("succ", "node"), F.col("p_partkey") == F.col("succ")).select("p_partkey", "node"))
    s.register("lines", t(spark, sf_dir, "lineitem").join(nodes.select("succ", "node"), F.col("l_partkey") == F.col("succ")).select("l_orderkey", "l_linenumber", "node"))
    return s


def j7_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: with_heap(spark, sf_dir).sql(sql)


J7 = {
    "j7_semi": "SELECT l.l_orderkey, l.l_linenumber FROM lines AS l LEFT SEMI JOIN small_parts AS p ON IS_DESCENDANT(l.node, p.node)",
    "j7_anti": "SELECT l.l_orderkey, l.l_linenumber FROM lines AS l LEFT ANTI JOIN small_parts AS p ON IS_DESCENDANT_OR_SELF(l.node, p.node)",
    "j7_left_outer": "SELECT l.l_orderkey, l.l_linenumber, p.p_partkey FROM lines AS l LEFT OUTER JOIN small_parts AS p ON IS_DESCENDANT(l.node, p.node)",
    "j7_right_outer": "SELECT p.p_partkey, count(l.l_orderkey) AS n FROM lines AS l RIGHT OUTER JOIN small_parts AS p ON IS_ANCESTOR(p.node, l.node) GROUP BY p.p_partkey",
    "j9_self_join": "SELECT a.p_partkey AS x, b.p_partkey AS y FROM small_parts a, small_parts b WHERE IS_SIBLING(a.node, b.node) OR IS_CHILD(a.node, b.node)",
}


def j3_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "customer orders").sql("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: same_query(q) for k, q in DIALECT.items()},
    **{k: pair_query(p) for k, (p, _) in PAIRS.items()},
    "n16_is_following": pair_query("is_following", geo), "n17_is_preceding": pair_query("is_preceding", geo),
    "h2_levels_ragged": h2_levels_ragged, "h10_rollup_revenue": h10_rollup_revenue, "h10_view_outer_join": hv_outer_join,
    "c3_cc_asof": currency_query(), "c4_cc_inverse": currency_query(allow_inverse=True), "c5_cc_keep": currency_query(error_handling="keep_unconverted"), "c2_cc_dialect": c2_cc_dialect,
    "a9_partial_aggregation": a9_partial, "t1_describe_table": t1_describe, "g5_spearman": g5_spearman,
    **{k: same_query(q) for k, q in SAME.items()}, **{k: same_query(q) for k, (q, _) in SPELT.items()}, "j3_semi": j3_semi,
    **{f"{k}_sql": sql_pairs(p) for k, (p, _) in PAIRS.items()}, **{k: j7_query(q) for k, q in J7.items()},
    "c2_precision": c2_precision, "c4_cc_inverse_dialect": c4_dialect, **catalog.QUERIES,
}

#: Order lines with their part's key in the tree, small parts, and for each node the small parts it has above it or is.
LINES = f"""{tree()}, li AS (SELECT l_orderkey, l_linenumber, k, path FROM lineitem JOIN r ON l_partkey = k),
    small AS (SELECT k FROM r JOIN part ON p_partkey = k WHERE p_size <= 3), a AS (SELECT k, unnest(path) AS top FROM r), up AS (SELECT a.k, top FROM a JOIN small ON small.k = top)"""

ORACLE_SQL: dict[str, str] = {
    **SAME,
    **{k: pair_sql(c) for k, (_, c) in PAIRS.items()},
    **{k: q for k, (_, q) in SPELT.items()}, **{f"{k}_sql": pair_sql(c) for k, (_, c) in PAIRS.items()}, **catalog.ORACLE_SQL,
    "j7_semi": f"{LINES} SELECT l_orderkey, l_linenumber FROM li WHERE EXISTS (SELECT 1 FROM up WHERE up.k = li.k AND up.top <> li.k)",
    "j7_anti": f"{LINES} SELECT l_orderkey, l_linenumber FROM li WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.k = li.k)",
    "j7_left_outer": f"{LINES} SELECT l_orderkey, l_linenumber, top AS p_partkey FROM li LEFT JOIN up ON up.k = li.k AND up.top <> li.k",
    "j7_right_outer": f"{LINES} SELECT small.k AS p_partkey, count(l_orderkey) AS n FROM small LEFT JOIN (SELECT top, l_orderkey FROM li JOIN up ON up.k = li.k AND up.top <> li.k) AS b ON b.top = small.k GROUP BY small.k",
    "j9_self_join": f"{LINES} SELECT x.k AS x, y.k AS y FROM small x JOIN small y ON x.k <> y.k AND (x.k // 2 = y.k // 2 OR x.k // 2 = y.k)",
    "n16_n17_rank_counts": f"""{tree()}, c AS (SELECT u.k AS succ, count(*) FILTER (x.pre > u.pre AND NOT list_contains(x.path, u.k)) AS n_following,
        count(*) FILTER (x.pre < u.pre AND NOT list_contains(u.path, x.k)) AS n_preceding FROM r u CROSS JOIN r x GROUP BY u.k) SELECT * FROM c""",
    "c2_precision": PRECISION_SQL,
    "c4_cc_inverse_dialect": currency_sql(f"coalesce({DIRECT}, {INVERSE})"),
    "h1_ranks": f"{tree()} SELECT k AS succ, lvl, pre, post, {LEAF} AS leaf FROM r",
    "h1_forest_restart": f"{tree('k IN (2, 3)')} SELECT k AS succ, lvl, pre, post FROM r",
    "h1_unreachable_dropped": f"{tree('k = 2')} SELECT k AS succ, lvl FROM r",
    "h1_default_roots": """WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey >= 4 THEN p_partkey // 2 END AS p FROM part),
        h AS (SELECT k, 1 AS lvl FROM e WHERE p IS NULL UNION ALL SELECT e.k, lvl + 1 FROM h JOIN e ON e.p = h.k) SELECT k AS succ, lvl::INT AS lvl, lvl = 1 AS root FROM h""",
    "h1_cycle_cut": """WITH RECURSIVE e(k, p) AS (VALUES (1, 3), (2, 1), (3, 2), (4, 2), (8, 9), (9, 8)), h AS (SELECT k, [k] AS path FROM e WHERE k = 1
        UNION ALL SELECT e.k, list_append(path, e.k) FROM h JOIN e ON e.p = h.k WHERE NOT list_contains(path, e.k)) SELECT k::BIGINT AS k, len(path)::INT AS lvl FROM h""",
    "h3_sibling_keys": f"{tree(order='p_brand, p_retailprice DESC')} SELECT k AS succ, pre FROM r",
    "n4_n6_root_name": f"{tree()} SELECT k AS succ, lvl = 1 AS root, k::VARCHAR AS label FROM r",
    "n16_is_following": geo_pair_sql("x.pre > y.pre AND NOT (len(x.path) > len(y.path) AND x.path[1:len(y.path)] = y.path)"),
    "n17_is_preceding": geo_pair_sql("y.pre > x.pre AND NOT (len(y.path) > len(x.path) AND y.path[1:len(x.path)] = x.path)"),
    "h2_levels_ragged": H2_SQL,
    "h10_rollup_revenue": f"""{tree()}, v AS (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT) AS cents FROM lineitem GROUP BY 1),
        x AS (SELECT k, unnest(path) AS part FROM r) SELECT part, sum(cents)::BIGINT AS cents FROM x JOIN v ON k = l_partkey GROUP BY part""",
    "h10_view_outer_join": f"{tree('k = 2')} SELECT p_partkey, lvl FROM part LEFT JOIN r ON p_partkey = k",
    "c3_cc_asof": currency_sql(DIRECT),
    "c4_cc_inverse": currency_sql(f"coalesce({DIRECT}, {INVERSE})"),
    "c5_cc_keep": currency_sql(f"coalesce({DIRECT}, amount::DOUBLE)"),
    "c2_cc_dialect": f"SELECT src, count(value) AS n, round(sum(value), 2) AS total FROM ({currency_sql(DIRECT).replace('o_orderkey, round', 'src, round')}) GROUP BY src",
    "a9_partial_aggregation": "SELECT l_returnflag, round(avg(l_quantity), 6) AS q, count(*) AS n, max(l_tax) AS tax, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag",
    "f1_f12_scalars": """SELECT o_orderkey, o_orderkey % 7 AS rem, o_orderdate::DATE + 3 AS d3, (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE AS y1, abs(date_diff('day', DATE '1998-01-01', o_orderdate::DATE))::INT AS gap,
        trunc(o_totalprice)::INT AS whole, o_orderkey::VARCHAR AS text, replace(o_orderpriority, '-', '') AS prio, round(ln(o_totalprice), 6) AS l FROM orders""",
    "f4_add_seconds": "SELECT event_id, ts + INTERVAL 90 SECOND AS later FROM events",
    "f13_extract": "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s FROM events",
    "a4_distinct_star": "SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL)",
    "a6_approx": "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS close, TRUE AS near FROM events GROUP BY event_type",
    "g5_spearman": """WITH a AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) SELECT round(corr(x, y), 6) AS rho FROM a""",
    "t1_describe_table": """WITH c AS (SELECT column_name AS o, data_type AS d FROM information_schema.columns WHERE table_name = 'orders')
        SELECT 'cust' AS COLUMN_NAME, o AS ORIGINAL_COLUMN_NAME, 1 AS ORDINAL_POSITION, d AS DATA_TYPE, 'k' || r_regionkey AS ANNOTATION_KEY, r_name AS ANNOTATION_VALUE FROM c, region WHERE o = 'o_custkey'
        UNION ALL SELECT 'total', o, 2, d, NULL, NULL FROM c WHERE o = 'o_totalprice' UNION ALL SELECT 'newest', o, 3, d, NULL, NULL FROM c WHERE o = 'o_orderdate'""",
    "j3_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
}
