"""Registered queries of the catalog, annotations, system tables and providers.

What they describe is made from the data (a view for each nation, an annotation for each region), so that
the answer can be computed from the same tables in SQL instead of being written down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import AnalyticsSession
from .sources.partitions import PartitionFunction
from .sources.providers import MemoryProvider, register_provider

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Make = Callable[[SparkSession, str], DataFrame]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, *names: str) -> AnalyticsSession:
    """A session with tables that a provider named q holds."""
    p = MemoryProvider()
    for n in names:
        p.frames[n] = t(spark, sf_dir, n)
    register_provider("q", p)
    return AnalyticsSession(spark)


def regions(spark: SparkSession, sf_dir: str) -> list:
    return t(spark, sf_dir, "region").orderBy("r_regionkey").collect()


def nations(spark: SparkSession, sf_dir: str) -> list:
    return t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def views(spark: SparkSession, sf_dir: str) -> AnalyticsSession:
    """A view for each region, and on it one for each of its nations."""
    s = stored(spark, sf_dir, "nation")
    s.sql("REGISTER TABLE nation USING q")
    for r in regions(spark, sf_dir):
        s.sql(f"CREATE {'DIMENSION ' if r.r_regionkey % 2 else ''}VIEW r_{r.r_regionkey} AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = {r.r_regionkey}")
    for n in nations(spark, sf_dir):
        s.sql(f"CREATE CUBE VIEW n_{n.n_nationkey} AS SELECT n_name FROM r_{n.n_regionkey} WHERE n_nationkey = {n.n_nationkey}")
    return s


def v7_cascade(spark, sf_dir):
    s = views(spark, sf_dir)
    s.sql("DROP VIEW r_2 CASCADE")
    s.sql("DROP VIEW IF EXISTS r_2")
    return s.sql("SELECT TABLE_NAME, KIND, IS_TEMPORARY FROM SYS.TABLES")


def v8_dependencies(spark, sf_dir):
    return views(spark, sf_dir).sql("SELECT BASE_OBJECT_NAME, BASE_OBJECT_TYPE, DEPENDENT_OBJECT_NAME FROM SYS.OBJECT_DEPENDENCIES")


def v4_late_resolution(spark, sf_dir):
    """A view over a view follows its base to other data and columns."""
    s = stored(spark, sf_dir)
    s.register("src", t(spark, sf_dir, "region"))
    s.sql("CREATE VIEW all_src AS SELECT * FROM src")
    s.sql("CREATE VIEW counted AS SELECT count(*) AS n FROM all_src")
    before = s.sql("SELECT n FROM counted").first().n
    s.register("src", t(spark, sf_dir, "supplier"))
    return s.sql(f"SELECT {before} AS before, n, (SELECT max(s_suppkey) FROM all_src) AS top FROM counted")


def v2_v3_persisted_views(spark, sf_dir):
    """Views kept by a provider come back in another session."""
    s = stored(spark, sf_dir, "orders")
    s.sql("REGISTER TABLE orders USING q")
    s.sql("CREATE CUBE VIEW by_status AS SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus USING q")
    s.sql("CREATE VIEW IF NOT EXISTS by_status AS SELECT 1 AS x USING q")
    later = AnalyticsSession(spark)
    later.sql("REGISTER ALL TABLES USING q")
    return later.sql("SELECT o_orderstatus, n, (SELECT KIND FROM SYS.TABLES WHERE TABLE_NAME = 'by_status') AS kind FROM by_status")


def v10_v12_provider_catalog(spark, sf_dir):
    s = stored(spark, sf_dir, *TABLES)
    s.sql("REGISTER TABLE nation USING q")
    s.sql("REGISTER ALL TABLES IF NOT EXISTS USING q")
    s.sql("REGISTER ALL TABLES USING q IGNORING CONFLICTS")
    shown = s.sql("SHOW TABLES USING q").join(s.sql("SELECT TABLE_NAME, PROVIDER FROM SYS.TABLES"), "TABLE_NAME")
    return shown.withColumn("n", F.lit(s.sql("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").first().n).cast("long"))


def v13_describe_using(spark, sf_dir):
    s = stored(spark, sf_dir, "nation")
    s.sql("CREATE TABLE made (a INT, b STRING) USING q")
    rows = [s.sql(f"DESCRIBE TABLE {n} USING q") for n in ("nation", "made", "nowhere")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def v14_deep_describe(spark, sf_dir):
    s = views(spark, sf_dir)
    k = nations(spark, sf_dir)[0].n_nationkey
    out = s.sql(f"DEEP DESCRIBE n_{k}")
    return out.select("NAME", "KIND", F.col("FIELDS")[0]["name"].alias("FIELD"), F.col("CHILDREN")[0]["name"].alias("CHILD"), F.size(F.col("CHILDREN")[0]["fields"]).alias("CHILD_FIELDS"), F.col("CHILDREN")[0]["children"][0]["name"].alias("GRANDCHILD"))


def v15_partition_numbers(spark, sf_dir):
    """The partition that each row is dealt to, by a range function with given bounds and one with a stride."""
    part = t(spark, sf_dir, "part").select("p_partkey", "p_size")
    out = []
    for f in (PartitionFunction("by_stride", "interval", ("INT",), start=0, end=50, stride=10), PartitionFunction("by_split", "split", ("INT",), splitters=("7", "30"), right_closed=True)):
        out.append(f.apply(part, "p_size").select("p_partkey", F.lit(f.name).alias("f"), F.spark_partition_id().alias("partition")))
    return out[0].unionAll(out[1])


def v15_functions_shown(spark, sf_dir):
    s = stored(spark, sf_dir)
    for r in regions(spark, sf_dir):
        s.sql(f"CREATE PARTITION FUNCTION f_{r.r_regionkey} (INT) AS RANGE START 0 END 100 STRIDE {r.r_regionkey * 10 + 15} USING q")
    s.sql("DROP PARTITION FUNCTION f_1 USING q")
    listed = s.sql("SHOW PARTITION FUNCTIONS USING q").select("name", "stride")
    return listed.join(s.sql("SELECT ID, TYPE, BOUNDARIES FROM SYS.PARTITION_FUNCTIONS USING q").withColumnRenamed("ID", "name"), "name")


def sc5_sc9_tables(spark, sf_dir):
    """A table made from a query, appended to from a file."""
    s = stored(spark, sf_dir, "nation")
    s.sql("REGISTER TABLE nation USING q")
    s.sql("CREATE TABLE made USING q AS SELECT * FROM nation WHERE n_regionkey = 0")
    s.sql(f"APPEND TABLE made OPTIONS (files '{sf_dir}/nation.parquet', format 'parquet')")
    return s.sql("SELECT n_name, count(*) AS n FROM made GROUP BY n_name")


def sc8_insert(spark, sf_dir):
    import uuid

    from .operators.tables import shared_folder

    s = AnalyticsSession(spark)
    name = f"arbordf_insert_{uuid.uuid4().hex[:8]}"
    s.register("src_orders", t(spark, sf_dir, "orders"))
    spark.sql(f"CREATE TABLE {name} (k BIGINT, status STRING) USING parquet LOCATION '{shared_folder(spark)}/{name}'")
    try:
        s.sql(f"INSERT INTO TABLE {name} SELECT o_orderkey, o_orderstatus FROM src_orders WHERE o_orderstatus = 'F'")
        s.sql(f"INSERT INTO {name} SELECT o_orderkey, o_orderstatus FROM src_orders WHERE o_orderstatus = 'O'")
        schema = spark.table(name).schema
    finally:
        spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return spark.read.schema(schema).parquet(f"{shared_folder(spark)}/{name}").groupBy("status").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


def sc16_raw_sql(spark, sf_dir):
    s = stored(spark, sf_dir)
    t(spark, sf_dir, "supplier").createOrReplaceTempView("raw_supplier")
    return s.sql("SELECT r.nation, r.n FROM (``SELECT s_nationkey AS nation, count(*) AS n FROM raw_supplier GROUP BY s_nationkey`` USING q) AS r WHERE r.n > 1")


def annotated(spark, sf_dir) -> AnalyticsSession:
    """A view of orders whose first column has an annotation for each region, by name."""
    s = stored(spark, sf_dir, "orders")
    s.sql("REGISTER TABLE orders USING q")
    marks = ", ".join(f"k{r.r_regionkey} = '{r.r_name}'" for r in regions(spark, sf_dir))
    s.sql(f"CREATE VIEW sales AS SELECT o_orderkey AS id @({marks}), o_totalprice FROM orders")
    return s


def annotation_query(select: str) -> Make:
    return lambda spark, sf_dir: annotated(spark, sf_dir).sql(f"SELECT COLUMN_NAME, ORIGINAL_COLUMN_NAME, ANNOTATION_KEY, ANNOTATION_VALUE FROM describe_table({select})")


def t2_describe_if_exists(spark, sf_dir):
    s = stored(spark, sf_dir, "lineitem")
    s.sql("REGISTER TABLE lineitem USING q")
    cols = "COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE"
    return s.sql(f"SELECT {cols} FROM describe_table_if_exists(SELECT * FROM lineitem)").unionAll(s.sql(f"SELECT {cols} FROM describe_table_if_exists(SELECT * FROM nowhere)"))


def s3_metadata(spark, sf_dir):
    s = stored(spark, sf_dir)
    for r in regions(spark, sf_dir):
        s.sql(f"CREATE TABLE t_{r.r_regionkey} (a @(name = '{r.r_name}') INT, b STRING) USING q")
    return s.sql("SELECT TABLE_NAME, METADATA_KEY, METADATA_VALUE FROM SYS.TABLE_METADATA")


def s4_schemas(spark, sf_dir):
    s = stored(spark, sf_dir, *TABLES)
    s.sql("REGISTER ALL TABLES USING q")
    s.sql("CREATE VIEW gone AS SELECT nothing FROM nowhere")
    return s.sql("SELECT TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, DATA_TYPE, NUMERIC_PRECISION FROM SYS.SCHEMAS")


def s5_session(spark, sf_dir):
    s = AnalyticsSession(spark)
    rows = regions(spark, sf_dir)
    for r in rows:
        spark.conf.set(f"spark.arbordf.query.{r.r_regionkey}", r.r_name)
    try:
        return s.sql("SELECT KEY, VALUE FROM SYS.SESSION_CONTEXT WHERE KEY LIKE 'spark.arbordf.query.%'")
    finally:
        for r in rows:
            spark.conf.unset(f"spark.arbordf.query.{r.r_regionkey}")


def s8_relation_names(spark, sf_dir):
    s = views(spark, sf_dir)
    return s.sql("SELECT RELATION_NAME, SQL_NAME FROM SYS_RELATION_SQL_NAME WHERE RELATION_NAME <> 'nation'")


def sc15_infer(spark, sf_dir):
    return AnalyticsSession(spark).sql(f"INFER SCHEMA OF '{sf_dir}/lineitem.parquet' AS PARQUET").select("COLUMN_NAME", "ORDINAL_POSITION", "DATA_TYPE", "NUMERIC_PRECISION")


def geography(spark, sf_dir, shards: int) -> AnalyticsSession:
    """Regions and nations in SQLite files, which is where queries over them run."""
    import re
    import sqlite3
    import uuid

    from .operators.tables import shared_folder

    names = []
    for k in range(shards):
        folder = re.sub("^file:/+", "/", shared_folder(spark))
        names.append(f"{folder}/geography-{uuid.uuid4().hex}.db")
        con = sqlite3.connect(names[-1])
        con.execute("CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)")
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        con.executemany("INSERT INTO region VALUES (?, ?)", [tuple(r) for r in regions(spark, sf_dir) if r.r_regionkey % shards == k])
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in nations(spark, sf_dir) if r.n_regionkey % shards == k])
        con.commit()
        con.close()
    s = AnalyticsSession(spark)
    s.sql(f"REGISTER ALL TABLES USING sqlite OPTIONS (database '{','.join(names)}')")
    return s


PUSHED = "SELECT r_name, count(*) AS n, min(n_name) AS first FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey BETWEEN 1 AND 22 AND n_name NOT LIKE '%9' GROUP BY r_name HAVING count(*) > 1 ORDER BY r_name DESC LIMIT 4"
PARTIAL = "SELECT n_regionkey, avg(n_nationkey) AS a, count(*) AS n, sum(n_nationkey) AS s, max(n_name) AS last FROM nation WHERE n_nationkey > 1 GROUP BY n_regionkey"


def g1_plan_text(spark, sf_dir):
    """The SQL text of a Spark query over the source, run there as raw SQL."""
    from .plans.frontend import Query
    from .plans.pushdown import sql_of

    s = geography(spark, sf_dir, 1)
    text = sql_of(Query(s, "SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, n_regionkey AS r FROM nation WHERE NOT (n_nationkey IN (3, 4) OR n_name IS NULL)").run())
    return s.sql(f"``{text}`` USING sqlite OPTIONS (database '{s.registry.get('nation').options['database']}') AS (parity STRING, r BIGINT)")


def n16_n17_counts(spark, sf_dir):
    from .operators.node_joins import rank_counts
    from .queries import heap

    return rank_counts(heap(spark, sf_dir)).select("succ", F.col("n_following").cast("long").alias("n_following"), F.col("n_preceding").cast("long").alias("n_preceding"))


QUERIES: dict[str, Make] = {
    "v7_cascade": v7_cascade, "v8_dependencies": v8_dependencies, "v4_late_resolution": v4_late_resolution, "v2_v3_persisted_views": v2_v3_persisted_views,
    "v9_v12_provider_catalog": v10_v12_provider_catalog, "v13_describe_using": v13_describe_using, "v14_deep_describe": v14_deep_describe,
    "v15_partition_numbers": v15_partition_numbers, "v15_s6_partition_functions": v15_functions_shown, "sc5_sc9_tables": sc5_sc9_tables, "sc8_insert": sc8_insert, "sc16_raw_sql": sc16_raw_sql,
    "an3_an5_propagation": annotation_query("SELECT q.order_no @(k1 = 'over', own = 'new') FROM (SELECT id AS order_no FROM sales) AS q"),
    "an4_filter": annotation_query("SELECT id @(k0 = ?, k3 = ?), o_totalprice FROM sales"),
    "an5_star_key": annotation_query("SELECT id @(* = 'same') FROM sales"),
    "an6_star": annotation_query("SELECT * @(every = 'column') FROM sales"),
    "an7_union": annotation_query("SELECT id @(side = 'left') FROM sales UNION SELECT id @(side = 'right') FROM sales"),
    "t2_describe_if_exists": t2_describe_if_exists, "s3_metadata": s3_metadata, "s4_schemas": s4_schemas, "s5_session_context": s5_session, "s8_relation_sql_name": s8_relation_names,
    "sc12_pushdown": lambda spark, sf_dir: geography(spark, sf_dir, 1).sql(PUSHED), "a9_sc12_shards": lambda spark, sf_dir: geography(spark, sf_dir, 3).sql(PARTIAL), "g1_plan_text": g1_plan_text,
    "sc15_infer_schema": sc15_infer, "n16_n17_rank_counts": n16_n17_counts,
}

#: SQL names of the types that the data has.
TYPE = "CASE data_type WHEN 'VARCHAR' THEN 'VARCHAR(*)' ELSE data_type END"
PRECISION = "CASE data_type WHEN 'BIGINT' THEN 64 WHEN 'INTEGER' THEN 32 WHEN 'DOUBLE' THEN 53 END"
COLUMNS = f"SELECT column_name AS COLUMN_NAME, ordinal_position::INT AS ORDINAL_POSITION, {TYPE} AS DATA_TYPE"
IN_TABLES = f"table_name IN ({', '.join(repr(n) for n in TABLES)})"
MARKS = "SELECT 'k' || r_regionkey AS k, r_name AS v FROM region"


def marks(column: str, original: str, sql: str) -> str:
    return f"SELECT '{column}' AS COLUMN_NAME, '{original}' AS ORIGINAL_COLUMN_NAME, k AS ANNOTATION_KEY, v AS ANNOTATION_VALUE FROM ({sql})"


ORACLE_SQL: dict[str, str] = {
    "v7_cascade": """SELECT 'r_' || r_regionkey AS TABLE_NAME, CASE WHEN r_regionkey % 2 = 1 THEN 'DIMENSION' ELSE 'VIEW' END AS KIND, 'TRUE' AS IS_TEMPORARY FROM region WHERE r_regionkey <> 2
        UNION ALL SELECT 'n_' || n_nationkey, 'CUBE', 'TRUE' FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'nation', 'TABLE', 'FALSE'""",
    "v8_dependencies": """SELECT 'nation' AS BASE_OBJECT_NAME, 'TABLE' AS BASE_OBJECT_TYPE, 'r_' || r_regionkey AS DEPENDENT_OBJECT_NAME FROM region
        UNION ALL SELECT 'r_' || n_regionkey, CASE WHEN n_regionkey % 2 = 1 THEN 'DIMENSION' ELSE 'VIEW' END, 'n_' || n_nationkey FROM nation""",
    "v4_late_resolution": "SELECT (SELECT count(*) FROM region)::INT AS before, count(*) AS n, max(s_suppkey) AS top FROM supplier",
    "v2_v3_persisted_views": "SELECT o_orderstatus, count(*) AS n, 'CUBE' AS kind FROM orders GROUP BY o_orderstatus",
    "v9_v12_provider_catalog": f"SELECT table_name AS TABLE_NAME, 'FALSE' AS IS_TEMPORARY, 'TABLE' AS KIND, 'q' AS PROVIDER, (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) AS n FROM information_schema.tables WHERE {IN_TABLES}",
    "v13_describe_using": """SELECT 'nation' AS TABLE_NAME, 'CREATE TABLE nation (' || string_agg(column_name || ' ' || CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END, ', ' ORDER BY ordinal_position) || ') USING q' AS DDL_STMT
        FROM information_schema.columns WHERE table_name = 'nation' UNION ALL SELECT 'made', 'CREATE TABLE made (a INT, b STRING) USING q' UNION ALL SELECT '', ''""",
    "v14_deep_describe": "SELECT 'n_' || n_nationkey AS NAME, 'cube' AS KIND, 'n_name' AS FIELD, 'r_' || n_regionkey AS CHILD, 2 AS CHILD_FIELDS, 'nation' AS GRANDCHILD FROM nation ORDER BY n_nationkey LIMIT 1",
    "v15_partition_numbers": """SELECT p_partkey, 'by_stride' AS f, least(greatest(p_size // 10, 0), 4)::INT AS partition FROM part
        UNION ALL SELECT p_partkey, 'by_split', CASE WHEN p_size <= 7 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END FROM part""",
    "v15_s6_partition_functions": """SELECT 'f_' || r_regionkey AS name, (r_regionkey * 10 + 15)::VARCHAR AS stride, 'RANGE' AS TYPE,
        array_to_string(range(r_regionkey * 10 + 15, 100, r_regionkey * 10 + 15), ',') AS BOUNDARIES FROM region WHERE r_regionkey <> 1""",
    "sc5_sc9_tables": "SELECT n_name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 0) GROUP BY n_name",
    "sc8_insert": "SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus",
    "sc16_raw_sql": "SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1",
    "an3_an5_propagation": marks("order_no", "o_orderkey", f"SELECT k, CASE k WHEN 'k1' THEN 'over' ELSE v END AS v FROM ({MARKS}) UNION ALL SELECT 'own', 'new'"),
    "an4_filter": f"{marks('id', 'o_orderkey', MARKS + ' WHERE r_regionkey IN (0, 3)')} UNION ALL SELECT 'o_totalprice', 'o_totalprice', NULL, NULL",
    "an5_star_key": marks("id", "o_orderkey", f"SELECT k, 'same' AS v FROM ({MARKS})"),
    "an6_star": f"{marks('id', 'o_orderkey', MARKS + chr(10) + ' UNION ALL SELECT ' + repr('every') + ', ' + repr('column'))} UNION ALL SELECT 'o_totalprice', 'o_totalprice', 'every', 'column'",
    "an7_union": marks("id", "o_orderkey", MARKS + " UNION ALL SELECT 'side', 'left'"),
    "t2_describe_if_exists": f"{COLUMNS} FROM information_schema.columns WHERE table_name = 'lineitem'",
    "s3_metadata": "SELECT 't_' || r_regionkey AS TABLE_NAME, 'a.name' AS METADATA_KEY, r_name AS METADATA_VALUE FROM region",
    "s4_schemas": f"SELECT table_name AS TABLE_NAME, * FROM ({COLUMNS}, table_name, {PRECISION} AS NUMERIC_PRECISION FROM information_schema.columns WHERE {IN_TABLES})".replace("SELECT table_name AS TABLE_NAME, * FROM", "SELECT table_name AS TABLE_NAME, * EXCLUDE (table_name) FROM"),
    "s5_session_context": "SELECT 'spark.arbordf.query.' || r_regionkey AS KEY, r_name AS VALUE FROM region",
    "s8_relation_sql_name": "SELECT 'r_' || r_regionkey AS RELATION_NAME, 'r_' || r_regionkey AS SQL_NAME FROM region UNION ALL SELECT 'n_' || n_nationkey, 'n_' || n_nationkey FROM nation",
    "sc12_pushdown": PUSHED,
    "a9_sc12_shards": PARTIAL.replace("sum(n_nationkey)", "sum(n_nationkey)::BIGINT").replace("SELECT n_regionkey,", "SELECT n_regionkey::BIGINT AS n_regionkey,"),
    "g1_plan_text": "SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, n_regionkey::BIGINT AS r FROM nation WHERE n_nationkey NOT IN (3, 4)",
    "sc15_infer_schema": f"{COLUMNS}, {PRECISION} AS NUMERIC_PRECISION FROM information_schema.columns WHERE table_name = 'lineitem'",
}
