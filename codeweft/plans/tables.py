"""A property graph over the relational test tables: the same rows in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.mutate import content_hash
from codeweft.plans.model import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, for work that takes long on a row: a table of few bytes has many rows in few tasks.

    The number of tasks doesn't follow from bytes, so adaptive planning leaves it as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def _node(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _symbol(df: DataFrame, prefix: str, key: str, name: str, kind: str, file, signature, doc, project: str) -> DataFrame:
    start = F.col(key).cast("long") + 1
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select(
        _node(prefix, key).alias("id"),
        F.col(name).alias("name"),
        F.lit(kind).alias("kind"),
        file.alias("file"),
        start.alias("start_line"),
        (start + F.col(key) % 50).alias("end_line"),
        text(signature).alias("signature"),
        text(doc).alias("doc_comment"),
        F.col(project).alias("project_id"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by definition
    supplier = read(spark, sf_dir, "supplier").join(F.broadcast(placed), F.col("s_nationkey") == F.col("n_nationkey"))
    customer = read(spark, sf_dir, "customer").join(F.broadcast(placed), F.col("c_nationkey") == F.col("n_nationkey"))
    part = read(spark, sf_dir, "part")
    under = lambda folder, c: F.concat(F.lit(f"{folder}/"), F.col(c))
    sig = F.concat("p_name", F.lit("("), "p_type", F.lit(")"))
    rows = [
        _symbol(region, "region", "r_regionkey", "r_name", "module", F.lit("regions"), None, None, "r_name"),
        _symbol(placed, "nation", "n_nationkey", "n_name", "type", under("nations", "r_name"), None, F.col("r_name"), "r_name"),
        _symbol(supplier, "supplier", "s_suppkey", "s_name", "interface", under("suppliers", "n_name"), F.col("s_name"), None, "r_name"),
        _symbol(customer, "customer", "c_custkey", "c_name", "class", under("customers", "c_mktsegment"), None, F.col("c_mktsegment"), "r_name"),
        _symbol(part, "part", "p_partkey", "p_name", "function", under("parts", "p_brand"), sig, None, "p_brand"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("imports", "implements", "calls")) -> DataFrame:
    """Edges of the kinds asked for; others aren't computed."""
    out = []

    def edge(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str, file: str) -> None:
        """``a`` and ``b``: prefix and column of the keys; those are shuffled, not the longer ids."""
        ends = df.select(F.col(a[1]).alias("a"), F.col(b[1]).alias("b")).distinct()
        line = F.lit(0).cast("long").alias("line")
        out.append(ends.select(_node(a[0], "a").alias("from_id"), _node(b[0], "b").alias("to_id"), F.lit(kind).alias("kind"), F.lit(file).alias("file"), line))

    if "imports" in kinds:
        edge(read(spark, sf_dir, "nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "imports", "nations")
        edge(read(spark, sf_dir, "customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "imports", "customers")
        edge(read(spark, sf_dir, "supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "imports", "suppliers")
    if "implements" in kinds:
        lines = read(spark, sf_dir, "lineitem")
        edge(lines, ("part", "l_partkey"), ("supplier", "l_suppkey"), "implements", "lineitem")
    if "calls" in kinds:
        big = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        after = big.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
        edge(big.join(after, ["l_orderkey", "l_linenumber"]), ("part", "l_partkey"), ("part", "next"), "calls", "lineitem")
    result = out[0]
    for r in out[1:]:
        result = result.union(r)
    return result


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are registered projects; parts' brands aren't."""
    name = F.col("r_name")
    return read(spark, sf_dir, "region").select(name.alias("id"), name.alias("name"), F.concat(F.lit("/"), name).alias("path"), F.lit("go").alias("language"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed files: hash of the text; projects take turns by id."""
    region = read(spark, sf_dir, "region")
    docs = read(spark, sf_dir, "documents").join(region, F.pmod("doc_id", F.lit(5)) == region["r_regionkey"], "left")
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        content_hash(F.col("text")).alias("hash"),
        F.lit(None).cast("timestamp").alias("mod_time"),
        F.col("r_name").alias("project_id"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(projects(spark, sf_dir), symbols(spark, sf_dir), edges(spark, sf_dir), files(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols with their text as the comment, for full-text search."""
    docs = read(spark, sf_dir, "documents")
    none = F.lit(0).cast("long")
    return docs.select(
        _node("doc", "doc_id").alias("id"),
        F.col("lang").alias("name"),
        F.lit("module").alias("kind"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"),
        none.alias("start_line"),
        none.alias("end_line"),
        F.col("source").alias("signature"),
        F.col("text").alias("doc_comment"),
        F.col("source").alias("project_id"),
    )


def busiest(calls: DataFrame, end: str = "from_id") -> str:
    """The symbol with most calls at this end; of several the smallest id."""
    top = calls.groupBy(end).agg(F.count("*").alias("n")).orderBy(F.desc("n"), end).limit(1).collect()
    return top[0][end] if top else ""


# ---- the same as SQL

_P = "CAST({0} + 1 AS BIGINT) AS start_line, CAST({0} + 1 + {0} % 50 AS BIGINT) AS end_line"

GRAPH_SQL = f"""
placed AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
symbols AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'module' AS kind, 'regions' AS file, {_P.format('r_regionkey')},
         CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS VARCHAR) AS doc_comment, r_name AS project_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'type', 'nations/' || r_name, {_P.format('n_nationkey')}, NULL, r_name, r_name FROM placed
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'interface', 'suppliers/' || n_name, {_P.format('s_suppkey')}, s_name, NULL, r_name
    FROM supplier JOIN placed ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'class', 'customers/' || c_mktsegment, {_P.format('c_custkey')}, NULL, c_mktsegment, r_name
    FROM customer JOIN placed ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'function', 'parts/' || p_brand, {_P.format('p_partkey')}, p_name || '(' || p_type || ')', NULL, p_brand
    FROM part
),
big AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
pairs AS (
  SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'imports' AS kind, 'nations' AS file FROM nation
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports', 'customers' FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports', 'suppliers' FROM supplier
  UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'implements', 'lineitem' FROM lineitem
  UNION SELECT 'part:' || a.l_partkey, 'part:' || b.l_partkey, 'calls', 'lineitem'
    FROM big a JOIN big b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
),
edges AS (SELECT from_id, to_id, kind, file, CAST(0 AS BIGINT) AS line FROM pairs),
busiest AS (SELECT from_id AS id FROM edges WHERE kind = 'calls' GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 1),
most_called AS (SELECT to_id AS id FROM edges WHERE kind = 'calls' GROUP BY to_id ORDER BY count(*) DESC, to_id LIMIT 1)
"""
