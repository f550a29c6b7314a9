"""Property graphs over the fixture tables: nodes (id, type, name, address, flags) and edges (source_id, target_id, type).

Tables of this shape from elsewhere go through the same operators. Layers: customers call orders, orders call parts and
suppliers; nations contain suppliers and customers, regions contain nations. Chain: a part calls the part of the next
line of the same order, for lines of at least a given quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources.tables import table

#: Quantities that give a sparse, shallow chain graph and a denser one with cycles.
SPARSE, DENSE = 50, 47
#: Lines or orders to a task where their calls are made distinct.
LINES = 1 << 19


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _flags(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, flag) for rule, flag in rules]))


def customer_flags() -> Column:
    return _flags((F.col("c_mktsegment") == "MACHINERY", "HANDLES_USER_INPUT"), (F.col("c_acctbal") < 0, "BUFFER_OVERFLOW_RISK"))


def part_flags() -> Column:
    size = F.col("p_size")
    return _flags((size <= 2, "NETWORK_CAPABLE"), (size == 3, "ENTRY_POINT"), (size >= 49, "COMMAND_INJECTION_RISK"), (size.between(47, 48), "BUFFER_OVERFLOW_RISK"), (size.between(45, 46), "PATH_TRAVERSAL_RISK"))


def layer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nodes(name: str, prefix: str, key: str, kind: str, called: Column, flags: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), called.cast("string").alias("name"), F.col(key).cast("long").alias("address"), flags.alias("flags"))

    none = F.array().cast("array<string>")
    return (
        nodes("customer", "c:", "c_custkey", "FUNCTION", F.col("c_name"), customer_flags())
        .unionByName(nodes("orders", "o:", "o_orderkey", "FUNCTION", F.lit(None), _flags((F.col("o_orderpriority") == "1-URGENT", "NETWORK_CAPABLE"))))
        .unionByName(nodes("part", "p:", "p_partkey", "FUNCTION", F.col("p_name"), part_flags()))
        .unionByName(nodes("supplier", "s:", "s_suppkey", "FUNCTION", F.col("s_name"), _flags((F.col("s_acctbal") < 0, "COMMAND_INJECTION_RISK"))))
        .unionByName(nodes("nation", "n:", "n_nationkey", "MODULE", F.col("n_name"), none))
        .unionByName(nodes("region", "r:", "r_regionkey", "BINARY", F.col("r_name"), none))
    )


def _edges(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"))


def layer_calls(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    """Calls of customers, orders' calls of parts and suppliers each once; with `unique` the former as well, should orders repeat.

    Rows are dealt out by their order, LINES to a task, and made distinct there, so that a task's memory has a bound.
    """

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(df.count() // LINES + 1, key)

    lines = dealt(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    orders = dealt(orders, "o_orderkey").distinct() if unique else orders
    order = _id("o:", "l_orderkey")
    return (
        _edges(orders, _id("c:", "o_custkey"), _id("o:", "o_orderkey"), "CALLS")
        .unionByName(_edges(lines.select("l_orderkey", "l_partkey").distinct(), order, _id("p:", "l_partkey"), "CALLS"))
        .unionByName(_edges(lines.select("l_orderkey", "l_suppkey").distinct(), order, _id("s:", "l_suppkey"), "CALLS"))
    )


def layer_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _edges(table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey"), _id("r:", "n_regionkey"), _id("n:", "n_nationkey"), "CONTAINS")
        .unionByName(_edges(table(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey"), _id("n:", "s_nationkey"), _id("s:", "s_suppkey"), "CONTAINS"))
        .unionByName(_edges(table(spark, sf_dir, "customer", "c_nationkey", "c_custkey"), _id("n:", "c_nationkey"), _id("c:", "c_custkey"), "CONTAINS"))
    )


def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: id, address and flags; ids are the numbers themselves."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return parts.select(F.col("p_partkey").alias("id"), F.lit("FUNCTION").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("address"), part_flags().alias("flags"))


def chain_calls(spark: SparkSession, sf_dir: str, quantity: int = DENSE) -> DataFrame:
    """Distinct calls between parts on neighbouring lines of an order, from lines of `quantity` or more."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = lines.filter(F.col("l_quantity") >= quantity).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source_id"))
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_id"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).filter("source_id != target_id").select("source_id", "target_id").distinct()
    return pairs.withColumn("type", F.lit("CALLS"))
