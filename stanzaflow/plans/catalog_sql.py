"""More of the catalog: queries in SQL by table functions, and tables published in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stanzaflow.operators import tables
from stanzaflow.plans import catalog_more as more
from stanzaflow.plans.catalog import SQL, query, table
from stanzaflow.sources import published
from stanzaflow.sources.scratch import new_path


def _documents(spark, d) -> str:
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("catalog_documents")
    return "TABLE(catalog_documents), key => array('doc_id')"


@query("sql_dated_sections", SQL["section_split"])
def _(spark, d):
    return spark.sql(
        f"SELECT doc_id, CAST(offset AS BIGINT) AS offset, ganzhi AS head, year, md5(text) AS digest FROM dated_sections({_documents(spark, d)}, "
        "header => :header, numerals => :numerals, digits => '0123456789')",
        {"header": more._HEADER, "numerals": more._NUMERALS},
    )


@query("sql_dated_quotes", SQL["asof_marker"])
def _(spark, d):
    return spark.sql(
        f"SELECT doc_id, CAST(offset AS BIGINT) AS offset, marker, year FROM dated_quotes({_documents(spark, d)}, "
        "quote => :quote, keep => 'A-Za-z', least => 0, markers => :markers, years => :years)",
        {"quote": more._QUOTE, "markers": F.array(*[F.lit(m) for m, _ in more._MARKS]), "years": F.array(*[F.lit(y) for _, y in more._MARKS])},
    )


@query("sql_verses", SQL["prose_gate"])
def _(spark, d):
    return spark.sql(
        f"SELECT doc_id, CAST(start AS BIGINT) AS start, lines FROM verses({_documents(spark, d)}, "
        "lengths => array(6, 9, 12), least => 2, prose => 'wmbz', ends => :ends, keep => 'A-Za-z')",
        {"ends": more._ENDS},
    )


_OF = "o_custkey long, status string, price double"


@query(
    "published_merge",
    """SELECT o_custkey, arg_max(o_orderstatus, place) AS status, arg_max(o_totalprice, place) AS price
FROM (SELECT *, o_orderkey + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1000000000000 END AS place FROM orders) GROUP BY o_custkey""",
)
def _(spark, d):
    """Each customer's last order: the finished ones published first, the others laid over them as the next version."""
    path = new_path(spark)
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    published.merge_jsonl(_last(orders.filter("status = 'F'")), path, _OF, ["o_custkey"], "seq")
    published.merge_jsonl(_last(orders.filter("status <> 'F'")), path, _OF, ["o_custkey"], "seq")
    return published.read(spark, path, _OF)


def _last(rows: DataFrame) -> DataFrame:
    """The last of each customer's rows, so that a first version holds one row a key."""
    return rows.groupBy("o_custkey").agg(F.max_by(F.struct("status", "price", "seq"), "seq").alias("last")).select("o_custkey", "last.*")


@query("published_csv", "SELECT o_orderkey, o_orderpriority, printf('%.3f', o_totalprice / 7) AS seventh FROM orders")
def _(spark, d):
    path = new_path(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice").cast("double") / 7).alias("seventh"))
    published.write_csv(orders, path, ["o_orderkey"], ["seventh"])
    return published.read(spark, path, "o_orderkey long, o_orderpriority string, seventh string")


@query("published_append", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(spark, d):
    """Events appended a type at a time; each append writes its own lines only."""
    path = new_path(spark)
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    published.write_jsonl(events.filter("event_type = 'purchase'"), path)
    published.write_jsonl(events.filter("event_type <> 'purchase' OR event_type IS NULL"), path, append=True)
    rows = published.read(spark, path, "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
