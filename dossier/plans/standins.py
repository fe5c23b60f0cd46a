"""The test tables seen as the corpus tables.

Each stand-in is a renaming: one expression per column over one test table. The same
expressions serve the DataFrames and the check SQL, so both start from equal inputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# orders as reports; the head pointer is stored with the report, as in the real table
REPORTS = {
    "id": "o_orderkey",
    "title": "o_orderpriority || ' Outlook'",
    "broker": "'Broker ' || CAST(o_custkey % 10 AS VARCHAR(20))",
    "publish_date": "CAST(o_orderdate AS DATE)",
    "deleted": "o_orderstatus = 'P'",
    "current_analysis_id": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderkey * 2 + o_custkey % 2 END",
    "author_id": "o_custkey",
    "action_word": "CASE WHEN o_totalprice > 400000 THEN '强推' WHEN o_totalprice > 300000 THEN '增持' WHEN o_totalprice > 200000 THEN '持有' WHEN o_totalprice > 100000 THEN '卖出' ELSE '看看' END",
    "created_by": "o_custkey",
}

# lineitem as the target and theme projections of two analysis versions per report
LINKS = {
    "report_id": "l_orderkey",
    "analysis_id": "l_orderkey * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "theme_id": "l_partkey",
    "code_no": "l_suppkey",
    "target_code": "LPAD(CAST(l_suppkey AS VARCHAR(20)), 6, '0')",
    "stance": "CASE l_returnflag WHEN 'A' THEN '推荐' WHEN 'R' THEN '回避' ELSE '提及' END",
    "linked_on": "CAST(l_shipdate AS DATE)",
    "line_no": "l_linenumber",
    "amount": "l_extendedprice",
}

# part as the theme vocabulary
THEMES = {
    "id": "p_partkey",
    "name": "p_name || ' ' || p_brand",
    "status": "CASE WHEN p_size <= 30 THEN 'active' WHEN p_size <= 38 THEN 'pending' WHEN p_size <= 44 THEN 'merged' ELSE 'retired' END",
    "synonym": "p_name || ' ' || p_type",
    "merged_into_id": "CASE WHEN p_size > 38 AND p_size <= 44 AND p_partkey >= p_size THEN p_partkey - p_size ELSE NULL END",
    "seed_code": "'BK' || CAST(p_partkey AS VARCHAR(20))",
    "source": "CASE WHEN p_retailprice > 950 THEN 'seed_sw' ELSE 'seed_em' END",
}

# supplier as the security master, customer as a second list of securities and as authors
TARGETS = {
    "code": "LPAD(CAST(s_suppkey AS VARCHAR(20)), 6, '0')",
    "name": "s_name",
    "l2_key": "s_nationkey",
    "balance": "s_acctbal",
}
AUTHORS = {
    "id": "c_custkey",
    "name": "c_name",
    "cert": "CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE NULL END",
}

# documents as report bodies
BODIES = {
    "doc_id": "doc_id",
    "title": r"REGEXP_EXTRACT(text, '^[^\n]*', 0)",
    "broker": "source",
    "body": "text",
    "lang": "lang",
}

# conversations as version chains
VERSIONS = {
    "report_id": "conv_id",
    "version": "turn",
    "model": "role",
    "result_text": "text",
}

# events as the connector log and as discovered references; user = subscription
EVENTS = {
    "event_id": "event_id",
    "subscription_id": "user_id",
    "seen_at": "ts",
    "day": "CAST(ts AS DATE)",
    "event": "event_type",
    "failed": "event_type = 'error'",
    "k": "CAST(REGEXP_REPLACE(props, '[^0-9]', '', 'g') AS INT)",
    "amount": "value",
}

_SOURCES = {
    "reports": ("orders", REPORTS),
    "links": ("lineitem", LINKS),
    "themes": ("part", THEMES),
    "targets": ("supplier", TARGETS),
    "authors": ("customer", AUTHORS),
    "bodies": ("documents", BODIES),
    "versions": ("conversations", VERSIONS),
    "log": ("events", EVENTS),
}


def spark_columns(columns: dict[str, str]) -> list[str]:
    """The expressions as Spark takes them: its REGEXP_REPLACE has no flags, it replaces all."""
    return [f"{expr.replace(", 'g')", ')')} AS {col}" for col, expr in columns.items()]


def ctes(*names: str) -> str:
    """``WITH`` clause with the named stand-ins for the check SQL."""
    parts = []
    for name in names:
        table, columns = _SOURCES[name]
        cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
        parts.append(f"{name} AS (SELECT {cols} FROM {table})")
    return "WITH " + ", ".join(parts)


class Tables:
    """Test tables and stand-ins of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A test table; its footer is read once per query."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def spread(self, rows: DataFrame) -> DataFrame:
        """Deal rows of a table with fewer files than cores out evenly before CPU-heavy work.

        The test tables are single files of one row group; a real table has many and stays as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows

    def _standin(self, name: str) -> DataFrame:
        table, columns = _SOURCES[name]
        return self.raw(table).selectExpr(*spark_columns(columns))

    @cached_property
    def reports(self) -> DataFrame:
        return self._standin("reports")

    @cached_property
    def links(self) -> DataFrame:
        return self._standin("links")

    @cached_property
    def themes(self) -> DataFrame:
        return self._standin("themes")

    @cached_property
    def targets(self) -> DataFrame:
        return self._standin("targets")

    @cached_property
    def authors(self) -> DataFrame:
        return self._standin("authors")

    @cached_property
    def bodies(self) -> DataFrame:
        return self._standin("bodies")

    @cached_property
    def versions(self) -> DataFrame:
        return self._standin("versions")

    @cached_property
    def log(self) -> DataFrame:
        return self._standin("log")
