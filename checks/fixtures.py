"""Derived tables of the checks, one SQL text per table for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.catalog import DCT_TITLE, EX, RDF_TYPE, RDFS_LABEL, TEMPLATES, XSD, full

FILLERS = {  # placeholder -> SQL over the columns k (customer key), ok (order key), st (status)
    "$CU": f"'<{EX}customer/' || cast(k % 20 as string) || '>'",
    "$NA": f"'<{EX}nation/' || cast(k % 5 as string) || '>'",
    "$OK": f"'<{EX}order/' || cast(ok as string) || '>'",
    "$ST": "st",
    "$N3": "cast(k % 3 as string)",
    "$N5": "cast(k % 5 as string)",
    "$N7": "cast(k % 7 as string)",
    "$BS": "chr(92)",
    "$NL": "chr(10)",
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(column: str, used: str | None = None) -> str:
    """SQL that fills the placeholders of a column."""
    out = column
    for mark, value in FILLERS.items():
        out = f"replace({out}, '{mark}', {value})"
    return out


ORDER_KEYS = """SELECT o_orderkey AS qid, o_custkey AS k, o_orderkey AS ok, o_orderstatus AS st,
  CASE WHEN o_orderkey % 48 < 24 THEN o_orderkey % 12 ELSE o_orderkey % 48 - 12 END AS tmpl FROM {orders}"""


def values(rows: list[tuple], columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else quote(v)
    body = ",\n".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def query_log_sql() -> str:
    texts = values([(i, full(t.text)) for i, t in enumerate(TEMPLATES)], "tmpl, text")
    return f"SELECT qid, {fill('text')} AS query_text FROM ({ORDER_KEYS}) o JOIN ({texts}) t ON o.tmpl = t.tmpl"


def http_log_sql() -> str:
    encoded = "query_text"
    for char, code in (("'%'", "%25"), ("'<'", "%3C"), ("'>'", "%3E"), ("'?'", "%3F"), ("'#'", "%23"), ("'\"'", "%22"),
                       ("'{{'", "%7B"), ("'}}'", "%7D"), ("'+'", "%2B"), ("'&'", "%26"), ("chr(10)", "%0A"),
                       ("chr(92)", "%5C"), ("' '", "+")):
        encoded = f"replace({encoded}, {char}, '{code}')"
    return f"""SELECT event_id AS hit_id, ts,
  CASE event_id % 4 WHEN 0 THEN 'bio.example.org' WHEN 1 THEN 'www.bio.example.org'
                    WHEN 2 THEN 'other.example.net' ELSE 'example.org' END AS domain,
  'agent-' || cast(user_id % 9 as string) AS agent,
  CASE event_type
    WHEN 'error' THEN '/sparql?query=SELECT+?x+WHERE+%7B+?x+?p+%22BuyNow+Spam%22+%7D'
    WHEN 'signup' THEN '/about.html'
    WHEN 'click' THEN '/sparql?format=json&query=' || {encoded} || '%zz'
    ELSE '/sparql?query=' || {encoded} END AS url
FROM {{events}} e JOIN (LOG) l ON e.event_id = l.qid""".replace("{{events}}", "{events}").replace(
        "'{{'", "'{'").replace("'}}'", "'}'")


QUADS = f"""
SELECT '{EX}customer/' || cast(c_custkey as string) AS s, '{RDF_TYPE}' AS p, '{EX}class/Customer' AS o,
  'uri' AS o_kind, cast(NULL as string) AS datatype, cast(NULL as string) AS lang, '{EX}graph/crm' AS g FROM {{customer}}
UNION ALL SELECT '{EX}customer/' || cast(c_custkey as string), '{RDFS_LABEL}', c_name, 'literal', NULL, 'en',
  '{EX}graph/crm' FROM {{customer}}
UNION ALL SELECT '{EX}customer/' || cast(c_custkey as string), '{EX}p/nation',
  '{EX}nation/' || cast(c_nationkey as string), 'uri', NULL, NULL, '{EX}graph/crm' FROM {{customer}}
UNION ALL SELECT '{EX}nation/' || cast(n_nationkey as string), '{RDF_TYPE}', '{EX}class/Nation', 'uri', NULL, NULL,
  '{EX}graph/geo' FROM {{nation}}
UNION ALL SELECT '{EX}nation/' || cast(n_nationkey as string), '{DCT_TITLE}', n_name, 'literal', '{XSD}string', NULL,
  '{EX}graph/geo' FROM {{nation}}
UNION ALL SELECT '{EX}nation/' || cast(n_nationkey as string), '{EX}p/region',
  '{EX}region/' || cast(n_regionkey as string), 'uri', NULL, NULL, '{EX}graph/geo' FROM {{nation}}
UNION ALL SELECT '{EX}region/' || cast(r_regionkey as string), '{RDF_TYPE}', '{EX}class/Region', 'uri', NULL, NULL,
  '{EX}graph/geo' FROM {{region}}
UNION ALL SELECT '{EX}region/' || cast(r_regionkey as string), '{RDFS_LABEL}', r_name, 'literal', NULL, 'en',
  '{EX}graph/geo' FROM {{region}}
UNION ALL SELECT '{EX}order/' || cast(o_orderkey as string), '{RDF_TYPE}', '{EX}class/Order', 'uri', NULL, NULL,
  '{EX}graph/sales' FROM {{orders}}
UNION ALL SELECT '{EX}order/' || cast(o_orderkey as string), '{EX}p/customer',
  '{EX}customer/' || cast(o_custkey as string), 'uri', NULL, NULL, '{EX}graph/sales' FROM {{orders}}
UNION ALL SELECT '{EX}order/' || cast(o_orderkey as string), '{EX}p/status', o_orderstatus, 'literal',
  '{XSD}string', NULL, '{EX}graph/sales' FROM {{orders}}
UNION ALL SELECT '{EX}part/' || cast(p_partkey as string), '{EX}p/parent',
  '{EX}part/' || cast((p_partkey - p_partkey % 2) / 2 as bigint), 'uri', NULL, NULL, '{EX}graph/parts'
  FROM {{part}} WHERE p_partkey > 0
UNION ALL SELECT '{EX}class/Customer', '{RDFS_LABEL}', 'a customer', 'literal', NULL, 'en', '{EX}graph/crm'
  FROM {{region}} WHERE r_regionkey = 0
UNION ALL SELECT '{EX}class/Customer', '{RDFS_LABEL}', 'Client', 'literal', NULL, 'en', '{EX}graph/crm'
  FROM {{region}} WHERE r_regionkey = 0
UNION ALL SELECT '{EX}class/Order', '{DCT_TITLE}', 'Order title', 'literal', '{XSD}string', NULL, '{EX}graph/crm'
  FROM {{region}} WHERE r_regionkey = 0
UNION ALL SELECT '{EX}class/Order', '{RDFS_LABEL}', 'An order', 'literal', NULL, 'en', '{EX}graph/crm'
  FROM {{region}} WHERE r_regionkey = 0
""".replace("cast((p_partkey - p_partkey % 2) / 2 as bigint)",
            "cast(cast((p_partkey - p_partkey % 2) / 2 as bigint) as string)")

EQUIV = values([
    (EX + "p/nation", "place"), (EX + "p/region", "place"), (RDF_TYPE, "type"), (EX + "class/Customer", "party"),
], "term, class")

FAQ = values([
    ("Return all drugs and their names.", "ASK { ?variable1 ?predicate1 ?variable2 }", "ASK { ?s ?p ?o }"),
    ("Retrieve subjects of the triples in the graph", "SELECT ?variable1 { ?variable1 ?predicate1 ?variable2 }",
     "SELECT ?s { ?s ?p ?o }"),
    ("Number of Customers per nation", "SELECT ?variable1 { ?ent1 ?predicate1 ?variable1 }", "SELECT ?n { <x> ?p ?n }"),
], "question, pattern, instance")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _sources(names: dict[str, str]):
    return lambda sql: _format(sql, names)


def _format(sql: str, names: dict[str, str]) -> str:
    for name, source in names.items():
        sql = sql.replace("{" + name + "}", source)
    return sql


def derived_sql(names: dict[str, str]) -> dict[str, str]:
    """Texts of query_log, http_log, quads with the given table sources."""
    log = query_log_sql()
    return {
        "query_log": _format(log, names),
        "http_log": _format(http_log_sql().replace("(LOG)", f"({log})"), names),
        "quads": _format(QUADS, names),
        "equiv": EQUIV,
        "faq": FAQ,
    }


class Fixture:
    """The derived tables of one data directory as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._sql = derived_sql({t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES})

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self, df: DataFrame, source: str) -> DataFrame:
        """Test tables are one file with one row group; spread the log when its scan has fewer tasks than cores."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if self.table(source).rdd.getNumPartitions() >= cores else df.repartition(cores)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("query_log", "http_log"):
            return self._spread(self.spark.sql(self._sql[name]), "orders" if name == "query_log" else "events")
        if name in ("quads", "equiv", "faq"):
            return self.spark.sql(self._sql[name])
        raise AttributeError(name)
