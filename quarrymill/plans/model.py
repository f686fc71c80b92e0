"""The semantic document: loading, saving, views as DataFrames, and a hand-declared model of the driver tables."""

from __future__ import annotations

import copy
import json
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:
    yaml = None

VERSION = "0.1"


def load(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    doc = yaml.safe_load(text) if yaml else json.loads(text)
    if not isinstance(doc, dict) or "semantic_layer" not in doc:
        raise ValueError(f"{path}: no semantic_layer at the root")
    return doc["semantic_layer"]


def save(doc: dict, path: str | Path) -> None:
    root = {"semantic_layer": doc}
    Path(path).write_text(yaml.safe_dump(root, sort_keys=False, allow_unicode=True) if yaml else json.dumps(root, indent=2, ensure_ascii=False), encoding="utf-8")


def new(name: str, tables: list[dict]) -> dict:
    return {"spec_version": VERSION, "name": name, "generated_by": "quarrymill", "tables": tables}


def columns_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(t["name"], c["name"], c["sql_type"], c["semantic_type"], c["entity_role"], float(c.get("confidence", 1.0)), c.get("lifecycle", ""), c.get("foreign_key", {}).get("references")) for t in doc["tables"] for c in t["columns"]]
    return spark.createDataFrame(rows, "table string, column string, sql_type string, semantic_type string, entity_role string, confidence double, lifecycle string, references string")


def tables_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(t["name"], t.get("source", ""), t.get("table_type", "unknown"), t.get("lifecycle", ""), t.get("primary_key", []), t.get("description")) for t in doc["tables"]]
    return spark.createDataFrame(rows, "table string, source string, table_type string, lifecycle string, primary_key array<string>, description string")


def relationships_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(r["name"], r["from"]["table"], r["from"]["columns"], r["to"]["table"], r["to"]["columns"], r.get("cardinality"), float(r.get("confidence", 1.0))) for r in doc.get("relationships", [])]
    return spark.createDataFrame(rows, "name string, from_table string, from_columns array<string>, to_table string, to_columns array<string>, cardinality string, confidence double")


def metrics_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(m["name"], m.get("type", "simple"), m.get("measure") or f"{m.get('numerator')} / {m.get('denominator')}", m.get("agg"), m.get("filter"), float(m.get("confidence", 1.0))) for m in doc.get("metrics", [])]
    return spark.createDataFrame(rows, "metric string, type string, measure string, agg string, filter string, confidence double")


def aggregates_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(a["table"], a["aggregates"], a["grain"], [f"{m['source']} -> {m['target']}" for m in a["measure_mappings"]], a["routing"]["status"]) for a in doc.get("aggregate_tables", [])]
    return spark.createDataFrame(rows, "table string, aggregates string, grain array<string>, mappings array<string>, status string")


def routing_frame(spark: SparkSession, doc: dict) -> DataFrame:
    rows = [(r["intent"], r["use"], [a["table"] for a in r.get("avoid", [])]) for r in doc.get("repo_knowledge", {}).get("routing", [])]
    return spark.createDataFrame(rows, "intent string, use array<string>, avoid array<string>")


def _table(name: str, key: str, **columns: str) -> dict:
    """Columns as ``name="TYPE semantic_type role"``."""
    out = []
    for c, text in columns.items():
        sql_type, kind, role = text.split()
        out.append({"name": c, "sql_type": sql_type, "semantic_type": kind, "entity_role": role, "lifecycle": "certified"})
    return {"name": name, "source": name, "table_type": "unknown", "lifecycle": "certified", "primary_key": [key], "columns": out}


@cache
def _driver_model() -> dict:
    key, fk, dim = "identifier primary_key", "identifier foreign_key", "dimension"
    tables = [
        _table("region", "r_regionkey", r_regionkey=f"INTEGER {key}", r_name=f"VARCHAR name {dim}"),
        _table("nation", "n_nationkey", n_nationkey=f"INTEGER {key}", n_name=f"VARCHAR name {dim}", n_regionkey=f"INTEGER {fk}"),
        _table("customer", "c_custkey", c_custkey=f"BIGINT {key}", c_name=f"VARCHAR name {dim}", c_nationkey=f"INTEGER {fk}", c_acctbal="DOUBLE monetary_value measure", c_mktsegment=f"VARCHAR enum {dim}"),
        _table("orders", "o_orderkey", o_orderkey=f"BIGINT {key}", o_custkey=f"BIGINT {fk}", o_orderstatus=f"VARCHAR status_code {dim}", o_totalprice="DOUBLE monetary_value measure", o_orderdate=f"TIMESTAMP timestamp_event {dim}", o_orderpriority=f"VARCHAR enum {dim}"),
        _table("lineitem", "l_orderkey", l_orderkey=f"BIGINT {fk}", l_partkey=f"BIGINT {fk}", l_suppkey=f"BIGINT {fk}", l_quantity="DOUBLE quantity measure", l_extendedprice="DOUBLE monetary_value measure", l_discount="DOUBLE rate measure", l_returnflag=f"VARCHAR code {dim}", l_linestatus=f"VARCHAR code {dim}", l_shipdate=f"TIMESTAMP timestamp_event {dim}"),
    ]

    def rel(a: str, x: str, b: str, y: str) -> dict:
        return {"name": f"{a}_to_{b}", "from": {"table": a, "columns": [x]}, "to": {"table": b, "columns": [y]}, "cardinality": "many_to_one", "join_type": "left", "fanout_risk": False, "lifecycle": "certified"}

    doc = new("driver", tables)
    doc["relationships"] = [rel("nation", "n_regionkey", "region", "r_regionkey"), rel("customer", "c_nationkey", "nation", "n_nationkey"), rel("orders", "o_custkey", "customer", "c_custkey"), rel("lineitem", "l_orderkey", "orders", "o_orderkey")]
    simple = lambda n, m, agg, **kw: {"name": n, "type": "simple", "measure": m, "agg": agg, "lifecycle": "certified"} | kw
    doc["metrics"] = [
        simple("revenue", "orders.o_totalprice", "sum", filter="o_orderstatus <> 'P'", agg_time_dimension="orders.o_orderdate"),
        simple("buyers", "orders.o_custkey", "count_distinct", agg_time_dimension="orders.o_orderdate"),
        simple("typical_balance", "customer.c_acctbal", "median"),
        simple("line_amount", "lineitem.l_extendedprice", "sum", agg_time_dimension="lineitem.l_shipdate"),
        {"name": "keys_per_customer", "type": "ratio", "numerator": "orders.o_orderkey", "denominator": "orders.o_custkey", "lifecycle": "certified", "agg_time_dimension": "orders.o_orderdate"},
        {"name": "spread", "type": "derived", "expr": "revenue - line_amount", "input_metrics": ["revenue", "line_amount"], "lifecycle": "certified"},
    ]
    return doc


def driver_model() -> dict:
    return copy.deepcopy(_driver_model())
