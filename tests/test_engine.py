import json
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.names import looks_like_key, similarity
from quarrymill.operators import aggregates as A
from quarrymill.operators import hierarchy, joins
from quarrymill.plans import drift as D
from quarrymill.plans import export, graph, link, review, scoring, search
from quarrymill.plans.assistant import Recorded, Scripted, answer, parse_json, score
from quarrymill.plans.compile import Compiled, Graph, Refusal, compile_metric, run_sql
from quarrymill.plans.infer import infer
from quarrymill.plans.model import driver_model, load, save
from quarrymill.plans.typing import classify
from quarrymill.plans.validate import validate
from quarrymill.sources.context import Bundle, apply_dictionary, decode_claims, dictionary, ratio_claims, split
from quarrymill.sources.tables import Frames, ParquetDir, open_source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mart(spark):
    """A small mart without declared keys: a fact, decode tables, a daily aggregate that leaves out one status, an old copy."""
    rng = random.Random(11)
    days = [date(2024, 1, 1) + timedelta(d) for d in range(60)]
    orders = [(i, f"C{rng.randint(1, 40):03d}", 1 + rng.randint(0, 7), rng.choice(days), rng.choice("PCCCX"), Decimal(rng.randint(100, 90000)) / 100) for i in range(1, 801)]
    daily = {}
    for o in orders:
        if o[4] != "X":
            daily[o[3]] = daily.get(o[3], Decimal(0)) + o[5]
    make = spark.createDataFrame
    frames = {
        "ord_hdr": make(orders, "ord_id int, cust_id string, store_id int, ord_dt date, sts_cd string, tot_amt decimal(12,2)"),
        "cust_mstr": make([(f"C{i:03d}", f"Name {i}", f"c{i}@example.com") for i in range(1, 41)], "cust_id string, cust_nm string, email string"),
        "store_dim": make([(i, f"Store {i}", "north" if i % 2 else "south") for i in range(1, 9)], "store_id int, store_nm string, area_cd string"),
        "sts_cd_dim": make([("P", "Pending"), ("C", "Complete"), ("X", "Cancelled")], "sts_cd string, sts_desc string"),
        "dly_sls_agg": make([(int(f"{d:%Y%m%d}"), t) for d, t in daily.items()], "agg_dt_key int, tot_sls_amt decimal(14,2)"),
        "ord_hdr_legacy": make([(i, Decimal(i)) for i in range(1, 20)], "order_number int, amount decimal(12,2)"),
        "emp": make([(i, None if i == 1 else i // 3 + (i < 3), f"E{i}") for i in range(1, 60)], "emp_id int, mgr_id int, emp_nm string"),
    }
    return Frames(frames)


@pytest.fixture(scope="module")
def inferred(spark, mart):
    return infer(spark, mart, "mart")


def test_inference(inferred, tmp_path):
    doc, report = inferred
    assert validate(doc) == []
    links = {(f"{r['from']['table']}.{r['from']['columns'][0]}", f"{r['to']['table']}.{r['to']['columns'][0]}") for r in doc["relationships"]}
    assert {("ord_hdr.cust_id", "cust_mstr.cust_id"), ("ord_hdr.store_id", "store_dim.store_id"), ("ord_hdr.sts_cd", "sts_cd_dim.sts_cd")} <= links
    columns = {f"{t['name']}.{c['name']}": c for t in doc["tables"] for c in t["columns"]}
    assert columns["cust_mstr.email"]["pii"] and columns["ord_hdr.tot_amt"]["semantic_type"] == "monetary_value"
    assert {v["value"]: v["meaning"] for v in columns["ord_hdr.sts_cd"]["enum_values"]} == {"P": "Pending", "C": "Complete", "X": "Cancelled"}
    metrics = {m["name"]: m for m in doc["metrics"]}
    assert metrics["total_tot_amt"]["filter"] == "sts_cd <> 'X'"
    assert metrics["total_tot_amt_completed"]["filter"] == "sts_cd IN ('C')"
    assert "filter" not in metrics["ord_hdr_count"]
    assert doc["aggregate_tables"][0]["routing"]["status"] == "advisory"
    old = next(t for t in doc["tables"] if t["name"] == "ord_hdr_legacy")
    assert old["lifecycle"] == "deprecated" and old["deprecation"]["replacement"] == "ord_hdr"
    assert any(h["kind"] == "recursive" and h["dimension_table"] == "emp" for h in doc["hierarchies"])
    assert doc["repo_knowledge"]["routing"][0]["use"] == ["ord_hdr"]
    save(doc, tmp_path / "m.yaml")
    assert load(tmp_path / "m.yaml") == json.loads(json.dumps(doc))
    assert report.counts["tables"] == 7 and set(report.seconds) >= {"profile", "link", "enrich"}


def test_compiled_metric_runs_as_frame_and_text(spark, mart, inferred):
    doc, _ = inferred
    out = compile_metric(doc, "total_tot_amt", ["store_dim.area_cd"], time_grain="month", time_start="2024-01-01", time_end="2024-02-01", source=mart)
    assert isinstance(out, Compiled)
    want = mart.df("ord_hdr").where("sts_cd <> 'X' and ord_dt < '2024-02-01'").join(mart.df("store_dim"), "store_id", "left").groupBy("area_cd").agg(F.sum("tot_amt")).collect()
    assert {(r["area_cd"], r["total_tot_amt"]) for r in out.df.collect()} == {tuple(r) for r in want}
    assert [tuple(r) for r in run_sql(spark, mart, doc, out.sql).collect()] == [tuple(r) for r in out.df.collect()]
    assert search.tools(doc)["compile_metric"]("total_tot_amt", "ord_hdr.sts_cd")["sql"].startswith("SELECT")


def test_traps_are_not_accepted(spark):
    frames = Frames(
        {
            "shoes": spark.createDataFrame([(i, i % 12 + 1) for i in range(1, 100)], "sku_id int, shoe_size int"),
            "departments": spark.createDataFrame([(i, f"D{i}") for i in range(1, 51)], "dept_id int, dept_nm string"),
            "reviews": spark.createDataFrame([(i, i % 5 + 1) for i in range(1, 80)], "review_id int, rating int"),
            "carriers": spark.createDataFrame([(i, f"X{i}") for i in range(1, 9)], "carrier_id int, carrier_nm string"),
        }
    )
    doc, report = infer(spark, frames, "traps")
    assert doc["relationships"] == [] and "shoes.shoe_size -> departments.dept_id" in report.audit["review"]


def test_language_model_can_only_object(spark, mart):
    def say(system, user):
        if "plausible" in system:
            return [{"n": p["n"], "verdict": "implausible" if p["child"].endswith("store_id") else "plausible"} for p in json.loads(user)]
        return []

    provider = Scripted(say)
    doc, report = infer(spark, Frames({k: mart.frames[k] for k in ("ord_hdr", "cust_mstr", "store_dim")}), "m", provider)
    assert [r["to"]["table"] for r in doc["relationships"]] == ["cust_mstr"] and report.audit["killed"] == ["ord_hdr.store_id -> store_dim.store_id"] and report.llm_calls


def test_names():
    assert similarity("cust_id", "cust_mstr", "cust_id") == 1.2
    assert similarity("o_custkey", "customer", "c_custkey") == 0.9
    assert similarity("ship_customer_id", "customer", "customer_id") == 0.9
    assert similarity("rating", "carriers", "carrier_id") < 0.35
    assert looks_like_key("sts_cd") and not looks_like_key("o_custkey")


def test_fused_key_names_are_opt_in(spark):
    source = Frames({n: ParquetDir(spark, SF).df(n) for n in ("orders", "customer")})
    assert not infer(spark, source, "d")[0]["relationships"]
    assert [r["name"] for r in infer(spark, source, "d", key_suffixes=("key",))[0]["relationships"] if r["from"]["table"] == "orders"] == ["orders_to_customer"]


def test_refusals():
    doc = driver_model()
    say = lambda *a, **k: compile_metric(doc, *a, **k).reason
    assert "unknown metric" in say("nope")
    assert "measure" in say("revenue", ["orders.o_totalprice"])
    assert "unknown column" in say("revenue", ["orders.nope"]) and "unknown column" in say("revenue", extra_filter="bogus = 1")
    assert "can't be reached" in say("line_amount", ["region.r_name"])  # four hops
    assert "derived" in say("spread") and "no time dimension" in say("typical_balance", time_grain="month")
    assert "not a condition" in say("revenue", extra_filter="1 = 1; drop table orders")
    assert "functions" in say("revenue", extra_filter="reflect('java.lang.System', 'exit') = 1")
    refusal = compile_metric(doc, "revenue", ["nope"])
    assert "nation.n_name" in refusal.group_bys and "month" in refusal.grains
    doc["metrics"].append({"name": "cross", "type": "ratio", "numerator": "orders.o_totalprice", "denominator": "customer.c_acctbal"})
    assert "across tables" in say("cross")
    doc["metrics"].append({"name": "by_name", "type": "ratio", "numerator": "revenue", "denominator": "buyers"})
    assert isinstance(compile_metric(doc, "by_name"), Compiled) and validate(doc) == []
    doc["metrics"][0]["lifecycle"] = "orphaned"
    assert "orphaned" in say("revenue")


def diamond(*edges):
    names = sorted({x for e in edges for x in e[:2]})
    tables = [{"name": n, "columns": [{"name": f"{n}_x", "sql_type": "VARCHAR", "semantic_type": "name", "entity_role": "dimension"}]} for n in names]
    rels = [{"name": f"{a}_{b}_{i}", "from": {"table": a, "columns": [f"{a}_x"]}, "to": {"table": b, "columns": [f"{b}_x"]}} for i, (a, b) in enumerate(edges)]
    return {"tables": tables, "relationships": rels, "metrics": [{"name": "n", "measure": "f.f_x", "agg": "count"}]}


def test_ambiguous_paths():
    doc = diamond(("f", "a"), ("f", "b"), ("a", "z"), ("b", "z"), ("z", "y"))
    assert Graph(doc, "f").ambiguous == {"z", "y"}
    assert "ambiguous" in compile_metric(doc, "n", ["y.y_x"]).reason
    assert not Graph(diamond(("f", "z"), ("f", "a"), ("a", "z")), "f").ambiguous
    assert Graph(diamond(("f", "d"), ("f", "d")), "f").ambiguous == {"d"}
    assert "z.z_x" not in compile_metric(doc, "n", ["nope"]).group_bys


def test_fiscal_calendar(spark):
    days = [date(2023, 1, 1) + timedelta(d) for d in range(731)]
    dates = [(int(f"{d:%Y%m%d}"), d, d.year, (d.month - 1) // 3 + 1, d.year + (d.month >= 2), (d.month + 10) % 12 // 3 + 1) for d in days]
    source = Frames(
        {
            "dt_dim": spark.createDataFrame(dates, "date_key int, cal_dt date, yr_nbr int, qtr_nbr int, fis_yr int, fis_qtr int"),
            "sls_fct": spark.createDataFrame([(i, dates[i // 2][0], 1.5) for i in range(1462)], "sls_id int, date_key int, amt double"),
        }
    )
    doc, _ = infer(spark, source, "fiscal")
    marks = {c["name"]: c.get("time_attribute") for t in doc["tables"] for c in t["columns"]}
    assert (marks["qtr_nbr"], marks["fis_qtr"], marks["yr_nbr"], marks["fis_yr"]) == ("calendar_quarter", "fiscal_quarter", "calendar_year", "fiscal_year")
    ask = lambda **k: compile_metric(doc, "total_amt", source=source, **k)
    assert isinstance(ask(time_grain="quarter"), Refusal) and isinstance(ask(time_grain="month"), Compiled)
    fiscal, plain = ask(time_grain="quarter", calendar="fiscal").df.collect(), ask(time_grain="quarter", calendar="calendar").df.collect()
    assert len(plain) == 8 and len(fiscal) == 9 and sum(r["total_amt"] for r in fiscal) == sum(r["total_amt"] for r in plain)


def test_versions_and_snapshots_in_metrics(spark):
    d = date
    source = Frames(
        {
            "sales": spark.createDataFrame([(1, "a", d(2024, 1, 5), 1.0), (2, "a", d(2024, 3, 5), 2.0)], "id int, cust string, dt date, amt double"),
            "cust": spark.createDataFrame([(1, "a", "north", d(2024, 1, 1), d(2024, 2, 1)), (2, "a", "south", d(2024, 2, 2), None)], "sk int, cust string, area string, f date, t date"),
            "stock": spark.createDataFrame([(d(2024, 1, 1), "x", 5), (d(2024, 1, 2), "x", 7), (d(2024, 1, 2), "y", 1)], "snap date, item string, qty int"),
        }
    )
    column = lambda n, t="VARCHAR", r="dimension", **kw: {"name": n, "sql_type": t, "semantic_type": "unknown", "entity_role": r} | kw
    link = {"name": "r", "from": {"table": "sales", "columns": ["cust"]}, "to": {"table": "cust", "columns": ["cust"]}}
    doc = {
        "tables": [
            {"name": "sales", "columns": [column("id"), column("cust"), column("dt", "DATE"), column("amt", "DOUBLE", "measure")]},
            {"name": "cust", "primary_key": ["sk"], "scd": {"valid_from": "f", "valid_to": "t"}, "columns": [column("sk"), column("cust"), column("area"), column("f", "DATE"), column("t", "DATE")]},
            {"name": "stock", "columns": [column("snap", "DATE"), column("item"), column("qty", "INTEGER", "measure", aggregations={"semi_additive": {"over": "snap"}})]},
        ],
        "relationships": [link],
        "metrics": [{"name": "m", "measure": "sales.amt", "agg": "sum", "agg_time_dimension": "sales.dt"}, {"name": "q", "measure": "stock.qty", "agg": "sum"}],
    }
    assert "as-of" in compile_metric(doc, "m", ["cust.area"]).reason
    link["asof"] = {"enabled": True, "on": "sales.dt"}
    out = compile_metric(doc, "m", ["cust.area"], source=source)
    assert [tuple(r) for r in out.df.collect()] == [("north", 1.0), ("south", 2.0)] == [tuple(r) for r in run_sql(spark, source, doc, out.sql).collect()]
    out = compile_metric(doc, "q", source=source)
    assert out.df.first()["q"] == 8 == run_sql(spark, source, doc, out.sql).first()["q"]
    assert {r["snap"]: r["q"] for r in compile_metric(doc, "q", ["stock.snap"], source=source).df.collect()} == {d(2024, 1, 1): 5, d(2024, 1, 2): 8}
    assert "DATE_TRUNC(`sales`.`dt`, MONTH)" in compile_metric(doc, "m", time_grain="month", dialect="bigquery").sql
    assert "unknown dialect" in compile_metric(doc, "m", dialect="x").reason


def test_fan_trap(spark):
    rows = [(o, 100.0, p, s) for o in range(50) for p in range(o % 3 + 1) for s in range(o % 2 + 1)]
    df = spark.createDataFrame(rows, "order_id int, total double, payment int, shipment int")
    assert A.once_per_key(df, "order_id", "total").first()["total"] == 5000 < df.agg(F.sum("total")).first()[0]


def test_versions(spark):
    d = date
    versions = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 31), "a"), (1, d(2024, 2, 1), None, "b"), (2, d(2024, 1, 1), d(2024, 3, 1), "c"), (2, d(2024, 2, 1), None, "d")], "k int, f date, t date, v string")
    facts = spark.createDataFrame([(1, d(2024, 1, 31)), (1, d(2024, 2, 1)), (2, d(2024, 2, 15)), (3, d(2024, 2, 15))], "k int, on date")
    got = joins.as_of(facts, versions, ["k"], "on", "f", "t", "left").collect()
    assert sorted((r["k"], r["v"]) for r in got if r["v"]) == [(1, "a"), (1, "b"), (2, "d")] and len(got) == 4
    assert [r["v"] for r in joins.overlaps(versions, ["k"], "f", "t").collect()] == ["d"]


def test_hierarchies(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "p int, c int")
    assert {r["id"] for r in hierarchy.in_cycles(edges, "p", "c").collect()} == {1, 2, 3}
    assert hierarchy.in_cycles(edges.where("p <> 3"), "p", "c").count() == 0


def test_long_chains_and_long_rings(spark):
    from quarrymill.operators import hierarchy

    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(60)], "id long, up long")
    assert hierarchy.depths(chain, "id", "up").groupBy().max("level").first()[0] == 60
    two = [(i, (i + 1) % 25) for i in range(25)] + [(100 + i, 100 + (i + 1) % 4) for i in range(4)] + [(24, 50), (50, 100), (7, 60), (70, 70)]
    found = {r["id"] for r in hierarchy.in_cycles(spark.createDataFrame(two, "p long, c long"), "p", "c").collect()}
    assert found == {*range(25), *range(100, 104), 70}


def test_numbers_compare_as_numbers(spark):
    from decimal import Decimal

    from quarrymill.operators import joins

    small = spark.createDataFrame([(1e-12,), (3.0,), (float("nan"),)], "x double")
    other = spark.createDataFrame([(2e-12,), (3.0,)], "y double")
    assert tuple(joins.inclusion(small, "x", other, "y").first()) == (3, 2, 1 - 2 / 3)
    decimals = spark.createDataFrame([(Decimal("3.00"),), (Decimal("0.10"),)], "z decimal(20,2)")
    whole = spark.createDataFrame([(3,), (4,)], "w long")
    assert tuple(joins.inclusion(decimals, "z", whole, "w").first()) == (2, 1, 0.5)
    assert tuple(joins.inclusion(decimals, "z", spark.createDataFrame([(0.1,), (3.0,)], "d double"), "d").first()) == (2, 0, 1.0)
    pairs = joins.inclusion_matrix({"a": (small, "x"), "b": (other, "y"), "c": (whole, "w")}, [("a", "b"), ("c", "a")]).collect()
    assert {(r["child"], r["matches"]) for r in pairs} == {("a", 1), ("c", 1)}


def test_overlaps_count_versions(spark):
    from quarrymill.operators import joins

    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 5), (1, 3, 4), (1, 11, 12), (2, 1, None), (2, 9, 9)], "k int, a int, b int")
    assert {(r["k"], r["a"]) for r in joins.overlaps(rows, ["k"], "a", "b").collect()} == {(1, 2), (1, 3), (2, 9)}


def test_sums_are_rounded_once(spark):
    from quarrymill.operators import aggregates

    rows = spark.createDataFrame([(1, 0.004)] * 1000, "k int, x double")
    assert float(aggregates.group_sums(rows, "k", "x").first()["total"]) == 4.0


def test_tokens_of_other_alphabets(spark):
    from quarrymill.operators import text

    docs = spark.createDataFrame([(1, "Gebühren für Straßen"), (2, "fur strassen"), (3, "дом и сад")], "doc_id int, text string")
    assert set(docs.where("doc_id = 1").select(text.tokens(docs["text"]).alias("t")).first()["t"]) == {"gebühren", "für", "straßen"}
    assert [tuple(r) for r in text.overlap(docs, "für Gebühren сад").collect()] == [(1, 2), (3, 1)]


def test_excerpts_cut_long_chunks():
    from quarrymill.sources.context import Bundle, Chunk, excerpts

    out = excerpts(Bundle([Chunk("a", "", "store " * 50), Chunk("b", "", "store open " * 50)]), {"store", "open"}, budget=600)
    assert [(c.path, len(c.body)) for c in out] == [("b", 550), ("a", 50)]


def test_columns_named_like_keywords_are_qualified(spark):
    from quarrymill.plans.compile import Refusal, compile_metric
    from quarrymill.plans.model import driver_model

    doc = driver_model()
    orders = next(t for t in doc["tables"] if t["name"] == "orders")
    orders["columns"].append({"name": "date", "sql_type": "DATE", "semantic_type": "date", "entity_role": "dimension"})
    out = compile_metric(doc, "revenue", extra_filter="date > DATE '2024-01-01'")
    assert not isinstance(out, Refusal) and "`orders`.`date` > DATE '2024-01-01'" in out.sql


def test_promotion_asks_again_about_columns_in_texts(spark):
    from quarrymill.plans.infer import infer
    from quarrymill.sources.context import Bundle, Chunk
    from quarrymill.sources.tables import Frames

    class Provider:
        calls = 0

        def json(self, system, user):
            self.calls += 1
            return {"semantic_type": "quantity"} if "speaks of" in system else []

    source = Frames({"stay": spark.createDataFrame([(i, i * 0.5) for i in range(50)], "stay_id long, share_pct double")})
    doc, report = infer(spark, source, "x", Provider(), Bundle([Chunk("a.md", "stay", "share_pct of a stay")]))
    column = next(c for t in doc["tables"] for c in t["columns"] if c["name"] == "share_pct")
    assert report.counts["promoted"] == 1 and column["semantic_type"] == "quantity" and "became quantity" in column["conflicts"][0]["detail"]
    bom = spark.createDataFrame([(1, 2, 2), (2, 3, 3), (1, 3, 1)], "p int, c int, q int")
    assert {tuple(r) for r in hierarchy.explode_bom(bom, spark.createDataFrame([(1,)], "r int"), "p", "c", "q").collect()} == {(1, 2, 2.0), (1, 3, 7.0)}


def test_hierarchies_of_many_levels(spark):
    chain = spark.createDataFrame([(1, None), *((i, i - 1) for i in range(2, 34)), (90, 91), (91, 90)], "id int, up int")  # 90 and 91 hang on no root
    assert {tuple(r) for r in hierarchy.depths(chain, "id", "up").collect()} == {(i, i) for i in range(1, 34)}
    bom = spark.createDataFrame([*((i, i + 1, 2) for i in range(1, 24)), (1, 24, 5)], "p int, c int, q int")
    roots = spark.createDataFrame([(1,)], "r int")
    assert {r["part"]: r["qty"] for r in hierarchy.explode_bom(bom, roots, "p", "c", "q").collect()} == {i: 2.0 ** (i - 1) + 5 * (i == 24) for i in range(2, 25)}
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.depths(chain.unionAll(spark.createDataFrame([(2, 33)], "id int, up int")), "id", "up")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.explode_bom(bom.unionAll(spark.createDataFrame([(24, 3, 1)], bom.schema)), roots, "p", "c", "q")


def test_drift(spark, mart, inferred):
    doc = json.loads(json.dumps(inferred[0]))
    live = {t.name: t.rendered() for t in mart.tables()}
    assert D.diff(D.baseline(doc), live) == []
    del live["store_dim"], live["ord_hdr"]["tot_amt"]
    live["emp"]["emp_nm"], live["emp"]["new_col"] = "INTEGER", "DATE"
    events = D.diff(D.baseline(doc), live)
    assert [(e.kind, e.element) for e in events] == [("column_retyped", "emp.emp_nm"), ("column_added", "emp.new_col"), ("column_dropped", "ord_hdr.tot_amt"), ("table_dropped", "store_dim")]
    change = D.apply(doc, events)
    assert "metric:total_tot_amt" in change.orphaned and "metric:total_tot_amt" in change.radius and "relationship:ord_hdr_to_store_dim" in change.orphaned
    assert "total_tot_amt" in D.render(change) and D.diff(D.baseline(doc), live) == []
    assert isinstance(compile_metric(doc, "total_tot_amt"), Refusal)
    more = Frames(mart.frames | {"ord_hdr": mart.df("ord_hdr").withColumn("sts_cd", F.when(F.col("ord_id") == 1, "Q").otherwise(F.col("sts_cd")))})
    found = D.semantic(inferred[0], more, {t.name: t.rendered() for t in mart.tables()}, date(2024, 6, 1))
    assert ("enum_drift", "ord_hdr", "sts_cd", "Q") in [(e.kind, e.table, e.column, e.detail) for e in found] and any(e.kind == "table_stale" for e in found)
    assert D.regressions(spark, [{"id": "q", "expected_sql": {"spark": "select nope from nowhere"}}, {"id": "r", "expected_sql": {"spark": "select 1"}, "references": ["metric:x"]}], {"metric:x": 1}) == ["q", "r"]


def test_streaming_watch(spark, tmp_path):
    from quarrymill.streaming.watch import watch_enum

    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "s string").write.mode("append").parquet(f"{tmp_path}/in")
    look = lambda: {r["value"] for r in watch_enum(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, "s", ["a"], f"{tmp_path}/out", f"{tmp_path}/at").collect()}
    rows("a", "b")
    assert look() == {"b"}
    rows("c", None)
    assert look() == {"b", "c"}


def test_context(inferred):
    doc = json.loads(json.dumps(inferred[0]))
    entries = dictionary("Table Name,Field,Definition\n,nope,x\n".replace("Table Name", "table").replace("Field", "field").replace("Definition", "definition") + "ord_hdr,tot_amt,What was paid\n")
    wiki = split("wiki.md", "intro\n# Orders\nord_hdr.sts_cd: X = Refunded, C = Complete\n## Ratios\nper_store = ord_hdr.tot_amt / ord_hdr.store_id")
    assert [c.heading for c in wiki] == ["", "Orders", "Ratios"]
    bundle = Bundle(wiki, entries)
    assert apply_dictionary(doc, bundle) == 1 and decode_claims(doc, bundle) and ratio_claims(doc, bundle) == 1
    column = next(c for t in doc["tables"] for c in t["columns"] if t["name"] == "ord_hdr" and c["name"] == "sts_cd")
    assert "Refunded" in column["conflicts"][0]["detail"] and isinstance(compile_metric(doc, "per_store"), Compiled) and validate(doc) == []


def test_review_search_graph_export(inferred):
    doc = json.loads(json.dumps(inferred[0]))
    items = {i["id"] for i in review.collect(doc)}
    first = next(i for i in items if i.startswith("type:"))
    assert review.apply(doc, {first: {"verdict": "accept"}, "type:no.where": {"verdict": "accept"}}) == [first] and first not in {i["id"] for i in review.collect(doc)}
    assert {(r["kind"], r["score"]) for r in search.search(doc, "tot_amt")} >= {("metric", 3), ("column", 3)}
    assert search.get_table(doc, "ord_hdr_legacy")["status"] == "UNUSABLE" and "error" in search.get_table(doc, "nope")
    assert graph.join_path(driver_model(), "orders", "region") == ["orders", "customer", "nation", "region"] and graph.join_path(doc, "emp", "ord_hdr") is None
    made, losses = export.export_dbt(doc)
    assert "ord_hdr_legacy: left out, deprecated" in losses and any(m["name"] == "total_tot_amt" for m in made["metrics"])
    assert "GRANT SELECT" in export.grants("snowflake", database="D") and scoring.score_document(doc, doc)["type_accuracy"] == 1


def _small():
    columns = [
        {"name": "id", "sql_type": "BIGINT", "entity_role": "foreign_key", "semantic_type": "identifier"},
        {"name": "day_cd", "sql_type": "VARCHAR", "entity_role": "dimension", "semantic_type": "date", "description": "day of order"},
        {"name": "amt", "sql_type": "DOUBLE", "entity_role": "measure", "semantic_type": "amount", "aggregations": {"default": "avg"}},
    ]
    return {
        "tables": [{"name": "order_line", "primary_key": ["id"], "columns": columns, "table_type": "fact", "description": "lines"}],
        "metrics": [
            {"name": "sales", "type": "simple", "measure": "order_line.amt", "display_name": "Order sales", "synonyms": ["turnover"]},
            {"name": "twice", "type": "derived", "expr": "2 * sales", "input_metrics": ["sales"]},
        ],
        "repo_knowledge": {"routing": []},
    }


def test_search_scores():
    found = [(r["kind"], r["name"], r["score"]) for r in search.search(_small(), "order")]
    assert found == [("table", "order_line", 3), ("metric", "sales", 3), ("column", "order_line.day_cd", 1)]
    assert search.search(_small(), "") == [] and search.search(_small(), "nothing") == []
    assert search.search(_small(), "turnover")[0]["measure"] == "order_line.amt"


def test_export_takes_keys_from_the_primary_key_and_lists_what_is_lost():
    made, losses = export.export_dbt(_small())
    model = made["semantic_models"][0]
    assert [(e["name"], e["type"]) for e in model["entities"]] == [("id", "primary")] and model["defaults"] == {"agg_time_dimension": "day_cd"}
    assert model["measures"] == [{"name": "amt", "agg": "average", "expr": "amt"}] and model["meta"] == {"table_type": "fact", "lifecycle": "inferred"}
    assert [(m["name"], m["label"]) for m in made["metrics"]] == [("sales", "Order sales")]
    assert "metric twice: left out, derived" in losses and "repo_knowledge has no place" in losses


def test_tool_server():
    from quarrymill.plans.serve import NAMES, serve

    def ask(*messages):
        return [json.loads(x) for x in serve(_small(), [m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages])]

    call = lambda name: {"id": 1, "method": "tools/call", "params": {"name": name}}
    hello, listed, hits, bad, gone, broken = ask(
        {"id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}, {"method": "notifications/initialized"}, {"id": 1, "method": "tools/list"},
        {"id": 2, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"text": "order"}}}, call("table_detail"), call("no_tool"), "{",
    )
    assert hello["result"]["protocolVersion"] == "2024-11-05" and {t["name"] for t in listed["result"]["tools"]} == {*NAMES, "join_path"}
    assert json.loads(hits["result"]["content"][0]["text"])[0]["name"] == "order_line"
    assert [x["error"]["code"] for x in (bad, gone, broken)] == [-32602, -32602, -32700] and broken["id"] is None
    refused = ask({"id": "a", "method": "tools/call", "params": {"name": "compile_metric", "arguments": {"name": "nope", "dialect": "duckdb"}}})[0]
    assert refused["id"] == "a" and "refused" in json.loads(refused["result"]["content"][0]["text"])


def test_validation_finds_what_is_wrong():
    for change, said in (
        (lambda d: d.update(extra=1), "unknown key"), (lambda d: d.pop("name"), "missing key"), (lambda d: d["tables"][0]["columns"][0].update(semantic_type="x"), "semantic_type"),
        (lambda d: d["tables"][0].update(primary_key=["x"]), "primary key"), (lambda d: d["metrics"][0].update(measure="orders.x"), "unknown 'orders.x'"), (lambda d: d["relationships"][0]["to"].update(table="x"), "unknown x."),
        (lambda d: d["tables"][0]["columns"][0].update(confidence=2), "not in 0 to 1"), (lambda d: d["tables"].append(d["tables"][0]), "twice"),
    ):
        doc = driver_model()
        assert validate(doc) == []
        change(doc)
        assert any(said in e for e in validate(doc)), said


def test_answers(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    said = iter(["```sql\nselect nope from five\n```", "select sum(id) as s from five"])
    got = answer(spark, driver_model(), "how much?", Scripted(lambda s, u: next(said)))
    assert got["repaired"] and score(spark, {"expected_kind": "scalar", "expected_sql": {"spark": "select 10.0"}}, got)
    assert answer(spark, driver_model(), "x", Scripted(lambda s, u: "REFUSE: unsafe"))["kind"] == "refusal"
    assert parse_json('text ```json\n[1, 2]\n``` more') == [1, 2] and parse_json("none") is None
    asked = []
    live = Recorded(tmp_path, "m", lambda s, u: asked.append(u) or "[1]")
    assert live.json("s", "u") == Recorded(tmp_path, "m").json("s", "u") == [1] and asked == ["u"]
    with pytest.raises(Exception, match="no recording"):
        Recorded(tmp_path, "m").text("s", "other")
    assert not scoring.same_rows([(1,), (1,)], [(1,)]) and scoring.same_rows([(Decimal("1.004"),)], [(1.0,)])


def test_sources(spark):
    names = [t.name for t in open_source(spark, f"parquet:{SF}").tables()]
    assert "orders" in names and len(names) == 14
    with pytest.raises(ValueError, match="unknown source"):
        open_source(spark, "duck:x")
    kinds = ParquetDir(spark, SF).tables()[names.index("embeddings")].rendered()
    assert kinds["embedding"] == "FLOAT[]"


def test_typing_rules(spark):
    from quarrymill.operators.profile import profile_table

    df = spark.range(200).selectExpr("id as thing_id", "cast(id % 5 as int) as sts_cd", "cast(id as decimal(9,2)) as unit_price", "array(id) as tags", "concat('http://x/', id) as place", "id % 2 = 0 as on_sale", "repeat('word ', 20) as body")
    found = {c: classify(s) for c, s in profile_table(df).items()}
    assert [found[c].semantic_type for c in df.columns] == ["identifier", "status_code", "monetary_value", "json_object", "url", "flag", "free_text"]
    assert found["thing_id"].role == "primary_key" and found["sts_cd"].confidence == 0.85


def test_cli(tmp_path, capsys):
    from quarrymill.cli import main

    save(driver_model(), tmp_path / "d.yaml")
    assert main(["validate", str(tmp_path / "d.yaml")]) == 0
    assert main(["compile", str(tmp_path / "d.yaml"), "revenue", "--group-by", "nation.n_name"]) == 0
    assert main(["compile", str(tmp_path / "d.yaml"), "nope"]) == 1
    assert main(["export", str(tmp_path / "d.yaml"), "--out", str(tmp_path / "x.json")]) == 0
    assert main(["validate", str(tmp_path / "none.yaml")]) == 2
    assert "LEFT JOIN" in capsys.readouterr().out
