"""Every query that has an SQL twin gives the same rows."""

import oracle
import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


#: Queries that no SQL expresses.
ALONE = {"q51_source_facts", "q52_detected_issues"}


def test_every_other_query_has_a_twin():
    assert set(SQL) | ALONE == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(ALONE))
def test_queries_without_a_twin_run(spark, name):
    got = catalog.queries()[name](spark, SF)
    assert got.count() >= 0 and len(set(got.columns)) == len(got.columns)


def test_flows_agree_with_a_walk(spark):
    """Every pair of source and sink within four calls, by a walk over the edges on the driver."""
    from tracewell.sources.issues import call_edges

    sf = "/root/testdata/sf0.01"
    edges = {}
    for r in call_edges(spark, sf).collect():
        edges.setdefault(r["caller"], set()).add(r["callee"])
    want = set()
    for start in [s for s in edges if s % 20 == 1]:
        paths = [[start]]
        for _ in range(4):
            paths = [[*p, to] for p in paths for to in edges[p[-1]] if to not in p and (len(p) == 1 or p[-1] % 20 != 1)]
            want |= {(str(p[0]), str(p[-1])) for p in paths if p[-1] % 11 == 0}
    assert {(r["source_fn"], r["sink_fn"]) for r in catalog.queries()["q53_taint_flows"](spark, sf).collect()} == want
    assert want


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    assert oracle.differences(catalog.queries()[name](spark, SF), db, SQL[name]) == ""


@pytest.mark.parametrize("deep,shallow", [("q55_forward_flows_deep", "q44_forward_flows"), ("q56_backward_flows_deep", "q45_backward_flows"), ("q57_flow_summary_deep", None), ("q58_taint_flows_deep", "q53_taint_flows"), ("q59_taint_summary_deep", None)])
def test_flows_of_ten_calls(spark, deep, shallow):
    """The smallest tables hold no sink; here walks of 5 to 10 calls count as well."""
    sf = "/root/testdata/" + ("sf0.1" if deep == "q58_taint_flows_deep" else "sf0.01")  # taint flows of 100 functions are short
    got = catalog.queries()[deep](spark, sf)
    assert oracle.differences(got, oracle.connect(sf), SQL[deep]) == ""
    if shallow:
        assert got.agg({"depth": "max"}).first()[0] > 4 and got.count() > catalog.queries()[shallow](spark, sf).count()


def test_every_event_and_node_takes_part(spark):
    found = catalog.queries()["q60_baseline_new_by_date"](spark, SF)
    assert {r[0] for r in found.selectExpr("ord % 3").distinct().collect()} == {0, 1, 2}
    starts = catalog.queries()["q61_reverse_closure_all"](spark, SF).select("start").distinct()
    assert starts.count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
