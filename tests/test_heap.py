"""Taint of access paths against runs of random programs, and odd texts."""

import itertools
import random

import pytest

from tracewell.extract import heap as read
from tracewell.taint import heap

NAMES, FIELDS = "abc", "xy"


class Made:
    """A value: tainted ones give tainted fields until they are overwritten."""

    def __init__(self, tainted=False, fields=()):
        self.tainted, self.fields = tainted, dict(fields)

    def get(self, field):
        if field not in self.fields:
            self.fields[field] = Made(self.tainted)
        return self.fields[field]


def program(r):
    """Steps (kind, ...) of a function: straight, and steps that may not run."""

    def path():
        return (r.choice(NAMES), *([r.choice(FIELDS)] if r.random() < 0.6 else []))

    def step():
        kind = r.choice(["copy", "copy", "copy", "new", "source", "source", "fixed", "spread"])
        return kind, (r.choice(NAMES),) if kind in ("new", "spread") else path(), path()

    return [(step(), r.random() < 0.25) for _ in range(r.randrange(3, 9))]


def text(steps, number):
    def one(kind, target, source):
        value = {"copy": ".".join(source), "new": "{}", "source": "req.query.q", "fixed": "'fixed'", "spread": "{ ...%s }" % ".".join(source)}[kind]
        return f"{'.'.join(target)} = {value};"

    body = "\n  ".join(f"if (go) {{ {one(*s)} }}" if maybe else one(*s) for s, maybe in steps)
    return f"function f{number}(req) {{\n  let a = {{}}, b = {{}}, c = {{}};\n  {body}\n  exec({', '.join(shown)});\n}}\n"


asked = [(n,) for n in NAMES] + [(n, f) for n in NAMES for f in FIELDS]
shown = [".".join(p) for p in asked]


def runs(steps):
    """Arguments that are tainted in some run."""
    found = set()
    for taken in itertools.product([True, False], repeat=sum(maybe for _, maybe in steps)):
        known, choice = {n: Made() for n in NAMES}, iter(taken)

        def value(p, known=known):
            out = known[p[0]]
            for f in p[1:]:
                out = out.get(f)
            return out

        for (kind, target, source), maybe in steps:
            if maybe and not next(choice):
                continue
            new = value(source) if kind == "copy" else Made(kind == "source")
            if kind == "spread":
                of = value(source)
                new = Made(of.tainted, of.fields)
            if len(target) == 1:
                known[target[0]] = new
            else:
                value(target[:-1]).fields[target[-1]] = new
        found |= {k for k, p in enumerate(asked) if value(p).tainted}
    return found


def test_no_flow_of_a_run_is_lost(spark):
    r = random.Random(5)
    programs = [program(r) for _ in range(150)]
    files = spark.createDataFrame([(str(n), text(p, n)) for n, p in enumerate(programs)], "path string, content string")
    got = {}
    for row in heap.tainted(read.extract(files)).collect():
        got.setdefault(int(row["path"]), set()).add(row["arg"])
    want = {n: runs(p) for n, p in enumerate(programs)}
    assert sum(map(len, want.values())) > 150
    assert {n: x - got.get(n, set()) for n, x in want.items() if x - got.get(n, set())} == {}
    extra = sum(len(got.get(n, set()) - x) for n, x in want.items())
    assert extra <= 0.15 * sum(map(len, want.values())), extra


def test_long_paths_and_odd_files(spark):
    rows = [
        ("long", "function f(req) { a.b.c.d.e.g.h = req.query.q; exec(a.b.c.d.e.g.h); exec(a.b.x); }"),
        ("element", "function f(req) { const xs = [1, req.query.q]; exec(xs[0]); exec(xs[1]); exec(xs[k]); }"),
        ("pattern", "function f({ body }, [x = req.query.q]) { exec(x); exec(body); }"),
        ("of", "function f(req) { for (const [k, v] of pairs) { exec(v); } pairs.push(req.body); for (const { v } of pairs) { exec(v); } }"),
        ("assigned", "function f(req) { const o = Object.assign({}, req.body, { x: 1 }); exec(o.y); }"),
        ("returned", "const f = (req) => ({ x: req.query.q });"),
        ("nothing", None), ("empty", ""), ("broken", "function f( { a = [ exec(req.body"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {(r["path"], r["line"], r["arg"], r["origin"]) for r in heap.tainted(read.extract(files)).collect()}
    assert {x[0] for x in got} - {"broken"} == {"long", "element", "pattern", "of", "assigned"}
    assert ("element", 1, 0, "req-query") in got and ("of", 1, 0, "req-body") in got
    assert heap.tainted(read.extract(files.limit(0))).count() == 0


def test_elements_apart(spark):
    files = spark.createDataFrame([("a", "function f(req) { const xs = [1, req.query.q]; exec(xs[0]); }"), ("b", "function f(req) { const xs = [1, req.query.q]; exec(xs[1]); }"), ("c", "function f(req) { const xs = [1, req.query.q]; exec(xs[k]); }")], "path string, content string")
    assert {r["path"] for r in heap.tainted(read.extract(files)).collect()} == {"b", "c"}


@pytest.mark.parametrize("text_", ["", "function", "x = {", "x = [", "const {", "const { a: [", "f(", "a[", "a[b", "a.b.", "function f(){ x = ", "function f(){ x = {...", "() => {", "({ a, b: { c }, ...d }) => a", "}}}", "(((", "a?.[0]?.(b)", "for (const x of", "function f(){ return"])
def test_any_text_is_read(text_):
    read.Heap(text_).rows()


def jobs_of(spark, name, make):
    """How many jobs make() starts before its rows are asked for."""
    spark.sparkContext.setJobGroup(name, name)
    made = make()
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(started)


def test_functions_are_worked_on_in_one_pass(spark):
    """No rounds over the tables of all functions; rows that lie by function already are sent once."""
    from tracewell.plans import catalog

    for name, most in (("q87_heap_flows", 2), ("q88_heap_reads", 1)):  # q87 deals out the files first
        made, jobs = jobs_of(spark, name, lambda name=name: catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert jobs <= 1 and plan.count("Exchange hashpartitioning") == most  # a job: the table's columns are read


def test_a_long_function(spark):
    steps = "".join(f"if (go) {{ o.x = b.y; b = o; }} x = x + {k}; " for k in range(400))
    files = spark.createDataFrame([("a", f"function f(req) {{ let o = {{}}, b = {{}}, x = req.query.q; {steps} exec(x, b.y); }}")], "path string, content string")
    assert {r["arg"] for r in heap.tainted(read.extract(files)).collect()} == {0}
