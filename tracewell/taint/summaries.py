"""Function summaries from value flows: what reaches a function's result, its sinks and the calls it makes.

Inside a function a value's way is a closure over edges from name to name; sanitizer calls mark the edges they are on. The
results are the tables that flows.forward() and flows.backward() search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graphs
from tracewell.taint import flows
from tracewell.taint.resolve import fn_id

# Names that decide results.
SOURCES = (
    ("req.body", "req-body"), ("req.params", "req-params"), ("req.query", "req-query"), ("req.headers", "req-headers"), ("req.cookies", "req-cookies"), ("req.files", "req-files"), ("req.ip", "req-ip"),
    ("request.body", "req-body"), ("request.params", "req-params"), ("request.query", "req-query"), ("request.payload", "req-payload"),
    ("ctx.request.body", "ctx-body"), ("ctx.params", "ctx-params"), ("ctx.query", "ctx-query"), ("process.env", "process-env"), ("process.argv", "process-argv"),
)
SINKS = (
    ("db-query", ("db.query", "db.execute", "db.raw", "connection.query", "pool.query", "knex.raw", "sequelize.query", "prisma.$queryRaw", "prisma.$executeRaw", "mongoose.exec")),
    ("command-exec", ("exec", "execSync", "spawn", "spawnSync", "execFile", "child_process.exec", "child_process.execSync", "child_process.spawn", "child_process.spawnSync", "child_process.execFile")),
    ("fs-read", ("fs.readFile", "fs.readFileSync", "fs.createReadStream")),
    ("fs-write", ("fs.writeFile", "fs.writeFileSync", "fs.createWriteStream", "fs.unlink", "fs.rmdir")),
    ("html-output", ("res.send", "res.write", "document.write", "document.writeln")),
    ("eval", ("eval", "Function", "vm.runInContext", "vm.runInNewContext")),
    ("http-request", ("fetch", "axios", "axios.get", "axios.post", "axios.put", "axios.delete", "http.request", "https.request")),
    ("template-render", ("ejs.render", "pug.render", "handlebars.compile", "nunjucks.render")),
    ("redirect", ("res.redirect",)),
)
SANITIZERS = (
    ("numeric-cast", ("parseInt", "parseFloat", "Number")),
    ("url-encode", ("encodeURIComponent", "encodeURI")),
    ("html-escape", ("escape", "escapeHtml", "DOMPurify.sanitize", "xss", "sanitizeHtml")),
    ("validator", ("validator.escape", "validator.trim")),
    ("path-normalize", ("path.basename", "path.normalize")),
)
MATH = r"^Math\.(abs|ceil|floor|round|trunc|max|min|pow|sqrt|log|sign|random)$"


def called(callee: Column, names: tuple[str, ...]) -> Column:
    """Whether a callee is one of the names; one that begins with "*." fits a method of any object."""
    plain, wide = [n for n in names if not n.startswith("*.")], [n for n in names if n.startswith("*.")]
    out = callee.isin(*plain) if plain else F.lit(False)
    for n in wide:
        out = out | callee.endswith(n[1:])
    return out


@dataclass
class Catalogue:
    """Names that sources, sinks and sanitizers go by; rule files and framework models add to them."""

    sources: list[tuple[str, str]] = field(default_factory=lambda: list(SOURCES))
    sinks: list[tuple[str, tuple[str, ...]]] = field(default_factory=lambda: list(SINKS))
    sanitizers: list[tuple[str, tuple[str, ...]]] = field(default_factory=lambda: list(SANITIZERS))
    #: the arguments that matter, of sinks that take only some; without an entry all do
    arguments: dict[str, tuple[int, ...]] = field(default_factory=dict)
    #: what a decorated parameter is a source of
    decorators: dict[str, str] = field(default_factory=lambda: {"Body": "req-body", "Param": "req-params", "Query": "req-query", "Headers": "req-headers"})

    #: functions whose names say that they check or clean their argument
    validators: str = ""

    def source_kind(self, use: Column) -> Column:
        """The source that a dotted name reads, or null."""
        out = F.lit(None).cast("string")
        for name, kind in reversed(self.sources):
            out = F.when((use == name) | use.startswith(name + "."), kind).otherwise(out)
        return out

    def source_of(self, use: str) -> str | None:
        """source_kind() of one name."""
        return next((kind for name, kind in self.sources if use == name or use.startswith(name + ".")), None)

    def sink_kind(self, callee: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, names in reversed(self.sinks):
            out = F.when(called(callee, names), kind).otherwise(out)
        return out

    def sanitizer_kind(self, callee: Column) -> Column:
        out = F.when(callee.rlike(MATH), "numeric-cast")
        if self.validators:
            out = F.when(out.isNull() & callee.rlike(self.validators), "validator").otherwise(out)
        for kind, names in reversed(self.sanitizers):
            out = F.when(called(callee, names), kind).otherwise(out)
        return out

    def takes(self, callee: Column, arg: Column) -> Column:
        out = F.lit(True)
        for name, which in self.arguments.items():
            out = F.when(called(callee, (name,)), arg.isin(*which)).otherwise(out)
        return out


def _of(objects: tuple[str, ...], methods: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{o}.{m}" for o in objects for m in methods)


_FS, _RESPONSE, _SHELL = ("fs", "fsp", "fsPromises", "path"), ("res", "response", "ctx", "reply"), ("exec", "execSync", "spawn", "spawnSync")
# The names that count inside one function, wider than those of summaries: methods of any object for databases.
SCOPE = Catalogue(
    sources=[*[(f"{o}.{p}", f"req.{p}") for o in ("req", "request") for p in ("body", "params", "query", "headers", "cookies", "files", "ip")], ("ctx.request.body", "ctx.request.body"), ("ctx.params", "ctx.params"), ("ctx.query", "ctx.query"), ("request.payload", "request.payload")],
    sinks=[
        ("file-read", _of(_FS, ("readFile", "readFileSync", "createReadStream", "access"))), ("file-write", _of(_FS, ("writeFile", "writeFileSync", "createWriteStream", "unlink", "rename"))),
        ("command-execution", _SHELL + _of(("child_process", "cp", "childProcess"), _SHELL)), ("html-output", _of(_RESPONSE, ("send", "render", "compile")) + ("document.write",) + _of(("ejs", "pug", "handlebars"), ("render", "compile"))),
        ("redirect", _of(_RESPONSE, ("redirect",))), ("http-request", ("fetch", "got", "axios") + _of(("axios", "http", "https", "undici"), ("get", "post", "put", "patch", "delete", "request", "fetch"))), ("eval", ("eval", "Function", "setTimeout", "setInterval")),
        ("db-query", tuple(f"*.{m}" for m in ("findById", "findOne", "findUnique", "findFirst", "findMany", "query", "where", "select", "findByPk", "aggregate"))),
        ("db-mutation", tuple(f"*.{m}" for m in ("create", "insert", "update", "delete", "destroy", "save", "upsert", "remove", "deleteOne", "deleteMany", "updateOne", "updateMany", "insertMany"))),
    ],
    sanitizers=[
        ("type-coercion", ("parseInt", "parseFloat", "Number", "Boolean", "String", "BigInt")), ("schema", _of(("z", "zod", "joi", "yup", "schema", "ajv", "vine", "superstruct"), ("parse", "safeParse", "validate")) + ("superstruct.create", "superstruct.assert")),
        ("escape", ("escapeHtml", "encodeURIComponent", "encodeURI", "sqlEscape", "xss", "DOMPurify.sanitize", "validator.escape")),
    ],
    validators=r"(?i)^(validate|sanitize|check|verify|ensure|clean|filter|guard)",
)


def root(use: Column) -> Column:
    """The variable of a dotted name; a field of `this` counts as one."""
    return F.when(use.startswith("this."), F.substring_index(use, ".", 2)).otherwise(F.substring_index(use, ".", 1))


def _ends(rows: DataFrame, names: Catalogue) -> DataFrame:
    """rows with one row for each use: node is the variable it reads, or the source."""
    used = rows.withColumn("use", F.explode("uses"))
    kind = names.source_kind(F.col("use"))
    both = F.array_compact(F.array(root(F.col("use")), F.when(kind.isNotNull(), F.concat(F.lit("~"), kind))))
    return used.withColumn("node", F.explode(both)).drop("uses")


ORIGIN = ("fn", "kind", "param", "label")


def edges(bindings: DataFrame, links: DataFrame, names: Catalogue) -> DataFrame:
    """(fn, node, to, kinds): one step of a value inside a function; calls of unknown functions hand their arguments on."""
    empty = F.array().cast("array<string>")
    b = bindings.withColumn("id", fn_id(F.col("path"), F.col("fn")))
    moved = _ends(b.filter("kind IN ('assign', 'return')"), names).select("id", "node", F.when(F.col("kind") == "return", "return").otherwise(root(F.col("target"))).alias("to"), empty.alias("kinds"))
    unknown = b.filter("kind = 'arg'").join(links.select("path", "fn", "ix"), ["path", "fn", "ix"], "left_anti")
    kind = names.sanitizer_kind(F.col("callee"))
    handed = _ends(unknown, names).select("id", "node", F.concat(F.lit("@"), F.col("ix").cast("string")).alias("to"), F.when(kind.isNotNull(), F.array(kind)).otherwise(empty).alias("kinds"))
    return moved.unionByName(handed).filter("node <> to").distinct().withColumnRenamed("id", "fn")


def starts(bindings: DataFrame, links: DataFrame, names: Catalogue) -> DataFrame:
    """(fn, kind, param, label, node): parameters, sources, and results of calls of known functions."""
    b = bindings.withColumn("id", fn_id(F.col("path"), F.col("fn")))
    none = F.lit(None).cast("int")
    params = b.filter("kind = 'param'").select(F.col("id").alias("fn"), F.lit("param").alias("kind"), F.col("arg").alias("param"), F.col("target").alias("label"), F.col("target").alias("node"))
    decorated = F.lit(None).cast("string")
    for name, kind in names.decorators.items():
        decorated = F.when(F.col("callee") == "@" + name, kind).otherwise(decorated)
    handed = b.filter("kind = 'param'").withColumn("label", decorated).filter("label IS NOT NULL").select(F.col("id").alias("fn"), F.lit("value").alias("kind"), none.alias("param"), "label", F.col("target").alias("node"))
    read = _ends(b.filter("kind IN ('assign', 'return', 'arg')"), names).filter("node LIKE '~%'").select(F.col("id").alias("fn"), F.lit("value").alias("kind"), none.alias("param"), F.expr("substr(node, 2)").alias("label"), "node").distinct()
    result = F.concat(F.lit("@"), F.col("ix").cast("string"))
    given = links.select(fn_id(F.col("path"), F.col("fn")).alias("fn"), F.lit("value").alias("kind"), none.alias("param"), result.alias("label"), result.alias("node"))
    return params.unionByName(read).unionByName(handed).unionByName(given)


def reached(first: DataFrame, steps: DataFrame) -> DataFrame:
    """(fn, kind, param, label, node, kinds): all that each origin comes to, by the sets of sanitizers on the way."""
    steps = graphs.cut(steps)
    begun = first.select(*ORIGIN, "node", F.array().cast("array<string>").alias("kinds"))
    # null-safe keys: a value's parameter is null, so it is -1 within the closure
    begun = begun.withColumn("param", F.coalesce("param", F.lit(-1)))
    hop = steps.select("fn", "node", "to", F.col("kinds").alias("more"))
    walked = graphs.closure(begun, lambda new: new.join(hop, ["fn", "node"]).select(*ORIGIN, F.col("to").alias("node"), F.array_sort(F.array_union("kinds", "more")).alias("kinds")))
    return walked.withColumn("param", F.when(F.col("param") >= 0, F.col("param")))


def _input() -> Column:
    return F.struct(F.col("kind").alias("kind"), F.col("param").alias("param"), F.col("label").alias("label"), F.array().cast("array<string>").alias("path"))


def transfers(way: DataFrame) -> DataFrame:
    """(fn, param, to_kind, sanitized, sanitizations, confidence) of parameters that come to the result."""
    return way.filter("kind = 'param' AND node = 'return'").select("fn", "param", F.lit("return").alias("to_kind"), (F.size("kinds") > 0).alias("sanitized"), F.col("kinds").alias("sanitizations"), F.lit("definite").alias("confidence")).distinct()


def composed(bindings: DataFrame, links: DataFrame, moves: DataFrame, names: Catalogue) -> DataFrame:
    """(fn, node, to, kinds): edges through calls of known functions, as their transfers say."""
    args = bindings.filter("kind = 'arg' AND arg >= 0").join(links, ["path", "fn", "ix"])
    met = args.join(moves.select(F.col("fn").alias("callee_fn"), F.col("param").alias("arg"), F.col("sanitizations").alias("kinds")), ["callee_fn", "arg"])
    shown = _ends(met.withColumn("id", fn_id(F.col("path"), F.col("fn"))).drop("fn"), names)
    return shown.select(F.col("id").alias("fn"), "node", F.concat(F.lit("@"), F.col("ix").cast("string")).alias("to"), "kinds").distinct()


def build(bindings: DataFrame, links: DataFrame, names: Catalogue | None = None, rounds: int = 10) -> flows.Summaries:
    """Summaries of all functions of a project.

    Transfers are composed over calls until no more are found, at most `rounds` times (a chain of so many calls that only
    hand a value through).
    """
    names = names or Catalogue()
    bindings, links = graphs.cut(bindings), graphs.cut(links)
    own, first = edges(bindings, links, names), graphs.cut(starts(bindings, links, names).distinct())
    way = reached(first, own)
    moves = graphs.cut(transfers(way))
    count = moves.count()
    for _ in range(rounds):
        way = reached(first, own.unionByName(composed(bindings, links, moves, names)).distinct())
        moves = graphs.cut(transfers(way))
        was, count = count, moves.count()
        if was == count:
            break
    way = graphs.cut(way)

    b = bindings.withColumn("id", fn_id(F.col("path"), F.col("fn"))).drop("fn")
    sinks = b.filter("kind = 'arg' AND arg >= 0").withColumn("sink_kind", names.sink_kind(F.col("callee"))).filter(F.col("sink_kind").isNotNull() & names.takes(F.col("callee"), F.col("arg")))
    at = way.withColumnRenamed("kind", "origin_kind")
    meets = lambda rows: _ends(rows, names).drop("kind").join(at.withColumnRenamed("fn", "id").withColumnRenamed("origin_kind", "kind"), ["id", "node"])
    hits = meets(sinks).select(F.col("id").alias("fn"), F.col("ix").alias("hit_ix"), _input().alias("input"), "sink_kind", F.col("callee").alias("sink_callee"), (F.size("kinds") > 0).alias("sanitized"), F.col("kinds").alias("sanitizations"), "line").distinct()
    known = links.withColumn("id", fn_id(F.col("path"), F.col("fn"))).select("id", "ix", "callee_fn")
    lines = b.filter("kind = 'call'").select("id", "ix", "line")
    calls = known.join(lines, ["id", "ix"]).select(F.col("id").alias("caller"), F.col("ix").alias("edge_ix"), F.col("callee_fn").alias("callee"), "line", F.concat(F.lit("@"), F.col("ix").cast("string")).alias("assigned_to"))
    args = meets(b.filter("kind = 'arg' AND arg >= 0").join(known, ["id", "ix"])).select(F.col("id").alias("caller"), F.col("ix").alias("edge_ix"), _input().alias("input"), F.col("arg").alias("callee_param")).distinct()
    sources = first.filter("kind = 'value' AND label NOT LIKE '@%'").select("fn", F.col("label").alias("kind"), "label", F.array().cast("array<string>").alias("path"))
    # what is returned as it is: a source is one of the callers as well, and so is a call's result
    returned = way.filter("kind = 'value' AND node = 'return' AND size(kinds) = 0")
    sources = sources.unionByName(returned.filter("label NOT LIKE '@%'").select("fn", F.col("label").alias("kind"), F.lit("return").alias("label"), F.array().cast("array<string>").alias("path"))).distinct()
    handed = returned.select(F.col("fn").alias("caller"), F.col("label").alias("assigned_to")).join(calls, ["caller", "assigned_to"]).withColumn("assigned_to", F.lit("return"))
    calls = calls.unionByName(handed.select(*calls.columns))
    hits = graphs.cut(hits)
    return flows.Summaries(functions(b, moves, hits), graphs.cut(sources), hits, graphs.cut(calls), graphs.cut(args), moves)


def functions(bindings: DataFrame, moves: DataFrame, hits: DataFrame) -> DataFrame:
    """(fn, file_path, is_sanitizer, sanitizer_kind): a sanitizer is a function whose every transfer is sanitized and that gives
    no parameter to a sink as it is; its kind is the one that most of its transfers have, or the first by name."""
    every = bindings.select(F.col("id").alias("fn"), F.col("path").alias("file_path")).distinct()
    clean = moves.groupBy("fn").agg(F.every("sanitized").alias("clean"))
    kind = moves.select("fn", F.explode("sanitizations").alias("kind")).groupBy("fn", "kind").count().groupBy("fn").agg(F.min_by("kind", F.struct(-F.col("count"), F.col("kind"))).alias("sanitizer_kind"))
    raw = hits.filter("input.kind = 'param' AND NOT sanitized").select("fn").distinct().withColumn("raw", F.lit(True))
    is_sanitizer = F.coalesce("clean", F.lit(False)) & ~F.coalesce("raw", F.lit(False))
    met = every.join(clean, "fn", "left").join(raw, "fn", "left").join(kind, "fn", "left")
    return graphs.cut(met.select("fn", "file_path", is_sanitizer.alias("is_sanitizer"), F.when(is_sanitizer, F.col("sanitizer_kind")).alias("sanitizer_kind")))


def carried_hits(s: flows.Summaries, rounds: int | None = None) -> DataFrame:
    """(fn, input, sink_kind, sink_callee, line, sanitized): hits of callees as their callers' own, all the way up. The line and
    the callee stay those of the sink."""
    arg = s.args.join(s.calls.select("caller", "edge_ix", "callee"), ["caller", "edge_ix"]).select(F.col("callee").alias("fn"), F.col("callee_param").alias("p"), F.col("caller").alias("up"), F.col("input").alias("from_input"))
    own = s.hits.select("fn", "input", "sink_kind", "sink_callee", "line", "sanitized")
    step = lambda new: new.filter("input.kind = 'param'").withColumn("p", F.col("input.param")).join(arg, ["fn", "p"]).filter("up <> fn").select(F.col("up").alias("fn"), F.col("from_input").alias("input"), "sink_kind", "sink_callee", "line", "sanitized")
    return graphs.closure(own, step, rounds)


# the store


TABLES = ("functions", "sources", "hits", "calls", "args", "transfers")


def save(s: flows.Summaries, path: str) -> None:
    """Writes every table of the summaries as Parquet below a path."""
    for name in TABLES:
        getattr(s, name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark, path: str) -> flows.Summaries:
    return flows.Summaries(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES])


def stats(s: flows.Summaries) -> DataFrame:
    """(functions, files, sanitizers, transfers, hits, calls, sources) in one row."""
    of = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    told = s.functions.agg(F.count("*").alias("functions"), F.countDistinct("file_path").alias("files"), F.count_if("is_sanitizer").alias("sanitizers"))
    rows = told.select(F.explode(F.create_map(*[x for c in told.columns for x in (F.lit(c), F.col(c))])).alias("what", "n"))
    for table, name in ((s.transfers, "transfers"), (s.hits, "hits"), (s.calls, "calls"), (s.sources, "sources")):
        rows = rows.unionByName(of(table, name))
    return rows.agg(*[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in (*told.columns, "transfers", "hits", "calls", "sources")])
