"""Models of web frameworks: which are used, their routes, and what their handlers are given by a request.

Handlers may call the request what they like; rows of a handler are rewritten so that its names are those that the source
catalogue knows, and everything behind works as for any function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.extract.facts import of_kind
from tracewell.functions import names

# Packages that tell a framework.
PACKAGES = (
    ("express", ("express", "@types/express", "express-serve-static-core")),
    ("nestjs", ("@nestjs/core", "@nestjs/common", "@nestjs/platform-express", "@nestjs/platform-fastify")),
    ("nextjs", ("next",)),
)
METHODS = ("get", "post", "put", "patch", "delete", "all", "use", "head", "options")
#: Words in a middleware's name, and what it does for the handlers behind it.
EFFECTS = (
    ("auth", r"(?i)auth|requireLogin|isLoggedIn|ensureUser|jwt|passport"), ("admin", r"(?i)admin"), ("validation", r"(?i)validat|schema|celebrate|joi|zod"),
    ("sanitizer", r"(?i)saniti[sz]e|escape|xss|helmet"), ("parser", r"(?i)bodyParser|^express\.(json|urlencoded)|cookieParser|multer|upload"),
)


def detected(facts: DataFrame, manifest_names: DataFrame | None = None) -> DataFrame:
    """(framework): those whose packages a manifest (name) declares or a file imports; Next.js also by its page folders."""
    package = names.package_of(F.col("name"))
    seen = of_kind(facts, "import").select(package.alias("name"))
    seen = seen.unionByName(manifest_names.select("name")) if manifest_names is not None else seen
    framework = F.lit(None).cast("string")
    for name, packages in PACKAGES:
        framework = F.when(F.col("name").isin(*packages), name).otherwise(framework)
    return seen.select(framework.alias("framework")).filter("framework IS NOT NULL").distinct()


def routes(bindings: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, line, framework, method, route, handler, middleware): one row for each handler; middleware are the names of what
    runs before it, in order."""
    args = bindings.filter("kind = 'arg' AND arg >= 0").withColumn("method", F.regexp_extract(F.col("callee"), r"(?i)^(?:[\w$.]*(?:app|router|server|api)|fastify)\.(" + "|".join(METHODS) + r")$", 1)).filter("method <> ''")
    given = args.filter(F.size("uses") > 0).groupBy("path", "fn", "ix", "method").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("arg", F.element_at("uses", 1).alias("use")))).alias("given"))
    last = F.element_at("given", -1)["use"]
    shown = F.transform(F.slice("given", F.lit(1), F.size("given") - 1), lambda g: g["use"])
    strings = of_kind(facts, "call").select("path", "line", F.col("name").alias("called"), F.regexp_extract(F.coalesce(F.col("about")["args"], F.lit("")), r"^['\"`]([^'\"`]*)['\"`]", 1).alias("route")).filter("route <> ''")
    express = given.join(strings, ["path", "line"], "left").filter(F.col("called").isNull() | (F.substring_index("called", ".", -1) == F.col("method")))
    express = express.select("path", "line", F.lit("express").alias("framework"), "method", "route", F.regexp_replace(last, "^=>", "").alias("handler"), shown.alias("middleware"))

    part = r"(?:^|/)app/(.*?)/?route\.[jt]sx?$"
    files = bindings.filter("kind = 'param' AND arg = 0").select("path", "fn", "line").distinct()
    served = files.filter(F.col("path").rlike(part) & F.col("fn").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"))
    none = F.array().cast("array<string>")
    app = served.select("path", "line", F.lit("nextjs").alias("framework"), F.lower("fn").alias("method"), F.concat(F.lit("/"), F.regexp_extract("path", part, 1)).alias("route"), F.col("fn").alias("handler"), none.alias("middleware"))
    page = r"(?:^|/)pages/(api/.*?)(?:/index)?\.[jt]sx?$"
    default = of_kind(facts, "export").filter("name = 'default'").select("path", F.col("about")["original"].alias("original"))
    served = files.filter(F.col("path").rlike(page)).join(default, "path").filter(F.col("original").isin("function", "async") | (F.col("original") == F.col("fn")))
    pages = served.select("path", "line", F.lit("nextjs").alias("framework"), F.lit("all").alias("method"), F.concat(F.lit("/"), F.regexp_extract("path", page, 1)).alias("route"), F.col("fn").alias("handler"), none.alias("middleware"))

    verbs = bindings.filter("kind = 'call' AND fn = ''").withColumn("method", F.lower(F.col("callee"))).filter(F.col("callee").isin("Get", "Post", "Put", "Patch", "Delete", "All")).select("path", "line", "method")
    methods = bindings.filter("kind = 'param' OR kind = 'return'").filter("fn <> '' AND fn NOT LIKE '@%'").groupBy("path", "fn").agg(F.min("line").alias("at"))
    nest = verbs.join(methods, "path").filter("at >= line").groupBy("path", "line", "method").agg(F.min_by("fn", F.struct("at", "fn")).alias("handler"))
    routed = strings.filter(F.col("called").isin("Get", "Post", "Put", "Patch", "Delete", "All")).select("path", "line", "route")
    nest = nest.join(routed, ["path", "line"], "left").select("path", "line", F.lit("nestjs").alias("framework"), "method", F.coalesce("route", F.lit("")).alias("route"), "handler", none.alias("middleware"))
    return express.unionByName(app).unionByName(pages).unionByName(nest)


def effect(middleware: Column) -> Column:
    """What a middleware is for by its name, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(EFFECTS):
        out = F.when(middleware.rlike(pattern), name).otherwise(out)
    return out


def effects(found: DataFrame) -> DataFrame:
    """(path, line, handler, effects): what the middleware of each route does, in order and without repeats."""
    every = F.array_compact(F.array_distinct(F.transform("middleware", effect)))
    return found.select("path", "line", "handler", every.alias("effects"))


def normalized(bindings: DataFrame, found: DataFrame) -> DataFrame:
    """bindings in which the request of every handler is called req, whatever the handler calls it."""
    first = bindings.filter("kind = 'param' AND arg = 0").select("path", "fn", F.col("target").alias("__was"))
    handlers = found.filter("framework IN ('express', 'nextjs')").select("path", F.col("handler").alias("fn"), "framework").distinct()
    renamed = handlers.join(first, ["path", "fn"]).filter(~F.col("__was").isin("req", "request", "ctx")).groupBy("path", "fn").agg(F.min("__was").alias("__was"))
    met = bindings.join(renamed, ["path", "fn"], "left")
    was = F.col("__was")
    rename = lambda name: F.when(was.isNotNull() & ((name == was) | name.startswith(F.concat(was, F.lit(".")))), F.concat(F.lit("req"), F.substr(name, F.length(was) + 1))).otherwise(name)
    return met.withColumns({"uses": F.transform("uses", rename), "target": F.when(F.col("target").isNotNull(), rename(F.col("target"))), "callee": F.when(F.col("callee").isNotNull(), rename(F.col("callee")))}).drop("__was").select(*bindings.columns)
