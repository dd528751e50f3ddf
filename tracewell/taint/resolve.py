"""Which function a call means: by name in its file, or through imports, exports and re-exports of other files.

A function's id is its path, "#" and its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.extract.facts import of_kind, told
from tracewell.operators import graphs
from tracewell.sources import projects


def imported_names(facts: DataFrame) -> DataFrame:
    """(path, name, local, imported): one row for each name that an import binds; name is the specifier, imported "default",
    "*" for the whole module, or what the other file calls it."""
    shown = F.trim(told("names"))
    braces = F.regexp_extract(shown, r"\{([^}]*)\}", 1)
    before = F.trim(F.regexp_replace(F.regexp_replace(shown, r"\{[^}]*\}", ""), r"\*\s*as\s+[\w$]+", ""))
    first = F.regexp_extract(before, r"^(?:type\s+)?([\w$]+)", 1)
    whole = F.regexp_extract(shown, r"\*\s*as\s+([\w$]+)", 1)
    one = lambda local, imported: F.struct(local.alias("local"), imported.alias("imported"))
    named = F.transform(F.filter(F.split(braces, ","), lambda p: F.length(F.trim(p)) > 0), lambda p: one(F.regexp_extract(F.trim(p), r"([\w$]+)$", 1), F.regexp_extract(F.trim(p), r"^(?:type\s+)?([\w$]+)", 1)))
    require = told("form") == "require"
    rows = F.concat(F.array(one(first, F.when(require, "*").otherwise("default")), one(whole, F.lit("*"))), named)
    return of_kind(facts, "import").filter(told("form").isin("esm", "require")).select("path", "name", F.explode(F.filter(rows, lambda r: F.length(r["local"]) > 0)).alias("r")).select("path", "name", "r.local", "r.imported")


def exported_names(facts: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(path, shown, origin_path, origin): every name that a file exports, and the file and name where it is defined.

    Re-exports are followed to the end; a file's own export goes before a named re-export, and that before `export *`.
    """
    rows = of_kind(facts, "export").select("path", F.col("name").alias("shown"), told("original").alias("original"), F.col("about")["target"].alias("target"))
    own = rows.filter("target IS NULL").select("path", "shown", F.col("path").alias("origin_path"), F.when(F.col("original") == "", F.col("shown")).otherwise(F.col("original")).alias("origin"), F.lit(0).alias("rank"))
    again = projects.resolved(rows.filter("target IS NOT NULL").select("path", F.col("target").alias("name"), "shown", "original").distinct(), files, prefixes).filter("target IS NOT NULL")
    named = again.filter("original <> '*'").select(F.col("path").alias("from_path"), F.col("shown").alias("as_name"), F.col("target").alias("path"), F.col("original").alias("shown"))
    star = again.filter("original = '*'").select(F.col("path").alias("from_path"), F.col("target").alias("path"))
    named, star = graphs.cut(named.distinct()), graphs.cut(star.distinct())

    def step(new: DataFrame) -> DataFrame:
        by_name = new.join(graphs.sent(named), ["path", "shown"]).select(F.col("from_path").alias("path"), F.col("as_name").alias("shown"), "origin_path", "origin", (F.col("rank") + 1).alias("rank"))
        by_star = new.filter("shown <> 'default'").join(graphs.sent(star), "path").select(F.col("from_path").alias("path"), "shown", "origin_path", "origin", (F.col("rank") + 100).alias("rank"))
        return by_name.unionByName(by_star)

    every = graphs.cheapest(own, ["path", "shown", "origin_path", "origin"], "rank", step)
    first = Window.partitionBy("path", "shown").orderBy("rank", "origin_path", "origin")
    return every.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select("path", "shown", "origin_path", "origin")


def fn_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("#"), name)


def symbols(facts: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None, exports: DataFrame | None = None) -> DataFrame:
    """(path, local, imported, name, target, origin_path, origin): each imported name with the file and name it stands for.

    exports: what exported_names() gives, if it is at hand.
    """
    names = projects.resolved(imported_names(facts).distinct(), files, prefixes)
    exports = exported_names(facts, files, prefixes) if exports is None else exports
    exports = exports.select(F.col("path").alias("target"), F.col("shown").alias("imported"), "origin_path", "origin")
    return names.join(graphs.sent(exports), ["target", "imported"], "left").select("path", "local", "imported", "name", "target", "origin_path", "origin")


def links(bindings: DataFrame, facts: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(path, fn, ix, callee_fn): calls whose function is known. A name of the file goes before an imported one."""
    calls = bindings.filter("kind = 'call'").select("path", "fn", "ix", "callee")
    defined = bindings.filter("kind IN ('param', 'return', 'assign', 'call') AND fn <> '' AND fn NOT LIKE '@%'").select("path", F.col("fn").alias("short")).unionByName(of_kind(facts, "function").filter("name <> '(anonymous)'").select("path", F.col("name").alias("short"))).distinct()
    plain = F.regexp_extract("callee", r"^(?:this\.)?([\w$]+)$", 1)
    local = calls.withColumn("short", plain).join(defined, ["path", "short"]).select("path", "fn", "ix", fn_id(F.col("path"), F.col("short")).alias("callee_fn"), F.lit(0).alias("rank"))

    shown = graphs.cut(exported_names(facts, files, prefixes))
    known = symbols(facts, files, prefixes, shown)
    head, member = F.regexp_extract("callee", r"^([\w$]+)", 1), F.regexp_extract("callee", r"^[\w$]+\.([\w$]+)$", 1)
    met = calls.withColumns({"local": head, "member": member}).join(known, ["path", "local"])
    direct = met.filter("member = '' AND callee = local AND origin IS NOT NULL").select("path", "fn", "ix", F.col("origin_path").alias("p"), F.col("origin").alias("o"))
    inside = met.filter("member <> '' AND imported = '*' AND target IS NOT NULL").select("path", "fn", "ix", F.col("target").alias("path2"), F.col("member").alias("shown"))
    exports = shown.select(F.col("path").alias("path2"), "shown", F.col("origin_path").alias("p"), F.col("origin").alias("o"))
    through = inside.join(exports, ["path2", "shown"]).select("path", "fn", "ix", "p", "o")
    away = direct.unionByName(through).join(defined.select(F.col("path").alias("p"), F.col("short").alias("o")), ["p", "o"], "left_semi").select("path", "fn", "ix", fn_id(F.col("p"), F.col("o")).alias("callee_fn"), F.lit(1).alias("rank"))
    return local.unionByName(away).groupBy("path", "fn", "ix").agg(F.min_by("callee_fn", F.struct("rank", "callee_fn")).alias("callee_fn"))


def bases(facts: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(class_id, base_id): each class and the class that it extends, an imported one before one of its file; ids as fn_id."""
    classes = of_kind(facts, "class").select("path", "name", F.col("about")["extends"].alias("base"))
    below = classes.filter("base IS NOT NULL")
    known = symbols(facts, files, prefixes).filter("origin IS NOT NULL").select("path", F.col("local").alias("base"), fn_id(F.col("origin_path"), F.col("origin")).alias("away"))
    here = classes.select("path", F.col("name").alias("base"), fn_id(F.col("path"), F.col("name")).alias("near")).distinct()
    met = below.join(known, ["path", "base"], "left").join(here, ["path", "base"], "left")
    return met.select(fn_id(F.col("path"), F.col("name")).alias("class_id"), F.coalesce("away", "near").alias("base_id")).filter("base_id IS NOT NULL").distinct()


def dispatched(classes: DataFrame, extends: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_id, method, owner, depth): for each class(class_id) and each method that it or a class above has, the nearest owner.

    extends(class_id, base_id), methods(class_id, method). The closure of a class's line follows `extends` upwards.
    """
    up = graphs.cut(extends.select(F.col("class_id").alias("at"), "base_id"))
    line = graphs.cheapest(classes.select("class_id", F.col("class_id").alias("at"), F.lit(0).alias("depth")), ["class_id", "at"], "depth", lambda new: new.join(up, "at").select("class_id", F.col("base_id").alias("at"), (F.col("depth") + 1).alias("depth")))
    met = line.join(methods.select(F.col("class_id").alias("at"), "method"), "at")
    return met.groupBy("class_id", "method").agg(F.min_by("at", "depth").alias("owner"), F.min("depth").alias("depth"))


def async_calls(found: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of links(...) whose function is declared async, wherever it stands."""
    declared = of_kind(facts, "function").filter((told("async") == "true") & (F.col("name") != "(anonymous)")).select(fn_id(F.col("path"), F.col("name")).alias("callee_fn")).distinct()
    return found.join(declared, "callee_fn", "left_semi")


def async_names(facts: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(path, callee): the names by which a file calls functions of other files that are declared async: an imported name, or a
    member of a module that is imported whole. Re-exports are followed."""
    shown = graphs.cut(exported_names(facts, files, prefixes))
    known = symbols(facts, files, prefixes, shown)
    direct = known.filter("origin IS NOT NULL").select("path", F.col("local").alias("callee"), "origin_path", "origin")
    whole = known.filter("imported = '*' AND target IS NOT NULL").select(F.col("path").alias("from_path"), "local", F.col("target").alias("path"))
    member = whole.join(graphs.sent(shown), "path").select(F.col("from_path").alias("path"), F.concat("local", F.lit("."), "shown").alias("callee"), "origin_path", "origin")
    declared = of_kind(facts, "function").filter(told("async") == "true").select(F.col("path").alias("origin_path"), F.col("name").alias("origin")).distinct()
    return direct.unionByName(member).join(graphs.sent(declared), ["origin_path", "origin"], "left_semi").select("path", "callee").distinct()


def callers(found: DataFrame, callee_fn: str) -> DataFrame:
    """(caller) functions that call one."""
    return found.filter(F.col("callee_fn") == callee_fn).select(fn_id(F.col("path"), F.col("fn")).alias("caller")).distinct()
