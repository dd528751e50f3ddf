"""Project sources: source trees, manifests, lockfiles, aliases, configuration and workspaces."""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import paths

# Names and levels that decide results.
EXTENSIONS = ("ts", "js", "tsx", "jsx")
CONFIG_NAMES = ("tracewell.config.json", ".tracewellrc.json", ".tracewellrc")
ALIAS_FILES = ("tsconfig.json", "tsconfig.build.json", "tsconfig.app.json", "tsconfig.base.json")
RULES = {
    "stack-trace-exposure": "error", "hardcoded-secret": "error", "sql-injection": "error", "xss-detector": "error", "idor": "error",
    "missing-await": "warn", "empty-catch": "warn", "console-in-production": "warn", "hallucinated-deps": "warn",
}


@dataclass
class Config:
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))
    fail_on: str = "error"
    exclude_tests: bool = True
    respect_ignore: bool = True
    confidence_threshold: str = "high"
    exclude: tuple[str, ...] = ()

    @classmethod
    def merged(cls, text: str | None) -> Config:
        """The defaults, with what a JSON text sets; rules are merged one by one. Text that is no JSON object counts as none."""
        try:
            given = json.loads(text) if text else {}
        except ValueError:
            given = {}
        given = given if isinstance(given, dict) else {}
        base = cls()
        return cls(base.rules | given.get("rules", {}), given.get("failOn", base.fail_on), given.get("excludeTestFiles", base.exclude_tests), given.get("respectGitignore", base.respect_ignore), given.get("confidenceThreshold", base.confidence_threshold), tuple(given.get("exclude", ())))

    def enabled(self, rule: str) -> bool:
        return self.rules.get(rule) != "off"


def upward(start: str, names: tuple[str, ...]) -> str | None:
    """The first of the names in a local folder or, failing that, in the folders above it."""
    folder = os.path.abspath(start)
    while True:
        for name in names:
            if os.path.isfile(os.path.join(folder, name)):
                return os.path.join(folder, name)
        if os.path.dirname(folder) == folder:
            return None
        folder = os.path.dirname(folder)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, script_kind) of every source file below root; other files are pruned from the listing."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    path = F.regexp_replace("path", "^file:", "")
    kind = F.element_at(F.split(F.lower("path"), r"\."), -1)
    return read.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).withColumn("script_kind", F.when(kind.isin(*EXTENSIONS), kind).otherwise("js"))


def scanned(files: DataFrame, config: Config, rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """The files worth parsing: path rules apply before any text is read by Python."""
    from tracewell.sources import ignore

    out = files.filter(~paths.is_artifact(F.col("path")))
    if config.respect_ignore and rules:
        out = ignore.kept(out, rules)
    if config.exclude:
        out = ignore.kept(out, ignore.parse(config.exclude))
    return out.filter(~paths.is_test(F.col("path"))) if config.exclude_tests else out


MANIFEST = "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def manifests(files: DataFrame) -> DataFrame:
    """(dir, manifest, workspaces array<string>) of package.json texts (path, content); workspaces as a list or as {packages}."""
    parsed = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("manifest", F.from_json("content", MANIFEST))
    listed = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"))
    return parsed.filter("manifest IS NOT NULL").select(F.regexp_replace("path", r"/?package\.json$", "").alias("dir"), "manifest", F.coalesce(listed, F.array().cast("array<string>")).alias("workspaces"))


def dependencies(read: DataFrame) -> DataFrame:
    """(dir, name, section) of manifests."""
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(F.map_keys(F.col("manifest")[s]), F.array().cast("array<string>")).alias("names")) for s in SECTIONS])
    return read.select("dir", F.explode(sections).alias("s")).select("dir", F.explode("s.names").alias("name"), F.col("s.section").alias("section"))


def workspaces(read: DataFrame) -> DataFrame:
    """(name, dir) of packages that a manifest's workspace patterns take in; `*` is one segment and `**` any number."""
    root = read.select(F.col("dir").alias("root"), F.explode("workspaces").alias("pattern"))
    member = read.select("dir", F.col("manifest.name").alias("name"))
    base = F.when(F.col("root") == "", F.lit("")).otherwise(F.concat("root", F.lit("/")))
    relative = F.when(F.col("dir").startswith(base) & (F.col("dir") != F.col("root")), F.expr("substr(dir, length(CASE WHEN root = '' THEN '' ELSE concat(root, '/') END) + 1)"))
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"^\./|/$", ""), r"([.+^$(){}|\[\]])", r"\\$1")
    fits = lambda text, pattern: F.call_function("rlike", text, pattern)  # noqa: E731  the pattern is a column
    shape = F.concat(F.lit("^"), F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))
    few = root.count() <= 1 << 14  # patterns of a project: a few; the join is by their shape, so many would be slow as well
    return member.join(F.broadcast(root) if few else root, relative.isNotNull() & fits(relative, shape)).select("name", "dir").distinct()


def locked_packages(files: DataFrame) -> DataFrame:
    """(name) of the first lockfile there is, in the order bun, npm, yarn, pnpm."""
    name = F.element_at(F.split("path", "/"), -1)
    bun = F.regexp_extract_all("content", F.lit(r'(?m)^    "([^"]+)": \['), 1)
    npm = F.transform(F.map_keys(F.from_json(F.get_json_object("content", "$.packages"), "map<string,string>")), lambda k: F.regexp_replace(k, "^node_modules/", ""))
    yarn = F.regexp_extract_all("content", F.lit(r'(?m)^"?(@?[a-z0-9][-a-z0-9._/]*)@'), 1)
    pnpm = F.regexp_extract_all("content", F.lit(r"(?m)^  /?'?(@?[a-z0-9][-a-z0-9._/]*)@"), 1)
    rank, found = F.lit(None).cast("int"), F.array().cast("array<string>")
    for r, (file, names) in enumerate((("bun.lock", bun), ("package-lock.json", npm), ("yarn.lock", yarn), ("pnpm-lock.yaml", pnpm))):
        rank, found = F.when(name == file, F.lit(r)).otherwise(rank), F.when(name == file, names).otherwise(found)
    best = files.select(rank.alias("rank"), found.alias("names")).filter("rank IS NOT NULL").agg(F.min_by("names", "rank").alias("names"))
    return best.select(F.explode("names").alias("name")).filter("name <> ''").distinct()


def known_packages(files: DataFrame) -> DataFrame:
    """(name) of all packages that a project may import: its own, its workspaces', declared and locked ones."""
    read = manifests(files)
    own = read.select(F.col("manifest.name").alias("name"))
    return own.unionByName(dependencies(read).select("name")).unionByName(locked_packages(files)).filter("name IS NOT NULL").distinct()


def installed(paths: DataFrame) -> DataFrame:
    """(dir, name) of packages below node_modules folders, from the paths of their manifests."""
    shape = r"^(.*?)/?node_modules/((?:@[^/]+/)?[^/]+)/package\.json$"
    return paths.filter(F.col("path").rlike(shape)).select(F.regexp_extract("path", shape, 1).alias("dir"), F.regexp_extract("path", shape, 2).alias("name")).distinct()


def ancestors(path: Column) -> Column:
    """The folders that a file lies in, the nearest first; "" is the top of a relative path."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def importable(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(path, name) of imports(path, package) that exist for their file: a package that one of the folders above declares or
    is, a workspace or what any workspace declares, what the top declares or the lockfile holds, or an installed one above.

    files: manifests and lockfiles (path, content); modules: installed(...). Each way is a semi-join on names; only the ways
    by folder look at the folders of the imports' files.
    """
    wanted = imports.select("path", "package").distinct()
    read = manifests(files)
    top = F.min_by("dir", F.struct(F.length("dir"), F.col("dir")))
    declared = dependencies(read).select("dir", "name")
    named = read.select("dir", F.col("manifest.name").alias("name")).filter("name IS NOT NULL")
    near = declared.unionByName(named)
    near = near.unionByName(modules.select("dir", "name")) if modules is not None else near
    above = wanted.select("path", "package", F.explode(ancestors(F.col("path"))).alias("dir"))
    by_folder = above.join(near.withColumnRenamed("name", "package").distinct(), ["dir", "package"], "left_semi").select("path", "package")
    spaces = workspaces(read)
    everywhere = spaces.select("name").unionByName(declared.join(spaces.select("dir").distinct(), "dir", "left_semi").select("name")).unionByName(declared.join(read.agg(top.alias("dir")), "dir", "left_semi").select("name")).unionByName(locked_packages(files))
    by_name = wanted.join(everywhere.withColumnRenamed("name", "package").distinct(), "package", "left_semi").select("path", "package")
    return by_folder.unionByName(by_name).distinct().withColumnRenamed("package", "name")


def workspace_of(path: Column, spaces: list[tuple[str, str]], whole_segments: bool = False) -> Column:
    """The first workspace (name, dir) whose directory the path starts with, as plain text or by whole segments."""
    out = F.lit(None).cast("string")
    for name, folder in reversed(spaces):
        out = F.when(path.startswith(folder.rstrip("/") + "/" if whole_segments else folder), name).otherwise(out)
    return out


def aliases(texts: dict[str, str], root: str = "") -> set[str]:
    """Alias prefixes of tsconfig texts by path, along their chains of extends: "@/*" gives "@/", "@config" itself."""
    found: set[str] = set()
    seen: set[str] = set()

    def take(path: str) -> None:
        if path in seen or path not in texts:
            return
        seen.add(path)
        bare = re.sub(r"//[^\n]*", "", texts[path])
        bare = re.sub(r"/\*.*?\*/", "", bare, flags=re.S)
        bare = re.sub(r",(\s*[}\]])", r"\1", bare)
        try:
            given = json.loads(bare)
        except ValueError:
            return
        if isinstance(parent := given.get("extends"), str):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), parent))
            take(target if target.endswith(".json") else target + ".json")
        for pattern in given.get("compilerOptions", {}).get("paths", {}):
            found.add(pattern[:-1] if pattern.endswith("/*") else pattern)

    for name in ALIAS_FILES:
        take(posixpath.join(root, name))
    return found


def resolved(imports: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """imports (path, name, ...) with target: the file that a relative or aliased specifier means, or null.

    Every specifier is tried as it is, with each extension and as a folder's index; the first that exists wins.
    """
    spec = F.col("name")
    base = F.when(spec.startswith("."), F.concat(F.regexp_replace("path", r"[^/]*$", ""), spec)).when(spec.startswith("/"), spec)
    for prefix, folder in reversed((prefixes or {}).items()):  # the first alias that fits wins
        base = F.when(spec.startswith(prefix), F.concat(F.lit(folder), F.expr(f"substr(name, {len(prefix) + 1})"))).otherwise(base)
    tries = [*[f".{e}" for e in EXTENSIONS], *[f"/index.{e}" for e in EXTENSIONS], ""]
    options = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(t).alias("tail")) for o, t in enumerate(tries)])
    keyed = imports.select("path", "name", plain_path(base).alias("base")).filter("base IS NOT NULL").distinct()
    probes = keyed.select("path", "name", F.explode(options).alias("t"), "base").select("path", "name", "t.o", F.concat("base", "t.tail").alias("target"))
    hits = probes.join(files.select(F.col("path").alias("target")).distinct().hint("merge"), "target", "left_semi").groupBy("path", "name").agg(F.min_by("target", "o").alias("target"))
    return imports.join(hits.hint("merge"), ["path", "name"], "left")


def plain_path(path: Column) -> Column:
    """Without `.` segments, and with `..` taken up by the segment before."""
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(kept, "/")
