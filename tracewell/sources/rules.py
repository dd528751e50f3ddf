"""Taint rule files: sources, sinks and sanitizers of a project's own, as patterns.

A file is JSON or a small subset of YAML (maps, lists, plain and quoted scalars, flow lists). Patterns:

- `req.body`: reading the name, or a field below it;
- `db.query($sql, ...)`, `$db.query($sql)`, `eval($code)`: a call; `$name` as an object stands for any;
- `@Body() $param`: a decorated parameter;
- `$x.innerHTML = $value`: an assignment to a field.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tracewell.taint.summaries import Catalogue

# Names of rule files in their order, and of the folder of further ones.
FILES = (".tracewell-taint.yml", ".tracewell-taint.yaml", ".tracewell-taint.json")
FOLDER = ".tracewell/taint-rules"


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\[\]]+", text[1:-1]) if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    if text in ("", "null", "~"):
        return None
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _plain(line: str) -> str:
    """A line without its comment."""
    return re.sub(r"(^|\s)#[^'\"]*$", "", line).rstrip()


def parse_yaml(text: str):
    """The value of a YAML text of the subset."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_plain, text.splitlines()) if x.strip() and x.strip() != "---"]

    def node(at: int, indent: int):
        if at >= len(lines) or lines[at][0] < indent:
            return None, at
        indent = lines[at][0]
        if lines[at][1] == "-" or lines[at][1].startswith("- "):
            out: list = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                rest = lines[at][1][1:].strip()
                if not rest:
                    value, at = node(at + 1, indent + 1)
                elif re.match(r"[\w$-]+:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)  # a map that begins on the dash's line
                    value, at = node(at, indent + 2)
                else:
                    value, at = _scalar(rest), at + 1
                out.append(value)
            return out, at
        out_map: dict = {}
        while at < len(lines) and lines[at][0] == indent and (m := re.match(r"(['\"]?)([^'\":]+)\1\s*:(?:\s+(.*))?$", lines[at][1])):
            key, rest = m[2].strip(), (m[3] or "").strip()
            if rest:
                out_map[key], at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- ")):
                out_map[key], at = node(at + 1, lines[at + 1][0])
            else:
                out_map[key], at = None, at + 1
        if not out_map:
            raise ValueError(f"line {lines[at][1]!r} is neither a map nor a list")
        return out_map, at

    value, at = node(0, 0) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"cannot read {lines[at][1]!r}")
    return value


@dataclass(frozen=True)
class Pattern:
    kind: str  # read, call, decorator, assignment
    name: str  # dotted; "*." in front for any object
    arguments: tuple[str, ...] = ()

    @property
    def tainted(self) -> tuple[int, ...]:
        return tuple(k for k, a in enumerate(self.arguments) if a.startswith("$"))


def pattern(text: str) -> Pattern:
    text = text.strip()
    wide = lambda name: re.sub(r"^\$\w+\.", "*.", name).removesuffix(".**").removesuffix(".*")
    arguments = lambda inside: tuple(a.strip() for a in inside.split(",") if a.strip())
    if m := re.fullmatch(r"@(\w+)\(([^)]*)\)\s*(\$?\w+)?", text):
        return Pattern("decorator", m[1], arguments(m[2]))
    if (m := re.fullmatch(r"([\w$.]+)\s*=\s*(\$?\w.*)", text)) and "(" not in text:
        return Pattern("assignment", wide(m[1]), (m[2],))
    if m := re.fullmatch(r"(.+?)\(([^)]*)\)", text):
        return Pattern("call", wide(m[1]), arguments(m[2]))
    if not re.fullmatch(r"[\w$.*\[\]?]+", text):
        raise ValueError(f"no pattern: {text!r}")
    return Pattern("read", wide(text))


SECTIONS = ("sources", "sinks", "sanitizers", "propagators")


@dataclass
class Rules:
    """Rules by id, what they and the global lists say, and what could not be read: (file, message)."""

    rules: dict[str, dict] = field(default_factory=dict)
    found: dict[str, list[tuple[Pattern, dict]]] = field(default_factory=lambda: {s: [] for s in SECTIONS})
    errors: list[tuple[str, str]] = field(default_factory=list)

    def catalogue(self, base: Catalogue | None = None) -> Catalogue:
        """The names of base with those of the rules in front."""
        base = base or Catalogue()
        sources = [(p.name, spec.get("kind") or p.name) for p, spec in self.found["sources"] if p.kind == "read"]
        sinks = [(spec.get("kind") or "custom", (p.name,)) for p, spec in self.found["sinks"] if p.kind == "call"]
        wanted = {p.name: tuple(spec.get("taintedArgs") or p.tainted) for p, spec in self.found["sinks"] if p.kind == "call" and (spec.get("taintedArgs") or p.tainted)}
        sanitizers = [(spec.get("sanitizationKind") or "custom", (p.name,)) for p, spec in self.found["sanitizers"] if p.kind == "call"]
        decorators = {p.name: spec.get("kind") or p.name for p, spec in self.found["sources"] if p.kind == "decorator"}
        return Catalogue(sources + base.sources, sinks + base.sinks, sanitizers + base.sanitizers, base.arguments | wanted, base.decorators | decorators)


def merged(texts: dict[str, str]) -> Rules:
    """Rules of texts by file name, in order: of rules with one id the last counts; global lists add up; a rule that is not
    enabled says nothing; a file or pattern that cannot be read is an error of its own and the others still count."""
    out = Rules()

    def take(section: str, given: list | None, file: str) -> None:
        for spec in given or []:
            spec = {"pattern": spec} if isinstance(spec, str) else spec
            try:
                out.found[section].append((pattern(spec["pattern"]), spec))
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                out.errors.append((file, f"{section}: {e}"))

    files: dict[str, str] = {}
    for file, text in texts.items():
        try:
            given = json.loads(text) if file.endswith(".json") else parse_yaml(text)
            if not isinstance(given, dict):
                raise ValueError("no map at the top")
        except ValueError as e:
            out.errors.append((file, str(e)))
            continue
        for section in SECTIONS[:1] + SECTIONS[2:]:
            take(section, given.get("global" + section.capitalize()), file)
        for rule in given.get("rules") or []:
            if not isinstance(rule, dict) or "id" not in rule:
                out.errors.append((file, "a rule without an id"))
                continue
            out.rules[rule["id"]] = rule
            files[rule["id"]] = file
    for key, rule in out.rules.items():
        if rule.get("enabled", True) is not False:
            for section in SECTIONS:
                take(section, rule.get(section), files[key])
    return out


def load(spark, root: str) -> Rules:
    """Rules of a project's fixed files and of its folder of rules, read on the driver (they are few and small)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda path: jvm.org.apache.hadoop.fs.Path(path)  # noqa: E731  Spark's own readers leave out names with a dot in front
    base = root.rstrip("/")
    fs = at(base).getFileSystem(conf)
    paths = [f"{base}/{f}" for f in FILES]
    if fs.exists(at(f"{base}/{FOLDER}")):
        more = sorted(s.getPath().getName() for s in fs.listStatus(at(f"{base}/{FOLDER}")))
        paths += [f"{base}/{FOLDER}/{f}" for f in more if re.search(r"(?i)\.(ya?ml|json)$", f)]
    found: dict[str, str] = {}
    for path in paths:
        if fs.exists(at(path)):
            stream = fs.open(at(path))
            try:
                found[path] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return merged(found)
