"""Predicates over file paths, as Column expressions on the lower-cased path with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results, one kind of path each. They use no look-around, so other engines can run them.
TEST = (
    r"\.(test|spec)\.(ts|js|tsx|jsx|mjs|cjs)$",
    r"(^|/)__tests__/", r"(^|/)__test__/", r"(^|/)tests?/", r"(^|/)specs?/",
    r"\.e2e-spec\.(ts|js)$", r"\.e2e\.(ts|js)$", r"\.integration\.(test|spec)\.(ts|js)$", r"\.unit\.(test|spec)\.(ts|js)$",
    r"(^|/)cypress/", r"(^|/)e2e/", r"(^|/)integration/",
    r"vitest\.config\.(ts|js)$", r"jest\.config\.(ts|js)$", r"jest\.setup\.(ts|js)$",
    r"(^|/)test-utils/", r"(^|/)test-helpers/", r"(^|/)fixtures/", r"(^|/)__fixtures__/", r"(^|/)__mocks__/",
    r"\.fixture\.", r"(^|/)mock", r"(^|/)examples/", r"(^|/)demos/", r"(^|/)stubs/",
)
GENERATED = (
    r"(^|/)generated/", r"(^|/)__generated__/", r"(^|/)\.next/", r"(^|/)dist/", r"(^|/)build/", r"(^|/)out/", r"(^|/)output/", r"(^|/)lib/",
    r"@generated", r"autogenerated", r"auto-generated", r"do not edit", r"generated by",
    r"\.generated\.(ts|js|tsx|jsx)$", r"\.g\.(ts|js)$", r"-generated\.(ts|js)$", r"__generated__/.*\.tsx?$", r"\.d\.ts$",
    r"\.pb\.(ts|js)$", r"_pb\.(ts|js)$", r"\.proto\.ts$", r"\.graphql\.ts$", r"/\.prisma/", r"@prisma/client",
    r"/migrations?/", r"/migrate/", r"swagger-codegen", r"openapi-generator",
    r"package-lock\.json$", r"yarn\.lock$", r"pnpm-lock\.yaml$", r"/node_modules/",
    r"/coverage/", r"/\.nyc_output/", r"/docs?/api/", r"/typedoc/",
)
COMMAND = (
    r"(^|/)bin/", r"(^|/)cli/", r"(^|/)scripts/", r"(^|/)tools/", r"/cli\.(ts|js|mjs|cjs)$", r"/index\.ts$", r"/main\.(ts|js)$",
    r"(^|/)debug/", r"(^|/)dev-tools/", r"(^|/)dev-server/",
)
CONFIG = (
    r"(^|/)config/", r"(^|/)configs/", r"(^|/)configuration/", r"\.config\.(ts|js|mjs|cjs)$", r"\.conf\.(ts|js)$",
    r"/config\.(ts|js)$", r"/settings\.(ts|js)$", r"tsconfig.*\.json$", r"jest\.config\.", r"webpack\.config\.", r"vite\.config\.", r"rollup\.config\.",
)
MIGRATION = (
    r"(^|/)migrations?/", r"(^|/)migrate/", r"(^|/)seeds?/", r"(^|/)seeders?/", r"\.migration\.(ts|js)$", r"\.seed\.(ts|js)$",
    r"/seeds?(er)?s?\.(ts|js|mjs|cjs)$",
)
ARTIFACT = (r"(^|/)public/assets/", r"(^|/)dist/assets/", r"(^|/)build/static/", r"/.next/static/", r"(^|/)\.nuxt/", r"(^|/)\.output/", r"(^|/)storybook-static/")
HASHED_NAME = r"[-.][A-Za-z0-9]{7,}$"


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"({p})" for p in patterns)


def fits(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is in the path, as one expression: chains of tests multiply where plans are collapsed."""
    return path.rlike("|".join(f"(?:{p})" for p in patterns))


def normalized(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def is_test(path: Column) -> Column:
    return fits(normalized(path), TEST)


def is_generated(path: Column) -> Column:
    return fits(normalized(path), GENERATED)


def is_command(path: Column) -> Column:
    return fits(normalized(path), COMMAND)


def is_config(path: Column) -> Column:
    return fits(normalized(path), CONFIG)


def is_migration(path: Column) -> Column:
    return fits(normalized(path), MIGRATION)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_artifact(path: Column) -> Column:
    name = F.regexp_replace(base_name(path), r"(?i)\.(m?js|cjs)$", "")
    return F.lower(path).rlike(any_of(ARTIFACT)) | name.rlike(HASHED_NAME)


def category(path: Column) -> Column:
    return F.when(is_test(path), "test").when(is_generated(path), "generated").otherwise("production")
