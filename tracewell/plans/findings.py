"""Queries over the issue table, each with its SQL twin for another engine on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import paths, scalars
from tracewell.operators import graphs, incremental, report, triage
from tracewell.plans.catalog import register
from tracewell.session import share_code
from tracewell.sources.issues import ENGINES, FOLDERS, TOPICS, call_edges, from_events, issues, pick, table

# the SQL side of the adapters and of the triage chain


def _case(value: str, options: dict, default: str = "NULL") -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {value} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in options.items()) + f" ELSE {default} END"


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LOW = "lower(file_path)"
_CONF = "coalesce(confidence, 'high')"
_ISSUES = f"""issues AS (
  SELECT *, regexp_matches(replace({_LOW}, '\\', '/'), '{paths.any_of(paths.TEST)}') AS is_test,
    regexp_matches(replace({_LOW}, '\\', '/'), '{paths.any_of(paths.GENERATED)}') AS is_generated
  FROM (
    SELECT event_id AS ord, {_case("event_type", ENGINES)} AS engine,
      CASE WHEN value >= 120 THEN 'error' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity,
      CASE WHEN k >= 60 THEN 'high' WHEN k >= 30 THEN 'medium' WHEN k >= 10 THEN 'low' END AS confidence,
      '/srv/app/' || {_list(FOLDERS)}[user_id % {len(FOLDERS)} + 1] || '/u' || user_id || '.ts' AS file_path,
      CAST(event_id % 400 + 1 AS INTEGER) AS line,
      'Check ' || event_type || ': ' || {_list(TOPICS)}[event_id % {len(TOPICS)} + 1] AS message,
      k / 16.0::DOUBLE AS entropy, '  ' || event_type || '   (' || event_id % 5 || ') ' AS context_snippet
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  )
)"""
_AUTO = f"""((engine = 'missing-await' AND {_any("lower(message)", triage.FIRE_AND_FORGET)})
  OR (engine = 'console-in-production' AND {_any(_LOW, triage.DEV_UTILITY)})
  OR (engine = 'empty-catch' AND ({_any(_LOW, ("/migration", "/seed", "/init", "/setup"))} OR ({_any(_LOW, ("package-resolver", "config"))} AND {_any("lower(message)", ("silently swallows", "empty catch"))})))
  OR ((engine = 'idor' OR contains(lower(message), 'validation')) AND ({_any(_LOW, triage.QUIET_ROUTE)} OR coalesce(confidence = 'low', false))))"""
_BOOST = f"""CASE WHEN (engine = 'hardcoded-secret' AND entropy > 4.5) OR (engine = 'stack-trace-exposure' AND {_any(_LOW, ("/api/", "/route", "/handler"))}) THEN 'high' ELSE confidence END"""
_ADJUST = f"""CASE
  WHEN engine = 'console-in-production' THEN CASE WHEN {_any(_LOW, ("/dev/", "/debug/", "/scripts/", "/tools/"))} OR is_test THEN 'info' ELSE step2 END
  WHEN engine IN ('empty-catch', 'missing-await') AND is_test AND step2 = 'error' THEN 'warning' ELSE step2 END"""


def _adjusted(source: str) -> str:
    return f"""(SELECT * REPLACE ({_ADJUST} AS severity) FROM (
    SELECT *, CASE WHEN is_test AND engine <> 'hardcoded-secret' THEN CASE step1 WHEN 'error' THEN 'warning' WHEN 'warning' THEN 'info' ELSE step1 END ELSE step1 END AS step2
    FROM (SELECT *, CASE WHEN severity = 'error' AND confidence = 'low' THEN 'warning' ELSE severity END AS step1 FROM {source})
  ) WHERE NOT is_generated)"""


def _scored(source: str) -> str:
    security = ", ".join(f"'{s}'" for s in scalars.SECURITY)
    return f"""(SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS priority FROM (
    SELECT *, CAST(least(floor((CASE WHEN is_generated THEN 0.0::DOUBLE ELSE
        (CASE severity WHEN 'error' THEN 40.0::DOUBLE WHEN 'warning' THEN 20.0::DOUBLE ELSE 5.0::DOUBLE END)
        * (CASE {_CONF} WHEN 'high' THEN 2.0::DOUBLE WHEN 'medium' THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END)
        * (CASE WHEN is_test AND engine <> 'hardcoded-secret' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) END)
      * (CASE WHEN engine IN ({security}) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN {_any(_LOW, ("/config/", "/auth/", "/security/", "credentials"))} OR {_LOW} LIKE '%.env' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN {_any(_LOW, ("/dev/", "/debug/", "/scripts/"))} THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) + 0.5::DOUBLE), 100) AS INTEGER) AS risk_score
    FROM {source}))"""


_WITH = f"WITH {_ISSUES}"
_KEPT = f"kept AS (SELECT * REPLACE ({_BOOST} AS confidence) FROM issues WHERE NOT {_AUTO})"
_TRIAGED = f"{_WITH}, {_KEPT}, triaged AS (SELECT * FROM {_scored(_adjusted('kept'))})"
_DISPLAY = f"""((CASE severity WHEN 'error' THEN 100 WHEN 'warning' THEN 50 ELSE 10 END) * (CASE {_CONF} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) + ({_case("engine", scalars.DISPLAY_RANK, "0")}))"""


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triaged(issues(spark, sf_dir))


# triage


@register("q01_triage_summary", f"""{_TRIAGED} SELECT engine, priority, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors,
  count(DISTINCT file_path) AS files, max(risk_score) AS max_risk FROM triaged GROUP BY ALL""")
def q01(spark, sf_dir):
    return _triaged(spark, sf_dir).groupBy("engine", "priority").agg(
        F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.countDistinct("file_path").alias("files"), F.max("risk_score").alias("max_risk"))


@register("q02_auto_ignore", f"{_WITH} SELECT ord, engine, file_path FROM issues WHERE NOT {_AUTO}")
def q02(spark, sf_dir):
    found = issues(spark, sf_dir)
    return found.filter(~triage.auto_ignored(found)).select("ord", "engine", "file_path")


@register("q03_confidence_threshold", f"{_WITH} SELECT ord, confidence FROM issues WHERE {_CONF} IN ('high', 'medium')")
def q03(spark, sf_dir):
    return triage.at_least_confidence(issues(spark, sf_dir), "medium").select("ord", "confidence")


@register("q04_severity_adjust", f"{_WITH}, b AS (SELECT * REPLACE ({_BOOST} AS confidence) FROM issues) SELECT ord, engine, severity, confidence FROM {_adjusted('b')}")
def q04(spark, sf_dir):
    return triage.adjusted(triage.boosted(issues(spark, sf_dir))).select("ord", "engine", "severity", "confidence")


@register("q05_risk_priority", f"{_WITH} SELECT ord, risk_score, priority FROM {_scored('issues')}")
def q05(spark, sf_dir):
    return triage.scored(issues(spark, sf_dir)).select("ord", "risk_score", "priority")


@register("q06_display_risk", f"{_WITH} SELECT ord, {_DISPLAY} AS display_score FROM issues")
def q06(spark, sf_dir):
    return issues(spark, sf_dir).select("ord", scalars.display_risk(F.col("severity"), F.col("confidence"), F.col("engine")).alias("display_score"))


@register("q07_min_risk_priority_quiet", f"""{_TRIAGED} SELECT ord, risk_score, priority FROM triaged
  WHERE coalesce(risk_score, 0) >= 30 AND priority IN ('medium', 'high', 'critical') AND (severity = 'error' OR (severity = 'warning' AND {_CONF} = 'high'))""")
def q07(spark, sf_dir):
    least = scalars.lookup(F.coalesce("priority", F.lit("low")), scalars.PRIORITY, 0) >= scalars.PRIORITY["medium"]
    return triage.quiet(_triaged(spark, sf_dir).filter((F.coalesce("risk_score", F.lit(0)) >= 30) & least)).select("ord", "risk_score", "priority")


# reports


for _key, _name in (("severity", "q08_group_by_severity"), ("file_path", "q09_group_by_file"), ("engine", "q10_group_by_engine")):
    register(_name, f"""{_WITH} SELECT {_key}, count(*) AS total, count(*) FILTER (severity = 'error') AS errors,
      count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues GROUP BY 1""")(
        lambda spark, sf_dir, key=_key: report.by_key(issues(spark, sf_dir), key))


@register("q11_summary_buckets", f"""{_WITH} SELECT count(*) FILTER (severity = 'error' AND {_CONF} = 'high') AS critical,
  count(*) FILTER (severity = 'warning' AND {_CONF} = 'high') AS high, count(*) FILTER (severity = 'warning' AND {_CONF} = 'medium') AS medium,
  count(*) FILTER ({_CONF} = 'low') AS low FROM issues""")
def q11(spark, sf_dir):
    return report.summary_buckets(issues(spark, sf_dir))


@register("q12_final_counts", f"""{_WITH} SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count,
  count(*) FILTER (severity = 'info') AS info_count, CAST(0 AS BIGINT) AS low_count, count(*) AS total FROM issues""")
def q12(spark, sf_dir):
    return report.final_counts(issues(spark, sf_dir))


@register("q13_confidence_breakdown", f"{_WITH} SELECT {_CONF} AS confidence, count(*) AS n FROM issues GROUP BY 1")
def q13(spark, sf_dir):
    return issues(spark, sf_dir).groupBy(scalars.confidence(F.col("confidence")).alias("confidence")).agg(F.count("*").alias("n"))


@register("q14_engine_rollup_distinct_files", f"""{_WITH} SELECT engine, count(*) FILTER (severity = 'error') AS criticals,
  count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT file_path) AS files FROM issues GROUP BY 1""")
def q14(spark, sf_dir):
    return report.per_engine(issues(spark, sf_dir))


for _key, _name in (("file_path", "q15_top_files"), ("engine", "q16_top_engines")):
    register(_name, f"{_WITH} SELECT {_key}, count(*) AS n, min(ord) AS first_ord FROM issues GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 5")(
        lambda spark, sf_dir, key=_key: report.top_by_count(issues(spark, sf_dir), key, 5))


@register("q17_high_volume_engines", f"""{_WITH}, c AS (SELECT engine, count(*) AS n FROM issues GROUP BY 1), s AS (SELECT *, round(n / sum(n) OVER (), 6) AS share FROM c)
  SELECT * FROM s WHERE n >= 30 OR share >= 0.4""")
def q17(spark, sf_dir):
    return report.high_volume(issues(spark, sf_dir)).withColumn("share", F.round("share", 6))


@register("q18_diversified_top5", f"""{_WITH}, r AS (SELECT *, {_DISPLAY} AS display_score FROM issues),
  n AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY display_score DESC, ord) AS rn FROM r)
  SELECT ord, engine, display_score FROM n ORDER BY rn > 1, display_score DESC, ord LIMIT 5""")
def q18(spark, sf_dir):
    return report.diversified(issues(spark, sf_dir)).select("ord", "engine", "display_score")


@register("q19_top10_per_group_remaining", f"""{_WITH}, n AS (SELECT ord, engine, row_number() OVER (PARTITION BY engine ORDER BY ord) AS rn, count(*) OVER (PARTITION BY engine) AS total FROM issues)
  SELECT ord, engine, CAST(rn AS INTEGER) AS rn, greatest(total - 10, 0) AS remaining FROM n WHERE rn <= 10""")
def q19(spark, sf_dir):
    return report.top_per_group(issues(spark, sf_dir), "engine").select("ord", "engine", "rn", "remaining")


@register("q20_one_per_line", f"{_WITH} SELECT file_path, line, min(ord) AS ord FROM issues GROUP BY 1, 2")
def q20(spark, sf_dir):
    return report.first_in(issues(spark, sf_dir), ["file_path", "line"], F.col("ord")).select("file_path", "line", "ord")


@register("q21_danger_rank_top10", f"{_WITH} SELECT ord, engine, {_case('engine', scalars.DANGER_RANK, '99')} AS danger FROM issues WHERE severity = 'error' ORDER BY danger, ord LIMIT 10")
def q21(spark, sf_dir):
    return report.by_danger(issues(spark, sf_dir).filter("severity = 'error'")).select("ord", "engine", "danger")


@register("q22_common_prefix", f"""{_WITH}, e AS (SELECT min(string_split(file_path, '/')) AS a, max(string_split(file_path, '/')) AS b FROM issues),
  l AS (SELECT a, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM e)
  SELECT array_to_string(a[1:greatest(n - 1, 0)], '/') AS root FROM l""")
def q22(spark, sf_dir):
    return report.common_root(issues(spark, sf_dir))


# statement sequences: turns of conversations


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _in_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


@register("q23_sequence_gap", "SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', false) AS next_awaited FROM conversations")
def q23(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.lead("role").over(_in_turn()) == "assistant", F.lit(False)).alias("next_awaited"))


@register("q24_last_statement", """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn = 1 AND n > 1""")
def q24(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n")).filter("n > 1").select("conv_id", "turn")


@register("q25_nesting_level", """SELECT conv_id, turn, CAST(greatest(0, coalesce(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS level FROM conversations""")
def q25(spark, sf_dir):
    delta = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    before = F.sum(delta).over(_in_turn().rowsBetween(Window.unboundedPreceding, -1))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.greatest(F.lit(0), F.coalesce(before, F.lit(0))).cast("long").alias("level"))


# fingerprints and baselines

_EXACT = "substr(sha256(engine || ':' || message || ':' || trim(regexp_replace(context_snippet, '\\s+', ' ', 'g'))), 1, 16)"
_MESSAGE = "substr(sha256(engine || ':' || message), 1, 16)"
_BASE = "sha256(file_path || ':' || line || ':' || engine || ':' || substr(message, 1, 100))"


def _keys():
    return scalars.exact_key(F.col("engine"), F.col("message"), F.col("context_snippet")), scalars.message_key(F.col("engine"), F.col("message")), scalars.baseline_key(F.col("file_path"), F.col("line"), F.col("engine"), F.col("message"))


@register("q26_fingerprint", f"{_WITH} SELECT ord, {_EXACT} AS exact, {_MESSAGE} AS by_message, {_BASE} AS baseline FROM issues")
def q26(spark, sf_dir):
    exact, message, base = _keys()
    return issues(spark, sf_dir).select("ord", exact.alias("exact"), message.alias("by_message"), base.alias("baseline"))


_GROUPS = "SELECT {key} AS fingerprint, min(ord) AS primary_ord, count(*) AS occurrences, count(DISTINCT file_path) AS files FROM issues GROUP BY 1"


@register("q27_dedup_exact", f"{_WITH} {_GROUPS.format(key=_EXACT)}")
def q27(spark, sf_dir):
    return report.deduplicated(issues(spark, sf_dir), _keys()[0])


@register("q28_dedup_message", f"{_WITH} {_GROUPS.format(key=_MESSAGE)}")
def q28(spark, sf_dir):
    return report.deduplicated(issues(spark, sf_dir), _keys()[1])


@register("q29_dedup_stats", f"""{_WITH}, g AS ({_GROUPS.format(key=_EXACT)}) SELECT CAST(sum(occurrences) AS BIGINT) AS total, count(*) AS unique_groups,
  count(*) FILTER (occurrences > 1) AS duplicated_groups, CAST(floor((sum(occurrences) - count(*)) / sum(occurrences)::DOUBLE * 100 + 0.5) AS INTEGER) AS reduction_percent FROM g""")
def q29(spark, sf_dir):
    return report.dedup_stats(report.deduplicated(issues(spark, sf_dir), _keys()[0]))


@register("q30_baseline_new", f"""{_WITH}, f AS (SELECT *, {_BASE} AS fingerprint FROM issues) SELECT ord, fingerprint FROM f
  WHERE ord > (SELECT max(ord) * 2 // 3 FROM f) AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE ord <= (SELECT max(ord) * 2 // 3 FROM f))""")
def q30(spark, sf_dir):
    """The last third of the numbers against all before: every issue is on one side."""
    found = issues(spark, sf_dir).withColumn("fingerprint", _keys()[2])
    last = F.lit(table(spark, sf_dir, "events").agg(F.expr("max(event_id) * 2 div 3").alias("at")).first()["at"])
    return report.new_against(found.filter(F.col("ord") > last), found.filter(F.col("ord") <= last)).select("ord", "fingerprint")


@register("q31_first_per_key", f"{_WITH} SELECT engine, min(ord) AS ord, arg_min(message, ord) AS message FROM issues GROUP BY 1")
def q31(spark, sf_dir):
    return issues(spark, sf_dir).groupBy("engine").agg(F.min("ord").alias("ord"), F.min_by("message", "ord").alias("message"))


# paths, rules and names


@register("q32_path_categories", f"""{_WITH}, p AS (SELECT DISTINCT file_path, replace({_LOW}, '\\', '/') AS low, is_test, is_generated FROM issues) SELECT file_path,
  CASE WHEN is_test THEN 'test' WHEN is_generated THEN 'generated' ELSE 'production' END AS category, regexp_matches(low, '{paths.any_of(paths.COMMAND)}') AS is_command,
  regexp_matches(low, '{paths.any_of(paths.CONFIG)}') AS is_config, regexp_matches(low, '{paths.any_of(paths.MIGRATION)}') AS is_migration,
  regexp_matches(low, '{paths.any_of(paths.ARTIFACT)}') OR regexp_matches(regexp_replace(string_split(file_path, '/')[-1], '(?i)\\.(m?js|cjs)$', ''), '{paths.HASHED_NAME}') AS is_artifact FROM p""")
def q32(spark, sf_dir):
    p = F.col("file_path")
    return issues(spark, sf_dir).select("file_path").distinct().select(
        "file_path", paths.category(p).alias("category"), paths.is_command(p).alias("is_command"), paths.is_config(p).alias("is_config"), paths.is_migration(p).alias("is_migration"), paths.is_artifact(p).alias("is_artifact"))


#: Ignore rules in their order: pattern and whether it takes a path back.
_RULES = ((1, "/src/", False), (2, "/src/(api|auth)/", True), (3, "/u1[0-9]*\\.ts$", False), (4, "/src/api/u12", True))


@register("q33_ignore_last_match", f"""{_WITH}, p AS (SELECT DISTINCT file_path FROM issues), r AS (SELECT * FROM (VALUES {", ".join(f"({o}, '{x}', {str(n).lower()})" for o, x, n in _RULES)}) v(o, pattern, negated))
  SELECT file_path, coalesce(NOT arg_max(negated, o), false) AS ignored FROM p LEFT JOIN r ON regexp_matches(file_path, pattern) GROUP BY 1""")
def q33(spark, sf_dir):
    from tracewell.sources.ignore import ignored

    return issues(spark, sf_dir).select("file_path").distinct().select("file_path", ignored(F.col("file_path"), [(x, n) for _, x, n in _RULES]).alias("ignored"))


@register("q34_entropy", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
  c AS (SELECT word, length(word) AS n, unnest(list_distinct(string_split(word, ''))) AS ch FROM w WHERE length(word) > 0),
  s AS (SELECT word, (n - length(replace(word, ch, ''))) / n::DOUBLE AS p FROM c) SELECT word, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM s GROUP BY 1""")
def q34(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).filter(F.length("word") > 0).distinct()
    return names.select("word", (F.round(scalars.entropy(F.col("word")), 6) + F.lit(0.0)).alias("entropy"))


_SECRET = r"(AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{16,}|xox[bp]-[0-9A-Za-z-]{10,}|token = \"[0-9a-f]{40}\"|postgres://[a-z]+:[^@ ]+@)"


@register("q35_secret_scan", f"SELECT doc_id, regexp_extract(text, '{_SECRET}', 1) AS secret FROM documents WHERE regexp_matches(text, '{_SECRET}')")
def q35(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(_SECRET)).select("doc_id", F.regexp_extract("text", _SECRET, 1).alias("secret"))


@register("q36_suppression", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
  SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (regexp_matches(lines[i], '(?i)licen[cs]ed?') OR (i > 1 AND regexp_matches(lines[i - 1], '(?i)copyright'))) AS BIGINT) AS suppressed FROM n GROUP BY 1""")
def q36(spark, sf_dir):
    from tracewell.functions.snippets import with_previous

    pairs = with_previous(F.col("text"))
    hit = F.filter(pairs, lambda p: p["line"].rlike("(?i)licen[cs]ed?") | F.coalesce(p["previous"].rlike("(?i)copyright"), F.lit(False)))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(pairs).cast("long").alias("lines"), F.size(hit).cast("long").alias("suppressed"))


@register("q37_context_snippet", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 4 + 1 AS line FROM documents), s AS (SELECT doc_id, lines, line, greatest(1, line - 2) AS a, least(len(lines), line + 2) AS b FROM l WHERE line <= len(lines))
  SELECT doc_id, array_to_string(list_transform(range(a, b + 1), lambda i: CASE WHEN i = line THEN '> ' ELSE '  ' END || lpad(i::VARCHAR, 4, ' ') || ' | ' || lines[i]), chr(10)) AS snippet FROM s""")
def q37(spark, sf_dir):
    from tracewell.functions.snippets import context_snippet

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 4 + 1).cast("int").alias("line"))
    return docs.filter(F.col("line") <= F.size(F.split("text", "\n", -1))).select("doc_id", context_snippet(F.col("text"), F.col("line")).alias("snippet"))


_POPULAR = ("express", "react", "lodash", "axios", "antique", "almond", "burlywood", "chartreuse", "cornflower")


@register("q38_typosquat_nearest", f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), d AS (SELECT name, p, o, levenshtein(name, p) AS distance FROM w, (SELECT unnest({_list(_POPULAR)}) AS p, unnest(range(1, {len(_POPULAR) + 1})) AS o))
  SELECT name, arg_min(p, distance * 1000 + o) AS nearest, CAST(min(distance) AS INTEGER) AS distance FROM d WHERE distance > 0 GROUP BY 1""")
def q38(spark, sf_dir):
    from tracewell.functions.names import nearest

    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return words.withColumn("best", nearest(F.col("name"), _POPULAR)).select("name", "best.nearest", "best.distance").filter("distance IS NOT NULL")


_SPACES = (("web", "/srv/app/src/a"), ("api", "/srv/app/src/api"), ("dist", "/srv/app/dist"), ("core", "/srv/app/src"))


@register("q39_workspace_prefix", f"{_WITH} SELECT ord, CASE " + " ".join(f"WHEN starts_with(file_path, '{p}') THEN '{n}'" for n, p in _SPACES) + " END AS workspace FROM issues")
def q39(spark, sf_dir):
    from tracewell.sources.projects import workspace_of

    return issues(spark, sf_dir).select("ord", workspace_of(F.col("file_path"), list(_SPACES)).alias("workspace"))


@register("q40_import_resolution", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS spec FROM pages),
  f AS (SELECT DISTINCT '/' || lower(substr(spec, 2)) || CASE WHEN page_id % 2 = 0 THEN '.ts' ELSE '/index.ts' END AS path FROM h WHERE page_id % 3 = 0),
  c AS (SELECT DISTINCT spec, unnest(['.ts', '.js', '/index.ts', '/index.js', '']) AS ext, unnest([1, 2, 3, 4, 5]) AS o FROM h)
  SELECT spec, arg_min('/' || lower(substr(spec, 2)) || ext, o) AS path FROM c WHERE '/' || lower(substr(spec, 2)) || ext IN (SELECT path FROM f) GROUP BY 1""")
def q40(spark, sf_dir):
    low = F.concat(F.lit("/"), F.lower(F.expr("substr(spec, 2)")))
    refs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)"'), 1)).alias("spec"))
    files = refs.filter("page_id % 3 = 0").select(F.concat(low, F.when(F.col("page_id") % 2 == 0, ".ts").otherwise("/index.ts")).alias("path")).distinct()
    tries = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(e).alias("ext")) for o, e in enumerate((".ts", ".js", "/index.ts", "/index.js", ""))])
    probes = refs.select("spec").distinct().select("spec", F.explode(tries).alias("t")).select("spec", "t.o", F.concat(low, F.col("t.ext")).alias("path"))
    return probes.join(files, "path", "left_semi").groupBy("spec").agg(F.min_by("path", "o").alias("path"))


# graphs

_EDGES = """n AS (SELECT count(*) AS n FROM supplier), edges AS (
  SELECT s_suppkey AS caller, 0 AS edge_ix, (7 * s_suppkey + 3) % n + 1 AS callee FROM supplier, n UNION ALL
  SELECT s_suppkey, 1, (5 * s_suppkey) % n + 1 FROM supplier, n)"""


@register("q41_reverse_closure", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier
  UNION SELECT r.start, e.caller FROM r JOIN edges e ON r.node = e.callee) SELECT start, count(*) AS reached, min(node) AS least, max(node) AS greatest FROM r GROUP BY start""")
def q41(spark, sf_dir):
    """What every function is reached from, counted."""
    share_code(spark)
    start = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    return graphs.reached(call_edges(spark, sf_dir), start, "callee", "caller")


@register("q42_hierarchy", """WITH RECURSIVE h AS (SELECT s_suppkey AS class_id, s_suppkey AS ancestor, 0 AS depth FROM supplier
  UNION ALL SELECT class_id, ancestor // 2, depth + 1 FROM h WHERE ancestor > 1 AND depth < 40) SELECT class_id, ancestor, depth FROM h""")
def q42(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("tracewell_classes")
    return spark.sql("""WITH RECURSIVE h (class_id, ancestor, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM tracewell_classes
      UNION ALL SELECT class_id, ancestor div 2, depth + 1 FROM h WHERE ancestor > 1 AND depth < 40) SELECT class_id, ancestor, depth FROM h""")


_KINDS = ("database", "command", "html")


@register("q43_summary_fixpoint", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT s_suppkey AS fn, s_suppkey % 2 AS param, {_list(_KINDS)}[s_suppkey % 3 + 1] AS kind FROM supplier WHERE s_suppkey % 11 = 0
  UNION SELECT e.caller, (e.caller + e.edge_ix) % 2, r.kind FROM r JOIN edges e ON r.fn = e.callee AND r.param = e.edge_ix AND e.caller <> e.callee) SELECT fn, CAST(param AS BIGINT) AS param, kind FROM r""")
def q43(spark, sf_dir):
    s = F.col("s_suppkey")
    hits = table(spark, sf_dir, "supplier").filter("s_suppkey % 11 = 0").select(s.alias("fn"), (s % 2).alias("param"), pick(s, _KINDS).alias("kind"))
    calls = call_edges(spark, sf_dir).select("caller", ((F.col("caller") + F.col("edge_ix")) % 2).alias("caller_param"), "callee", F.col("edge_ix").cast("long").alias("callee_param"))
    return graphs.summary_fixpoint(hits, calls)


def _flow_sql(source: str, target: str, start: str, sink: str, depth: int = 4) -> str:
    return f"""WITH RECURSIVE {_EDGES}, p AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS depth, [s_suppkey] AS trail FROM supplier WHERE {start}
      UNION ALL SELECT p.start, e.{target}, p.depth + 1, list_append(p.trail, e.{target}) FROM p JOIN (SELECT DISTINCT caller, callee FROM edges) e ON p.node = e.{source}
      WHERE p.depth < {depth} AND NOT list_contains(p.trail, e.{target})),
      flows AS (SELECT start, node, depth, array_to_string(trail, '>') AS trail FROM p WHERE depth > 0 AND {sink})"""


def _flows(spark, sf_dir, source: str, target: str, start: str, sink: str, depth: int = 4) -> DataFrame:
    first = table(spark, sf_dir, "supplier").filter(start).select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    found = graphs.paths(call_edges(spark, sf_dir), first, source, target, depth).filter(f"depth > 0 AND {sink}")
    return found.withColumn("trail", F.array_join(F.col("trail").cast("array<string>"), ">"))


_FORWARD = ("caller", "callee", "s_suppkey % 20 = 1", "node % 11 = 0")


@register("q44_forward_flows", _flow_sql(*_FORWARD) + " SELECT * FROM flows")
def q44(spark, sf_dir):
    return _flows(spark, sf_dir, *_FORWARD)


_BACKWARD = ("callee", "caller", "s_suppkey % 11 = 0", "node % 20 = 1")


@register("q45_backward_flows", _flow_sql(*_BACKWARD) + " SELECT * FROM flows")
def q45(spark, sf_dir):
    return _flows(spark, sf_dir, *_BACKWARD)


_SUMMARY = """ SELECT sink, source, CAST(depth AS INTEGER) AS depth, count(*) AS flows, CAST(max(depth_) AS INTEGER) AS max_hops
  FROM (SELECT node % 3 AS sink, start % 2 AS source, depth, depth AS depth_ FROM flows) GROUP BY GROUPING SETS ((sink), (source), (depth), ()) HAVING count(*) > 0"""


def _summed(flows: DataFrame) -> DataFrame:
    flows = flows.select((F.col("node") % 3).alias("sink"), (F.col("start") % 2).alias("source"), "depth", F.col("depth").alias("hops"))
    return flows.groupingSets([["sink"], ["source"], ["depth"], []], "sink", "source", "depth").agg(F.count("*").alias("flows"), F.max("hops").alias("max_hops"))


@register("q46_flow_summary", _flow_sql(*_FORWARD) + _SUMMARY)
def q46(spark, sf_dir):
    return _summed(_flows(spark, sf_dir, *_FORWARD))


#: The reference's depth of a flow query. q44 to q46 stop at 4, as their SQL does.
DEEP = 10


@register("q55_forward_flows_deep", _flow_sql(*_FORWARD, DEEP) + " SELECT * FROM flows")
def q55(spark, sf_dir):
    return _flows(spark, sf_dir, *_FORWARD, DEEP)


@register("q56_backward_flows_deep", _flow_sql(*_BACKWARD, DEEP) + " SELECT * FROM flows")
def q56(spark, sf_dir):
    return _flows(spark, sf_dir, *_BACKWARD, DEEP)


@register("q57_flow_summary_deep", _flow_sql(*_FORWARD, DEEP) + _SUMMARY)
def q57(spark, sf_dir):
    return _summed(_flows(spark, sf_dir, *_FORWARD, DEEP))


@register("q47_lattice_join", """WITH f AS (SELECT user_id, event_id, CAST(event_id % 5 AS INTEGER) AS a, CAST(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 5 AS INTEGER) AS b FROM events)
  SELECT event_id, CASE WHEN a = b THEN a WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE 4 END AS joined, CASE WHEN a = b THEN a WHEN a = 4 THEN b WHEN b = 4 THEN a ELSE 0 END AS met,
  a = b OR a = 0 OR b = 4 AS leq FROM f WHERE b IS NOT NULL""")
def q47(spark, sf_dir):
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    facts = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("a"), (after % 5).cast("int").alias("b")).filter("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return facts.select("event_id", scalars.lattice_join(a, b).alias("joined"), scalars.lattice_meet(a, b).alias("met"), scalars.lattice_leq(a, b).alias("leq"))


@register("q48_reaching_defs", """SELECT * FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_turn FROM conversations)
  WHERE role = 'assistant'""")
def q48(spark, sf_dir):
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(_in_turn().rowsBetween(Window.unboundedPreceding, -1))
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", last.alias("def_turn")).filter("role = 'assistant'")


@register("q49_stale_cached_deleted", """WITH now AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents),
  was AS (SELECT doc_id, substr(sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END), 1, 16) AS h FROM documents WHERE doc_id % 7 <> 0
    UNION ALL SELECT -doc_id, 'gone' FROM documents WHERE doc_id % 13 = 0 AND doc_id > 0)
  SELECT coalesce(n.doc_id, w.doc_id) AS path, CASE WHEN n.h IS NULL THEN 'deleted' WHEN n.h = w.h THEN 'cached' ELSE 'stale' END AS state FROM now n FULL OUTER JOIN was w ON n.doc_id = w.doc_id""")
def q49(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = incremental.snapshot(docs, "doc_id", "text")
    changed = docs.filter("doc_id % 7 <> 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")))
    gone = docs.filter("doc_id % 13 = 0 AND doc_id > 0").select((-F.col("doc_id")).alias("path"), F.lit("gone").alias("content_hash"))
    return incremental.compared(now, incremental.snapshot(changed, "doc_id", "text").unionByName(gone))


@register("q50_progress_window", """SELECT CAST((epoch_us(ts) // 500000) * 500 AS BIGINT) AS window_ms, count(*) AS findings, count(DISTINCT event_type) AS phases, max(event_id) AS last_event FROM events GROUP BY 1""")
def q50(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")  # whatever the session's zone
    start = ((micros - F.pmod(micros, F.lit(500_000))) / 1000).cast("long")
    return table(spark, sf_dir, "events").groupBy(start.alias("window_ms")).agg(F.count("*").alias("findings"), F.countDistinct("event_type").alias("phases"), F.max("event_id").alias("last_event"))


# splits and starts over whole tables


@register("q60_baseline_new_by_date", f"""{_WITH}, f AS (SELECT *, {_BASE} AS fingerprint FROM issues), c AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle FROM events),
  old AS (SELECT event_id FROM events, c WHERE epoch_us(ts) < middle) SELECT ord, fingerprint FROM f WHERE ord NOT IN (SELECT event_id FROM old)
  AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE ord IN (SELECT event_id FROM old))""")
def q60(spark, sf_dir):
    """Every event is on one side: the first half of the time is the baseline, the rest (and what has no time) is tested."""
    events = table(spark, sf_dir, "events").withColumn("__at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"))
    middle = events.agg(F.expr("(min(__at) + max(__at)) div 2").alias("at")).first()["at"]
    old = F.coalesce(F.col("__at") < F.lit(middle), F.lit(False))
    side = lambda which: from_events(events.filter(which)).withColumn("fingerprint", _keys()[2])
    return report.new_against(side(~old), side(old)).select("ord", "fingerprint")


@register("q61_reverse_closure_all", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier
  UNION SELECT r.start, e.caller FROM r JOIN edges e ON r.node = e.callee) SELECT start, node FROM r""")
def q61(spark, sf_dir):
    share_code(spark)
    start = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    return graphs.reachable(call_edges(spark, sf_dir), start, "callee", "caller")
