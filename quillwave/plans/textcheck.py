"""Checks of a repository's notes and build files, as columns and tables of failures.

Files are rows of (doc_id, path, body); `scan` reads them from a folder.  A check gives a row a failure, so a bundle of
checks is a union, and what passed is what has no row.  White space at the ends of what is extracted is ASCII's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that a scan leaves out.
SKIPPED = ("build", ".gradle", ".git", "node_modules", ".kotlin", ".idea")
#: The parts that a closed note has, and what an open one still shows.
REQUIRED = ["## Summary", "## Root Cause", "## Prevention", "## Guardrail Updates", "## Planning Integration", "## Shift-Left Decision", "## Automation Follow-Up", "Trigger:", "Automation Links:"]
PLACEHOLDERS = [("todo", r"(?i)<TODO"), ("tbd", r"\bTBD\b"), ("verb", r"<add\|update\|skip>"), ("reason", "<reason>"), ("slug", "<slug-title>")]
#: The same of plans, the states of a plan, and what makes a plan one about accuracy.
PLAN_REQUIRED = ["## Goal", "## Context & Constraints", "## Approach", "## Steps", "## Definition of Done", "## Risks & Mitigations", "## Test & Verification"]
PLAN_PLACEHOLDERS = [("todo", r"(?i)<TODO"), ("tbd", r"\bTBD\b"), ("iso", "<iso>"), ("phase", "<phase>"), ("score", "<score>"), ("title", "<title>"), ("roadmap", r"(?i)<roadmap item")]
PLAN_STATES = ["draft", "planned", "active", "blocked", "done"]
ACCURACY = r"(?i)\b(FRR|FAR|recogni[sz]|matcher|accuracy|threshold|DTW|MFCC|false accept|false reject)\b"
#: Folders and files that a repository has, where its worktrees are listed, and what a list names.
REQUIRED_DIRS = ["docs/errors/2026-06", "docs/errors/rca/rca-plan-done/2026-06", "docs/plans/2026-06", "docs/plans/done/2026-06", "docs/plans/worktrees", "docs/audits/findings/2026-06", "docs/ai/retro/2026-06", "docs/meta/dreaming"]
REQUIRED_FILES = ["docs/errors/INDEX.md", "docs/audits/INDEX.md", "docs/DOC_TOC.md", "docs/standards/documentation-governance.md"]
WORKTREES, PLAN_CITED = "docs/plans/worktrees/", r"(docs/plans/[A-Za-z0-9_./-]+\.md)"
#: Shapes of paths, versions and coordinates.
CITED = r"([A-Za-z0-9_./-]+\.(?:mjs|md|kt|kts|toml|json|xml|properties|ya?ml))"
PATH_END = r"(\.(md|mjs|json|kts|toml|properties|ya?ml|xml|kt|txt|nvmrc)|/)$"
DYNAMIC = [("range", r"\+"), ("latest.release", r"(?i)latest\.release"), ("latest.integration", r"(?i)latest\.integration"), ("snapshot", "(?i)snapshot")]
COORDINATE = r'"([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+:[A-Za-z0-9_.${}+-]*[0-9][A-Za-z0-9_.${}+-]*)"'
PINNED, UNPINNED = r"gradle-[0-9]+\.[0-9]+(\.[0-9]+)?-(all|bin)\.zip", r"(?i)-(latest|nightly|snapshot|rc|milestone)-"
#: Path patterns of the boundaries that must move together.
CONTRACTS = {
    "service-manifest": [r"AndroidManifest\.xml$", r"(?i)foregroundservice", r"(?i)Service\.kt$"],
    "dependency-catalog": [r"libs\.versions\.toml$", r"build\.gradle\.kts$"],
    "incident-closure": [r"docs/errors/.*\.md$"],
}
#: makers' names by family, in order; what to do there, and the page that a deep link opens.
MAKERS = [("xiaomi", ["xiaomi", "redmi", "poco"]), ("huawei", ["huawei", "honor"]), ("oppo", ["oppo", "realme"]), ("vivo", ["vivo", "iqoo"]), ("samsung", ["samsung"])]
STEPS = {
    "xiaomi": (["Security > Permissions > Autostart", "Battery saver: no restrictions"], "com.miui.securitycenter", "com.miui.permcenter.autostart.AutoStartManagementActivity"),
    "huawei": (["Phone Manager > Startup management", "Manage automatically: off"], "com.huawei.systemmanager", "com.huawei.systemmanager.startupmgr.ui.StartupNormalAppListActivity"),
    "oppo": (["Settings > Battery > App energy saver", "Auto-startup: on"], "com.coloros.safecenter", "com.coloros.safecenter.startupapp.StartupAppListActivity"),
    "vivo": (["i Manager > App manager > Autostart", "High background power use: allowed"], "com.vivo.permissionmanager", "com.vivo.permissionmanager.activity.BgStartUpManagerActivity"),
    "samsung": (["Settings > Battery > Background usage limits", "Sleeping apps: removed, put to sleep: off"], None, None),
    "generic": (["Settings > Apps", "Background activity or autostart: allowed, battery restrictions: off"], None, None),
}
_SPACE = r"[ \t\n\r\f\x0B]"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of all files under a folder, paths relative to it, but for those under skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    path = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/" + base.strip("/") + "/", -1)
    inside = reduce(lambda a, b: a | b, [F.array_contains(F.split("path", "/"), name) for name in SKIPPED])
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("body")).where(~inside)


def existing(files: DataFrame) -> DataFrame:
    """(path) of all files and of the folders that they lie in."""
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(upto).alias("path")).distinct()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def section(body: Column, heading: str) -> Column:
    """What follows the first place of a heading's text, up to the next heading of its level, trimmed; null where it is missing."""
    rest = F.substring(body, F.instr(body, heading) + F.lit(len(heading)), F.lit(2**31 - 1))
    return F.when(F.contains(body, F.lit(heading)), trimmed(F.split_part(rest, F.lit("\n## "), F.lit(1))))


def _unless_none(name: str, test: Column) -> Column:
    return F.when(test, F.lit(name))


def missing_parts(notes: DataFrame, parts: list[str] = REQUIRED) -> DataFrame:
    wanted = F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: ~F.contains(F.col("body"), p))
    return notes.select("doc_id", F.explode(wanted).alias("missing"))


def first_placeholder(body: Column, patterns: list[tuple[str, str]] = PLACEHOLDERS) -> Column:
    """The name of the first pattern that still shows; null of none."""
    return F.coalesce(*[_unless_none(name, body.rlike(pattern)) for name, pattern in patterns])


def decides(body: Column) -> Column:
    return F.coalesce(section(body, "## Shift-Left Decision").rlike(r"(?i)\b(add|update|skip)\b"), F.lit(False))


def citations(notes: DataFrame) -> DataFrame:
    """Files that the guardrail part names, a row each."""
    found = F.regexp_extract_all(F.coalesce(section(F.col("body"), "## Guardrail Updates"), F.lit("")), F.lit(CITED), F.lit(1))
    return notes.select("doc_id", F.explode(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\./", "")))).alias("cited"))


def citation_resolves(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes with at least one citation of a file that exists; `files`: (path)."""
    return citations(notes).join(files.select(F.col("path").alias("cited")), "cited", "left_semi").select("doc_id").distinct()


def _failures(files: DataFrame, tests: list[Column]) -> DataFrame:
    return files.select("doc_id", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def note_failures(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, problem) of incident notes; a placeholder hides what comes after it."""
    body = F.col("body")
    cites = citation_resolves(notes, files).withColumn("cites", F.lit(True))
    rows = notes.join(cites, "doc_id", "left")
    plan = F.coalesce(section(body, "## Planning Integration"), F.lit(""))
    names = plan.rlike(r"docs/plans/|ACTIVE_DEV_RULES|(?i:\bDefinition of Done\b)|\bDoD\b")
    held = first_placeholder(body)
    later = [_unless_none(f"empty {h}", F.coalesce(F.length(section(body, h)), F.lit(0)) < 8) for h in ("## Summary", "## Root Cause", "## Prevention")]
    later += [_unless_none("no real file cited", F.col("cites").isNull()), _unless_none("no plan named", ~names), _unless_none("no decision", ~decides(body))]
    return _failures(rows, [_unless_none(f"missing {p}", ~F.contains(body, F.lit(p))) for p in REQUIRED] + [F.concat(F.lit("placeholder "), held)] + [F.when(held.isNull(), x) for x in later])


def plan_failures(plans: DataFrame) -> DataFrame:
    """(doc_id, problem) of plans; a draft is not held to anything, and a placeholder hides what comes after it."""
    body = F.col("body")
    status = F.lower(F.regexp_extract(body, r"(?i)\*\*Status:\*\*\s*([a-z]+)", 1))
    known, held = status.isin(*PLAN_STATES), first_placeholder(body, PLAN_PLACEHOLDERS)
    done = F.coalesce(section(body, "## Definition of Done"), F.lit(""))
    both = F.contains(F.upper(done), F.lit("FRR")) & F.contains(F.upper(done), F.lit("FAR"))
    accuracy = body.rlike(ACCURACY) & ~both
    judged = [_unless_none(f"missing {p}", ~F.contains(body, F.lit(p))) for p in PLAN_REQUIRED] + [F.concat(F.lit("placeholder "), held)]
    later = [_unless_none(f"empty {h}", F.coalesce(F.length(section(body, h)), F.lit(0)) < 12) for h in ("## Goal", "## Definition of Done", "## Test & Verification")]
    later += [_unless_none("accuracy without both rates", accuracy), _unless_none("bare percentage", accuracy & done.rlike(r"\b9[0-9](\.[0-9]+)?\s*%"))]
    tests = [_unless_none("no status", status == ""), _unless_none("unknown status", (status != "") & ~known)]
    return _failures(plans, tests + [F.when(known & (status != "draft"), x) for x in judged] + [F.when(known & (status != "draft") & held.isNull(), x) for x in later])


def unfenced(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)```.*?```", "")


def unsafe_links(body: Column) -> Column:
    """Number of link targets outside code that are neither on the web, nor an address, nor a place in the page."""
    targets = F.regexp_extract_all(F.regexp_replace(unfenced(body), r"`[^`\n]+`", ""), F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.size(F.filter(targets, lambda t: ~trimmed(t).rlike("^(https?:|mailto:|#)"))).cast("long")


def code_paths(notes: DataFrame) -> DataFrame:
    """(doc_id, cited): what looks like a path of the repository in back quotes outside fenced code, without a last slash."""

    def is_path(t: Column) -> Column:
        shown = F.contains(t, F.lit("/")) & ~t.rlike(r"[\s<>*{}$:]|YYYY|MM-DD") & ~t.rlike(r"^(/|~|\./|http)")
        return shown & t.rlike(PATH_END)

    quoted = F.transform(F.regexp_extract_all(unfenced(F.col("body")), F.lit(r"`([^`\n]+)`"), F.lit(1)), trimmed)
    return notes.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(quoted, is_path), lambda t: F.regexp_replace(t, "/$", "")))).alias("cited"))


def broken_paths(notes: DataFrame, files: DataFrame) -> DataFrame:
    return code_paths(notes).join(existing(files).select(F.col("path").alias("cited")), "cited", "left_anti").select("doc_id", "cited")


def missing_structure(files: DataFrame, folders: list[str] = REQUIRED_DIRS, names: list[str] = REQUIRED_FILES) -> DataFrame:
    """(kind, path) of the required folders and files that are not there; `files`: (path)."""
    required = files.sparkSession.createDataFrame([("folder", x) for x in folders] + [("file", x) for x in names], "kind string, path string")
    return required.join(existing(files), "path", "left_anti").select("kind", "path")


def broken_plan_references(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, cited): plans that an entry of the list of worktrees names and that don't exist; once each."""
    listed = entries.where(F.startswith("path", F.lit(WORKTREES)) & F.endswith("path", F.lit(".md")))
    cited = listed.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(PLAN_CITED), F.lit(1)))).alias("cited"))
    return cited.join(files.select(F.col("path").alias("cited")), "cited", "left_anti").select("doc_id", "cited")


def _field(pattern: str, other: Column) -> Column:
    found = F.regexp_extract("body", pattern, 1)
    return F.when(found == "", other).otherwise(trimmed(found))


def index_rows(notes: DataFrame) -> DataFrame:
    """(doc_id, date, area, status, title) of incident notes, newest first; a question mark for what a note does not say."""
    unknown = F.lit("?")
    rows = notes.select(
        "doc_id", "path", _field(r"\*\*Date:\*\*\s*([0-9-]+)", unknown).alias("date"), _field(r"\*\*Area:\*\*\s*(.+)", unknown).alias("area"),
        _field(r"\*\*Status:\*\*\s*(.+)", unknown).alias("status"), _field(r"(?m)^#\s*Incident:\s*(.+)$", F.col("path")).alias("title"),
    )
    return rows.orderBy(F.desc("date"), "path").select("doc_id", "date", "area", "status", "title")


def audit_rows(findings: DataFrame) -> DataFrame:
    """(doc_id, date, severity, disposition, title) of audit findings, newest first; a question mark for what one does not say."""
    named = {"date": r"\*\*Date:\*\*\s*([0-9-]+)", "severity": r"\*\*Severity:\*\*\s*(.+)", "disposition": r"\*\*Disposition:\*\*\s*(.+)", "title": r"(?m)^#\s*Audit Finding:\s*(.+)$"}
    rows = findings.select("doc_id", "path", *[_field(pattern, F.lit("?")).alias(name) for name, pattern in named.items()])
    return rows.orderBy(F.desc("date"), "path").select("doc_id", *named)


def _lines(files: DataFrame, body: Column) -> DataFrame:
    return files.select("doc_id", F.posexplode(F.split(body, "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def dynamic_versions(catalogs: DataFrame) -> DataFrame:
    """(doc_id, line_no, place, why): versions that are left open, in entries of the table of versions or inline; comments don't count."""
    lines = _lines(catalogs, F.col("body")).withColumn("line", F.split_part("line", F.lit("#"), F.lit(1)))
    header = F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1)
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("header", F.when(header != "", trimmed(header))).withColumn("part", F.last("header", ignorenulls=True).over(upto)).where("header IS NULL")
    inline = F.struct(F.lit("inline").alias("place"), F.regexp_extract("line", r'\bversion\s*=\s*"([^"]*)"', 1).alias("value"))
    entry = F.struct(F.lit("entry").alias("place"), F.when(F.col("part") == "versions", F.regexp_extract("line", r'^\s*[A-Za-z0-9_.-]+\s*=\s*"([^"]*)"', 1)).otherwise("").alias("value"))
    values = placed.select("doc_id", "line_no", F.explode(F.array(inline, entry)).alias("v"))
    return values.select("doc_id", "line_no", "v.place", first_placeholder(F.col("v.value"), DYNAMIC).alias("why")).where("why IS NOT NULL")


def fixed_coordinates(builds: DataFrame) -> DataFrame:
    """(doc_id, line_no, coordinate): quoted group, artifact and version outside comments."""
    code = F.regexp_replace(F.regexp_replace("body", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1")
    found = _lines(builds, code).withColumn("coordinate", F.explode(F.regexp_extract_all("line", F.lit(COORDINATE), F.lit(1))))
    return found.select("doc_id", "line_no", "coordinate")


def wrapper_failures(properties: DataFrame) -> DataFrame:
    """(doc_id, problem) of wrapper properties; the last line of a key counts."""

    def value(key: str) -> Column:
        own = F.filter(F.split("body", "\n"), lambda x: x.rlike(rf"^\s*{key}\s*="))
        return F.when(F.size(own) > 0, trimmed(F.regexp_extract(F.element_at(own, -1), r"^[^=]*=(.*)$", 1))).otherwise("")

    url = F.replace(value("distributionUrl"), F.lit("\\:"), F.lit(":"))
    return _failures(properties, [_unless_none("no url", url == ""), _unless_none("not pinned", (url != "") & (~url.rlike(PINNED) | url.rlike(UNPINNED))), _unless_none("validation off", F.lower(value("validateDistributionUrl")) == "false")])


def manifest_failures(manifests: DataFrame) -> DataFrame:
    """(doc_id, problem) of manifests that have a service and record sound."""
    body = F.col("body")
    recording = manifests.where(F.contains(body, F.lit("RECORD_AUDIO")) & body.rlike(r"<service\b"))
    typed = body.rlike(r'android:foregroundServiceType\s*=\s*"[^"]*microphone[^"]*"')
    return _failures(recording, [_unless_none("no microphone type", ~typed), _unless_none("no permission", ~F.contains(body, F.lit("FOREGROUND_SERVICE_MICROPHONE")))])


def classified(paths: DataFrame) -> DataFrame:
    """(path, contracts): the contracts that any pattern ties a path to; paths of none are left out."""
    hits = F.array(*[_unless_none(name, reduce(lambda a, b: a | b, [F.col("path").rlike(p) for p in patterns])) for name, patterns in CONTRACTS.items()])
    return paths.select("path", F.array_join(F.array_compact(hits), ",").alias("contracts")).where("contracts <> ''")


def maker_family(name: Column) -> Column:
    low = F.lower(name)
    families = [_unless_none(family, reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])) for family, parts in MAKERS]
    return F.coalesce(*families, F.lit("generic"))


def guidance(spark: SparkSession) -> DataFrame:
    """(family, step_no, step, package, page): the steps of each family."""
    rows = [(family, i + 1, step, package, page) for family, (steps, package, page) in STEPS.items() for i, step in enumerate(steps)]
    return spark.createDataFrame(rows, "family string, step_no int, step string, package string, page string")


def bundle(failures: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(check, failures, passed): every check of a bundle, with the number of its failures."""
    parts = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in failures.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failures") == 0)


# Derived files: what documents would be as notes, plans and build files ---------------------------------------------

_NOTE = (
    "'# Incident: number ' || doc_id || '\n**Date:** 2026-0' || (1 + doc_id % 9) || '-1' || doc_id % 7 || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '\n**Area:** ' || source END || '\n**Status:** closed \n## Summary \n' || coalesce(text, '') || '\n## Root Cause\nsee `docs/' || source || '/' || (doc_id - doc_id % 7) || '.md`, `docs/' || source || '/`, `~/x.md` and '"
    " || CASE doc_id % 4 WHEN 0 THEN '[it](../up.md)' WHEN 1 THEN '[it]( https://example.org )' WHEN 2 THEN '[it](/root.md), `[x](../y.md)`' ELSE '[a](#b) ```[x](../z.md)```' END || '\n## Prevention\n' || CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE 'a test of it' END"
    " || '\n## Guardrail Updates\nTrigger: ' || CASE WHEN doc_id % 5 = 0 THEN 'TBD' WHEN doc_id % 5 = 1 THEN '<reason>' ELSE 'done' END || ' ./docs/' || source || '/' || (doc_id - doc_id % 3) || '.md'"
    " || CASE WHEN doc_id % 8 = 0 THEN '' ELSE '\n## Planning Integration\n' || CASE doc_id % 3 WHEN 0 THEN 'docs/plans/x' WHEN 1 THEN 'definition of done' ELSE 'later' END END"
    " || CASE WHEN doc_id % 2 = 0 THEN '\n## Shift-Left Decision: \nWe ' || CASE WHEN doc_id % 4 = 0 THEN 'update' ELSE 'keep' END || ' it\n## Automation Follow-Up\nnone' ELSE '' END || '\n'"
)
_PATH = "CASE doc_id % 6 WHEN 0 THEN 'app/AndroidManifest.xml' WHEN 1 THEN 'app/src/ListeningService.kt' WHEN 2 THEN 'gradle/libs.versions.toml' WHEN 3 THEN 'core/build.gradle.kts' WHEN 4 THEN 'docs/errors/' || doc_id || '.md' ELSE 'docs/' || source || '/' || doc_id || '.md' END"
_MAKER = "CASE doc_id % 8 WHEN 0 THEN 'Xiaomi' WHEN 1 THEN 'POCO F3' WHEN 2 THEN 'HONOR' WHEN 3 THEN 'Realme' WHEN 4 THEN 'iQOO' WHEN 5 THEN 'Samsung' WHEN 6 THEN 'vivo' ELSE 'Nokia' END || ' ' || source"
_PLAN = (
    "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '**Status:** Draft\n' WHEN 2 THEN '**Status:** gone\n' ELSE '**Status:** active\n' END || '## Goal\n' || CASE WHEN doc_id % 5 = 0 THEN 'short' ELSE coalesce(text, '') END || '\n## Context & Constraints\n## Approach\n## Steps\n## Definition of Done\n' || "
    "CASE doc_id % 4 WHEN 0 THEN 'accuracy of 97.5 %' WHEN 1 THEN 'frr and far per hour' WHEN 2 THEN 'the matcher works well' ELSE 'it builds and runs' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '\n## Risks & Mitigations\n<phase' || CASE WHEN doc_id % 6 = 1 THEN '>' ELSE '' END || '\n## Test & Verification\nby the whole suite' END"
)
_CATALOG = (
    "'# no + and no latest.release here\n[versions]\na = \"1.' || doc_id % 10 || CASE doc_id % 5 WHEN 0 THEN '.+' WHEN 1 THEN '-SNAPSHOT' ELSE '' END || '\" # latest.release\nversion = \"' || CASE WHEN doc_id % 3 = 0 THEN 'Latest.Integration' ELSE '2' END || '\"\n [ libraries ] \nb = { module = \"x:y\", version = \"' || CASE WHEN doc_id % 4 = 0 THEN 'latest.release' ELSE '3' END || '\" }\nc = \"+\"'"
)
_BUILD = (
    "'plugins { id = \"a.b\" }\n// implementation(\"old:one:1\")\n/* \"in:a:2\"\n*/ val u = \"https://x.y\" // \"z:z:9\"\nimplementation(\"g.' || source || ':art-' || doc_id || ':' || CASE WHEN doc_id % 2 = 0 THEN '1.' || doc_id % 9 ELSE 'latest' END || '\"); api(\"k:l:{v}2\")'"
)
_PROPERTIES = (
    "CASE WHEN doc_id % 6 = 0 THEN 'x=1' ELSE 'distributionUrl=old\n distributionUrl = https\\\\://services.example.org/distributions/gradle-8.' || doc_id % 12 || CASE doc_id % 4 WHEN 0 THEN '-bin.zip' WHEN 1 THEN '.1-all.zip' WHEN 2 THEN '-rc-1-bin.zip' ELSE '.zip' END || ' ' END || '\nvalidateDistributionUrl=' || CASE WHEN doc_id % 5 = 0 THEN 'False' ELSE 'true' END"
)
_MANIFEST = (
    "'<manifest>' || CASE WHEN doc_id % 2 = 0 THEN '<uses-permission android:name=\"RECORD_AUDIO\"/>' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '<uses-permission android:name=\"FOREGROUND_SERVICE_MICROPHONE\"/>' ELSE '' END || '<service' || CASE WHEN doc_id % 5 = 0 THEN 's' ELSE '' END || ' android:foregroundServiceType = \"' || CASE WHEN doc_id % 4 = 0 THEN 'location|microphone' ELSE 'location' END || '\"/></manifest>'"
)


def _files(body: str):
    spark_body = body.replace("\n", "\\n")
    return lambda s, d: s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "'docs/' || source || '/' || doc_id || '.md' AS path", f"{spark_body} AS body")


_FINDING = (
    "CASE WHEN doc_id % 6 = 0 THEN '' ELSE '# Audit Finding: number ' || doc_id || ' \n' END || '**Date:** 2026-0' || (1 + doc_id % 9) || '-1' || doc_id % 7 || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '\n**Severity:** of ' || source END || '\n**Disposition:** ' || CASE WHEN doc_id % 3 = 0 THEN 'fix' ELSE 'accept' END || '\n' || coalesce(text, '')"
)
_ENTRY = "'tracks `docs/plans/' || source || '/' || (doc_id - doc_id % 3) || '.md`, docs/plans/2026-06/p' || doc_id % 7 || '.md. and (docs/plans/2026-06/p' || doc_id % 7 || '.md)'"
#: Where documents would lie in a repository.
_TREE = (
    "CASE doc_id % 6 WHEN 0 THEN 'docs/errors/2026-06/' || doc_id || '.md' WHEN 1 THEN 'docs/plans/worktrees/' || doc_id || '.md' WHEN 2 THEN 'docs/errors/INDEX.md' WHEN 3 THEN 'docs/plans/' || source || '/' || doc_id || '.md' "
    "WHEN 4 THEN 'docs/plans/2026-06/p' || doc_id % 5 || '.md' ELSE 'docs/ai/retro/2026-06/' || doc_id || '.txt' END"
)

notes, plans, catalogs, builds, properties, manifests, findings = map(_files, (_NOTE, _PLAN, _CATALOG, _BUILD, _PROPERTIES, _MANIFEST, _FINDING))


def tree(s, d):
    return s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{_TREE} AS path", f"{_ENTRY} AS body")


_TREE_FILES = f"tree AS (SELECT doc_id, {_TREE} AS path, {_ENTRY} AS body FROM documents)"


def _with(name: str, body: str) -> str:
    return f"WITH {name} AS (SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS path, {body} AS body FROM documents)"


# The same in SQL, by string functions where Spark has patterns, and the other way about ------------------------------


def _cut(heading: str) -> str:
    return rf"CASE WHEN strpos(body, '{heading}') > 0 THEN trim(string_split(body[strpos(body, '{heading}') + {len(heading)}:], chr(10) || '## ')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END"


_NOTES = _with("notes", _NOTE)
_PLACE = "CASE WHEN contains(lower(body), '<todo') THEN 'todo' WHEN regexp_matches(body, '(^|[^A-Za-z0-9_])TBD($|[^A-Za-z0-9_])') THEN 'tbd' WHEN contains(body, '<add|update|skip>') THEN 'verb' WHEN contains(body, '<reason>') THEN 'reason' WHEN contains(body, '<slug-title>') THEN 'slug' END"
_UNSAFE = r"""CAST(len(list_filter(regexp_extract_all(regexp_replace(regexp_replace(body, '(?s)```.*?```', '', 'g'), '`[^`\n]+`', '', 'g'), '\[[^\]]*\]\(([^)]+)\)', 1), lambda t: NOT (starts_with(trim(t), 'http:') OR starts_with(trim(t), 'https:') OR starts_with(trim(t), 'mailto:') OR starts_with(trim(t), '#')))) AS BIGINT)"""
_VERB = rf"coalesce(len(list_intersect(regexp_split_to_array(lower({_cut('## Shift-Left Decision')}), '[^a-z0-9_]+'), ['add', 'update', 'skip'])) > 0, false)"
_CITES = rf"cites AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce({_cut('## Guardrail Updates')}, ''), '{CITED}', 1)) AS c FROM notes) WHERE CASE WHEN starts_with(c, './') THEN c[3:] ELSE c END IN (SELECT path FROM notes))"


def _explained(tests: list[tuple[str, str]], table: str) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN {name} END" for name, test in tests)
    return f"SELECT doc_id, problem FROM (SELECT doc_id, unnest([{cases}]) AS problem FROM {table}) WHERE problem IS NOT NULL"


def _short(heading: str, least: int) -> str:
    return f"coalesce(length({_cut(heading)}), 0) < {least}"


_NOTE_TESTS = (
    [(f"'missing {p}'", f"NOT contains(body, '{p}')") for p in REQUIRED]
    + [("'placeholder ' || held", "held IS NOT NULL")]
    + [(f"'empty {h}'", f"held IS NULL AND {_short(h, 8)}") for h in ("## Summary", "## Root Cause", "## Prevention")]
    + [("'no real file cited'", "held IS NULL AND doc_id NOT IN (SELECT doc_id FROM cites)")]
    + [("'no plan named'", rf"held IS NULL AND NOT regexp_matches(coalesce({_cut('## Planning Integration')}, ''), 'docs/plans/|ACTIVE_DEV_RULES|(?i:\bDefinition of Done\b)|\bDoD\b')")]
    + [("'no decision'", f"held IS NULL AND NOT {_VERB}")]
)
_DONE = f"coalesce({_cut('## Definition of Done')}, '')"
_RATES = f"(contains(lower({_DONE}), 'frr') AND contains(lower({_DONE}), 'far'))"
_PLAN_PLACE = "CASE WHEN contains(lower(body), '<todo') THEN 'todo' WHEN regexp_matches(body, '\\bTBD\\b') THEN 'tbd' WHEN contains(body, '<iso>') THEN 'iso' WHEN contains(body, '<phase>') THEN 'phase' WHEN contains(body, '<score>') THEN 'score' WHEN contains(body, '<title>') THEN 'title' WHEN contains(lower(body), '<roadmap item') THEN 'roadmap' END"
_STATUS = r"lower(regexp_extract(body, '(?i)\*\*Status:\*\*\s*([a-z]+)', 1))"
_HELD = "status IN ('planned', 'active', 'blocked', 'done')"
_PLAN_TESTS = (
    [("'no status'", "status = ''"), ("'unknown status'", f"status NOT IN ('', 'draft') AND NOT {_HELD}")]
    + [(f"'missing {p}'", f"{_HELD} AND NOT contains(body, '{p}')") for p in PLAN_REQUIRED]
    + [("'placeholder ' || held", f"{_HELD} AND held IS NOT NULL")]
    + [(f"'empty {h}'", f"{_HELD} AND held IS NULL AND {_short(h, 12)}") for h in ("## Goal", "## Definition of Done", "## Test & Verification")]
    + [("'accuracy without both rates'", f"{_HELD} AND held IS NULL AND regexp_matches(body, '{ACCURACY}') AND NOT {_RATES}")]
    + [("'bare percentage'", rf"{_HELD} AND held IS NULL AND regexp_matches(body, '{ACCURACY}') AND NOT {_RATES} AND regexp_matches({_DONE}, '\b9\d(\.\d+)?\s*%')")]
)
_FAMILY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(maker), '{x}')" for x in parts) + f" THEN '{family}'" for family, parts in MAKERS) + " ELSE 'generic' END"
_HITS = " || ".join("CASE WHEN " + " OR ".join(f"regexp_matches(path, '{p}')" for p in patterns) + f" THEN '{name},' ELSE '' END" for name, patterns in CONTRACTS.items())
_STEP_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in (family, i + 1, step, package, page)) + ")" for family, (steps, package, page) in STEPS.items() for i, step in enumerate(steps))
_WHY = "CASE WHEN contains(value, '+') THEN 'range' WHEN contains(lower(value), 'latest.release') THEN 'latest.release' WHEN contains(lower(value), 'latest.integration') THEN 'latest.integration' WHEN contains(lower(value), 'snapshot') THEN 'snapshot' END"
_VERSIONS_SQL = rf"""{_with("files", _CATALOG)}, lines AS (SELECT doc_id, i AS line_no, string_split(string_split(body, chr(10))[i], '#')[1] AS line FROM files, range(1, 9) r(i) WHERE i <= len(string_split(body, chr(10)))),
marked AS (SELECT *, regexp_matches(line, '^\s*\[[^\]]+\]\s*$') AS is_header, trim(line, ' []' || chr(9)) AS name FROM lines),
placed AS (SELECT *, (SELECT max_by(h.name, h.line_no) FROM marked h WHERE h.doc_id = m.doc_id AND h.is_header AND h.line_no <= m.line_no) AS part FROM marked m WHERE NOT is_header),
found AS (SELECT doc_id, line_no, 'inline' AS place, regexp_extract(line, '\bversion\s*=\s*"([^"]*)"', 1) AS value FROM placed UNION ALL SELECT doc_id, line_no, 'entry', regexp_extract(line, '^\s*[A-Za-z0-9_.-]+\s*=\s*"([^"]*)"', 1) FROM placed WHERE part = 'versions')
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, place, {_WHY} AS why FROM found WHERE {_WHY} IS NOT NULL"""
_URL = r"(SELECT max_by(trim(x[strpos(x, '=') + 1:]), i) FROM (SELECT unnest(string_split(body, chr(10))) AS x, unnest(range(1, 20)) AS i) WHERE starts_with(trim(x), 'distributionUrl') AND contains(x, '='))"
_PROPERTY_TESTS = [
    ("'no url'", "url IS NULL"),
    ("'not pinned'", rf"url IS NOT NULL AND (NOT regexp_matches(url, 'gradle-\d+\.\d+(?:\.\d+)?-(?:all|bin)\.zip') OR regexp_matches(lower(url), '-(latest|nightly|snapshot|rc|milestone)-'))"),
    ("'validation off'", "contains(lower(body), 'validatedistributionurl=false')"),
]
_MANIFEST_TESTS = [
    ("'no microphone type'", r"""NOT regexp_matches(body, 'android:foregroundServiceType\s*=\s*"[^"]*microphone')"""),
    ("'no permission'", "NOT contains(body, 'FOREGROUND_SERVICE_MICROPHONE')"),
]
Check = tuple


def _read(source, then):
    return lambda s, d: then(source(s, d))


#: The checks of a bundle, each a query below that gives a row a failure.
BUNDLE = ("note_failures", "code_paths", "plan_failures", "dynamic_versions", "fixed_coordinates", "wrapper_failures", "manifest_failures", "unsafe_notes", "missing_structure", "worktree_references")


def check_summary(s, d):
    """How often each of a bundle's checks fails, and which pass."""
    return bundle({name: CHECKS[name][0](s, d) for name in BUNDLE}, s)


CHECKS: dict[str, Check] = {
    "section_extract": (
        _read(notes, lambda n: n.select("doc_id", F.md5(section(F.col("body"), "## Summary")).alias("summary_md5"), section(F.col("body"), "## Shift-Left Decision").alias("decision"))),
        f"{_NOTES} SELECT doc_id, md5({_cut('## Summary')}) AS summary_md5, {_cut('## Shift-Left Decision')} AS decision FROM notes",
    ),
    "required_labels": (_read(notes, missing_parts), f"{_NOTES} SELECT doc_id, p AS missing FROM notes, (SELECT unnest({REQUIRED!r}) AS p) WHERE strpos(body, p) = 0"),
    "placeholder_scan": (_read(notes, lambda n: n.select("doc_id", first_placeholder(F.col("body")).alias("placeholder"))), f"{_NOTES} SELECT doc_id, {_PLACE} AS placeholder FROM notes"),
    "citation_resolve": (_read(notes, lambda n: citation_resolves(n, n)), f"{_NOTES}, {_CITES} SELECT doc_id FROM cites"),
    "note_failures": (_read(notes, lambda n: note_failures(n, n)), f"{_NOTES}, {_CITES}, judged AS (SELECT *, {_PLACE} AS held FROM notes) {_explained(_NOTE_TESTS, 'judged')}"),
    "link_safety": (_read(notes, lambda n: n.select("doc_id", unsafe_links(F.col("body")).alias("unsafe"))), f"{_NOTES} SELECT doc_id, {_UNSAFE} AS unsafe FROM notes"),
    "code_paths": (
        _read(notes, lambda n: broken_paths(n, n)),
        rf"{_NOTES}, quoted AS (SELECT doc_id, trim(unnest(regexp_extract_all(regexp_replace(body, '(?s)```.*?```', '', 'g'), '`([^`\n]+)`', 1))) AS t FROM notes) SELECT DISTINCT doc_id, rtrim(t, '/') AS cited FROM quoted WHERE contains(t, '/') AND NOT regexp_matches(t, '[\s<>*{{}}$:]|YYYY|MM-DD|^[/~]|^\./|^http') AND regexp_matches(t, '{PATH_END}') AND rtrim(t, '/') NOT IN (SELECT path FROM notes) AND NOT EXISTS (SELECT 1 FROM notes n WHERE starts_with(n.path, rtrim(t, '/') || '/'))",
    ),
    "decision_verb": (_read(notes, lambda n: n.select("doc_id", decides(F.col("body")).alias("decided"))), f"{_NOTES} SELECT doc_id, {_VERB} AS decided FROM notes"),
    "note_index": (
        _read(notes, index_rows),
        f"{_NOTES} SELECT doc_id, '2026-0' || (1 + doc_id % 9) || '-1' || doc_id % 7 AS date, CASE WHEN doc_id % 4 = 0 THEN '?' ELSE source END AS area, 'closed' AS status, 'number ' || doc_id AS title FROM notes JOIN documents USING (doc_id)",
    ),
    "audit_index": (
        _read(findings, audit_rows),
        f"SELECT doc_id, '2026-0' || (1 + doc_id % 9) || '-1' || doc_id % 7 AS date, CASE WHEN doc_id % 4 = 0 THEN '?' ELSE 'of ' || source END AS severity, CASE WHEN doc_id % 3 = 0 THEN 'fix' ELSE 'accept' END AS disposition, CASE WHEN doc_id % 6 = 0 THEN '?' ELSE 'number ' || doc_id END AS title FROM documents",
    ),
    "missing_structure": (
        _read(tree, missing_structure),
        f"WITH {_TREE_FILES}, required(kind, path) AS (VALUES " + ", ".join(f"('{kind}', '{x}')" for kind, names in (("folder", REQUIRED_DIRS), ("file", REQUIRED_FILES)) for x in names) + ") SELECT kind, path FROM required r WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.path = r.path OR starts_with(tree.path, r.path || '/'))",
    ),
    "worktree_references": (
        _read(tree, lambda f: broken_plan_references(f, f)),
        f"WITH {_TREE_FILES}, cited AS (SELECT DISTINCT doc_id, unnest(['docs/plans/' || source || '/' || (doc_id - doc_id % 3) || '.md', 'docs/plans/2026-06/p' || doc_id % 7 || '.md']) AS cited FROM documents WHERE doc_id % 6 = 1) SELECT * FROM cited WHERE cited NOT IN (SELECT path FROM tree)",
    ),
    "plan_failures": (_read(plans, plan_failures), f"{_with('plans', _PLAN)}, judged AS (SELECT *, {_STATUS} AS status, {_PLAN_PLACE} AS held FROM plans) {_explained(_PLAN_TESTS, 'judged')}"),
    "dynamic_versions": (_read(catalogs, dynamic_versions), _VERSIONS_SQL),
    "fixed_coordinates": (
        _read(builds, fixed_coordinates),
        f"{_with('files', _BUILD)} SELECT doc_id, 4 AS line_no, 'k:l:{{v}}2' AS coordinate FROM files UNION ALL SELECT doc_id, 4, 'g.' || source || ':art-' || doc_id || ':1.' || doc_id % 9 FROM documents WHERE doc_id % 2 = 0",
    ),
    "wrapper_failures": (_read(properties, wrapper_failures), f"{_with('files', _PROPERTIES)}, judged AS (SELECT doc_id, body, replace({_URL}, chr(92) || ':', ':') AS url FROM files) {_explained(_PROPERTY_TESTS, 'judged')}"),
    "manifest_failures": (_read(manifests, manifest_failures), f"{_with('files', _MANIFEST)}, judged AS (SELECT * FROM files WHERE contains(body, 'RECORD_AUDIO') AND contains(body, '<service ')) {_explained(_MANIFEST_TESTS, 'judged')}"),
    "path_classifier": (lambda s, d: classified(s.read.parquet(f"{d}/documents.parquet").selectExpr(f"{_PATH} AS path")), f"SELECT path, rtrim(hits, ',') AS contracts FROM (SELECT path, {_HITS} AS hits FROM (SELECT {_PATH} AS path FROM documents)) WHERE hits <> ''"),
    "oem_guidance": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{_MAKER} AS maker").withColumn("family", maker_family(F.col("maker"))).join(guidance(s), "family").select("doc_id", "family", "step_no", "step", "package", "page"),
        f"SELECT doc_id, family, CAST(step_no AS INTEGER) AS step_no, step, package, page FROM (SELECT doc_id, {_FAMILY} AS fam FROM (SELECT doc_id, {_MAKER} AS maker FROM documents)) JOIN (VALUES {_STEP_ROWS}) g(family, step_no, step, package, page) ON family = fam",
    ),
    "unsafe_notes": (_read(notes, lambda n: n.where(unsafe_links(F.col("body")) > 0).select("doc_id")), f"{_NOTES} SELECT doc_id FROM notes WHERE {_UNSAFE} > 0"),
}
CHECKS["check_summary"] = check_summary, " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS failures, count(*) = 0 AS passed FROM ({CHECKS[name][1]})" for name in BUNDLE)
