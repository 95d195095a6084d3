"""The code-fact questions over a code base that the driver's tables spell out: ``QUERIES`` and ``ORACLES``.

Suppliers are files, parts are functions and methods (brands are classes, with bases within a file and into the next
one), line items are call sites and imports, events are remote calls, their handlers, and events sent and heard. The
facts are plain SQL that both engines read; the answers come from the navigator on one side and from SQL on the other.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.config import AnalysisConfig
from navgraph.impact import Impact
from navgraph.navigation import Navigator
from navgraph.resources import Resources
from navgraph.sources.store import FrameStore

TABLES = ("supplier", "nation", "part", "lineitem", "events")
SIZES = "SELECT (SELECT count(*) FROM {supplier}) AS ns, (SELECT count(*) FROM {part}) AS np"
#: Facts, as common table expressions; ``{part}`` and the like stand for the tables.
BASE = f"""
    sizes AS ({SIZES}),""" + """
    files AS (
      SELECT s_suppkey AS s, 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey || '.py' AS file,
             'r' || n_regionkey || '.n' || s_nationkey || '.s' || s_suppkey AS module, s_suppkey % 10 <> 9 AS parse_ok, s_suppkey * 7 AS length
      FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey),
    parts AS (
      SELECT p_partkey AS k, p_partkey % ns AS s, CAST(floor(p_partkey / ns) AS BIGINT) AS slot,
             CASE WHEN p_size <= 5 THEN 'only_' || p_partkey ELSE replace(p_name, ' ', '_') END AS name,
             CASE WHEN p_partkey % 3 > 0 THEN CAST(substring(p_brand, 7) AS BIGINT) END AS b
      FROM {part} CROSS JOIN sizes),
    funcs AS (
      SELECT k, files.s, file, module, name, 10 + 10 * slot AS line, 18 + 10 * slot AS end_line, 'B' || b || '_s' || files.s AS cls, b
      FROM parts JOIN files ON files.s = parts.s),
    handled AS (
      SELECT event_id, file, event_id + 1000000 AS line, 'call_' || (event_id % 20) AS method, event_type FROM {events} CROSS JOIN sizes JOIN files ON s = user_id % ns
      WHERE event_type IN ('signup', 'purchase') AND event_id % 20 < 6),
    defs AS (
      SELECT file, line, end_line, cls, name FROM funcs
      UNION ALL SELECT file, line, line, CAST(NULL AS VARCHAR(9)), method FROM handled),
    classes AS (
      SELECT file, cls AS name, s, b, min(line) - 2 AS line, max(end_line) AS end_line, min(line) AS first_method,
             CASE WHEN b >= 5 THEN 'B' || CAST(floor(b / 5) AS BIGINT) || '_s' || s WHEN s % 2 = 0 THEN 'B' || b || '_s' || (s + 1) END AS base
      FROM funcs WHERE cls IS NOT NULL GROUP BY file, cls, s, b),
    imports AS (
      SELECT a.file, b.module, 'm0' AS alias, 1 AS line FROM files a CROSS JOIN sizes JOIN files b ON b.s = (a.s * 3 + 1) % ns
      UNION ALL SELECT a.file, b.module, 'm1', 2 FROM files a CROSS JOIN sizes JOIN files b ON b.s = (a.s + 5) % ns
      UNION ALL SELECT a.file, CASE WHEN l_linenumber = 7 THEN 'ext_' || (l_partkey % 60) ELSE b.module END, 'i' || l_partkey, l_orderkey + 3
        FROM {lineitem} CROSS JOIN sizes JOIN files a ON a.s = l_suppkey JOIN files b ON b.s = l_partkey % ns),
    calls AS (
      SELECT u.k, u.s, u.file, u.cls, u.name AS func, u.line AS func_line, u.line + l_linenumber AS line, l_orderkey * 10 + l_linenumber AS ord,
             (l_orderkey + l_linenumber) % 4 AS kind, l_linenumber AS ln, l_quantity AS quantity,
             CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN (u.k * 7 + l_linenumber) % np WHEN 1 THEN (u.k + ns * l_linenumber) % np
                  WHEN 2 THEN (u.k + 1 + ns * l_linenumber) % np
                  ELSE (CASE WHEN l_linenumber % 2 = 0 THEN (u.s * 3 + 1) % ns ELSE (u.s + 5) % ns END + ns * l_linenumber) % np END AS q
      FROM {lineitem} JOIN funcs u ON u.k = l_partkey CROSS JOIN sizes),
    sites AS (
      SELECT calls.*, parts.name AS callee, CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'self' ELSE 'name' END AS recv_kind,
             CASE kind WHEN 1 THEN 'self' WHEN 2 THEN 'x' WHEN 3 THEN 'm' || (ln % 2) END AS recv,
             coalesce(cls || '.', '') || func AS scope
      FROM calls JOIN parts ON parts.k = calls.q),
    assigns AS (
      SELECT a.file, a.line, a.cls, coalesce(a.cls || '.', '') || a.name AS scope, b.cls AS type
      FROM funcs a CROSS JOIN sizes JOIN funcs b ON b.k = (a.k + 1) % np WHERE b.cls IS NOT NULL),
    facts AS (SELECT file, line, 'x' AS expr, 'B' || (1 + ord % 25) || '_s' || s AS type FROM sites WHERE kind = 2 AND quantity <= 2),
    names AS (
      SELECT name, file, line, 4 AS col FROM defs UNION ALL SELECT callee, file, line, 8 + ord % 60 FROM sites),
    remote AS (
      SELECT file, event_id AS line, CASE event_id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE 'side' END AS chan, 'call_' || (event_id % 20) AS method,
             CASE WHEN event_id % 7 = 0 THEN 'Stub' || (event_id % 5) END AS stub
      FROM {events} CROSS JOIN sizes JOIN files ON s = user_id % ns WHERE event_type = 'click'),
    handlers AS (
      SELECT file, line, CASE event_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE 'void' END AS chan, method, 'Ep' || (event_id % 3) AS endpoint,
             CASE WHEN event_id % 5 = 0 THEN 'verified' ELSE 'likely' END AS confidence
      FROM handled WHERE event_type = 'signup'),
    heard AS (
      SELECT file, event_id AS line, CASE WHEN event_type = 'error' THEN 'listen' ELSE 'publish' END AS side,
             CASE event_id % 3 WHEN 0 THEN 'ui.' WHEN 1 THEN 'net.' ELSE '' END || 'k' || (event_id % 40) AS event,
             CASE WHEN event_id % 50 = 0 THEN 'on_' || (event_id % 40) END AS func
      FROM {events} CROSS JOIN sizes JOIN files ON s = user_id % ns WHERE event_type IN ('error', 'view')),
    binds AS (SELECT file, line, name AS cls, 'ui' || (s % 5) AS key FROM classes WHERE b % 2 = 1),
    nodes AS (
      SELECT 'ui' || n_regionkey AS res_key, 'root' AS node_id, CAST(NULL AS VARCHAR(9)) AS parent_id, 'root' AS name, 'Panel' AS type FROM {nation} GROUP BY n_regionkey
      UNION ALL SELECT 'ui' || n_regionkey, 'n' || n_nationkey, 'root', 'nat' || (n_nationkey % 3), 'List' FROM {nation}
      UNION ALL SELECT 'ui' || n_regionkey, 's' || s_suppkey, 'n' || s_nationkey, 'sup' || (s_suppkey % 7), 'Item' FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey),
    drawn AS (
      SELECT file, line, cls, name AS func, k % 5 AS how, CASE k % 5 WHEN 0 THEN 'nat' || (k % 3) WHEN 1 THEN 'sup' || (k % 7) WHEN 2 THEN 'su' || CASE WHEN k % 2 = 0 THEN 'x' ELSE '' END ELSE 'zzz' END AS word
      FROM funcs WHERE cls IS NOT NULL)"""

#: How each fact table follows from ``BASE``: columns of ``schema.FACTS`` (what is left out is null).
FRAMES = {
    "defs": "SELECT file, line, end_line, cls, name, coalesce(cls || '.', '') || name AS scope, false AS nested FROM defs",
    "classes": "SELECT file, name, base, line, end_line, line AS header_start, first_method FROM classes",
    "imports": "SELECT file, module, CAST(NULL AS STRING) AS name, alias, line, '' AS scope FROM imports",
    "names": "SELECT file, name, line, col FROM names",
    "call_site": "SELECT file, line, ord, recv_kind, recv, callee, cls, func, func_line, scope FROM sites",
    "assign_fact": "SELECT file, line, 0 AS ord, scope, cls, 'x' AS var, 'ctor' AS kind, type AS head, CAST(NULL AS STRING) AS tail FROM assigns",
    "scope_range": "SELECT file, line AS start, end_line AS end, name AS scope, 'class' AS kind FROM classes",
    "receiver_fact": "SELECT DISTINCT file, line, expr, type, 'likely' AS confidence, 'framework' AS reason FROM facts",
    "rpc": "SELECT file, line, chan, method, stub FROM remote",
    "rpc_handler": "SELECT file, line, chan, method, endpoint, confidence, 'decorator' AS reason FROM handlers",
    "ui_binding": "SELECT file, line, 'bind' AS kind, key, CAST(NULL AS STRING) AS receiver, cls, CAST(NULL AS STRING) AS func FROM binds",
    "pubsub": "SELECT file, line, side, event, func, CAST(NULL AS STRING) AS cls FROM heard",
}
FILES = "SELECT file, module, TIMESTAMP '2024-01-01 00:00:00' AS mtime, length, 'x' AS sha, parse_ok, CASE WHEN s % 4 = 0 THEN 'semantic-only' ELSE 'full' END AS profile FROM files"
ALIASES = {"in": ["out"]}


@cache
def _tables(app: str, sf_dir: str) -> tuple[dict[str, DataFrame], str]:
    """The tables, and ``BASE`` with their counted sizes in it."""
    spark = SparkSession.getActiveSession()
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return tables, BASE.replace(SIZES, f"SELECT {tables['supplier'].count()}L AS ns, {tables['part'].count()}L AS np")


def _facts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over ``BASE``. Each table's footers are read once a session and folder: a path named in SQL costs one job
    wherever it is named, about 180 of them for a store. Sizes are numbers there: while ``l_partkey % ns`` waits for a
    joined table, a filter on a module (of two tables) joins them first, as a product."""
    tables, base = _tables(spark.sparkContext.applicationId, sf_dir)
    return spark.sql(f"WITH {base} {sql}", **tables)


def store(spark: SparkSession, sf_dir: str) -> FrameStore:
    """The facts as a store of DataFrames, each made when a question first asks for it."""
    tables = {name: partial(_facts, spark, sf_dir, sql) for name, sql in FRAMES.items()}
    bases = F.when(F.col("base").isNull(), F.array().cast("array<string>")).otherwise(F.array("base"))
    tables["classes"] = lambda: _facts(spark, sf_dir, FRAMES["classes"]).withColumn("bases", bases)
    return FrameStore(spark, _facts(spark, sf_dir, FILES), tables)


@cache
def _navigator(app: str, sf_dir: str) -> Navigator:
    spark = SparkSession.getActiveSession()
    return Navigator(store(spark, sf_dir), AnalysisConfig(sf_dir, rpc_aliases=ALIASES))


def navigator(spark: SparkSession, sf_dir: str) -> Navigator:
    """One navigator for a session and folder, so that its questions share the resolved calls."""
    return _navigator(spark.sparkContext.applicationId, sf_dir)


def _part(spark: SparkSession, sf_dir: str, key: int = 1) -> tuple[str, str]:
    """File and name of the function of one part."""
    row = _facts(spark, sf_dir, f"SELECT file, name FROM funcs WHERE k = {key}").first()
    return row["file"], row["name"]


def _resources(spark: SparkSession, sf_dir: str) -> tuple[Resources, DataFrame]:
    """Resource trees (regions, nations, suppliers) and code sites that name their nodes: a name, a path that skips
    levels, a beginning, an absent name, a name unknown before run time."""
    trees = _facts(spark, sf_dir, "SELECT * FROM nodes")
    sites = _facts(spark, sf_dir, "SELECT * FROM drawn")
    segments = F.when(F.col("how") == 1, F.array(F.lit("root"), "word")).otherwise(F.array("word"))
    prefix = F.when(F.col("how") == 4, F.lit(None).cast("boolean")).otherwise(F.col("how") == 2)
    empty = spark.createDataFrame([], "res_key string, timeline string")
    return Resources(navigator(spark, sf_dir), trees, empty), sites.select("file", "line", "cls", "func", segments.alias("segments"), prefix.alias("prefix"))


def code_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, failed files and the contract word of the whole index."""
    return navigator(spark, sf_dir).store.coverage().select("files", "failed", "coverage")


def code_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigator(spark, sf_dir).store.by_profile()


def code_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of one name, methods told from functions."""
    return navigator(spark, sf_dir).defs("red_widget")


def code_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 201 raw occurrences of one name."""
    return navigator(spark, sf_dir).usages("red_widget", 200)


def code_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal imports of every file."""
    return navigator(spark, sf_dir).deps("")


def code_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that imports a file of one region."""
    return navigator(spark, sf_dir).importers("r1")


def code_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported modules outside the index, by how often they are imported."""
    return navigator(spark, sf_dir).external()


def code_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 files with most importers."""
    return navigator(spark, sf_dir).hubs(25)


def code_hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules' least degree of a hub."""
    nav = navigator(spark, sf_dir)
    return spark.createDataFrame([(nav.hub_degree(), nav.hub_degree(real_percentile=True))], "compatible long, p95 long")


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigator(spark, sf_dir).tree(1)


def code_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that hold a text, case aside, shortest first, one more than the limit."""
    return navigator(spark, sf_dir).find("N1", 40)


def code_file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is known of one file."""
    return navigator(spark, sf_dir).file_context(_part(spark, sf_dir, 9)[0]).groupBy("section", "name", "detail", "line").agg(F.count("*").alias("n"))


def code_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What method lookup finds for every class and name, over its bases."""
    return navigator(spark, sf_dir).graph.methods().select("cls", "method", "def_file", "def_line", "def_cls")


def code_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call site that is resolved, by its branch, with the definition."""
    rows = navigator(spark, sf_dir).graph.resolved().where("def_file IS NOT NULL")
    return rows.select("file", "line", "ord", "callee", "branch", "def_file", "def_line", "def_cls")


def code_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded call sites of one method: evidence of receivers, resolution, mere names, files that failed to parse."""
    return navigator(spark, sf_dir).callers(*_part(spark, sf_dir))


def code_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded callees of one method."""
    return navigator(spark, sf_dir).callees(*_part(spark, sf_dir))


def code_rpc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, handlers and namesakes of one remote method."""
    return navigator(spark, sf_dir).rpc_refs("call_1")


def code_pubsub_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of one bare event: exact keys and keys that end in it."""
    return navigator(spark, sf_dir).pubsub_refs("k7")


def code_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of what reaches the functions of one changed file, over calls, remote calls and events."""
    nav = navigator(spark, sf_dir)
    changes = spark.createDataFrame([(_part(spark, sf_dir)[0], None, None)], "file string, diff string, old_text string")
    return Impact(nav).closure(changes, depth=2, max_edges=1 << 40)[0].withColumn("layer", F.col("layer").cast("long"))


def code_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that the hunks of a diff to every file meet."""
    nav = navigator(spark, sf_dir)
    changes = nav.store.files().select("file", F.lit("@@ -1,1 +15,12 @@\n x\n@@ -40,2 +70 @@\n").alias("diff"), F.lit(None).cast("string").alias("old_text"))
    return Impact(nav).changed_functions(changes).where("cls IS NULL OR name LIKE '%\\_%'").select("file", "cls", "name", "state")


def code_lost_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importers of a file that the index has and of one that it has lost, the latter by its module's name."""
    changes = spark.createDataFrame([(f, None, None) for f in (_part(spark, sf_dir)[0], "ext_3.py")], "file string, diff string, old_text string")
    return Impact(navigator(spark, sf_dir)).importers(changes)


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's folders, hubs, external modules, profiles, table sizes and coverage, in brief."""
    return navigator(spark, sf_dir).context(compact=True)


def code_ui_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site that names a node of a resource tree, graded by what it hits in the trees its class is bound to."""
    own, sites = _resources(spark, sf_dir)
    return own.grade(sites).select("file", "line", "cls", "level", "n")


def code_ui_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and files by level."""
    own, sites = _resources(spark, sf_dir)
    return own.audit(sites).select("level", "n", "files")


QUERIES = {
    f.__name__: f
    for f in (
        code_coverage, code_profiles, code_defs, code_usages, code_deps, code_importers, code_external, code_hubs, code_hub_degree, code_tree, code_find,
        code_file_context, code_methods, code_resolved, code_callers, code_callees, code_rpc_refs, code_pubsub_refs, code_blast, code_changed,
        code_lost_importers, code_context, code_ui_grade, code_ui_audit,
    )
}

_EDGES = """
    known AS (SELECT i.file, i.module, i.line, f.file AS dst FROM imports i LEFT JOIN files f ON f.module = i.module),
    edges AS (SELECT DISTINCT file AS src, dst FROM known WHERE dst <> file),
    degrees AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)"""
_RESOLVED = """
    up AS (
      SELECT name AS cls, name AS anc, 0 AS depth, base FROM classes
      UNION ALL SELECT up.cls, c.name, depth + 1, c.base FROM up JOIN classes c ON c.name = up.base),
    methods AS (
      SELECT cls, method, def_file, def_line, def_cls FROM (
        SELECT up.cls, defs.name AS method, defs.file AS def_file, defs.line AS def_line, defs.cls AS def_cls,
               row_number() OVER (PARTITION BY up.cls, defs.name ORDER BY depth, defs.line) AS r
        FROM up JOIN defs ON defs.cls = up.anc) WHERE r = 1),
    tops AS (SELECT file, name, count(*) AS n, min(line) AS line FROM defs WHERE cls IS NULL GROUP BY ALL),
    everywhere AS (SELECT name, min(file) AS file, min(line) AS line FROM tops GROUP BY name HAVING sum(n) = 1),
    typed AS (SELECT file, scope, arg_max(type, line) AS type FROM assigns GROUP BY ALL),
    resolved AS (
      SELECT c.*, 'self' AS branch, m.def_file, m.def_line, m.def_cls FROM sites c JOIN methods m ON m.cls = c.cls AND m.method = c.callee WHERE kind = 1
      UNION ALL SELECT c.*, 'type', m.def_file, m.def_line, m.def_cls FROM sites c JOIN typed t ON t.file = c.file AND t.scope = c.scope
        JOIN methods m ON m.cls = t.type AND m.method = c.callee WHERE kind = 2
      UNION ALL SELECT c.*, 'module', t.file, t.line, NULL FROM sites c JOIN imports i ON i.file = c.file AND i.alias = c.recv
        JOIN files f ON f.module = i.module JOIN tops t ON t.file = f.file AND t.name = c.callee AND t.n = 1 WHERE kind = 3
      UNION ALL SELECT c.*, 'name', coalesce(e.file, t.file), coalesce(e.line, t.line), NULL FROM sites c LEFT JOIN everywhere e ON e.name = c.callee
        LEFT JOIN tops t ON t.file = c.file AND t.name = c.callee AND t.n = 1 WHERE kind = 0 AND coalesce(e.file, t.file) IS NOT NULL),
    target AS (SELECT defs.* FROM defs JOIN funcs f ON f.k = 1 AND defs.file = f.file AND defs.name = f.name ORDER BY defs.line LIMIT 1),
    evidence AS (SELECT file, line, expr, list(DISTINCT type) AS types FROM facts GROUP BY ALL)"""
_GRADES = """
    bound AS (SELECT DISTINCT up.cls, binds.key AS res_key FROM up JOIN binds ON binds.cls = up.anc),
    hit AS (
      SELECT d.file, d.line, count(*) AS n FROM drawn d JOIN bound ON bound.cls = d.cls JOIN nodes ON nodes.res_key = bound.res_key
        AND CASE how WHEN 2 THEN starts_with(nodes.name, word) WHEN 4 THEN false ELSE nodes.name = word END GROUP BY ALL),
    graded AS (
      SELECT d.file, d.line, d.cls, coalesce(hit.n, 0) AS n,
             CASE WHEN how = 4 THEN 'DYNAMIC' WHEN hit.n = 1 THEN 'EXACT' WHEN hit.n > 1 THEN 'MULTI' WHEN d.cls NOT IN (SELECT cls FROM bound) THEN 'UNBOUND'
                  WHEN how = 2 THEN 'PATTERN' ELSE 'MISS' END AS level
      FROM drawn d LEFT JOIN hit ON hit.file = d.file AND hit.line = d.line)"""
_SHOWN = "coalesce(CASE WHEN {0} IS NULL THEN {1} ELSE {0} || coalesce('.' || {1}, '') END, '?')"


def _shown(cls: str, name: str) -> str:
    return _SHOWN.format(cls, name)


def _sql(answer: str, *more: str) -> str:
    start = "WITH RECURSIVE " if any("FROM up JOIN" in m for m in more) else "WITH "
    return start + ",".join([BASE.format(**{t: t for t in TABLES}), *more]) + "\n    " + answer


ORACLES: dict[str, str] = {
    "code_coverage": _sql("SELECT count(*) AS files, count(*) FILTER (NOT parse_ok) AS failed, CASE WHEN bool_and(parse_ok) THEN 'complete' ELSE 'partial' END AS coverage FROM files"),
    "code_profiles": _sql("SELECT CASE WHEN s % 4 = 0 THEN 'semantic-only' ELSE 'full' END AS profile, count(*) AS n FROM files GROUP BY 1"),
    "code_defs": _sql(f"""SELECT 'DEFINITION' AS level, CASE WHEN cls IS NULL THEN 'function' ELSE 'method' END AS kind, file, line, {_shown("cls", "name")} AS symbol
        FROM defs WHERE name = 'red_widget' ORDER BY file, line LIMIT 201"""),
    "code_usages": _sql("SELECT 'OCCUR' AS level, file, line, col FROM names WHERE name = 'red_widget' ORDER BY file, line, col LIMIT 201"),
    "code_deps": _sql("SELECT src, dst FROM edges", _EDGES),
    "code_importers": _sql("SELECT DISTINCT src AS file FROM edges WHERE dst LIKE 'r1/%'", _EDGES),
    "code_external": _sql("SELECT module, count(*) AS n FROM known WHERE dst IS NULL GROUP BY 1", _EDGES),
    "code_hubs": _sql("SELECT dst AS file, n FROM degrees ORDER BY n DESC, dst LIMIT 25", _EDGES),
    "code_hub_degree": _sql("""SELECT greatest(max(CASE WHEN k = greatest(CAST(floor(total * 0.95) AS BIGINT) - 1, 0) THEN n END), 10) AS compatible,
        greatest(max(CASE WHEN k = CAST(floor(total * 0.05) AS BIGINT) THEN n END), 10) AS p95
        FROM (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS k, count(*) OVER () AS total FROM degrees)""", _EDGES),
    "code_tree": _sql("SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS folder, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM files GROUP BY 1"),
    "code_find": _sql("SELECT file FROM files WHERE file ILIKE '%n1%' ORDER BY length(file), file LIMIT 41"),
    "code_file_context": _sql(f"""SELECT section, name, detail, CAST(line AS BIGINT) AS line, count(*) AS n FROM (
        SELECT 'class' AS section, c.name, coalesce(c.base, '') AS detail, c.line, c.file FROM classes c
        UNION ALL SELECT 'def', {_shown("cls", "name")}, NULL, line, file FROM defs
        UNION ALL SELECT 'import', dst, module, line, file FROM known WHERE dst IS NOT NULL
        UNION ALL SELECT 'external', module, NULL, line, file FROM known WHERE dst IS NULL
        UNION ALL SELECT 'importer', src, NULL, NULL, dst FROM edges
        UNION ALL SELECT 'issue', 'parse failure', NULL, NULL, file FROM files WHERE NOT parse_ok)
        WHERE file = (SELECT file FROM funcs WHERE k = 9) GROUP BY ALL""", _EDGES),
    "code_methods": _sql("SELECT * FROM methods", _RESOLVED),
    "code_resolved": _sql("SELECT file, line, ord, callee, branch, def_file, def_line, def_cls FROM resolved", _RESOLVED),
    "code_callers": _sql(f"""
        SELECT DISTINCT * FROM (
          SELECT CASE WHEN e.types IS NOT NULL AND NOT hit THEN 'FRAMEWORK-INFERRED' WHEN hit THEN 'VERIFIED' ELSE 'CANDIDATE' END AS level, c.file, c.line,
                 {_shown("c.cls", "c.func")} AS caller,
                 CASE WHEN e.types IS NOT NULL OR hit THEN NULL WHEN c.def_file IS NOT NULL THEN 'resolved to ' || c.def_file || ':' || c.def_line ELSE 'unreachable' END AS note
          FROM (SELECT s.*, r.def_file, r.def_line, coalesce(r.def_file = t.file AND r.def_line = t.line, false) AS hit, t.cls AS wanted
                FROM sites s JOIN target t ON s.callee = t.name LEFT JOIN resolved r ON r.file = s.file AND r.line = s.line AND r.ord = s.ord) c
          LEFT JOIN evidence e ON e.file = c.file AND e.line = c.line AND e.expr = c.recv
          WHERE e.types IS NULL OR coalesce(list_contains(e.types, c.wanted), false)
          UNION ALL SELECT 'CANDIDATE', n.file, n.line, '?', 'parse failure' FROM names n JOIN target t ON n.name = t.name JOIN files f ON f.file = n.file WHERE NOT f.parse_ok)""", _RESOLVED),
    "code_callees": _sql(f"""
        SELECT level, symbol, def_file, def_line, note, CAST(min(line) AS BIGINT) AS line FROM (
          SELECT CASE WHEN r.def_file IS NOT NULL THEN 'VERIFIED' WHEN len(e.types) = 1 THEN 'FRAMEWORK-INFERRED' ELSE 'CANDIDATE' END AS level,
                 CASE WHEN r.def_file IS NOT NULL THEN {_shown("r.def_cls", "s.callee")} WHEN len(e.types) = 1 THEN e.types[1] || '.' || s.callee ELSE s.callee END AS symbol,
                 r.def_file, r.def_line, CASE WHEN r.def_file IS NULL AND coalesce(len(e.types), 0) <> 1 THEN 'unresolved' END AS note, s.line
          FROM sites s JOIN target t ON s.file = t.file AND s.line BETWEEN t.line AND t.end_line
          LEFT JOIN resolved r ON r.file = s.file AND r.line = s.line AND r.ord = s.ord
          LEFT JOIN evidence e ON e.file = s.file AND e.line = s.line AND e.expr = s.recv) GROUP BY ALL""", _RESOLVED),
    "code_rpc_refs": _sql(f"""
        SELECT 'RPC-INFERRED' AS level, r.file, r.line, {_shown("i.cls", "i.name")} AS symbol, chan, NULL AS match
          FROM called r LEFT JOIN defs i ON i.file = r.file AND r.line BETWEEN i.line AND i.end_line
        UNION ALL SELECT CASE WHEN confidence = 'verified' THEN 'HANDLER-VERIFIED' ELSE 'HANDLER-INFERRED' END, file, line, endpoint || '.' || method, chan, 'direction' FROM paired
        UNION ALL SELECT 'NAME-ONLY', file, line, name, NULL, 'name-only' FROM defs WHERE name = 'call_1' AND (file, line) NOT IN (SELECT (file, line) FROM paired)""", """
        called AS (SELECT * FROM remote WHERE method = 'call_1'),
        paired AS (SELECT * FROM handlers WHERE method = 'call_1' AND (chan IN (SELECT chan FROM called)
            OR (chan = 'in' AND EXISTS (SELECT 1 FROM called WHERE chan = 'out')) OR NOT EXISTS (SELECT 1 FROM called)))"""),
    "code_pubsub_refs": _sql("""SELECT event, CASE side WHEN 'publish' THEN 'EVENT-INFERRED' ELSE 'LISTENER' END AS level, file, line, coalesce(func, '?') AS symbol
        FROM heard WHERE event = 'k7' OR event LIKE '%.k7'"""),
    "code_blast": _sql(f"""
        SELECT 1 AS layer, target, caller, caller_file, caller_line, via FROM reach1
        UNION ALL SELECT 2, target, caller, caller_file, caller_line, via FROM reach2""", _RESOLVED, f"""
        links AS (
          SELECT DISTINCT d.file || '|' || coalesce(d.cls, '') || '|' || d.name AS t, {_shown("d.cls", "d.name")} AS target, r.file || '|' || coalesce(r.cls, '') || '|' || r.func AS key,
                 {_shown("r.cls", "r.func")} AS caller, r.file AS caller_file, r.line AS caller_line, 'call' AS via
          FROM resolved r JOIN defs d ON d.file = r.def_file AND d.line = r.def_line
          UNION SELECT d.file || '|' || coalesce(d.cls, '') || '|' || d.name, {_shown("d.cls", "d.name")}, i.file || '|' || coalesce(i.cls, '') || '|' || i.name,
                 {_shown("i.cls", "i.name")}, r.file, r.line, 'rpc'
          FROM remote r JOIN defs d ON d.name = r.method AND (d.cls IS NULL OR r.stub IS NULL OR r.stub = d.cls)
            LEFT JOIN defs i ON i.file = r.file AND r.line BETWEEN i.line AND i.end_line
          UNION SELECT b.file || '||' || b.func, b.func, a.file || '||' || a.func, a.func, a.file, a.line, 'pubsub'
          FROM heard a JOIN heard b ON a.event = b.event AND a.side <> b.side WHERE a.func IS NOT NULL AND b.func IS NOT NULL),
        loose AS (SELECT * FROM links WHERE key IS NULL OR key <> t),
        seeds AS (SELECT DISTINCT d.file || '|' || coalesce(d.cls, '') || '|' || d.name AS key FROM defs d WHERE d.file = (SELECT file FROM funcs WHERE k = 1)),
        reach1 AS (SELECT DISTINCT * FROM loose WHERE t IN (SELECT key FROM seeds)),
        ahead AS (SELECT DISTINCT key FROM reach1 WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM seeds)),
        reach2 AS (SELECT DISTINCT * FROM loose WHERE t IN (SELECT key FROM ahead))"""),
    "code_lost_importers": _sql("""SELECT src AS file, dst AS imports FROM edges WHERE dst = (SELECT file FROM funcs WHERE k = 1)
        UNION SELECT file, 'ext_3.py' FROM imports WHERE module = 'ext_3'""", _EDGES),
    "code_context": _sql("""
        SELECT * FROM (SELECT 'folder' AS section, split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS name, count(*) AS n FROM files GROUP BY 2 ORDER BY n DESC, name LIMIT 15)
        UNION ALL SELECT * FROM (SELECT 'hub', dst, n FROM degrees ORDER BY n DESC, dst LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'external', module, count(*) AS n FROM known WHERE dst IS NULL GROUP BY module ORDER BY n DESC, module LIMIT 10)
        UNION ALL SELECT 'profile', CASE WHEN s % 4 = 0 THEN 'semantic-only' ELSE 'full' END AS p, count(*) FROM files GROUP BY p
        UNION ALL SELECT 'coverage', CASE WHEN bool_and(parse_ok) THEN 'complete' ELSE 'partial' END, count(*) FILTER (NOT parse_ok) FROM files
        UNION ALL SELECT 'table', 'defs', count(*) FROM defs UNION ALL SELECT 'table', 'classes', count(*) FROM classes
        UNION ALL SELECT 'table', 'imports', count(*) FROM imports UNION ALL SELECT 'table', 'call_site', count(*) FROM sites""", _EDGES),
    "code_ui_grade": _sql("SELECT file, line, cls, level, n FROM graded", _RESOLVED, _GRADES),
    "code_ui_audit": _sql("""SELECT l.level, count(g.file) AS n, count(DISTINCT g.file) AS files
        FROM (SELECT unnest(['EXACT', 'MULTI', 'PATTERN', 'INDIRECT', 'UNBOUND', 'MISS', 'DYNAMIC']) AS level) l LEFT JOIN graded g ON g.level = l.level GROUP BY 1""", _RESOLVED, _GRADES),
    "code_changed": _sql("""
        SELECT DISTINCT d.file, d.cls, d.name, 'changed' AS state FROM defs d LEFT JOIN classes c ON c.file = d.file AND c.name = d.cls
        WHERE (d.line <= 26 AND d.end_line >= 15) OR (d.line <= 70 AND d.end_line >= 70)
           OR (c.line <= 26 AND c.first_method - 1 >= 15) OR (c.line <= 70 AND c.first_method - 1 >= 70)"""),
}
