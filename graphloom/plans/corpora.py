"""Queries over source files and documents made from the tables, with the SQL that gives the same rows.

Each part stands for a file of one of five languages; @ in a file is its number, ^ the number of
the file before it of the same language, of the first its own. What a file holds is stated again in the SQL, as values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, mutate, resolve, search
from ..sources import scan
from .derived import edges_of, nodes_of, query, table

#: Path and content of the file of part @, by @ modulo 5.
FILES = (
    ("src/f@.py", 'import os\nfrom pkg.f^ import z\nclass C@(C^):\n    """Doc @."""\n    def m@(self):\n        return helper@()\n\ndef helper@():\n    pass\n'),
    ("src/main/java/a/b/K@.java", "import a.b.X;\n/** Doc @. */\nclass K@ extends K^ {\n  K@() { }\n  int f@(int x) { return g@(x); }\n  int g@(int x) { return 1; }\n}\n"),
    ("go/g@.go", 'package m\nimport "fmt"\ntype S@ struct {}\nfunc A@() { B@() }\nfunc B@() { fmt.Println(1) }\n'),
    ("web/j@.js", 'import q from "lib@";\nclass N@ extends N^ {\n  go@() { run@(1); }\n}\nfunction run@(x) { return x; }\n'),
    ("web/t@.ts", 'import { q } from "./lib@";\nexport function e@(a: number): void { h@(a); }\nfunction h@(a) { }\n'),
)
#: Modulo, kind, name, first and last line, owner (of a call its caller), signature, docstring, bases of what FILES hold.
HELD = (
    (0, "class", "C@", 3, 6, None, "", "Doc @.", "C^"), (0, "function", "m@", 5, 6, "C@", "def m@(self)", "", ""), (0, "function", "helper@", 8, 9, None, "def helper@()", "", ""),
    (0, "import", "os", 0, 0, None, "", "", ""), (0, "import", "pkg.f^", 0, 0, None, "", "", ""), (0, "call", "helper@", 6, 6, "m@", "", "", ""),
    (1, "class", "K@", 3, 7, None, "", "Doc @.", "K^"), (1, "function", "f@", 5, 5, "K@", "int f@(int x)", "", ""), (1, "function", "g@", 6, 6, "K@", "int g@(int x)", "", ""),
    (1, "import", "a.b.X", 0, 0, None, "", "", ""), (1, "call", "g@", 5, 5, "f@", "", "", ""),
    (2, "class", "S@", 3, 3, None, "", "", ""), (2, "function", "A@", 4, 4, None, "func A@()", "", ""), (2, "function", "B@", 5, 5, None, "func B@()", "", ""),
    (2, "import", "fmt", 0, 0, None, "", "", ""), (2, "call", "B@", 4, 4, "A@", "", "", ""), (2, "call", "Println", 5, 5, "B@", "", "", ""),
    (3, "class", "N@", 2, 4, None, "", "", "N^"), (3, "function", "go@", 3, 3, "N@", "go@()", "", ""), (3, "function", "run@", 5, 5, None, "function run@(x)", "", ""),
    (3, "import", "lib@", 0, 0, None, "", "", ""), (3, "call", "run@", 3, 3, "go@", "", "", ""),
    (4, "function", "e@", 2, 2, None, "function e@(a: number): void", "", ""), (4, "function", "h@", 3, 3, None, "function h@(a)", "", ""),
    (4, "import", "./lib@", 0, 0, None, "", "", ""), (4, "call", "h@", 2, 2, "e@", "", "", ""),
)
PATHS = " ".join(f"WHEN {k} THEN '{path}'" for k, (path, _) in enumerate(FILES))
LANGS = "list_value('python', 'java', 'go', 'javascript', 'typescript')"


def _value(x: str | int | None) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _fill(x: str) -> str:
    return f"replace(replace({x}, '@', p_partkey::VARCHAR), '^', (CASE WHEN p_partkey < 5 THEN p_partkey ELSE p_partkey - 5 END)::VARCHAR)"


#: `found`: what the parser gives, `code`: nodes of the code, `links`: its edges.
CODE = f"""files AS (SELECT p_partkey, {_fill(f"CASE p_partkey % 5 {PATHS} END")} AS path, {LANGS}[p_partkey % 5 + 1] AS language FROM part),
found AS (
  SELECT path, language, kind, {_fill("name")} AS name, start_line, end_line, {_fill("owner")} AS owner, {_fill("signature")} AS signature, {_fill("docstring")} AS docstring, {_fill("bases")} AS bases
  FROM files JOIN (VALUES {", ".join("(" + ", ".join(map(_value, r)) + ")" for r in HELD)}) v(k, kind, name, start_line, end_line, owner, signature, docstring, bases) ON p_partkey % 5 = k
), code AS (
  SELECT CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END || ':' || path || ':' || name || ':' || start_line AS uid, CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END AS label, name, path AS file, NULL AS path,
    start_line, end_line, language, CASE kind WHEN 'function' THEN signature END AS signature, docstring, CASE kind WHEN 'class' THEN bases END AS bases, NULL AS imports,
    CASE WHEN language = 'java' THEN replace(substring(path, 15, length(path) - 19), '/', '.') || CASE kind WHEN 'function' THEN '#' || name ELSE '' END END AS fqn, owner
  FROM found WHERE kind IN ('class', 'function')
  UNION ALL SELECT 'Module::' || stem || ':0', 'Module', stem, NULL, path, NULL, NULL, language, NULL, NULL, NULL, (SELECT string_agg(name, ',' ORDER BY name DESC) FROM found i WHERE i.path = m.path AND kind = 'import'), NULL, NULL
  FROM (SELECT *, regexp_extract(path, '([^/]+)\\.[a-z]+$', 1) AS stem FROM files) m
), links AS (
  SELECT coalesce((SELECT c.uid FROM code c WHERE c.file = x.file AND c.label = 'Class' AND c.name = x.owner), 'Module::' || regexp_extract(x.file, '([^/]+)\\.[a-z]+$', 1) || ':0') AS src_uid, x.uid AS dst_uid, 'CONTAINS' AS type, NULL AS line FROM code x WHERE label <> 'Module'
  UNION ALL SELECT a.uid, b.uid, 'CALLS', f.start_line FROM found f JOIN code a ON a.file = f.path AND a.name = f.owner JOIN code b ON b.file = f.path AND b.name = f.name WHERE kind = 'call'
)"""
#: Modules are known by their path.
CODE = CODE.replace("'Module::' || stem", "'Module:' || path || ':' || stem").replace("'Module::' || regexp", "'Module:' || x.file || ':' || regexp")


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a file for each part."""
    part, key = table(spark, d, "part"), F.col("p_partkey")
    made = [F.array(*map(F.lit, x))[(key % 5).cast("int")] for x in zip(*FILES, strict=True)]
    fill = lambda x: F.replace(F.replace(x, F.lit("@"), key.cast("string")), F.lit("^"), F.when(key < 5, key).otherwise(key - 5).cast("string"))
    return part.select(fill(made[0]).alias("path"), fill(made[1]).alias("content"))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): Markdown around the whole text of each document."""
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        F.concat(F.lit("docs/"), i, F.lit(".md")).alias("path"),
        F.concat(F.lit("# Part "), i, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nsee `a.C"), i, F.lit("`, `K"), i, F.lit("` and `no`\n## End\nbye `N"), i, F.lit("`\n")).alias("content"),
    )


#: `sections` and `roots`: what documents_of holds.
DOCS = r"""docs AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path, '# Part ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || 'see `a.C' || doc_id || '`, `K' || doc_id || '` and `no`' || chr(10) || '## End' || chr(10) || 'bye `N' || doc_id || '`' || chr(10) AS content FROM documents),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs),
heads AS (SELECT path, i, length(regexp_extract(line, '^(#{1,6})\s+', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) AS title, lead(i) OVER (PARTITION BY path ORDER BY i) AS after FROM lines WHERE regexp_matches(line, '^#{1,6}\s+\S')),
refs AS (SELECT path, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(content, '```.*?```', '', 'gs'), '`([^`\n]+)`', 1), lambda x: regexp_matches(x, '^[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)*$') AND length(x) > 2), lambda x: string_split(x, '.')[-1]))) AS found FROM docs),
sections AS (
  SELECT 'Document:' || path || ':' || title || ':' || i AS uid, title AS name, path AS file, i AS start_line, 'Part ' || doc_id || ' > ' || title AS title, title AS section, level,
    left(trim(array_to_string(list_slice(string_split(content, chr(10)), i + 1, coalesce(after - 1, 1000000)), chr(10)), chr(10) || chr(9) || chr(11) || chr(12) || chr(13) || ' '), 2000) AS content,
    left(sha256(content), 16) AS content_hash, CASE WHEN i = 1 THEN found END AS refs, 'Document:' || path || ':Part ' || doc_id || ':1' AS root
  FROM heads JOIN docs USING (path) JOIN refs USING (path)
)"""


def _code(spark, d):
    return scan.code_graph(sources_of(spark, d))


# --- parsing ---------------------------------------------------------------------------------


@query("parse_languages", sql=f"WITH {CODE} SELECT path, language, kind, name, start_line, end_line, owner, signature, docstring, bases FROM found")
def _(spark, d):
    found = scan.entities(sources_of(spark, d))
    return found.select("path", "language", "kind", "name", "start_line", "end_line", "owner", "signature", "docstring", F.array_join("bases", ",").alias("bases"))


@query("code_graph_nodes", sql=f"WITH {CODE} SELECT uid, label, name, file, path, start_line, end_line, language, signature, docstring, bases, imports, fqn FROM code")
def _(spark, d):
    texts = [F.array_join(F.reverse(F.array_sort(c)) if c == "imports" else F.col(c), ",").alias(a) for c, a in (("base_classes", "bases"), ("imports", "imports"))]
    return _code(spark, d)[0].select("uid", "label", "name", "file", "path", "start_line", "end_line", "language", "signature", "docstring", *texts, "fqn")


@query("code_graph_edges", sql=f"WITH {CODE} SELECT src_uid, dst_uid, type, line FROM links")
def _(spark, d):
    return _code(spark, d)[1]


@query("document_graph_nodes", sql=f"WITH {DOCS} SELECT uid, name, file, start_line, title, section, level, content, content_hash, array_to_string(refs, ',') AS refs FROM sections")
def _(spark, d):
    return scan.document_graph(documents_of(spark, d))[0].select("uid", "name", "file", "start_line", "title", "section", "level", "content", "content_hash", F.array_join("code_references", ",").alias("refs"))


@query("document_graph_edges", sql=f"WITH {DOCS} SELECT root AS src_uid, uid AS dst_uid, 'CONTAINS' AS type FROM sections")
def _(spark, d):
    return scan.document_graph(documents_of(spark, d))[1].select("src_uid", "dst_uid", "type")


@query("index_edges", sql=f"""WITH {CODE}, {DOCS}
SELECT src_uid, dst_uid, type, line FROM links UNION ALL SELECT root, uid, 'CONTAINS', NULL FROM sections
UNION ALL SELECT a.uid, b.uid, 'INHERITS', NULL FROM code a JOIN code b ON b.label = 'Class' AND b.name = a.bases AND a.uid <> b.uid WHERE a.label = 'Class'
UNION ALL SELECT a.uid, b.uid, 'IMPORTS', NULL FROM code a, unnest(string_split(a.imports, ',')) u(raw), code b WHERE a.label = 'Module' AND b.label = 'Module' AND b.name = string_split(raw, '.')[-1] AND a.uid <> b.uid
UNION ALL SELECT DISTINCT s.uid, b.uid, 'REFERENCES', NULL FROM (SELECT uid, unnest(refs) AS raw FROM sections) s JOIN code b ON b.label IN ('Function', 'Class') AND b.name = raw""")  # fmt: skip
def _(spark, d):
    nodes, edges = _code(spark, d)
    n, e = scan.document_graph(documents_of(spark, d))
    return resolve.resolve(nodes.unionByName(n), edges.unionByName(e))


@query("resolve_again", sql=f"""WITH {CODE} SELECT src_uid, dst_uid, type, line FROM links
UNION ALL SELECT a.uid, b.uid, 'INHERITS', NULL FROM code a JOIN code b ON b.label = 'Class' AND b.name = a.bases AND a.uid <> b.uid WHERE a.label = 'Class' AND a.language <> 'java'""")  # fmt: skip
def _(spark, d):
    # edges across files that no longer hold go, those that hold come once
    nodes, edges = _code(spark, d)
    nodes = nodes.withColumn("base_classes", F.when(F.col("language") != "java", F.col("base_classes"))).withColumn("imports", F.lit(None).cast("array<string>"))
    return resolve.resolve(nodes, resolve.resolve(_code(spark, d)[0], edges))


_TITLES = """SELECT doc_id % 40 AS path, doc_id AS start_line, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 8) || '.2 of' ELSE 'a > h' || (doc_id % 120) END AS title, CASE WHEN doc_id % 40 < 8 AND doc_id % 5 <> 0 THEN 4 END AS level FROM documents"""


@query("outline_levels", sql=f"""WITH t AS ({_TITLES}), stored AS (SELECT path FROM t GROUP BY path HAVING count(level) > 0),
f AS (SELECT k AS path, 'h' || (k + 40 * m) AS title, 1 + (k + m) % 4 AS n FROM generate_series(8, 23) a(k), generate_series(0, 1) b(m)),
o AS (SELECT *, CASE WHEN doc_3 = 0 THEN 3 WHEN row_number() OVER (PARTITION BY path ORDER BY start_line) = 1 THEN 1 END AS own FROM (SELECT *, start_line % 3 AS doc_3 FROM t)),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY path ORDER BY start_line) AS carried FROM o)
SELECT path::VARCHAR AS path, start_line, CASE WHEN path IN (FROM stored) THEN coalesce(level, 2) WHEN path BETWEEN 8 AND 23 THEN coalesce((SELECT n FROM f WHERE f.path = c.path AND f.title = string_split(c.title, ' > ')[-1]), 2) ELSE carried END AS inferred_level FROM c""")  # fmt: skip
def _(spark, d):
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, F.concat((i % 8).cast("string"), F.lit(".2 of"))).otherwise(F.concat(F.lit("a > h"), (i % 120).cast("string")))
    rows = table(spark, d, "documents").select((i % 40).cast("string").alias("path"), i.alias("start_line"), title.alias("title"), F.when((i % 40 < 8) & (i % 5 != 0), 4).alias("level"))
    heading = lambda m: F.concat(F.lit("  "), F.repeat(F.lit("#"), (1 + (F.col("id") + m) % 4).cast("int")), F.lit(" h"), (F.col("id") + 40 * m).cast("string"), F.lit(" \ntext\n"))
    # files 8 to 23 have headings, 24 to 31 none, and of the others there is no file
    content = F.when(F.col("id") < 24, F.concat(heading(0), heading(1))).otherwise("text")
    files = spark.range(8, 32).select(F.col("id").cast("string").alias("path"), content.alias("content"))
    return X.outline_levels(rows, files).select("path", "start_line", "inferred_level")


# --- changes of paths, owners and names --------------------------------------------------------


@query("strip_prefix_edges", sql=f"WITH {CODE} SELECT replace(src_uid, ':src/', ':') AS src_uid, replace(dst_uid, ':src/', ':') AS dst_uid, type, line FROM links")
def _(spark, d):
    return mutate.strip_prefix(*_code(spark, d), "src/")[1]


@query("strip_prefix_nodes", sql=f"WITH {CODE} SELECT replace(uid, ':src/', ':') AS uid, regexp_replace(file, '^src/', '') AS file, regexp_replace(path, '^src/', '') AS path FROM code")
def _(spark, d):
    return mutate.strip_prefix(*_code(spark, d), "src/")[0].select("uid", "file", "path")


@query("delete_repository_edges", graph_sql="SELECT src_uid, dst_uid, type, line FROM edges WHERE src_uid NOT IN (SELECT uid FROM nodes WHERE repository = 'repo3') AND dst_uid NOT IN (SELECT uid FROM nodes WHERE repository = 'repo3')")
def _(spark, d):
    return mutate.delete_nodes(nodes_of(spark, d), edges_of(spark, d), F.col("repository") == "repo3")[1]


@query("cleanup_folders_edges", graph_sql="SELECT src_uid, dst_uid, type, line FROM edges WHERE src_uid NOT IN (SELECT uid FROM nodes WHERE file = 'Brand#4' OR path IS NOT NULL) AND dst_uid NOT IN (SELECT uid FROM nodes WHERE file = 'Brand#4' OR path IS NOT NULL)")
def _(spark, d):
    n = nodes_of(spark, d).withColumn("file", F.when(F.col("file") == "Brand#4", F.lit("build/x.py")).otherwise(F.col("file")))
    return mutate.delete_nodes(n, edges_of(spark, d), mutate.in_folders(("build", "src")))[1]


@query("tag_file", graph_sql="SELECT uid, CASE WHEN file = 'Brand#7' THEN 'mine' ELSE repository END AS repository FROM nodes")
def _(spark, d):
    return mutate.tag_file(nodes_of(spark, d), "Brand#7", "mine").select("uid", "repository")


@query("set_fqn", graph_sql="SELECT uid, CASE WHEN uid = 'Function:5' THEN 'z.y.x' ELSE fqn END AS fqn FROM nodes")
def _(spark, d):
    return mutate.set_fqn(nodes_of(spark, d), "Function:5", "z.y.x").select("uid", "fqn")


@query("upsert_last_given", sql="SELECT 'Function:' || user_id AS uid, arg_max(event_type, event_id) FILTER (event_id % 3 > 0) AS signature, arg_max('n' || event_id, event_id) AS name FROM events GROUP BY user_id")
def _(spark, d):
    # many rows of one key in a batch: of each property the last that is given
    i = F.col("event_id")
    new = table(spark, d, "events").select(
        F.lit("Function").alias("label"), F.concat(F.lit("Function:"), F.col("user_id").cast("string")).alias("uid"), F.when(i % 3 > 0, F.col("event_type")).alias("signature"),
        F.concat(F.lit("n"), i.cast("string")).alias("name"), i.alias("_seq"),
    )
    return mutate.upsert_nodes(nodes_of(spark, d).limit(0), new).select("uid", "signature", "name")


# --- names in texts ----------------------------------------------------------------------------

_PLAIN = r"[^\x00-\x7F]"


@query("identifiers_plain", sql=rf"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '{_PLAIN}', ' ', 'g'), '\b(?:[a-z]+(?:[A-Z][a-zA-Z0-9]*)+|[A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]*)+|[a-z]+(?:_[a-z0-9]+)+|[a-zA-Z_][a-zA-Z0-9_]{{2,}})\b'),
  lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in X.STOP_WORDS)}], lower(x))), ' ') AS words FROM documents""")  # fmt: skip
def _(spark, d):
    # letters beyond ASCII are blanked on both sides, as SQL's word borders know none
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(X.identifiers(plain), " ").alias("words"))


@query("qualified_calls", sql="SELECT p_partkey, 'com.acme.S' || p_partkey || '#run' || (p_partkey % 7) AS called, 'x.y_1.z' || p_partkey AS dotted, '' AS two, true AS with_hash, p_partkey % 2 = 0 AS with_dots FROM part")
def _(spark, d):
    i, k = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 7).cast("string")
    return table(spark, d, "part").select(
        "p_partkey",
        X.qualified_name(F.concat(F.lit("who calls com.acme.S"), i, F.lit("#run"), k, F.lit("(int, long) of a.b.c now"))).alias("called"),
        X.qualified_name(F.concat(F.lit("see x.y_1.z"), i, F.lit(", please"))).alias("dotted"),
        X.qualified_name(F.concat(F.lit("only a.b"), i)).alias("two"),
        X.is_qualified(F.concat(F.lit("S#run"), i)).alias("with_hash"),
        X.is_qualified(F.concat(F.lit("a.b"), F.when(F.col("p_partkey") % 2 == 0, ".c").otherwise(" .c"), i)).alias("with_dots"),
    )


@query("stems", sql="SELECT page_id, 'p' || page_id || '.tar' AS stem, '.gz' AS suffix, 'p' || page_id AS bare, '' AS none, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' WHEN 3 THEN 'javascript' END AS language, page_id % 2 = 0 AS is_document FROM pages")
def _(spark, d):
    i = F.col("page_id")
    name = F.concat(F.lit("a.b/c/p"), i.cast("string"))
    kind = F.array(*map(F.lit, (".py", ".JAVA", ".tsx", ".mjs", ".csv")))[(i % 5).cast("int")]
    return table(spark, d, "pages").select(
        "page_id", X.stem(F.concat(name, F.lit(".tar.GZ"))).alias("stem"), X.suffix(F.concat(name, F.lit(".tar.GZ"))).alias("suffix"), X.stem(name).alias("bare"), X.suffix(F.concat(F.lit("p"), i.cast("string"))).alias("none"),
        X.language(F.concat(name, kind)).alias("language"), X.is_document(F.concat(name, F.when(i % 2 == 0, ".RST").otherwise(".py"))).alias("is_document"),
    )


@query("truncated", sql="SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '...' ELSE text END AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncated("text", 100, "\n...").alias("text"))


# --- searches with given vectors ---------------------------------------------------------------


def _with_vectors(spark, d):
    """The derived graph's nodes, documents with the vectors of their numbers, and a question's vector, which is vector 0."""
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("Document:"), F.col("vec_id").cast("string")).alias("uid"), F.col("embedding").alias("_v"))
    nodes = nodes_of(spark, d).join(vectors, "uid", "left").withColumn("embedding", F.col("_v")).drop("_v")
    asked = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return nodes, lambda _: asked


#: `semantic` hits of vector 0, and `keyword` hits of the words NATION_1, red and widget, five each.
_SEARCH = """
, sem AS (SELECT n.uid, n.label, n.name, n.file, n.start_line, list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM nodes n JOIN embeddings v ON n.uid = 'Document:' || v.vec_id),
semantic AS (SELECT * FROM sem WHERE score IS NOT NULL ORDER BY score DESC, uid LIMIT 5),
met AS (SELECT pos, n.uid, n.name, coalesce(n.file, '') AS file, n.start_line, CASE WHEN n.name = word THEN 1.0 ELSE 0.9 END AS score FROM (VALUES (1, 'NATION_1'), (2, 'red'), (3, 'widget')) w(pos, word) JOIN nodes n ON n.label IN ('Function', 'Class', 'Module') AND contains(lower(n.name), lower(word))),
best AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, CASE WHEN score < 1 THEN length(name) ELSE 0 END, uid) AS r FROM met),
keyword AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pos, score DESC) AS x FROM best WHERE r <= 5),
both_lists AS (SELECT uid, name, file, start_line, score, 0 AS late FROM keyword WHERE x = 1 UNION ALL SELECT uid, name, coalesce(file, ''), start_line, score, 1 FROM semantic),
fused AS (SELECT *, row_number() OVER (PARTITION BY name, file, start_line ORDER BY late, score DESC, uid) AS y FROM both_lists)"""


@query("semantic_hits", graph_sql=_SEARCH + " SELECT uid, label AS type, name, file, start_line, round(score, 6) AS score FROM semantic")
def _(spark, d):
    nodes, encode = _with_vectors(spark, d)
    return search.semantic_search(nodes, encode, "any", 5).select("uid", "type", "name", "file", "start_line", F.round("score", 6).alias("score"))


@query("hybrid_hits", graph_sql=_SEARCH + " SELECT uid, name, file, start_line, round(score::DOUBLE, 6) AS score, CASE late WHEN 0 THEN 'keyword' ELSE 'semantic' END AS match_source FROM fused WHERE y = 1 ORDER BY fused.score DESC, late, uid LIMIT 5")
def _(spark, d):
    nodes, encode = _with_vectors(spark, d)
    hits = search.hybrid_search(nodes, edges_of(spark, d), encode, "NATION_1 has a red widget", 5, 1)[0]
    return hits.select("uid", "name", "file", "start_line", F.round("score", 6).alias("score"), "match_source")


@query("related_to_file", recursive=True, graph_sql="""
, s AS (SELECT uid, label, name AS seed FROM nodes WHERE (name, label) IN (SELECT (name, label) FROM nodes WHERE label IN ('Function', 'Class') AND file = 'Brand#3')),
walk AS (SELECT uid, seed, 0 AS d FROM s WHERE label = 'Class' UNION SELECT e.src_uid, w.seed, w.d + 1 FROM walk w JOIN edges e ON e.type = 'INHERITS' AND e.dst_uid = w.uid WHERE w.d < 10),
r AS (
  SELECT s.seed, 1 AS o, unnest([e.src_uid, e.dst_uid]) AS uid FROM s JOIN edges e ON e.type = 'CALLS' AND e.src_uid = s.uid WHERE s.label = 'Function'
  UNION ALL SELECT s.seed, 3, e.dst_uid FROM s JOIN edges e ON e.type = 'CONTAINS' AND e.src_uid = s.uid WHERE s.label = 'Class'
  UNION ALL SELECT seed, 4, uid FROM walk WHERE d > 0
), k AS (SELECT r.seed, r.o, n.name, coalesce(n.file, '') AS file, n.start_line, row_number() OVER (PARTITION BY n.name, coalesce(n.file, ''), n.start_line ORDER BY o, seed) AS x FROM r JOIN nodes n USING (uid))
SELECT seed AS seed_name, CASE o WHEN 1 THEN 'called_by' WHEN 3 THEN 'method' ELSE 'child' END AS relationship, name, file, start_line FROM k WHERE x = 1""")  # fmt: skip
def _(spark, d):
    n, e = nodes_of(spark, d), edges_of(spark, d)
    return search.related(n, e, graph.file_entities(n, "Brand#3"), 1, callers=False)
