"""Column expressions on names, paths, documents and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a question that are no identifiers.
STOP_WORDS = (
    "the", "this", "that", "what", "where", "which", "how", "does",
    "function", "class", "method", "module", "file", "code", "find",
    "search", "show", "get", "set", "for", "from", "with", "and",
    "not", "are", "was", "has", "have", "all",
)
#: Suffixes and the languages they stand for.
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt")
#: Folders that no scan enters.
EXCLUDED = (
    "node_modules", ".git", ".venv", "venv", "__pycache__",
    "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
    "vendor", "target",
    ".cursor", ".agent", ".agents", ".vscode", ".idea", ".fleet",
    ".windsurf", ".continue", ".aider", ".copilot",
)

#: What counts as an identifier (camel, Pascal and snake case, words of three letters) and as a qualified name.
_IDENTIFIER = r"(?U)\b(?:[a-z]+(?:[A-Z][a-zA-Z0-9]*)+|[A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]*)+|[a-z]+(?:_[a-z0-9]+)+|[a-zA-Z_][a-zA-Z0-9_]{2,})\b"
_DOTTED = r"(?U)[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){2,}(?:#[a-zA-Z_]\w*(?:\([^)]*\))?)?"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_segment(x: str | Column, by: str = ".") -> Column:
    return F.substring_index(c(x), by, -1)


def stem(path: str | Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_extract(c(path), r"([^/]+?)(\.[^./]+)?$", 1)


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(c(path), r"(\.[^./]+)$", 1))


def language(path: str | Column) -> Column:
    """The language of a source path, null for others."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, suffix(path))


def is_document(path: str | Column) -> Column:
    return suffix(path).isin(*DOC_SUFFIXES)


def excluded(relative: str | Column) -> Column:
    """Whether a relative path passes through a folder that scans leave out."""
    return F.arrays_overlap(F.split(F.replace(c(relative), F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, EXCLUDED)))


def content_hash(text: str | Column) -> Column:
    return F.left(F.sha2(c(text).cast("binary"), 256), F.lit(16))


def java_fqn(path: str | Column, name: str | Column, is_method: bool | Column = False, parent: str | Column | None = None) -> Column:
    """The qualified name that a Java path below src/main/java or src/test/java gives; empty for other paths.

    Classes of a file share its dotted path. A method of a class adds `#name`; one without a
    class takes the place of the file in its package.
    """
    inner = F.coalesce(
        F.nullif(F.regexp_extract(c(path), r"src/main/java/(.*)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(c(path), r"src/test/java/(.*)$", 1), F.lit("")),
        F.lit(""),
    )
    dotted = F.regexp_replace(F.translate(inner, "/", "."), r"\.java$", "")
    owned = F.lit(False) if parent is None else F.coalesce(c(parent), F.lit("")) != ""
    package = F.regexp_extract(dotted, r"^(.*)\.", 1)
    method = F.when(owned, F.concat(dotted, F.lit("#"), c(name))).when(package != "", F.concat(package, F.lit("."), c(name))).otherwise(c(name))
    flag = is_method if isinstance(is_method, Column) else F.lit(is_method)
    return F.when(dotted == "", F.lit("")).when(flag, method).otherwise(dotted)


def relative_path(path: str | Column, repository: str | Column) -> Column:
    """What follows `/repository/` in a path, with forward slashes; the whole path where that is absent."""
    p = F.replace(F.coalesce(c(path), F.lit("")), F.lit("\\"), F.lit("/"))
    mark = F.concat(F.lit("/"), c(repository), F.lit("/"))
    at = F.position(mark, p)
    return F.when((F.coalesce(c(repository), F.lit("")) != "") & (at > 0), F.substring(p, at + F.length(mark), F.length(p))).otherwise(p)


def repository_root(path: str | Column, repository: str | Column) -> Column:
    """The part of a path that ends with `/repository`; null where it is absent."""
    mark = F.concat(F.lit("/"), c(repository), F.lit("/"))
    at = F.position(mark, c(path))
    return F.when(at > 0, F.substring(c(path), F.lit(1), at + F.length(c(repository))))


def code_text(name: str | Column, signature: str | Column, docstring: str | Column, snippet: str | Column) -> Column:
    """The text of a code node that is embedded: labelled lines, those without content left out."""
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    return F.concat_ws(
        "\n",
        line("Name: ", c(name)),
        line("Signature: ", c(signature)),
        line("Description: ", F.left(c(docstring), F.lit(500))),
        line("Code: ", F.left(c(snippet), F.lit(1000))),
    )


def truncated(text: str | Column, most: int, mark: str = "") -> Column:
    """The first `most` characters, and `mark` where more follow."""
    return F.when(F.length(c(text)) > most, F.concat(F.left(c(text), F.lit(most)), F.lit(mark))).otherwise(c(text))


def identifiers(query: str | Column) -> Column:
    """Identifiers of a question in order, repeated ones too: camel, Pascal and snake case, else words of three letters on; stop words go."""
    found = F.regexp_extract_all(F.coalesce(c(query), F.lit("")), F.lit(_IDENTIFIER), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(found, lambda x: ~F.array_contains(stop, F.lower(x)))


def qualified_name(query: str | Column) -> Column:
    """The first dotted name of at least three parts in a text, with its #method, without arguments; empty if there is none."""
    return F.trim(F.substring_index(F.regexp_extract(F.coalesce(c(query), F.lit("")), _DOTTED, 0), "(", 1))


def is_qualified(raw: str | Column) -> Column:
    """Whether an input is a qualified name: it has a #, or two dots and no space."""
    x = c(raw)
    dots = F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    return x.contains("#") | ((dots >= 2) & ~x.contains(" "))


def code_references(text: str | Column) -> Column:
    """Names in back ticks outside fenced blocks: identifiers of over two characters, the last part of dotted ones, each once, sorted."""
    bare = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"(?s)```.*?```", "")
    spans = F.regexp_extract_all(bare, F.lit(r"`([^`\n]+)`"), F.lit(1))
    names = F.filter(spans, lambda x: x.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)*$") & (F.length(x) > 2))
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.substring_index(x, ".", -1))))


def business_id(x: str | Column) -> Column:
    """Whether a tenant's id is well formed."""
    return c(x).rlike("^[a-z0-9][a-z0-9_-]{0,63}$")


#: Levels of the characters that underline a title.
_UNDERLINES = {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5}


def sections(docs: DataFrame, kind: str = "markdown", path: str = "path", content: str = "content") -> DataFrame:
    """(path, pos, start_line, level, title, body) of every heading of every document.

    A body is what stands up to the next heading of any level, trimmed. A Markdown heading is one
    to six # and a space, also inside fenced code; what comes before the first one is left out.
    An RST heading is a line and one of a single character of = - ~ ^ " under it, at least as long.
    The lines are an array per document, so a document stays one row and is cut without a shuffle.
    """
    lines = F.split(F.coalesce(F.col(content), F.lit("")), "\n")
    rows = docs.select(F.col(path).alias("path"), lines.alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.get("lines", i + 1).alias("under")))
    if kind == "markdown":
        heads = F.filter(numbered, lambda s: s["line"].rlike(r"^#{1,6}\s+\S"))
        level = lambda s: F.length(F.regexp_extract(s["line"], r"^(#{1,6})", 1))
        title = lambda s: F.trim(F.regexp_extract(s["line"], r"^#{1,6}\s+(.*)$", 1))
        skip = 1
    else:
        marked = lambda s: F.rtrim(s["under"])
        heads = F.filter(numbered, lambda s: s["under"].isNotNull() & (F.trim(s["line"]) != "") & marked(s).rlike(r'^(=+|-+|~+|\^+|"+)$') & (F.length(marked(s)) >= F.length(F.rtrim(s["line"]))))
        by = F.create_map(*(F.lit(x) for pair in _UNDERLINES.items() for x in pair))
        level = lambda s: F.try_element_at(by, F.left(s["under"], F.lit(1)))
        title = lambda s: F.trim(s["line"])
        skip = 2
    rows = rows.withColumn("heads", heads).withColumn("n", F.size("lines"))
    cut = F.transform(
        "heads",
        lambda s, k: F.struct(
            (k + 1).alias("pos"), (s["i"] + 1).alias("start_line"), level(s).cast("int").alias("level"), title(s).alias("title"),
            F.trim(F.regexp_replace(F.array_join(F.slice("lines", s["i"] + 1 + skip, F.greatest(F.lit(0), F.coalesce(F.get("heads", k + 1)["i"], F.col("n")) - s["i"] - skip)), "\n"), r"^\s+|\s+$", "")).alias("body"),
        ),
    )
    return rows.select("path", F.inline(cut))


def section_levels(rows: DataFrame, by: str = "path", order: str = "start_line", title: str = "title") -> DataFrame:
    """`rows` with inferred_level: 2 and one for each dot of a numbered title, else the level of the section before; 1 for the first."""
    number = F.regexp_extract(F.col(title), r"^(\d+(?:\.\d+)*)[.\s]", 1)
    w = Window.partitionBy(by).orderBy(F.col(order).asc_nulls_last(), F.col(title).asc_nulls_last())
    own = F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 2).when(F.row_number().over(w) == 1, 1)
    carried = F.last("_level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_level", own).withColumn("inferred_level", F.coalesce(carried, F.lit(2)).cast("int")).drop("_level")


def outline_levels(rows: DataFrame, files: DataFrame | None = None, by: str = "path", order: str = "start_line", title: str = "title", level: str = "level") -> DataFrame:
    """`rows` with inferred_level of every section of every document.

    A document with any stored level keeps its own. Else the headings of its file decide, where it
    has any among `files` (`by`, content): lines of # at any indent, of equal titles the last;
    a title counts from its last " > " on. Else `section_levels`. What then has no level has 2.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole = Window.partitionBy(by)
    out = section_levels(rows, by, order, title).withColumn("_stored", F.max(F.col(level).isNotNull()).over(whole))
    if files is None:
        inferred = F.col("inferred_level")
    else:
        line = strip(F.col("_line"))
        heads = files.select(F.col(by).alias("_by"), F.posexplode(F.split("content", "\n")).alias("_pos", "_line")).where(line.startswith("#"))
        heads = heads.select("_by", "_pos", F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("_n"), strip(F.regexp_replace(line, r"^#+", "")).alias("_title"))
        of_title = heads.groupBy("_by", "_title").agg(F.max_by("_n", "_pos").alias("_of_title"))
        headed = heads.select(F.col("_by").alias("_headed")).distinct()
        own = F.substring_index(F.coalesce(F.col(title), F.lit("")), " > ", -1)
        out = out.join(headed, F.col(by) == F.col("_headed"), "left").join(of_title, (F.col(by) == F.col("_by")) & (own == F.col("_title")), "left")
        inferred = F.when(F.col("_headed").isNotNull(), F.col("_of_title")).otherwise(F.col("inferred_level"))
    found = F.coalesce(F.when(F.col("_stored"), F.col(level)).otherwise(inferred), F.lit(2)).cast("int")
    return out.withColumn("inferred_level", found).select(*rows.columns, "inferred_level")
