"""What a user calls: questions and changes of one tenant's graph."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import embed, graph, mutate, resolve, search, traverse
from ..schema import EDGE_TYPES, LABELS, as_edges, as_nodes
from ..sources import changes, scan
from . import readonly
from .store import GraphStore, Snapshot


def _within(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}, not {value!r}")
    return value


def _one_of(name: str, value: str, *allowed: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


class Engine:
    """`graph` questions, searches, ingestion, and SQL over the views nodes and edges and one for each label and type."""

    def __init__(self, store: GraphStore, encoder: embed.OnnxEncoder | None = None, dim: int = embed.DIM, query_prefix: str = ""):
        self.store, self.spark, self.encoder, self.dim, self.query_prefix = store, store.spark, encoder, dim, query_prefix

    def encode(self, text: str) -> list[float]:
        return self.encoder.encode([self.query_prefix + text])[0] if self.encoder else embed.hashed(text, self.dim)

    # questions ----------------------------------------------------------------------------

    def ask(self, query_type: str, name: str = "", file: str = "", depth: int = 3, direction: str = "downstream", entity_type: str = "any", sql: str = "") -> DataFrame:
        """The nine kinds of structured question; `inheritance` and `module_deps` are other names of two of them."""
        now = self.store.at()
        n, e = now.nodes(), now.edges()
        _within("depth", depth, 1, 10)
        _one_of("direction", direction, "upstream", "downstream", "parents", "children")
        _one_of("entity_type", entity_type, "any", "function", "class")
        kinds: dict[str, Callable[[], DataFrame]] = {
            "call_chain": lambda: graph.call_chain(n, e, name, depth, direction),
            "inheritance_tree": lambda: graph.inheritance_tree(n, e, name, direction),
            "class_methods": lambda: graph.class_methods(n, e, name),
            "module_dependencies": lambda: graph.module_dependencies(n, e, name),
            "reverse_dependencies": lambda: graph.module_dependencies(n, e, name, reverse=True),
            "find_entity": lambda: graph.find_entity(now.lookup((*graph.CODE, resolve.FQN), [name]), name, entity_type),
            "file_entities": lambda: graph.file_entities(now.lookup((resolve.FILE,), [file]), file),
            "graph_stats": lambda: graph.graph_stats(n, e),
            "raw_sql": lambda: self.sql(sql),
        }
        kinds |= {"inheritance": kinds["inheritance_tree"], "module_deps": kinds["module_dependencies"]}
        if query_type not in kinds:
            raise ValueError(f"unknown query type {query_type!r}; one of {', '.join(sorted(kinds))}")
        return kinds[query_type]()

    def search(self, query: str, k: int = 10, entity_type: str = "all") -> DataFrame:
        """Keyword and vector hits, fused; the type narrows the vector hits only."""
        _one_of("entity_type", entity_type, "all", "function", "class", "document")
        now = self.store.at()
        labels = {"function": ("Function",), "class": ("Class",), "document": ("Document",)}.get(entity_type, ("Function", "Class", "Document"))
        return search.fuse(self._keyword(now, query, _within("k", k, 1, 50)), search.semantic_search(now.nodes(), self.encode, query, k, labels, now.nearest), k)

    def _keyword(self, now: Snapshot, query: str, k: int) -> DataFrame:
        """Hits of the first three identifiers; those that are no qualified names are looked for by the index of names' letters."""
        hits = None
        for word in search.words_of(self.spark, query)[:3] or [query]:
            qualified = "#" in word or word.count(".") >= 2
            rows = search.keyword_search(now.nodes() if qualified else now.holding(word.strip()), now.edges(), word, k)
            hits = rows if hits is None else hits.unionByName(rows)
        first = Window.partitionBy("uid").orderBy(F.desc("score"))
        return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    def keyword(self, query: str, k: int = 10) -> DataFrame:
        """Keyword hits alone, without vectors: of the question's first three identifiers, the best `k`."""
        return self._keyword(self.store.at(), query, _within("k", k, 1, 50)).orderBy(F.desc("score"), "uid").limit(k)

    def hybrid(self, query: str, k: int = 5, expand_depth: int = 2, callers: bool = True, callees: bool = True) -> tuple[DataFrame, DataFrame]:
        now = self.store.at()
        return search.hybrid_search(now.nodes(), now.edges(), self.encode, query, _within("k", k, 1, 20), _within("expand_depth", expand_depth, 1, 5), callers, callees, find=now.nearest)

    def related_to_file(self, file: str) -> DataFrame:
        """Methods of the file's classes and what its functions call."""
        n, e = self.store.snapshot()
        return search.related(n, e, graph.file_entities(n, file), 1, callers=False)

    def document(self, uid: str, folder: str | None = None) -> DataFrame:
        """A document's sections with contents and levels; where no levels are stored, the headings of its file below `folder` decide."""
        n, e = self.store.snapshot()
        row = n.where((F.col("uid") == uid) & F.col("file").isNotNull()).select("file").first() if folder else None
        return graph.document(n, e, uid, scan.named_files(self.spark, folder, [row["file"]]) if row else None)

    def explore(self, name: str, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return graph.explore(*self.store.snapshot(), name, _within("depth", depth, 1, 5), _within("limit", limit, 1, 500))

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Read-only SQL; parameters go through `args`.

        The text is parsed by Spark, and runs only if it is a query over these views whose parts
        and functions are all listed in `readonly`; else it is a ValueError, before anything runs.
        """
        readonly.check(self.spark, text, frozenset(("nodes", "edges", *(x.lower() for x in (*LABELS, *EDGE_TYPES)))))
        n, e = self.store.snapshot()
        n.createOrReplaceTempView("nodes")
        e.createOrReplaceTempView("edges")
        for label in LABELS:
            n.where(F.col("label") == label).createOrReplaceTempView(label.lower())
        for kind in EDGE_TYPES:
            e.where(F.col("type") == kind).createOrReplaceTempView(kind.lower())
        return self.spark.sql(text, args=args or {})

    # ingestion ----------------------------------------------------------------------------

    def _graph(self, sources: DataFrame | None, docs: DataFrame | None, repository: str | None) -> tuple[DataFrame, DataFrame]:
        parts = [scan.code_graph(sources)] if sources is not None else []
        parts += [scan.document_graph(docs)] if docs is not None else []
        # each alone, as rows that are dealt out by uid already are not dealt out again
        parts = [(embed.embed(n, self.encoder, dim=self.dim), e) for n, e in parts]
        nodes, edges = parts[0]
        for n, e in parts[1:]:
            nodes, edges = nodes.unionByName(n), edges.unionByName(e)
        if repository:
            nodes = nodes.withColumn("repository", F.lit(repository))
        return nodes, edges

    def index_full(self, folder: str, repository: str | None = None) -> dict[str, int]:
        """Scan, parse, embed, write with all edges resolved, documents included; returns what was indexed."""
        return self._ingest(*self._graph(scan.files(self.spark, folder), scan.files(self.spark, folder, documents=True), repository))

    def _ingest(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> dict[str, int]:
        """Write what was made, once, counting it on the way, and commit it; returns nodes by label, vectors, files, edges within files, and edges across them by type."""
        labels = [F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS]
        seen, linked = traverse.Counts(*labels, F.count("embedding").alias("vectors")), traverse.Counts(F.count(F.lit(1)).alias("edges"))
        nodes, edges = traverse.together(lambda: traverse.cut(seen.of(as_nodes(nodes))), lambda: traverse.cut(linked.of(as_edges(edges))))
        resolved = self.store.ingest(nodes, edges, files, whole=True)
        self.store.compact_if_due()
        counts = {k: v for k, v in seen.get(nodes).items() if v or k == "vectors"}
        return counts | {"files": nodes.select(F.coalesce("file", "path").alias("f")).where("f is not null").distinct().count(), "edges": linked.get(edges)["edges"]} | resolved

    def index_files(self, rows: list[tuple[str, str]], repository: str | None = None) -> dict[str, int]:
        """Replace what is known of files by their given contents; returns what was indexed."""
        given = scan.payload(self.spark, rows)
        return self.apply(given.withColumn("status", F.lit("M")), repository)

    def apply(self, changed: DataFrame, repository: str | None = None) -> dict[str, int]:
        """(path, status, content): delete what D, M and A name, add anew what has content, then resolve. Replay changes nothing."""
        changed = traverse.cut(changed)
        there = changed.where("status <> 'D' and content is not null").select("path", "content")
        return self._ingest(*self._graph(there, there.where(_document()), repository), files=changed.select(F.col("path").alias("file")))

    def index_incremental(self, folder: str, base: str = "HEAD~1", head: str = "HEAD", repository: str | None = None) -> dict[str, int]:
        """Apply a git difference; returns how many files were added, modified and deleted. Only the files that it names are read."""
        feed = changes.git_changes(self.spark, folder, base, head).unionByName(changes.git_changes(self.spark, folder, base, head, documents=True))
        feed = traverse.cut(feed)
        there = [r["path"] for r in feed.where("status <> 'D'").select("path").distinct().collect()]
        self.apply(feed.join(scan.named_files(self.spark, folder, there), "path", "left"), repository)
        return changes.status_counts(feed).first().asDict()

    def sync(self, folder: str, repository: str) -> dict[str, int] | None:
        """Pull and apply what came; None if nothing did."""
        if not changes.git_pull(folder):
            return None
        return self.index_incremental(folder, "ORIG_HEAD", "HEAD", repository)

    def sync_all(self, repositories: dict[str, str]) -> dict[str, dict[str, int] | str | None]:
        """`sync` of all (name, folder); of a repository that fails the error stands for its counts, and the others go on."""
        out: dict[str, dict[str, int] | str | None] = {}
        for name, folder in repositories.items():
            try:
                out[name] = self.sync(folder, name)
            except (OSError, ValueError, subprocess.SubprocessError) as error:
                out[name] = str(error)
        return out


def _document():
    return X.is_document("path")
