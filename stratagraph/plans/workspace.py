"""A workspace: repositories indexed into versioned tables, one revision at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..operators import derive, embedding, graph, incremental, index, manifest, search, temporal
from ..operators.versioned import Change, Spec, VersionedTables
from ..sources import parsers, readers

TABLES = {
    "repositories": Spec("repo string, folder string", ("repo",), "repo", 1),
    "manifest": Spec("repo string, path string, blob_hash string, size long, modified timestamp, lang string", ("repo", "path"), "path"),
    "observations": Spec(f"repo string, {parsers.OBSERVATIONS}", ("repo", "path"), "path"),
    "builds": Spec(f"repo string, {parsers.BUILD}", ("repo", "path"), "path"),
    "supports": Spec("repo string, path string, stable_key string, state string", ("repo", "path"), "path"),
    "counts": Spec("repo string, stable_key string, n long", ("repo", "stable_key"), "stable_key"),
    "facts": Spec("repo string, stable_key string, state string", ("repo", "stable_key"), "stable_key"),
    "renames": Spec("repo string, old_path string, new_path string, exact boolean", ("repo", "new_path"), "new_path"),
    "contents": Spec("blob_hash string, text string", ("blob_hash",), "blob_hash"),
    "windows": Spec("blob_hash string, ordinal int, start_line int, body string, split string", ("blob_hash",), "blob_hash"),
    "postings": Spec("term string, blob_hash string, ordinal int, tf double, length int, bucket int", ("term", "blob_hash"), "bucket", index.TERM_BUCKETS),
    "chunks": Spec("blob_hash string, ordinal int, start_line int, end_line int, decl_key string, context string", ("blob_hash",), "blob_hash"),
    "vectors": Spec("blob_hash string, ordinal int, model string, embedding array<float>", ("blob_hash", "model"), "blob_hash"),
    "stats": Spec("n long, terms long", ("n",), "n", 1),
}
#: Rows are looked up by up to so many paths, keys or hashes by name; beyond, the tables are joined whole.
FEW = 500
#: Supports that an enrichment makes stand under paths with these beginnings, which no file has.
OWNERS, REFERENCES = "@owners/", "@references/"
_EDGE = "edge"


class Workspace:
    """Tables under a folder that all executors see (see versioned.VersionedTables). A revision is one commit of all tables: what failed or lost
    against another writer leaves the workspace as it was.

    Indexing is scoped: of files whose size and time are those of the manifest nothing is read; changed ones are parsed, and only the facts that changed
    paths support are derived again (see incremental). Every fact knows the paths that support it.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: tuple[str, Callable[[Column], Column]] | None = None):
        """embedder: the name and revision of a model, which vectors are kept with, and the column function that embeds texts and queries alike."""
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.tables = VersionedTables(spark, self.root, TABLES)

    def revision(self) -> int:
        return self.tables.revision()

    def _current(self, name: str, repo: str | None = None, keys: list | None = None, at: dict | None = None) -> DataFrame:
        rows = self.tables.current(name, keys, at).drop("valid_to")
        return rows if repo is None else rows.where(F.col("repo") == repo)

    @staticmethod
    def _few(rows: DataFrame, column: str) -> list | None:
        """The distinct values of a column if they are few, else None."""
        found = [r[0] for r in rows.select(column).distinct().limit(FEW + 1).collect()]
        return found if len(found) <= FEW else None

    def _staged(self, rows: DataFrame, held: list[str]) -> DataFrame:
        """rows as a table of their own for the time of a commit: computed once, in a folder that all executors see, with a short plan."""
        held.append(f"staged/{uuid.uuid4().hex}")
        at = f"{self.root}/{held[-1]}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _drop(self, held: list[str]) -> None:
        for name in held:
            self.tables.delete(name)

    def _facts(self, repo: str, files: DataFrame, seen: DataFrame, build: DataFrame, all_build: DataFrame, paths: DataFrame) -> DataFrame:
        return incremental.supports(repo, files, seen, build, all_build, paths)

    def index(self, repo: str, folder: str) -> int:
        """Take a snapshot of a folder; if the manifest changed, commit a revision. The workspace's revision afterwards.

        Facts that no file supports any more are retracted, folders without files too. A file that changes without a change of its size and time is not seen.
        """
        at, held = self.tables.head(), []
        try:
            return self._indexed(repo, folder, at, held)
        finally:
            self._drop(held)

    def _indexed(self, repo: str, folder: str, at: dict, held: list[str]) -> int:
        listing = self._staged(readers.source_listing(self.spark, folder), held)
        old = self._current("manifest", repo, at=at)
        same = ["path", "size", "modified"]
        touched = listing.join(old.select(*same), same, "left_anti")
        gone = old.select("path").join(listing, "path", "left_anti")
        names = self._few(touched, "file")
        plain = names is not None and not any(c in n for n in names for c in "{}[]*?\\")
        files = readers.source_tree(self.spark, folder, names) if plain and names else readers.source_tree(self.spark, folder)
        files = self._staged(files.join(touched.select("path", "modified"), "path"), held)
        before = old.join(touched.select("path").unionByName(gone), "path", "left_semi")
        diff = self._staged(manifest.manifest_diff(before, files), held)
        return at["revision"] if diff.isEmpty() else self._commit_files(repo, at, listing, files, diff, before, held)

    def _commit_files(self, repo: str, at: dict, listing: DataFrame, files: DataFrame, diff: DataFrame, before: DataFrame, held: list[str]) -> int:
        r = at["revision"] + 1
        since, mine = F.lit(r).cast("long").alias("valid_from"), F.lit(repo).alias("repo")
        new = files.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi")
        seen = self._staged(parsers.extract(new), held)
        built = self._staged(parsers.build_observations(new.where("text is not null")), held)
        left = before.join(diff.where("change <> 'added'").select("path"), "path", "left_semi").select("repo", "path", "valid_from", F.lit(r).cast("long").alias("valid_to"))
        old_build = self._current("builds", repo, at=at).drop("repo", "valid_from")
        all_build = old_build.join(diff.select("path"), "path", "left_anti").select(*built.columns).unionByName(built)
        dirty = self._staged(incremental.dirty_paths(diff, old_build.select(*built.columns).unionByName(built)), held)
        keys = self._few(dirty, "path")
        supported = self._staged(self._current("supports", repo, keys, at).join(dirty, "path", "left_semi"), held)
        other = self._current("observations", repo, keys, at).join(dirty, "path", "left_semi").join(diff.select("path"), "path", "left_anti")
        dirty_files = listing.select("path", "lang").join(dirty, "path", "left_semi")
        after = self._staged(self._facts(repo, dirty_files, other.select(*seen.columns).unionByName(seen), all_build.join(dirty, "path", "left_semi"), all_build, listing.select("path")), held)
        hashes = self._few(new, "blob_hash")
        known = self._current("contents", keys=hashes, at=at).select("blob_hash")
        renamed = manifest.renames(diff)
        changes = {
            "manifest": Change(new.select(mine, "path", "blob_hash", "size", "modified", "lang", since), left),
            "observations": Change(seen.select(mine, *seen.columns, since), left),
            "builds": Change(built.select(mine, *built.columns, since), left),
            "contents": Change(readers.blobs(new.where("text is not null")).select("blob_hash", "text", since).join(known, "blob_hash", "left_anti")),
            "renames": Change(renamed.select(mine, "old_path", "new_path", "exact", since)),
        }
        return self._commit_supports(repo, at, supported, after, changes, held)

    def _commit_supports(self, repo: str, at: dict, before: DataFrame, after: DataFrame, changes: dict[str, Change], held: list[str]) -> int:
        """Commit changes, with what supports (path, stable_key, state) of dirty paths before and after mean for the facts."""
        r = at["revision"] + 1
        since, until, mine = F.lit(r).cast("long").alias("valid_from"), F.lit(r).cast("long").alias("valid_to"), F.lit(repo).alias("repo")
        moved = self._staged(incremental.support_changes(before, after), held)
        keys = self._few(moved, "stable_key")
        counts, facts = (self._current(name, repo, keys, at) for name in ("counts", "facts"))
        found = self._staged(incremental.fact_changes(moved, counts, facts), held)
        other = found.where("not (state <=> old_state)")
        n_moved = found.where("not (n <=> coalesce(old_n, 0))")
        closing = lambda table, rows: table.join(rows.select("stable_key"), "stable_key", "left_semi").select("repo", "stable_key", "valid_from", until)
        changes = changes | {
            "supports": Change(after.select(mine, "path", "stable_key", "state", since), before.select("repo", "path", "valid_from", until).distinct()),
            "counts": Change(n_moved.where("n > 0").select(mine, "stable_key", "n", since), closing(counts, n_moved)),
            "facts": Change(other.where("state is not null").select(mine, "stable_key", "state", since), closing(facts, other)),
        }
        revision = self.tables.commit(at, changes)["revision"]
        self.tidy()
        return revision

    def tidy(self) -> list[str]:
        """Fold the deltas of tables that are due; their names."""
        due = [name for name in TABLES if self.tables.due(name)]
        for name in due:
            self.tables.compact(name)
        return due

    # ---- enrichments: facts from other sources than the files' contents

    def _enrich(self, repo: str, prefix: str, wanted: DataFrame) -> int:
        """Make the supports under a prefix those wanted (path, stable_key, state): a path without a difference is not written. The revision afterwards."""
        at, held = self.tables.head(), []
        try:
            wanted = self._staged(wanted, held)
            stored = self._staged(self._current("supports", repo, at=at).where(F.col("path").startswith(prefix)), held)
            plain = stored.select("path", "stable_key", "state")
            differ = self._staged(plain.exceptAll(wanted).unionByName(wanted.exceptAll(plain)).select("path").distinct(), held)
            if differ.isEmpty():
                return at["revision"]
            return self._commit_supports(repo, at, stored.join(differ, "path", "left_semi"), wanted.join(differ, "path", "left_semi"), {}, held)
        finally:
            self._drop(held)

    def enrich_ownership(self, repo: str, touches: DataFrame, least_share: float = 0.6) -> int:
        """People, authoredBy and ownedBy edges of the current files from commits (path, person, name, at). Of an earlier run only what is stale is retracted."""
        files = self._current("manifest", repo).select("path")
        touches = touches.join(files, "path", "left_semi")
        names = touches.groupBy("person").agg(F.max_by("name", F.struct("at", "name")).alias("name"))
        authors = derive.authorship(touches).drop("name").join(names, "person")
        owners = derive.dominant_owners(authors, least_share)
        file, person = model.file_key(F.lit(repo), F.col("path")), model.person_key(F.col("person"))
        at = F.concat(F.lit(OWNERS), "path").alias("path")
        edge = lambda rows, kind: rows.select(at, F.concat_ws("|", F.lit(kind), file, person).alias("stable_key"), F.lit(_EDGE).alias("state"))
        people = authors.select(at, person.alias("stable_key"), F.concat_ws("|", F.lit("person"), "name").alias("state"))
        return self._enrich(repo, OWNERS, people.unionByName(edge(authors, "authoredBy")).unionByName(edge(owners, "ownedBy")).distinct())

    def enrich_references(self, repo: str, occurrences: DataFrame) -> int:
        """references between files and refersToSymbol between declarations from a compiler's exported occurrences (usr, name, path, line, column, role)."""
        held: list[str] = []
        found = self._staged(readers.compiler_references(occurrences).withColumn("point_id", F.monotonically_increasing_id()), held)
        seen = self._current("observations", repo).where("kind = 'declaration'").join(self._current("manifest", repo).select("path", "lang"), "path")
        key = model.decl_key(F.col("lang"), F.lit(repo), F.col("path"), F.col("decl_path"))
        spans = seen.select("path", "start", "end", F.lit(0).alias("rank"), key.alias("key"))
        inner = lambda path, line: derive.innermost(found.select(F.col(path).alias("path"), F.col(line).alias("line"), "point_id"), spans).select("point_id", "key")
        placed = found.join(inner("from_path", "line").withColumnRenamed("key", "from_key"), "point_id", "left").join(inner("to_path", "def_line").withColumnRenamed("key", "to_key"), "point_id", "left")
        here = self._current("manifest", repo).select("path")
        placed = placed.join(here.withColumnRenamed("path", "from_path"), "from_path", "left_semi").join(here.withColumnRenamed("path", "to_path"), "to_path", "left_semi")
        at = F.concat(F.lit(REFERENCES), "from_path").alias("path")
        state = lambda refs, calls: F.concat_ws(" ", F.lit(_EDGE), refs, calls).alias("state")
        files = placed.groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("refs"), F.count_if("is_call").alias("calls"))
        files = files.select(at, F.concat_ws("|", F.lit("references"), model.file_key(F.lit(repo), F.col("from_path")), model.file_key(F.lit(repo), F.col("to_path"))).alias("stable_key"), state("refs", "calls"))
        pairs = derive.symbol_pairs(placed)
        of = placed.select("from_key", "from_path").distinct()
        pairs = pairs.join(of, "from_key").select(at, F.concat_ws("|", F.lit("refersToSymbol"), "from_key", "to_key").alias("stable_key"), state("reference_count", "call_count"))
        try:
            return self._enrich(repo, REFERENCES, files.unionByName(pairs))
        finally:
            self._drop(held)

    def why(self, key: str) -> DataFrame:
        """repo, path, since: the files (or, under a prefix, the enrichments of a file) that support a fact now, and from which revision on they say it."""
        return self._current("supports").where(F.col("stable_key") == key).select("repo", "path", F.col("valid_from").alias("since"))

    def origins(self, repo: str) -> DataFrame:
        """old_path, new_path, exact, revision of the renames that indexing saw."""
        return self._current("renames", repo).select("old_path", "new_path", "exact", F.col("valid_from").alias("revision"))

    # ---- repositories and facts

    def register(self, repo: str, folder: str) -> None:
        """Name a repository's folder; the newest name counts."""
        at = self.tables.head()
        r = at["revision"]
        old = self._current("repositories", repo, at=at).select("repo", "valid_from", F.lit(r).cast("long").alias("valid_to"))
        row = self.spark.createDataFrame([(repo, folder, at["seq"] + 1)], "repo string, folder string, valid_from long")
        self.tables.commit(at, {"repositories": Change(row, old)}, r)

    def registered(self) -> DataFrame:
        """repo, folder of the registered repositories."""
        return self._current("repositories").groupBy("repo").agg(F.max_by("folder", "valid_from").alias("folder"))

    def versions(self) -> DataFrame:
        """All versions of all facts."""
        return self.tables.rows("facts")

    def facts(self, revision: int | None = None) -> DataFrame:
        return temporal.as_of(self.versions(), revision)

    def verify(self, repo: str, folder: str) -> DataFrame:
        """What a rebuild from scratch would say differently: fact, problem. Enrichments are left out: their sources are not in the folder."""
        files = readers.source_tree(self.spark, folder)
        build = parsers.build_observations(files.where("text is not null"))
        rebuilt = incremental.facts(incremental.supports(repo, files.select("path", "lang"), parsers.extract(files), build, build, files.select("path")))
        added = self._current("supports", repo).where(F.col("path").startswith("@")).select("stable_key").distinct()
        stored = self.facts().where(F.col("repo") == repo).join(added, "stable_key", "left_anti")
        line = F.concat_ws("=", "stable_key", "state").alias("fact")
        return manifest.verify(rebuilt.select(line), stored.select(line))

    # ---- what was indexed, as the tables that lookups, tools and search read

    def files(self, repo: str | None = None) -> DataFrame:
        """repo, path, blob_hash, text of the current manifest."""
        m = self._current("manifest", repo)
        return m.join(self.contents(), "blob_hash", "left").select("repo", "path", "blob_hash", "text")

    def contents(self) -> DataFrame:
        return self._current("contents").drop("valid_from")

    def entities(self, revision: int | None = None) -> DataFrame:
        """node, key, kind, name, repo, path, line, decl_path of the entities at a revision; lines are those of the newest observation."""
        state = F.split("state", r"\|", 2)
        e = self.facts(revision).where("state like '%|%'").select(F.xxhash64("stable_key").alias("node"), F.col("stable_key").alias("key"), state[0].alias("kind"), state[1].alias("name"), "repo")
        inner = F.expr("substr(key, locate(concat(repo, '/'), key) + length(repo) + 1)")
        placed = e.withColumn("path", F.when(F.col("kind").isin("file", "directory", "buildTarget", *model.DEFINITION_KINDS), F.substring_index(inner, "#", 1)))
        placed = placed.withColumn("decl_path", F.when(F.col("kind").isin(*model.DEFINITION_KINDS), F.expr("substr(key, locate('#', key) + 1)")))
        seen = self._current("observations").where("kind = 'declaration'").groupBy("repo", "path", "decl_path").agg(F.min("start").alias("line"))
        return placed.join(seen, ["repo", "path", "decl_path"], "left").select("node", "key", "kind", "name", "repo", "path", "line", "decl_path")

    def edges(self, revision: int | None = None) -> DataFrame:
        """id, kind, src, dst, refs, calls of the edges at a revision (references of the compiler have numbers, others have none)."""
        ends, said = F.split("stable_key", r"\|"), F.split("state", " ")
        number = lambda i: F.get(said, F.lit(i)).cast("int")
        return self.facts(revision).where(_is_edge()).select(F.xxhash64("stable_key").alias("id"), ends[0].alias("kind"), F.xxhash64(ends[1]).alias("src"), F.xxhash64(ends[2]).alias("dst"), number(1).alias("refs"), number(2).alias("calls"))

    def ranks(self, repo: str | None, focus: list[str] | None = None) -> DataFrame:
        """path, rank of a repository's (or all) files by PageRank over references, imports and builds between them, drawn to the files of the focus names."""
        here = F.lit(True) if repo is None else F.col("repo") == repo
        files = self.entities().where(here & (F.col("kind") == "file")).select("node", "path")
        weight = F.when(F.col("kind") == "references", F.coalesce("refs", F.lit(1))).when(F.col("kind") == "builds", 2).otherwise(1)
        e = graph.edges_among(self.edges().where("kind in ('references', 'imports', 'builds')").select("src", "dst", weight.cast("double").alias("weight")), files)
        seeds = None
        for name in focus or []:
            found = search.name_search(self.entities().where(here), name, 3, list(model.DEFINITION_KINDS)).select("path").join(files, "path").select("node")
            seeds = found if seeds is None else seeds.unionByName(found)
        return files.join(graph.pagerank(files, graph.settled(e), seeds=seeds), "node").select("path", "rank")

    def build_index(self) -> int:
        """Windows, postings and statistics of contents that the index does not hold, in one commit. How many windows it wrote."""
        at = self.tables.head()
        since = F.lit(at["revision"]).cast("long").alias("valid_from")
        held: list[str] = []
        try:
            windows = self._staged(index.new_windows(self.contents(), self._current("windows", at=at).select("blob_hash")), held)
            new = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.terms(F.col("body"))) + F.size(T.terms(F.col("split")))).alias("terms")).first()
            if new.n:
                stats = self.spark.createDataFrame([(new.n, new.terms)], "n long, terms long")
                self.tables.commit(at, {"windows": Change(windows.select("*", since)), "postings": Change(index.postings(windows).select("*", since)), "stats": Change(stats.select("*", since))}, at["revision"])
                self.tidy()
            if self.embedder:
                self._build_vectors(held)
            return new.n
        finally:
            self._drop(held)

    def learn(self) -> str:
        """Train an embedder on the indexed windows of all contents, keep its model under its name, and embed with it from here on. The name."""
        windows = self._current("windows")
        model = embedding.train(windows.select(F.concat_ws(":", "blob_hash", "ordinal").alias("key"), F.col("body").alias("text")))
        name = embedding.identity(model)
        model.write.mode("overwrite").parquet(f"{self.root}/models/{name}")  # the name is a digest of the rows, so it is written with the same ones again
        self.embedder = (name, embedding.column(model))
        return name

    def use(self, name: str) -> None:
        """Embed with a model that learn() kept."""
        self.embedder = (name, embedding.column(self.spark.read.schema(embedding.MODEL).parquet(f"{self.root}/models/{name}")))

    def _build_vectors(self, held: list[str]) -> None:
        """Chunks of contents that have none, and vectors of chunks that the model has not embedded, in one commit."""
        model_name, embed = self.embedder
        at = self.tables.head()
        since = F.lit(at["revision"]).cast("long").alias("valid_from")
        place = self._current("manifest", at=at).select("repo", "path", "blob_hash", "lang")
        seen = self._current("observations", at=at).join(place.select("repo", "path", "lang"), ["repo", "path"])
        key = model.decl_key(F.col("lang"), F.col("repo"), F.col("path"), F.col("decl_path"))
        named = place.groupBy("blob_hash").agg(F.min(F.struct("path", "repo")).alias("p")).select("blob_hash", "p.path", "p.repo")  # a blob's first place names it
        seen = seen.join(named.select("repo", "path"), ["repo", "path"], "left_semi")
        decls = seen.where("kind = 'declaration'").select("blob_hash", key.alias("key"), "start", "end")
        uses = seen.where("kind = 'importStatement'").select("blob_hash", F.col("name").alias("module")).distinct()
        old = self._current("chunks", at=at).drop("valid_from")
        contents = self.contents().join(named.select("blob_hash"), "blob_hash", "left_semi")
        fresh = self._staged(index.new_chunks(contents, decls, named.select("path", "blob_hash"), uses, old, self.root.rsplit("/", 1)[-1]), held)
        done = self._current("vectors", at=at).where(F.col("model") == model_name).select("blob_hash", "ordinal")
        bodies = index.chunk_bodies(old.select(*fresh.columns).unionByName(fresh).join(done, ["blob_hash", "ordinal"], "left_anti"), contents)
        vectors = self._staged(index.embedded(bodies, embed, model_name), held)
        if not vectors.isEmpty():
            self.tables.commit(at, {"chunks": Change(fresh.select("*", since)), "vectors": Change(vectors.select("*", since))}, at["revision"])
            self.tidy()

    def boosts(self, focus: list[str], repo: str | None = None) -> DataFrame:
        """path, boost of files next to those that declare the focus names, and of central ones."""
        e = self.entities()
        e = e if repo is None else e.where(F.col("repo") == repo)
        named = [search.name_search(e, name, 3, list(model.DEFINITION_KINDS)).select("path") for name in focus]
        found = named[0]
        for n in named[1:]:
            found = found.unionByName(n)
        files = e.where("kind = 'file'").select("node", "path")
        between = graph.edges_among(self.edges().select("src", "dst"), files)
        between = between.join(files.withColumnsRenamed({"node": "src", "path": "a"}), "src").join(files.withColumnsRenamed({"node": "dst", "path": "b"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        return search.adjacency_boost(between, found.distinct(), self.ranks(repo, focus))

    def find(self, query: str, limit: int = 10, repo: str | None = None, prefix: str | None = None, mode: str = "hybrid", focus: list[str] | None = None) -> tuple[DataFrame, str, str | None]:
        """(hits, mode used, note): rank, repo, path, line, score, snippet, resolution by words, meaning or both; without an embedder words answer, and the note says
        so. With focus names, findings near them or central in the graph move up where both lists are fused."""
        at, semantic_hits = self.tables.head(), None
        if self.embedder and mode != "lexical":
            name, embed = self.embedder
            asked = [float(x) for x in self.spark.range(1).select(F.lit(query).alias("q")).select(embed(F.col("q")).alias("v")).first().v]
            place = self._current("manifest", at=at).select("repo", "path", "blob_hash")
            vectors, chunks = self._current("vectors", at=at), self._current("chunks", at=at)
            semantic_hits = lambda n: index.semantic(vectors, chunks, place, self.contents(), name, asked, n, repo)
        boost = self.boosts(focus, repo) if focus and semantic_hits is not None and mode == "hybrid" else None
        hits, used, note = index.hybrid(lambda n: self.search(query, n, repo, prefix), semantic_hits, mode, limit, prefix, boost)
        if used != "hybrid":
            return hits, used, note
        where = F.split("at", ":", 2)
        hits = hits.select("rank", where[0].alias("repo"), where[1].alias("path"), F.col("line").cast("int").alias("line"), "score", "resolution")
        lines = T.lines(F.col("text"))
        shown = hits.join(self.files(repo).select("repo", "path", "text"), ["repo", "path"]).withColumn("snippet", T.snippet(lines, F.col("line")))
        return shown.select("rank", "repo", "path", "line", "score", "snippet", "resolution"), used, note

    def search(self, query: str, limit: int = 10, repo: str | None = None, prefix: str | None = None) -> DataFrame:
        """Lexical hits of a query over the current files. Of the postings the buckets of the query's terms are read, of texts those of the hits."""
        at = self.tables.head()
        terms = self.spark.range(1).select(F.explode(T.query_terms(F.lit(query))).alias("t")).toPandas()["t"].tolist() or [""]
        posts = self._current("postings", keys=index.term_buckets(terms), at=at)
        stats = self._current("stats", at=at).agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("average"))
        return index.lexical(self._current("windows", at=at), posts, stats, self._current("manifest", at=at).select("repo", "path", "blob_hash"), terms, limit, repo, prefix)

    def status(self) -> DataFrame:
        """repo, files, declarations, modules, compiled (whether compiled references are there): counts of the current facts."""
        kind = F.substring_index("state", "|", 1)
        f = self.facts()
        compiled = F.max(_is_edge() & F.col("stable_key").startswith("refersToSymbol|"))
        return f.groupBy("repo").agg(F.count_if(kind == "file").alias("files"), F.count_if(kind.isin(*model.DEFINITION_KINDS)).alias("declarations"), F.count_if(kind == "module").alias("modules"), compiled.alias("compiled"))


def _is_edge() -> Column:
    return F.col("state").rlike(f"^{_EDGE}( |$)")
