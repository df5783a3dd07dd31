"""Selections of symbols, files and diagnostics by project, kind, scope and change; all are column predicates or equi-joins.

Symbols are (id, kind, name, project, file, line); projects are (path, name, is_test). Paths compare in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import is_within
from cairn.operators import graph
from cairn.session import staged

#: Rows of a side in one cell of a shared key, pairs in one task, about, and the most tasks of one join.
CELL, TASK, MOST_TASKS = 1024, 4 << 20, 50_000
TYPE_KINDS = ["class", "record", "struct", "interface", "enum"]


def with_project(symbols: DataFrame, projects: DataFrame) -> DataFrame:
    """symbols with project_name and is_test; a symbol whose project is unknown keeps its row and counts as no test."""
    side = projects.select(F.lower("path").alias("__p"), F.col("name").alias("project_name"), "is_test")
    return symbols.join(side, F.lower("project") == F.col("__p"), "left").drop("__p").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def production_only(symbols: DataFrame) -> DataFrame:
    """Rows of with_project() outside test projects."""
    return symbols.where(~F.col("is_test"))


def in_project(wanted: str) -> Column:
    """Whether a row of with_project() has a project whose path or name contains the wanted text."""
    low = F.lit(wanted.lower())
    return F.contains(F.lower("project"), low) | F.coalesce(F.contains(F.lower("project_name"), low), F.lit(False))


def of_kind(kinds: list[str]) -> Column:
    """Whether kind is one of kinds, in any case; no kinds select everything."""
    return F.lower("kind").isin([k.lower() for k in kinds]) if kinds else F.lit(True)


def unknown_kinds(asked: list[str], known: list[str]) -> list[str]:
    """The kinds asked for that no index can have, once each, in order: they are a gap, not an empty answer."""
    have = {k.lower() for k in known}
    return sorted({k.lower() for k in asked} - have)


def in_files(df: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """Rows whose file is one of files (path)."""
    side = files.select(F.lower("path").alias("__f")).distinct()
    return df.join(side, F.lower(column) == F.col("__f"), "left_semi")


def scope_for(scope: str, purpose: str) -> str:
    """The scope to use: automatic is what changed where the purpose is a change, else the whole repository."""
    return scope if scope != "automatic" else "changed" if purpose == "change" else "full"


def scope_files(owned: DataFrame, scope: str, target: str | None = None, changed: DataFrame | None = None) -> DataFrame:
    """The files (project, path) of a scope over owned files (project, project_name, path).

    full: all; changed: those in changed (path), owned or not; project: of the projects with that name or path; path: the file or
    everything below it.
    """
    if scope == "full":
        return owned.select("project", "path").distinct()
    if scope == "changed":
        own = owned.select(F.lower("path").alias("__f"), "project")
        return changed.select("path").distinct().join(own, F.lower("path") == F.col("__f"), "left").select("project", "path").distinct()
    if not (target or "").strip():
        raise ValueError(f"scope {scope} needs a target")
    low = target.replace("\\", "/").strip("/").lower()
    found = (F.lower("project_name") == target.lower()) | (F.lower("project") == low) if scope == "project" else is_within(F.col("path"), F.lit(low))
    return owned.where(found).select("project", "path").distinct()


def diagnostics_in_scope(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics without a file, and those in files (path); all of them if there are no files."""
    if not files.take(1):
        return diagnostics
    side = files.select(F.lower("path").alias("__f"), F.lit(True).alias("__in")).distinct()
    return diagnostics.join(side, F.lower("file") == F.col("__f"), "left").where(F.col("file").isNull() | F.col("__in")).drop("__f", "__in")


def select_symbols(symbols: DataFrame, files: DataFrame | None, projects: DataFrame | None, types_only: bool, most: int) -> DataFrame:
    """The first `most` symbols by file, line and id that stand in files (path), or without files in projects (path)."""
    found = in_files(symbols, files) if files is not None else in_files(symbols, projects, "project")
    return (found.where(F.col("kind").isin(TYPE_KINDS)) if types_only else found).orderBy("file", "line", "id").limit(most)


def select_types(types: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """The first `most` types (id, declarations: array of file and line) with any declaration in files, by their first declaration."""
    spread = types.select("id", F.explode("declarations").alias("d")).select("id", F.col("d.file").alias("file"))
    hit = in_files(spread, files).select("id").distinct()
    first = F.get("declarations", F.lit(0))
    return types.join(hit, "id", "left_semi").orderBy(first["file"], first["line"], "id").limit(most)


def block_edges(edges: DataFrame, blocks: DataFrame, most: int = 40) -> DataFrame:
    """Distinct edges between chosen blocks (block, symbol): source_block, target_block, relationship; the first `most` in order."""
    side = lambda end: blocks.where("symbol is not null").select(F.col("symbol").alias(end), F.col("block").alias(f"{end}_block"))
    found = edges.join(F.broadcast(side("source")), "source").join(F.broadcast(side("target")), "target")  # chosen blocks are a page of results
    return found.select("source_block", "target_block", "relationship").distinct().orderBy("source_block", "target_block", "relationship").limit(most)


def method_owners(methods: DataFrame, symbols: DataFrame) -> DataFrame:
    """methods (file, line, name, owner_line) with the ids of their own symbol and of the type declared at owner_line."""
    own = symbols.where(F.col("kind").isin("method", "test")).groupBy("file", "line", "name").agg(F.min("id").alias("symbol"))
    types = symbols.where(F.col("kind").isin(TYPE_KINDS)).groupBy("file", F.col("line").alias("owner_line")).agg(F.min("id").alias("owner"))
    return methods.join(own, ["file", "line", "name"]).join(types, ["file", "owner_line"])


def project_counts(projects: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row: projects, production, tests, the distinct frameworks in order (a small closed set), and errors and warnings of diagnostics (severity)."""
    counts = projects.agg(
        F.count("*").alias("projects"), F.count_if(~F.col("is_test")).alias("production"), F.count_if("is_test").alias("tests"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))), ", ").alias("frameworks"),
    )
    if diagnostics is None:
        return counts
    found = diagnostics.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one").drop("one")  # two rows


def dependency_keys(dependencies: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct (source, relationship, key, whole) of dependencies (symbol, related, relationship) of these kinds: what a display string may
    name a type by. Keys are the string and what stands behind each of its dots, and once more the whole string."""
    bare = F.replace("related", F.lit("global::"), F.lit(""))
    parts = F.split(bare, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, n, F.size(parts)), ".").alias("key"), F.lit(False).alias("whole")))
    keys = F.concat(tails, F.array(F.struct(bare.alias("key"), F.lit(True).alias("whole"))))
    return dependencies.where(F.col("relationship").isin(kinds)).select(F.col("symbol").alias("source"), "relationship", F.inline(keys)).distinct()


def type_keys(types: DataFrame) -> DataFrame:
    """Distinct (target, key, whole, many) of types (id, name, semantic_name): the name, and the semantic name as a whole where it does not
    end in the name, which finds it then. many: the type has several keys."""
    ends = F.coalesce((F.col("semantic_name") == F.col("name")) | F.endswith("semantic_name", F.concat(F.lit("."), F.col("name"))), F.lit(False))
    names = types.select(F.col("id").alias("target"), F.col("name").alias("key"), F.lit(False).alias("whole"))
    names = names.union(types.where(~ends).select("id", "semantic_name", F.lit(True))).where("target is not null and key is not null")
    spread = names.groupBy("target").agg(F.min(F.struct("key", "whole")).alias("first"), F.max(F.struct("key", "whole")).alias("last"))
    one = spread.where("first = last").select("target", "first.key", "first.whole", F.lit(False).alias("many"))
    return one.union(names.join(spread.where("first <> last"), "target", "left_semi").distinct().withColumn("many", F.lit(True)))


def key_pairs(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (source, target, relationship) of dependency_keys() and type_keys() that share a key; both should be staged, they are read more than once.

    A key's pairs are cut into cells of some CELL rows by CELL rows, and a task gets some TASK pairs, whatever share of the rows
    has the key. A type of one key gives a pair once, so only pairs of types with many keys are compared with each other.
    """
    on = ["key", "whole"]
    sizes = staged(asked.groupBy(*on).agg(F.count("*").alias("n")).join(names.groupBy(*on).agg(F.count("*").alias("m")), on), "sizes")
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = min(int(total // TASK) + 1, MOST_TASKS)
    sizes = sizes.select(*on, F.ceil(F.col("n") / CELL).alias("n"), F.ceil(F.col("m") / CELL).alias("m"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = [*on, "i", "j"]
    left = asked.join(sizes, on).select(*on, F.pmod(F.xxhash64("source", "relationship"), "n").alias("i"), blocks("m").alias("j"), "source", "relationship").repartition(tasks, *cell)

    def meet(side: DataFrame) -> DataFrame:
        right = side.join(sizes, on).select(*on, blocks("n").alias("i"), F.pmod(F.xxhash64("target"), "m").alias("j"), "target").repartition(tasks, *cell)
        return left.join(right.hint("merge"), cell).select("source", "target", "relationship")

    return meet(names.where("not many")).union(meet(names.where("many")).distinct())


def related_types(dependencies: DataFrame, types: DataFrame, kinds: list[str]) -> DataFrame:
    """Dependencies (symbol, related, relationship) of these kinds, related by display string, to types (id, name, semantic_name).

    A display string names a type by its name, its semantic name, or by ending in a dot and its name. Its candidate
    names become keys of one equi-join: the whole string, and what stands behind each of its dots.
    """
    return key_pairs(staged(dependency_keys(dependencies, kinds), "asked"), staged(type_keys(types), "names"))


def type_relation(edges: DataFrame, dependencies: DataFrame, types: DataFrame, symbols: DataFrame, given: DataFrame, name: str) -> DataFrame:
    """implementers or subtypes of given (id): by edges, and by the display strings of type dependencies. Both ends must be symbols (id).

    The ends are checked before names are matched, and an edge that the names give too is left out by its keys: the pairs of
    names, which may be far more than the rows, are not shuffled again.
    """
    kinds = {"implementers": ["interface"], "subtypes": ["base-type", "interface"]}[name]
    ids = symbols.select("id").distinct()
    asked = staged(dependency_keys(dependencies.join(ids.withColumnRenamed("id", "symbol"), "symbol", "left_semi"), kinds), "asked")
    names = staged(type_keys(types.join(given.select("id").distinct(), "id", "left_semi").join(ids, "id", "left_semi")), "names")
    keyed = known_ends(graph.relation(edges, given, name), symbols).join(names.drop("many"), "target", "left")
    marked = keyed.join(asked.withColumn("__named", F.lit(True)), ["source", "relationship", "key", "whole"], "left")
    alone = marked.groupBy("source", "target", "relationship").agg(F.max("__named").alias("__named")).where("__named is null")
    return alone.drop("__named").union(key_pairs(asked, names))


def known_ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose source and target both are symbols (id)."""
    ids = symbols.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def absence_scope(project: DataFrame, outbound: bool, dependencies: DataFrame) -> DataFrame:
    """The projects (id) that must be complete before an empty answer proves absence.

    For relations that leave a symbol its own project; for those that reach it, its project and all that depend on
    it, directly or not. dependencies are (source depends on target).
    """
    if outbound:
        return project.select("id").distinct()
    return graph.closure(project, dependencies.select(F.col("target").alias("source"), F.col("source").alias("target"))).select("id")


def block_text(blocks: DataFrame, files: DataFrame, generated: DataFrame) -> DataFrame:
    """blocks (file, ...) with text: of a generated:// file from generated (file, text), else from files (path, text); those without a text go."""
    made = generated.select("file", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("__made"))
    stored = files.select(F.col("path").alias("file"), F.col("text").alias("__stored"))
    both = blocks.join(made, "file", "left").join(stored, "file", "left")
    text = F.when(F.startswith("file", F.lit("generated://")), F.col("__made")).otherwise(F.col("__stored"))
    return both.withColumn("text", text).where("text is not null").drop("__made", "__stored")
