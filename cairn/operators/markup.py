"""Markup scan: symbols of components and views, and positioned references from markup to code.

A pattern's matches are marked in the text by one replacement, the text is split at the marks, and the pieces' sizes and
line breaks add up to offset, line and column along each file. Only names and sizes travel, never the text. A reference
names code by its last identifier, or by a semantic name or a dotted end of one; both are keys of one equi-join with the
candidates that can come first for a key, so a name that very many symbols share costs no more than a rare one.

Columns count code points. A null text has no matches. Repeated paths (in any case) of a project count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.names import extension_of, last_identifier, stem_of
from cairn.functions.text import identity, normal_path
from cairn.operators.keys import first_by

COMPONENT, VIEW = "razor-component", "xaml-view"
# Fixed value: build items that are markup.
MARKUP_ITEMS = ["RazorComponent", "MauiXaml", "Page", "ApplicationDefinition"]
TYPE_KINDS = ["class", "record", "struct", "interface", "enum"]
# Attributes whose value is no event handler.
NOT_EVENTS = ["Class", "Name", "Title", "Text", "Content", "Source"]
#: Candidates of one reference.
MOST = 3


@dataclass(frozen=True)
class Pattern:
    """One kind of reference: in which dialect, its pattern, how many groups it has (the name is the last), and whether it names types only."""

    dialect: str
    relationship: str
    regex: str
    groups: int = 1
    types_only: bool = False
    first_only: bool = False


NAME = r"([A-Za-z_][A-Za-z0-9_.]*)"
# The shapes of references in the two dialects.
PATTERNS = [
    Pattern(COMPONENT, "dependency-injection", rf"@inject\s+{NAME}\s+[A-Za-z_][A-Za-z0-9_]*"),
    Pattern(COMPONENT, "component-use", r"<([A-Za-z_][A-Za-z0-9_:.]*)\b", types_only=True),
    Pattern(COMPONENT, "markup-event", rf'@on[A-Za-z]+\s*=\s*"(?:@?\(?){NAME}'),
    Pattern(COMPONENT, "markup-binding", rf'@bind(?:-[A-Za-z]+)?\s*=\s*"@?{NAME}'),
    Pattern(VIEW, "markup-code-behind", rf'x:Class\s*=\s*"{NAME}"', types_only=True, first_only=True),
    Pattern(VIEW, "component-use", r"<([A-Za-z_][A-Za-z0-9_:.]*)\b", types_only=True),
    Pattern(VIEW, "markup-binding", rf'{NAME}(?:Property)?\s*=\s*"\{{Binding(?:\s+Path=)?\s*{NAME}', 2),
    Pattern(VIEW, "markup-data-context", r'(?:x:DataType|DataType)\s*=\s*"(?:\{x:Type\s+)?(?:[A-Za-z_][A-Za-z0-9_]*:)?([A-Za-z_][A-Za-z0-9_]*)', types_only=True),
    Pattern(VIEW, "markup-event", r'(?:[A-Za-z_][A-Za-z0-9_]*:)?([A-Z][A-Za-z0-9_]*)\s*=\s*"([A-Za-z_][A-Za-z0-9_]*)"', 2),
]
#: Marks around groups and matches; they become spaces in texts that hold them.
BEGIN, SECOND, WHOLE, REST = "\u0001", "\u0002", "\u0003", "\u0004"


def positions(texts: DataFrame, key: list[str], text: str, patterns: dict[int, Column | None], regexes: dict[int, tuple[str, int]]) -> DataFrame:
    """Every match of every pattern: key, pattern, nth (from 1), first, second (groups), line, column, end_line, end_column.

    regexes: number -> (pattern, number of groups); patterns: number -> which rows it is for (None: all).
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), BEGIN + SECOND + WHOLE + REST, "    ")
    made = []
    for n, (regex, groups) in regexes.items():
        marked = F.regexp_replace(F.col("__text"), F.lit(regex), F.lit(f"{BEGIN}$1{SECOND}{'$2' if groups > 1 else ''}{WHOLE}$0{REST}"))
        pieces = F.struct(F.lit(n).alias("pattern"), F.split(marked, BEGIN).alias("pieces"))
        made.append(pieces if patterns.get(n) is None else F.when(patterns[n], pieces))
    rows = texts.withColumn("__text", clean).select(*key, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("p")).select(*key, "p.pattern", F.posexplode("p.pieces").alias("nth", "piece"))
    head, body = F.substring_index("piece", WHOLE, 1), F.when(F.col("nth") == 0, F.concat(F.lit(WHOLE + REST), "piece")).otherwise(F.col("piece"))
    tail = F.substring_index(body, WHOLE, -1)
    match, rest = F.substring_index(tail, REST, 1), F.substring_index(tail, REST, -1)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    after = lambda x: F.length(F.substring_index(x, "\n", -1))  # noqa: E731  characters behind the last line break
    both = F.concat(match, rest)
    sized = rows.select(
        *key, "pattern", "nth", F.substring_index(head, SECOND, 1).alias("first"), F.substring_index(head, SECOND, -1).alias("second"),
        F.length(match).alias("size"), breaks(match).alias("breaks"), after(match).alias("after"), F.length(both).alias("all_size"), breaks(both).alias("all_breaks"), after(both).alias("all_after"),
    )
    w = Window.partitionBy(*key, "pattern").orderBy("nth")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("all_size").over(upto))
    placed = placed.withColumn("start", F.col("end") - F.col("all_size")).withColumn("broken", F.when(F.col("all_breaks") > 0, F.col("end") - F.col("all_after")))
    placed = placed.withColumn("line", F.coalesce(F.sum("all_breaks").over(before), F.lit(0)) + 1).withColumn("column", F.col("start") - F.coalesce(F.max("broken").over(before), F.lit(0)) + 1)
    end_column = F.when(F.col("breaks") > 0, F.col("after") + 1).otherwise(F.col("column") + F.col("size"))
    return placed.where("nth > 0").select(*key, "pattern", F.col("nth").cast("long").alias("nth"), "first", "second", "line", "column", (F.col("line") + F.col("breaks")).alias("end_line"), end_column.alias("end_column"))


def markup_files(items: DataFrame) -> DataFrame:
    """Markup among a project's build items (project, item_type, path, text): project, path, kind, text, and the source's identity and names."""
    found = items.where(F.col("item_type").isin(MARKUP_ITEMS)).withColumn("path", normal_path(F.col("path")))
    found = first_by(found, ["project", F.lower("path")], ["path"])
    razor = (F.col("item_type") == "RazorComponent") | (extension_of(F.col("path")) == "razor")
    found = found.withColumn("kind", F.when(razor, COMPONENT).otherwise(VIEW))
    named = F.when(F.col("kind") == VIEW, F.regexp_extract("text", PATTERNS[4].regex, 1)).otherwise("")
    own = F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(stem_of(F.col("path")))
    return found.select("project", "path", "kind", "text", identity(F.col("project"), F.col("kind"), F.col("path")).alias("identity"), stem_of(F.col("path")).alias("name"), own.alias("semantic_name"))


def markup_symbols(files: DataFrame) -> DataFrame:
    """A symbol for each file of markup_files()."""
    namespace = F.regexp_extract("semantic_name", r"^(.+)\.[^.]*$", 1)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return files.select("identity", "kind", "name", "semantic_name", F.when(namespace != "", namespace).alias("namespace"), "project", F.col("path").alias("file"), F.lit(1).cast("long").alias("line"), lines.alias("end_line"))


def markup_references(files: DataFrame) -> DataFrame:
    """Every reference in files of markup_files(), unresolved: source, project, path, relationship, name, types_only and its place."""
    wanted = {n: F.col("kind") == p.dialect for n, p in enumerate(PATTERNS)}
    found = positions(files, ["identity", "project", "path", "kind"], "text", wanted, {n: (p.regex, p.groups) for n, p in enumerate(PATTERNS)})
    pattern = lambda attribute: F.element_at(F.create_map(*[F.lit(x) for n, p in enumerate(PATTERNS) for x in (n, getattr(p, attribute))]), F.col("pattern"))
    rows = found.withColumns({"relationship": pattern("relationship"), "types_only": pattern("types_only"), "first_only": pattern("first_only")}).where(~F.col("first_only") | (F.col("nth") == 1))
    is_use, is_event = F.col("relationship") == "component-use", (F.col("kind") == VIEW) & (F.col("relationship") == "markup-event")
    is_binding = (F.col("kind") == VIEW) & (F.col("relationship") == "markup-binding")
    name = F.when(is_use, F.substring_index("first", ":", -1)).when(is_event, F.col("second")).when(is_binding, last_identifier(F.col("second"))).when(F.col("relationship").isin("dependency-injection", "markup-code-behind"), F.col("first")).otherwise(last_identifier(F.col("first")))
    rows = rows.withColumn("name", name).where(F.trim("name") != "")
    rows = rows.where(~(is_use & (F.col("kind") == COMPONENT)) | F.col("name").rlike("^[A-Z]")).where(~is_event | ~(F.col("first").isin(NOT_EVENTS) | F.endswith("first", F.lit("Property"))))
    relationship = F.when(is_binding & F.contains(F.lower("first"), F.lit("command")), "markup-command").otherwise(F.col("relationship"))
    return rows.select(F.col("identity").alias("source"), "project", "path", relationship.alias("relationship"), "name", "types_only", "line", "column", "end_line", "end_column")


def _candidates(symbols: DataFrame) -> DataFrame:
    """tier, key, types_only, scope -> the first MOST symbols: of all projects (scope empty), and of each (scope its path in lower case)."""
    parts = F.split("semantic_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.lit("s").alias("tier"), F.array_join(F.slice(parts, n, F.size(parts)), ".").alias("key")))
    keys = F.concat(F.array(F.struct(F.lit("n").alias("tier"), F.col("name").alias("key"))), F.when(F.col("semantic_name").isNotNull(), tails).otherwise(F.array()))
    rows = symbols.select("identity", "project", "kind", F.explode(keys).alias("k")).select("k.tier", "k.key", "identity", "project", F.explode(F.when(F.col("kind").isin(TYPE_KINDS), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("types_only")).distinct()
    rows = rows.withColumn("scope", F.explode(F.array(F.lit(""), F.lower("project"))))
    return first_by(rows, ["tier", "key", "types_only", "scope"], ["project", "identity"], MOST)


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from references of markup_references() to symbols (identity, name, semantic_name, kind, project): the first three candidates
    of each, those of the own project first, then by project and identity. A distinct (project, name) is resolved once.
    """
    asked = references.select("project", "name", "types_only").distinct()
    keys = F.array(F.struct(F.lit("n").alias("tier"), last_identifier(F.col("name")).alias("key")), F.struct(F.lit("s").alias("tier"), F.col("name").alias("key")))
    wanted = asked.select(F.col("project").alias("__project"), F.col("name").alias("__name"), "types_only", F.explode(keys).alias("k")).select("__project", "__name", "types_only", "k.tier", "k.key", F.explode(F.array(F.lit(""), F.lower("__project"))).alias("scope"))
    found = wanted.join(_candidates(symbols), ["tier", "key", "types_only", "scope"]).select("__project", "__name", "types_only", F.col("identity").alias("target"), F.col("project").alias("target_project")).distinct()
    own = (F.lower("target_project") == F.lower("__project")).cast("int")
    best = first_by(found, ["__project", "__name", "types_only"], [F.desc(own), "target_project", "target"], MOST).select(F.col("__project").alias("project"), F.col("__name").alias("name"), "types_only", "target", "target_project")
    syntax = F.col("relationship").isin("component-use", "markup-code-behind")
    edges = references.join(best, ["project", "name", "types_only"]).where("source <> target")
    return edges.select("source", "target", "relationship", F.col("project").alias("source_project"), "target_project", F.when(syntax, "markup-syntax").otherwise("markup-convention").alias("origin"), F.col("path").alias("file"), "line", "column", "end_line", "end_column").distinct()


def markup_edges(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from markup items to code symbols, with the place of each."""
    return resolve_references(markup_references(markup_files(items)), symbols)
