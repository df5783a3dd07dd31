"""Queries over markup made of the driver's pages: views and components, with symbols from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import markup
from cairn.plans.registry import query
from cairn.session import table

VIEW_HEAD = """concat('<Page x:Class="Web.V', page_id % 5, '"', chr(10), ' x:DataType="vm:Kind', page_id % 4, '">', chr(10))"""
VIEW_TAIL = """<Button SaveCommand="{Binding Save}" Width="{Binding Path=Size.Wide}" Clicked="OnTap"/>"""
PART_HEAD = """concat('@inject Web.Svc', page_id % 4, ' svc', chr(10), '<Ns:Card/>', chr(10))"""
PART_TAIL = """<input @onclick="(OnTap)" @bind-Value="@Model.Size">"""
NAMES = """CASE s_suppkey % 11 WHEN 0 THEN 'article' WHEN 1 THEN 'nav' WHEN 2 THEN 'Card' WHEN 3 THEN 'OnTap' WHEN 4 THEN 'Save' WHEN 5 THEN 'Wide' WHEN 6 THEN 'Size' WHEN 7 THEN concat('V', s_suppkey % 5) WHEN 8 THEN concat('Kind', s_suppkey % 4) WHEN 9 THEN concat('Svc', s_suppkey % 4) ELSE 'Page' END"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    view = "page_id % 2 = 0"
    return table(spark, d, "pages").select(
        F.expr("concat('w', page_id % 3, '.csproj')").alias("project"), F.expr(f"CASE WHEN {view} THEN 'Page' ELSE 'RazorComponent' END").alias("item_type"), F.expr(f"concat('views/p', page_id, CASE WHEN {view} THEN '.xaml' ELSE '.razor' END)").alias("path"),
        F.when(F.expr(view), F.concat(F.expr(VIEW_HEAD), "html", F.lit("\n" + VIEW_TAIL))).otherwise(F.concat(F.expr(PART_HEAD), "html", F.lit("\n" + PART_TAIL))).alias("text"),
    )


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("identity"), F.expr(NAMES).alias("name"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'method' ELSE 'class' END").alias("kind"), F.expr("concat('w', s_suppkey % 4, '.csproj')").alias("project"))
    return made.withColumn("semantic_name", F.concat(F.lit("Web."), "name"))


def _place(relationship: str, name: str, types: bool, before: str, match: str, where: str) -> str:
    """A reference whose match stands behind `before` (SQL strings)."""
    return f"SELECT page_id, '{relationship}' AS relationship, {name} AS name, {str(types).lower()} AS types_only, {before} AS b, {match} AS m FROM t WHERE {where}"


def _markup_sql() -> str:
    def tail(text: str, match: str) -> str:
        return f"concat(head, html, chr(10), '{text[: text.index(match)]}')"

    even, odd = "page_id % 2 = 0", "page_id % 2 = 1"
    refs = [
        _place("markup-code-behind", "concat('Web.V', page_id % 5)", True, "'<Page '", """concat('x:Class="Web.V', page_id % 5, '"')""", even),
        _place("markup-data-context", "concat('Kind', page_id % 4)", True, """concat('<Page x:Class="Web.V', page_id % 5, '"', chr(10), ' ')""", """concat('x:DataType="vm:Kind', page_id % 4)""", even),
        _place("markup-command", "'Save'", False, tail(VIEW_TAIL, "SaveCommand"), """'SaveCommand="{Binding Save'""", even),
        _place("markup-binding", "'Wide'", False, tail(VIEW_TAIL, "Width"), """'Width="{Binding Path=Size.Wide'""", even),
        _place("markup-event", "'OnTap'", False, tail(VIEW_TAIL, "Clicked"), """'Clicked="OnTap"'""", even),
        _place("dependency-injection", "concat('Web.Svc', page_id % 4)", False, "''", "concat('@inject Web.Svc', page_id % 4, ' svc')", odd),
        _place("component-use", "'Card'", True, "concat('@inject Web.Svc', page_id % 4, ' svc', chr(10))", "'<Ns:Card'", odd),
        _place("markup-event", "'OnTap'", False, tail(PART_TAIL, "@onclick"), """'@onclick="(OnTap'""", odd),
        _place("markup-binding", "'Size'", False, tail(PART_TAIL, "@bind"), """'@bind-Value="@Model.Size'""", odd),
    ]
    return f"""WITH t AS (SELECT page_id, html, CASE WHEN {even} THEN {VIEW_HEAD} ELSE {PART_HEAD} END AS head FROM pages WHERE html IS NOT NULL),
pieces AS (SELECT page_id, string_split(concat(head, html, chr(10), '{VIEW_TAIL}'), '<') AS ps FROM t WHERE {even}),
tags AS (SELECT page_id, ps, unnest(range(2, len(ps) + 1)) AS i FROM pieces),
uses AS (SELECT page_id, 'component-use' AS relationship, regexp_extract(ps[i], '^[A-Za-z_][A-Za-z0-9_]*') AS name, true AS types_only, array_to_string(ps[1:i - 1], '<') AS b, '<' || regexp_extract(ps[i], '^[A-Za-z_][A-Za-z0-9_]*') AS m FROM tags WHERE regexp_extract(ps[i], '^[A-Za-z_][A-Za-z0-9_]*') <> ''),
refs AS (SELECT * FROM uses UNION ALL {" UNION ALL ".join(refs)}),
placed AS (SELECT page_id, relationship, name, types_only, length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(string_split(b, chr(10))[-1]) + 1 AS col, length(m) AS size FROM refs),
s AS (SELECT 's' || s_suppkey AS identity, {NAMES} AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'method' ELSE 'class' END AS kind, concat('w', s_suppkey % 4, '.csproj') AS project FROM supplier),
asked AS (SELECT DISTINCT concat('w', page_id % 3, '.csproj') AS source_project, name, types_only FROM placed),
c AS (SELECT a.*, identity AS target, s.project AS target_project, row_number() OVER (PARTITION BY source_project, a.name, types_only ORDER BY s.project = source_project DESC, s.project, identity) AS n
  FROM asked a JOIN s ON (NOT types_only OR kind = 'class') AND (s.name = regexp_extract(a.name, '([^.]*)$', 1) OR 'Web.' || s.name = a.name OR ends_with('Web.' || s.name, '.' || a.name)))
SELECT DISTINCT sha256(concat_ws('|', source_project, CASE WHEN {even} THEN 'xaml-view' ELSE 'razor-component' END, concat('views/p', page_id, CASE WHEN {even} THEN '.xaml' ELSE '.razor' END))) AS source, target, relationship, source_project, target_project,
  CASE WHEN relationship IN ('component-use', 'markup-code-behind') THEN 'markup-syntax' ELSE 'markup-convention' END AS origin, concat('views/p', page_id, CASE WHEN {even} THEN '.xaml' ELSE '.razor' END) AS file, line, col AS "column", line AS end_line, col + size AS end_column
FROM placed JOIN c ON c.source_project = concat('w', page_id % 3, '.csproj') AND c.name = placed.name AND c.types_only = placed.types_only WHERE n <= 3"""


@query(_markup_sql())
def markup_edges(spark: SparkSession, d: str) -> DataFrame:
    """Positioned references of every page's markup, resolved to symbols."""
    return markup.markup_edges(_items(spark, d), _symbols(spark, d))


@query("""SELECT sha256(concat_ws('|', project, kind, path)) AS identity, kind, name, semantic_name, CASE WHEN kind = 'xaml-view' THEN 'Web' END AS namespace, project, path AS file, 1::BIGINT AS line, lines AS end_line FROM (
SELECT concat('w', page_id % 3, '.csproj') AS project, 'xaml-view' AS kind, concat('views/p', page_id, '.xaml') AS path, concat('p', page_id) AS name, concat('Web.V', page_id % 5) AS semantic_name, len(string_split(html, chr(10))) + 3 AS lines FROM pages WHERE page_id % 2 = 0 AND html IS NOT NULL
UNION ALL SELECT concat('w', page_id % 3, '.csproj'), 'razor-component', concat('views/p', page_id, '.razor'), concat('p', page_id), concat('p', page_id), len(string_split(html, chr(10))) + 3 FROM pages WHERE page_id % 2 = 1 AND html IS NOT NULL)""")
def markup_symbols(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_symbols(markup.markup_files(_items(spark, d).where("text is not null")))
