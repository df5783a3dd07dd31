"""Names, labels, predicates on paths and small formats as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that hold evidence text.
EVIDENCE_EXTENSIONS = ["cs", "fs", "vb", "razor", "xaml", "md", "json", "csproj", "fsproj", "vbproj", "props", "targets"]
# Files that decide what a repository builds.
INPUT_NAMES = [".gitignore", "global.json", "NuGet.Config", "packages.lock.json"]
INPUT_EXTENSIONS = ["cs", "fs", "vb", "csproj", "fsproj", "vbproj", "props", "targets", "sln", "slnx", "slnf", "razor", "cshtml", "xaml", "resx", "editorconfig", "globalconfig", "ruleset"]
# Folders that build tools write.
TOOL_FOLDERS = ["bin", "obj", ".idea"]
FENCES = {"razor": "razor", "xaml": "xml", "json": "json", "md": "markdown", "csproj": "xml", "props": "xml", "targets": "xml"}
LABELS = {"Committed": "committed", "WorkingTree": "working tree", "Both": "committed + working tree"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    """Lower-case extension without the dot, empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem_of(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def plain_path(path: Column) -> Column:
    """A path without `.` and `..` segments; `..` above the root stays."""
    step = lambda a, s: F.when((s == "") | (s == "."), a).when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step), "/")


def beside(file: Column, relative: Column) -> Column:
    """A path given relative to the folder of a file."""
    folder = F.regexp_extract(F.replace(file, F.lit("\\"), F.lit("/")), r"^(.*/)?[^/]*$", 1)
    return F.when(relative.rlike(r"^(?:/|[A-Za-z]:)"), F.replace(relative, F.lit("\\"), F.lit("/"))).otherwise(plain_path(F.concat(folder, relative)))


def relative_file(uri: Column, root: str) -> Column:
    """A decoded file URI or path, relative to root where it is below it; null for blank ones."""
    below = root.replace("\\", "/").rstrip("/") + "/"
    decoded = F.replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    local = F.regexp_replace(decoded, r"^file://(?:localhost)?(?:/(?=[A-Za-z]:))?", "")
    absolute = local.rlike(r"^(?:/|[A-Za-z]:)")
    full = F.when(absolute, F.concat(F.when(local.startswith("/"), "/").otherwise(""), plain_path(local))).otherwise(F.concat(F.lit(below), plain_path(local)))
    full = F.when(absolute, full).otherwise(F.concat(F.lit("/" if below.startswith("/") else ""), plain_path(full)))
    return F.when(F.trim(uri) != "", F.when(F.startswith(full, F.lit(below)), F.substring(full, len(below) + 1, 1 << 30)).otherwise(full))


def is_within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder (any case) or below it; everything is within the empty folder."""
    below = F.lower(F.rtrim(folder, F.lit("/")))
    return (below == "") | (F.lower(path) == below) | F.startswith(F.lower(path), F.concat(below, F.lit("/")))


def is_evidence_file(path: Column) -> Column:
    return extension_of(path).isin(EVIDENCE_EXTENSIONS)


def is_repository_input(path: Column) -> Column:
    return file_name(path).isin(INPUT_NAMES) | extension_of(path).isin(INPUT_EXTENSIONS)


def in_tool_folder(path: Column, own: list[str]) -> Column:
    """Whether any segment is a folder of build tools or one of `own`, in any case."""
    names = [n.lower() for n in [*TOOL_FOLDERS, *own]]
    return F.exists(F.split(path, "/"), lambda s: F.lower(s).isin(names))


def joined_name(*parts: Column) -> Column:
    """The parts that are not blank, joined by dots."""
    return F.concat_ws(".", *[F.when(F.trim(p) != "", p) for p in parts])


def last_identifier(value: Column) -> Column:
    """The last name of a dotted or listed expression, quotes and braces around it left out; empty without one."""
    bare = F.regexp_replace(value, "^[ {}\"'@]+|[ {}\"'@]+$", "")
    return F.coalesce(F.get(F.reverse(F.filter(F.split(bare, "[.:, ]"), lambda x: x != "")), F.lit(0)), F.lit(""))


def position_of(text: Column, at: Column) -> Column:
    """1-based (line, column) of a 1-based position."""
    before = F.substring(text, F.lit(1), at - 1)
    lines = F.split(before, "\n")
    return F.struct(F.size(lines).cast("long").alias("line"), (F.length(F.element_at(lines, -1)) + 1).cast("long").alias("column"))


def signed_delta(delta: Column, decimals: int | None = None, suffix: str = "") -> Column:
    """' (+3)', ' (-1)' or ' (0)', with decimals if given; empty for null."""
    shown = F.abs(delta).cast("string") if decimals is None else F.format_string(f"%.{decimals}f", F.round(F.abs(delta), decimals))
    zero = "0" if decimals is None else f"{0:.{decimals}f}"
    sign = F.when(shown == zero, "").when(delta > 0, "+").otherwise("-")
    return F.when(delta.isNotNull(), F.concat(F.lit(" ("), sign, shown, F.lit(f"{suffix})"))).otherwise(F.lit(""))


def escaped_test(name: Column) -> Column:
    """A test name as a value in a test filter: backslash, parentheses and comma behind a backslash."""
    return F.regexp_replace(name, r"([\\(),])", r"\\$1")


def test_filter(names: Column) -> Column:
    """A filter expression for an array of full test names."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("FullyQualifiedName="), escaped_test(n))), "|")


def compact_message(message: Column, most: int = 500) -> Column:
    """Trimmed lines that are not empty, joined by a space, cut to `most` characters with three dots."""
    lines = F.filter(F.transform(F.split(message, r"[\r\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    one = F.array_join(lines, " ")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 3), F.lit("...")))


def _mapped(key: Column, values: dict[str, str], rest: Column) -> Column:
    out = rest
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def change_label(provenance: Column) -> Column:
    return _mapped(provenance, LABELS, provenance)


def fence_language(path: Column) -> Column:
    """The language of a fenced block for a file."""
    return _mapped(extension_of(path), FENCES, F.lit("csharp"))


def evidence_location(file: Column, line: Column, column: Column, framework: Column) -> Column:
    """'; file:line[:column][; framework]', empty without file or line."""
    more = lambda before, x: F.coalesce(F.concat(F.lit(before), x.cast("string")), F.lit(""))
    return F.coalesce(F.concat(F.lit("; "), file, F.lit(":"), line.cast("string"), more(":", column), more("; ", framework)), F.lit(""))


def split_command(command: str) -> list[str]:
    """A configured command's arguments. Quotes of either kind group; within them a backslash escapes just that quote."""
    parts: list[str] = []
    word, quote, rest = "", "", iter(range(len(command)))
    for i in rest:
        c = command[i]
        if quote and c == "\\" and command[i + 1 : i + 2] == quote:
            word += quote
            next(rest)
        elif c == quote:
            quote = ""
        elif not quote and c in "'\"":
            quote = c
        elif not quote and c.isspace():
            parts, word = [*parts, word], ""
        else:
            word += c
    if quote:
        raise ValueError("the command holds an unmatched quote")
    return [p for p in [*parts, word] if p]
