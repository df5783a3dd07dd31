"""Word, identifier and path expressions (Column in, Column out) and their driver-side twins for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as terms.
STOP_WORDS = ["about", "after", "before", "could", "does", "from", "have", "into", "that", "the", "their", "this", "what", "when", "where", "which", "with", "would", "why"]
TOKEN = r"[A-Za-z_][A-Za-z0-9_./-]*"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def camel_parts(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit(f"({CAMEL})"), F.lit(1))


#: Words of one character, and none at all: never terms.
_TOO_SHORT = ["", "_", *"abcdefghijklmnopqrstuvwxyz0123456789"]


def identifier_words(text: Column) -> Column:
    """Lower-case words of an identifier or text: whole tokens and their camel parts, two characters or more.

    Tokens hold no spaces, so all distinct ones are joined by spaces, split into parts by one pattern, lowered and taken
    apart again: a handful of calls a text, and no loop over its words.
    """
    whole = F.array_join(F.array_distinct(tokens(text)), " ")
    parts = F.array_join(F.array_distinct(camel_parts(whole)), " ")
    low = F.split(F.lower(F.concat_ws(" ", whole, parts)), " ")
    return F.array_except(low, F.lit([*STOP_WORDS, *_TOO_SHORT]))


def query_terms(query: str) -> list[str]:
    """The words of a query string, in ordinal order."""
    found = re.findall(TOKEN, query)
    every = {p.lower() for t in found for p in [t, *re.findall(CAMEL, t)]}
    return sorted(w for w in every if len(w) >= 2 and w not in STOP_WORDS)


def compound_terms(query: str) -> set[str]:
    """Tokens of the query with more than one camel part, lowered."""
    return {t.lower() for t in re.findall(TOKEN, query) if len(re.findall(CAMEL, t)) > 1}


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda x: F.trim(x) != "")).cast("long")


def identity(*parts: Column) -> Column:
    """SHA-256 over parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a 1-based position."""
    before = F.substring(text, F.lit(1), at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors_of(path: Column) -> Column:
    """All directories that contain a path, the root as the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def suffixes_of(path: Column) -> Column:
    """All suffixes of a path that start at a segment, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a path glob: ** spans directories, * and ? stay in one, a bare name matches at
    any depth, and what matches also covers everything below it."""
    glob = re.sub(r"^(\./)+", "", pattern.strip().replace("\\", "/"))
    glob += "**" if glob.endswith("/") else ""
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(kinds.get(p) or re.sub(r"([^\w/ -])", r"\\\1", p) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob))
    return ("^" if "/" in glob else "^(?:.*/)?") + body + "(?:/.*)?$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


# Names, name endings and extensions of files that configure every project below their directory.
SHARED_NAMES = ["global.json", "nuget.config"]
SHARED_ENDINGS = [".editorconfig", ".globalconfig"]
SHARED_EXTENSIONS = ["props", "targets", "sln", "slnx", "ruleset"]


def shared_input(path: Column) -> Column:
    """Files that configure every project below their directory, in any case."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    out = name.isin(SHARED_NAMES) | F.regexp_extract(name, r"\.([^.]*)$", 1).isin(SHARED_EXTENSIONS)
    for ending in SHARED_ENDINGS:
        out = out | F.endswith(name, F.lit(ending))
    return out
