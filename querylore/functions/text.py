"""Text, date and parameter expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylore.functions.columns import strip

# The parameters a page address must carry.
CONTEXT_PARAMETERS = [
    "Application", "DatabaseHost", "DatabaseSchema", "Company", "CompanyName",
    "Industry", "LoginId", "FirstName", "LastName", "Email",
]

# Content types by file extension.
CONTENT_TYPES = {
    ".md": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".html": "text/html",
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".svg": "image/svg+xml",
}


def non_blank_lines(text: Column) -> Column:
    """Lines of a text, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def sorted_entries(entries: Column, separator: str = "::") -> Column:
    """``key:value`` pairs of a map joined in the order of their keys."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), separator)


def query_parameter(url: Column, name: str) -> Column:
    """A named parameter of a page address, decoded and trimmed; null when it is missing or blank."""
    value = F.try_url_decode(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))
    return F.nullif(strip(value), F.lit(""))


def missing_parameters(url: Column, names: list[str]) -> Column:
    flags = [F.when(query_parameter(url, n).isNull(), F.lit(n)) for n in names]
    return F.array_join(F.array_compact(F.array(*flags)), ",")


def encode_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("%20"))


def extension(path: Column) -> Column:
    """Extension of the last path part, lower-cased, empty when there is none. A leading dot is part of the name."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def content_type(path: Column, types: dict[str, str] = CONTENT_TYPES) -> Column:
    """Content type by extension, null when unknown."""
    lookup = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.try_element_at(lookup, extension(path))


def object_key(path: Column, root: str, prefix: str) -> Column:
    """Key of a file below ``root``: prefix plus relative path with ``/`` as separator."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    relative = F.when(slashes.startswith(root), F.substring(slashes, F.lit(len(root) + 1), F.length(slashes))).otherwise(slashes)
    return F.concat(F.lit(prefix.rstrip("/") + "/" if prefix else ""), relative)
