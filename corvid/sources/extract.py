"""Text and metadata from raw documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRONT = r"(?s)\A-{3}\s*\n(.*?)\n-{3}\s*\n"
#: Elements that go with what they hold, and comments.
DROPPED = (*(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style")), r"(?s)<!--.*?-->")
_META = r"""(?i)<meta\s+(?:name|property)=["']([^"']+)["']\s+content=["']([^"']*)["']"""


def merge_metadata(left: Column, right: Column) -> Column:
    """One map, the right one's values first; independent of the session's policy for doubled keys."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def with_metadata(df: DataFrame, **values: str) -> DataFrame:
    """Rows with these entries in ``metadata``."""
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return df.withColumn("metadata", merge_metadata(F.col("metadata"), new) if "metadata" in df.columns else new)


def _as_map(entries: Column) -> Column:
    """Structs ``k, v`` to a map, the last of one key counts."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def front_matter(text: Column) -> Column:
    """The ``key: value`` lines between the dashes at the beginning; empty keys and values don't count."""
    lines = F.split(F.regexp_extract(text, _FRONT, 1), "\n")
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return _as_map(F.filter(pairs, lambda e: (e["k"] != "") & (e["v"] != "")))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, _FRONT, "")


def html_text(html: Column, block_spacing: bool = False) -> Column:
    """Without scripts, styles, comments and tags; entities decoded, white space collapsed.

    Tags vanish without a trace, so words of neighbouring blocks join, unless
    ``block_spacing`` puts a space in place of each tag.
    """
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, "<[^>]*>", " " if block_spacing else "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<title>([^<]+)</title\s*>", 1)


def html_metadata(html: Column) -> Column:
    """Named meta tags, and the title over them."""
    names, values = (F.regexp_extract_all(html, F.lit(_META), F.lit(i)) for i in (1, 2))
    tags = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    title = F.array(F.struct(F.lit("title").alias("k"), html_title(html).alias("v")))
    return _as_map(F.concat(tags, F.when(html_title(html) != "", title).otherwise(F.slice(title, 1, 0))))


def format_of_mime(mime: Column) -> Column:
    low = F.lower(mime)
    return F.when(low.contains("pdf"), "pdf").when(low.contains("html") | low.contains("xml"), "html").otherwise("text")


def format_of_name(name: Column) -> Column:
    """By extension; both ``md`` and ``markdown`` are Markdown."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm", "xml"), "html").when(ext.isin("md", "markdown"), "markdown").otherwise("text")


def extract(files: DataFrame) -> DataFrame:
    """``id, content, format, metadata`` from ``name, text`` and optionally a map ``metadata``.

    What a document says of itself goes over what the caller gave.  PDF has no reader
    here: its content is null and its metadata says so.
    """
    kind = format_of_name(F.col("name"))
    given = F.col("metadata") if "metadata" in files.columns else F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    own = F.when(kind == "markdown", front_matter(F.col("text"))).when(kind == "html", html_metadata(F.col("text"))).when(kind == "pdf", F.create_map(F.lit("format"), F.lit("pdf")))
    content = F.when(kind == "markdown", without_front_matter(F.col("text"))).when(kind == "html", html_text(F.col("text"))).when(kind == "text", F.col("text"))
    return files.select(F.col("name").alias("id"), content.alias("content"), kind.alias("format"), F.when(own.isNull(), given).otherwise(merge_metadata(given, own)).alias("metadata"))


def row_documents(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``id, content, metadata``: a document of the named columns for each row of a table."""
    lines = F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))
    meta = F.map_filter(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    return df.select(F.col(key).cast("string").alias("id"), lines.alias("content"), meta.alias("metadata"))
