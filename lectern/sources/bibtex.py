"""BibTeX documents: a tokenizer as a data source of rows, a strict check, and a serialiser as a column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions.text import ascii_field, collapse

# The closed sets of a strict document.
TYPES = ("article", "book", "incollection", "inproceedings", "misc", "phdthesis")
FIELDS = (
    "title", "author", "year", "journal", "booktitle", "volume", "number", "pages", "publisher", "doi", "url", "howpublished",
    "eprint", "archiveprefix", "primaryclass", "school", "month", "issn", "series", "editor", "note", "abstract", "keywords",
    "isbn", "x_s2_paper_id", "x_openalex_id", "x_pmid",
)
RAW = ("doi", "url", "howpublished")
_HEAD = re.compile(r"@\s*(\w+)\s*([{(])")
_NAME = re.compile(r"\s*([A-Za-z][\w:.-]*)\s*=\s*")


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """A value: braced, quoted, number or macro, several joined by #; and the place after it."""
    parts = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise ValueError("value expected")
        if text[at] in "{\"":
            close, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
            at += 1
            while at < len(text):
                ch = text[at]
                if ch == "\\":
                    at += 1
                elif ch == close and depth == 0:
                    break
                elif ch == "{":
                    depth += 1
                elif ch == "}":
                    depth -= 1
                at += 1
            if at >= len(text):
                raise ValueError("value does not end")
            parts.append(text[start:at])
            at += 1
        else:
            m = re.compile(r"[^\s,#}]+").match(text, at)
            if not m:
                raise ValueError("value expected")
            parts.append(macros.get(m[0].lower(), m[0]))
            at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "#":
            at += 1
            continue
        return "".join(parts), at


def entries(text: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(type, key, fields in order) of each entry; @string macros are resolved, comments skipped."""
    macros: dict[str, str] = {}
    at = 0
    while m := _HEAD.search(text, at):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            comma = text.find(",", at)
            end = comma if comma >= 0 else len(text)
            key, at = text[at:end].strip(), end + 1
        fields = []
        while n := _NAME.match(text, at):
            value, at = _value(text, n.end(), macros)
            fields.append((n[1].lower(), " ".join(value.split())))
            while at < len(text) and (text[at].isspace() or text[at] == ","):
                at += 1
        if kind == "string":
            macros.update(fields)
        else:
            yield kind, key, fields


def violations(text: str) -> list[str]:
    """What keeps a document from being one strict entry."""
    out = []
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        out.append("control_character")
    if re.search(r"@\s*(string|preamble|comment)", text, re.I):
        out.append("directive")
    try:
        found = list(entries(text))
    except ValueError:
        return [*out, "syntax"]
    if len(found) != 1:
        return [*out, "entry_count"]
    kind, _, fields = found[0]
    names = [n for n, _ in fields]
    if kind not in TYPES:
        out.append("type")
    if len(set(names)) < len(names):
        out.append("duplicate_field")
    if set(names) - set(FIELDS):
        out.append("field")
    year = dict(fields).get("year", "")
    if not re.fullmatch(r"\d{4}", year) or not policy.YEAR_MIN <= int(year) <= policy.YEAR_MAX:
        out.append("year")
    return out


def parse(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row id, type, key, fields): the first entry of each document; null type where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["text"]):
                try:
                    first = next(entries(t or ""), None)
                except ValueError:
                    first = None
                rows.append((i, first[0], first[1], dict(first[2])) if first else (i, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "type", "key", "fields"])

    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInPandas(
        run, "id long, type string, key string, fields map<string,string>"
    )


def check(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, violations) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "violations": [violations(t or "") for t in batch["text"]]})

    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, violations array<string>")


def serialize(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """The document of an entry: fields in the preferred order, then by name; empty ones left out."""
    names = [f for f in policy.FIELD_ORDER if f in fields] + sorted(set(fields) - set(policy.FIELD_ORDER))
    lines = []
    for name in names:
        value = collapse(F.coalesce(fields[name].cast("string"), F.lit("")))
        shown = value if name in RAW else ascii_field(value)
        lines.append(F.when(value != "", F.concat(F.lit(f"  {name} = {{"), shown, F.lit("}"))))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def write_directory(docs: DataFrame, root: str) -> None:
    """Writes each row of (path, document) as a file of its own below `root`, through the file system that `root` names.
    A task that runs again writes the same bytes to the same paths."""
    from pyarrow import fs as arrow_fs

    uri = root if "://" in root else "file://" + root.removeprefix("file:")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = arrow_fs.FileSystem.from_uri(uri)
        n = 0
        for batch in batches:
            for path, document in zip(batch["path"], batch["document"]):
                full = f"{base}/{path}"
                where.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(full) as out:
                    out.write(document.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    docs.select("path", "document").mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one number


def scan_directory(spark: SparkSession, root: str, pattern: str = "*.bib") -> DataFrame:
    """(path, dir, type, key, fields, violations) of every document below `root`, through Spark's own reader: any file
    system, hidden files and other names left out, each file whole and read by one task among all. Paths are below
    `root`; a file that is no entry has a null type; an empty folder gives no rows."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rest = F.substring_index(F.col("_metadata.file_path"), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    docs = files.select(F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, t in zip(batch["path"], batch["text"]):
                try:
                    first = next(entries(t or ""), None)
                except ValueError:
                    first = None
                rows.append((path, *((first[0], first[1], dict(first[2])) if first else (None, None, None)), violations(t or "")))
            yield pd.DataFrame(rows, columns=["path", "type", "key", "fields", "violations"])

    read = docs.mapInPandas(run, "path string, type string, key string, fields map<string,string>, violations array<string>")
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    return read.select("path", folder.alias("dir"), "type", "key", "fields", "violations")
