"""Markdown files: scanning a folder, parsing documents and cutting them into chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.functions.text import ATOM_RE, fold

# Patterns of tags, links and code blocks, chunk tiers in characters, windows in atoms.
TAG_PATTERN = r"(?<!\w)#[\w\-一-鿿]+"
LINK_PATTERN = r"(?:https?://\S+|zotero://\S+|file:///\S+)"
WIKI_LINK_PATTERN = r"\[\[([^\]]+)\]\]"
CODE_BLOCK_PATTERN = r"```([^\n`]*)\n(.*?)```"
TITLE_PATTERN = r"^#\s+(.+?)\s*$"
SMALL_DOCUMENT, LARGE_DOCUMENT = 1200, 3500
WINDOW, OVERLAP = 800, 120

BEFORE_STOP, BLANK_RUN, PARAGRAPHS = r"\s+([,.;:!?)}\]])", r"[ \t]{2,}", r"\n\s*\n"

_TAG, _LINK, _WIKI = re.compile(TAG_PATTERN), re.compile(LINK_PATTERN), re.compile(WIKI_LINK_PATTERN)
_CODE, _TITLE = re.compile(CODE_BLOCK_PATTERN, re.S), re.compile(TITLE_PATTERN, re.M)
_BEFORE_STOP, _BLANK_RUN, _PARAGRAPHS = re.compile(BEFORE_STOP), re.compile(BLANK_RUN), re.compile(PARAGRAPHS)

PARSED_SCHEMA = (
    "doc_id string, collection_id string, collection_name string, title string, source_path string, relative_path string, tags array<string>, out_links array<string>, "
    "updated_at string, source_hash string, context_hash string, document_hash string, char_count int, context_text string, "
    "chunks array<struct<chunk_id:string,section_path:string,chunk_type:string,context_prefix:string,text:string,search_text:string,token_count:int,embedding_hash:string>>"
)


def mask_pattern(mask: str) -> str:
    """A regular expression for relative paths that a file mask takes.

    ``*`` and ``?`` stay inside a name, ``**`` as a whole part stands for any folders, also none.
    """
    parts = [p for p in mask.split("/") if p not in ("", ".")]
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+/)*" + ("[^/]*" if last else "")
            continue
        for token in re.findall(r"\[!?\]?[^\]]*\]|.", part):
            if token == "*":
                out += "[^/]*"
            elif token == "?":
                out += "[^/]"
            elif len(token) > 1:
                out += "[" + token[1:-1].replace("\\", "\\\\").replace("!", "^", token[1] == "!") + "]"
            else:
                out += re.escape(token)
        out += "" if last else "/"
    return f"^{out}$"


FILE_COLUMNS = "path string, relative_path string, updated_at string"


def list_files(spark: SparkSession, root: str, mask: str) -> DataFrame:
    """``path, relative_path, updated_at`` of the files below ``root`` that ``mask`` takes, whatever their names begin with, except a dot.

    Spark's own listing leaves out names with a leading underscore; this one asks the file system in
    tasks, one for each folder directly below the root.
    """
    pattern = re.compile(mask_pattern(mask))

    def entries(folder: str, deep: bool) -> list[fs.FileInfo]:
        where, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + quote(folder))
        return where.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=False))

    def shown(found: list[fs.FileInfo], base: str) -> pa.RecordBatch:
        rows = []
        for f in found:
            relative = f.path[len(base) :].lstrip("/")
            if f.type == fs.FileType.File and pattern.match(relative) and not any(part.startswith(".") for part in relative.split("/")):
                rows.append({"path": f.path, "relative_path": relative, "updated_at": f.mtime.astimezone().strftime("%Y-%m-%dT%H:%M:%S") if f.mtime else None})
        return pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("path", "relative_path", "updated_at")]))

    def top(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.path for f in entries(root, False) if f.type == fs.FileType.Directory and not f.base_name.startswith(".")]
        yield pa.record_batch([pa.array([None, *names], pa.string())], ["folder"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + quote(root))
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield shown(entries(root, False) if folder is None else where.get_file_info(fs.FileSelector(folder, recursive=True)), base)

    folders = spark.range(1, numPartitions=1).mapInArrow(top, "folder string")
    return (folders.repartition(spark.sparkContext.defaultParallelism) if "/" in mask else folders.where("folder is null")).mapInArrow(below, FILE_COLUMNS)


def scan_markdown(spark: SparkSession, root: str, mask: str = "*.md") -> DataFrame:
    """``source_path, relative_path, updated_at, text`` of the Markdown files under ``root``.

    ``*.md`` takes the folder's own files, ``**/*.md`` those below it too, ``docs/*.md`` those of one folder.
    Files and folders whose name begins with a dot are left out. Bytes must be UTF-8; line
    ends become ``\\n``. Listing and reading are done by tasks, on any file system Arrow knows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + quote(root))
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_stream(row["path"]) as stream:
                    text = stream.read().decode("utf-8")
                yield pa.record_batch([pa.array([v], pa.string()) for v in (row["path"], row["relative_path"], row["updated_at"], text.replace("\r\n", "\n").replace("\r", "\n"))], ["source_path", "relative_path", "updated_at", "text"])

    files = list_files(spark, root, mask)
    return files.repartition(2 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "source_path string, relative_path string, updated_at string, text string")


def title_of(text: Column, default: Column) -> Column:
    """The first top-level heading, else ``default``."""
    found = F.regexp_extract(text, "(?m)" + TITLE_PATTERN, 1)
    return F.when(found != "", found).otherwise(default)


def links_of(text: Column) -> Column:
    """Web, file and wiki links, each once, sorted."""
    wiki = F.transform(F.regexp_extract_all(text, F.lit(WIKI_LINK_PATTERN), F.lit(1)), lambda x: F.concat(F.lit("wiki://"), F.trim(x)))
    return F.array_sort(F.array_union(F.regexp_extract_all(text, F.lit(r"https?://\S+|zotero://\S+|file:///\S+"), F.lit(0)), wiki))


def tags_of(text: Column) -> Column:
    """Hash tags, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + TAG_PATTERN), F.lit(0))))


def without_tags(text: str) -> str:
    """Tags removed, stops pulled to the word before, runs of blanks collapsed."""
    bare = "\n".join(_TAG.sub("", line) for line in text.splitlines())
    return _BLANK_RUN.sub(" ", _BEFORE_STOP.sub(r"\1", bare)).strip()


def windows_of(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """The text itself if it is short, else windows of normalized atoms joined by blanks."""
    atoms = ATOM_RE.findall(fold(text))
    n = len(atoms)
    if n <= size:
        return [text.strip()] if n else []
    step = max(1, size - overlap)
    count = 1 + -(-(n - size) // step)
    return [" ".join(atoms[i * step : i * step + size]) for i in range(count)]


def sections_of(text: str, title: str) -> list[tuple[str, str]]:
    """Heading and body of each second-level section; lines of first-level headings are left out."""
    lines = text.splitlines()
    heads = [(i, line[3:].strip() or title) for i, line in enumerate(lines) if line.startswith("## ")]
    bounds = [(-1, title), *heads, (len(lines), "")]
    found = [(name, [x for x in lines[a + 1 : b] if not x.startswith("# ")]) for (a, name), (b, _) in zip(bounds, bounds[1:])]
    if not any(body for _, body in found):
        found = [(title, lines)]
    return [(name, joined) for name, body in found if (joined := "\n".join(body).strip())]


def prose_and_code(section: str) -> tuple[str, list[tuple[str, str]]]:
    """A section's prose, and each code block with the last paragraph before it."""
    fields = _CODE.split(section)  # prose, language, code, prose, ...
    prose = [without_tags(p) for p in fields[0::3]]
    blocks = []
    for before, language, code in zip(prose, fields[1::3], fields[2::3]):
        body = without_tags(code.strip())
        if body:
            lead = [p for p in map(str.strip, _PARAGRAPHS.split(before)) if p]
            language = language.strip()
            blocks.append((f"language: {language}\n{body}" if language else body, lead[-1] if lead else ""))
    return "\n".join(filter(None, prose)).strip(), blocks


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _joined(*parts: str) -> str:
    return "\n\n".join(filter(None, (p.strip() for p in parts)))


def parse_document(text: str, name: str, doc_id: str, context: str) -> dict:
    """One document's own columns and its chunks.

    Small documents make one prose chunk, middling ones one for each section, large ones
    windows of each section; code blocks are chunks of their own.
    """
    match = _TITLE.search(text)
    title = match.group(1).strip() if match else name
    parts = [(head, *prose_and_code(body)) for head, body in sections_of(text, title)]
    prose = [(head, p) for head, p, _ in parts if p]
    if len(text) < SMALL_DOCUMENT:
        pieces = [(title, "\n\n".join(p for _, p in prose))] if prose else []
    elif len(text) <= LARGE_DOCUMENT:
        pieces = prose
    else:
        pieces = [(f"{head}::part{n}", w) for head, p in prose for n, w in enumerate(windows_of(p), 1)]
    chunks = []

    def add(kind: str, number: int, section: str, body: str, prefix: str, search: str) -> None:
        chunks.append(
            {
                "chunk_id": f"{doc_id}::{kind}::{number}", "section_path": section, "chunk_type": kind, "context_prefix": prefix, "text": body,
                "search_text": search, "token_count": len(ATOM_RE.findall(fold(search))), "embedding_hash": _sha(f"{kind}::{search}"),
            }
        )

    for number, (section, body) in enumerate(pieces):
        add("text", number, section, body, "", _joined(context, body))
    blocks = [(head, code, lead) for head, _, found in parts for code, lead in found]
    for number, (section, code, lead) in enumerate(blocks):
        add("code", number, section, code, lead, _joined(context, f"context:\n{lead}" if lead else "", f"code:\n{code}"))
    source, ctx = _sha(text), _sha(context)
    return {
        "title": title, "tags": sorted(set(_TAG.findall(text))), "out_links": sorted({*_LINK.findall(text), *(f"wiki://{x.strip()}" for x in _WIKI.findall(text))}),
        "source_hash": source, "context_hash": ctx, "document_hash": _sha(f"{source}::{ctx}"), "char_count": len(text), "chunks": chunks,
    }


def parse_markdown(files: DataFrame) -> DataFrame:
    """Parsed documents, each with an array of its chunks.

    ``files`` has ``collection_id, collection_name, source_path, relative_path, updated_at,
    context_text, text``. A null text counts as an empty one; a null context too.
    """
    carried = ["collection_id", "collection_name", "source_path", "relative_path", "updated_at", "context_text", "text"]
    schema = pa.schema(
        [(c, pa.string()) for c in ("doc_id", "collection_id", "collection_name", "title", "source_path", "relative_path")]
        + [("tags", pa.list_(pa.string())), ("out_links", pa.list_(pa.string()))]
        + [(c, pa.string()) for c in ("updated_at", "source_hash", "context_hash", "document_hash")]
        + [("char_count", pa.int32()), ("context_text", pa.string())]
        + [("chunks", pa.list_(pa.struct([(c, pa.int32() if c == "token_count" else pa.string()) for c in ("chunk_id", "section_path", "chunk_type", "context_prefix", "text", "search_text", "token_count", "embedding_hash")])))]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, context = row["text"] or "", (row["context_text"] or "").strip()
                relative = row["relative_path"] or ""
                doc_id = f"{row['collection_id']}::{relative}"
                stem = relative.rpartition("/")[2]
                stem = stem.rpartition(".")[0] or stem
                rows.append({c: row[c] for c in carried if c != "text"} | {"doc_id": doc_id, "context_text": context} | parse_document(text, stem, doc_id, context))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(*carried).mapInArrow(parse, PARSED_SCHEMA)


def chunk_rows(parsed: DataFrame) -> DataFrame:
    """One row per chunk with its document's columns."""
    return parsed.select(
        "doc_id", "collection_id", "collection_name", "title", "source_path", "relative_path", "context_text", "tags", "out_links", "updated_at", F.explode("chunks").alias("c"),
    ).select("doc_id", "collection_id", "collection_name", "title", "source_path", "relative_path", "context_text", "tags", "out_links", "updated_at", "c.*")
