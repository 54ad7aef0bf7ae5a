"""Files to documents (doc_id, text, metadata): text, CSV, JSON, HTML, Markdown, spreadsheets, word-processor files.

Paths are read by Spark's own readers, so they may be in any store. The first broken file fails the read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwell.functions.arrays import let
from sparkwell.functions.text import trimmed

# fixed values: file name patterns of each reader
GLOBS = {
    "csv": "*.{csv,tsv}",
    "json": "*.{json,jsonl}",
    "html": "*.{html,htm,xhtml}",
    "markdown": "*.{md,markdown,mdown,mkd}",
    "excel": "*.{xlsx,xlsm}",
    "docx": "*.docx",
    "pdf": "*.pdf",
}
DOCUMENT = "doc_id string, text string, metadata map<string,string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt by its first column to as many partitions as there are cores, if it is read in fewer; else as it is.

    A small file is read by one task, whatever is done to its rows; tables of many files are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def whole_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, name, content) of each file as text."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def _binary(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".txt", ".md"), recursive: bool = True) -> DataFrame:
    files = whole_files(spark, path, None, recursive).where(_extension(F.col("name")).isin([e.lower() for e in extensions]))
    meta = F.create_map(F.lit("filename"), F.col("name"), F.lit("path"), F.col("path"), F.lit("ext"), _extension(F.col("name")))
    return files.select(F.col("path").alias("doc_id"), F.col("content").alias("text"), meta.alias("metadata"))


def resolve_columns(headers: list[str], wanted: list[str]) -> list[int]:
    """Places of the wanted columns, by header whatever the case, else by number; unknown ones are left out."""
    folded = [h.strip().lower() for h in headers]
    out = []
    for w in wanted:
        if w.strip().lower() in folded:
            out.append(folded.index(w.strip().lower()))
        elif w.strip().isdigit() and int(w) < len(headers):
            out.append(int(w))
    return out


def csv_rows(spark: SparkSession, path: str, header: bool = True, text: list[str] | None = None, metadata: list[str] | None = None, separator: str | None = None) -> DataFrame:
    """One document for each row: non-empty cells by lines, named if there are several text columns."""
    separator = separator or ("\t" if path.lower().endswith(".tsv") else ",")
    df = spark.read.csv(path, header=header, sep=separator, ignoreLeadingWhiteSpace=True, inferSchema=False, multiLine=True, escape='"')
    names = df.columns if header else [f"col_{i}" for i in range(len(df.columns))]
    places = list(range(len(names))) if text is None else resolve_columns(names, text)
    if metadata is not None:
        kept = resolve_columns(names, metadata)
    else:
        kept = [] if text is None else [i for i in range(len(names)) if i not in places]
    cells = df.toDF(*[f"c{i}" for i in range(len(names))])
    cells = cells.withColumn("path", F.col("_metadata.file_path")) if "_metadata" not in names else cells
    w = Window.partitionBy("path").orderBy("__m")
    cells = cells.withColumn("__m", F.monotonically_increasing_id()).withColumn("row", F.row_number().over(w) - 1)

    def cell(i: int) -> Column:
        own = F.nullif(F.trim(F.col(f"c{i}")), F.lit(""))
        return F.concat(F.lit(f"{names[i]}: "), own) if len(places) > 1 else own

    meta = [F.lit("row"), (F.col("row") + 1).cast("string"), F.lit("path"), F.col("path")]
    for i in kept:
        meta += [F.lit(names[i]), F.coalesce(F.col(f"c{i}"), F.lit(""))]
    return cells.select(
        F.concat("path", F.lit("_row_"), F.col("row").cast("string")).alias("doc_id"),
        F.concat_ws("\n", *[cell(i) for i in places]).alias("text"),
        F.create_map(*meta).alias("metadata"),
    )


def csv_files(spark: SparkSession, path: str, header: bool = True, separator: str = "\n") -> DataFrame:
    """One document for each file: cells joined by ' | ', rows by the separator."""
    df = spark.read.csv(path, header=header, ignoreLeadingWhiteSpace=True, inferSchema=False, multiLine=True, escape='"')
    names = df.columns
    row = F.concat_ws(" | ", *[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names])
    rows = df.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("m"), row.alias("r"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("m", "r"))), lambda x: x["r"])
    own = rows.groupBy("path").agg(F.array_join(lines, separator).alias("text"), F.count(F.lit(1)).alias("n"))
    meta = F.create_map(F.lit("total_rows"), F.col("n").cast("string"), F.lit("headers"), F.lit(", ".join(names)))
    return own.select(F.col("path").alias("doc_id"), "text", meta.alias("metadata"))


def json_documents(values: DataFrame, text_key: str | None = None, metadata_keys: list[str] | None = None) -> DataFrame:
    """Documents of (path, index, value): value is a JSON object or scalar as text, keys in order."""
    fields = F.from_json("value", "map<string,string>")
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))
    own = F.coalesce(F.try_element_at(fields, F.lit(text_key)) if text_key else F.lit(None).cast("string"), ordered, F.col("value"))
    if metadata_keys is not None:
        meta = F.map_filter(fields, lambda k, v: k.isin(metadata_keys))
    else:
        meta = F.map_filter(fields, lambda k, v: k != F.lit(text_key or ""))
    meta = F.coalesce(meta, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    meta = F.when(F.col("index") > 0, F.map_concat(F.map_filter(meta, lambda k, v: k != "index"), F.create_map(F.lit("index"), F.col("index").cast("string")))).otherwise(meta)
    return values.select(F.concat("path", F.lit("_"), F.col("index").cast("string")).alias("doc_id"), own.alias("text"), meta.alias("metadata"))


def json_files(
    spark: SparkSession, path: str, text_key: str | None = None, metadata_keys: list[str] | None = None, strict: bool = True
) -> DataFrame:
    """An array gives a document for each element, an object one, a .jsonl file one for each line that isn't blank.

    A broken value fails the read, naming its place; with strict=False it becomes a document without metadata whose error
    column names the place, and which is null in all others.

    Lines are read as such, so a large .jsonl file is many tasks; a line's index is its number among those of the file.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value")]
    read = reader.option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(path).select(*place)
    lines = read.withColumn("at", F.monotonically_increasing_id()).withColumn("held", (F.trim("value") != "").cast("long"))
    # a block's lines are in order in one task; blocks are numbered one after the other from their sizes
    sizes = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(F.col("path").alias("__p"), F.col("block").alias("__b"), F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    numbered = lines.withColumn("i", inside).join(first, (F.col("path") == F.col("__p")) & (F.col("block") == F.col("__b")))
    line = numbered.where("held = 1").select("path", (F.col("first") + F.col("i")).cast("int").alias("index"), "value")
    whole = whole_files(spark, path, "*.[jJ][sS][oO][nN]")
    many = F.from_json("content", "array<string>")
    rest = whole.select("path", F.posexplode(F.when(F.rlike("content", F.lit(r"^\s*\[")), many).otherwise(F.array("content"))).alias("index", "value"))
    every = line.unionByName(rest)
    place = F.concat(F.lit("malformed JSON in "), "path", F.lit(" at "), F.col("index").cast("string"))
    parsed = F.try_parse_json("value")
    broken = parsed.isNull() & F.col("value").isNotNull()
    value = F.when(F.is_variant_null(parsed), F.lit("null")).otherwise(F.col("value"))
    if strict:
        return json_documents(every.withColumn("value", F.when(broken, F.raise_error(place)).otherwise(value)), text_key, metadata_keys)
    good = json_documents(every.where(~broken).withColumn("value", value), text_key, metadata_keys)
    doc_id = F.concat("path", F.lit("_"), F.col("index").cast("string")).alias("doc_id")
    none = F.create_map().cast("map<string,string>").alias("metadata")
    bad = every.where(broken).select(doc_id, F.col("value").alias("text"), none, place.alias("error"))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def html_metadata(page: Column) -> Column:
    """Map with title, description, keywords and language where the page has them."""
    part = lambda p: F.nullif(trimmed(F.regexp_extract(page, "(?i)" + p, 1)), F.lit(""))
    values = {
        "title": part(r"<title[^>]*>([^<]+)</title>"),
        "description": F.coalesce(
            part(r"""<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']"""),
            part(r"""<meta[^>]+content=["']([^"']+)["'][^>]+name=["']description["']"""),
        ),
        "keywords": part(r"""<meta[^>]+name=["']keywords["'][^>]+content=["']([^"']+)["']"""),
        "language": part(r"""<html[^>]+lang=["']([^"']+)["']"""),
    }
    own = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return F.map_filter(own, lambda k, v: v.isNotNull())


# fixed values: named character references, &amp; last
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&mdash;": "—", "&ndash;": "–",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&hellip;": "…", "&lsquo;": "'", "&rsquo;": "'", "&ldquo;": "“",
    "&rdquo;": "”", "&bull;": "•", "&amp;": "&",
}
REMOVED = ("script", "style", "noscript", "iframe", "svg")
BLOCKS = "div|p|br|li|tr|h1|h2|h3|h4|h5|h6|blockquote|pre"


def html_text(page: Column, only: tuple[str, ...] = (), removed: tuple[str, ...] = REMOVED, numeric=None) -> Column:
    """The page's text: some elements removed, block tags as line ends, references decoded, white space collapsed."""
    t = page
    for tag in removed:
        t = F.regexp_replace(F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", ""), rf"(?i)<{tag}\b[^>]*/?>", "")
    t = F.regexp_replace(t, r"<!--[\s\S]*?-->", "")
    if only:
        parts = [F.regexp_extract_all(t, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)) for tag in only]
        t = F.array_join(F.transform(F.concat(*parts), lambda x: F.concat(x, F.lit("\n"))), "")
    else:
        body = r"(?is)<body[^>]*>(.*?)</body>"
        t = let(t, lambda x: F.when(F.rlike(x, F.lit(body)), F.regexp_extract(x, body, 1)).otherwise(x))
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = let(t, lambda x: F.when(F.contains(x, F.lit("&")), let(_named_references(x), numeric or decimal_references)).otherwise(x))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return trimmed(t)


def _named_references(t: Column) -> Column:
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def decimal_references(t: Column) -> Column:
    """&#NNN; decoded natively: what stands between the references is joined with their characters."""
    pattern = r"&#(\d+);"
    codes = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    # a character of a code point, by way of UTF-32
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.try_cast("bigint")), 8, "0")), "UTF-32")
    fits = lambda c: c.try_cast("bigint").between(1, 0x10FFFE) & ~c.try_cast("bigint").between(0xD800, 0xDFFF)
    shown = F.transform(codes, lambda c: F.when(fits(c), char(c)).otherwise(F.concat(F.lit("&#"), c, F.lit(";"))))
    pairs = F.zip_with(F.split(t, pattern, -1), shown, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(F.rlike(t, F.lit(pattern)), F.array_join(pairs, "")).otherwise(t)


def html_files(spark: SparkSession, path: str, only: tuple[str, ...] = ()) -> DataFrame:
    files = whole_files(spark, path, GLOBS["html"])
    return files.select(F.col("path").alias("doc_id"), html_text(F.col("content"), only).alias("text"), html_metadata(F.col("content")).alias("metadata"))


def markdown_text(text: Column, links: bool = True, images: bool = True) -> Column:
    """Links as their text, images removed."""
    if links:
        text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]+\)", "") if images else text


def front_matter(text: Column) -> Column:
    """Map of the key: value lines between leading --- lines."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^[^:]+:")))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"),
        ),
    )
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["key"]))
    return F.map_from_entries(last)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")


def markdown_sections(docs: DataFrame, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(doc_id, section_index, header, header_level, text): a section for each header of the levels; its line stays.

    The text is cut before such headers, in the row itself.
    """
    marks = "|".join("#" * n for n in levels)
    parts = F.split("text", rf"(?m)^(?=(?:{marks})[ \t]+\S)", -1)
    kept = F.filter(parts, lambda p: F.trim(p) != "")
    own = docs.select("doc_id", F.posexplode(kept).alias("section_index", "text"))
    mark = F.regexp_extract("text", rf"^({marks})[ \t]+", 1)
    return own.select(
        "doc_id",
        "section_index",
        F.regexp_extract("text", rf"^(?:{marks})[ \t]+([^\n]*)", 1).alias("header"),
        F.length(mark).alias("header_level"),
        trimmed(F.col("text")).alias("text"),
    )


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    files = whole_files(spark, path, GLOBS["markdown"])
    return files.select(F.col("path").alias("doc_id"), markdown_text(without_front_matter(F.col("content"))).alias("text"), front_matter(F.col("content")).alias("metadata"))


def _documents(files: DataFrame, read: Callable[[str, bytes], Iterator[tuple[str, str, dict]]]) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in read(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "metadata"])

    return files.mapInPandas(run, DOCUMENT)


def _letters(name: str) -> int:
    n = 0
    for c in name.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> dict[str, list[list[str]]]:
    """Sheets by name with their rows as strings."""
    x = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{x}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{x}t")))
        rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{x}sheet"):
            target = targets[s.get(rel)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{x}row"):
                cells: list[str] = []
                for c in row.iter(f"{x}c"):
                    at = _letters(re.match("[A-Z]+", c.get("r", "A"))[0])
                    cells += [""] * (at + 1 - len(cells))
                    v = c.find(f"{x}v")
                    value = "".join(t.text or "" for t in c.iter(f"{x}t")) if v is None else (v.text or "")
                    cells[at] = shared[int(value)] if c.get("t") == "s" else value
                rows.append(cells)
            out[s.get("name")] = rows
    return out


def excel_files(spark: SparkSession, path: str, sheets: tuple[str, ...] = (), by_row: bool = True) -> DataFrame:
    """A document for each row (empty rows are left out) or for each sheet."""
    wanted = {s.lower() for s in sheets}

    def read(p, content):
        for name, rows in sheet_rows(content).items():
            if (wanted and name.lower() not in wanted) or not rows:
                continue
            headers, body = rows[0], [r for r in rows[1:] if any(c.strip() for c in r)]
            if by_row:
                for i, r in enumerate(body):
                    text = "\n".join(f"{h}: {c.strip()}" for h, c in zip(headers, r, strict=False) if c.strip())
                    yield f"{p}_{name}_row_{i}", text, {"sheet": name, "row": str(i + 1)}
            else:
                lines = [" | ".join(c.strip() for c in r if c.strip()) for r in body]
                yield f"{p}_{name}", f"## {name}\n" + "\n".join(lines), {"sheet": name, "total_rows": str(len(body))}

    return _documents(_binary(spark, path, GLOBS["excel"], True), read)


def docx_text(content: bytes) -> tuple[str, dict]:
    """Paragraphs by lines, tables as ' | ' rows, and the core properties."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        lines = []
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        for e in body if body is not None else []:
            if e.tag == f"{w}p":
                lines.append(text(e))
            elif e.tag == f"{w}tbl":
                lines += [" | ".join(text(c) for c in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
        meta = {}
        if "docProps/core.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                if e.text and e.text.strip():
                    meta[e.tag.rpartition("}")[2]] = e.text.strip()
    return "\n".join(x for x in lines if x.strip()), meta


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    def read(p, content):
        text, meta = docx_text(content)
        yield p, text, meta

    return _documents(_binary(spark, path, GLOBS["docx"], True), read)


def pdf_files(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None, by_page: bool = True) -> DataFrame:
    """Documents of a page each, or of all pages; `pages` reads a file, as no PDF library is part of this package."""
    if pages is None:
        raise ValueError("pass pages, a function from a PDF's bytes to its pages' texts")

    def read(p, content):
        texts = pages(content)
        if not any(t.strip() for t in texts):
            raise ValueError(f"{p} has no text")
        if by_page:
            for i, t in enumerate(texts):
                yield f"{p}_page_{i + 1}", t, {"page_number": str(i + 1)}
        else:
            yield p, "\n\n".join(texts), {"total_pages": str(len(texts))}

    return _documents(_binary(spark, path, GLOBS["pdf"], True), read)
