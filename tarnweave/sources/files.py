"""Scans: JSON in its forms, text trees, documents of many formats, registries, manifests, archives."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.functions import text
from tarnweave.operators import knowledge

IGNORED = (".git", "__pycache__", "node_modules", ".venv")
FORMATS = (".md", ".txt", ".docx", ".pdf", ".json", ".jsonl", ".html", ".htm")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a missing path is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def text_items(spark: SparkSession, path: str, keys: Sequence[str] = ("text", "content", "input", "output", "question", "answer", "query"), least: int = 20) -> DataFrame:
    """(path, line, text): values of the given keys at any depth of JSON, and blocks between empty lines of other texts."""
    wanted = frozenset(keys)

    def walk(x: object) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, str) and k in wanted:
                    yield v
                else:
                    yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                body = content.decode("utf-8", "replace")
                if name.endswith((".json", ".jsonl")):
                    units = enumerate(body.splitlines(), 1) if name.endswith(".jsonl") else [(1, body)]
                    for line, unit in units:
                        try:
                            rows += [(name, line, t) for t in walk(json.loads(unit))] if unit.strip() else []
                        except ValueError:
                            rows.append((name, line, unit))
                else:
                    rows += [(name, i, b) for i, b in enumerate(re.split(r"\n\s*\n", body), 1)]
            yield pd.DataFrame([(p, n, t.strip()) for p, n, t in rows if len(t.strip()) >= least], columns=["path", "line", "text"])

    return binary_files(spark, path, (".json", ".jsonl", ".md", ".txt", ".csv")).select("path", "content").mapInPandas(run, "path string, line long, text string")


def canonical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole texts of files; JSON lines each as compact JSON with sorted keys."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            try:
                return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return x

        return s.map(one)

    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).where("trim(value) <> ''")
    lines = lines.select(F.input_file_name().alias("path"), canonical("value").alias("text"))
    others = binary_files(spark, path, (".md", ".txt", ".json")).select("path", F.decode("content", "UTF-8").alias("text"))
    return lines.unionByName(others)


def binary_files(spark: SparkSession, path: str, extensions: Sequence[str] = FORMATS, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """Files below a path with one of the extensions and no ignored folder on the way; with sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return files.where(suffix.isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored)))).withColumns({"extension": suffix, "sha256": F.sha2("content", 256)})


def discovered(files: DataFrame, registry: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Files whose path names a registered source, with its columns and what the manifest says of the file."""
    source = F.coalesce(F.nullif(F.regexp_extract("path", r"/raw/auto/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"/raw/manual/(?:textbooks|papers|campus|official)/([^/.]+)", 1), F.lit("")))
    rows = files.withColumn("source_id", source).join(registry, "source_id")
    if manifest is None:
        return rows
    extra = [c for c in manifest.columns if c not in rows.columns]
    return rows.join(manifest.select(F.col("file_path").alias("_p"), *(c for c in extra if c != "file_path")).dropDuplicates(["_p"]), F.expr("endswith(path, _p)"), "left").drop("_p")


def latest_manifest(parts: Sequence[DataFrame]) -> DataFrame:
    """(key, ...) of manifests in their order, by file_path and by source_id; the last row of a key wins."""
    rows = None
    for i, df in enumerate(parts):
        df = df.withColumn("_seq", F.struct(F.lit(i), F.monotonically_increasing_id()))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    keyed = rows.withColumn("key", F.explode(F.array_compact(F.array("file_path", "source_id"))))
    names = [c for c in rows.columns if c != "_seq"]
    return keyed.groupBy("key").agg(F.max_by(F.struct(*names), "_seq").alias("r")).select("key", "r.*")


def registry(spark: SparkSession, rows: Sequence[dict], domains: Sequence[str], collections: Sequence[str], fields: Sequence[str] = ("source_id", "title", "organization", "official_page_url", "target_collection", "use_mode", "license")) -> DataFrame:
    """Registered sources from parsed configuration; a repeated id, a bad URL or an unknown collection fails the job.

    ``rows`` come from a configuration file that people keep, so they are small.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField("raw", T.MapType(T.StringType(), T.StringType()))])
    ids = [r.get("source_id") for r in rows]
    if len(set(ids)) < len(ids) or not all(ids):
        raise ValueError("source ids must be given and unique")
    df = spark.createDataFrame([(*(str(r.get(f) or "") for f in fields), {k: str(v) for k, v in r.items()}) for r in rows], schema)
    ok = text.domain_allowed(F.col("official_page_url"), domains) & F.col("official_page_url").rlike("^https?://")
    df = df.withColumn("official_page_url", F.when(ok, F.col("official_page_url")).otherwise(F.raise_error(F.concat(F.lit("URL not allowed: "), F.col("official_page_url"))).cast("string")))
    known = F.col("target_collection").isin(*collections)
    return df.withColumn("target_collection", F.when(known, F.col("target_collection")).otherwise(F.raise_error(F.concat(F.lit("unknown collection: "), F.col("target_collection"))).cast("string")))


# --- documents --------------------------------------------------------------

# What of a page is dropped, and what is text.
DROPPED = frozenset(("script", "style", "noscript", "svg", "nav", "footer", "header", "aside"))
DROPPED_CLASSES = frozenset(("cookie", "cookies", "breadcrumb", "breadcrumbs", "related", "menu", "navigation"))
SPOKEN = frozenset(("h1", "h2", "h3", "h4", "p", "li", "td", "th"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Page(HTMLParser):
    """Gathers the title, and the text of each element that is text; text within two such elements counts for both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.hidden = 0
        self.title: list[str] = []
        self.pieces: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        drop = tag in DROPPED or bool(classes & DROPPED_CLASSES)
        place = -1
        if tag in SPOKEN and not drop and not self.hidden:
            place = len(self.pieces)
            self.pieces.append([])
        self.open.append((tag, -2 if drop else place))
        self.hidden += drop

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _ in self.open):
            return
        while self.open:
            name, place = self.open.pop()
            self.hidden -= place == -2
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        words = data.strip()
        if not words or self.hidden:
            return
        if any(t == "title" for t, _ in self.open):
            self.title.append(words)
        for _, place in self.open:
            if place >= 0:
                self.pieces[place].append(words)


def page_text(html: str) -> str:
    """The title and the text elements of a page, parted by empty lines."""
    page = _Page()
    page.feed(html)
    page.close()
    return "\n\n".join(p for p in (" ".join(x) for x in [page.title, *page.pieces]) if p)


def html_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: page_text(x or ""))

    return run(text.text_or_empty(c))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file; a broken file raises ValueError."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            root = ElementTree.fromstring(package.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile) as e:
        raise ValueError("not a DOCX file") from e
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in root.iter(f"{w}p"))
    return "\n\n".join(x for x in lines if x)


def pdf_text(content: bytes) -> str:
    """The pages of a PDF file, where the optional parser is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("pdf_parser_unavailable") from e
    return "\n\n".join((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages)


def documents(files: DataFrame) -> DataFrame:
    """(path, extension, text, error) of binary files; a file that can't be read is a row with an error, not an end of the job."""
    readers = {".docx": docx_text, ".pdf": pdf_text, ".html": lambda b: page_text(b.decode("utf-8", "ignore")), ".htm": lambda b: page_text(b.decode("utf-8", "ignore"))}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, ext, content in zip(part["path"], part["extension"], part["content"], strict=True):
                try:
                    rows.append((path, ext, readers.get(ext, lambda b: b.decode("utf-8"))(content), None))
                except ValueError as e:
                    rows.append((path, ext, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "extension", "text", "error"])

    return files.select("path", "extension", "content").mapInPandas(run, "path string, extension string, text string, error string")


def sections(docs: DataFrame) -> DataFrame:
    """(path, section_no, section, content) of read documents, each split as its format wants."""
    title = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    good = docs.where("text is not null").withColumns({"title": title, "text": F.when(F.col("extension").isin(".json", ".jsonl"), F.col("text")).otherwise(knowledge.tidy(F.col("text")))})
    lines = good.where("extension = '.jsonl'").withColumn("text", F.concat(F.lit("["), F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: ~text.is_blank(x)), lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x).otherwise(F.to_json(F.struct(x.alias("content"))))), ","), F.lit("]")))
    made = [
        knowledge.markdown_sections(good.where("extension = '.md'"), "path", "text", "title"),
        knowledge.json_sections(good.where("extension = '.json'").unionByName(lines), "path", "text", "title"),
        knowledge.plain_sections(good.where("extension not in ('.md', '.json', '.jsonl')"), "path", "text", "title"),
    ]
    cast = [m.select("path", F.col("section_no").cast("long").alias("section_no"), "section", "content") for m in made]
    return cast[0].unionByName(cast[1]).unionByName(cast[2])


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, content) of zip files; a member whose path leads out of the archive fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    for info in package.infolist():
                        if info.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", info.filename) or re.match(r"[A-Za-z]:", info.filename):
                            raise ValueError(f"unsafe path in archive: {info.filename}")
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [package.read(info)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation cases from JSON lines: (case_id, dataset, turns as texts, tags, expected as JSON); ``limit`` takes the first by id."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    turns = F.from_json(get("turns"), "array<string>")
    said = F.transform(turns, lambda t: F.when(t.startswith("{"), F.coalesce(F.get_json_object(t, "$.content"), F.get_json_object(t, "$.text"), F.lit(""))).otherwise(t))
    rows = raw.select(get("case_id").alias("case_id"), get("dataset").alias("dataset"), said.alias("turns"), F.from_json(get("tags"), "array<string>").alias("tags"), get("expected").alias("expected"))
    return rows.orderBy("case_id").limit(limit) if limit else rows


def pack_catalogue(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(dataset, n, ready): the declared datasets with their cases; one without cases isn't ready."""
    counts = rows.groupBy("dataset").agg(F.count("*").alias("n"))
    return declared.select("dataset").join(counts, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ready"))


def review_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a review CSV; rows without a reviewer or with an unknown decision are dropped."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.replace("﻿", "") for c in rows.columns))
    decision = F.lower(F.trim("decision"))
    return rows.withColumn("review_status", F.when(decision.isin("approve", "approved"), "approved").when(decision.isin("reject", "rejected"), "rejected").when(decision == "pending", "pending")).where(F.col("review_status").isNotNull() & ~text.is_blank(F.col("reviewed_by")))
