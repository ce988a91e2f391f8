"""Bulk ingest of nested XML archives and JSON archives.

Archives are never loaded whole. Spark lists the files, a first pass reads only the member
lists, and after a repartition every member is read by its own task, straight out of the
archive. Python does the unzipping and cuts text into documents; parsing is Spark's.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from json.decoder import WHITESPACE

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.functions.labels import EUROPEAN
from techatlas.functions.names import (
    framework_from_filename,
    parse_pub_date,
    safe_float,
    sanitize_entities,
    year_of,
)
from techatlas.operators.normalize import dedupe_first_wins, upsert_last_wins

#: Rows handed to Spark at a time.
BATCH = 256


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def select_files(
    spark: SparkSession, folder: str, glob: str = "*.zip", contains: str | None = None, recursive: bool = False
) -> DataFrame:
    """(path, file_name, length) of the files to import; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", file_name("path").alias("file_name"), "length")
    )
    if contains:
        files = files.where(F.col("file_name").contains(contains))
    return files


def _open(path: str):
    """A seekable handle on any file system pyarrow knows."""
    if path.startswith("file:"):
        return open("/" + path[len("file:") :].lstrip("/"), "rb")
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= BATCH:
            yield pd.DataFrame(buffer, columns=columns)
            buffer = []
    if buffer:
        yield pd.DataFrame(buffer, columns=columns)


def list_members(files: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, file_name, member, error) of the archives; only their directories are read."""
    columns = ["path", "file_name", "member", "error"]

    def listed(frames):
        def rows():
            for frame in frames:
                for path, name in zip(frame["path"], frame["file_name"]):
                    try:
                        with _open(path) as handle, zipfile.ZipFile(handle) as archive:
                            members = archive.namelist()
                    except (zipfile.BadZipFile, OSError) as e:
                        yield path, name, None, str(e)
                        continue
                    for member in members:
                        if member.startswith(prefix) and member.endswith(suffix):
                            yield path, name, member, None

        yield from _batches(rows(), columns)

    return files.select("path", "file_name").mapInPandas(listed, ", ".join(f"{c} string" for c in columns))


def _spread(members: DataFrame) -> DataFrame:
    """One archive's members go to many tasks; they are few rows, so the number is fixed."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "path", "member")


# --- nested XML archives -------------------------------------------------------------

_OPENING = re.compile(rb"<(?:\w+:)?exchange-document[\s>]")
_CLOSING = re.compile(rb"</(?:\w+:)?exchange-document>")
_CHUNK = 1 << 20


def _xml_documents(stream, chunk: int = _CHUNK) -> Iterator[tuple[bytes | None, str | None]]:
    """(document, error) of an XML file, read piece by piece; a last document without end is an error."""
    rest = b""
    while True:
        more = stream.read(chunk)
        rest += more
        end = 0
        while (opened := _OPENING.search(rest, end)) and (closed := _CLOSING.search(rest, opened.end())):
            end = closed.end()
            yield rest[opened.start() : end], None
        rest = rest[end:]
        opened = _OPENING.search(rest)
        if not more:
            if opened:
                yield None, "document without end"
            return
        # what comes before the next document is not needed, but an opening tag may be cut in two
        rest = rest[opened.start() :] if opened else rest[-64:]


def read_documents(files: DataFrame) -> DataFrame:
    """(file_name, member, position, doc, error, path): one row per XML document.

    Members are the zips below ``Root/DOC/``; every XML file in them is read, and documents are numbered through
    them. What cannot be read gives one row with the error instead.
    """
    columns = ["file_name", "member", "position", "doc", "error", "path"]

    def documents(frames):
        def rows():
            for frame in frames:
                for path, name, member, error in frame.itertuples(index=False):
                    if error is not None:
                        yield name, member, 0, None, error, path
                        continue
                    position = 0
                    try:
                        with _open(path) as handle, zipfile.ZipFile(handle) as outer:
                            inner = zipfile.ZipFile(io.BytesIO(outer.read(member)))
                        for xml in sorted(m for m in inner.namelist() if m.endswith(".xml")):
                            with inner.open(xml) as stream:
                                for doc, problem in _xml_documents(stream):
                                    yield name, member, position, doc and doc.decode("utf-8", "replace"), problem, path
                                    position += 1
                    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError) as e:
                        yield name, member, position, None, str(e), path

        yield from _batches(rows(), columns)

    members = _spread(list_members(files, "Root/DOC/", ".zip"))
    return members.mapInPandas(
        documents, "file_name string, member string, position long, doc string, error string, path string"
    )


DOCUMENT_SCHEMA = """
`_country` string, `_doc-number` string, `_kind` string, `_date-publ` string, `_family-id` string,
`bibliographic-data` struct<
  `invention-title`: array<struct<`_lang`: string, `_VALUE`: string>>,
  `patent-classifications`: struct<`patent-classification`: array<struct<`classification-symbol`: string>>>,
  `classifications-ipcr`: struct<`classification-ipcr`: array<struct<`text`: string>>>,
  `parties`: struct<`applicants`: struct<`applicant`: array<struct<
    `_data-format`: string, `applicant-name`: struct<`name`: string>, `residence`: struct<`country`: string>>>>>>,
`_damaged` string
"""


def parse_documents(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """The documents' other columns, the parsed document ``d``, and ``reason`` it can't be a record (or null).

    Every document is parsed once: as a generated row ``d`` is a value to what comes after. As a plain column,
    every condition on it would be pushed below it with a parse of its own.
    """
    plain = F.regexp_replace(sanitize_entities(doc), r"(</?)[A-Za-z]\w*:", "$1")
    rest = [c for c in documents.columns if c != doc]
    once = F.from_xml(plain, DOCUMENT_SCHEMA, {"columnNameOfCorruptRecord": "_damaged"})
    parsed = documents.select(*rest, F.explode(F.array(once)).alias("d"))
    filled = (F.col("d._country") != "") & (F.col("d._doc-number") != "") & F.col("d.bibliographic-data").isNotNull()
    reason = F.when(F.col("d").isNull() | F.col("d._damaged").isNotNull(), "malformed XML").when(
        ~F.coalesce(filled, F.lit(False)), "no country, number or bibliographic data"
    )
    return parsed.withColumn("reason", reason)


def extract_record_fields(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """XML text to record columns; other columns of ``documents`` are kept.

    Documents that are malformed or lack country, number or bibliographic data are none; ``rejects`` lists them.
    Documents that went through ``parse_documents`` before are not parsed again.
    """
    parsed = parse_documents(documents, doc) if doc in documents.columns else documents
    rest = [c for c in parsed.columns if c not in ("d", "reason")]
    bib = F.col("d.bibliographic-data")

    def distinct_text(items: Column) -> Column:
        trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
        return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))

    titles = bib["invention-title"]
    english = F.filter(titles, lambda t: t["_lang"] == "en")
    first_english = F.trim(F.try_element_at(english, F.lit(1))["_VALUE"])
    first_any = F.trim(F.try_element_at(titles, F.lit(1))["_VALUE"])
    applicants = F.filter(
        bib["parties"]["applicants"]["applicant"], lambda a: a["_data-format"] == "docdb"
    )
    cpc = distinct_text(
        F.transform(bib["patent-classifications"]["patent-classification"], lambda x: x["classification-symbol"])
    )
    ipc = distinct_text(
        F.transform(bib["classifications-ipcr"]["classification-ipcr"], lambda x: F.substring(x["text"], 1, 15))
    )
    names = distinct_text(F.transform(applicants, lambda a: a["applicant-name"]["name"]))
    countries = distinct_text(F.transform(applicants, lambda a: a["residence"]["country"]))
    country, number = F.col("d._country"), F.col("d._doc-number")
    return (
        parsed.where("reason is null")
        .select(
            *rest,
            F.concat(country, number, F.coalesce(F.col("d._kind"), F.lit(""))).alias("publication_number"),
            country.alias("country"),
            number.alias("doc_number"),
            F.col("d._kind").alias("kind"),
            F.coalesce(F.nullif(first_english, F.lit("")), first_any, F.lit("")).alias("title"),
            parse_pub_date(F.col("d._date-publ")).alias("pub_date"),
            F.col("d._family-id").alias("family_id"),
            F.array_join(F.array_distinct(names), ", ").alias("applicant_names"),
            F.array_join(countries, ", ").alias("applicant_countries"),
            F.array_join(F.array_distinct(cpc), ", ").alias("codes"),
            F.array_join(F.array_distinct(ipc), ", ").alias("ipc_codes"),
        )
        .withColumn("pub_year", year_of("pub_date"))
    )


def rejects(documents: DataFrame) -> DataFrame:
    """What did not become a record, and why: unreadable archives and members, and unusable documents.

    Documents that went through ``parse_documents`` before are not parsed again.
    """
    parsed = parse_documents(documents) if "doc" in documents.columns else documents
    problem = F.coalesce("error", "reason").alias("error")
    return parsed.select("file_name", "member", "position", problem).where("error is not null")


#: Rows are imported in this order: files of one name in two folders differ in their path.
IMPORT_ORDER = ["path", "member", "position"]


def ingest_nested_archives(files: DataFrame) -> DataFrame:
    """Records of all archives, first one wins per publication number."""
    docs = read_documents(files).where("error is null").drop("error")
    return dedupe_first_wins(
        extract_record_fields(docs), ["publication_number"], IMPORT_ORDER
    )


# --- JSON archives -------------------------------------------------------------------


_MARKS = re.compile(r'\\.|["\[\]{},]', re.S)


def _checked(element: str) -> tuple[str | None, str | None]:
    try:
        json.loads(element)
    except ValueError as e:
        return None, f"damaged element: {e}"
    return element, None


_DECODER = json.JSONDecoder()


def _whole(text: str, begin: int, end: int) -> Iterator[tuple[str, int]]:
    """(element, where the next begins) of the sound elements from ``begin`` on, up to the first that needs a look at its marks."""
    while True:
        try:
            _, stop = _DECODER.raw_decode(text, WHITESPACE.match(text, begin).end())
        except ValueError:
            return
        stop = WHITESPACE.match(text, stop).end()
        if stop >= end or text[stop] != ",":
            return
        element, begin = text[begin:stop], stop + 1
        yield element, begin


def _elements(stream, chunk: int = _CHUNK) -> Iterator[tuple[str | None, str | None]]:
    """(element, error) of a JSON array, read piece by piece: every element is given or reported.

    Elements are cut at the commas outside strings and brackets, so one damaged element leaves the others whole.
    """
    text = io.TextIOWrapper(stream, "utf-8", errors="replace")
    held, depth, quoted, started = "", 0, False, False
    done: list[str] = []
    while True:
        more = text.read(chunk)
        held += more
        if not started:
            held = held.lstrip("\ufeff \t\r\n")
            if not held and more:
                continue
            if not held.startswith("["):
                yield None, "not a JSON array"
                return
            started, held = True, held[1:]
        # a backslash at the end belongs to the next piece
        tail = len(held) - len(held.rstrip("\\"))
        cut = len(held) - (tail % 2 if more else 0)
        begin, more_marks = 0, True
        while more_marks:
            if not (depth or quoted or done):
                for element, begin in _whole(held, begin, cut):
                    yield element, None
            more_marks = False
            for mark in _MARKS.finditer(held, begin, cut):
                sign = mark.group()
                if quoted:
                    quoted = sign != '"'
                elif sign == '"':
                    quoted = True
                elif sign in "[{":
                    depth += 1
                elif sign in "]}" and depth:
                    depth -= 1
                elif sign in ",]" and not depth:
                    element = "".join(done) + held[begin : mark.start()]
                    done, begin, more_marks = [], mark.end(), True
                    if element.strip() or sign == ",":
                        yield _checked(element)
                    if sign == "]":
                        return
                    break
        done.append(held[begin:cut])
        held = held[cut:]
        if not more:
            yield None, "the array ends early"
            return


def read_json_members(files: DataFrame, member: str = "", suffix: str = ".json") -> DataFrame:
    """(file_name, member, position, element, error, path) of the JSON arrays named ``member`` in the archives.

    What cannot be read, or is no JSON, gives a row with the error instead of the element.
    """
    columns = ["file_name", "member", "position", "element", "error", "path"]

    def elements(frames):
        def rows():
            for frame in frames:
                for path, name, inside, error in frame.itertuples(index=False):
                    if error is not None:
                        yield name, inside, 0, None, error, path
                        continue
                    position = 0
                    try:
                        with _open(path) as handle, zipfile.ZipFile(handle) as archive, archive.open(inside) as stream:
                            for element, problem in _elements(stream):
                                yield name, inside, position, element, problem, path
                                position += 1
                    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError) as e:
                        yield name, inside, position, None, str(e), path

        yield from _batches(rows(), columns)

    members = _spread(list_members(files, member, suffix))
    return members.mapInPandas(
        elements, "file_name string, member string, position long, element string, error string, path string"
    )


def json_rejects(files: DataFrame, member: str = "", key: str = "id") -> DataFrame:
    """Elements that did not become rows, and why: unreadable or damaged ones, and those whose ``key`` is no whole number."""
    read = read_json_members(files, member)
    value = F.from_json("element", f"`{key}` string")[key]
    problem = F.coalesce("error", F.when(value.try_cast("long").isNull(), f"no whole number as {key}"))
    return read.select("file_name", "member", "position", problem.alias("error")).where("error is not null")


PROJECT_SCHEMA = """id string, rcn string, acronym string, title string, objective string, keywords string,
startDate string, endDate string, status string, totalCost string, ecMaxContribution string,
fundingScheme string, topics string, legalBasis string, contentUpdateDate string"""

ORGANIZATION_SCHEMA = """organisationID string, projectID string, name string, shortName string, country string,
city string, role string, activityType string, SME string, ecContribution string, totalCost string"""

PUBLICATION_SCHEMA = """projectID string, title string, authors string, journalTitle string,
publicationDate string, doi string, openAccess string"""


def _of_member(elements: DataFrame, member: str, schema: str) -> DataFrame:
    """Elements of members with this name (all, if empty), parsed as ``e``."""
    return elements.where(F.startswith("member", F.lit(member))).withColumn("e", F.from_json("element", schema))


def projects_of(elements: DataFrame) -> DataFrame:
    """Project rows of ``read_json_members``, with their place in the import; ids may repeat."""
    e = _of_member(elements, "project.json", PROJECT_SCHEMA)
    return e.where(F.col("e.id").try_cast("long").isNotNull()).select(
        F.col("e.id").try_cast("long").alias("project_id"),
        "path",
        "member",
        "position",
        "file_name",
        F.col("e.rcn").try_cast("long").alias("rcn"),
        framework_from_filename("file_name").alias("framework"),
        F.col("e.acronym").alias("acronym"),
        F.coalesce("e.title", F.lit("")).alias("title"),
        F.col("e.objective").alias("objective"),
        F.col("e.keywords").alias("keywords"),
        F.col("e.startDate").alias("start_date"),
        F.col("e.endDate").alias("end_date"),
        F.col("e.status").alias("status"),
        safe_float("e.totalCost").alias("total_cost"),
        safe_float("e.ecMaxContribution").alias("ec_max_contribution"),
        F.col("e.fundingScheme").alias("funding_scheme"),
        F.col("e.topics").alias("topics"),
        F.col("e.legalBasis").alias("legal_basis"),
        F.col("e.contentUpdateDate").alias("cordis_update_date"),
        year_of(F.col("e.startDate")).alias("start_year"),
    )


def ingest_projects(files: DataFrame) -> DataFrame:
    """Projects of all archives; the later archive wins per project id."""
    rows = projects_of(read_json_members(files, "project.json"))
    return upsert_last_wins(rows, ["project_id"], IMPORT_ORDER)


def organizations_of(elements: DataFrame) -> DataFrame:
    """Participants of ``read_json_members``."""
    e = _of_member(elements, "organization.json", ORGANIZATION_SCHEMA)
    return e.where(F.col("e.projectID").try_cast("long").isNotNull()).select(
        F.col("e.organisationID").try_cast("long").alias("organisation_id"),
        F.col("e.projectID").try_cast("long").alias("project_id"),
        F.coalesce("e.name", F.lit("")).alias("name"),
        F.col("e.shortName").alias("short_name"),
        F.col("e.country").alias("country"),
        F.col("e.city").alias("city"),
        F.col("e.role").alias("role"),
        F.col("e.activityType").alias("activity_type"),
        F.col("e.SME").alias("sme"),
        safe_float("e.ecContribution").alias("ec_contribution"),
        safe_float("e.totalCost").alias("total_cost"),
    )


def ingest_organizations(files: DataFrame) -> DataFrame:
    """Project participants; archives without them add nothing."""
    return organizations_of(read_json_members(files, "organization.json"))


def publications_of(elements: DataFrame) -> DataFrame:
    """Project publications of ``read_json_members``: elements of any member that name a project."""
    e = _of_member(elements, "", PUBLICATION_SCHEMA)
    return e.where(F.col("e.projectID").try_cast("long").isNotNull()).select(
        F.col("e.projectID").try_cast("long").alias("project_id"),
        F.col("e.title").alias("title"),
        F.col("e.authors").alias("authors"),
        F.col("e.journalTitle").alias("journal"),
        F.col("e.publicationDate").alias("publication_date"),
        F.col("e.doi").alias("doi"),
        F.col("e.openAccess").alias("open_access"),
    )


def ingest_publications(files: DataFrame) -> DataFrame:
    """Project publications."""
    return publications_of(read_json_members(files))


# --- export --------------------------------------------------------------------------

#: Columns of the panel exports (panel column holding the rows, then its fields).
EXPORTS = {
    "landscape": ("time_series", ["year", "records", "projects", "publications", "records_growth", "projects_growth", "publications_growth"]),
    "maturity": ("time_series", ["year", "records", "cumulative", "fitted"]),
    "competitive": ("full_actors", ["rank", "name", "records", "projects", "total", "share", "country"]),
    "funding": ("time_series", ["year", "projects", "funding"]),
    "code_flow": ("pairs", ["code_a", "description_a", "code_b", "description_b", "jaccard"]),
    "geographic": ("country_distribution", ["country", "label", "is_european", "records", "projects", "total"]),
    "research_impact": ("top_papers", ["title", "year", "citations", "venue"]),
    "temporal": ("entrant_persistence_trend", ["year", "total_actors", "new_entrant_rate", "persistence_rate"]),
}


def export_rows(panel: DataFrame, name: str, countries: DataFrame | None = None) -> DataFrame:
    """Flat rows of a panel's export table.

    Rates are in percent with one decimal. ``countries`` (country, label, is_european) names the
    countries; without it codes stand for names.
    """
    column, fields = EXPORTS[name]
    rows = panel.select("tech", F.explode(column).alias("r")).select("tech", "r.*")
    if name == "geographic":
        if countries is None:
            rows = rows.withColumn("label", F.col("country")).withColumn("is_european", F.col("country").isin(EUROPEAN))
        else:
            rows = rows.join(countries.select("country", "label", "is_european"), "country", "left")
            rows = rows.withColumn("label", F.coalesce("label", "country"))
            rows = rows.withColumn("is_european", F.coalesce("is_european", F.lit(False)))
    if name == "temporal":
        rates = ("new_entrant_rate", "persistence_rate")
        rows = rows.withColumns({c: F.round(F.col(c) * 100, 1) for c in rates})
    return rows.select("tech", *fields)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes only where needed and ``""`` for a quote inside."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
