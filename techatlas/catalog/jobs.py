"""Registered ingest, export and streaming jobs, on files Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from techatlas.catalog import archives as ar
from techatlas.catalog.oracle import BASE, ORACLE, oracle
from techatlas.catalog.queries import query
from techatlas.operators import aggregate as ag
from techatlas.session import materialize, shared_dir
from techatlas.sources import ingest as ig
from techatlas.streaming import jobs as st

RECORD_COLUMNS = ["publication_number", "country", "title", "pub_date", "family_id", "applicant_names", "codes"]
RECORD_SQL = """select concat(country, record_id, 'A1') publication_number, country, coalesce(title, 'Titel') title, pub_date, family_id, applicant_names, coalesce(codes, '') codes
  from records"""


def _archive_folder(c) -> str:
    """A folder of nested archives holding all records."""
    folder = shared_dir(c.spark, "archives")
    ar.write_nested_archives(ar.record_documents(c.star.records()), folder).write.format("noop").mode("overwrite").save()
    return folder


@query
def ingest_nested_archive(c):
    files = ig.select_files(c.spark, _archive_folder(c))
    return ig.ingest_nested_archives(files).select(*RECORD_COLUMNS)


oracle("ingest_nested_archive", RECORD_SQL)


@query
def extract_record_fields(c):
    return ig.extract_record_fields(ar.record_documents(c.star.records())).select(
        "record_id", "publication_number", "title", "pub_year", "applicant_countries", "ipc_codes"
    )


oracle(
    "extract_record_fields",
    """select record_id, concat(country, record_id, 'A1') publication_number, coalesce(title, 'Titel') title, pub_year, applicant_countries, 'A01B   1/00   2' ipc_codes from records""",
)


def _partly_broken(c):
    """All records as documents: of every 10, one is cut short and one has no country."""
    docs = ar.record_documents(c.star.records())
    broken = F.replace("doc", F.lit("</exch:bibliographic-data>"), F.lit(""))
    nowhere = F.regexp_replace("doc", 'country="[^"]*"', 'country=""')
    kind = F.col("record_id") % 10
    return docs.withColumn("doc", F.when(kind == 0, broken).when(kind == 1, nowhere).otherwise(F.col("doc")))


@query
def import_outcome(c):
    """Accepted and rejected documents of a damaged import add up to its input."""
    folder = shared_dir(c.spark, "damaged")
    ar.write_nested_archives(_partly_broken(c), folder).write.format("noop").mode("overwrite").save()
    docs = materialize(ig.parse_documents(ig.read_documents(ig.select_files(c.spark, folder))), "documents")
    kept = ig.extract_record_fields(docs.where("error is null").drop("error")).select(F.lit("accepted").alias("outcome"))
    return kept.unionAll(ig.rejects(docs).select("error")).groupBy("outcome").agg(F.count("*").alias("n"))


oracle(
    "import_outcome",
    """select case record_id % 10 when 0 then 'malformed XML' when 1 then 'no country, number or bibliographic data' else 'accepted' end outcome,
  count(*) n from records group by 1""",
)


@query
def resumed_import_records(c):
    """Records of an import in two runs with archives that overlap; equal to a bulk import of the same."""
    folder, out = shared_dir(c.spark, "resumed"), shared_dir(c.spark, "import")
    docs = ar.record_documents(c.star.records())
    early = docs.where("record_id % 3 > 0")
    ar.write_nested_archives(early, folder).write.format("noop").mode("overwrite").save()
    st.resume_ingest(c.spark, folder, out).awaitTermination()
    # everything again, under later names: only what is new may be added
    again = docs.withColumn("record_id", F.col("record_id") + ar.OUTER * 1_000_000)
    ar.write_nested_archives(again, folder).write.format("noop").mode("overwrite").save()
    st.resume_ingest(c.spark, folder, out).awaitTermination()
    return st.imported(c.spark, out, "records").select("publication_number", "title", "pub_date", "doc_number", "kind")


oracle(
    "resumed_import_records",
    """select concat(country, record_id, 'A1') publication_number, coalesce(title, 'Titel') title, pub_date, record_id::varchar doc_number, 'A1' kind from records""",
)


@query
def resumed_import_reversed(c):
    """Late archives arrive first, with other titles: earlier ones replace them, as if all had been imported at once."""
    folder, out = shared_dir(c.spark, "reversed"), shared_dir(c.spark, "import")
    docs = ar.record_documents(c.star.records())
    late = docs.where("record_id % 3 > 0").select(
        (F.col("record_id") + ar.OUTER * 1_000_000).alias("record_id"), F.replace("doc", F.lit('lang="en"> '), F.lit('lang="en">late ')).alias("doc")
    )
    for part in (late, docs):
        ar.write_nested_archives(part, folder).write.format("noop").mode("overwrite").save()
        st.resume_ingest(c.spark, folder, out).awaitTermination()
    records = st.imported(c.spark, out, "records")
    links = st.imported(c.spark, out, "code_links").groupBy("record_id").agg(F.count("*").alias("n_codes"))
    return records.join(links, "record_id", "left").select(
        "publication_number", "title", "pub_date", F.coalesce("n_codes", F.lit(0)).alias("n_codes")
    )


oracle(
    "resumed_import_reversed",
    """select concat(country, record_id, 'A1') publication_number, coalesce(title, 'Titel') title, pub_date, coalesce(n, 0) n_codes
  from records left join (select record_id, count(*) n from record_code group by 1) using (record_id)""",
)


@query
def file_selection(c):
    chosen = ig.select_files(c.spark, _archive_folder(c), "docdb_*.zip", contains="0", recursive=True)
    return chosen.select("file_name").orderBy("file_name")


oracle(
    "file_selection",
    f"select distinct 'docdb_' || lpad((o_orderkey // {ar.OUTER})::varchar, 9, '0') || '.zip' file_name from orders",
    "",
)


def _projects_json(c, folder: str | None = None, keep: str = "true", name=None, **other) -> str:
    """Archives of the projects for which ``keep`` holds, with ``other`` columns in place of theirs."""
    folder = folder or shared_dir(c.spark, "projects")
    p = c.star.projects().where(keep).withColumns(other).select(
        F.col("project_id").alias("id"),
        "acronym",
        "title",
        "objective",
        "keywords",
        F.col("start_date").alias("startDate"),
        "status",
        F.col("total_cost").cast("string").alias("totalCost"),
        F.when(F.col("ec_max_contribution").isNull(), "n/a")
        .otherwise(F.col("ec_max_contribution").cast("string"))
        .alias("ecMaxContribution"),
        F.col("funding_scheme").alias("fundingScheme"),
        F.coalesce("framework", F.lit("other")).alias("_framework"),
    )
    name = F.concat(F.lit("cordis-"), F.col("_framework")) if name is None else name
    ar.write_json_archives(p, folder, "project.json", name).write.format("noop").mode("overwrite").save()
    return folder


@query
def ingest_json_projects(c):
    files = ig.select_files(c.spark, _projects_json(c))
    return ig.ingest_projects(files).select(
        "project_id", "framework", "acronym", "title", "objective", "keywords", "start_date", "start_year", "total_cost",
        "ec_max_contribution", "funding_scheme",
    )


oracle(
    "ingest_json_projects",
    """select project_id, coalesce(framework, 'UNKNOWN') framework, acronym, coalesce(title, '') title, objective, keywords, start_date, start_year,
  total_cost, ec_max_contribution, funding_scheme from projects""",
)


@query
def projects_over_runs(c):
    """Archives that overlap, in four runs: a new version, one that failed and is repeated, and an old version that comes late."""
    folder, out = shared_dir(c.spark, "projects"), shared_dir(c.spark, "import")

    def broken():
        raise RuntimeError("the run ends here")

    def add(name: str, keep: str, **other):
        _projects_json(c, folder, keep, F.lit(name), **other)

    add("cordis-2-h2020", "project_id % 3 > 0", title=F.lit("second"), start_date=F.lit("1990-01-01"))
    st.import_projects(c.spark, folder, out)
    add("cordis-3-h2020", "true")
    try:
        st.import_projects(c.spark, folder, out, before_commit=broken)
    except RuntimeError:
        pass
    st.import_projects(c.spark, folder, out)
    add("cordis-1-h2020", "project_id % 2 = 0", title=F.lit("first"))
    add("cordis-4-h2020", "project_id % 7 = 0", title=F.concat(F.lit("fourth "), F.col("acronym")))
    st.import_projects(c.spark, folder, out)
    return st.imported_projects(c.spark, out).select("project_id", "framework", "title", "keywords", "start_date", "start_year")


oracle(
    "projects_over_runs",
    """select project_id, 'H2020' framework, case when project_id % 7 = 0 then 'fourth ' || acronym else coalesce(title, '') end title, keywords, start_date, start_year
  from projects""",
)


@query
def ingest_json_organizations(c):
    folder = shared_dir(c.spark, "organizations")
    o = c.star.organizations().select(
        F.col("project_id").alias("projectID"), "name", "country", "city", "role", F.col("sme").alias("SME")
    )
    ar.write_json_archives(o, folder, "organization.json", F.lit("cordis")).write.format("noop").mode("overwrite").save()
    files = ig.select_files(c.spark, folder)
    return ig.ingest_organizations(files).select("project_id", "name", "country", "city", "role", "sme")


oracle("ingest_json_organizations", "select project_id, name, country, city, role, sme from organizations")


@query
def ingest_json_publications(c):
    folder = shared_dir(c.spark, "publications")
    p = c.star.raw("documents").select(
        F.col("doc_id").alias("projectID"), F.col("text").alias("title"), F.col("source").alias("journalTitle")
    )
    ar.write_json_archives(p, folder, "projectPublications.json", F.lit("pubs")).write.format("noop").mode("overwrite").save()
    files = ig.select_files(c.spark, folder)
    return ig.ingest_publications(files).select("project_id", "title", "journal")


oracle("ingest_json_publications", "select doc_id project_id, text title, source journal from documents", "")


@query
def resume_ingest(c):
    """The ledger after two runs over the same folder: the second imports nothing."""
    folder, out = _archive_folder(c), shared_dir(c.spark, "import")
    for _ in range(2):
        st.resume_ingest(c.spark, folder, out).awaitTermination()
    return c.spark.read.parquet(f"{out}/ledger").select("file_name", "records")


oracle(
    "resume_ingest",
    f"""select 'docdb_' || lpad((o_orderkey // {ar.OUTER})::varchar, 9, '0') || '.zip' file_name, count(*) records from orders
  join customer on o_custkey = c_custkey group by 1""",
    "",
)


@query
def records_by_year_stream(c):
    """Records arrive as files; the running count equals ``records_by_year``."""
    folder, out = shared_dir(c.spark, "arriving"), shared_dir(c.spark, "counts")
    arriving = c.star.records().select("record_id", "title", "codes", "pub_year")
    arriving.repartition(8, "record_id").write.parquet(folder)
    schema = "record_id long, title string, codes string, pub_year int"
    st.count_new_records(c.spark, folder, c.an.terms, out, schema).awaitTermination()
    return st.latest_counts(c.spark, out)


oracle("records_by_year_stream", "select * from rby")


@query
def records_by_year_redelivered(c):
    """Every record arrives twice, over three starts of the stream; each counts once."""
    folder, out = shared_dir(c.spark, "arriving"), shared_dir(c.spark, "counts")
    arriving = c.star.records().select("record_id", "title", "codes", "pub_year")
    arriving = materialize(arriving, "records")
    schema = "record_id long, title string, codes string, pub_year int"
    for part in ("record_id % 2 = 0", "record_id % 3 > 0", "record_id % 2 = 1 or record_id % 3 = 0"):
        arriving.where(part).repartition(4, "record_id").write.mode("append").parquet(folder)
        st.count_new_records(c.spark, folder, c.an.terms, out, schema).awaitTermination()
    return st.latest_counts(c.spark, out)


oracle("records_by_year_redelivered", "select * from rby")


@query
def export_csv(c):
    """A panel table written as CSV and read back."""
    path = shared_dir(c.spark, "csv")
    ig.export_csv(ag.top_actor_strings(c.an.records), path)
    return c.spark.read.option("header", True).option("escape", '"').schema(
        "tech string, applicant_names string, n long"
    ).csv(path)


oracle("export_csv", ORACLE["top_actor_strings"].removeprefix(BASE))
