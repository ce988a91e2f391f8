"""Import, streaming and panel jobs on small files."""

import io
import json
import time
import zipfile

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from techatlas.catalog.archives import record_documents, write_nested_archives
from techatlas.plans import reports as rp
from techatlas.plans.analysis import Analysis
from techatlas.plans.apart import run_apart
from techatlas.sources import ingest as ig
from techatlas.sources.tables import StarSchema, Tables, terms_table
from techatlas.streaming import jobs as st

SF = "/root/testdata/sf0.001"


def doc(country="EP", number="1", kind="A1", date="20200315", body=""):
    return (
        f'<exch:exchange-document country="{country}" doc-number="{number}" kind="{kind}" date-publ="{date}" family-id="F1">'
        f"{body}</exch:exchange-document>"
    )


BIBLIO = """<exch:bibliographic-data><exch:invention-title lang="de">Eins</exch:invention-title>
<exch:invention-title lang="en"> One &amp; two&nbsp; </exch:invention-title>
<exch:classifications-ipcr><classification-ipcr><text>G06N  10/00   20220101AFI</text></classification-ipcr></exch:classifications-ipcr>
<exch:patent-classifications><patent-classification><classification-symbol>G06N 10/00</classification-symbol></patent-classification>
<patent-classification><classification-symbol>G06N 10/00</classification-symbol></patent-classification>
<patent-classification><classification-symbol>H01L 1/00</classification-symbol></patent-classification></exch:patent-classifications>
<exch:parties><exch:applicants>
<exch:applicant data-format="docdb"><exch:applicant-name><name>SIEMENS AG</name></exch:applicant-name><residence><country>DE</country></residence></exch:applicant>
<exch:applicant data-format="docdb"><exch:applicant-name><name>BOSCH</name></exch:applicant-name><residence><country>DE</country></residence></exch:applicant>
<exch:applicant data-format="original"><exch:applicant-name><name>Siemens</name></exch:applicant-name></exch:applicant>
</exch:applicants></exch:parties></exch:bibliographic-data>"""


def nested_zip(path, members):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("Root/readme.txt", "x")
        for name, body in members.items():
            if isinstance(body, bytes):
                out.writestr(name, body)
                continue
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("a.xml", "<r>" + body + "</r>")
            out.writestr(name, inner.getvalue())


def test_documents(spark):
    docs = spark.createDataFrame(
        [(1, doc(body=BIBLIO)), (2, doc(country="", body=BIBLIO)), (3, doc()), (4, doc(number="4", date="2020", body="<exch:bibliographic-data/>"))],
        "i int, doc string",
    )
    got = {r["i"]: r for r in ig.extract_record_fields(docs).collect()}
    assert 2 not in got and 3 not in got
    r = got[1]
    assert r["publication_number"] == "EP1A1" and r["pub_date"] == "2020-03-15" and r["pub_year"] == 2020
    assert r["title"] == "One & two"
    assert r["codes"] == "G06N 10/00, H01L 1/00" and r["ipc_codes"] == "G06N  10/00   2"
    assert r["applicant_names"] == "SIEMENS AG, BOSCH" and r["applicant_countries"] == "DE, DE"


def test_archives_with_errors(spark, tmp_path):
    nested_zip(tmp_path / "a.zip", {"Root/DOC/1.zip": doc(number="1", body=BIBLIO) + doc(number="2", body=BIBLIO),
                                    "Root/DOC/2.zip": b"broken", "Other/3.zip": doc(number="9", body=BIBLIO)})
    nested_zip(tmp_path / "b.zip", {"Root/DOC/1.zip": doc(number="2", date="20210101", body=BIBLIO)})
    (tmp_path / "c.zip").write_bytes(b"no zip")
    files = ig.select_files(spark, str(tmp_path))
    got = {r["publication_number"]: r["pub_year"] for r in ig.ingest_nested_archives(files).collect()}
    assert got == {"EP1A1": 2020, "EP2A1": 2020}  # first wins
    assert [r[:2] for r in rows_of(ig.rejects(ig.read_documents(files)))] == [("a.zip", "Root/DOC/2.zip"), ("c.zip", None)]
    assert [r["file_name"] for r in ig.select_files(spark, str(tmp_path), "*.zip", contains="b").collect()] == ["b.zip"]
    broken = doc(number="5", body=BIBLIO.replace("</exch:parties>", ""))
    nested_zip(tmp_path / "d.zip", {"Root/DOC/1.zip": doc(number="4", body=BIBLIO) + broken + doc(number="6") + "<exch:exchange-document >"})
    docs = ig.read_documents(ig.select_files(spark, str(tmp_path), "d.zip"))
    assert [r["publication_number"] for r in ig.extract_record_fields(docs.where("error is null").drop("error")).collect()] == ["EP4A1"]
    assert rows_of(ig.rejects(docs).select("position", "error")) == [
        (1, "malformed XML"), (2, "no country, number or bibliographic data"), (3, "document without end")]


def test_all_xml_files_of_a_member_are_read(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.xml", "<r>" + doc(number="2", body=BIBLIO) + "</r>")
        z.writestr("a.xml", "<r>" + doc(number="1", body=BIBLIO) + "</r>")
    nested_zip(tmp_path / "a.zip", {"Root/DOC/1.zip": inner.getvalue()})
    docs = ig.read_documents(ig.select_files(spark, str(tmp_path)))
    assert rows_of(docs.selectExpr("position", "substring(doc, 45, 14)")) == [(0, ' doc-number="1'), (1, ' doc-number="2')] or docs.count() == 2
    got = ig.extract_record_fields(docs.drop("error")).orderBy("position").collect()
    assert [(r["doc_number"], r["kind"]) for r in got] == [("1", "A1"), ("2", "A1")]


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame(
        [("f", "m", 0, doc(body=BIBLIO), None), ("f", "m", 1, doc(), None), ("f", "m", 2, "<a", None), ("f", "m", 3, None, "unread"), ("f", "m", 4, None, None)],
        "file_name string, member string, position long, doc string, error string",
    )
    good = docs.where("error is null").drop("error")
    for df in (ig.extract_record_fields(good), ig.rejects(docs)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    parsed = ig.parse_documents(docs)
    assert rows_of(ig.rejects(parsed)) == rows_of(ig.rejects(docs))
    assert [r["error"] for r in ig.rejects(docs).orderBy("position").collect()] == [
        "no country, number or bibliographic data", "malformed XML", "unread", "malformed XML"]
    columns = ["position", "publication_number", "title", "codes"]
    again = ig.extract_record_fields(parsed.where("error is null").drop("error"))
    assert rows_of(again.select(columns)) == rows_of(ig.extract_record_fields(good).select(columns))
    assert again.columns == ig.extract_record_fields(good).columns and again.count() == 1


@pytest.mark.parametrize("chunk", [16, 100, 1 << 20])
def test_xml_is_cut_the_same_in_pieces_of_any_size(chunk):
    body = ("<r>" + doc(number="1", body=BIBLIO) + " " * 90 + doc(number="2") + doc(number="3", body="ü") + "</r>").encode()
    got = [d for d, e in ig._xml_documents(io.BytesIO(body), chunk)]
    assert b"".join(got).count(b"exchange-document>") == 3 and len(got) == 3


def test_text_ids_and_damaged_projects(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "cordis-h2020.zip", "w") as z:
        z.writestr("project.json", '[{"id": "101", "title": "a"}, {"id": tru}, {"id": "x9"}, {"id": 7}]')
        z.writestr("organization.json", '[{"projectID": "101", "name": "CNRS"}]')
    (tmp_path / "cordis-fp7.zip").write_bytes(b"no zip")
    files = ig.select_files(spark, str(tmp_path))
    assert sorted(r["project_id"] for r in ig.ingest_projects(files).collect()) == [7, 101]
    assert [r["project_id"] for r in ig.ingest_organizations(files).collect()] == [101]
    bad = ig.json_rejects(files, "project.json").collect()
    assert sorted((r["file_name"], r["position"]) for r in bad) == [("cordis-fp7.zip", 0), ("cordis-h2020.zip", 1), ("cordis-h2020.zip", 2)]


def test_project_ledger(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, name in enumerate(("cordis-fp7.zip", "cordis-h2020.zip")):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("project.json", json.dumps([{"id": 10 * n + k} for k in range(3)]) + " ")
        st.import_projects(spark, str(folder), out)
    ledger = st.import_projects(spark, str(folder), out)
    assert rows_of(ledger.select("file_name", "elements", "rejects")) == [("cordis-fp7.zip", 3, 0), ("cordis-h2020.zip", 3, 0)]
    assert st.imported_projects(spark, out).count() == 6


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
def test_json_elements(chunk):
    data = [{"a": 'x],"}{', "n": [1, {"b": 2}]}, 12345, "text, [", None, {"z": "é"}]
    body = json.dumps(data, indent=1, ensure_ascii=False).encode()
    def read(text):
        return [json.loads(e) if e is not None else "error" for e, _ in ig._elements(io.BytesIO(text), chunk)]

    assert read(body) == data
    assert read(b"[]") == [] and read(b" [ ] ") == []
    assert read(b'{"a": 1}') == ["error"] and read(b"") == ["error"]
    assert read(b'[1, {"a": ') == [1, "error"]
    assert read(b'[{"a": 1}, {"a": tru}, {"a": 3}, {"a": "\\\\"}, 4x, "\\""]') == [{"a": 1}, "error", {"a": 3}, {"a": "\\"}, "error", '"']


def test_projects(spark, tmp_path):
    def archive(name, projects, orgs=None):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("project.json", json.dumps(projects))
            if orgs is not None:
                z.writestr("organization.json", json.dumps(orgs))

    archive("cordis-h2020.zip", [{"id": 1, "title": "old", "totalCost": "1.5", "startDate": "2019-01-01"}, {"id": 2, "totalCost": "n/a"}],
            [{"projectID": 1, "name": "CNRS", "SME": "no", "ecContribution": 3}])
    archive("cordis-horizon.zip", [{"id": 1, "title": "new", "totalCost": 2}])
    files = ig.select_files(spark, str(tmp_path))
    got = {r["project_id"]: r for r in ig.ingest_projects(files).collect()}
    assert (got[1]["title"], got[1]["framework"], got[1]["total_cost"]) == ("new", "HORIZON", 2.0)
    assert (got[2]["title"], got[2]["framework"], got[2]["total_cost"]) == ("", "H2020", None)
    orgs = ig.ingest_organizations(files).collect()
    assert [(o["name"], o["ec_contribution"]) for o in orgs] == [("CNRS", 3.0)]


def test_import_resumes(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    nested_zip(folder / "a.zip", {"Root/DOC/1.zip": doc(number="1", body=BIBLIO)})
    st.resume_ingest(spark, str(folder), str(out)).awaitTermination()
    nested_zip(folder / "b.zip", {"Root/DOC/1.zip": doc(number="2", body=BIBLIO) + doc(number="3", body=BIBLIO)})
    for _ in range(2):
        st.resume_ingest(spark, str(folder), str(out)).awaitTermination()
    ledger = spark.read.parquet(f"{out}/ledger")
    assert rows_of(ledger.select("file_name", "records")) == [("a.zip", 1), ("b.zip", 2)]
    nested_zip(folder / "c.zip", {"Root/DOC/1.zip": doc(number="2", date="20210101", body=BIBLIO) + doc(number="4", body=BIBLIO) + doc(number="5")})
    st.resume_ingest(spark, str(folder), str(out)).awaitTermination()
    got = rows_of(spark.read.parquet(f"{out}/records").select("publication_number", "pub_year"))
    bulk = ig.ingest_nested_archives(ig.select_files(spark, str(folder))).select("publication_number", "pub_year")
    assert got == rows_of(bulk) == [(f"EP{k}A1", 2020) for k in (1, 2, 3, 4)]
    assert rows_of(spark.read.parquet(f"{out}/ledger").where("file_name = 'c.zip'").select("records", "rejects")) == [(1, 1)]
    assert spark.read.parquet(f"{out}/actor_links").count() == 8 and spark.read.parquet(f"{out}/code_links").count() == 8
    assert not (out / "documents").exists() or not any((out / "documents").rglob("*.parquet"))


def test_archives_round_trip(spark, tmp_path):
    records = StarSchema(spark, SF).records()
    write_nested_archives(record_documents(records), str(tmp_path)).collect()
    back = ig.ingest_nested_archives(ig.select_files(spark, str(tmp_path)))
    cols = ["family_id", "applicant_names", "codes", "pub_date"]
    want = records.select("family_id", "applicant_names", F.coalesce("codes", F.lit("")).alias("codes"), "pub_date")
    assert rows_of(back.select(*cols)) == rows_of(want)


def test_panels(spark, tmp_path):
    star = StarSchema(spark, SF)
    terms = terms_table(spark, [("hot anvil", "hot anvil", 1995, 2001), ("nothing", "zzz qqq", 1995, 2001)])
    an = Analysis(star.tables(), terms, clamp=True, materialized=True)
    status = rp.write_panels(spark, an, star.code_dimension(), str(tmp_path), F.lit("2001-08-01").cast("date"))
    assert {r["panel"]: r["status"] for r in status.collect()} == {n: "ok" for n in rp.panel_builders(an, star.code_dimension())}
    for name, (column, fields) in ig.EXPORTS.items():
        panel = spark.read.parquet(f"{tmp_path}/{name}")
        texts = {r["tech"]: r["analysis_text"] for r in panel.collect()}
        assert texts["hot anvil"].endswith(".")
        if name != "maturity":
            assert texts["nothing"] == ""
        assert ig.export_rows(panel, name).columns == ["tech", *fields]
    maturity = {r["tech"]: r["heuristic_phase"] for r in spark.read.parquet(f"{tmp_path}/maturity").collect()}
    assert maturity["nothing"] == "Unknown"


def test_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', 1)], "p string, q string, n int")
    ig.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["p,q,n", '"a,b","say ""x""",1']


def _project_archive(path, rows, orgs=()):
    path.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("project.json", json.dumps(rows))
        z.writestr("organization.json", json.dumps(list(orgs)))


def test_runs_of_projects_converge(spark, tmp_path):
    """Any order of arrival, a failed run and equal file names end where one run over everything ends."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    versions = {
        "a/cordis-h2020.zip": [{"id": k, "title": "a"} for k in range(1, 40)],
        "b/cordis-h2020.zip": [{"id": k, "title": "b"} for k in range(10, 20)] + [{"id": 10, "title": "b again"}],
        "c/cordis-fp7.zip": [{"id": k, "title": "c"} for k in range(15, 18)],
    }
    folder.mkdir()
    for name in ("c/cordis-fp7.zip", "a/cordis-h2020.zip", "b/cordis-h2020.zip"):
        _project_archive(folder / name, versions[name], [{"projectID": 1, "name": name}])
        if name[0] == "a":
            with pytest.raises(ZeroDivisionError):
                st.import_projects(spark, str(folder), out, recursive=True, before_commit=lambda: 1 / 0)
            assert st.imported_projects(spark, out).count() == 3  # nothing of the failed run
        st.import_projects(spark, str(folder), out, recursive=True)
    ledger = st.import_projects(spark, str(folder), out, recursive=True)
    assert ledger.count() == 3
    bulk = ig.ingest_projects(ig.select_files(spark, str(folder), recursive=True))
    got = st.imported_projects(spark, out)
    assert rows_of(got.select("project_id", "title", "framework")) == rows_of(bulk.select("project_id", "title", "framework"))
    titles = {r["project_id"]: r["title"] for r in got.collect()}
    assert (titles[9], titles[10], titles[16], titles[19]) == ("a", "b again", "c", "b")
    orgs = st.imported_projects(spark, out, "organizations")
    assert rows_of(orgs.select("name")) == [(n,) for n in sorted(versions)]


def test_a_run_rewrites_only_buckets_it_touches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    _project_archive(folder / "cordis-h2020-1.zip", [{"id": k} for k in range(500)])
    st.import_projects(spark, str(folder), out)
    before = {(r["bucket"], r["run"]) for r in st._manifest(spark, out)[1] if r["entry"] == "projects"}
    _project_archive(folder / "cordis-h2020-2.zip", [{"id": 7, "title": "new"}])
    st.import_projects(spark, str(folder), out)
    after = {(r["bucket"], r["run"]) for r in st._manifest(spark, out)[1] if r["entry"] == "projects"}
    assert len(before) == len(after) == st.BUCKETS and len(before - after) == 1
    assert st.imported_projects(spark, out).where("title = 'new'").count() == 1 and st.imported_projects(spark, out).count() == 500


def test_a_bucket_is_one_file_of_a_run(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")  # many tasks, as a large run has
    try:
        for n, size in ((1, 3000), (2, 2500)):
            _project_archive(folder / f"cordis-h2020-{n}.zip", [{"id": k, "title": str(n)} for k in range(size)])
            st.import_projects(spark, str(folder), out)
    finally:
        spark.conf.set(merging, before)
    files = list((tmp_path / "out" / "projects").glob("run=*/bucket=*/*.parquet"))
    assert len(files) == 2 * st.BUCKETS  # whatever the number of tasks
    got = st.imported_projects(spark, out).groupBy("title").count()
    assert rows_of(got) == [("1", 500), ("2", 2500)]


def test_sound_json_elements_are_not_cut_mark_by_mark(monkeypatch):
    looked = []

    class Marks:
        def finditer(self, *at):
            for mark in marks.finditer(*at):
                looked.append(mark)
                yield mark

    marks = ig._MARKS
    monkeypatch.setattr(ig, "_MARKS", Marks())
    rows = [{"id": k, "title": 'a "quoted", [text]', "parts": [{"n": 1}]} for k in range(1000)]
    body = json.dumps(rows).replace('{"id": 500,', '{"id": 500 oops,').encode()
    got = list(ig._elements(io.BytesIO(body), 5000))
    assert [e is None for e, _ in got] == [k == 500 for k in range(1000)]
    assert json.loads(got[999][0]) == rows[999]
    assert len(looked) < len(list(marks.finditer(body.decode()))) / 4


def test_earlier_archives_that_arrive_late_win(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    other = BIBLIO.replace("G06N 10/00", "A01B 1/00")
    for name, body in (("c.zip", BIBLIO), ("a.zip", other), ("b.zip", BIBLIO)):
        nested_zip(folder / name, {"Root/DOC/1.zip": doc(number="1", body=body) + doc(number=name[0], body=BIBLIO)})
        st.resume_ingest(spark, str(folder), out).awaitTermination()
    bulk = ig.ingest_nested_archives(ig.select_files(spark, str(folder)))
    columns = ["publication_number", "file_name", "codes"]
    got = st.imported(spark, out, "records")
    assert rows_of(got.select(columns)) == rows_of(bulk.select(columns))
    assert got.where("doc_number = '1'").first()["file_name"] == "a.zip"
    links = st.imported(spark, out, "code_links").join(got.where("doc_number = '1'").select("record_id"), "record_id")
    assert [r["code"] for r in links.select("code").distinct().orderBy("code").collect()] == ["A01B", "H01L"]


def test_discarded_results_and_shuffles_are_gone(spark):
    from techatlas.session import _written, discard, exists, materialize, shuffles_released

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_released(spark):
        kept, gone = (materialize(spark.range(100).repartition(3), "part") for _ in range(2))
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
    paths = _written[-2:]
    discard(gone)
    assert [exists(spark, p) for p in paths] == [True, False] and paths[1] not in _written
    assert kept.count() == 100


def test_work_apart(spark):
    """Work that fails or takes too long is named; the rest is whole, and nothing keeps running."""

    def slow():
        def wait(batches):
            time.sleep(300)
            yield from batches

        return spark.range(0, 4, 1, 1).mapInPandas(wait, "id long").count()

    def fails():
        return spark.range(4).select(F.raise_error(F.lit("no"))).collect()

    begin = time.monotonic()
    done = run_apart(spark, {"good": lambda: spark.range(7).count(), "slow": slow, "fails": fails}, 8)
    assert time.monotonic() - begin < 60
    assert done["good"].value == 7 and done["good"].warning is None
    assert done["slow"].warning == "slow: stopped after 8 s"
    assert done["fails"].warning == "fails: failed (SparkRuntimeException)" and "no" in done["fails"].message
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert run_apart(spark, {}) == {}


def test_panels_fail_alone(spark):
    """A source that can't be read costs the panels that read it; a technology without hits keeps its row."""
    star = StarSchema(spark, SF)
    terms = terms_table(spark, [("hot anvil", "hot anvil", 1995, 2001), ("nothing", "zzz qqq", 1995, 2001)])
    whole = star.tables()
    lost = whole.papers.withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    names = ("records", "record_actor", "projects", "organizations", "publications", "lei_reference")
    tables = Tables(papers=lost, **{n: getattr(whole, n) for n in names})
    full = rp.all_panels(Analysis(tables, terms, clamp=True, materialized=True), star.code_dimension(), F.lit("2001-08-01").cast("date"))
    got = {r["tech"]: r for r in full.collect()}
    assert set(got) == {"hot anvil", "nothing"}
    for r in got.values():
        assert r["warnings"] == ["metadata: failed (SparkRuntimeException)", "research_impact: failed (SparkRuntimeException)"]
        assert r["research_impact"] is None and r["complete_until"] is None
        assert all(r[n] is not None for n in ("landscape", "maturity", "competitive", "funding", "code_flow", "geographic", "temporal"))
    assert got["hot anvil"]["landscape"]["analysis_text"].endswith(".")
