from pyspark.sql import functions as F

from techatlas.functions import labels as lb
from techatlas.functions import names as nm
from techatlas.functions import text as tx
from techatlas.operators import terms as te


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


def test_normalize_actor_name(spark):
    got = apply(spark, ["Siemens AG", " Foo Co., Ltd. ", "Bar GmbH & Co. KG", "ACME CORPORATION", "AG", "Big  Data Inc", "X CO LTD KG"], nm.normalize_actor_name)
    assert got == ["SIEMENS", "FOO", "BAR GMBH", "ACME", "AG", "BIG DATA", "X CO LTD"]


def test_text(spark):
    assert apply(spark, ["Lithium-Ion  Akku", "Éléctrique!", "", None], tx.normalize_text) == ["lithium ion akku", "electrique", "", None]
    assert apply(spark, ["a, b ,,c", ""], tx.split_list) == [["a", "b", "c"], []]


def test_codes_and_dates(spark):
    assert apply(spark, ["G06N 10/00", " H 01L", "G0"], nm.normalize_code) == ["G06N", "H01L", "G0"]
    assert apply(spark, ["20200315", "2020", "2020-03"], nm.parse_pub_date) == ["2020-03-15", "2020", "2020-03"]
    assert apply(spark, ["1.5", "x", None, " 2 ", "1.5d", "2f", "NaN", "Infinity", "-3e2", "+.5", "7."], nm.safe_float) == [
        1.5, None, None, 2.0, None, None, None, None, -300.0, 0.5, 7.0]
    assert apply(spark, ["cordis-FP7.zip", "H2020x", "HORIZONprojects", "a"], nm.framework_from_filename) == ["FP7", "H2020", "HORIZON", "UNKNOWN"]
    assert apply(spark, ["a &nbsp;&amp; &#38; &uuml;b &ampere;"], nm.sanitize_entities) == ["a &amp; &#38; b "]


def test_case(spark):
    assert apply(spark, ["QUANTUM COMPUTING", "quantum led", "LED LAMP", "Quantum computing", "SOLAR OF"], lb.title_case_smart) == [
        "Quantum Computing", "Quantum Led", "LED LAMP", "Quantum computing", "Solar Of"]
    assert apply(spark, ["TU MUNICH", "r&d/abc-def x"], lb.title_case) == ["Tu Munich", "R&d/Abc-Def X"]


def test_formats(spark):
    assert apply(spark, [1234567, 12, 0], lb.format_int_de, "long") == ["1.234.567", "12", "0"]
    assert apply(spark, [67.34, 0.0, -6.46], lb.format_pct_de, "double") == ["67,3%", "0,0%", "-6,5%"]
    assert apply(spark, [1.2e9, 345.6e6, 4200.0, 12.0], lb.format_eur, "double") == ["1,2 Mrd. EUR", "345,6 Mio. EUR", "4 Tsd. EUR", "12 EUR"]


def test_bands(spark):
    assert apply(spark, [1499.9, 1500.0, 2499.0, 2500.0], lb.hhi_band, "double") == ["Low", "Moderate", "Moderate", "High"]
    assert apply(spark, [16.0, 6.0, 1.0, 0.0, -5.0], lb.trend_word, "double") == [
        "very strong growth", "solid growth", "slight growth", "stagnation", "decline"]
    assert apply(spark, ["G06N", "", "X1", None], lb.section_bucket) == ["G", "other", "other", "other"]


def test_suggestions(spark, ask):
    titles = spark.createDataFrame(
        [("q", "Quantum Computing device"), ("q", "a QUANTUM COMPUTING method"), ("q", "quantum computing"), ("q", "Quantum Computing chip")],
        "tech string, title string",
    )
    got = {r["norm"]: (r["term"], r["n"]) for r in te.suggest_terms(titles, ask(("q", "quantum", None, None))).collect()}
    assert got["quantum computing"] == ("Quantum Computing", 4)
    assert "a quantum" not in got and "quantum computing method" not in got
    assert got["quantum computing chip"][1] == 1


def test_failure_scan(spark):
    warn = spark.createDataFrame([("q", "paper query failed: x"), ("q", "paper query failed: y"), ("r", "fine")], "tech string, warning string")
    pats = spark.createDataFrame(te.FAILURE_PATTERNS, "pattern string, source string")
    assert [tuple(r) for r in te.source_failures(warn, pats).collect()] == [("q", "papers", "papers: no data")]


def test_dedupe_ordered(spark):
    df = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "b", 3)], "tech string, v string, i int")
    assert sorted(tuple(r) for r in te.dedupe_ordered(df, "v", "i").collect()) == [("q", "a", 2), ("q", "b", 1)]


def test_accents_fold_in_every_spelling(spark):
    """Czech, Polish, Turkish, Hungarian, Romanian, Vietnamese; composed and decomposed."""
    import unicodedata

    from techatlas.functions.text import normalize_text

    texts = ["Škoda Ősz", "Łódź", "İstanbul Iğdır", "naïve façade", "țară ŞİŞLİ", "Nguyễn Đức", "Ǿre ǣ", "Ærø straße", "ÀÁÂÃÄÅ Ěŕĺ žluťoučký kůň"]
    texts += [unicodedata.normalize("NFD", t) for t in texts]

    def plain(text):
        # letters of the Latin blocks lose their marks; a lone mark is dropped anywhere
        low = unicodedata.normalize("NFD", text.lower())
        kept = "".join(c for c in low if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in kept).split())

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(normalize_text("t")).collect()] == [plain(t) for t in texts]
