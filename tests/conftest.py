import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from techatlas.session import local_session  # noqa: E402
from techatlas.sources.tables import terms_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def patents(spark):
    """Ten patents on two topics."""
    rows = """EP1001|DE|Quantum computing device|2020-03-15|SIEMENS AG|G06N10/00|F1
EP1002|DE|Quantum processor chip|2020-07-20|SIEMENS AG|G06N10/00,H01L27/00|F2
EP1003|FR|Quantum gate circuit|2021-01-10|THALES SA|G06N10/00|F3
EP1004|US|Quantum error correction|2021-06-01|IBM CORP|G06N10/00|F4
EP1005|DE|Solar cell efficiency improvement|2020-05-01|FRAUNHOFER|H01L31/00|F5
EP1006|JP|Solar panel manufacturing|2021-03-15|PANASONIC|H01L31/00|F6
EP1007|DE|Quantum key distribution|2022-01-01|SIEMENS AG|H04L9/08|F7
EP1008|FR|Quantum sensor array|2022-06-15|THALES SA|G01N21/00|F8
EP1009|US|Quantum computing method|2023-01-20|GOOGLE LLC|G06N10/00|F9
EP1010|DE|Quantum machine learning|2023-08-10|SAP SE|G06N10/00|F10"""
    data = []
    for i, line in enumerate(rows.splitlines(), 1):
        number, country, title, date, names, codes, family = line.split("|")
        data.append((i, number, country, title, date, int(date[:4]), family, names, country, codes))
    return spark.createDataFrame(
        data,
        "record_id long, publication_number string, country string, title string, pub_date string, pub_year int, "
        "family_id string, applicant_names string, applicant_countries string, codes string",
    )


@pytest.fixture(scope="session")
def project_rows(spark):
    projects = spark.createDataFrame(
        [
            (1, "H2020", 2019, "2019-01-01", 4e6, "RIA", "quantum repeater"),
            (2, "H2020", 2020, "2020-03-01", 2.5e6, "RIA", "quantum chip"),
            (3, "HORIZON", 2022, "2022-01-01", 7e6, "RIA", "quantum network"),
            (4, "FP7", 2012, "2012-01-01", 1.5e6, "CP", "solar cell"),
            (5, "H2020", 2021, "2021-06-01", 3.5e6, "RIA", "quantum sensing"),
        ],
        "project_id long, framework string, start_year int, start_date string, ec_max_contribution double, "
        "funding_scheme string, title string",
    )
    orgs = spark.createDataFrame(
        [
            (1, "TU MUNICH", "DE", "Munich", "coordinator", "no"),
            (1, "CNRS", "FR", "Paris", "participant", "no"),
            (2, "THALES SA", "FR", "Paris", "coordinator", "no"),
            (2, "FRAUNHOFER", "DE", "Berlin", "participant", "no"),
            (3, "KPN NV", "NL", "The Hague", "coordinator", "YES"),
            (3, "TU DELFT", "NL", "Delft", "participant", "no"),
            (3, "CNRS", "FR", "Paris", "participant", "no"),
            (4, "FRAUNHOFER", "DE", "Berlin", "coordinator", "no"),
            (5, "ETH ZURICH", "CH", "Zurich", "coordinator", "no"),
            (5, "TU MUNICH", "DE", "Munich", "participant", "no"),
        ],
        "project_id long, name string, country string, city string, role string, sme string",
    )
    return projects, orgs


@pytest.fixture(scope="session")
def ask(spark):
    """Terms table of (tech, query, start, end) rows."""

    def make(*rows):
        return terms_table(spark, [r if len(r) == 4 else (r[0], r[0], None, None) for r in rows])

    return make


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
