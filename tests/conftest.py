import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", os.environ.get("TEST_CPUS", "8"), **{"spark.ui.showConsoleProgress": "false"})


# A fragment of the hierarchy: a chemical without a generic, and one with a generic and a brand.
CODES = [
    ("06", 1, "Endocrine System"),
    ("0601", 2, "Drugs used in diabetes"),
    ("060106", 3, "Diabetic diagnostic and monitoring agents"),
    ("0601060", 4, "Diabetic diagnostic and monitoring agents"),
    ("0601060D0", 5, "Glucose blood testing reagents"),
    ("0601060D0BS", 6, "Prestige"),
    ("0601060D0BSAAA0", 7, "Prestige Smart System testing strips"),
    ("10", 1, "Musculoskeletal and Joint Diseases"),
    ("1001", 2, "Drugs used in rheumatic diseases and gout"),
    ("100103", 3, "Rheumatic disease suppressant drugs"),
    ("1001030", 4, "Rheumatic disease suppressant drugs"),
    ("1001030U0", 5, "Methotrexate"),
    ("1001030U0AA", 6, "Methotrexate (Rheumatism)"),
    ("1001030U0AAABAB", 7, "Methotrexate 2.5mg tablets"),
    ("1001030U0AAACAC", 7, "Methotrexate 10mg tablets"),
    ("1001030U0BD", 6, "Maxtrex (Rheumatism)"),
    ("1001030U0BDAAAB", 7, "Maxtrex 2.5mg tablets"),
    ("1001030U0BDABAC", 7, "Maxtrex 10mg tablets"),
]
MEDICATIONS_SCHEMA = (
    "id bigint, bnf_code string, name string, is_amp boolean, vmp_id bigint, vtm_id bigint, invalid boolean,"
    " form_routes array<string>, ingredient_ids array<bigint>"
)
MEDICATIONS = [
    (1, "1001030U0AAABAB", "Methotrexate 2.5mg tablets", False, 1, 10, False, ["tablet.oral"], [100]),
    (2, "1001030U0AAACAC", "Methotrexate 10mg tablets", False, 2, 10, False, ["tablet.oral", "solution.oral"], [100, 101]),
    (3, "1001030U0BDAAAB", "Maxtrex 2.5mg", True, 1, 10, False, ["tablet.oral"], [100]),
    (4, "1001030U0BDABAC", "Maxtrex 10mg", True, 2, 10, False, ["solution.intravenous"], [101]),
    (5, "0601060D0BSAAA0", "Prestige strips", True, 6, None, False, [], []),
    (6, None, "Strips", False, 6, None, False, [], []),
]


@pytest.fixture(scope="session")
def codes(spark):
    return spark.createDataFrame(CODES, "code string, level int, name string").cache()


@pytest.fixture(scope="session")
def catalogue(spark, codes):
    from scriptline.operators.medicine_filter import Catalogue

    meds = spark.createDataFrame(MEDICATIONS, MEDICATIONS_SCHEMA).cache()
    routes = [(1, "tablet.oral"), (2, "solution.oral"), (3, "solution.intravenous")]
    return Catalogue(
        codes,
        meds,
        spark.createDataFrame(routes, "cd bigint, descr string").cache(),
        spark.createDataFrame([(100, "Methotrexate"), (101, "Water")], "isid bigint, nm string").cache(),
        spark.createDataFrame([(10, "Methotrexate")], "vtmid bigint, nm string").cache(),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
