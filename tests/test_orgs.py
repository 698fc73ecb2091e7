import pytest

from conftest import rows
from scriptline.operators import orgs

RELATION = "struct<sourceOrgCode:string,relationshipTypeCode:string,opStartDate:string,opEndDate:string>"
ODS = (
    "id string, name string, inactive boolean, primaryRole string, primaryRoleName string, roleName array<string>,"
    " isPartnerToCode array<string>, RE4 string, ICB string, NHSER string, country string,"
    f" relationships map<string, array<{RELATION}>>"
)


def org(id_, primary="X", roles=(), partners=(), re4=None, icb=None, nhser=None, country="ENGLAND", role=None, rel=None):
    relationships = None if rel is None else {"PRESCRIBING COST CENTRE": rel}
    return (id_, f"Name {id_}", False, role, primary, list(roles), list(partners), re4, icb, nhser, country, relationships)


def ods(spark, extra=()):
    return spark.createDataFrame(
        [
            org("R1", "NHS ENGLAND (REGION)"),
            org("I1", roles=["INTEGRATED CARE BOARD"], nhser="R1"),
            org("S1", roles=["SUB ICB LOCATION"], icb="I1", nhser="R1"),
            org("N1", "PRIMARY CARE NETWORK", re4="S1", icb="I1", role="RO272", rel=[("P2", "RE8", "2021-04-01", "2026-03-31")]),
            org("N2", "PRIMARY CARE NETWORK", re4="S1", icb="I1", role="RO272", rel=[("P2", "RE8", "2026-04-01", ""), ("P2", "RE9", "2000-01-01", "")]),
            org("P1", "PRESCRIBING COST CENTRE", ["GP PRACTICE"], ["N1"], "S1", "I1", "R1"),
            org("P2", "PRESCRIBING COST CENTRE", ["GP PRACTICE"], ["N1", "N2"], "S1", "I1", "GONE"),
            org("O1", "PRESCRIBING COST CENTRE", ["WALK-IN"], [], "S1"),
            org("W1", "PRESCRIBING COST CENTRE", ["GP PRACTICE"], ["N1"], country="WALES"),
            org("Z1", "SOMETHING ELSE"),
            *extra,
        ],
        ODS,
    )


def parents(spark, child, as_of, extra=()):
    return {r.parent_id for r in orgs.org_parents(ods(spark, extra), as_of).collect() if r.child_id == child}


def test_types(spark):
    assert {r.id: r.org_type for r in orgs.org_classify(ods(spark)).collect()} == {
        "ENGLAND": "nat", "R1": "reg", "I1": "icb", "S1": "sic", "N1": "pcn", "N2": "pcn", "P1": "pra", "P2": "pra", "O1": "oth",
    }


def test_parents(spark):
    assert parents(spark, "P1", "2026-03-20") == {"ENGLAND", "N1", "S1", "I1", "R1"}
    assert parents(spark, "I1", "2026-03-20") == {"ENGLAND", "R1"}
    assert parents(spark, "R1", "2026-03-20") == {"ENGLAND"}


@pytest.mark.parametrize("as_of, network", [("2026-03-20", "N1"), ("2026-04-20", "N2")])
def test_partner_on_a_day(spark, as_of, network):
    assert parents(spark, "P2", as_of) == {"ENGLAND", "S1", "I1", network}


def test_latest_start_wins_where_an_end_is_missing(spark):
    extra = [
        org("N3", "PRIMARY CARE NETWORK", role="RO272", rel=[("P3", "RE8", "2021-01-01", "")]),
        org("N4", "PRIMARY CARE NETWORK", role="RO272", rel=[("P3", "RE8", "2026-03-17", "")]),
        org("P3", "PRESCRIBING COST CENTRE", ["GP PRACTICE"], ["N3", "N4"]),
    ]
    assert parents(spark, "P3", "2026-03-20", extra) == {"ENGLAND", "N4"}


def test_no_valid_partner_fails(spark):
    with pytest.raises(Exception, match="No partner is valid for P2"):
        orgs.org_parents(ods(spark), "2010-01-01").collect()


def test_every_type_must_be_there(spark):
    assert dict(rows(orgs.org_verify(orgs.org_classify(ods(spark)))))["pra"] == 2
    with pytest.raises(Exception, match="No orgs of type"):
        orgs.org_verify(orgs.org_classify(ods(spark).where("id <> 'R1'"))).collect()


def test_membership(spark):
    found = orgs.org_practices(orgs.org_classify(ods(spark)), orgs.org_parents(ods(spark), "2026-03-20"))
    members = {}
    for r in found.collect():
        members.setdefault(r.org_id, set()).add(r.practice_code)
    assert members["ENGLAND"] == {"P1", "P2"} and members["N1"] == {"P1", "P2"} and members["P1"] == {"P1"}
    assert members["N2"] == {None} and members["O1"] == {None} and members["R1"] == {"P1"}


def test_order_and_search(spark):
    found = orgs.org_classify(ods(spark))
    assert [r.id for r in orgs.orgs_ordered(found).collect()] == ["ENGLAND", "R1", "I1", "S1", "N1", "N2", "P1", "P2", "O1"]
    assert {r.id for r in orgs.search_orgs(found, " name p").collect()} == {"P1", "P2"}
    assert {r.id for r in orgs.search_orgs(found, "n1").collect()} == {"N1"}
    assert orgs.search_orgs(found, "n").isEmpty()
