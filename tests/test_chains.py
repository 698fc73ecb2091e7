import random

import pytest

from scriptline.operators import chains

CHANGES = "year int, line int, old string, new string"


def fold(changes):
    """The mapping one gets by applying the rows one after the other, newest year first."""
    mapping = {}
    for _, _, old, new in sorted(changes, key=lambda r: (-r[0], r[1])):
        mapping[old] = mapping.get(new, new)
    return mapping


def resolved(spark, changes):
    found = chains.bnf_code_change_chain(spark.createDataFrame(changes, CHANGES)).collect()
    assert len({r.old_code for r in found}) == len(found)
    return {r.old_code: r.new_code for r in found}


def test_yearly_changes(spark):
    years = {2024: [("A1", "A2"), ("B1", "B2")], 2025: [("A2", "A3"), ("C1", "C2")], 2026: [("A3", "A4"), ("B2", "B3")]}
    changes = [(year, i, *pair) for year, pairs in years.items() for i, pair in enumerate(pairs)]
    assert resolved(spark, changes) == {"A1": "A4", "A2": "A4", "A3": "A4", "B1": "B3", "B2": "B3", "C1": "C2"}


@pytest.mark.parametrize("seed", range(3))
def test_any_changes_fold_alike(spark, seed):
    """Repeated old codes, changes within a file, circles over the years, and one popular new code."""
    pick = random.Random(seed)
    codes = [f"C{i}" for i in range(12)]
    changes = [
        (2000 + pick.randrange(6), line, pick.choice(codes), "C0" if pick.random() < 0.3 else pick.choice(codes)) for line in range(60)
    ]
    assert resolved(spark, changes) == fold(changes)


def test_changes_without_chains(spark):
    assert resolved(spark, [(2020, 0, "A", "B"), (2021, 0, "C", "D")]) == {"A": "B", "C": "D"}


def vmp(spark, pairs):
    return chains.vmp_code_change_chain(spark.createDataFrame(pairs, "vpid bigint, vpidprev bigint"))


def test_vmp_chain(spark):
    pairs = [(2000, 1000), (3000, 2000), (9, None), (5, 4), (6, 4)]
    assert {tuple(r) for r in vmp(spark, pairs).collect()} == {(1000, 3000), (2000, 3000), (4, 6)}


def test_long_vmp_chain(spark):
    found = vmp(spark, [(i + 1, i) for i in range(100)]).collect()
    assert {tuple(r) for r in found} == {(i, 100) for i in range(100)}


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 1)], [(1, 1)], [(2, 1), (3, 2), (1, 3), (1, 7)]])
def test_vmp_cycle_fails(spark, pairs):
    with pytest.raises(ValueError, match="Cycle"):
        vmp(spark, pairs)
