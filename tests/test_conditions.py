"""Every condition operator against hand-made masks, and the ordered ones against pairwise definitions."""

import random

import pytest

from attestra.model import ORD, All, AnyOf, ColumnRef, Dataset, Leaf, Literal, MissingColumn, Not, NoValue, RuleError, Terms, Values
from attestra.operators.conditions import OPERATORS, violations

ROWS = [
    # ord, S, T, N, D, L, P, A, A1, A2
    (1, "A", "a", 1.0, "2024-01-01", "x|y", "P1D", "q", None, "z"),
    (2, "a", "A", 2.0, "2024", "x", "P", "q", "r", "s"),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "", "b", 3.0, "2024-02-30", " ", "", "", "", ""),
    (5, "Éb", "10", 2.0, "2024-01-01T10:00", "y|x", "PT1H", "q", "r", None),
]
SCHEMA = f"{ORD} long, S string, T string, N double, D string, L string, P string, A string, A1 string, A2 string"


@pytest.fixture(scope="module")
def table(spark):
    return Dataset("T", spark.createDataFrame(ROWS, SCHEMA), "AE")


def mask(ds, condition, presence=None):
    return [r["__mask"] for r in violations(ds, condition, presence).orderBy(ORD).collect()]


def bits(text):
    return [c == "1" for c in text]


CASES = [
    ("exists", "S", NoValue(), {}, "11011"),
    ("not_exists", "S", NoValue(), {}, "00100"),
    ("is_empty", "S", NoValue(), {}, "00110"),
    ("non_empty", "S", NoValue(), {}, "11001"),
    ("equal_to", "S", Literal("a"), {}, "01000"),
    ("equal_to", "S", Literal(None), {}, "00100"),
    ("equal_to", "S", Literal("A| a"), {}, "11000"),
    ("equal_to", "N", Literal("2"), {}, "00000"),
    ("equal_to", "N", Literal("2"), {"type_insensitive": True}, "01001"),
    ("not_equal_to", "S", Literal("a"), {}, "10111"),
    ("not_equal_to", "S", ColumnRef("S"), {}, "00000"),
    ("equal_to", "S", ColumnRef("nowhere"), {}, "00000"),
    ("equal_to_case_insensitive", "S", ColumnRef("T"), {}, "11100"),
    ("not_equal_to_case_insensitive", "S", Literal("éB"), {}, "11111"),
    ("contains", "L", Literal("x"), {}, "11001"),
    ("contains", "D", Literal("-01-"), {}, "10001"),
    ("does_not_contain", "D", Literal("-01-"), {}, "01110"),
    ("contains_case_insensitive", "S", Literal("A"), {}, "11000"),
    ("does_not_contain_case_insensitive", "S", Literal("A"), {}, "00111"),
    ("is_contained_by", "S", Values(("a", "A")), {}, "11000"),
    ("is_contained_by", "S", Values(("a", None)), {}, "01100"),
    ("is_not_contained_by", "S", Values(("a", "A")), {}, "00111"),
    ("is_contained_by_case_insensitive", "S", Values(("a",)), {}, "11000"),
    ("is_not_contained_by_case_insensitive", "S", Values(("a",)), {}, "00111"),
    ("contains_all", "L", Values(("x", "y")), {}, "10001"),
    ("not_contains_all", "L", Values(("x", "y")), {}, "01110"),
    ("shares_no_elements_with", "L", Literal("y|z"), {}, "01110"),
    ("is_not_ordered_subset_of", "L", Literal("x|y"), {}, "00101"),
    ("less_than", "N", Literal(2), {}, "10000"),
    ("less_than", "T", Literal("9"), {}, "00000"),
    ("less_than_or_equal_to", "N", Literal("2"), {}, "11001"),
    ("greater_than", "S", Literal("A"), {}, "01001"),
    ("greater_than_or_equal_to", "N", ColumnRef("N"), {}, "11011"),
    ("matches_regex", "D", Literal(r"^\d{4}$"), {}, "01000"),
    ("does_not_match_regex", "D", Literal(r"^\d{4}$"), {}, "10111"),
    ("not_matches_regex", "D", Literal(r"\d{4}"), {}, "10011"),
    ("longer_than", "D", Literal(4), {}, "10011"),
    ("starts_with", "D", Literal("2024-01"), {}, "10001"),
    ("prefix_not_equal_to", "D", Literal("2024-01"), {}, "01010"),
    ("prefix_equal_to", "D", Literal("2024"), {"prefix": 4}, "11011"),
    ("not_prefix_matches_regex", "D", Literal("-0"), {"prefix": 6}, "01000"),
    ("prefix_is_not_contained_by", "D", Values(("2024-01",)), {"prefix": 7}, "01010"),
    ("suffix_is_not_contained_by", "D", Values(("01", "24")), {"suffix": 2}, "00011"),
    ("ends_with", "D", Literal("01"), {}, "10000"),
    ("suffix_matches_regex", "D", Literal("^0"), {"suffix": 2}, "10001"),
    ("not_suffix_matches_regex", "D", Literal("^0"), {"suffix": 2}, "01010"),
    ("date_equal_to", "D", Literal("2024-01-01"), {}, "11000"),
    ("date_not_equal_to", "D", Literal("2024-01-01"), {}, "00001"),
    ("date_less_than", "D", Literal("2024-01-01T10:00"), {}, "11000"),
    ("date_less_than_or_equal_to", "D", Literal("2024-01"), {}, "11000"),
    ("date_greater_than", "D", Literal("2024"), {}, "00001"),
    ("date_greater_than_or_equal_to", "D", Literal("2024"), {}, "11001"),
    ("is_complete_date", "D", NoValue(), {}, "10001"),
    ("is_incomplete_date", "D", NoValue(), {}, "01000"),
    ("is_incomplete_date", "S", NoValue(), {}, "00010"),
    ("invalid_date", "D", NoValue(), {}, "00010"),
    ("invalid_duration", "P", NoValue(), {}, "01000"),
    ("empty_within_except_last_row", "S", ColumnRef("P"), {"ordering": "N"}, "00010"),
    ("does_not_have_next_corresponding_record", "A", ColumnRef("A"), {"ordering": "D"}, "00011"),
    ("not_present_on_multiple_rows_within", "A", NoValue(), {"within": "D"}, "11001"),
    ("not_present_on_multiple_rows_within", "A", NoValue(), {}, "00000"),
    ("inconsistent_enumerated_columns", "A", NoValue(), {}, "10000"),
    ("is_not_unique_set", "A", Values(("N",)), {}, "01001"),
    ("is_unique_set", "A", Values(("N",)), {}, "10110"),
    ("is_unique_set", "A", Values(("nowhere",)), {}, "00110"),
    ("is_not_unique_set", "D", Values(("A",)), {"regex": "^2024"}, "11001"),
    ("is_not_unique_relationship", "N", ColumnRef("D"), {}, "01001"),
    ("is_not_unique_relationship", "N", ColumnRef("A"), {"direction": "target_to_comparator"}, "00000"),
    ("is_inconsistent_across_dataset", "D", Values(("N",)), {}, "01001"),
    ("does_not_equal_string_part", "D", ColumnRef("D"), {"regex": r"^(\d+)-"}, "10011"),
]


@pytest.mark.parametrize(("operator", "target", "value", "options", "want"), CASES)
def test_operator(table, operator, target, value, options, want):
    assert mask(table, Leaf(target, operator, value, options), False) == bits(want)


def test_every_operator_has_a_case():
    aliases = {"empty": "is_empty", "non_empty": "is_not_empty"}
    seen = {aliases.get(c[0], c[0]) for c in CASES} | {"target_is_not_sorted_by"}
    assert set(OPERATORS) == seen


def test_missing_columns(table):
    for operator, want in (("exists", False), ("not_exists", True), ("is_empty", False), ("is_not_empty", False), ("is_not_contained_by", False)):
        assert mask(table, Leaf("GONE", operator, Values(("a",))), False) == [want] * 5
    with pytest.raises(MissingColumn):
        mask(table, Leaf("GONE", "equal_to", Literal("a")))
    some = AnyOf((Leaf("GONE", "equal_to", Literal("a")), Leaf("S", "equal_to", Literal("a"))))
    assert mask(table, some) == bits("01000")
    assert mask(table, Leaf("s", "equal_to", Literal("a"))) == bits("01000")  # ASCII case only


def test_trees_and_presence(table):
    tree = All((Leaf("S", "is_not_empty"), Not(Leaf("S", "equal_to", Literal("a")))))
    assert mask(table, tree) == bits("10001")
    assert mask(table, Leaf("S", "exists"), True) == [True] * 5
    assert mask(table, All(())) == [True] * 5 and mask(table, AnyOf(())) == [False] * 5


def test_errors(table):
    for leaf in (Leaf("S", "matches_regex", Literal("(?=a)")), Leaf("S", "contains", ColumnRef("T")), Leaf("S", "nothing_known"), Leaf("S", "is_contained_by"), Leaf("S", "prefix_equal_to", Literal("a"))):
        with pytest.raises(RuleError):
            mask(table, leaf)


def test_zero_rows(spark):
    empty = Dataset("T", spark.createDataFrame([], SCHEMA), "AE")
    for operator, target, value, options, _ in CASES:
        assert mask(empty, Leaf(target, operator, value, options), False) == []


def test_long_lists_are_joined(spark, table):
    many = Values(tuple([f"v{i}" for i in range(3000)] + ["a"]))
    assert mask(table, Leaf("S", "is_contained_by", many)) == bits("01000")
    assert mask(table, Leaf("S", "is_not_contained_by", many)) == bits("10111")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("down", [False, True])
def test_sortedness_is_the_pairwise_definition(spark, seed, down):
    rng = random.Random(seed)
    rows = [(i, rng.choice("gh"), rng.choice([None, 1.0, 2.0, 3.0, 4.0]), rng.choice([None, "5", "12", "abc", "b", "7"])) for i in range(60)]
    ds = Dataset("T", spark.createDataFrame(rows, f"{ORD} long, G string, K double, V string"))
    spec = {"name": "K", "sort_order": "desc" if down else "asc", "null_position": "last"}
    got = mask(ds, Leaf("V", "target_is_not_sorted_by", Values((spec,)), {"within": "G"}))

    def number(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return None

    def greater(a, b):
        if a is None or b is None:
            return False
        return number(a) > number(b) if number(a) is not None and number(b) is not None else a > b

    place = lambda k: (1, 0) if k is None else (0, k)
    before = lambda a, b: place(b) < place(a) if down else place(a) < place(b)
    want = [any(o[1] == r[1] and ((before(o[2], r[2]) and greater(o[3], r[3])) or (before(r[2], o[2]) and greater(r[3], o[3]))) for o in rows) for r in rows]
    assert got == want


def test_partial_dates_mark_their_group(spark):
    """A group with an inversion and a partial date among its keys counts as a whole; others as usual."""
    rows = [(1, "a", "2020", 1), (2, "a", "2020-05-01", 3), (3, "a", "2020-06-01", 2), (4, "a", "2020-07-01", None), (5, "b", "2020", 1), (6, "b", "2020-05-01", 2), (7, "c", "2020-05-01", 2), (8, "c", "2020-06-01", 1), (9, "c", "2020-07-01", 3)]
    ds = Dataset("T", spark.createDataFrame(rows, f"{ORD} long, G string, D string, V long"))
    got = mask(ds, Leaf("V", "target_is_not_sorted_by", Values(({"name": "D"},)), {"within": "G"}))
    assert got == [True, True, True, False, False, False, True, True, False]


def test_a_table_of_terms(spark, table):
    ds = Dataset("T", spark.createDataFrame([(1, "A"), (2, "b"), (3, None), (4, "c")], f"{ORD} long, V string"))
    terms = Terms(spark.createDataFrame([("a",), ("b",), ("b",)], "term string"))
    assert mask(ds, Leaf("V", "is_contained_by", terms)) == [False, True, False, False]
    assert mask(ds, Leaf("V", "is_not_contained_by_case_insensitive", terms)) == [False, False, True, True]
