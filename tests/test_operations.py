"""Dataset operations, joins and positions on small tables."""

import pytest

from attestra.functions.positions import with_position
from attestra.model import ORD, Dataset, MissingColumn, RuleError, Variable
from attestra.operators import joins
from attestra.operators.operations import OPERATIONS, Context, apply
from attestra.plans.rules import parse_condition
from attestra.sources.metadata import codelist_table


@pytest.fixture(scope="module")
def ds(spark):
    rows = [(1, "s1", "AE", "5", 1.5, "2024-01-02", "a, b,,c"), (2, "s1", "AE", "12", None, "2023-12-31", None), (3, "s2", "CM", "x", 2.0, "2024-01", ""), (4, None, "AE", None, 2.0, None, "d")]
    return Dataset("AE", spark.createDataFrame(rows, f"{ORD} long, USUBJID string, DOMAIN string, T string, N double, D string, W string"), "AE", "Events", "ae.csv", variables=(Variable("D", extra={"role": "Timing"}), Variable("T", extra={"role": "Topic"})))


@pytest.fixture(scope="module")
def dm(spark):
    rows = [(1, "s1", "2024-01-01", 30.0), (2, "s2", "2024-01-01", 40.0), (3, "s1", "2024-01-01", 31.0)]
    return Dataset("DM", spark.createDataFrame(rows, f"{ORD} long, USUBJID string, RFSTDTC string, AGE double"), "DM")


def run(ds, context=None, **spec):
    return apply(ds, spec, context or Context([ds], parse_condition))


def column(ds, name):
    return [r[0] for r in ds.df.orderBy(ORD).select(f"`{name}`").collect()]


def test_rows(ds):
    assert column(run(ds, operator="filter", where={"name": "N", "operator": "equal_to", "value": 2.0}), "T") == ["x", None]
    assert column(run(ds, operator="where", where={"DOMAIN": "AE"}), ORD) == [1, 2, 4]
    assert column(run(ds, operator="sort", by=["N"]), "N") == [None, 1.5, 2.0, 2.0]
    assert column(run(ds, operator="sort", by=["N"], descending=True), "T") == ["x", None, "5", "12"]
    assert column(run(ds, operator="distinct", by=["USUBJID"]), "T") == ["5", "x", None]
    assert column(run(ds, operator="row_number", by=["USUBJID"], **{"as": "k"}), "k") == [1, 2, 1, 1]
    assert column(run(run(ds, operator="sort", by=["D"]), operator="rank", **{"as": "k"}), "k") == [1, 2, 3, 4]


def test_columns(ds):
    assert run(ds, operator="select", columns=["T", "N"]).columns == ["T", "N"]
    assert "N" not in run(ds, operator="drop", columns=["n"]).columns
    assert "M" in run(ds, operator="rename", mapping={"N": "M"}).columns
    with pytest.raises(RuleError):
        run(ds, operator="drop", columns=ds.columns)
    with pytest.raises(MissingColumn):
        run(ds, operator="select", columns=["t"])
    assert column(run(ds, operator="derive", target="X", value="Y"), "X") == ["Y"] * 4
    assert column(run(ds, operator="derive", target="$X", expression='$concat($lowercase(DOMAIN), "-", T)'), "X") == ["ae-5", "ae-12", "cm-x", "ae-"]
    assert column(run(ds, operator="split_by", name="W", delimiter=",", id="P"), "P") == ["a|b|c", None, "", "d"]
    assert column(run(ds, operator="map", id="P", map=[{"DOMAIN": "AE", "T": "5", "output": "1"}, {"DOMAIN": "CM", "output": "2"}]), "P") == ["1", "", "2", ""]
    with pytest.raises(RuleError):
        run(ds, operator="derive", target="N", value=1)


def test_statistics(ds, dm):
    assert column(run(ds, operator="aggregate", by=["USUBJID"], **{"as": "made"}), "made") == [2, 2, 1, 1]
    assert column(run(ds, operator="aggregate", **{"as": "made"}), "made") == [4] * 4
    assert column(run(ds, operator="aggregate", by=["DOMAIN"], filter={"N": 2.0}, **{"as": "made"}), "made") == [1, 1, 1, 1]
    assert column(run(ds, operator="aggregate", function="sum", source_column="T", by=["DOMAIN"], **{"as": "made"}), "made") == [17.0, 17.0, 0.0, 17.0]
    assert column(run(ds, operator="aggregate", function="mean", source_column="T", by=["USUBJID"], **{"as": "made"}), "made") == [8.5, 8.5, None, None]
    assert column(run(ds, operator="aggregate", function="count_distinct", source_column="N", by=["DOMAIN"], **{"as": "made"}), "made") == [2, 2, 1, 2]
    assert column(run(ds, operator="max", name="T", by=["DOMAIN"], **{"as": "made"}), "made") == ["12", "12", "x", "12"]
    assert column(run(ds, operator="min", name="D", by=["DOMAIN"], **{"as": "made"}), "made") == ["2023-12-31", "2023-12-31", "2024-01", "2023-12-31"]
    both = Context([ds, dm], parse_condition)
    assert column(run(ds, both, operator="max", name="AGE", dataset="DM", by=["USUBJID"], **{"as": "made"}), "made") == ["31", "31", "40", None]
    assert column(run(ds, both, operator="record_count", dataset="DM", group=["USUBJID"], **{"as": "made"}), "made") == [2, 2, 1, 0]
    assert column(run(ds, operator="distinct", name="T", by=["DOMAIN"], id="v"), "v") == ["12|5", "12|5", "x", "12|5"]
    assert column(run(ds, both, operator="distinct", name="AGE", dataset="DM", group=["USUBJID"], id="v"), "v") == ["30|31", "30|31", "40", ""]
    assert column(run(ds, both, operator="dy", name="D", id="dy"), "dy") == [2, -1, None, None]


def test_metadata(spark, ds, dm):
    lists = codelist_table(spark, "code,extensible,term_code,value,pref_term,version\nC1,true,T1,Y,Yes,2020-01-01\nC1,true,T2,N,No,2024-01-01\n")
    c = Context([ds, dm], parse_condition, lists, {"SDTM": ["2024-03-29", "2023-12-15"]})
    one = lambda **s: column(run(ds, c, **s), s["id"])[0]
    assert one(operator="study_domains", id="v") == "AE|DM" and one(operator="domain_label", id="v") == "Events"
    assert one(operator="variable_count", name="USUBJID", id="v") == 2 and one(operator="extract_metadata", name="domain", id="v") == "AE"
    assert one(operator="valid_codelist_dates", ct_package_types=["SDTM"], id="v") == "2023-12-15|2024-03-29"
    assert one(operator="codelist_terms", codelists=["C1"], id="v") == "N|Y" and one(operator="codelist_terms", codelists=["C1"], version="2021", returntype="code", id="v") == "T1"
    assert one(operator="codelist_extensible", codelist_code="C1", id="v") is True
    assert one(operator="get_dataset_filtered_variables", key_name="role", key_value="Timing", id="v") == "['D']"
    assert one(operator="dataset_names", id="v") == "AE|DM" and one(operator="variable_exists", name="N", id="v") is True
    assert one(operator="get_column_order_from_dataset", id="v").startswith("USUBJID|DOMAIN")
    good = ['<p class="x">ok <b>b</b></p>', None, " ", '<ul><li>a</li></ul>', '<usdm:ref id="1" klass="A" attribute="b"/>', '<td colspan="2">x</td>']
    bad = ["<p>", "<blink/>", "<h1>x</h1>", '<p href="x">a</p>', "<ol><p>a</p></ol>", "<usdm:ref/>", '<usdm:tag name="n">text</usdm:tag>', '<usdm:other id="1"/>', '<usdm:tag name="n" id="1"/>']
    text = Dataset("X", spark.createDataFrame(list(enumerate([*good, *bad])), f"{ORD} long, H string"))
    got = column(run(text, operator="get_xhtml_errors", name="H", id="e", namespace="http://example.org/ns"), "e")
    assert got == [None] * len(good) + ["invalid xhtml"] * len(bad)
    assert len(OPERATIONS) > 35
    with pytest.raises(RuleError):
        run(ds, operator="pivot")


def test_joins(ds, dm):
    left = joins.join(ds, dm, "left_join", ["USUBJID"])
    assert column(left, "DM.AGE") == [30.0, 31.0, 30.0, 31.0, 40.0, None] and column(left.with_df(with_position(left.df, [ORD], "K")), "K") == [1, 2, 3, 4, 5, 6]
    assert column(joins.join(ds, dm, "inner_join", ["USUBJID"]), "T") == ["5", "5", "12", "12", "x"]
    assert column(joins.join(ds, dm, "semi_join", ["USUBJID"]), "T") == ["5", "12", "x"]
    assert column(joins.join(ds, dm, "anti_join", ["USUBJID"]), ORD) == [4]
    assert "USUBJID_right" in joins.join(ds, dm, "left_join", ["USUBJID"], prefix="").columns
    assert column(joins.join(ds, dm, "inner_join", ["T"], ["AGE"]), "T") == []  # text never equals a number
    assert column(joins.match_all(ds, [(dm, [])]), "T")[0] == "5"


def test_supplemental(spark):
    parent = Dataset("AE", spark.createDataFrame([(1, "s1", 1, "x"), (2, "s1", 2, "y")], f"{ORD} long, USUBJID string, AESEQ long, AETERM string"), "AE")
    supp = Dataset("SUPPAE", spark.createDataFrame([(1, "s1", "AESEQ", "2", "Q"), (2, "s1", "", "", "R"), (3, "s9", "AESEQ", "1", "S")], f"{ORD} long, USUBJID string, IDVAR string, IDVARVAL string, QNAM string"))
    got = sorted((r["QNAM"], r["AE.AETERM"]) for r in joins.supplemental(parent, supp).df.collect() if r["AE.AETERM"])
    assert got == [("Q", "y"), ("R", "x"), ("R", "y")]


def test_positions_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS k").repartition(7)
    got = with_position(df, ["k"], "p").collect()
    assert all(r["p"] == r["k"] + 1 for r in got) and len(got) == 1000
    assert with_position(df.limit(0), ["k"], "p").count() == 0


def test_positions_where_rows_are_far_wider_than_their_keys(spark):
    """Partitions of the rows and of their keys alone are coalesced differently."""
    df = spark.range(20_000).selectExpr("(id * 7919) % 20000 AS k", "concat_ws('', transform(sequence(1, 8), i -> sha2(concat(id, i), 512))) AS wide").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = with_position(df, ["k"], "p").selectExpr("count(*) AS n", "count_if(p = k + 1 AND length(wide) = 1024) AS right").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got["n"], got["right"]) == (20_000, 20_000)
