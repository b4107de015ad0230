"""Edge cases of the report semantics on hand-made rows (FIXTURES §3, SURVEY §2.1)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.functions import scalars
from claimscope.operators import facets, refine, reshape
from claimscope.operators import filters as flt
from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import directory as dirs
from claimscope.plans import kpis, prep, reports
from claimscope.sources import schemas
from conftest import claim, reg

REF = [
    ("C1", "Cat A", "Code one"),
    ("C2", "Cat B", "Code two"),
    ("C3", "Cat B", "Code three"),
]


def test_empty_filter_is_no_filter(make):
    c = make.claims([claim("1", "C1", "2020-01", state="S1"), claim("2", "C1", "2020-01", state="S2")])
    a = reports.state_overview(c, ClaimsFilter(states=[], years=[])).collect()
    b = reports.state_overview(c).collect()
    assert a == b and len(a) == 2


def test_quote_in_value_matches_literally(make):
    c = make.claims([claim("1", "C1", "2020-01", state="O'Brien"), claim("2", "C1", "2020-01", state="S2")])
    rows = reports.state_overview(c, ClaimsFilter(states=["O'Brien"])).collect()
    assert [r.state for r in rows] == ["O'Brien"]


def test_null_month_group_sorted_last_and_absent_from_facet_and_pivot(make):
    c = make.claims([
        claim("1", "C1", None, claims=7),
        claim("1", "C1", "2020-02", claims=3),
        claim("1", "C2", "2020-01", claims=4),
    ])
    ref = make.ref(REF)
    months = [r.month for r in reports.monthly(c, ref).collect()]
    assert months == ["2020-01", "2020-02", None]
    assert [r.year for r in reports.yearly(c, ref).collect()] == ["2020", None]
    assert [r.year for r in facets.years(c).collect()] == ["2020"]
    pivot = reshape.pivot_wide(reports.category_trend(c, ref))
    assert [r.month for r in pivot.collect()] == ["2020-01", "2020-02"]


def test_null_state_absent_from_reports(make):
    c = make.claims([claim("1", "C1", "2020-01", state=None), claim("2", "C1", "2020-01", state="S2")])
    ref = make.ref(REF)
    assert [r.state for r in reports.state_overview(c).collect()] == ["S2"]
    assert reports.category_summary(c, ref).first().total_claims == 20
    assert [r.state for r in facets.states(c).collect()] == ["S2"]


def test_suppression_keeps_twelve(spark, make):
    c = make.claims([claim("1", "C1", "2020-01", claims=11), claim("2", "C1", "2020-01", claims=12)])
    assert [r.total_claims for r in prep.suppress(c).collect()] == [12]


def test_name_expressions(spark):
    df = spark.createDataFrame(
        [
            (None, "A", None, "1"),
            ("", "A", "B", "2"),
            (None, "A", "B", "2"),
            ("Org", "A", "B", "1"),
            (None, None, None, None),
        ],
        "org string, first string, last string, et string",
    )
    out = df.select(
        scalars.billing_name("org", "first", "last").alias("b"),
        scalars.servicing_name("et", "org", "first", "last").alias("s"),
    ).collect()
    assert [r.b for r in out] == [None, "", "A B", "Org", None]
    assert [r.s for r in out] == ["Unknown", "", "Unknown", "A B", "Unknown"]


def test_year_of_and_labels(spark):
    df = spark.createDataFrame([("2020-01",), ("20",), (None,)], "m string")
    assert [r[0] for r in df.select(scalars.year_of("m")).collect()] == ["2020", "20", None]
    lab = spark.createDataFrame([("C1", "Desc — x"), ("C2", None)], "hcpcs_code string, description string")
    labels = reshape.code_labels(lab)
    assert [r.label for r in labels.collect()] == ["C1 — Desc — x", "C2 — None"]
    assert [r.hcpcs_code for r in reshape.parse_labels(labels).collect()] == ["C1", "C2"]


def _dir(make, claims, registry, view, filt=None):
    return dirs.directory(
        make.claims(claims), make.ref(REF), make.registry(registry), filt or ClaimsFilter(states=["S1"]), view
    )


def test_servicing_null_npi_is_one_unknown_group(make):
    rows = _dir(
        make,
        [claim("1", "C1", "2020-01", servicing=None), claim("2", "C2", "2020-01", servicing=None),
         claim("1", "C1", "2020-01", servicing="9")],
        [reg("9", "1", first="Ann", last="Lee")],
        "servicing",
    ).collect()
    by = {r.npi: r for r in rows}
    assert by[None].provider_name == "Unknown" and by[None].total_hiv_claims == 40
    assert by["9"].provider_name == "Ann Lee"


def test_unregistered_billing_kept_with_null_attributes(make):
    rows = _dir(make, [claim("7", "C1", "2020-01")], [reg("1", org="X")], "billing").collect()
    assert len(rows) == 1 and rows[0].npi == "7" and rows[0].provider_name is None and rows[0].city is None


def test_provider_in_two_categories(make):
    rows = _dir(make, [claim("1", "C2", "2020-01"), claim("1", "C1", "2020-02"), claim("1", "C3", "2020-02")],
                [reg("1", org="X")], "billing").collect()
    assert rows[0].hiv_service_categories == 2
    assert rows[0].categories_served == "Cat A, Cat B"


def test_provider_in_two_states_counts_twice_in_overview_kpi(make):
    c = make.claims([claim("1", "C1", "2020-01", state="S1"), claim("1", "C1", "2020-01", state="S2")])
    k = kpis.overview_kpis(reports.state_overview(c)).first()
    assert k.providers == 2 and k.states == 2


def test_pre_vs_post_category(make):
    claims = [claim("1", "C1", "2020-01", claims=10), claim("1", "C2", "2020-01", claims=30)]
    registry = [reg("1", org="X")]
    pre = _dir(make, claims, registry, "billing", ClaimsFilter(states=["S1"], category="Cat A")).collect()
    assert pre[0].total_hiv_claims == 10 and pre[0].categories_served == "Cat A"
    full = _dir(make, claims, registry, "billing")
    post = refine.post_category(full, "Cat A").collect()
    assert post[0].total_hiv_claims == 40 and post[0].categories_served == "Cat A, Cat B"
    assert refine.post_category(full, "Cat").count() == 0  # element, not substring
    assert refine.post_category(full, None).count() == 1


def test_codes_beat_category(make):
    c = make.claims([claim("1", "C1", "2020-01"), claim("1", "C2", "2020-01")])
    rows = reports.code_detail(c, make.ref(REF), ClaimsFilter(category="Cat B", codes=["C1"])).collect()
    assert [r.hcpcs_code for r in rows] == ["C1"]


def test_code_in_two_categories_keeps_both(make):
    ref = make.ref(REF + [("C1", "Cat B", "Code one again")])
    c = make.claims([claim("1", "C1", "2020-01", claims=15), claim("1", "C3", "2020-01", claims=5)])
    cats = {r.category: r.total_claims for r in reports.category_summary(c, ref, ClaimsFilter(category="Cat B")).collect()}
    assert cats == {"Cat A": 15, "Cat B": 20}
    detail = {(r.hcpcs_code, r.category): r.total_claims for r in reports.code_detail(c, ref).collect()}
    assert detail == {("C1", "Cat A"): 15, ("C1", "Cat B"): 15, ("C3", "Cat B"): 5}


def test_directory_requires_a_state(make):
    with pytest.raises(ValueError):
        _dir(make, [claim("1", "C1", "2020-01")], [reg("1")], "billing", ClaimsFilter())
    with pytest.raises(ValueError):
        _dir(make, [claim("1", "C1", "2020-01")], [reg("1")], "nope")


def test_search(make):
    full = _dir(
        make,
        [claim("1234567890", "C1", "2020-01"), claim("2", "C1", "2020-01")],
        [reg("1234567890", org="Health (North)", city="Springfield"), reg("2", org="Other")],
        "billing",
    )
    assert refine.search(full, "").count() == 2
    assert [r.npi for r in refine.search(full, "SPRINGFIELD").collect()] == ["1234567890"]
    assert refine.search(full, "(north)").count() == 1
    assert refine.search(full, "45678").count() == 1
    assert refine.search(full, "fields1").count() == 0  # city + state: no match across cells
    assert refine.search(full, "none").count() == 0  # null cells hold no text


def test_pivot_hole_is_zero(make):
    c = make.claims([claim("1", "C1", "2020-01", claims=5), claim("1", "C2", "2020-02", claims=6)])
    rows = reshape.pivot_wide(reports.category_trend(c, make.ref(REF))).collect()
    assert [(r.month, r["Cat A"], r["Cat B"]) for r in rows] == [("2020-01", 5, 0), ("2020-02", 0, 6)]


def test_csv_round_trip(spark, tmp_path):
    from claimscope.sinks import csv as csv_sink

    df = spark.createDataFrame(
        [("a,b", 'say "hi"', Decimal("12345678.90")), (None, "", Decimal("0.01")), ("x\ny", "plain", None)],
        "a string, b string, paid decimal(18,2)",
    )
    back = csv_sink.export(df, str(tmp_path / "out"))
    got = sorted(back.collect(), key=lambda r: str(r.paid))
    want = sorted([("a,b", 'say "hi"', Decimal("12345678.90")), (None, None, Decimal("0.01")),
                   ("x\ny", "plain", None)], key=lambda r: str(r[2]))
    assert [tuple(r) for r in got] == want
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"say ""hi"""' in text and "12345678.90" in text and "E7" not in text


def test_duplicate_keys_raise(spark, make):
    with pytest.raises(schemas.SchemaError):
        schemas.assert_unique(make.registry([reg("1"), reg("1")]), "npi", "registry")
    with pytest.raises(schemas.SchemaError):
        schemas.assert_unique(make.ref(REF + [REF[0]]), "code", "ref")
    with pytest.raises(schemas.SchemaError):
        schemas.conform(spark.createDataFrame([("x",)], "code string"), schemas.CODE_REFERENCE, "ref")


def test_empty_result_gives_zero_kpis(make):
    c = make.claims([claim("1", "C1", "2020-01")])
    ov = reports.state_overview(c, ClaimsFilter(states=["nowhere"]))
    assert ov.count() == 0
    k = kpis.overview_kpis(ov).first()
    assert (k.states, k.providers, k.total_claims, float(k.total_paid)) == (0, 0, 0, 0.0)


def test_category_filter_standalone_is_semi_join(make):
    ref = make.ref(REF)
    c = make.claims([claim("1", "C1", "2020-01"), claim("1", "C2", "2020-01"), claim("1", "C9", "2020-01")])
    assert sorted(r.code for r in flt.by_category(c, ref, "Cat B").collect()) == ["C2"]
    assert flt.by_category(c, ref, "Cat B").columns == c.columns


def test_served_category_facet(make):
    d = _dir(make, [claim("1", "C1", "2020-01"), claim("2", "C2", "2020-01")],
             [reg("1", org="X"), reg("2", org="Y")], "billing")
    assert [r.category for r in facets.served_categories(d).collect()] == ["Cat A", "Cat B"]


def test_partition_column_reads_as_string(spark, make, tmp_path):
    from claimscope.sources.loaders import load_claims

    c = make.claims([claim("1", "C1", "2020-01"), claim("1", "C1", None)])
    prep.write_claims(c, str(tmp_path / "fact"))
    back = load_claims(spark, str(tmp_path / "fact"))
    assert dict(back.dtypes)["claim_year"] == "string"
    assert sorted(back.select("claim_year").collect(), key=str) == sorted([("2020",), (None,)], key=str)
    assert back.where(F.col("claim_year").isin("2020")).count() == 1


def test_keyword_codes_and_crosswalk(spark):
    codes = spark.createDataFrame(
        [("J1", "Injection, cabotegravir, for PrEP"), ("8", "HIV-1 viral load assay"), ("Z", "Unrelated")],
        "code string, description string",
    )
    found = prep.keyword_codes(codes)
    assert sorted(r.code for r in found.collect()) == ["8", "J1"]
    cw = prep.crosswalk(found, [(("prep",), "PrEP"), (("viral load", "hiv"), "Lab")], default="Other")
    assert {r.code: r.category for r in cw.collect()} == {"J1": "PrEP", "8": "Lab"}
