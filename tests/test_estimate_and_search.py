import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import detail, estimate, search, stats

AS_OF = dt.date(2026, 1, 1)


def day(n):
    return AS_OF + dt.timedelta(days=n)


def product(source, pid, name, company="Acme", modality="SMALL_MOLECULE", cls=None, app="NDA", form="TABLET", route="ORAL"):
    return (source, pid, name, name.lower() + "ol", company, modality, cls, app, form, route, "5MG", pid, "001")


def patent(source, pid, number, expiry, adjustment=None, live=True, substance=True, prod=False, use=""):
    return (source, pid, number, use, expiry, expiry, adjustment, None, substance, prod, live)


@pytest.fixture(scope="module")
def data(spark):
    products = [
        product("A", "alpha", "AlphaDrug"),
        product("A", "beta", "BetaMed", cls="Statin", form="CAPSULE"),
        product("A", "gamma", "Gamma_Cure", company="50% Co", modality="PEPTIDE", app="ANDA", form="INJECTABLE", route="INTRAVENOUS"),
        product("A", "delta", "DeltaForm"),
        product("A", "eps", "EpsilonGen", app="ANDA"),
        product("A", "zeta", "ZetaOld"),
        product("B", "bio", "Biozumab", modality="MONOCLONAL_ANTIBODY", app=None),
        product("B", "sim", "Biosim-Alfa", modality="UNCLASSIFIED", app=None),
    ]
    patents = [
        patent("A", "alpha", "1", day(10)),
        patent("A", "beta", "2", day(100), substance=False, prod=True),
        patent("A", "gamma", "3", day(1000), use="U-1"),
        patent("A", "delta", "4", day(-30)),
        patent("A", "zeta", "5", day(500), live=False),
        patent("B", "bio", "6", day(600), adjustment=200),
    ]
    exclusivities = [("A", "beta", "NCE", day(200)), ("B", "bio", "ORPHAN", day(50)), ("B", "sim", "BPCIA_REF_PRODUCT", day(300))]
    p, t, e = spark.createDataFrame(products, schemas.PRODUCT), spark.createDataFrame(patents, schemas.PATENT), spark.createDataFrame(exclusivities, schemas.EXCLUSIVITY)
    return p, t, e, estimate.estimates(p, t, e).cache()


def listed(data, **asked):
    p, t, e, est = data
    q = search.ListQuery(AS_OF, **asked)
    presence = {k: est.filter(F.col("product_id").isin(v)) for k, v in {"has_challenge": ["alpha", "beta"], "has_marketing": ["beta"], "has_litigation": ["gamma"]}.items()}
    rows = search.prepared(est, q, t, e, **presence)
    return [r["product_id"] for r in search.page(rows, q).collect()], search.total(rows, q).first()["total"], rows, q


def test_estimates(data):
    rows = {r["product_id"]: r for r in data[3].collect()}
    assert (rows["alpha"]["estimate"], rows["alpha"]["confidence"]) == (day(10), "pending_verification")
    assert (rows["beta"]["estimate"], rows["beta"]["confidence"]) == (day(200), "confirmed")
    assert (rows["bio"]["estimate"], rows["bio"]["confidence"], rows["bio"]["max_gap_days"]) == (day(600), "confirmed", 200)
    assert rows["eps"]["estimate"] is None and rows["eps"]["confidence"] is None and rows["eps"]["patent_count"] == 0
    assert rows["zeta"]["estimate"] is None and rows["zeta"]["patent_count"] == 1  # delisted ones count


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ({}, ["delta", "alpha", "beta", "sim", "bio", "gamma"]),
        ({"sort": "entry_desc", "limit": 2}, ["gamma", "bio"]),
        ({"sort": "gap_desc", "limit": 2}, ["bio", "alpha"]),
        ({"limit": 2, "offset": 2}, ["beta", "sim"]),
        ({"offset": 50}, []),
        ({"q": "BETA"}, ["beta"]),
        ({"q": "%"}, ["gamma"]),
        ({"q": "a_c"}, ["gamma"]),
        ({"within_days": 100}, ["delta", "alpha"]),
        ({"expires_after": day(200), "expires_before": day(300)}, ["beta", "sim"]),
        ({"modality": ["PEPTIDE", "MONOCLONAL_ANTIBODY"]}, ["bio", "gamma"]),
        ({"drug_class": ["Statin"]}, ["beta"]),
        ({"application_type": ["ANDA"]}, ["gamma"]),
        ({"dosage_form": ["CAPSULE"], "route": ["ORAL"]}, ["beta"]),
        ({"company": ["50% Co"]}, ["gamma"]),
        ({"source": ["B"]}, ["sim", "bio"]),
        ({"patent_type": ["product"]}, ["beta"]),
        ({"patent_type": ["use", "product"]}, ["beta", "gamma"]),
        ({"exclusivity_code": ["ORPHAN", "NCE"]}, ["beta", "bio"]),
        ({"min_gap_days": 150}, ["bio"]),
        ({"has_challenge": True}, ["alpha", "beta"]),
        ({"has_challenge": False, "source": ["A"]}, ["delta", "gamma"]),
        ({"has_marketing": True}, ["beta"]),
        ({"has_litigation": True}, ["gamma"]),
    ],
)
def test_lists(data, asked, want):
    ids, total, _, _ = listed(data, **asked)
    assert ids == want
    if "limit" not in asked and "offset" not in asked:
        assert total == len(want)


def test_total_is_true_past_the_end(data):
    assert listed(data, offset=50)[1] == 6


def test_facets_leave_their_own_filter_out(data):
    *_, rows, q = listed(data, modality=["PEPTIDE"], source=["A"])
    got = {(r["facet"], r["value"]): r["n"] for r in search.facets(rows, q).collect()}
    assert got == {("modality", "SMALL_MOLECULE"): 3, ("modality", "PEPTIDE"): 1, ("application_type", "ANDA"): 1, ("dosage_form", "INJECTABLE"): 1, ("route", "INTRAVENOUS"): 1, ("source", "A"): 1}


def test_parsing():
    q = search.ListQuery.parse({"modality": "PEPTIDE, OTHER", "within_days": "30", "has_challenge": "true", "expires_after": "2026-02-01"}, AS_OF)
    assert q.modality == ["PEPTIDE", "OTHER"] and q.within_days == 30 and q.has_challenge is True and q.expires_after == dt.date(2026, 2, 1)
    for bad in ({"limit": "0"}, {"limit": "101"}, {"offset": "-1"}, {"sort": "x"}, {"within_days": "x"}, {"nope": "1"}, {"patent_type": "x"}, {"has_challenge": "maybe"}, {"expires_after": "2026-13-01"}):
        with pytest.raises(ValueError):
            search.ListQuery.parse(bad, AS_OF)
        assert search.ListQuery.parse(bad, AS_OF, lenient=True).limit == 50


def test_controlling_child_and_ties(spark):
    t = spark.createDataFrame([patent("A", "x", "9", day(5)), patent("A", "x", "8", day(5), adjustment=3), patent("A", "y", "1", day(1)), patent("A", "z", "1", day(9), live=False)], schemas.PATENT)
    e = spark.createDataFrame([("A", "x", "NCE", day(5)), ("A", "y", "ODE", day(2)), ("A", "w", "ODE", day(2))], schemas.EXCLUSIVITY)
    got = {r["product_id"]: (r["kind"], r["label"], r["confidence"]) for r in estimate.controlling(t, e).collect()}
    assert got == {"x": ("patent", "Patent 8", "confirmed"), "y": ("exclusivity", "Exclusivity ODE", "confirmed"), "w": ("exclusivity", "Exclusivity ODE", "confirmed")}
    # the list says confirmed where any child that attains the date is sure; the detail follows its one child
    tie = spark.createDataFrame([patent("A", "x", "1", day(5))], schemas.PATENT)
    p = spark.createDataFrame([product("A", "x", "X")], schemas.PRODUCT)
    one = e.filter("product_id = 'x'")
    assert estimate.estimates(p, tie, one).first()["confidence"] == "confirmed"
    assert estimate.controlling(tie, one).first()["confidence"] == "pending_verification"


def test_horizons_timeline_and_divergence(data, spark):
    est = data[3]
    row = stats.horizon_counts(est, AS_OF).first()
    assert (row["within_30"], row["within_90"], row["within_365"]) == (2, 2, 4)  # what has passed counts
    months = stats.timeline(est, AS_OF, 12).orderBy("month").collect()
    assert len(months) == 12 and months[0]["n"] == 1 and sum(r["n"] for r in months) == 3
    sold = spark.createDataFrame([("A", "beta", day(-30)), ("A", "beta", day(-10)), ("A", "alpha", day(3000)), ("A", "eps", day(-1))], "source string, product_id string, marketing_date date")
    assert stats.diverging(est, sold).count() == 2  # one product with two dates counts twice
    tiles = stats.portfolio(est, spark.createDataFrame([("ELIGIBLE",), (None,), ("EXTINGUISHED",)], "current_status string"), sold, AS_OF).first()
    assert (tiles["tracked"], tiles["active_challenges"], tiles["divergence"]) == (8, 2, 2)


def test_autocomplete_and_vocabulary(spark):
    names = [("A", "1", "Humalog"), ("A", "2", "Humulin N"), ("B", "3", "Humira"), ("B", "4", "Humira")]
    p = spark.createDataFrame([product(s, i, n) for s, i, n in names], schemas.PRODUCT)
    assert {r["name"] for r in search.autocomplete(p, "hum").collect()} == {"Humalog", "Humulin N", "Humira"}
    assert [r["name"] for r in search.autocomplete(p, "humira").collect()][0] == "Humira"
    assert len([r for r in search.autocomplete(p, "humira").collect() if r["name"] == "Humira"]) == 1
    assert search.autocomplete(p, "zzzznonexistent").count() == 0
    with pytest.raises(ValueError):
        search.autocomplete(p, "h", 26)
    got = {(r["facet"], r["value"]) for r in search.vocabulary([p], ["modality", "drug_class"], {"modality": ["OTHER"]}).collect()}
    assert got == {("modality", "SMALL_MOLECULE"), ("modality", "OTHER")}


def test_details(data):
    p, t, e, _ = data
    rows = {r["product_id"]: r for r in detail.product_details(p, t, e).collect()}
    assert [c["code"] for c in rows["beta"]["exclusivities"]] == ["NCE"] and rows["eps"]["patents"] == [] and rows["eps"]["controlling"] is None
    assert rows["bio"]["controlling"]["label"] == "Patent 6"
    assert [r["product_id"] for r in detail.lookup("US 3,", t, p, e).collect()] == ["gamma"]


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, None)], "id int, x string, y string")
    got = {(r["id"], r["rule"]) for r in schemas.violations(df, {"one parent": schemas.exactly_one("x", "y"), "x": F.col("x") == "a"}).collect()}
    assert got == {(2, "one parent"), (3, "one parent"), (3, "x")}
    assert schemas.duplicates(df, ["x"]).collect() == [("a", 2)]


def test_same_result_for_other_partitions(data, spark):
    p, t, e, est = data
    again = estimate.estimates(p.repartition(7), t.repartition(3), e.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, est.collect()))
