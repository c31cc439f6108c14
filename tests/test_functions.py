import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import classify, dates, extract, parties, text


def values(spark, inputs, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, x string")
    rows = df.select("k", *[e(F.col("x")).alias(f"e{i}") for i, e in enumerate(exprs)]).orderBy("k").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows]


def test_classifier(spark):
    cases = {
        "ENOXAPARIN SODIUM": ("OTHER", None),
        "axicabtagene ciloleucel": ("CELL_THERAPY", None),
        "elivaldogene autotemcel": ("GENE_THERAPY", None),
        "ARSENIC TRIOXIDE": ("SMALL_MOLECULE", None),
        "CILASTATIN": ("SMALL_MOLECULE", None),
        "CILASTATIN; LOSARTAN": ("SMALL_MOLECULE", "Angiotensin receptor blocker (ARB)"),
        "Measles Vaccine, Live": ("VACCINE", None),
        "Coagulation Factor IX": ("OTHER", "Clotting factor"),
        "atorvastatin CALCIUM": ("SMALL_MOLECULE", "Statin"),
        "veligrotug": ("MONOCLONAL_ANTIBODY", None),
        "Nusinersen": ("OLIGONUCLEOTIDE", None),
        "": ("SMALL_MOLECULE", None),
        None: ("SMALL_MOLECULE", None),
    }
    got = values(spark, list(cases), lambda c: classify.modality(c, "SMALL_MOLECULE"), classify.drug_class)
    assert dict(zip(cases, got, strict=True)) == cases
    assert values(spark, ["DRUG-A/DRUG-B (COMBO)", "ENOXAPARIN SODIUM"], classify.tokens) == [["druga", "drugb", "combo"], ["enoxaparin"]]


def test_dates(spark):
    assert values(spark, ["Jan 5, 2031", "Feb 30, 2031", "Approved Prior to Jan 1, 1982", "", None], dates.short_month_date) == [dt.date(2031, 1, 5), None, None, None, None]
    assert values(spark, ["15-Jan-74", "25-Jan-31", "1-dec-50", "1-Dec-51", "January 4, 2031", "Date TBD", "31-Feb-20", None], dates.pivot_year_date) == [dt.date(1974, 1, 15), dt.date(2031, 1, 25), dt.date(2050, 12, 1), dt.date(1951, 12, 1), dt.date(2031, 1, 4), None, None, None]
    assert values(spark, ["2/11/2020", "13/1/2020", "2/30/2021", "x", None], dates.rolling_date) == [dt.date(2020, 2, 11), dt.date(2021, 1, 1), dt.date(2021, 3, 2), None, None]
    now = F.lit(dt.date(2026, 1, 1))
    assert values(spark, ["2026-01-01", "2026-06-01", "2027-06-01", "2030-01-01", None], lambda c: dates.urgency(c.cast("date"), now)) == ["open", "imminent", "upcoming", "distant", None]
    assert values(spark, ["2026-01-01", "2026-01-02", "2025-12-30", "2026-04-01", "2030-01-01", "2020-01-01"], lambda c: dates.relative_days(c.cast("date"), now)) == ["Today", "in 1 day", "2 days ago", "in 3 months", "in 4 years", "6 years ago"]
    assert values(spark, ["2031-08-04", None], lambda c: dates.shown_date(c.cast("date"))) == ["Aug 4, 2031", None]


def test_text(spark):
    assert values(spark, ["<p>A&nbsp;b</p> \n c&amp;d", None, ""], text.strip_html) == ["A b c&d", None, ""]
    assert values(spark, ["ACME-labs OF new/york", ""], text.title_case) == ["Acme-Labs Of New/York", ""]
    assert values(spark, ["12 x", " -3", "x1", None], text.leading_int) == [12, -3, None, None]
    assert values(spark, ["5 mg ", None], text.compact_upper) == ["5MG", None]
    assert values(spark, ["a@x.org", "B@Y.org", "c@z.org", None], lambda c: text.allowed(c, ["a@x.org", "@y.org"])) == [True, True, False, False]
    sims = values(spark, ["word", "words", "zzz", ""], lambda c: text.similarity(c, F.lit("word")))
    assert sims[0] == 1 and sims[1] == pytest.approx(4 / 7) and sims[2:] == [0, 0]


def test_parties(spark):
    assert values(spark, ["TEVA PHARMACEUTICALS USA, INC.", "Inc", "Pharma Co", "Acme Incident", "  A&B  Ltd ", None], parties.company) == ["teva", "inc", "pharma", "acme incident", "a b", None]
    got = values(spark, ["A Inc. v. B Ltd", "A VS. B", "A and B", "A v. B v. C", " v. B", None], parties.sides)
    assert [tuple(g) if g else None for g in got] == [("A Inc.", "B Ltd"), ("A", "B"), None, None, None, None]
    assert values(spark, ["830 Patent", "35:271 patent infringement", "8301", None], lambda c: parties.is_patent_case(c, F.lit(None).cast("string"))) == [True, True, False, False]
    assert values(spark, ["deld", "njd", "x"], parties.court) == ["DE", "NJ", None]


def test_confidence_tiers(spark):
    rows = [("plaintiff", "exact", "c", 1, True), ("plaintiff", "exact", "c", 0, True), ("plaintiff", "exact", "c", 4, True), ("plaintiff", "exact", None, 1, True), ("defendant", "exact", "c", 1, True), ("plaintiff", "fuzzy", "c", 1, True), ("plaintiff", "exact", "c", 1, False), ("unmatched", "none", None, 0, False)]
    df = spark.createDataFrame(rows, "role string, m string, d string, n int, p boolean")
    got = [r[0] for r in df.coalesce(1).select(parties.confidence(F.col("role"), F.col("m"), F.col("d"), F.col("n"), F.col("p"))).collect()]
    assert [g["tier"] for g in got] == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "LOW", "LOW", "LOW", "LOW"]
    assert "4 products" in got[2]["note"] and got[7]["note"].count(";") == 1


def test_complaints(spark):
    body = 'generic versions of Brandix® (brandine tablets, 550 mg) before U.S. Patent Nos. 11,779,571 ("A"), 8,193,196 and 11,779,571. Later 9,999,999 stands alone. ANDA No. 221289 and ANDA No. 5'
    a, b = values(spark, [body, "nothing"], extract.complaint_facts)
    assert a["patent_numbers"] == ["11779571", "8193196"] and (a["brand_name"], a["strength"], a["application_number"]) == ("Brandix", "550 mg", "221289")
    assert b["patent_numbers"] == [] and b["brand_name"] is None


def test_settlements(spark):
    body = (
        "Brandix® Paragraph IV Patent Litigation (Actor) - On September 12, 2018, we announced that we had reached an agreement ... beginning January 1, 2028 (or earlier under certain circumstances). "
        'Brandix Patent Litigation ("Other") - The trial goes on. Brandix Patent Litigation (Third) - a settlement agreement was signed.'
    )
    other = "A.b(c)\\E Patent Litigation (Solo) - On May 1, 2020, the Company announced a settlement agreement. " + "x" * 3000 + " beginning January 1, 2030"
    df = spark.createDataFrame([(1, body, "brandix"), (2, body, "None"), (3, None, "x"), (4, other, "A.b(c)\\E"), (5, body, None), (6, body, "")], "k int, text string, product string")
    got = extract.settlements(df).orderBy("k", "place").collect()
    assert [(s["k"], s["place"], s["counterparty"], s["licensed_entry"], s["announced"], s["earlier"], s["confidence"]) for s in got] == [
        (1, 0, "Actor", dt.date(2028, 1, 1), dt.date(2018, 9, 12), True, "HIGH"),
        (1, 2, "Third", None, None, False, "LOW"),
        (4, 0, "Solo", None, dt.date(2020, 5, 1), False, "MEDIUM"),
    ]
    assert got[0]["note"] == "the heading of Actor and a licensed entry, beginning January 1, 2028" and "May 1, 2020" in got[2]["note"] and "no date" in got[1]["note"]
    assert len(got[2]["excerpt"]) == extract.EXCERPT


def test_challenge_cells(spark):
    got = values(spark, ["Ziagen\n20977", "Bijuva\nNDA 210132", "Pain\n(mild)\n20802", "Pepcid", "X\n1234567", ""], extract.listed_product)
    assert [tuple(g) for g in got] == [("Ziagen", "NDA020977", None), ("Bijuva", "NDA210132", None), ("Pain (mild)", "NDA020802", None), ("Pepcid", None, None), ("X", None, "1234567"), ("", None, None)]
    sent = values(spark, ["Pre-MMA", "PIV received prior to 8/18/2003", "2/11/2020", "soon"], extract.submission)
    assert [(s["kind"], s["date"], s["issue"] is None) for s in sent] == [("PRE_MMA", None, True), ("RECEIVED_PRIOR_TO", dt.date(2003, 8, 18), True), ("EXACT_DATE", dt.date(2020, 2, 11), True), ("EXACT_DATE", None, False)]

    def told(status, posting):
        r = spark.range(1).select(extract.decisions(F.lit(status), F.lit(posting)).alias("d")).first()["d"]
        return [(h["status"], h["posting_date"]) for h in r["history"]], r["ambiguous"]

    assert told("Extinguished\nEligible", "1/12/2021\n2/11/2020") == ([("EXTINGUISHED", dt.date(2021, 1, 12)), ("ELIGIBLE", dt.date(2020, 2, 11))], False)
    assert told("40 u/100 mL -\nExtinguished", "1/12/2021") == ([("EXTINGUISHED", dt.date(2021, 1, 12))], False)
    assert told("Extinguished", "") == ([("EXTINGUISHED", None)], False)
    assert told("Maybe", "1/1/2020") == ([("ELIGIBLE", dt.date(2020, 1, 1))], True)
    assert told("Eligible", "1/1/2020\n1/2/2020")[1] and told("Eligible", "soon")[1]
    assert told("", "") == ([], False)
    dates_ = values(spark, ["", "1/2/2020", "1/2/2020 - 5mg 1/3/2020", "x"], lambda c: extract.single_date(c, "marketing"))
    assert [(s["date"], s["issue"] is None) for s in dates_] == [(None, True), (dt.date(2020, 1, 2), True), (None, False), (None, False)]


def test_roles_and_manual_tiers(spark):
    assert values(spark, ["a", "b", "c", None], lambda c: parties.role(c, F.lit("a"), F.lit("b"))) == ["plaintiff", "defendant", "unmatched", "unmatched"]
    assert values(spark, ["Acme Inc.  (ACME)  (CIK 0000885590)", "Acme (US) Inc", "Bob (B.K) (cik 12) "], parties.filer_name) == ["Acme Inc.", "Acme (US) Inc", "Bob"]
    rows = [("exact", "exact", 1, True), ("exact", "exact", 2, True), ("fuzzy", "exact", 1, True), ("exact", "none", 1, False), ("none", "none", 0, True), ("none", "fuzzy", 1, True)]
    df = spark.createDataFrame(rows, "a string, z string, n int, p boolean")
    told = [r[0] for r in df.coalesce(1).select(parties.manual_confidence(*map(F.col, "aznp"))).collect()]
    assert [r["tier"] for r in told] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "NONE", "MEDIUM"] and len({r["note"] for r in told}) == 5


def test_html_in_one_pass(spark):
    import random
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", ">", "a", " b", "\n", "<b>", "</b>", "&amp;"]) for _ in range(rng.randrange(0, 25))) for _ in range(400)] + ["", "<", ">", "<>", "a<b", "a>b<c"]
    got = values(spark, [*texts, None], lambda c: text.without_tags(c, "_"))
    assert got == [re.sub("<[^>]*>", "_", t) for t in texts] + [None]
    long = spark.range(1).select(*[F.length(text.strip_html(F.expr(f"repeat('{unit}', {3_000_000 // len(unit)})"))).alias(str(i)) for i, unit in enumerate(["<", "<a ", "x<b>y"])]).first()
    assert tuple(long) == (3_000_000, 2_999_999, 1_800_000)


def test_links_and_lists_of_broken_pages(spark):
    from tideline.sources import monthly

    page = '<a href="x"><b>The List</b></A> <a title="a list" href="y">no</a> <a href="z">other</a> <a href="open">list <abbr>list</abbr>'
    assert sorted(r["href"] for r in monthly.links(spark.createDataFrame([(page,), (None,), ("<a <a <a",)], "html string"), "LIST").collect()) == ["x", "y"]
    many = spark.range(1).select(F.expr("concat(repeat('<a ', 300000), repeat('<table ', 100000), repeat('<tr ', 100000))").alias("html"))
    assert monthly.links(many, "x").count() == 0 and monthly.patent_list(many, "t").count() == 0
