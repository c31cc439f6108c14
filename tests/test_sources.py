import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.sources import layout, monthly, tilde


@pytest.fixture
def lines(spark):
    return lambda raws: spark.createDataFrame([(i + 1, r) for i, r in enumerate(raws)], "line long, raw string")


def test_tilde_products(lines):
    head = "~".join(["h"] * 14)
    row = lambda **k: "~".join({**dict(zip(range(14), ["ING", "TABLET;ORAL", "Brand", "x", "5MG", "N", "012345", "001", "x", "Jan 5, 2001", "x", "x", "x", "Acme Inc"], strict=True)), **{int(i[1:]): v for i, v in k.items()}}.values())
    good, issues = tilde.products(lines([head, row(), row(_5="A", _9="Approved Prior to Jan 1, 1982"), row(_5="X"), row(_1="TABLET"), row(_13=" "), row(_6=""), "a~b"]))
    got = sorted(good.collect(), key=lambda r: r["line"])
    assert [(r["application_number"], r["form"] if "form" in r else r["dosage_form"], r["route"], r["approval_date"]) for r in got] == [("NDA012345", "TABLET", "ORAL", dt.date(2001, 1, 5)), ("ANDA012345", "TABLET", "ORAL", None)]
    assert sorted(r["line"] for r in issues.collect()) == [4, 5, 6, 7, 8]


def test_tilde_patents(lines):
    def row(no, date="Jan 1, 2030", use="", flag="Y", kind="N"):
        return "~".join([kind, "012345", "001", no, date, flag, "", use, "", "Feb 1, 2010"])

    raws = ["h"] + [row("111"), row("111*PED", "Jul 1, 2030"), row("222*PED", "Mar 1, 2031"), row("333", use="U-1"), row("333", use="U-2"), row("333", "Jan 2, 2031", use="U-1"), row("444*XX"), row("555", "soon"), row("666", "soon"), row("666*PED", "Jan 1, 2032"), row("777", kind="Z")]
    good, issues = tilde.patents(lines(raws))
    got = {(r["patent_number"], r["use_code"]): (r["nominal_expiry"], r["expiry"], r["adjustment_days"]) for r in good.collect()}
    d = dt.date
    assert got == {
        ("111", ""): (d(2030, 1, 1), d(2030, 7, 1), 181),
        ("222", ""): (d(2031, 3, 1), d(2031, 3, 1), None),
        ("333", "U-1"): (d(2030, 1, 1), d(2030, 1, 1), None),
        ("333", "U-2"): (d(2030, 1, 1), d(2030, 1, 1), None),
        ("444", ""): (d(2030, 1, 1), d(2030, 1, 1), None),
        ("666", ""): (d(2032, 1, 1), d(2032, 1, 1), None),
    }
    kinds = {r["category"]: r["n"] for r in tilde.issue_categories(issues).collect()}
    assert kinds['unreadable date "…"'] == 2 and kinds["no usable date"] == 1 and kinds['unknown suffix "…"'] == 1 and kinds["a marked row without a plain one: its date is used for both"] == 1


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text("\n".join(f"row {i}" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = tilde.numbered_lines(spark, str(tmp_path / "f.txt"))
        assert got.count() == 5000 and got.filter("raw != concat('row ', line)").count() == 0
        (tmp_path / "g.txt").write_text("\n\n".join(f"row {i}" for i in range(1, 3001)) + "\n\n\n")  # empty lines count for nothing
        got = tilde.numbered_lines(spark, str(tmp_path / "g.txt"))
        assert got.count() == 3000 and got.filter("raw != concat('row ', line)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_monthly_csv(lines):
    head = ["N/R/U", "Applicant", "BLA Number", "Proprietary Name", "Proper Name", "License Type", "Strength", "Dosage Form", "Route of Administration", "Product Number", "Marketing Status", "Approval Date", "Center", "Ref. Product Proper Name", "Ref. Product Proprietary Name", *[n for n, _, _ in monthly.EXCLUSIVITIES]]
    row = lambda **k: ",".join({**dict.fromkeys(head, ""), "Applicant": '"Acme, ""Bio"" Inc."', "BLA Number": "125", "Product Number": "001", "Proprietary Name": "Brand", "Proper Name": "proper", "License Type": "351(a)", "Center": "cder", "Approval Date": "15-Jan-74", "Ref. Product Proper Name": "N/A", **{n.replace("_", " "): v for n, v in k.items()}}.values())
    two = {"Ref. Product Exclusivity Exp. Date": "25-Jan-31", "First Interchangeable Exclusivity Exp. Date": "Date TBD", "Orphan Exclusivity Exp. Date": "nonsense"}
    raws = ["title", ",".join(head), row(**{"BLA Number": "old"}), "", ",".join(head), row(), row(**two), row(**{"License Type": "x"}), row(Center="y"), row(Applicant=""), "a,b"]
    rows, bad = monthly.section(lines(raws), head)
    assert rows.count() == 5 and bad.count() == 1
    good, odd = monthly.products(rows)
    got = good.collect()
    assert len(got) == 2 and got[0]["company"] == 'Acme, "Bio" Inc.' and got[0]["approval_date"] == dt.date(1974, 1, 15) and got[0]["reference_alt_name"] is None and got[0]["center"] == "CDER"
    assert odd.count() == 3
    codes, unread = monthly.exclusivities(good)
    assert [(r["code"], r["expiry"]) for r in codes.collect()] == [("BPCIA_REF_PRODUCT", dt.date(2031, 1, 25))]
    assert [r["reason"] for r in unread.collect()] == ['unreadable Orphan Exclusivity Exp. Date "nonsense"']
    none, issue = monthly.section(lines(["a,b"]), head)
    assert none.count() == 0 and issue.first()["reason"] == "no header row"
    changed = [*head[:-1], "New"]
    assert "columns differ" in monthly.section(lines([",".join(changed)]), head)[1].first()["reason"]


def test_html(spark):
    cells = lambda *c: f'<tr valign="top">{"".join(f"<td>{x}</td>" for x in c)}</tr>'
    page = f'<a href="/a">Patent <b>List</b></a><a href="/b" title="The LIST">x</a><table id="t">{cells("BLA 125", "A &amp; B", "Name", "proper", "8,512,983", "January 4, 2031")}{cells("only", "five")}</table>'
    df = spark.createDataFrame([(page,), (None,)], "html string")
    (row,) = monthly.patent_list(df, "t").collect()
    assert tuple(row) == ("125", "A & B", "Name", "proper", "8512983", dt.date(2031, 1, 4))
    assert sorted(r["href"] for r in monthly.links(df, "list").collect()) == ["/a", "/b"]


def test_printed_table(spark):
    items = [(1, "Name", 50.0, 520.0), (1, "(brand)", 60.0, 510.0), (1, "Status", 200.0, 520.0), (1, "Alpha", 50.0, 450.0), (1, "Beta", 90.0, 450.0), (1, "two", 50.0, 440.0), (1, "Eligible", 201.0, 445.0), (2, "Gamma", 50.0, 400.0), (2, " ", 50.0, 400.0)]
    rects = [(1, 40.0, 500.0, 600.0, 530.0), (1, 40.0, 430.0, 600.0, 460.0), (1, 40.0, 430.0, 500.0, 460.0), (1, 40.0, 380.0, 100.0, 420.0), (2, 40.0, 390.0, 600.0, 410.0), (2, 40.0, 300.0, 600.0, 320.0)]
    i, r = spark.createDataFrame(items, "page int, str string, x double, y double"), spark.createDataFrame(rects, "page int, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(x) for x in layout.table(i, r, ["name", "status"]).orderBy("page", "band").collect()]
    assert got == [(1, 1, "Alpha Beta\ntwo", "Eligible"), (2, 1, "Gamma", ""), (2, 2, "", "")]
    with pytest.raises(ValueError):
        layout.table(i, r, ["a", "b", "c"])


def test_archives_and_addresses(spark, tmp_path):
    import zipfile

    from tideline.sources import archive

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("in/Products.TXT", "h\r\na~b\n\n")
        z.writestr("patent.txt", "\ufeff" + "x~y\r\n" * 400_000)
    got = archive.members(spark, str(tmp_path / "r.zip"), ["products.txt", "Patent.txt"])
    assert [tuple(r) for r in tilde.numbered_lines(spark, got["products.txt"]).collect()] == [(1, "h"), (2, "a~b")]
    patents = tilde.numbered_lines(spark, got["Patent.txt"])
    assert patents.count() == 400_000 and patents.filter("raw != 'x~y'").count() == 0
    with pytest.raises(ValueError, match="in/Products.TXT"):
        archive.members(spark, str(tmp_path / "r.zip"), ["exclusivity.txt"])
    assert archive.monthly_addresses("https://x.org/", dt.date(2026, 1, 5)) == ["https://x.org/2026/january", "https://x.org/2025/december"]
    assert archive.is_apology("<!DOCTYPE html><body>We apologize") and not archive.is_apology("N/R/U,Applicant")


def test_search_hits(spark):
    from tideline.sources import responses

    one = '{"docket_id": 1, "caseName": "A v. B", "docketNumber": "1:20", "court_id": "deld", "dateFiled": "2020-01-02", "assignedTo": "", "cause": "35:271"}'
    body = f'{{"results": [{one}, {one.replace(": 1,", ": null,")}, {one.replace(": 1,", ": \"1\",")}, {one.replace("docketNumber", "other")}, {one.replace(chr(34) + "1:20" + chr(34), "7")}, {one.replace("2020-01-02", "soon").replace(": 1,", ": 3,")}]}}'
    good, bad = responses.hits(spark.createDataFrame([(7, body), (8, "no JSON"), (9, None), (10, '{"results": 5}')], "company_id int, body string"))
    assert sorted((r["docket_id"], r["filed"], r["judge"], r["cause"]) for r in good.collect()) == [(1, dt.date(2020, 1, 2), None, "35:271"), (3, None, None, "35:271")] and bad.count() == 4


def test_changed_header_and_exclusivities(lines):
    raws = ["a~b~c", "N~012345~001~NCE~Jan 5, 2031", "N~012345~001~NCE~soon", "Q~1~1~X~Jan 5, 2031", "A~1~1~~Jan 5, 2031"]
    good, issues = tilde.exclusivities(lines(raws))
    assert [(r["application_number"], r["code"], r["expiry"]) for r in good.collect()] == [("NDA012345", "NCE", dt.date(2031, 1, 5))]
    assert sorted((r["line"], r["reason"]) for r in issues.collect())[0] == (1, "header has 3 columns, expected 5") and issues.count() == 4


def test_first_entries_and_their_cases(spark):
    from tideline.sources import responses

    body = '{"results": [{"recap_documents": [{"plain_text": ""}, {"plain_text": 5}, {"plain_text": "yes"}, {"plain_text": "later"}]}, {"recap_documents": [{"plain_text": "other"}]}]}'
    rows = [(1, 200, body), (2, 404, None), (3, 500, body), (4, 200, '{"results": []}'), (5, 200, '{"results": [{"recap_documents": [{}]}]}'), (6, 200, "<html>"), (7, 401, body), (8, 200, '{"results": [{}]}'), (9, 200, "{}")]
    entries = responses.first_entry(spark.createDataFrame(rows, "docket_id int, code int, body string"))
    assert [(r["status"], r["text"]) for r in entries.orderBy("docket_id").collect()] == [("found", "yes"), ("error", None), ("error", None), ("missing", None), ("empty", None), ("error", None), ("denied", None), ("empty", None), ("missing", None)]
    d = lambda n: dt.date(2020, 1, n)
    dockets = [("a", 2, d(1)), ("a", 1, d(2)), ("b", 7, d(1)), ("b", 1, d(2)), ("c", 7, None), ("c", 1, d(2)), ("d", 4, d(1)), ("d", 5, d(2)), ("e", 3, d(1)), ("f", None, d(1))]
    got = responses.case_texts(spark.createDataFrame(dockets, "case_id string, docket_id int, filed date"), entries)
    assert {r["case_id"]: (r["status"], r["docket_id"], r["text"]) for r in got.collect()} == {"a": ("found", 1, "yes"), "b": ("denied", None, None), "c": ("found", 1, "yes"), "d": ("empty", None, None), "e": ("missing", None, None), "f": ("missing", None, None)}


def test_terms(spark):
    from tideline.sources import responses

    bag = lambda *e: '{"patentFileWrapperDataBag": [' + ", ".join(e) + "]}"
    entry = lambda days, filing='"2001-11-01"': f'{{"patentTermAdjustmentData": {{"adjustmentTotalQuantity": {days}}}, "applicationMetaData": {{"filingDate": {filing}}}}}'
    plain = '{"applicationMetaData": {"filingDate": "1990-01-01"}}'
    said = [("a", 200, bag(entry(0))), ("b", 200, bag(plain, entry(7))), ("c", 200, bag(plain)), ("d", 200, bag(entry('"7"'))), ("e", 200, bag(entry("null"))), ("f", 200, bag(entry(7, "null"))), ("g", 200, bag(entry(7, '"soon"')))]
    said += [("h", 200, bag()), ("i", 200, "{}"), ("j", 200, "<html>"), ("k", 403, None), ("l", 404, None), ("m", 429, bag(entry(7))), ("n", 200, None), ("o", 200, '{"patentFileWrapperDataBag": 5}'), ("p", 200, bag('{"patentTermAdjustmentData": {}}'))]
    got = {r["patent_number"]: (r["status"], r["filing"], r["days"]) for r in responses.terms(spark.createDataFrame(said, "patent_number string, code int, body string")).collect()}
    day, none = dt.date(2001, 11, 1), (None, None)
    assert got == {"a": ("ok", day, 0), "b": ("ok", day, 7), "c": ("not_found", *none), "d": ("not_found", *none), "e": ("not_found", *none), "f": ("ok", None, 7), "g": ("ok", None, 7), "h": ("not_found", *none), "i": ("not_found", *none), "j": ("error", *none), "k": ("denied", *none), "l": ("not_found", *none), "m": ("error", *none), "n": ("error", *none), "o": ("not_found", *none), "p": ("not_found", *none)}


def test_lines_are_read_once_whatever_is_asked_of_them(spark):
    head = F.when(F.col("id") == 0, "h~h")
    made = lambda raw: spark.range(20).select((F.col("id") + 1).alias("line"), F.coalesce(head, F.expr(raw)).alias("raw"))
    read = {
        tilde.products: made("concat('I~TABLET;', id % 2, '~B~x~5MG~N~', id, '~001~x~Jan 5, 2001~x~x~x~A')"),
        tilde.patents: made("concat('N~', id, '~001~', if(id % 3 = 0, '1*PED', '1'), '~', if(id % 2 = 0, 'soon', 'Jan 5, 2001'), '~Y~~~~')"),
        tilde.exclusivities: made("concat('N~', id, '~001~NCE~', if(id % 2 = 0, 'soon', 'Jan 5, 2001'))"),
    }
    for reader, lines_ in read.items():
        for part in reader(lines_):
            assert part.count() > 0 and "Range (" not in part._jdf.queryExecution().toString()
