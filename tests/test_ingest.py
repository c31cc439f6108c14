import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tideline.operators import ingest, keys, runs
from tideline.operators.commits import Conflict, Store
from tideline.sources import monthly

NOW = dt.datetime(2026, 1, 1, 12)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/tables")


def rows(store, table, *columns):
    return sorted(tuple(r[c] for c in columns) for r in store.read(table, ingest.SCHEMAS[table]).collect())


# --- numbers and keys ---------------------------------------------------------------------------


def test_numbers_are_dense_whatever_the_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    want = {v: i + 5 for i, v in enumerate(sorted(r["v"] for r in df.collect()))}
    for parts in (1, 3, 17):
        assert {r["v"]: r["n"] for r in keys.numbered(df.repartition(parts), [F.col("v")], "n", 5).collect()} == want
    assert keys.numbered(df.limit(0), [F.col("v")], "n").count() == 0


def test_keys_stay_and_new_names_take_the_next(spark):
    none = spark.createDataFrame([], "name string, id long")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    one = keys.assign(none, names("b", "a", "b", None), ["name"], "id")
    assert {r["name"]: r["id"] for r in one.collect()} == {"a": 1, "b": 2}
    two = keys.assign(one, names("A", "b", "c").repartition(3), ["name"], "id")
    assert {r["name"]: r["id"] for r in two.collect()} == {"a": 1, "b": 2, "A": 3, "c": 4}
    assert sorted(map(tuple, keys.assign(two, names("c", "a"), ["name"], "id").collect())) == sorted(map(tuple, two.collect()))


# --- commits ------------------------------------------------------------------------------------


def test_several_tables_change_at_once(spark, store):
    one, two = spark.range(2).toDF("v"), spark.range(5).toDF("v")
    assert store.read("a", "v long").count() == 0 and store.last().version == 0
    first = store.commit(store.last(), {"a": store.stage("a", one), "b": store.stage("b", one)}, {"log": store.stage("log", one)})
    old = store.read("a", "v long")
    store.stage("a", two)  # a writer that dies here has changed nothing
    assert store.read("a", "v long").count() == 2 and store.last() == first
    store.commit(first, {"a": store.stage("a", two)}, {"log": store.stage("log", two)})
    assert old.count() == 2  # a reader of before goes on with what it has
    assert [store.read(t, "v long").count() for t in ("a", "b", "log")] == [5, 2, 7]
    assert store.read("log", "v long", first).count() == 2
    store.compact("log", "v long")
    assert store.read("log", "v long").count() == 7 and len(store.last().tables["log"]) == 1


def test_conflicts(spark, store):
    one = spark.range(1).toDF("v")
    base = store.last()
    store.commit(base, {"a": store.stage("a", one)})
    with pytest.raises(Conflict):
        store.commit(base, {"a": store.stage("a", one)})
    with pytest.raises(Conflict):
        store.commit(base, appended={"log": store.stage("log", one)}, unchanged=["a"])
    assert store.commit(base, {"b": store.stage("b", one)}, {"a": store.stage("a", one)}).version == 2  # others' tables and appends do not conflict
    assert store.read("a", "v long").count() == 2


@pytest.mark.parametrize("way", ["link", "rename"])
def test_one_of_many_writers_wins_a_version(spark, store, way):
    put = store.put_if_absent if way == "link" else store._renamed
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if put("log/00000000000000000009.json", str(k)) else None) for k in range(8 if way == "link" else 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and not put("log/00000000000000000009.json", "x") and store.versions() == [9]


def test_many_appends_at_once_are_all_kept(spark, store):
    one = spark.range(1).toDF("v")
    paths = [store.stage("log", one) for _ in range(6)]
    threads = [threading.Thread(target=lambda p=p: store.commit(store.last(), appended={"log": p})) for p in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(store.last().tables["log"]) == sorted(paths) and store.versions() == [1, 2, 3, 4, 5, 6]


def test_old_versions_expire(spark, store):
    one = spark.range(1).toDF("v")
    for _ in range(4):
        store.commit(store.last(), {"a": store.stage("a", one)})
    lost = store.stage("a", one)
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=25)
    assert store.expire(keep=2) == [] and store.versions() == [3, 4]  # too young to be deleted
    gone = store.expire(keep=2, now=later)
    assert lost in gone and len(gone) == 3 and store.read("a", "v long").count() == 1


# --- runs ---------------------------------------------------------------------------------------


def status(store):
    return sorted((r["source"], r["status"]) for r in runs.runs(store).collect())


def quiet(store, base, run_id, now, check):
    return runs.Loaded(appended={"log": store.stage("log", store.spark.range(1).toDF("v"))}, upserted={"t": 3})


def test_a_run_from_start_to_end(store):
    assert runs.run(store, "s", quiet, NOW) == "SUCCESS"
    (r,) = runs.runs(store).collect()
    assert (r["source"], r["status"], r["started_at"], r["rows_upserted"], r["summary"]) == ("s", "SUCCESS", NOW, 3, '{"issues": 0, "upserted": {"t": 3}}')
    assert store.read("log", "v long").count() == 1


def test_two_starters_and_a_stale_run(store):
    won = []

    def begin():
        try:
            won.append(runs.start(store, "s", NOW))
        except runs.Busy:
            pass

    threads = [threading.Thread(target=begin) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and status(store) == [("s", "RUNNING")]
    runs.start(store, "other", NOW)
    with pytest.raises(runs.Busy):
        runs.start(store, "s", NOW + 6 * HOUR)
    second = runs.start(store, "s", NOW + 7 * HOUR)
    assert status(store) == [("other", "RUNNING"), ("s", "FAILED"), ("s", "RUNNING")]
    with pytest.raises(runs.TakenOver):
        runs.end(store, store.last(), won[0], "s", "SUCCESS", NOW, NOW + 8 * HOUR)
    runs.end(store, store.last(), second, "s", "SUCCESS", NOW, NOW + 8 * HOUR)
    assert status(store) == [("other", "RUNNING"), ("s", "FAILED"), ("s", "SUCCESS")]


def test_a_failing_run_changes_nothing(store):
    def bad(store, base, run_id, now, check):
        store.stage("log", store.spark.range(1).toDF("v"))
        raise ValueError("no such file")

    assert runs.run(store, "s", bad, NOW) == "FAILED" and "log" not in store.last().tables
    assert "no such file" in runs.runs(store).first()["summary"]
    assert runs.run(store, "s", quiet, NOW + HOUR) == "SUCCESS"


def test_a_stopped_run_ends_and_so_does_its_chain(store):
    assert not runs.stop(store, "slow")

    def slow(store, base, run_id, now, check):
        threading.Timer(1, lambda: runs.stop(store, "slow")).start()
        wait = F.udf(lambda x: __import__("time").sleep(60) or x, "long")
        store.spark.range(4).select(wait("id")).collect()
        raise AssertionError("not stopped")

    ended = runs.run_all(store, {"first": quiet, "slow": slow, "last": quiet}, NOW)
    assert ended == [("first", "SUCCESS"), ("slow", "CANCELLED")], [r["summary"] for r in runs.runs(store).collect()]
    assert status(store) == [("first", "SUCCESS"), ("slow", "CANCELLED")]
    runs.start(store, "first", NOW)
    with pytest.raises(runs.Busy):
        runs.run_all(store, {"last": quiet, "first": quiet}, NOW)


def test_a_changed_table_makes_the_load_again(store):
    tried = []

    def load(store, base, run_id, now, check):
        tried.append(base.version)
        if len(tried) == 1:  # another source is faster
            other = store.last()
            store.commit(other, {"t": store.stage("t", store.spark.range(1).toDF("v"))})
        return runs.Loaded(replaced={"t": store.stage("t", store.read("t", "v long", base).unionByName(store.spark.range(5, 6).toDF("v")))})

    assert runs.run(store, "s", load, NOW) == "SUCCESS" and len(tried) == 2
    assert sorted(r["v"] for r in store.read("t", "v long").collect()) == [0, 5]


# --- loads --------------------------------------------------------------------------------------


def lines(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw, 1)), "line long, raw string")


def tilde_files(spark, products, patents=(), exclusivities=()):
    return {"products": lines(spark, "~".join("h" * 14), *products), "patents": lines(spark, "~".join("h" * 10), *patents), "exclusivities": lines(spark, "a~b~c~d~e", *exclusivities)}


def product(number, name, company, form="TABLET; ORAL"):
    return f"Calcium~{form}~{name}~x~5MG~N~{number}~001~x~Jan 5, 2001~x~x~x~{company}"


def test_tilde_runs(spark, store):
    one = tilde_files(spark, [product("1", "One", "Acme"), product("1", "Again", "Acme"), product("2", "Two", "Beta")], ["N~1~001~77~Jan 1, 2030~Y~~U-1~x~", "N~9~001~77~Jan 1, 2030~Y~~~x~"], ["N~1~001~NCE~Jan 1, 2031", "N~1~001~NCE~Jan 1, 2031"])
    assert runs.run(store, "tilde", ingest.tilde_load(one), NOW) == "PARTIAL"
    assert rows(store, "companies", "company_id", "name") == [(1, "Acme"), (2, "Beta")]
    assert rows(store, "products_a", "product_id", "name", "company_id", "modality") == [(1, "One", 1, "SMALL_MOLECULE"), (2, "Two", 2, "SMALL_MOLECULE")]
    assert rows(store, "issues", "file", "reason") == [
        ("exclusivity.txt", "1 rows repeat a key that was seen before in this run"),
        ("patent.txt", 'no product found for "NDA9/001"'),
        ("products.txt", "1 rows repeat a key that was seen before in this run"),
    ]
    (run,) = runs.runs(store).collect()
    assert (run["rows_upserted"], run["rows_skipped"]) == (4, 1)
    two = tilde_files(spark, [product("2", "Two!", "Acme"), product("3", "Three", "Gamma")], ["N~3~001~77~Jan 1, 2030~Y~~~x~"])
    assert runs.run(store, "tilde", ingest.tilde_load(two), NOW + HOUR) == "SUCCESS"
    assert rows(store, "products_a", "product_id", "name", "company_id") == [(1, "One", 1), (2, "Two!", 1), (3, "Three", 3)]
    assert rows(store, "patents_a", "product_id", "patent_number", "use_code") == [(1, "77", "U-1"), (3, "77", "")]
    assert rows(store, "records", "entity_kind", "entity_id", "verified_at") == [("exclusivity", "1/NCE/2031-01-01", NOW), ("patent", "1/77/U-1", NOW), ("patent", "3/77/", NOW + HOUR), ("product", "1", NOW), ("product", "2", NOW), ("product", "2", NOW + HOUR), ("product", "3", NOW + HOUR)]
    products, patents, exclusivities = ingest.canonical(store)
    assert sorted((r["product_id"], r["company"]) for r in products.collect()) == [("1", "Acme"), ("2", "Acme"), ("3", "Gamma")]
    assert patents.count() == 2 and exclusivities.count() == 1


HEAD = ["N/R/U", "Applicant", "BLA Number", "Proprietary Name", "Proper Name", "License Type", "Strength", "Dosage Form", "Route of Administration", "Product Number", "Marketing Status", "Approval Date", "Center", "Ref. Product Proper Name", "Ref. Product Proprietary Name", *[n for n, _, _ in monthly.EXCLUSIVITIES]]


def biologic(number, name, proper, product="001", ref="", ref_proper="", until=""):
    return f',Acme,{number},{name},{proper},351(a),5,VIAL,IV,{product},,5-Jan-01,CDER,{ref_proper},{ref},{until},,'


def test_monthly_run(spark, store):
    csv = lines(spark, ",".join(HEAD), biologic("1", "Alpha", "alphamab", until="5-Jan-31"), biologic("1", "Alpha", "alphamab", "002"), biologic("2", "Beta", "betamab", ref="ALPHA", ref_proper="x"), biologic("3", "Gamma", "gammamab", ref="Gamma", ref_proper="Alphamab"), biologic("4", "Delta", "deltamab", ref_proper="Betamab"), biologic("5", "Eps", "eps", ref="nobody"))
    cell = lambda *c: "<tr valign=\"top\">" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = f'<table id="patents">{cell("BLA 1", "Acme", "Alpha", "alphamab", "8,000,001", "January 4, 2031")}{cell("9", "x", "y", "z", "8,000,002", "January 4, 2031")}</table>'
    load = ingest.monthly_load(csv, HEAD, spark.createDataFrame([(page,)], "html string"))
    assert runs.run(store, "monthly", load, NOW) == "PARTIAL"
    found = {r["name"]: r["reference_id"] for r in store.read("products_b", ingest.SCHEMAS["products_b"]).filter("product_number = '001'").collect()}
    assert found == {"Alpha": None, "Beta": 1, "Gamma": None, "Delta": 3, "Eps": None}  # whose first name is its own is not asked for its second
    assert rows(store, "issues", "file", "reason", "raw") == [
        ("patent-list.html", 'no product found for "9"', "8000002"),
        ("products.csv", 'no known product for the reference "Gamma", which is kept as a name', "3/001"),
        ("products.csv", 'no known product for the reference "nobody", which is kept as a name', "5/001"),
    ]
    assert rows(store, "patents_b", "product_id", "patent_number") == [(1, "8000001"), (2, "8000001")]
    assert rows(store, "exclusivities_b", "product_id", "code") == [(1, "BPCIA_REF_PRODUCT")]
    base = store.last()
    theirs = store.read("patents_b", ingest.SCHEMAS["patents_b"], base).withColumns({"filing_date": F.lit(dt.date(2000, 1, 1)), "nominal_expiry": F.lit(dt.date(2020, 1, 1)), "expiry": F.lit(dt.date(2021, 1, 1))})
    store.commit(base, {"patents_b": store.stage("patents_b", theirs)})
    runs.run(store, "monthly", load, NOW + HOUR)  # what a second source has found out stays
    assert rows(store, "patents_b", "nominal_expiry", "expiry") == [(dt.date(2020, 1, 1), dt.date(2021, 1, 1))] * 2


CELLS = ["ingredient", "form", "strength", "listed", "submitted", "applicants", "status", "posting", "approval", "marketing", "expiration"]


def test_challenges_run(spark, store):
    products = [product("020977", "One", "Acme", "TABLET; ORAL"), product("020978", "Two", "Acme", "TABLET; ORAL"), product("020978", "Two", "Acme", "SOLUTION; ORAL").replace("~001~", "~002~"), product("020979", "Three", "Acme", "GEL; SKIN"), product("020979", "Three", "Acme", "CREAM; SKIN").replace("~001~", "~002~")]
    runs.run(store, "tilde", ingest.tilde_load(tilde_files(spark, products)), NOW)
    cell = lambda name, form, number: ("x", form, "5MG", f"{name}\n{number}", "1/5/2020", "1", "Eligible", "1/6/2020", "", "", "")
    listed = [cell("One", "Tablets", "20977"), cell("Two", "Tablets", "20978"), cell("Three", "Foam", "20979"), cell("Gone", "Foam", "30000"), ("x", "Foam", "5MG", "None", "1/5/2020", "1", "", "", "", "", "")]
    cells = lambda them: spark.createDataFrame([(i, *c) for i, c in enumerate(them)], "line long, " + ", ".join(f"{c} string" for c in CELLS))
    assert runs.run(store, "challenges", ingest.challenges_load(cells(listed)), NOW) == "PARTIAL"
    names = {r["challenge_id"]: r["name"] for r in store.read("challenges", ingest.SCHEMAS["challenges"]).collect()}
    numbers = {r["product_id"]: (r["application_number"], r["product_number"]) for r in store.read("products_a", ingest.SCHEMAS["products_a"]).collect()}
    links = lambda: sorted((names[r["challenge_id"]], *numbers[r["product_id"]]) for r in store.read("challenge_links", ingest.SCHEMAS["challenge_links"]).collect())
    want = [("One", "NDA020977", "001"), ("Three", "NDA020979", "001"), ("Three", "NDA020979", "002"), ("Two", "NDA020978", "001")]
    assert links() == want
    said = [r for _, r in rows(store, "issues", "file", "reason")]
    assert sorted(said) == ["no application number", "no application number", "no product has the application number NDA030000", 'the dosage form "Foam" is none of CREAM, GEL; linked to all 2 products of NDA020979']
    base = store.last()
    store.commit(base, {"products_a": store.stage("products_a", store.read("products_a", ingest.SCHEMAS["products_a"], base).filter("application_number <> 'NDA020977'"))})
    runs.run(store, "challenges", ingest.challenges_load(cells([listed[0]])), NOW + HOUR)
    assert links() == want[1:]  # confirmed and without a product now; all others stay
