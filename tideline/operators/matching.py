"""Resolving entities across sources without guessing among ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.parties import company, court, is_patent_case, manual_confidence, sides
from tideline.functions.text import compact_upper


def hash_lookup(rows: DataFrame, table: DataFrame, key: list[str], value: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the value found by key, and issues for keys that are not known."""
    joined = rows.join(table.select(*key, value), key, "left")
    return joined.filter(F.col(value).isNotNull()), joined.filter(F.col(value).isNull()).withColumn("reason", F.lit(reason)).drop(value)


def fan_out(rows: DataFrame, products: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """Rows that know part of a key, once for every product with it; and the rows with none."""
    return rows.join(products, part), rows.join(products.select(part).distinct(), part, "left_anti")


def references(products: DataFrame) -> DataFrame:
    """(product_id, reference_id): by the stated name, else by the stated other name, case aside.

    Of several products of one name the least id is meant. A product whose stated name is its own has no
    reference; the other name is asked only where no product has the first.
    """
    by = lambda column, out: products.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias(f"_{out}")).agg(F.min("product_id").alias(out))
    asked = products.select("product_id", F.lower("reference_name").alias("_first"), F.lower("reference_alt_name").alias("_second"))
    found = asked.join(by("name", "first"), "_first", "left").join(by("alt_name", "second"), "_second", "left")
    pick = F.coalesce("first", "second")
    return found.select("product_id", F.when(pick != F.col("product_id"), pick).alias("reference_id"))


def unresolved_references(products: DataFrame, found: DataFrame, raw: Column, file: str) -> DataFrame:
    """Issues (file, line, reason, raw) for products that state a reference which was not found; ``found``: what :func:`references` gave."""
    stated = F.coalesce("reference_name", "reference_alt_name")
    rows = products.filter(stated.isNotNull()).join(found.filter("reference_id IS NULL").select("product_id"), "product_id", "left_semi")
    reason = F.concat(F.lit('no known product for the reference "'), stated, F.lit('", which is kept as a name'))
    return rows.select(F.lit(file).alias("file"), F.lit(-1).cast("long").alias("line"), reason.alias("reason"), raw.cast("string").alias("raw"))


def narrowed(pairs: DataFrame, key: str | list[str], forms: str, holds: Column) -> DataFrame:
    """Pairs of each key: all if only one form occurs or none of them ``holds``, else those that do."""
    by = Window.partitionBy(key)
    judged = pairs.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    several = F.min(forms).over(by) != F.max(forms).over(by)
    return judged.withColumn("_keep", ~F.coalesce(several, F.lit(False)) | ~F.max("_holds").over(by) | F.col("_holds")).filter("_keep").drop("_keep", "_holds")


def words_overlap(a: Column, b: Column) -> Column:
    """Do two texts share a word? Words are compared without a final s, so that plurals meet."""
    split = lambda c: F.transform(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "s$", ""))
    return F.arrays_overlap(split(a), split(b))


def challenge_links(challenges: DataFrame, products: DataFrame) -> DataFrame:
    """(challenge_id, product_id): by application number, narrowed by dosage form where several forms occur.

    What is kept depends on the forms of both sides alone, so it is judged once for each two forms of an application; then challenges
    meet just the products that they keep, and no pair is made to be judged, sorted or dropped.
    """
    asked = challenges.select("challenge_id", "application_number", F.col("dosage_form").alias("_form"))
    owned = products.select("product_id", "application_number", "dosage_form")
    forms = asked.select("application_number", "_form").distinct().join(owned.select("application_number", "dosage_form").distinct(), "application_number")
    kept = narrowed(forms, ["application_number", "_form"], "dosage_form", words_overlap(F.col("_form"), F.col("dosage_form")))
    kept = kept.select(F.col("application_number").alias("_application"), F.col("_form").alias("_asked"), F.col("dosage_form").alias("_kept"))
    wanted = asked.join(kept, (F.col("application_number") == F.col("_application")) & F.col("_form").eqNullSafe(F.col("_asked"))).select("challenge_id", "_application", "_kept")
    # the few rows of either side are small enough for one task, what comes of them is not
    wanted = wanted.repartition("challenge_id")
    return wanted.join(owned, (F.col("_application") == F.col("application_number")) & F.col("_kept").eqNullSafe(F.col("dosage_form"))).select("challenge_id", "product_id")


def challenge_notes(challenges: DataFrame, products: DataFrame) -> DataFrame:
    """(challenge_id, linked, note): what there is to say of each challenge's links; ``linked`` is matched, no_number or not_found.

    A challenge that no dosage form narrows is linked to all products of its application, and that is said.
    """
    forms = products.groupBy("application_number").agg(F.array_sort(F.collect_set("dosage_form")).alias("_forms"), F.count(F.lit(1)).alias("_n"))
    rows = challenges.select("challenge_id", "application_number", F.col("dosage_form").alias("_form")).join(forms, "application_number", "left")
    number, fits = F.col("application_number"), F.exists("_forms", lambda f: F.coalesce(words_overlap(F.col("_form"), f), F.lit(False)))
    linked = F.when(number.isNull(), "no_number").when(F.col("_n").isNull(), "not_found").otherwise("matched")
    wide = F.concat(F.lit('the dosage form "'), F.coalesce("_form", F.lit("")), F.lit('" is none of '), F.array_join("_forms", ", "), F.lit("; linked to all "), F.col("_n").cast("string"), F.lit(" products of "), number)
    note = (
        F.when(linked == "no_number", "no application number")
        .when(linked == "not_found", F.concat(F.lit("no product has the application number "), number))
        .when((F.size("_forms") > 1) & ~fits, wide)
    )
    return rows.select("challenge_id", linked.alias("linked"), note.alias("note"))


def _met(inner: DataFrame, outer: DataFrame, often: DataFrame) -> DataFrame:
    """Inner names with the outer ones that have their rarest word: name, company_id, _words, _theirs.

    A name all of whose words another has is found so, and no other word of it need meet anything.
    """
    words, theirs = inner.withColumn("_word", F.explode("_words")), outer.withColumn("_word", F.explode("_words"))
    keys = [c for c in ("name", "company_id") if c in inner.columns]
    rarest = words.join(often, "_word").groupBy(*keys).agg(F.min_by(F.struct("_word", "_words"), F.struct("_often", "_word")).alias("_r")).select(*keys, "_r.*")
    return rarest.join(theirs.select(*[c for c in ("name", "company_id") if c in outer.columns], "_word", F.col("_words").alias("_theirs")), "_word").select("name", "company_id", "_words", "_theirs")


def word_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, company_id): all words of the one side are on the other. asked: name, _words; known: company_id, _words.

    Words that many names share meet only where a name has no rarer one, so the rows that meet grow with the names and not
    with the square of those that share a word.
    """
    every = asked.select(F.explode("_words").alias("_word")).unionAll(known.select(F.explode("_words").alias("_word")))
    often = every.groupBy("_word").agg(F.count(F.lit(1)).alias("_often"))
    met = _met(asked, known, often).unionByName(_met(known, asked, often))
    return met.filter(F.size(F.array_intersect("_words", "_theirs")) == F.size("_words")).select("name", "company_id").distinct()


def companies(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(name, company_id, match): exact, fuzzy or none.

    Names are compared without their legal form. One company of that name is an exact match
    and several are none. Otherwise a fuzzy match is one company all of whose words are in the name,
    or that has all of the name's words; several such are none (:func:`word_pairs`).
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("_norm", company(F.col("name")))
    table = known.select(F.col("id").alias("company_id"), company(F.col("name")).alias("_norm"))
    exact = table.groupBy("_norm").agg(F.count(F.lit(1)).alias("_n"), F.min("company_id").alias("_exact"))
    words = lambda df: df.withColumn("_words", F.array_distinct(F.filter(F.split("_norm", " "), lambda w: w != "")))
    open_ = words(asked.filter("_norm != ''").join(exact, "_norm", "left_anti"))
    pairs = word_pairs(open_.select("name", "_words"), words(table.filter("_norm != ''")).select("company_id", "_words"))
    fuzzy = pairs.groupBy("name").agg(F.min("company_id").alias("_fuzzy"), F.max("company_id").alias("_other"))
    out = asked.join(exact, "_norm", "left").join(fuzzy.filter("_fuzzy = _other"), "name", "left")
    return out.select(
        F.col("name").alias(name),
        F.when(F.col("_n") == 1, F.col("_exact")).when(F.col("_n").isNull(), F.col("_fuzzy")).alias("company_id"),
        F.when(F.col("_n") == 1, "exact").when(F.col("_n").isNull() & F.col("_fuzzy").isNotNull(), "fuzzy").otherwise("none").alias("match"),
    )


#: What two parties are told apart by: ids, and names where there is no id.
PARTIES = ["plaintiff_id", "defendant_id", "plaintiff_name", "defendant_name"]


def grouped_cases(hits: DataFrame, days: int = 180) -> DataFrame:
    """Hits with a case number: of the same two parties, each filed within ``days`` of the one before.

    Parties that are not known (null ids) are told apart by their names (plaintiff, defendant) as
    they are. Hits without a filing date go to the parties' first case. Chains are single-linkage
    by date, which is what adding hits one by one in the order of their dates gives.
    """
    hits = hits.withColumns({f"{p}_name": F.when(F.col(f"{p}_id").isNull(), F.col(p)) for p in ("plaintiff", "defendant")})
    pair = Window.partitionBy(*PARTIES).orderBy(F.asc_nulls_first("filed"), "docket_id")
    gap = F.datediff("filed", F.lag("filed").over(pair))
    starts = F.when(F.coalesce(gap > days, F.lit(False)), 1).otherwise(0)
    return hits.withColumn("_starts", starts).withColumn("case_no", F.sum("_starts").over(pair.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def grown_cases(cases: DataFrame, hits: DataFrame, days: int = 180) -> tuple[DataFrame, DataFrame]:
    """(hits with case_no, cases): new hits put into stored cases or new ones, whose numbers never change.

    ``cases``: PARTIES, case_no, first, last: the first and last filing of each case (null: none has a date). Of the parties of
    the new hits alone, stored spans and hits' dates are laid side by side in time; what lies within ``days`` of
    each other is one island. Its new hits join its stored case, or are a new case, numbered after the parties' last one. An
    island with several stored cases, which a hit has bridged, leaves them apart, and its hits go to the one of the least
    number. Hits without a date go to the parties' first case. Batches one after another give
    what :func:`grouped_cases` gives for all at once, but for numbers, wherever no hit bridges two stored cases.
    """
    hits = hits.withColumns({f"{p}_name": F.when(F.col(f"{p}_id").isNull(), F.col(p)) for p in ("plaintiff", "defendant")})
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in PARTIES])
    touched = hits.select(*PARTIES).distinct()
    old = cases.join(touched, same(cases, touched), "left_semi")
    spans = old.select(*PARTIES, "case_no", F.col("first").alias("_a"), F.col("last").alias("_z"), F.lit(None).cast(hits.schema["docket_id"].dataType).alias("docket_id"))
    dated = hits.filter(F.col("filed").isNotNull()).select(*PARTIES, F.lit(None).cast("long").alias("case_no"), F.col("filed").alias("_a"), F.col("filed").alias("_z"), "docket_id")
    order = Window.partitionBy(*PARTIES).orderBy("_a", "_z", "case_no", "docket_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.datediff("_a", F.max("_z").over(before)) > days, F.lit(True))
    islands = spans.filter(F.col("_a").isNotNull()).unionByName(dated).withColumn("_island", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_island = Window.partitionBy(*PARTIES, "_island")
    stored = F.min("case_no").over(of_island)
    last = old.groupBy(*PARTIES).agg(F.max("case_no").alias("_last"), F.min("case_no").alias("_least"))
    rows = islands.withColumn("_stored", stored).filter("docket_id IS NOT NULL")
    rows = rows.join(last, same(rows, last), "left").select(*[rows[c] for c in (*PARTIES, "docket_id", "_a", "_island", "_stored")], "_last")
    # new islands are numbered in order of time after the parties' last case
    fresh = F.dense_rank().over(Window.partitionBy(*PARTIES, F.col("_stored").isNull()).orderBy("_island"))
    numbered = rows.withColumn("_no", F.coalesce("_stored", F.coalesce("_last", F.lit(-1).cast("long")) + fresh))
    undated = hits.filter(F.col("filed").isNull())
    first = numbered.groupBy(*PARTIES).agg(F.min("_no").alias("_new"))
    known = touched.join(last, same(touched, last), "left").select(*[touched[c] for c in PARTIES], "_least")
    known = known.join(first, same(known, first), "left").select(*[known[c] for c in PARTIES], F.coalesce("_least", "_new", F.lit(0).cast("long")).alias("_no"))
    undated = undated.join(known, same(undated, known)).select(*[undated[c] for c in (*PARTIES, "docket_id")], F.lit(None).cast("date").alias("_a"), "_no")
    placed = numbered.select(*PARTIES, "docket_id", "_a", "_no").unionByName(undated)
    out = hits.join(placed.select("docket_id", F.col("_no").alias("case_no")), "docket_id")
    grown = old.select(*PARTIES, "case_no", "first", "last").unionByName(placed.select(*PARTIES, F.col("_no").alias("case_no"), F.col("_a").alias("first"), F.col("_a").alias("last")))
    grown = grown.groupBy(*PARTIES, "case_no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    rest = cases.join(touched, same(cases, touched), "left_anti").select(*grown.columns)
    return out, rest.unionByName(grown)


def case_summary(grouped: DataFrame) -> DataFrame:
    """Per case: first filing, outcome (open while any docket is), dockets."""
    return grouped.groupBy(*PARTIES, "case_no").agg(
        F.min("filed").alias("filed"),
        F.when(F.bool_or(F.col("terminated").isNull()), "ONGOING").otherwise("UNCLEAR").alias("outcome"),
        F.count(F.lit(1)).alias("n_dockets"),
    )


def raised_tier(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Tiers are only ever raised: the surer of the old and the new."""
    rank = F.create_map(*[x for k, t in enumerate(["LOW", "MEDIUM", "HIGH"]) for x in (F.lit(t), F.lit(k))])
    return old.select(*key, "tier").unionByName(new.select(*key, "tier")).groupBy(*key).agg(F.max_by("tier", rank[F.col("tier")]).alias("tier"))


def named_products(complaints: DataFrame, patents: DataFrame, products: DataFrame) -> DataFrame:
    """(case_id, product_id, how): the products that a complaint names, whoever sues.

    By patent numbers if all that are known belong to one product; else by brand, case aside: the products
    of the same strength, white space and case aside, if there are any, else all of that brand; else nothing.
    complaints: case_id, patent_numbers, brand_name, strength; patents: patent_number, product_id;
    products: product_id, name, strength.
    """
    numbers = complaints.select("case_id", F.explode("patent_numbers").alias("patent_number"))
    owned = patents.select("patent_number", "product_id").distinct()
    hits = numbers.join(owned, "patent_number").groupBy("case_id").agg(F.min("product_id").alias("a"), F.max("product_id").alias("b"))
    by_patent = hits.filter("a = b").select("case_id", F.col("a").alias("_by_patent"))
    brands = complaints.filter(F.col("brand_name").isNotNull()).select("case_id", F.lower("brand_name").alias("_brand"), compact_upper(F.col("strength")).alias("_strength"))
    asked = brands.join(by_patent, "case_id", "left_anti")
    named = products.select(F.col("product_id").alias("_by_brand"), F.lower("name").alias("_brand"), compact_upper(F.col("strength")).alias("_strength"))
    # what no strength narrows alone meets all products of its brand, so no pair is made that is not kept
    fitting = asked.join(named, ["_brand", "_strength"]).select("case_id", "_by_brand")
    wide = asked.join(fitting.select("case_id"), "case_id", "left_anti").join(named.drop("_strength"), "_brand").select("case_id", "_by_brand")
    by_brand = fitting.unionByName(wide)
    joined = complaints.select("case_id").join(by_patent, "case_id", "left").join(by_brand, "case_id", "left")
    how = F.when(F.col("_by_patent").isNotNull(), "patent").when(F.col("_by_brand").isNotNull(), "brand").otherwise("none")
    return joined.select("case_id", F.coalesce("_by_patent", "_by_brand").alias("product_id"), how.alias("how")).distinct()


def labelled(records: DataFrame, targets: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Records with the label of whichever target they have. targets: (column, table, its key, its label)."""
    labels = []
    for k, (column, table, key, label) in enumerate(targets):
        records = records.join(table.select(F.col(key).alias(column), F.col(label).alias(f"_label{k}")), column, "left")
        labels.append(f"_label{k}")
    return records.withColumn("label", F.coalesce(*labels)).drop(*labels)


def party_products(dockets: DataFrame, companies_: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """(docket_id, product_id, challenged): all products of both parties' companies, each once; is a challenge linked to it?

    Those that are not challenged are no candidates, as nothing says that they are in dispute. No party was searched for
    here, so neither side comes first. dockets: docket_id, plaintiff, defendant (names); companies_: what
    :func:`companies` found for names; products: product_id, company_id; links: product_id of challenges.
    """
    known = companies_.filter(F.col("company_id").isNotNull()).select(F.col("name").alias("_name"), "company_id")
    sides = dockets.select("docket_id", F.explode(F.array_distinct(F.array("plaintiff", "defendant"))).alias("_name"))
    linked = links.select("product_id", F.lit(True).alias("_linked")).distinct()
    owned = products.select("product_id", "company_id").join(linked, "product_id", "left").withColumn("challenged", F.coalesce("_linked", F.lit(False)))
    return sides.join(known, "_name").select("docket_id", "company_id").distinct().join(owned, "company_id").select("docket_id", "product_id", "challenged").distinct()


def docket_preview(hits: DataFrame, known: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """What a person is shown before entering a docket: court, parties, their matches, candidate products, the tier and why.

    hits: docket_id, caption, court_id, nature, cause. Hits of other courts or without two parties have an issue instead.
    """
    rows = hits.withColumn("court", court(F.col("court_id"))).withColumn("_s", sides(F.col("caption")))
    issue = F.when(F.col("court").isNull(), F.concat(F.lit('court out of scope: "'), F.col("court_id"), F.lit('"'))).when(F.col("_s").isNull(), F.concat(F.lit('no two parties in "'), F.col("caption"), F.lit('"')))
    rows = rows.withColumn("issue", issue).withColumns({p: F.when(issue.isNull(), F.col(f"_s.{p}")) for p in ("plaintiff", "defendant")}).drop("_s")
    names = rows.select(F.explode(F.array("plaintiff", "defendant")).alias("name")).filter("name IS NOT NULL")
    found = companies(names, known)
    candidates = party_products(rows, found, products, links).filter("challenged").groupBy("docket_id").agg(F.array_sort(F.collect_list("product_id")).alias("candidates"))
    for p in ("plaintiff", "defendant"):
        rows = rows.join(found.select(F.col("name").alias(p), F.col("match").alias(f"{p}_match")), p, "left")
    rows = rows.join(candidates, "docket_id", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    told = manual_confidence(F.col("plaintiff_match"), F.col("defendant_match"), n, F.coalesce(is_patent_case(F.col("nature"), F.col("cause")), F.lit(False)))
    return rows.withColumns({"tier": F.when(F.col("issue").isNull(), told["tier"]), "note": F.when(F.col("issue").isNull(), told["note"])})
