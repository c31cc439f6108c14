import random
import re

from tideline.llm import decontaminate as d

ITEM = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours while the other train stands still on the left track"
OTHER = "In the garden of the small house there are several kinds of trees whose leaves turn yellow every autumn before they fall"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_contaminated(spark):
    fill = words(1, 60)
    docs = [
        (1, f"{fill} {ITEM} {fill}"),  # as it is
        (2, f"{fill} {ITEM.replace('40', '75').replace('Alice', 'Bob').replace('3 hours', '9 hours')} {fill}"),  # other values
        (3, f"{fill} {ITEM.upper().replace(',', ';')}"),  # capitals alone are words, so all but the name is found
        (4, fill),
        (5, f"{fill} {' '.join(ITEM.split()[:9])}"),  # less than half
        (6, None),
        (7, ""),
        (None, OTHER.replace(" ", "\n", 3)),
        (1, f"{fill} {ITEM} {fill}"),  # a repeated row
        (8, f"{OTHER}! {ITEM}? " * 40),
    ]
    items = [(10, ITEM), (11, OTHER), (12, "too short here"), (13, None), (11, OTHER), (14, "six words are enough for this")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(df, it).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in got) == [(0, 11), (1, 10), (2, 10), (3, 10), (8, 10), (8, 11)]
    other = {r["doc_id"]: r["reparameterised"] for r in got if r["item_id"] == 10}
    assert other == {1: False, 2: True, 3: False, 8: False}
    left = d.clean(df, it).collect()
    assert sorted(r["doc_id"] for r in left) == [4, 5, 6, 7]


def test_inconsistent_slots_are_no_copy(spark):
    item = "Carol adds 5 apples then Carol takes 5 apples then Carol sells 5 apples then Carol eats 5 apples then Carol has 5 apples left"
    item = "today " + item
    mixed, n = item, 0
    for _ in range(5):
        n += 1
        mixed = mixed.replace("Carol", f"N{'abcdefgh'[n]}me", 1).replace(" 5 ", f" 1{n} ", 1)
    swapped = item.replace("Carol", "Dave").replace(" 5 ", " 8 ")
    docs = spark.createDataFrame([(1, item), (2, mixed), (3, swapped)], "doc_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in d.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 3: True}


def test_names_that_begin_sentences(spark):
    item = "Alice has 12 marbles in a bag. Alice gives 4 marbles to Bob. Alice then buys 9 more marbles. Bob loses 3 of his marbles. Alice counts what both of them have left."
    other = item.replace("Alice", "Mara").replace("Bob", "Tom").replace("12", "31").replace("4", "7").replace("9", "15").replace("3 ", "8 ")
    docs = [
        (1, item),
        (2, other),
        (3, other.replace(". ", " ")),  # without marks
        (4, other.replace(" marbles", "\nmarbles").replace("to Tom", "to\nTom")),  # lines broken elsewhere
        (5, f"{words(2, 30)}. {other} {words(3, 30)}"),
        (6, words(4, 60)),
    ]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["reparameterised"], r["coverage"]) for r in d.contaminated(df, it).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1), 5: (True, 1)}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "well, six words are enough for this one"), (2, "six words are not enough")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Six words are enough for this")], "item_id long, text string")
    assert [r["doc_id"] for r in d.contaminated(docs, items).collect()] == [1]


def test_items_of_few_plain_words(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2?"), (2, "Alice 12 Bob 15 Carol 18 Dave 21 Erin 24 Frank 27"), (3, "Who wrote Waverley?"), (4, "+ - *")]
    docs = [
        (1, f"{words(5, 20)}\n{items[0][1]} {words(6, 20)}"),
        (2, f"{words(5, 20)}\nwhat is\n12 + 7 * 3 - 4 / 2 {words(6, 20)}"),
        (3, f"{words(5, 20)} What is 13 + 7 * 3 - 4 / 2? + - * {words(6, 20)}"),  # other values
        (4, f"{words(7, 20)} {items[1][1].replace(' Carol', chr(10) + 'Carol')}. Who wrote Waverley? Who wrote Waverley?"),
        (5, f"{words(8, 20)} Who wrote Emma? Alice 12 Bob 15"),
    ]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"], r["reparameterised"]) for r in d.contaminated(df, it).collect())
    assert got == [(1, 1, 1.0, False), (2, 1, 1.0, False), (4, 2, 1.0, False), (4, 3, 1.0, False)]
    assert [r["doc_id"] for r in d.clean(df, it).orderBy("doc_id").collect()] == [3, 5]


def test_windows_of_few_plain_words_take_no_item_away(spark):
    item = f"{words(9, 12)} 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"
    other = " ".join(str(int(w) + 50) if w.isdigit() else w for w in item.split())
    docs, items = (spark.createDataFrame([(1, t)], f"{c} long, text string") for c, t in (("doc_id", other), ("item_id", item)))
    assert [(r["coverage"], r["reparameterised"]) for r in d.contaminated(docs, items).collect()] == [(1.0, True)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0
    assert d.clean(docs, items.limit(0)).count() == 1


def test_whole_items_in_the_given_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    flat = lambda t: " ".join(t.split())
    want = {(a["doc_id"], b["item_id"]) for a in docs.collect() for b in items.collect() if flat(b["text"]) in flat(a["text"])}
    assert got == want and want


# A plain version of the method, word by word.

PLAIN_UNITS = set(d.UNITS)
WIDE = re.compile(r"[฀-໿က-Ⴟក-៿぀-鿿豈-﫿\U00020000-\U0002ffff]")


def plain_words(text):
    """(kind, value) of each word: number, name, unit, word, or either of the last and a name."""
    text = re.sub("[　-〿＀-／：-＠]", "   ", text)
    text = WIDE.sub(lambda m: f"\0{m.group()}\0", text)
    out, opens, number = [], True, False
    for line, part in enumerate(text.split("\n")):
        opens = opens or line > 0
        for raw in re.findall(r"[^\x20\x09-\x0D]+", part):
            for piece in [p for p in raw.split("\0") if p]:
                core = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", piece)
                if core:
                    low = "".join(c.lower() if c < "ÿ" and c != "×" else c for c in core)
                    capital = bool(re.match("[A-ZÀ-ÖØ-Þ]", core)) and bool(re.search("[a-zß-ÿ]", core))
                    if core[0].isascii() and core[0].isdigit():
                        kind = "number"
                    elif number and low in PLAIN_UNITS:
                        kind = "unit"
                    else:
                        kind = ("either" if opens else "name") if capital else "word"
                    number = kind == "number"
                    out.append((kind, low))
                opens = piece[-1] in ".!?:" if core else opens if not piece.strip() else piece[-1] in ".!?:"
    return out


def readings(ws):
    """Every reading of a window: which words are slots."""
    out = [[]]
    for kind, _ in ws:
        out = [r + [s] for r in out for s in ([True, False] if kind == "either" else [kind != "word"])]
    return out


def plain_template(ws, slots):
    return tuple(("name" if k == "either" else k) if s else v for (k, v), s in zip(ws, slots, strict=True))


def plain_pairs(docs, items, coverage=0.5, agreement=0.8):
    out = set()
    for item_id, item in items:
        iw = plain_words(item)
        if not iw:
            continue
        size = min(8, len(iw))
        ats = range(len(iw) - size + 1)
        poor = [a for a in ats if size < 5 or sum(k == "word" for k, _ in iw[a : a + size]) < 4]
        templates = {a: [r for r in readings(iw[a : a + size]) if size >= 5 and size - sum(r) >= 4] for a in ats}
        typed = [a for a in ats if templates[a]]
        for doc_id, doc in docs:
            dw = plain_words(doc or "")
            met, found, own = {}, set(), set()
            for at in range(len(dw) - size + 1):
                part = dw[at : at + size]
                theirs = {plain_template(part, r): r for r in readings(part) if size - sum(r) >= 4} if size >= 5 else {}
                for a in ats:
                    hits = [r for r in templates[a] if plain_template(iw[a : a + size], r) in theirs]
                    if hits:
                        found.add(a)
                        own.add(a)
                        best = min(hits, key=sum)
                        for k in range(size):
                            if best[k]:
                                met.setdefault(at - a, {})[a + k] = (iw[a + k][1], part[k][1])
                    elif a in poor and [v for _, v in part] == [v for _, v in iw[a : a + size]]:
                        found.add(a)
            if max(len(found) / len(ats), len(own) / len(typed) if typed else 0) < coverage:
                continue
            agree = uses = 0
            for slots in met.values():
                by = {}
                for mine, theirs in slots.values():
                    by.setdefault(mine, []).append(theirs)
                agree += sum(max(v.count(x) for x in v) for v in by.values())
                uses += sum(map(len, by.values()))
            if not uses or agree / uses >= agreement:
                out.add((doc_id, item_id))
    return out


def test_random_texts_against_a_plain_version(spark):
    rng = random.Random(11)
    names, plain = "Alice Bob Carol Élodie Ann".split(), "the train has left old station while it waits for a small green bag and then".split()

    def sentence(n):
        ws = []
        for _ in range(n):
            x = rng.random()
            ws.append(str(rng.randrange(40)) if x < 0.12 else rng.choice(names) if x < 0.24 else rng.choice(["km", "kg", "hours"]) if x < 0.3 else rng.choice(plain))
        return " ".join(ws)[:1].upper() + " ".join(ws)[1:] + rng.choice([".", "?", "", ":", "!"])

    def change(text):
        to = {w: (str(rng.randrange(40, 90)) if w.isdigit() else rng.choice(["Dan", "Eve", "Zoë"])) for w in set(re.findall(r"\d+|Alice|Bob|Carol|Élodie|Ann", text))}
        return re.sub(r"\d+|Alice|Bob|Carol|Élodie|Ann", lambda m: to[m.group()] if rng.random() < 0.9 else rng.choice(list(to.values())), text)

    items = [(i, " ".join(sentence(rng.randrange(2, 12)) for _ in range(rng.randrange(1, 4)))) for i in range(25)]
    items += [(25, "小明有12个苹果，他吃了3个，还剩几个？"), (26, "12 + 7 * 3 - 4 / 2"), (27, "ab"), (28, "?"), (29, items[0][1] + " " + items[1][1])]
    docs = []
    for k in range(120):
        text = items[rng.randrange(len(items))][1]
        text = change(text) if k % 3 == 1 else text if k % 3 == 0 else " ".join(text.split()[: rng.randrange(3, 20)])
        docs.append((k, f"{sentence(rng.randrange(1, 30))} {text} {sentence(rng.randrange(1, 30))}".replace(" ", rng.choice([" ", " ", "\n"]), rng.randrange(4))))
    docs += [(500, "今天小明有12个苹果，他吃了3个，还剩几个？好"), (501, "小明有15个苹果，他吃了7个，还剩几个？"), (502, "小明有苹果"), (503, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(df, it).collect()}
    want = plain_pairs(docs, items)
    assert got == want and {(500, 25), (501, 25)} <= got and len(got) > 60


def test_one_template_of_many_items_and_documents(spark):
    frame = "a train leaves the old station at {} km per hour and stops after {} hours near the green hill"
    items = spark.createDataFrame([(i, frame.format(i, i + 1)) for i in range(60)] + [(100, OTHER)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{words(i, 10)} {frame.format(1000 + i, 7)}") for i in range(40)] + [(90, OTHER)], "doc_id long, text string")
    got = d.contaminated(docs, items).toPandas()
    assert len(got) == 40 * 60 + 1 and d.clean(docs, items).count() == 0


def test_a_long_document(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", f"concat(repeat('some words of a long text ', 600000), CASE WHEN id = 1 THEN '{OTHER}' ELSE '' END) AS text")  # 16 MB each
    items = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    assert [r["doc_id"] for r in d.contaminated(docs, items).collect()] == [1]
