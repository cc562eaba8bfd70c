import random

from kinmatch.llm import addresses, gazetteer, names, same_names
from kinmatch.llm.components import connected_components
from kinmatch.llm.linkage import link, nearest, term_weights


def same(a, b):
    x, y = names.parse(a), names.parse(b)
    return bool(x and y and names.same_name(x, y))


def test_spellings_of_one_name():
    for a, b in [
        ("Bhagyashree Gulupe Garments", "Bh. Gulupe Gmts"),
        ("Richard Safaner Motors Private Limited", "M/s DICK SAFANER MTRS."),
        ("Keripox Tobave Construction Bros.", "The Keripoxtobave Constr and Sons"),
        ("Nonozu Rogawom Construction", "नोनोजु रोगवोम कोन्स्त्रुक्तिओन"),
        ("Gayave Saliras Chemicals Limited", "Γαυαβε Σαλιρασ Κχεμικαλσ"),
        ("Yawelu Riharo Hospital", "Йавелу Рихаро Хоспитал"),
        ("Frédéric Mayotu Manufacturing", "Mayotu, Frederic Mfg"),
        ("Suwoju Rowebath Ramonage SAS", "Suwοju Rowebath Ｒａｍｏｎａｇｅ S.A.S."),
        ("Yofimol Rolunem Restaurant", "Yofimol Roluneem Restaursnt Ltd"),
    ]:
        assert same(a, b) and same(b, a), (a, b)


def test_different_names():
    for a, b in [("Yofimol Rolunem Bakery", "Yofimol Rolunem Motors"), ("Yofimol Rolunem Bakery", "Yofimol Tadowel Bakery"), ("n/a", "n/a"), ("", ""), (None, "X Y Bakery"), ("Private Limited", "Private Limited")]:
        assert not same(a, b), (a, b)


def test_same_name_pairs(spark):
    rows = [("b", "Yofimol Rolunem Bakery"), ("a", "Yofimol Roluneem Bkry Ltd"), ("c", "Bakery Rolunem Yofimol"), ("d", None), ("e", "n/a"), ("f", "-"), ("g", "Yofimol Rolunem Motors"), ("b", "Yofimol Rolunem Bakery")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string").selectExpr("*", "1 AS form", "2 AS trade")
    assert {tuple(r) for r in same_names.same_name_pairs(df, "entity_id", "business_name").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert same_names.same_name_pairs(df.limit(0), "entity_id", "business_name").count() == 0


def test_shortened_name_that_fits_two_names_joins_neither(spark):
    rows = [("a", "Pad. Dituwox Bakery"), ("b", "Padmavati Dituwox Bakery"), ("c", "Padiluk Dituwox Bakery"), ("d", "Padmavati Dituwox Bkry")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string")
    assert {tuple(r) for r in same_names.same_name_pairs(df, "entity_id", "business_name").collect()} == {("b", "d")}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    for n, m in ((30, 25), (60, 50), (2, 1)):
        links = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)] + [(None, "n00"), ("n01", "n01")]
        links += [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)]  # a long path
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            if a and b and a != b:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
        assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_address_parts():
    p = addresses.parse("Unit 36A, No 480, Norafi Mg,Opposite Yajuhi Post Office,Phase 20,Viraripur,110 172", "india")
    assert (p.number, p.street, p.kind, p.post) == ("480", "norafi", "marg", "110172") and "viraripur" in p.places
    p = addresses.parse("Shop No 13 No 396 Ramoga X Rd Lupoka Industrial Area Kafabogarh BD 341148", "india")
    assert (p.number, p.street, p.kind, p.post) == ("396", "ramoga", "cross road", "341148")
    p = addresses.parse("296 impasse du Jegaka, Bâtiment 34, 93943 Bovisagny, Bas-Férin", "france")
    assert (p.number, p.street, p.kind, p.post) == ("296", "jegaka", "impasse", "93943")
    p = addresses.parse("MOYORO QY 48 - YOLESAMAR - UPPER COAST - 1384", "portugal")
    assert (p.number, p.street, p.kind, p.post) == ("48", "moyoro", "quay", "1384")
    p = addresses.parse("568 EAST SUYOLU CT , STE 33 , VIGASUVILLE , 36979-1111", "us")
    assert (p.number, p.street, p.kind, p.post) == ("568", "suyolu", "court", "36979")
    for v in (None, "", "-", "<NULL>", "n/a"):
        assert addresses.parse(v, "us") == addresses.Address()
    assert not addresses.parse("P.O. Box, Boneketon", "us").street
    assert addresses.parse("x" * 200_000, "us").street == ""


def town(name, pin, streets, country="India"):
    return [(f"{name}-{s}-{k}", f"{n} {s} Road, {name}, {pin}{i:03}", country) for i, s in enumerate(streets) for k, n in enumerate((4, 4, 8))]


def test_same_location_pairs(spark):
    rows = town("Alnagar", "111", ["Rovepe", "Taguvi", "Nehira"]) + town("Belpur", "222", ["Rovepe", "Sakeba"])
    rows += [
        ("z1", "Unit 3, House No.4, Roevpe Rd, Alnagar, 111000", "INDIA"),
        ("z2", "4 Rovepe Road, Alnagr", None),
        ("z3", "null", "India"),
        ("z4", None, None),
        ("z5", "Rovepe Road, Alnagar", "India"),
        ("z1", "Unit 3, House No.4, Roevpe Rd, Alnagar, 111000", "INDIA"),
    ]
    df = spark.createDataFrame(rows, "entity_id string, business_address string, country string").selectExpr("*", "1 AS loc", "2 AS street")
    got = {tuple(r) for r in gazetteer.same_location_pairs(df, "entity_id", "business_address", "country").collect()}
    assert ("Alnagar-Rovepe-0", "Alnagar-Rovepe-1") in got and ("Alnagar-Rovepe-0", "z1") in got
    assert not any({"Alnagar-Rovepe-0", x} == {a, b} for a, b in got for x in ("Alnagar-Rovepe-2", "Belpur-Rovepe-0", "Alnagar-Taguvi-0"))
    assert not any(x in p for p in got for x in ("z3", "z4", "z5"))
    assert all(a < b for a, b in got)
    assert gazetteer.same_location_pairs(df.limit(0), "entity_id", "business_address", "country").count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    import math

    from kinmatch.llm import linkage

    rng = random.Random(7)
    docs = [(f"d{i:03}", [rng.choice([rng.randrange(6), 10 + rng.randrange(60)]) for _ in range(rng.randrange(1, 9))]) for i in range(120)]
    docs = [(i, sorted(set(t))) for i, t in docs]
    queries = [(f"q{i}", sorted(set(rng.sample(docs, 1)[0][1][:4] + [rng.randrange(6)]))) for i in range(40)]
    sch = "id string, terms array<bigint>"
    d, q = spark.createDataFrame(docs, sch), spark.createDataFrame(queries, sch)
    idf = {r["term"]: r["idf"] for r in term_weights(d).collect()}
    mean = sum(len(t) for _, t in docs) / len(docs)

    def norm(n):
        return (linkage.K1 + 1) / (1 + linkage.K1 * (1 - linkage.B + linkage.B * n / mean))

    want = set()
    for qi, t in queries:
        own = sum(idf.get(x, 0) for x in t) * norm(len(t))
        all_ = sorted(((-round(sum(idf[x] for x in t if x in u) * norm(len(u)), 9), di) for di, u in docs))
        want |= {(qi, di, r + 1) for r, (s, di) in enumerate(all_[:3]) if -s >= linkage.LEAST * own - 1e-12 and s < 0}
    got = {(r["q"], r["d"], r["rank"]) for r in nearest(q, d, 3).collect()}
    assert got == want
    # Without a least share, and however many terms are looked up first, the result is that of brute force over everything.
    monkeypatch.setattr(linkage, "FIRST", 2)
    rows = {qi: sorted(((-round(sum(idf[x] for x in t if x in u) * norm(len(u)), 9), di) for di, u in docs if set(t) & set(u))) for qi, t in queries}
    want = {(qi, di, r + 1) for qi, all_ in rows.items() for r, (s, di) in enumerate(all_[:3])}
    assert {(r["q"], r["d"], r["rank"]) for r in nearest(q, d, 3, least=0.0).collect()} == want
    near = {(r["q"], r["d"]) for r in nearest(q, d, 3, least=0.0, within=0.2).collect()}
    own = {qi: sum(idf.get(x, 0) for x in t) * norm(len(t)) for qi, t in queries}
    assert near == {(qi, di) for qi, all_ in rows.items() for s, di in all_[:3] if -s >= -all_[0][0] - 0.2 * own[qi] - 1e-9}
    assert math.isfinite(mean)


def test_link_small(spark):
    cols = "id string, business_name string, business_address string, country string"
    s1 = [(f"S1-{i}", f"{a} {b} Bakery", f"{4 * (i + 1)} {s} Road, {t}, {p}", "India") for i, (a, b, s, t, p) in enumerate([("Yofimol", "Rolunem", "Rovepe", "Alnagar", "111001"), ("Tadowel", "Moliwer", "Taguvi", "Alnagar", "111002"), ("Gayave", "Saliras", "Nehira", "Belpur", "222001")])]
    pool = [("S2-1", "Yofimol Roluneem Bkry", "No 4, Rovepe Rd, Alnagar, 111001", "India"), ("S3-1", "Gayave Saliras Bakery", None, None), ("S2-2", "Other Business Motors", "No 4, Rovepe Rd, Alnagar, 111001", "India"), ("S2-3", None, None, None)]
    truth = spark.createDataFrame([("S1-0", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    got = link(spark.createDataFrame(s1, cols), spark.createDataFrame(pool, cols), truth).collect()
    pairs = {(r["id_a"], r["id_b"]): r for r in got}
    assert ("S1-0", "S2-1") in pairs and ("S1-2", "S3-1") in pairs
    assert all(0 <= r["confidence"] <= 1 for r in got)
    assert not any(r["id_b"] == "S2-3" for r in got)
    assert not pairs.get(("S1-0", "S2-2"), {"accepted": False})["accepted"]


def test_link_keeps_every_record_of_an_entity_and_every_tie(spark):
    cols = "id string, business_name string, business_address string, country string"
    home = "4 Rovepe Road, Alnagar, 111001"
    s1 = [("S1-0", "Yofimol Rolunem Bakery", home, "India"), ("S1-1", "Tadowel Moliwer Motors", "8 Taguvi Road, Belpur, 222001", "India"), ("S1-2", "Tadowel Moliwer Motors", "8 Taguvi Road, Belpur, 222001", "India")]
    s1 += [(f"S1-{i}", f"{a} Kerip Farm", f"{i} Nehira Road, Cadpur, 33300{i}", "India") for i, a in enumerate(["Gayave", "Saliras", "Nonozu"], 3)]
    pool = [(f"S2-{i:02}", "Yofimol Rolunem Bakery", home, "India") for i in range(20)]
    pool += [("S3-name", "Yofimol Rolunem Bakery", None, "India"), ("S3-tie", "Tadowel Moliwer Motors", "8 Taguvi Road, Belpur, 222001", "India")]
    truth = spark.createDataFrame([("S1-9", "")], "source1_entity_id string, matched_entity_ids string")
    got = {(r["id_a"], r["id_b"]) for r in link(spark.createDataFrame(s1, cols), spark.createDataFrame(pool, cols), truth).collect() if r["accepted"]}
    assert {b for a, b in got if a == "S1-0"} == {i for i, *_ in pool if i != "S3-tie"}
    assert {a for a, b in got if b == "S3-tie"} == {"S1-1", "S1-2"}


def test_jaro_winkler_accepts_and_the_prefilter_lets_it(spark):
    import itertools

    bases = ["Keripoxan Tobavesu Garments", "Yofimolu Rolunemi Garments"]
    assert not same("Keripox Tobave Garments", "Kedivox Tobave Garments")
    assert same(bases[1], "Yofimlo Rolunemi Garments") and same(bases[1], "Yofimolasu Rolunemi Garments")
    rng = random.Random(3)
    rows = [(f"{b}-0", name) for b, name in enumerate(bases)]
    for b, name in enumerate(bases):
        first, second, trade = name.split()
        for i in range(1, 60):  # two or three errors behind the first letters
            w = list(first)
            for _ in range(rng.choice((2, 3))):
                at = rng.randrange(3, len(w) - 1)
                w[at : at + 2] = rng.choice(([w[at + 1], w[at]], [w[at]], [rng.choice("aeiou"), w[at + 1]], [w[at], rng.choice("aeiou"), w[at + 1]]))
            rows.append((f"{b}-{i}", f"{''.join(w)} {second} {trade}"))
    parts = same_names.forms(spark.createDataFrame(rows, "id string, name string"), "id", "name")[1]
    form = {tuple(r["own"]): r["form"] for r in parts.collect()}
    parsed = {n.own: n for n in map(names.parse, (name for _, name in rows))}
    meet = [(a, b) for a, b in itertools.combinations(parsed.values(), 2) if set(names.block_keys(a)) & set(names.block_keys(b))]
    want = {tuple(sorted((form[a.own], form[b.own]))) for a, b in meet if names.same_name(a, b)}
    assert {(r["a"], r["b"]) for r in same_names.form_links(parts).collect()} == want


def test_locality_is_chosen_with_the_street(spark):
    rows = town("Alnagar", "111", ["Rovepe", "Taguvi", "Nehira", "Wimoku", "Zuhayo"]) + town("Belpur", "222", ["Lupoka", "Sakeba", "Fidago"])
    rows += [
        ("w1", "4 Rovepe Road, Alnagar, 222000", "India"),  # wrong code beside the right town
        ("w2", "4 Rovpe Road, Alnagar, 222000", "India"),
        ("w3", "8 Sakeba Road, Alnagar, 222001", "India"),  # wrong town beside the right code
        ("o1", "15 Gikelumo Road", "India"),
        ("o2", "15 Gikelumo Rd", "India"),
    ]
    df = spark.createDataFrame(rows, "entity_id string, business_address string, country string")
    got = {tuple(r) for r in gazetteer.same_location_pairs(df, "entity_id", "business_address", "country").collect()}
    assert {("Alnagar-Rovepe-0", "w1"), ("Alnagar-Rovepe-0", "w2"), ("w1", "w2"), ("Belpur-Sakeba-2", "w3"), ("o1", "o2")} <= got
    assert len(got) == 8 + 7  # each of eight streets has two at one number; w1 and w2 meet both there and each other


def test_names_of_many_words_meet_and_agree_in_any_order():
    a = "Keripox Tobave Yofimol Rolunem Garments"
    assert same(a, "Keripox Tobave Yofimol Rolunam Garments") and same(a, "Rolunem Yofimal Keripox Tobave Garments")
    assert not same(a, "Keripox Tobave Yofimol Saliras Garments")
    for x, y in [("Keripox Tobave Yofimol Garments", "Tobave Keripox Yofimol Garments"), (a, "Tobave Zeripox Rolunem Yofimol Garments")]:
        assert set(names.block_keys(names.parse(x))) & set(names.block_keys(names.parse(y)))
