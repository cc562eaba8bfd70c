import random

from kinmatch.llm import leaks


def edit_distance_to_stretch(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 90))]
        t = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        assert leaks.myers(p, t)[0] == edit_distance_to_stretch(p, t)


WORDS = [f"w{i}" for i in range(400)]


def items(n=12, size=60, seed=2):
    rng = random.Random(seed)
    lead = "this notice may be copied by anyone who keeps it"
    return [(i, f"{lead}. " + " ".join(rng.choice(WORDS) for _ in range(size))) for i in range(n)]


def test_found_and_not_found(spark):
    its = items()
    w = its[3][1].split()
    part = w[20:48]
    noisy = [x if i % 9 else "other" for i, x in enumerate(part)]
    docs = [
        (1, "x " * 30 + " ".join(w) + " y" * 30),
        (2, "<p>" + " ".join(part).upper() + "</p>"),
        (3, "+ # " + "\n+ # ".join(" ".join(noisy[i : i + 5]) for i in range(0, len(noisy), 5))),
        (4, " ".join(w[20:28])),  # too little
        (5, " ".join(w[:10])),  # the shared opening only
        (6, None),
        (7, ""),
        (8, " ".join(reversed(w))),  # not in the item's order
        (1, "x " * 30 + " ".join(w)),
        (9, "  1| " + " ".join(w[10:20]) + "\n  2| " + " ".join(w[20:30]) + "\n  3| " + " ".join(w[30:40])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS item_id")
    t = spark.createDataFrame([*its, (77, None), (78, ""), its[0]], "item_id long, text string")
    got = {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", t, "item_id", "text").collect()}
    assert got == {(1, 3), (2, 3), (3, 3), (9, 3)}


def test_no_items_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(d, "doc_id", "text", none, "item_id", "text").count() == 0
    assert leaks.find_leaks(d.limit(0), "doc_id", "text", spark.createDataFrame(items(2), "item_id long, text string"), "item_id", "text").count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    its = items()
    d = spark.createDataFrame([(i, t) for i, t in its], "doc_id long, text string")
    t = spark.createDataFrame(its, "item_id long, text string")
    opening = spark.createDataFrame([(100, " ".join(its[0][1].split()[:30])), (101, its[0][1].split(".")[0])], "doc_id long, text string")
    d = d.unionByName(opening)
    one = {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", t, "item_id", "text").collect()}
    assert one == {(i, i) for i, _ in its} | {(100, 0)}
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", t, "item_id", "text").collect()} == one


def ready(rows):
    return leaks.Items([(i, leaks.normal(t).split(), [], []) for i, t in rows])


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(9)
    for size in (3, 4, 6, 9, 12, 15, 30, 60, 150):
        words = [f"{rng.choice(WORDS)}" for _ in range(size)]
        search = leaks.Search(ready([(1, " ".join(words))]))
        need = -(-size // 3)
        for _ in range(60):
            lo = rng.randrange(size - need + 1)
            part = words[lo : lo + need]
            for _ in range(int(leaks.ERROR_RATE * need)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice(([], ["zz"], [part[at], "zz"]))
            text = [f"q{rng.randrange(50)}" for _ in range(30)]
            text[15:15] = part
            if leaks.myers(words[lo : lo + need], text)[0] <= int(leaks.ERROR_RATE * need):
                assert [i for i, _ in search(leaks.normal(" ".join(text)))] == [1], (size, part)


def test_notices_and_whole_copies(spark, monkeypatch):
    monkeypatch.setattr(leaks, "NOTICE_LEAST", 5)
    rng = random.Random(4)
    its = items(3, 60, 8)
    notice = " ".join(rng.choice(WORDS) for _ in range(30))
    its.append((50, notice + " " + " ".join(f"n{i}" for i in range(30))))
    its.append((51, its[0][1]))  # the same text under another id
    docs = [(k, f"d{k} " * 20 + notice) for k in range(20)] + [(99, its[-2][1]), (98, its[0][1])]
    got = {tuple(r) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(its, "item_id long, text string"), "item_id", "text").collect()}
    assert got == {(99, 50), (98, 0), (98, 51)}


def test_dense_windows_lose_nothing():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice(WORDS[:50]) for _ in range(40)]
        doc = [rng.choice(WORDS[:60]) for _ in range(60)]
        need = 12
        keep = set(leaks.dense_windows(words, [True] * 40, need, set(doc)))
        for lo in range(len(words) - need + 1):
            if leaks.myers(words[lo : lo + need], doc)[0] <= int(leaks.ERROR_RATE * need):
                assert lo in keep
