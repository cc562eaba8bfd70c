"""Problem 1: a gazetteer built from the addresses themselves, and the place of every address in it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinmatch.core.session import cut, release
from kinmatch.llm import addresses
from kinmatch.llm.components import connected_components

#: Leading digits of a postal code that name a locality: the longest of these that towns agree on is taken, by country.
PREFIXES = (3, 2)
#: A place word stands for a locality if this share of its postal codes lies there.
PURE = 0.8
#: Hypotheses kept for an address after each step of the search.
BEAM = 4

_ADDRESS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("country", "number", "street", "kind", "post")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("places", "hints", "readings")]
)


@F.arrow_udf(_ADDRESS)
def parse_addresses(text: pa.Array, country: pa.Array) -> pa.Array:
    """``addresses.parse`` of columns."""
    spelt: dict[str | None, str] = {}
    lands = [spelt[c] if c in spelt else spelt.setdefault(c, addresses.country_of(c)) for c in country.to_pylist()]
    rows = [addresses.parse(t, c) for t, c in zip(text.to_pylist(), lands)]
    for r in rows:  # a direction tells streets apart as the kind does
        r.kind = f"{r.towards} {r.kind}".lstrip()
    columns = [pa.array(lands, pa.string())]
    columns += [pa.array([getattr(r, f.name) for r in rows], to_arrow_type(f.dataType)) for f in _ADDRESS.fields[1:]]
    return pa.StructArray.from_arrays(columns, _ADDRESS.names)


def close_spelling(a: Column, b: Column) -> Column:
    """Edit grade of two words: 0 equal, 1 one letter changed, added, left out or two neighbours swapped, 2 two such errors, 9 more."""
    d = F.levenshtein(a, b)
    swap = (F.array_join(F.array_sort(F.split(a, "")), "") == F.array_join(F.array_sort(F.split(b, "")), "")) & (d == 2)
    return F.when(a == b, F.lit(0)).when((d == 1) | swap, F.lit(1)).when(d <= 3, F.lit(2)).otherwise(F.lit(9))


def without_one(word: Column) -> Column:
    """The word and all forms with one letter left out: words one error apart share one of them."""
    n = F.length(word)
    cut_ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut_))


def localities(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``country, width``: digits of a postal code that name a locality; ``country, place, loc, n``: place words that stand for one).

    For every country the longest prefix length is taken under which most mentions of place words agree on one
    prefix. Country "" holds the words that mean one locality in all countries together.
    """
    seen = parsed.where("post <> '' and country <> ''").select("country", "post", F.explode("places").alias("place"))
    by = None
    for width in PREFIXES:
        part = seen.groupBy("country", "place", F.substring("post", 1, width).alias("loc")).agg(F.count(F.lit(1)).alias("n")).withColumn("width", F.lit(width))
        by = part if by is None else by.unionByName(part)
    w = Window.partitionBy("country", "place", "width")
    top = by.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "loc"))}).where("r = 1")
    top = cut(top.select("country", "place", "width", "loc", "n", "total"))
    # Mentions by how well they agree: regions never agree, so half of the mentions agreeing marks the towns.
    fit = top.where("total >= 3").groupBy("country", "width").agg((F.sum(F.when(F.col("n") >= PURE * F.col("total"), F.col("total")).otherwise(0)) / F.sum("total")).alias("share"))
    best = fit.groupBy("country").agg(F.max("share").alias("most"))
    width = fit.join(best, "country").where(F.col("share") >= 0.85 * F.col("most")).groupBy("country").agg(F.max("width").alias("width"))
    pure = top.join(width, ["country", "width"]).where(F.col("n") >= PURE * F.col("total"))
    words = pure.select("country", "place", "loc", "n")
    anywhere = words.groupBy("place").agg(F.sum("n").alias("n"), F.max_by(F.struct("country", "loc"), "n").alias("b"), F.max("n").alias("m")).where(F.col("m") >= PURE * F.col("n"))
    return width, words.unionByName(anywhere.select(F.lit("").alias("country"), "place", F.concat_ws("|", "b.country", "b.loc").alias("loc"), "n"))


def settle_readings(parsed: DataFrame) -> DataFrame:
    """``parsed`` with one street name an address. Where nothing marks how many words a name has, the addresses themselves
    decide: the longest reading that two of them and half as many as its shortest one have stands, else the shortest."""
    if parsed.where(F.size("readings") > 1).isEmpty():
        return parsed.drop("readings")
    said = F.when(F.size("readings") > 1, F.col("readings")).otherwise(F.array("street"))
    n = parsed.where("street <> ''").select("country", "kind", F.explode(said).alias("street")).groupBy("country", "kind", "street").agg(F.count(F.lit(1)).alias("n"))
    open_ = parsed.where(F.size("readings") > 1).select("id", "country", "kind", F.posexplode("readings").alias("at", "street"))
    by_id = Window.partitionBy("id")
    judged = open_.join(n, ["country", "kind", "street"]).withColumn("least", F.max(F.struct("at", "n")).over(by_id))
    good = (F.col("n") >= 2) & (2 * F.col("n") >= F.col("least.n")) | (F.col("at") == F.col("least.at"))
    chosen = judged.where(good).groupBy("id").agg(F.min(F.struct("at", "street")).alias("_r")).select("id", F.col("_r.street").alias("_street"))
    return parsed.drop("readings").join(chosen, "id", "left").withColumn("street", F.coalesce("_street", "street")).drop("_street")


def locate(parsed: DataFrame, width: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``parsed`` (with ``id``) plus ``loc``, the locality, "" where nothing tells it; NULL countries filled in from the place;
    ``id, country, loc, s, r``: the proposals of addresses that have several).

    First step of the search: the postal code and every place word propose localities; the code counts double, a
    word misspelt by one letter half. The best ``BEAM`` proposals go on to the street step; the first
    of them stands until then.
    """
    base = parsed.join(F.broadcast(width), "country", "left").withColumn("width", F.coalesce("width", F.lit(3)))
    code = base.where("post <> ''").select("id", "country", F.expr("substring(post, 1, width)").alias("loc"), F.lit(2.0).alias("s"))
    said = base.select("id", F.col("country").alias("c"), F.explode("places").alias("place"))
    exact = said.join(words.withColumnRenamed("country", "c"), ["c", "place"])
    named = exact.select("id", F.when(F.col("c") == "", F.split("loc", "\\|")[0]).otherwise(F.col("c")).alias("country"), F.when(F.col("c") == "", F.split("loc", "\\|")[1]).otherwise(F.col("loc")).alias("loc"), F.lit(1.0).alias("s"))
    # Misspelt place words: only for addresses that neither a code nor a word has placed.
    lost = said.join(code.select("id").unionByName(named.select("id")), "id", "left_anti").where("c <> '' and length(place) >= 6")
    sure = words.where("country <> '' and n >= 5 and length(place) >= 6").select(F.col("country").alias("c"), F.col("place").alias("right"), "loc", F.explode(without_one(F.col("place"))).alias("k"))
    near = lost.withColumn("k", F.explode(without_one(F.col("place")))).join(sure, ["c", "k"]).where(close_spelling(F.col("place"), F.col("right")) <= 1)
    fuzzy = near.select("id", F.col("c").alias("country"), "loc", F.lit(0.5).alias("s"))
    votes = code.where("country <> ''").unionByName(named).unionByName(fuzzy).groupBy("id", "country", "loc").agg(F.sum("s").alias("s"))
    by_id = Window.partitionBy("id")
    ranked = votes.withColumns({"r": F.row_number().over(by_id.orderBy(F.desc("s"), "country", "loc")), "of": F.count(F.lit(1)).over(by_id)})
    beam = cut(ranked.where(F.col("r") <= BEAM))
    best = beam.where("r = 1").select("id", F.col("country").alias("_c"), F.col("loc").alias("_l"))
    located = parsed.join(best, "id", "left").withColumns({"country": F.coalesce("_c", "country"), "loc": F.coalesce("_l", F.lit(""))}).drop("_c", "_l")
    return located, beam.where("of > 1").drop("of")


def _spelt(*at: str) -> Column:
    """Codes under which a street meets spellings one error away at the same place."""
    return F.explode(F.transform(without_one(F.col("street")), lambda x: F.xxhash64(*at, "kind", x)))


def _towards(kind: str) -> Column:
    return F.regexp_extract(kind, "^(north|south|east|west|northeast|northwest|southeast|southwest) ", 1)


def choose(located: DataFrame, rivals: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, country, loc, street_id`` of addresses for which another proposal than the first fits its street better.

    A proposal's votes and the best entry of the street there, as spelt or one error away, are scored together: the
    entry counts by its spelling, more with the full postal code or a landmark in common. An entry counts
    only if addresses without a rival proposal have made it.
    """
    h = rivals.join(located.where("street <> ''").select("id", "street", "kind", "post", "hints"), "id")
    key = ["country", "loc", "street", "kind"]
    unsure = h.where("r = 1").groupBy(*key).agg(F.count(F.lit(1)).alias("unsure"))
    known = entries.join(unsure, key, "left").where(F.col("n") > F.coalesce("unsure", F.lit(0)))
    e = known.select("street_id", "n", "posts", F.col("hints").alias("eh"), F.col("street").alias("es"), _spelt("country", "loc").alias("k"))
    met = h.withColumn("k", _spelt("country", "loc")).join(e, "k")
    grade = close_spelling(F.col("street"), F.col("es"))
    more = F.when(F.array_contains("posts", F.col("post")), 0.5).otherwise(0.0) + F.when(F.arrays_overlap("hints", "eh"), 0.25).otherwise(0.0)
    fit = met.where(grade <= 1).select("id", "r", "street_id", "n", (F.when(grade == 0, 1.5).otherwise(1.25) + more).alias("f"))
    fit = fit.groupBy("id", "r").agg(F.max(F.struct("f", "n", "street_id")).alias("b"))
    total = h.select("id", "r", "country", "loc", "s").join(fit, ["id", "r"], "left").withColumn("t", F.col("s") + F.coalesce("b.f", F.lit(0.0)))
    top = total.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("t"), "r"))).where("p = 1 and r > 1")
    return top.select("id", F.col("country").alias("_c"), F.col("loc").alias("_l"), F.col("b.street_id").alias("_s"))


def street_entries(located: DataFrame) -> DataFrame:
    """The gazetteer: ``country, loc, street, kind`` as spelt, with ``n``, ``posts`` and ``hints`` seen there, and the ``street_id``.

    Spellings are clustered within their locality. A spelling joins a more frequent one that it resembles by the
    evidence they share: with a common full postal code up to two errors, with a common landmark or area up to two, with a
    common house number one; with none of them one error, from a spelling seen once or twice to one seen three times as often. The kind of
    street must agree, or one postal code hold both. Every spelling joins its best candidate, and chains of joins
    end at the spelling that gives the cluster its id.
    """
    key = ["country", "loc", "street", "kind"]
    known = located.where("street <> '' and loc <> ''")
    per = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("post") != "", F.col("post")))).alias("posts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hints")))).alias("hints"), F.array_sort(F.collect_set(F.when(F.col("number") != "", F.col("number")))).alias("numbers"))
    entries = cut(per.withColumn("e", F.concat_ws("|", *key)))
    # Where spellings meet: one row for each code and each form with a letter left out, as light as can be.
    slim = entries.select(F.xxhash64("country", "loc").alias("at"), "e", "street", "kind", "n", "posts")
    by_post = slim.select("e", "street", "n", F.explode(F.transform("posts", lambda x: F.xxhash64("at", F.lit("p"), x))).alias("k"))
    by_word = slim.select("e", "street", "n", F.explode(F.transform(without_one(F.col("street")), lambda x: F.xxhash64("at", "kind", x))).alias("k"))
    keyed = by_post.unionByName(by_word)
    a = keyed.select("k", *[F.col(c).alias(f"{c}_a") for c in ("e", "street", "n")])
    b = keyed.select("k", *[F.col(c).alias(f"{c}_b") for c in ("e", "street", "n")])
    more = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("e_b") < F.col("e_a")))
    similar = close_spelling(F.col("street_a"), F.col("street_b")) <= 2
    near = a.join(b, "k").where(more & (F.col("e_a") != F.col("e_b")) & similar).select("e_a", "e_b").distinct()
    about = ("street", "kind", "n", "posts", "hints", "numbers")
    met = near.join(entries.select(F.col("e").alias("e_a"), *[F.col(c).alias(f"{c}_a") for c in about]), "e_a").join(entries.select(F.col("e").alias("e_b"), *[F.col(c).alias(f"{c}_b") for c in about]), "e_b")
    grade = close_spelling(F.col("street_a"), F.col("street_b"))
    posts = F.arrays_overlap("posts_a", "posts_b")
    hints = F.coalesce(F.arrays_overlap("hints_a", "hints_b"), F.lit(False)) & (F.size("hints_a") > 0)
    numbers = F.arrays_overlap("numbers_a", "numbers_b")
    codes_differ = (F.size("posts_a") > 0) & (F.size("posts_b") > 0) & ~posts
    same_kind = F.col("kind_a") == F.col("kind_b")
    # North and south of one name are two streets.
    met = met.where(_towards("kind_a") == _towards("kind_b"))
    ok = F.when(posts, (grade <= 2) & (same_kind | (grade == 0))).when(codes_differ, F.lit(False)).when(hints, (grade <= 2) & same_kind).when(numbers, (grade <= 1) & same_kind).otherwise((grade <= 1) & same_kind & (F.col("n_a") <= 2) & (F.col("n_b") >= 3 * F.col("n_a")))
    score = F.when(posts, F.lit(4.0)).otherwise(F.lit(0.0)) + F.when(hints, F.lit(2.0)).otherwise(F.lit(0.0)) + F.when(numbers, F.lit(2.0)).otherwise(F.lit(0.0)) - grade - F.when(same_kind, F.lit(0.0)).otherwise(F.lit(1.0))
    cand = met.where(ok).select("e_a", "e_b", "n_b", score.alias("s"))
    w = Window.partitionBy("e_a").orderBy(F.desc("s"), F.desc("n_b"), "e_b")
    ranked = cand.withColumns({"r": F.row_number().over(w), "s2": F.lead("s").over(w)})
    # Without a code or landmark in common, two equally good candidates decide nothing.
    joins = ranked.where("r = 1 and (s >= 1 or s2 is null or s2 < s)").select("e_a", "e_b")
    groups = connected_components(joins, "e_a", "e_b").toDF("e", "street_id")
    out = cut(entries.join(groups, "e", "left").withColumn("street_id", F.coalesce("street_id", "e")).drop("e"))
    release(entries)
    release(groups)
    return out


def resolve(records: DataFrame, row_id: str, address: str, country: str) -> DataFrame:
    """``id, street_id, number, loc, country, post`` of every record with a non-empty address; ``street_id`` NULL where unresolved.

    Second step of the search: an address takes its own spelling's entry in its locality, or the entry of another
    proposed locality if that fits better together (``choose``). One without a locality takes the entry of its country
    with its street and kind, scored by spelling, postal code and landmarks, if it is better than the second; a misspelt
    street needs a code or landmark in common. A street that is nowhere in the gazetteer is an entry of its own.
    """
    once = records.select(F.col(row_id).alias("id"), F.col(address).alias("t"), F.col(country).alias("c")).dropDuplicates(["id"])
    return resolve_parsed(cut(once.select("id", parse_addresses("t", "c").alias("a")).select("id", "a.*")))


def resolve_parsed(parsed: DataFrame) -> DataFrame:
    """``resolve`` of addresses that are taken apart already, one row an id."""
    parsed = settle_readings(parsed)
    width, words = map(cut, localities(parsed))
    located, rivals = locate(parsed, width, words)
    located = cut(located)
    release(width)
    release(words)
    entries = street_entries(located)
    key = ["country", "loc", "street", "kind"]
    # Written before it is joined, so that its shuffle files are gone by then; so are those of ``taken``.
    chosen = cut(choose(located, rivals, entries))
    own = located.where("loc <> ''").join(entries.select(*key, "street_id"), key, "left").join(chosen, "id", "left")
    own = own.withColumns({"street_id": F.when(F.col("_l").isNotNull(), F.col("_s")).otherwise(F.col("street_id")), "country": F.coalesce("_c", "country"), "loc": F.coalesce("_l", "loc")})
    adrift = located.where("loc = '' and street <> ''").select("id", "country", "street", "kind", "post", "hints")
    e = entries.select("street_id", "n", "posts", F.col("hints").alias("eh"), F.col("street").alias("es"), _spelt("country").alias("k"))
    met = adrift.withColumn("k", _spelt("country")).join(e, "k")
    grade = close_spelling(F.col("street"), F.col("es"))
    more = F.when(F.array_contains("posts", F.col("post")), 1).otherwise(0) + F.when(F.arrays_overlap("hints", "eh"), 1).otherwise(0)
    options = met.select("id", "street_id", "es", "n", grade.alias("g"), more.alias("more")).distinct().where("g = 0 or (g = 1 and more > 0)")
    scored = options.groupBy("id", "street_id").agg(F.max(F.col("more") + F.when(F.col("g") == 0, 2).otherwise(0)).alias("s"), F.sum("n").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("s"), F.desc("n"), "street_id")
    first = scored.withColumns({"r": F.row_number().over(w), "s2": F.lead("s").over(w)}).where("r = 1")
    # Equally good entries leave an address unresolved; no entry at all makes one.
    taken = first.select("id", F.when(F.col("s2").isNull() | (F.col("s2") < F.col("s")), F.col("street_id")).alias("street_id"), F.lit(True).alias("_met"))
    taken = cut(taken)
    rest = located.where("loc = ''").join(taken, "id", "left").withColumn("street_id", F.when(F.col("_met").isNull() & (F.col("street") != ""), F.concat_ws("|", *key)).otherwise(F.col("street_id")))
    cols = ["id", "street_id", "number", "loc", "country", "post"]
    out = cut(own.select(*cols).unionByName(rest.select(*cols)))
    for df in (rivals, located, entries, chosen, taken):
        release(df)
    return out


def location_key(resolved: DataFrame) -> DataFrame:
    """``resolved`` with ``location``: street and house number, NULL where either is missing."""
    return resolved.withColumn("location", F.when(F.col("street_id").isNotNull() & (F.col("number") != ""), F.concat_ws("#", "street_id", F.ltrim(F.col("number"), F.lit("0")))))


def same_location_pairs(records: DataFrame, row_id: str, address: str, country: str) -> DataFrame:
    """``id_a, id_b``: records whose addresses denote the same house in the same street of the same town and country.

    Unit, floor, building part, landmark and area play no part. NULL, empty and placeholder addresses and those
    without a street and house number denote no location. A record that is delivered twice counts once.
    """
    from kinmatch.llm.same_names import member_pairs

    at = location_key(resolve(records, row_id, address, country)).where("location is not null")
    return member_pairs(at.select("id", "location").distinct(), "id", "location")
