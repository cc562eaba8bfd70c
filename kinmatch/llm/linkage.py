"""Problem 4: matching records of several sources that share no key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.core.session import cut, release
from kinmatch.llm import gazetteer, logistic, names
from kinmatch.llm.same_names import name_agreement, parse_names_briefly

#: BM25 parameters.
K1, B = 1.2, 0.75
#: A match must reach this share of the score that the query would have against its own copy; the search is exact from there on.
LEAST = 0.3
#: Nearest records that are kept for each query.
NEAREST = 3
#: A pool record counts as near to a Source 1 record from this share of the best score that any pool record has for it.
MUTUAL = 0.1
#: A runner-up further behind than this share of the query's own score is as good as none.
GAP = 0.3
#: Documents that the terms of a query which are looked up first have together, at most, if there is more than one.
FIRST = 8
#: Slices of the larger side of a search that follow one another: all are searched, but only one's shuffle files are on disk.
SLICES = 3
#: Labelled pairs that calibrate the confidence, at most.
SAMPLE_PAIRS = 200_000
#: Confidence from which a pair is a match: about where right pairs stop outnumbering wrong ones.
ACCEPT = 0.4


def attributes(records: DataFrame) -> DataFrame:
    """Records (``id, primary, business_name, business_address, country``) with name parts, location parts and their index terms.

    ``terms``: the sounds of all words of the name together in both orders, each word alone, with the line of trade and with
    the town, location, street. ``common`` terms: line of trade, postal code, town. A missing attribute has no terms.
    Terms are 64-bit hashes: joins and shuffles move numbers.
    """
    once = records.select("id", "primary", "business_name", "business_address", "country").dropDuplicates(["id"])
    parsed = cut(once.select("id", "primary", parse_names_briefly("business_name").alias("n"), gazetteer.parse_addresses("business_address", "country").alias("a")))
    resolved = gazetteer.resolve_parsed(parsed.select("id", "a.*"))
    place = gazetteer.location_key(resolved)
    full = parsed.select("id", "primary", "n").join(place.withColumnRenamed("country", "land"), "id", "left")
    tag = lambda p, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(p), c))
    none = F.array().cast("array<string>")
    each = lambda c, f: F.coalesce(F.when(F.col("n.own").isNotNull(), F.transform(c, f)), none)
    hashed = lambda *parts: F.transform(F.array_distinct(F.array_compact(F.concat(*parts))), lambda t: F.xxhash64(t))
    town = F.when(F.col("loc") != "", F.concat_ws("|", "land", "loc"))
    trade = F.when(F.col("n.trade") != "", F.col("n.trade"))
    words = each("n.own", lambda w: F.concat(F.lit("w:"), w))
    with_trade = each("n.own", lambda w: F.concat(F.lit("x:"), w, F.lit("|"), trade))
    with_town = each("n.own", lambda w: F.concat(F.lit("y:"), w, F.lit("|"), town))
    codes = each("n.codes", lambda k: F.concat(F.lit("n:"), k))
    telling = hashed(codes, F.array(tag("l:", F.col("location")), tag("s:", F.col("street_id"))), with_trade, with_town, words)
    common = hashed(F.array(tag("t:", trade), tag("p:", F.when(F.col("post") != "", F.concat_ws("|", "land", "post"))), tag("c:", town)))
    name = F.struct("n.own", "n.cut", "n.trade", "n.foreign").alias("name")
    full = full.select("*", telling.alias("terms"), common.alias("common"))
    numbers = [F.when(F.col(c) != "", F.xxhash64(c)).alias(c) for c in ("location", "number", "post", "loc", "land")]
    out = cut(full.select("id", F.monotonically_increasing_id().alias("k"), "primary", name, F.col("n.own").isNotNull().alias("has_name"), *numbers, "terms", "common"))
    release(parsed)
    release(resolved)
    return out


def term_weights(docs: DataFrame, n: int | None = None) -> DataFrame:
    """``term, df, idf`` of BM25 over all ``n`` documents (counted if not given)."""
    n = docs.count() if n is None else n
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _norm(length: Column | int, mean: float) -> Column | float:
    """BM25's factor of a term that occurs once in a document of this length."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / mean))


def _total(weights: Column | str) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda n, x: n + x)


def _shared(terms: str, weights: str, of: str) -> Column:
    """Sum of the weights of those ``terms`` that the array ``of`` has."""
    return _total(F.zip_with(terms, weights, lambda t, w: F.when(F.array_contains(of, t), w).otherwise(F.lit(0.0))))


def in_slice(key: str, i: int, n: int) -> Column:
    """Whether a row belongs to slice ``i`` of ``n``, by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(n)) == i


def _with_common(df: DataFrame) -> DataFrame:
    return df if "common" in df.columns else df.withColumn("common", F.slice("terms", 1, 0))


class Documents:
    """Documents (``id, terms`` and maybe ``common``) for one or more searches.

    ``count, mean, least``: how many there are, and how many terms they have on average and at least. The driver holds these as numbers:
    a table of one row would be broadcast by every step that needs it, each time with a job and 4 MB of the driver's heap.
    """

    def __init__(self, docs: DataFrame):
        docs = _with_common(docs)
        self.terms = docs.select("id", F.array_union("terms", "common").alias("terms"))
        length = F.size("terms")
        self.posting = docs.select(F.col("id").alias("d"), F.size(F.array_union("terms", "common")).alias("len_d"), "common", F.explode("terms").alias("term"))
        self.count, self.mean, self.least = self.terms.agg(F.count(F.lit(1)), F.coalesce(F.avg(length), F.lit(1.0)), F.coalesce(F.min(length), F.lit(1))).first()
        # Written before it is joined, so that its shuffle files are gone by then.
        self.weights = cut(term_weights(self.terms, self.count))

    def release(self) -> None:
        """Remove the weights, once the queries of all searches are prepared."""
        release(self.weights)


class Index:
    """Queries prepared for the search in documents.

    Both tables have ``id`` (any type; numbers move fastest), ``terms`` and maybe ``common``. A document is found by its
    ``terms``; ``common`` ones (a line of trade, a town), which identify nothing, only add to the score of documents found.

    ``queries``: ``q, own, t, w, ct, cw, most, first``, one row a query: its score against its own copy, its ``terms`` (heaviest
    first) with their weights, its ``common`` terms with theirs, the greatest factor of a term in any document, and how many
    terms are looked up before it is known how far the others must be: the heaviest, and more while all have ``FIRST``
    documents at most. Terms and weights are arrays of numbers of their own, the lightest form that can be sent.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame | Documents, slices: int = 1):
        """``slices``: in how many parts the documents are looked up, one after the other."""
        self.slices = slices
        given = isinstance(docs, Documents)
        self.docs = docs = docs if given else Documents(docs)
        self.written: list[DataFrame] = []
        queries = _with_common(queries)
        each = F.concat(F.transform("terms", lambda t: F.struct(F.lit(True).alias("look"), t.alias("term"))), F.transform(F.array_except("common", "terms"), lambda t: F.struct(F.lit(False).alias("look"), t.alias("term"))))
        weighed = queries.select(F.col("id").alias("q"), F.size(each).alias("len_q"), F.inline(each)).join(docs.weights, "term")
        q = weighed.groupBy("q").agg(F.first("len_q").alias("len_q"), F.sort_array(F.collect_list(F.struct("look", "idf", "term", "df")), asc=False).alias("all"))
        seen = lambda i: F.aggregate(F.slice("all", 1, i + 1), F.lit(0).cast("bigint"), lambda n, x: n + x["df"])
        first = F.size(F.filter("all", lambda x, i: x["look"] & ((i == 0) | (seen(i) <= FIRST))))
        part = lambda look, c: F.transform(F.filter("all", lambda x: x["look"] == look), lambda x: x[c])
        own = F.aggregate("all", F.lit(0.0), lambda n, x: n + x["idf"]) * _norm(F.col("len_q"), docs.mean)
        self.queries = self._cut(q.select("q", own.alias("own"), part(True, "term").alias("t"), part(True, "idf").alias("w"), part(False, "term").alias("ct"), part(False, "idf").alias("cw"), F.lit(_norm(docs.least, docs.mean)).alias("most"), first.alias("first")))
        if not given:
            docs.release()

    def _cut(self, df: DataFrame) -> DataFrame:
        self.written.append(cut(df))
        return self.written[-1]

    def release(self) -> None:
        """Remove the tables behind the index, once everything found by it is written."""
        for df in self.written:
            release(df)

    def score(self, pairs: DataFrame) -> DataFrame:
        """``q, d, own, score`` of pairs ``q, d``: the whole BM25 score of every pair."""
        full = pairs.select("q", "d").join(self.docs.terms.withColumnRenamed("id", "d"), "d").join(self.queries.select("q", "own", F.concat("t", "ct").alias("t"), F.concat("w", "cw").alias("w")), "q")
        return full.select("q", "d", "own", (_shared("t", "w", "terms") * _norm(F.size("terms"), self.docs.mean)).alias("score"))

    def met(self, q: DataFrame, begin: Column, count: Column, k: int) -> DataFrame:
        """``looked_up`` of all documents, written slice by slice."""
        return reduce(DataFrame.unionByName, [self._cut(self.looked_up(q, begin, count, k, i)) for i in range(self.slices)])

    def looked_up(self, q: DataFrame, begin: Column, count: Column, k: int, part_of: int = 0) -> DataFrame:
        """``q, d`` that can be among the ``k`` best: documents with one of ``count`` terms from place ``begin`` (from 0) of ``t`` on.

        What is known of a score, the looked-up and the common terms, plus the contribution of all terms behind bounds it from
        above, for documents without one of the terms before ``begin`` (those have been found by them already). A document
        whose bound is below the ``k``-th best known part of its query, or below ``floor``, is dropped. Hits are sent by
        query once, and counted, ranked and bounded where they arrive. Only documents of slice ``part_of`` are seen: the ``k``-th
        best of a slice is no better than that of all, so no document is dropped that would stay without slices.
        """
        asked = q.select("q", "ct", "cw", F.inline(F.arrays_zip(F.slice("t", begin + 1, count).alias("term"), F.slice("w", begin + 1, count).alias("idf"))))
        posting = self.docs.posting if self.slices == 1 else self.docs.posting.where(in_slice("d", part_of, self.slices))
        hits = asked.join(posting, "term").select("q", "d", "idf", "len_d", _shared("ct", "cw", "common").alias("shared")).repartition("q")
        part = hits.groupBy("q", "d").agg((F.sum("idf") + F.first("shared")).alias("sum"), F.first("len_d").alias("len_d"))
        others = _total(F.slice("w", begin + count + 1, F.size("w")))
        part = part.join(q.select("q", "floor", others.alias("other")), "q")
        factor = _norm(F.col("len_d"), self.docs.mean)
        part = part.select("q", "d", "floor", (F.col("sum") * factor).alias("part"), (F.col("other") * factor).alias("other"))
        by_q = Window.partitionBy("q")
        ranked = part.withColumn("r", F.row_number().over(by_q.orderBy(F.desc("part"), "d")))
        ranked = ranked.withColumn("kth", F.max(F.when(F.col("r") == k, F.col("part"))).over(by_q))
        bound = F.col("part") + F.col("other") + 1e-9
        return ranked.where((F.col("kth").isNull() | (bound >= F.col("kth"))) & (bound >= F.col("floor"))).select("q", "d")

    def nearest(self, k: int = NEAREST, ties: bool = False, least: float = LEAST, within: float = 1.0) -> DataFrame:
        """``q, d, score, own, rank``: the ``k`` documents of the highest BM25 score for every query, of those with one of its ``terms``.

        Equal scores are numbered by ``d``; with ``ties`` they share a rank and all of the ``k``-th are kept. Documents
        below ``least * own``, or more than ``within * own`` behind the best, are not reported; with 0 and 1 every document
        with a term in common counts. The pruning is exact and has two steps:

        1. The ``first`` terms of a query are looked up and their documents scored in full. The best score
           found, less ``within * own``, is the query's floor (``least * own`` if that is more).
        2. A document without any of those terms can reach the floor only by the terms that are left. Only where their
           greatest contributions together reach it are more terms looked up: as many as it takes until the rest stays
           below the floor.

        So a query with a near copy reads a few short posting lists, and frequent terms are read for few queries.
        """
        floored = self.queries.withColumn("floor", least * F.col("own"))
        one = self._cut(self.score(self.met(floored, F.lit(0), F.col("first"), k)).where(F.col("score") >= least * F.col("own")))
        best = one.groupBy("q").agg(F.max("score").alias("best"))
        floored = self.queries.join(best, "q", "left").withColumn("floor", F.greatest(least * F.col("own"), F.coalesce("best", F.lit(0.0)) - within * F.col("own"), F.lit(0.0)))
        # Terms behind the first ones whose contributions, with all behind them, can still reach the floor.
        behind = F.filter("w", lambda x, i: (i >= F.col("first")) & ((_total(F.slice("w", i + 1, F.size("w"))) + _total("cw")) * F.col("most") >= F.col("floor")))
        more = self._cut(floored.withColumn("more", F.size(behind)).where("more > 0").select("q", "t", "w", "ct", "cw", "floor", "first", "more"))
        two = self.score(self.met(more, F.col("first"), F.col("more"), k)).where(F.col("score") >= least * F.col("own"))
        scored = one.unionByName(two).dropDuplicates(["q", "d"])
        by_q = Window.partitionBy("q")
        order = F.desc(F.round("score", 9))
        place = F.rank().over(by_q.orderBy(order)) if ties else F.row_number().over(by_q.orderBy(order, "d"))
        ranked = scored.withColumns({"rank": place, "_top": F.max("score").over(by_q)})
        return ranked.where((F.col("rank") <= k) & (F.col("score") >= F.col("_top") - within * F.col("own") - 1e-9)).drop("_top")


def nearest(queries: DataFrame, docs: DataFrame, k: int = NEAREST, ties: bool = False, least: float = LEAST, within: float = 1.0) -> DataFrame:
    """``Index.nearest`` of tables that are searched once."""
    return Index(queries, docs).nearest(k, ties, least, within)


FEATURES = ["coverage", "gap", "mutual", "name", "loose", "loose_here", "trade_far", "no_name", "name_far", "same_place", "no_place", "near_place", "far_place", "alone"]


def pair_evidence(best: DataFrame, records: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (``q, d, score, own, gap``; numbers ``k`` of the records) with their ids and the features of the calibration."""
    cols = ["name", "has_name", "location", "number", "post", "loc", "land"]
    a = records.select(F.col("k").alias("q"), F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_q") for c in cols])
    b = docs.select(F.col("k").alias("d"), F.col("id").alias("id_a"), *[F.col(c).alias(f"{c}_d") for c in cols])
    j = best.join(a, "q").join(b, "d")
    both = F.col("has_name_q") & F.col("has_name_d")
    j = j.withColumn("agree", name_agreement("name_q", "name_d"))
    trade_far = both & (F.col("name_q.trade") != F.col("name_d.trade")) & (F.col("name_q.trade") != "") & (F.col("name_d.trade") != "")
    placed = F.col("location_q").isNotNull() & F.col("location_d").isNotNull()
    eq = lambda x: F.coalesce(F.col(f"{x}_q") == F.col(f"{x}_d"), F.lit(False))
    known = lambda x: F.col(f"{x}_q").isNotNull() & F.col(f"{x}_d").isNotNull()
    same = placed & (F.col("location_q") == F.col("location_d"))
    # A street that could not be resolved or a misread number: same postal code and number, or same locality and number.
    near = F.coalesce(~same & eq("number") & (eq("post") | (eq("loc") & ~placed)), F.lit(False))
    apart = F.coalesce((placed & ~same & ~near) | (known("loc") & (F.col("loc_q") != F.col("loc_d"))) | (known("land") & (F.col("land_q") != F.col("land_d"))), F.lit(False))
    j = j.withColumns({"sure": F.col("agree.sure"), "same": F.coalesce(same, F.lit(False)), "near": near, "apart": apart})
    f = lambda c: c.cast("double")
    return j.withColumns(
        {
            "coverage": F.col("score") / F.col("own"),
            "name": F.col("sure"),
            # Resemblance below 0.7 is what any two names have.
            "loose": F.greatest((F.col("agree.loose") - 0.7) / 0.3, F.lit(0.0)),
            "loose_here": F.when(F.col("same") & ~F.coalesce(trade_far, F.lit(False)), F.greatest((F.col("agree.loose") - 0.7) / 0.3, F.lit(0.0))).otherwise(F.lit(0.0)),
            "trade_far": f(F.coalesce(trade_far, F.lit(False))),
            "no_name": f(~both),
            "name_far": f(both & (F.col("sure") == 0)),
            "same_place": f(F.col("same")),
            "near_place": f(F.col("near")),
            "no_place": f(~F.col("same") & ~F.col("near") & ~F.col("apart")),
            "far_place": f(F.col("apart")),
            "alone": f(F.col("gap") >= 0.15),
        }
    )


def link(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """``id_a, id_b, confidence, accepted`` of mutual nearest records; columns of the inputs as in ``attributes``.

    Two searches: every pool record looks for its nearest Source 1 record, or all that are equally near; every Source 1
    record found looks among all pool records. An entity has any number of records, so the pair is mutual if the pool record
    has ``MUTUAL`` of the score of the Source 1 record's nearest one; it need not be the nearest itself, and none is
    dropped for its rank. ``truth`` (``source1_entity_id, matched_entity_ids``) labels some Source 1 records; their pairs, at most
    ``SAMPLE_PAIRS``, calibrate a logistic regression that turns the score gap and the agreement of the attributes
    into a confidence. A pair is accepted from the confidence ``ACCEPT`` on.

    Records without any identifying term (no name, no street) match nothing. Records delivered twice count once.
    """
    cols = ["id", "business_name", "business_address", "country"]
    both = attributes(s1.select(*cols, F.lit(True).alias("primary")).unionByName(pool.select(*cols, F.lit(False).alias("primary"))))
    docs, queries = both.where("primary"), both.where("not primary")
    by_number = lambda df: df.select(F.col("k").alias("id"), "terms", "common")
    parts = []
    primary = Documents(by_number(docs))
    for i in range(SLICES):
        forth = Index(by_number(queries.where(in_slice("k", i, SLICES))), primary)
        parts.append(cut(forth.nearest(2, ties=True, within=GAP)))
        forth.release()
    primary.release()
    found = reduce(DataFrame.unionByName, parts)
    per_q = Window.partitionBy("q")
    second = F.when(F.count_if(F.col("rank") == 1).over(per_q) > 1, F.col("score")).otherwise(F.max(F.when(F.col("rank") > 1, F.col("score"))).over(per_q))
    # A runner-up that is GAP or more behind, or none, counts as GAP behind.
    top = cut(found.withColumn("gap", F.coalesce((F.col("score") - second) / F.col("own"), F.lit(GAP))).where("rank = 1"))
    for part in parts:
        release(part)
    # The search in the other direction: the Source 1 records found look among all pool records.
    asking = by_number(docs).join(top.select(F.col("d").alias("id")).distinct(), "id", "left_semi")
    back = Index(asking, by_number(queries), SLICES)
    # Written one by one, so that each one's shuffle files are gone before the next.
    reverse = cut(back.score(top.select(F.col("d").alias("q"), F.col("q").alias("d"))).select(F.col("q").alias("d"), F.col("d").alias("q"), F.col("score").alias("back")))
    most = cut(back.nearest(1, within=0.0).select(F.col("q").alias("d"), F.col("score").alias("back_best")))
    back.release()
    mutual = top.join(reverse, ["q", "d"]).join(most, "d").withColumn("mutual", F.col("back") / F.col("back_best")).where(F.col("mutual") >= MUTUAL)
    mutual = cut(mutual.select("q", "d", "score", "own", "gap", "mutual"))
    for df in (reverse, most, top):
        release(df)
    part = lambda df, k, i: df.where(in_slice(k, i, SLICES))
    pairs = reduce(DataFrame.unionByName, [cut(pair_evidence(part(mutual, "q", i), part(queries, "k", i), docs).select("id_a", "id_b", *FEATURES)) for i in range(SLICES)])
    release(mutual)
    release(both)
    links = truth.select(F.col("source1_entity_id").alias("id_a"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("id_b")).distinct()
    labelled = pairs.join(truth.select(F.col("source1_entity_id").alias("id_a")).distinct(), "id_a", "left_semi").join(links.withColumn("y", F.lit(1.0)), ["id_a", "id_b"], "left")
    sample = labelled.select(*FEATURES, F.coalesce("y", F.lit(0.0)).alias("y"), "id_b").orderBy(F.xxhash64("id_b")).limit(SAMPLE_PAIRS)
    model = logistic.fit(sample, FEATURES, "y")
    # Nothing to calibrate on: the coverage itself.
    confidence = model.column(FEATURES) if model else F.least(F.col("coverage"), F.lit(1.0))
    scored = pairs.withColumn("confidence", confidence)
    return scored.select("id_a", "id_b", "confidence", (F.col("confidence") >= ACCEPT).alias("accepted"), *FEATURES)
