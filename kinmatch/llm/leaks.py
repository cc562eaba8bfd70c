"""Problem 8: passages of evaluation items inside documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.core.session import cut

#: Share of an item's words that a passage must hold.
SHARE = 1 / 3
#: Word edits (changed, added or left out) allowed for each word of the passage.
ERROR_RATE = 0.25
#: Items that the driver may gather: they are patterns for every worker, in blocks of this many.
BLOCK = 5_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"<[^<>\n]{0,80}>|&[a-z]{2,6};|&#\d{1,5};|\\[nrt]")
#: Line beginnings that layout puts before the words: diff signs, comment and quote marks, line numbers.
_LINE_START = re.compile(r"(?m)^[+\- ]?[ \t]*(?:\d{1,4}[|:.)]|[>|#*;%]+|//+|--)?[ \t]*(?:\d{1,4}[|])?")


def normal(text: str) -> str:
    """Lower-case words with single blanks around and between; markup and line beginnings are left out."""
    return f" {' '.join(_WORD.findall(_LINE_START.sub(' ', _MARKUP.sub(' ', text)).lower()))} "


#: Words in a row that several items share, from this number on, are no evidence of any of them.
RUN = 6
#: So is what this share of all different documents, and ``NOTICE_LEAST`` at least, hold of an item: a notice.
NOTICE, NOTICE_LEAST = 0.01, 50


def piece_size(need: int) -> int:
    """Words of a piece: of pieces laid end to end over an item, any window of ``need`` words holds one more than its error budget whole."""
    return max(1, (need + 1) // (int(ERROR_RATE * need) + 2))


class Items:
    """Evaluation items ready for the search: words, which of them are the item's own, and exact pieces.

    ``rows``: (id, words, places at which a run of ``RUN`` words begins that other items have too, places of words that are a notice).
    """

    def __init__(self, rows: list[tuple[int, list[str], list[int], list[int]]]):
        self.words: dict[int, list[str]] = {}
        self.own: dict[int, list[bool]] = {}
        self.need: dict[int, int] = {}
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for i, w, shared, noticed in rows:
            own = [True] * len(w)
            for j in shared:
                own[j : j + RUN] = [False] * len(own[j : j + RUN])
            for j in noticed:
                own[j] = False
            self.words[i], self.own[i], self.need[i] = w, own, max(1, -(-len(w) // 3))
            size = piece_size(self.need[i])
            for j in range(0, len(w) - size + 1, size):
                self.pieces.setdefault(f" {' '.join(w[j : j + size])} ", []).append((i, j))


def masks(pattern: list[str]) -> dict[str, int]:
    """Bit masks of the positions of each word of a pattern."""
    out: dict[str, int] = {}
    for j, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << j
    return out


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a stretch of the text, end of that stretch); bit-parallel over words.

    Myers' algorithm in the semi-global form: the stretch may begin and end anywhere. Python integers hold
    patterns of any length.
    """
    m = len(pattern)
    peq, full, top = masks(pattern), (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if d < best:
            best, end = d, at
    return best, end


def dense_windows(words: list[str], own: list[bool], need: int, present: set[str]) -> list[int]:
    """Starts of the windows of ``need`` item words that can match within the budget.

    Each of the window's words that the document lacks costs an edit, so more lacking words than the budget rule
    a window out without loss. A window of which less than half is the item's own text is no evidence.
    """
    budget = int(ERROR_RATE * need)
    out: list[int] = []
    lacking, mine = 0, 0
    for j, w in enumerate(words):
        lacking += w not in present
        mine += own[j]
        if j >= need:
            lacking -= words[j - need] not in present
            mine -= own[j - need]
        if j >= need - 1 and lacking <= budget and 2 * mine >= need:
            out.append(j - need + 1)
    return out


def holds(words: list[str], own: list[bool], need: int, doc: list[str], present: set[str], hits: list[tuple[int, int]]) -> int:
    """Start of a window of ``need`` item words that the document holds as one passage, -1 without one; ``hits``: (place in item, in document).

    A window around a hit counts if its Myers distance to the document nearby stays within the budget. Every window is
    decided: the distance of the next one is smaller by one at most, so a window that is off by d edits too many rules
    out the d - 1 windows behind it.
    """
    windows = dense_windows(words, own, need, present)
    if not windows:
        return -1
    budget = int(ERROR_RATE * need)
    size = piece_size(need)
    for at, place in hits:
        near = doc[max(0, place - need - budget) : place + need + size + budget]
        beginning = at + size - need
        for lo in windows:
            if lo > at:
                break
            if lo < beginning:
                continue
            off = myers(words[lo : lo + need], near)[0] - budget
            if off <= 0:
                return lo
            beginning = lo + off
    return -1


class Search:
    """Finds the items that leaked into one text."""

    def __init__(self, items: Items):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        for p, at in items.pieces.items():
            self.automaton.add_word(p, (len(p), at))
        self.usable = bool(items.pieces)
        if self.usable:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(id, start of the window found) of the items of which the text (already normal) holds a passage, in order."""
        if not self.usable:
            return []
        spots: dict[int, list[tuple[int, int]]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for i, j in at:
                spots.setdefault(i, []).append((j, end - length + 1))
        if not spots:
            return []
        doc = text.split()
        present = set(doc)
        starts: list[int] = []
        p = 0
        for w in doc:
            starts.append(p)
            p += len(w) + 1
        index = {s: k for k, s in enumerate(starts)}
        found = []
        for i, at in spots.items():
            lo = holds(self.items.words[i], self.items.own[i], self.items.need[i], doc, present, [(j, index[s]) for j, s in at])
            if lo >= 0:
                found.append((i, lo))
        return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normal(t).split())


def prepared_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``i, words, shared`` of every item with words: ``shared``, the places at which a run of ``RUN`` words begins that an item of other text has too."""
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null and t <> ''").groupBy("i").agg(F.min("t").alias("t"))
    rows = cut(rows.select("i", _words("t").alias("words")).where("size(words) > 0").withColumn("text", F.xxhash64("words")))
    texts = rows.groupBy("text").agg(F.first("words").alias("words")).where(F.size("words") >= RUN)
    runs = texts.select("text", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - RUN + 1), lambda j: F.xxhash64(F.slice("words", j, RUN)))).alias("j", "run"))
    several = runs.groupBy("run").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("run")
    shared = runs.join(several, "run").groupBy("text").agg(F.collect_set("j").alias("shared"))
    return rows.join(shared, "text", "left").select("i", "words", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def _search(docs: DataFrame, prepared: DataFrame, id_type: T.DataType) -> DataFrame:
    """``doc_id, text_hash, item_id, lo`` of every find; ``prepared`` has ``i, words, shared, noticed``."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("lo", T.IntegerType())])
    blocks = max(1, -(-prepared.count() // BLOCK))
    out = None
    for k in range(blocks):
        mine = prepared.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(sorted((r["i"], r["words"], r["shared"], r["noticed"]) for r in mine))

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            search = Search(Items(block.value))
            for b in batches:
                found = [(d, h, i, lo) for d, t, h in zip(b["doc_id"], b["text"], b["text_hash"]) for i, lo in search(normal(t))]
                yield pd.DataFrame(found, columns=["doc_id", "text_hash", "item_id", "lo"])

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``doc_id, item_id`` for every document that holds, as one passage, a third of an item's words in order.

    Pigeonhole: a passage of m words with at most k errors that covers k + 1 pieces holds one of them intact, so
    an Aho-Corasick automaton over the pieces finds every candidate in one pass over the text; Myers' bit-parallel
    distance over words then decides. At least half of the passage must be the item's own text: neither runs of ``RUN`` words
    that items of other text share, nor a notice, what more than ``NOTICE`` of all different documents hold of it. Only
    where the first pass meets such a notice does a second one search for the items concerned without it.

    Sharing is counted over all items, whatever their blocks. The items go to the workers in blocks of about ``BLOCK``, each
    block one pass, and only one block at a time is on the driver. The documents are never shuffled. NULL and empty
    texts or items hold and give nothing; a document or item that comes twice counts once; an item under two ids is
    found under both.
    """
    prepared = cut(prepared_items(items, item_id, item_text))
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    kind = docs.schema[doc_id].dataType
    asked = prepared.withColumn("noticed", F.array().cast("array<int>"))
    found, settled = cut(_search(given, asked, kind)), None
    total = None
    # A find names one window of the item, so a long notice takes a few rounds: each takes half a window from it at least.
    while True:
        # How many different documents hold each word of an item: only items that enough documents hold can have a notice.
        often = found.groupBy("item_id").agg(F.approx_count_distinct("text_hash").alias("n")).where(F.col("n") >= NOTICE_LEAST // 2).select("item_id")
        if often.isEmpty():
            break
        total = given.agg(F.count(F.lit(1)).alias("n")).first()["n"] if total is None else total
        need = F.ceil(F.size("words") / 3).cast("int")
        held = found.join(often, "item_id", "left_semi").join(prepared.select(F.col("i").alias("item_id"), need.alias("need")), "item_id")
        places = held.groupBy("item_id", "lo", "need").agg(F.count_distinct("text_hash").alias("n")).select("item_id", "n", F.explode(F.sequence("lo", F.col("lo") + F.col("need") - 1)).alias("j"))
        noticed = places.groupBy("item_id", "j").agg(F.sum("n").alias("n")).where((F.col("n") > NOTICE * total) & (F.col("n") >= NOTICE_LEAST))
        noticed = noticed.groupBy(F.col("item_id").alias("i")).agg(F.collect_set("j").alias("more"))
        asked = cut(asked.join(noticed, "i").select("i", "words", "shared", F.array_union("noticed", "more").alias("noticed")))
        if asked.isEmpty():
            break
        kept = found.join(asked.select(F.col("i").alias("item_id")), "item_id", "left_anti").select("doc_id", "item_id")
        settled = kept if settled is None else settled.unionByName(kept)
        found = cut(_search(given, asked, kind))
    rows = found.select("doc_id", "item_id")
    return (rows if settled is None else settled.unionByName(rows)).distinct()
