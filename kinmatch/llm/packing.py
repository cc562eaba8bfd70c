"""Problem 7: filling containers of fixed capacity with texts."""

from __future__ import annotations

import base64
import re
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.core.session import cut

#: Tokens that one packing group should hold: 2,048 containers of 2,048 tokens.
GROUP_TOKENS = 1 << 22
#: Distinct stretches of text whose token counts a worker remembers.
CACHE = 400_000

#: A stretch: white space and the run of other characters after it. No token of a byte-level BPE vocabulary with
#: the usual pattern reaches from one stretch into the next, so counts of stretches add up exactly.
_STRETCH = re.compile(r"\s*\S+|\s+")

_encoders: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """Tokens of a text under a public byte-level BPE vocabulary (ranks file of the tiktoken form)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encode = tiktoken.Encoding("kinmatch", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._seen: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        """Number of tokens; 0 for None and ""."""
        if not text:
            return 0
        seen, total = self._seen, 0
        for s in _STRETCH.findall(text):
            n = seen.get(s)
            if n is None:
                n = len(self._encode(s))
                if len(s) < 40:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[s] = n
            total += n
        return total


def counter(path: str) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = TokenCounter(path)
    return _encoders[path]


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens`` of every row, over the whole text. NULL and empty texts have 0 tokens."""

    @F.pandas_udf("bigint")
    def count(values: pd.Series) -> pd.Series:
        c = counter(tokenizer)
        return pd.Series([c.count(v) for v in values], dtype="int64")

    return df.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("n_tokens"))


def best_two_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place of every item; ``sizes`` are between 0 and ``capacity``.

    A container is filled greedily, the largest item that fits first. Then its smallest item is replaced by the
    two unpacked items that fill the gap, widened by that item, most tightly; again as long as that helps.
    Items of equal size are interchangeable, so the search runs over distinct sizes. Items of size 0 take places
    in the first container.
    """
    order = np.argsort(-sizes, kind="stable")
    stock: dict[int, list[int]] = {}
    for i in order[::-1]:
        stock.setdefault(int(sizes[i]), []).append(int(i))
    empty = stock.pop(0, [])
    present = sorted(stock)
    container, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    def take(s: int) -> int:
        items = stock[s]
        i = items.pop()
        if not items:
            del stock[s]
            present.pop(bisect_right(present, s) - 1)
        return i

    def give(s: int, i: int) -> None:
        if s in stock:
            stock[s].append(i)
        else:
            stock[s] = [i]
            insort(present, s)

    k = 0
    while present:
        bin_: list[tuple[int, int]] = []
        gap = capacity
        while present and present[0] <= gap:
            s = present[bisect_right(present, gap) - 1]
            bin_.append((s, take(s)))
            gap -= s
        while gap and len(bin_) > 1 and present:
            s, i = bin_[-1]
            pair = _closest_pair(present, stock, gap + s)
            if pair is None or sum(pair) <= s:
                break
            bin_.pop()
            a, b = pair
            bin_ += [(b, take(b)), (a, take(a))]
            give(s, i)
            gap += s - a - b
            bin_.sort(key=lambda x: -x[0])
        for at, (_, i) in enumerate(bin_):
            container[i], place[i] = k, at
        k += 1
    if empty:
        at = int((container[sizes > 0] == 0).sum())
        for n, i in enumerate(empty):
            container[i], place[i] = 0, at + n
    return container, place


def _closest_pair(present: list[int], stock: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two unpacked sizes (smaller first) with the greatest sum up to ``room``."""
    sizes = np.asarray(present[: bisect_right(present, room)])
    if not len(sizes):
        return None
    small = sizes[: np.searchsorted(sizes, room // 2, "right")]
    if not len(small):
        return None
    at = np.searchsorted(sizes, room - small, "right") - 1
    at = np.maximum(at, 0)
    other = sizes[at]
    # An item cannot be its own partner: with one copy only, take the next smaller size.
    for j in np.flatnonzero(other == small):
        if len(stock[int(small[j])]) < 2:
            other[j] = sizes[at[j] - 1] if at[j] else 0
    total = np.where(other > 0, small + other, 0)
    j = int(total.argmax())
    if not total[j] or total[j] > room:
        return None
    return (int(min(small[j], other[j])), int(max(small[j], other[j])))


def pack(counts: DataFrame, capacity: int = 2048, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Containers for texts of known size: ``doc_id, piece, n_tokens, container, place``.

    A text longer than ``capacity`` is cut into full pieces and a rest (``piece`` counts from 0; piece p begins at
    token p * capacity); all others stay whole. Texts are spread over groups of about ``group_tokens`` tokens by a
    hash of the id, and each group is packed on its own: a group leaves at most one poorly filled container in
    2,048, so what is lost against one global packing is under 0.05 %. Groups are bounded whatever the input.

    Empty and NULL texts get a place in their group's first container. Repeated ids are packed as separate items.
    """
    counts = cut(counts.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))))
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, round(total["t"] / group_tokens), total["n"] // 200_000)
    pieces = counts.select(
        "doc_id",
        F.posexplode(
            F.when(F.col("n_tokens") <= capacity, F.array("n_tokens")).otherwise(
                F.concat(
                    F.array_repeat(F.lit(capacity).cast("bigint"), F.floor(F.col("n_tokens") / capacity).cast("int")),
                    F.when(F.col("n_tokens") % capacity > 0, F.array(F.col("n_tokens") % capacity)).otherwise(F.array().cast("array<bigint>")),
                )
            )
        ).alias("piece", "n_tokens"),
    ).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="mergesort").reset_index(drop=True)
        container, place = best_two_fit(pdf["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "container": (int(key[0]) << 32) + container, "place": place})

    id_type = dict(counts.dtypes)["doc_id"]
    return pieces.groupBy("group").applyInPandas(run, f"doc_id {id_type}, piece int, n_tokens bigint, container bigint, place bigint")
