"""Problem 6: texts laid into containers of fixed capacity, by lexical retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published token pattern, stop words kept (fixed value).
TOKEN = "[0-9A-Za-zА-Яа-яЁё_-]+"
#: Characters for each text of a shard's usual number at which a shard counts as full.
SHARD_CHARACTERS = 5000


class Bm25:
    """An inverted index of one shard: of each term the pieces that have it with their BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n, sizes = len(pieces), np.array([len(p) for p in pieces], np.float64)
        flat = np.concatenate(pieces) if n else np.zeros(0, np.int32)
        terms, ids = np.unique(flat, return_inverse=True)
        pairs, tf = np.unique(ids.astype(np.int64) * max(n, 1) + np.repeat(np.arange(n), sizes.astype(int)), return_counts=True)
        self.owner, term = pairs % max(n, 1), pairs // max(n, 1)
        self.starts = np.searchsorted(term, np.arange(len(terms) + 1))
        df = np.diff(self.starts)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes / max(sizes.mean(), 1e-9)) if n else sizes
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm[self.owner])
        order = np.argsort(self.owner, kind="stable")
        self.terms_of, self.of = term[order], np.searchsorted(self.owner[order], np.arange(n + 1))
        self.n = n

    def scores(self, piece: int) -> np.ndarray:
        """Of every piece of the shard the score for the query that is this piece's distinct terms."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.terms_of[self.of[piece] : self.of[piece + 1]]]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_shard(pieces: list[np.ndarray], capacity: int, neighbours: int = 64) -> list[list[tuple[int, str]]]:
    """Containers as lists of (piece number, role). The longest unused piece is the 'seed'; its best unused BM25 'neighbour's fill the
    container as long as they fit, then the longest unused pieces that still fit, 'filler's, so that little space is left.

    Neighbours are looked at `neighbours` at a time, until no piece that shares a term with the seed fits any more.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    index, unused = Bm25(pieces), np.ones(len(pieces), bool)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(pieces) - 1, -1, -1):  # so that the first comes off first
        stacks[sizes[i]].append(i)
    mask = sum(1 << size for size, s in enumerate(stacks) if s)

    def longest(room: int) -> int | None:
        nonlocal mask
        while at := mask & ((1 << (room + 1)) - 1):
            size = at.bit_length() - 1
            while stacks[size]:
                if unused[stacks[size][-1]]:
                    return stacks[size][-1]
                stacks[size].pop()
            mask ^= 1 << size
        return None

    containers = []
    while (seed := longest(capacity)) is not None:
        unused[seed] = False
        inside, room = [(seed, "seed")], capacity - int(sizes[seed])
        score = index.scores(seed) if room else np.zeros(0)
        while room:
            open_to = np.flatnonzero(unused & (sizes <= room) & (score > 0))
            if not len(open_to):
                break
            best = open_to[np.argpartition(-score[open_to], neighbours - 1)[:neighbours]] if len(open_to) > neighbours else open_to
            for i in best[np.lexsort((best, -score[best]))]:
                if sizes[i] <= room:
                    unused[i] = False
                    inside.append((int(i), "neighbour"))
                    room -= int(sizes[i])
        while (more := longest(room)) is not None:
            unused[more] = False
            inside.append((more, "filler"))
            room -= int(sizes[more])
        containers.append(inside)
    return containers


def token_hashes(text: Column, pattern: str = TOKEN) -> Column:
    """The text's tokens as 32-bit hashes of their lower case; NULL texts have none."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.hash(F.lower(t))), F.array().cast("array<int>"))


def pack_texts(texts: DataFrame, item: str, text: str = "text", capacity: int = 512, shard_texts: int = 3000, neighbours: int = 64) -> DataFrame:
    """(container, item, piece, token_from, token_to, role): every text laid whole into a container of `capacity` tokens, token_to exclusive.

    Only a text of more tokens than the capacity is split, into 'full' containers and a rest that is laid like a whole text.
    Texts are hashed to shards of about `shard_texts` (fewer if they are long), however hot a source or group of copies is, and rows
    equal in item and text, NULL ones too, by their place in the input; tokens go there as hashes. A shard has its own BM25
    index, whose unused neighbours of a seed fill the seed's container, `neighbours` looked at together. role is 'full',
    'seed', 'neighbour', or 'filler' for what only fits. Texts without tokens (NULL, empty) take no space: they come
    out with token_from = token_to = 0 in a container of their shard. Rows equal in `item` are laid each; a NULL item is laid too. No rows
    in, no rows out.
    """
    if capacity < 1 or shard_texts < 1 or neighbours < 1:
        raise ValueError("capacity, shard_texts and neighbours must be at least 1")
    # by number, or by size where texts are long on average
    share = F.count(F.lit(1)) / F.lit(float(shard_texts)) + F.coalesce(F.sum(F.length(text)), F.lit(0)) / F.lit(float(shard_texts * SHARD_CHARACTERS))
    shards = F.ceil(texts.agg(share.alias("n")).scalar())
    place = F.xxhash64(F.col(item), F.col(text), F.monotonically_increasing_id())
    rows = texts.select(F.col(item).cast("long").alias("item"), token_hashes(F.col(text)).alias("tokens"), place.alias("place"))
    sharded = rows.withColumn("shard", F.pmod(F.col("place"), F.greatest(shards, F.lit(1))).cast("long"))

    def lay(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", kind="stable")
        tokens, full = [], []
        for i, t in enumerate(f["tokens"]):
            t = np.asarray(t, np.int32)
            for k, at in enumerate(range(0, max(len(t), 1), capacity)):
                part = t[at : at + capacity]
                alone = len(t) > capacity and len(part) == capacity
                (full if alone else tokens).append((i, k, at, part))
        packed = pack_shard([p for *_, p in tokens], capacity, neighbours)
        containers = [[(j, "full")] for j in range(len(full))] + [[(len(full) + j, role) for j, role in c] for c in packed]
        every = full + tokens
        keys, rows, shard = f["item"].to_numpy(dtype=object), [], int(f["shard"].iloc[0]) << 32
        for c, inside in enumerate(containers):
            for j, role in inside:
                i, k, at, part = every[j]
                rows.append((shard + c, keys[i], k, at, at + len(part), role))
        return pd.DataFrame(rows, columns=["container", "item", "piece", "token_from", "token_to", "role"]).astype({"item": "Int64"})

    return sharded.groupBy("shard").applyInPandas(lay, "container long, item long, piece int, token_from long, token_to long, role string")


def split_items(layout: DataFrame) -> DataFrame:
    """(item) of the texts that were split."""
    return layout.where(F.col("piece") > 0).select("item").distinct()


def coverage(layout: DataFrame, capacity: int = 512) -> DataFrame:
    """(item, n_tokens, pieces, whole, fits) of each item of a layout in which items are unique: whether its pieces cover its tokens from
    the first to the last once each, and whether all its containers hold `capacity` tokens at most."""
    size = F.col("token_to") - F.col("token_from")
    filled = layout.groupBy("container").agg(F.sum(size).alias("filled"))
    rows = layout.join(filled, "container")
    gapless = (F.min("token_from") == 0) & (F.max("token_to") == F.sum(size)) & (F.count_distinct("token_from") == F.count(F.lit(1)))
    return rows.groupBy("item").agg(F.sum(size).alias("n_tokens"), F.count(F.lit(1)).alias("pieces"), gapless.alias("whole"), (F.max("filled") <= capacity).alias("fits"))
