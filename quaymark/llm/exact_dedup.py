"""Exact deduplication: a static binary-fuse filter over a snapshot screens the digests of a new batch.

The snapshot is immutable, so its distinct digests are cut into buckets by digest and each bucket gets one
3-wise binary-fuse filter, built once. Digests of the new batch meet the filter of their bucket; only positives
join the snapshot's exact buckets, where the bytes of both texts are compared. Duplicates inside the new batch
are grouped by digest on their own, before the screen, so that one row of each group is screened.

Texts are equal when identical after every run of ASCII white space becomes one space; null counts as empty.
Defined results: the smallest doc_id of equal texts stays; null doc_ids never stay beside others; rows that repeat
doc_id and text share one verdict; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common

#: Digests of one filter, on average; digests are uniform, so a bucket stays near it.
BUCKET_KEYS = 400_000
FINGERPRINT_BITS = 16
_SEEDS = 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over the keys."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _geometry(n: int) -> tuple[int, int]:
    """Slots of a segment (a power of two) and number of segments for n keys."""
    if n < 2:
        return 4, 3
    width = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    return width, max(3, int(np.ceil(n * factor / width)) + 2)


def _slots(hashes: np.ndarray, width: int, segments: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments."""
    window = ((hashes >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    base = window.astype(np.int64) * width
    mask = np.uint64(width - 1)
    return np.stack([base + i * width + ((hashes >> np.uint64(18 * i)) & mask).astype(np.int64) for i in range(3)])


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes, 991) >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """``(seed, width, segments, cells)`` of a binary-fuse filter over 64-bit keys.

    Peels all slots that one remaining key touches at once; such keys share no slot, so a whole round can
    be assigned together, last round first.
    """
    keys = np.unique(keys.astype(np.uint64))
    width, segments = _geometry(len(keys))
    for seed in range(_SEEDS):
        hashes = _mixed(keys, seed)
        slots = _slots(hashes, width, segments)
        left, rounds = np.arange(len(keys)), []
        while len(left):
            mine = slots[:, left]
            degree = np.bincount(mine.ravel(), minlength=width * segments)
            single = degree[mine] == 1
            free = single.any(axis=0)
            if not free.any():
                break
            rounds.append((left[free], np.argmax(single[:, free], axis=0)))
            left = left[~free]
        if len(left):
            continue
        cells = np.zeros(width * segments, np.uint16)
        marks = _fingerprints(hashes)
        for which, own in reversed(rounds):
            at = slots[:, which]
            home = at[own, np.arange(len(which))]
            cells[home] = 0
            cells[home] = marks[which] ^ cells[at[0]] ^ cells[at[1]] ^ cells[at[2]]
        return seed, width, segments, cells
    raise ValueError("no filter found")


def may_contain(keys: np.ndarray, seed: int, width: int, segments: int, cells: np.ndarray) -> np.ndarray:
    hashes = _mixed(keys.astype(np.uint64), seed)
    a, b, c = _slots(hashes, width, segments)
    return (cells[a] ^ cells[b] ^ cells[c]) == _fingerprints(hashes)


def _as_keys(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    seed, width, segments, cells = build_filter(_as_keys(rows["key"]))
    return pd.DataFrame(
        {"bucket": rows["bucket"].iloc[:1], "seed": seed, "width": width, "segments": segments, "cells": [cells.tobytes()]}
    )


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(new) or not len(filters):
        return new[["digest"]].iloc[:0]
    f = filters.iloc[0]
    shape = int(f["seed"]), int(f["width"]), int(f["segments"])
    hit = may_contain(_as_keys(new["key"]), *shape, np.frombuffer(f["cells"], np.uint16))
    return new.loc[hit, ["digest"]]


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` (sha256 of the normalised text) of every row."""
    plain = F.regexp_replace(common.whole_text(), common.SPACE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(plain, 256)).alias("digest"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return groups.select("digest", key.alias("key"), (F.crc32("digest") % buckets).cast("int").alias("bucket"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of the snapshot's distinct digests."""
    form = "bucket int, seed int, width int, segments int, cells binary"
    return _keyed(groups, buckets).groupBy("bucket").applyInPandas(_build, form)


def screened(new: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``new`` that the filters don't rule out."""
    left, right = _keyed(new, buckets).groupBy("bucket"), filters.groupBy("bucket")
    return left.cogroup(right).applyInPandas(_screen, "digest binary")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def _same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The digests whose two texts, of the new batch and of the snapshot, have the same bytes."""
    ids = pairs.select(F.explode(F.array("new_id", "old_id")).alias("doc_id"), "digest")
    plain = F.regexp_replace(common.whole_text(), common.SPACE, " ")
    # Always a merge join: a broadcast of few ids would turn into a shuffle of the texts at some larger size.
    texts = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id").select("digest", plain.alias("plain"))
    texts = texts.where(F.unhex(F.sha2("plain", 256)) == F.col("digest"))  # a doc_id may come with several texts
    return texts.groupBy("digest").agg(F.min("plain").alias("a"), F.max("plain").alias("b")).where("a = b").select("digest")


def exact_groups(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The lower half of the id range is the snapshot, the upper half the new batch.
    """
    rows = common.settle(digests(docs))
    middle = rows.agg(F.expr("(min(doc_id) + max(doc_id)) / 2").alias("m")).first()["m"]
    is_new = F.col("doc_id") > (middle if middle is not None else 0)
    old = common.settle(_grouped(rows.where(~F.coalesce(is_new, F.lit(True)))))
    new = common.settle(_grouped(rows.where(F.coalesce(is_new, F.lit(True)))))
    buckets = max(1, -(-max(old.count(), new.count()) // bucket_keys))
    filters = common.settle(snapshot_filters(old, buckets))
    positive = common.settle(screened(new, filters, buckets))
    pairs = common.settle(
        positive.join(new, "digest")
        .join(old.select("digest", F.col("first_id").alias("old_id"), F.col("n").alias("old_n")), "digest")
        .select("digest", F.col("first_id").alias("new_id"), "old_id", "old_n", F.col("n").alias("new_n"))
    )
    proven = common.settle(pairs.join(_same_bytes(docs, pairs), "digest", "left_semi"))
    met = proven.select(
        "digest", F.least("old_id", "new_id").alias("keep_id"), (F.col("old_n") + F.col("new_n")).alias("group_size")
    )
    alone = old.unionByName(new).join(proven, "digest", "left_anti").select(
        "digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")
    )
    groups = common.settle(met.unionByName(alone))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of equal texts, with its columns: the least doc_id, null last.

    Rows that repeat a doc_id are judged one by one: one with a text of its own stays, copies go, without an id too.
    """
    if not common.told_apart(docs):
        return common.one_of_each(docs, lambda rows: exact_groups(rows).select("doc_id", F.col("text_sha256").alias("class")))
    dropped = common.settle(exact_groups(docs).where("not kept").select("doc_id"))
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
