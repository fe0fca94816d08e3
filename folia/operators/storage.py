"""Which store a published file goes to, and which files go in one commit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.sources.written import written

#: Stores of a year that are tried; what fits none of them goes to the next one, whatever its size.
BINS = 50


def plan_storage(files: DataFrame, used: DataFrame, year: int, limit: int, prefix: str = "store") -> DataFrame:
    """(site, doc_id, store, path): the store of each file to be published, in the order of `place`.

    files: (site, place, doc_id, bytes, format, store): `store` is where an edition of the file lies, or null.
    used: (site, store, bytes): what other files, and editable ones, take. A file stays in a store of `year`
    that has room for it, else it goes to the year's first store with room, and to number BINS + 1 if none has.

    First fit depends on every file before, so a site's files pass one task in order; of each only the size and
    the store are read, and the state is a tree of the room left in BINS + 1 stores beside the other stores
    that files lie in, however many files there are.
    """
    own = used.groupBy("site", "store").agg(F.sum("bytes").cast("long").alias("bytes"))
    taken = own.select("site", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("doc_id"), "bytes", "store")
    rows = files.select("site", F.col("place").cast("long").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "store")
    stays = f"^.*_{year}_\\d+$"
    rows = rows.withColumn("store", F.when(F.col("store").rlike(stays), F.col("store"))).unionByName(taken)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, stores = None, _Stores(f"{prefix}_{year}_", limit)
        for p in parts:
            out: list[tuple] = []
            for s, place, doc, size, store in zip(p["site"], p["place"], p["doc_id"], p["bytes"].tolist(), p["store"]):
                if s != site:
                    site, stores = s, _Stores(f"{prefix}_{year}_", limit)
                if pd.isna(place):
                    stores.add(store, size)
                else:
                    at = store if isinstance(store, str) and stores.fits(store, size) else stores.first(size)
                    stores.add(at, size)
                    out.append((s, doc, at))
            yield pd.DataFrame(out, columns=["site", "doc_id", "store"]).astype({"doc_id": "Int64"})

    order = [F.col("site"), F.asc_nulls_first("place"), F.col("doc_id")]
    placed = rows.repartition("site").sortWithinPartitions(*order).mapInPandas(run, "site string, doc_id long, store string")
    path = F.concat(F.lit("files/"), F.col("doc_id").cast("string"), F.lit("."), F.col("format"))
    return placed.join(files.select("site", "doc_id", "format"), ["site", "doc_id"]).select("site", "doc_id", "store", path.alias("path"))


class _Stores:
    """Bytes used by name, and the room left in the numbered stores as a tree of maxima."""

    def __init__(self, prefix: str, limit: int):
        self.prefix, self.limit, self.used = prefix, limit, {}
        self.leaves = 1 << (BINS - 1).bit_length()
        self.room = [-1] * (2 * self.leaves)
        for n in range(BINS):
            self._set(n, limit)

    def _set(self, n: int, room: int) -> None:
        at = self.leaves + n
        self.room[at] = room
        while at > 1:
            at //= 2
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])

    def fits(self, store: str, size: int) -> bool:
        return self.used.get(store, 0) + size <= self.limit

    def add(self, store: str, size: int) -> None:
        self.used[store] = self.used.get(store, 0) + size
        n = store.removeprefix(self.prefix)
        if n != store and n.isdigit() and str(int(n)) == n and 1 <= int(n) <= BINS:
            self._set(int(n) - 1, self.limit - self.used[store])

    def first(self, size: int) -> str:
        if self.room[1] < size:
            return f"{self.prefix}{BINS + 1}"
        at = 1
        while at < self.leaves:
            at = 2 * at if self.room[2 * at] >= size else 2 * at + 1
        return f"{self.prefix}{at - self.leaves + 1}"


# ---- batches --------------------------------------------------------------------------------------


def _ends(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each row and behind the last, for each row the row behind the batch that begins there, or 0)."""
    sums = np.append(0, np.cumsum(sizes))
    to = np.searchsorted(sums[1:], sums[:-1] + limit) + 1
    return sums, np.where(to <= len(sizes), to, 0)


def _jumps(sizes: np.ndarray, limit: int) -> pd.DataFrame:
    """What a range does to a batch that is open at its beginning: for held >= at, (held, batches closed) at its end."""
    sums, to = _ends(sizes, limit)
    n = len(sizes)
    held, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        held[i], closed[i] = (held[to[i]], closed[to[i]] + 1) if to[i] else (sums[n] - sums[i], 0)
    # with much held the first row closes the batch, with less a later one, with little none does
    first = np.flatnonzero(np.append(True, np.diff(sums[1:]) > 0))
    at = np.append(limit - sums[1:][first], -1)[::-1]
    out = np.append(np.column_stack([held[first + 1], closed[first + 1] + 1]), [[-1, 0]], axis=0)[::-1]
    live = np.append(at[1:] > 0, True)  # of thresholds at or below 0 the last one holds
    at, out = np.maximum(at[live], 0), out[live]
    new = np.append(True, (out[1:] != out[:-1]).any(axis=1))
    return pd.DataFrame({"at": at[new], "held": out[new, 0], "closed": out[new, 1], "total": sums[n]})


def batches(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """`rows` with `batch`, from 0: in a group's order a batch is closed by the row that brings it to `limit`.

    The sum starts anew behind each batch, so it is no window. Rows are dealt into ranges of (group, order); a
    range says how many batches it closes, and what it leaves open, for anything that may be open at its
    beginning. These tables, which have a few rows where batches soon fall into step, are followed in the
    order of ranges, and then each range is numbered on its own. No task holds a group's rows.
    """
    dealt = written(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "dealt")
    small = dealt.select(group, "_range", order, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))

    def tell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return _jumps(part["_size"].to_numpy(), limit).assign(_group=part[group].iloc[0], _range=part["_range"].iloc[0])

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        held = number = 0
        out = []
        for r, own in part.sort_values(["_range", "at"]).groupby("_range"):
            out.append((own["_group"].iloc[0], r, held, number))
            row = own.iloc[int(np.searchsorted(own["at"].to_numpy(), held, "right")) - 1]
            held, number = (held + int(row["total"]), number) if row["held"] < 0 else (int(row["held"]), number + int(row["closed"]))
        return pd.DataFrame(out, columns=["_group", "_range", "_held", "_number"])

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        sums, to = _ends(part["_size"].to_numpy(), limit)
        closed = np.zeros(len(part) + 1, np.int64)
        at = int(np.searchsorted(sums[1:], limit - part["_held"].iloc[0])) + 1
        while 0 < at <= len(part):
            closed[at] += 1
            at = int(to[at]) if at < len(part) else 0
        return part[own].assign(batch=part["_number"].iloc[0] + np.cumsum(closed)[:-1])

    kind = rows.schema[group].dataType.simpleString()
    own = rows.columns
    told = small.groupBy(group, "_range").applyInPandas(tell, f"at long, held long, closed long, total long, _group {kind}, _range int")
    begun = told.groupBy("_group").applyInPandas(follow, f"_group {kind}, _range int, _held long, _number long").withColumnRenamed("_group", group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch long"
    joined = dealt.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).join(begun, [group, "_range"])
    return joined.groupBy(group, "_range").applyInPandas(label, schema)
