"""Shards of near equal bytes by histogram sort, in DataFrame operations alone.

Rows are sorted by a pair of keys: the hash of their group, then one of the
row. The boundaries between shards are found without sorting: bytes below
candidate boundaries are counted exactly over all partitions, the candidates
draw closer around each wanted boundary, and when all are within the
tolerance the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assethealth.llm.shared import written

#: Candidate boundaries that a wanted one is looked for between, in each round.
PROBES = 32
#: Share of a shard's fair bytes that a boundary may be off without cutting a group of equal texts.
TOLERANCE = 0.005
#: Keys are smaller than this.
TOP = 1 << 62


@dataclass(frozen=True)
class Range:
    """Where boundaries are looked for: groups with ``low <= h1 <= high``, or, ``group`` given, rows of that group with ``low <= h2 <= high``.

    ``below`` bytes come before it.
    """

    group: int | None
    low: int
    high: int
    below: int

    @property
    def step(self) -> int:
        return (self.high - self.low) // PROBES + 1

    @property
    def place(self) -> tuple[int, int]:
        return (self.group, self.low) if self.group is not None else (self.low, -1)


def _tree(leaves: list[str], tests: list[str]) -> str:
    """An expression that picks one of ``leaves`` by halving: ``tests[i]`` says whether a row comes before leaf i."""
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return f"IF({tests[half]}, {_tree(leaves[:half], tests[:half])}, {_tree(leaves[half:], tests[half:])})"


def _cell(i: int, r: Range) -> str:
    """Number of the cell, of PROBES a range, that a row of range ``i`` is in; null outside of it."""
    key, also = ("h2", f"h1 = {r.group}L AND ") if r.group is not None else ("h1", "")
    return f"IF({also}{key} BETWEEN {r.low}L AND {r.high}L, {i * PROBES} + CAST(({key} - {r.low}L) div {r.step}L AS INT), NULL)"


def _before(place: tuple[int, int]) -> str:
    h1, h2 = place
    return f"h1 < {h1}L" if h2 <= 0 else f"(h1 < {h1}L OR h1 = {h1}L AND h2 < {h2}L)"


def boundaries(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` pairs (h1, h2), ascending: a shard begins with the first row at or after its pair.

    ``keyed`` has ``h1, h2, size``. Each round is one pass that adds up bytes
    by cell where the rows are; PROBES numbers a boundary reach the driver.
    A boundary within the tolerance between two groups is taken; where one
    group alone spans it, it is looked for among that group's rows. A round
    divides the range by PROBES at least, so 26 rounds end any search.
    """
    ends = keyed.agg(F.sum("size"), F.min("h1"), F.max("h1")).first()
    if ends[0] is None:
        return []
    total, slack = ends[0], ends[0] * tolerance / shards
    wanted = [total * k / shards for k in range(1, shards)]
    open_at = {k: Range(None, ends[1], ends[2], 0) for k in range(len(wanted))}
    found: dict[int, tuple[int, int]] = {}
    while open_at:
        ranges = sorted(set(open_at.values()), key=lambda r: r.place)
        cell = F.expr(_tree([_cell(i, r) for i, r in enumerate(ranges)], [_before(r.place) for r in ranges]))
        rows = keyed.select(cell.alias("cell"), "h1", "h2", "size").where("cell IS NOT NULL").groupBy("cell")
        got = rows.agg(*[F.sum("size").alias("bytes"), F.min("h1"), F.max("h1"), F.min("h2"), F.max("h2")]).collect()
        cells = {i: sorted(tuple(x) for x in got if x[0] // PROBES == i) for i in range(len(ranges))}
        for k, r in list(open_at.items()):
            found_or_next = _closer(r, cells[ranges.index(r)], wanted[k], slack)
            if isinstance(found_or_next, Range):
                open_at[k] = found_or_next
            else:
                found[k] = found_or_next
                del open_at[k]
    return sorted(found.values())


def _closer(r: Range, cells: list[tuple[int, ...]], wanted: float, slack: float) -> tuple[int, int] | Range:
    """The boundary, if an end of the cell around ``wanted`` will do, or else the range of that cell's rows."""
    below = r.below
    inside = r.group is not None
    for _, size, least1, most1, least2, most2 in cells:
        if below + size < wanted:
            below += size
            continue
        first, last = (r.group, least2) if inside else (least1, 0), (r.group, most2 + 1) if inside else (most1 + 1, 0)
        off = [(wanted - below, first), (below + size - wanted, last)]
        nearest = min(off)
        single = least2 == most2 if inside else least1 == most1
        if nearest[0] <= slack or (single and (inside or least2 == most2)):
            return nearest[1]
        if single:
            return Range(least1, least2, most2, below)
        return Range(r.group, least2, most2, below) if inside else Range(None, least1, most1, below)
    return (TOP, 0)


def with_keys(docs: DataFrame, size: Column, group: Column, row_id: Column, columns: list[Column]) -> DataFrame:
    """``size, h1, h2, row``: keys of the row's group and of itself, and ``columns`` in a struct.

    Rows of one group go by their id's hash; rows with one id are told apart by
    where they stand in the input, so not even equal rows share both keys.
    """
    top = lambda c, bits: F.shiftrightunsigned(c, 64 - bits)
    where = top(F.xxhash64(F.monotonically_increasing_id()), 22)
    own = F.shiftleft(top(F.xxhash64(row_id), 40), 22).bitwiseOR(where)
    return docs.select(size.cast("long").alias("size"), top(F.xxhash64(group), 62).alias("h1"), own.alias("h2"), F.struct(*columns).alias("row"))


def by_bytes(docs: DataFrame, shards: int, size: Column, group: Column, row_id: Column, columns: list[Column], tolerance: float = TOLERANCE) -> DataFrame:
    """``columns`` of all rows with ``size, shard, slot``: shards of near equal size, numbered from 0 by key, slots without a gap from 0.

    A boundary is off by ``tolerance`` of a fair share at most, or by half of
    the one row it stands in. Rows of one ``group`` stand next to one another,
    and in one shard unless a boundary has no place beside them within the
    tolerance, so a group of any share of the rows is spread over as many
    shards as it fills. Shards may stay empty where there are fewer rows than
    shards. Nulls are hashed like other values. An empty table gives none.

    The rows are written with their keys once and read narrow in each round;
    they travel whole in one exchange, by ranges of all keys, so a shard is
    the work of many tasks. Slots are where a row stands in its task's sorted
    output plus the rows of its shard in the tasks before; a table of a row a
    task and shard brings those.
    """
    keyed = written(with_keys(docs, size, group, row_id, columns), "keyed")
    cuts = boundaries(keyed.select("h1", "h2", "size"), shards, tolerance)
    cuts = cuts + [(TOP, 1)] * (shards - 1 - len(cuts))
    shard = F.expr(_tree([str(i) for i in range(shards)], ["", *map(_before, cuts)]))
    ordered = keyed.withColumn("shard", shard).repartitionByRange("shard", "h1", "h2").sortWithinPartitions("shard", "h1", "h2")
    place = F.monotonically_increasing_id()
    ordered = written(ordered.select("size", "shard", "row", place.alias("place"), F.spark_partition_id().alias("task")), "sharded")
    tasks = ordered.groupBy("shard", "task").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("shard", "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    placed = ordered.join(F.broadcast(offsets), ["shard", "task"])  # a row a task, and one more for each shard
    return placed.select("row.*", "size", "shard", (F.col("place") + F.col("offset")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, columns: list[Column] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``columns`` of all documents (all of ``docs``, if not given) with ``size, shard, slot``, by bytes of text plus 16.

    Groups are equal texts, null as empty. Columns named as these three give
    way to them. Repeated rows and doc_ids each have their own slot.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    given = columns if columns is not None else [F.col(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    return by_bytes(docs, shards, F.octet_length(body).cast("long") + 16, body, F.col("doc_id"), given, tolerance)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> DataFrame:
    """All documents written as Parquet below ``path``, a folder a shard, each task's rows in order; read back."""
    spark: SparkSession = docs.sparkSession
    shard_documents(docs, shards).write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path)
