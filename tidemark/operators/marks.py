"""First-seen rows per key: the keyed state machines of the jobs in one operator.

A row of a key is *first* under one of four resets, in event-time order (ties by ``by`` and ``carry``):

* ``window``: no earlier row of the key in the same window;
* ``day``: no earlier row of the key on the same calendar day;
* ``idle``: no earlier row, or the latest earlier row is at least ``ttl`` old;
* ``day_or_idle``: either of the last two.

Rows are read once, whatever is counted: each is spread to one role per mark and one for plain sums, and one
aggregate, combined on the map side, makes *cells* of them, by role, key and time slot. Within a slot only the earliest
row can be first.
A slot of the idle resets is as wide as the ``ttl``, so only rows of the slot before can be near enough to matter: if asked
to look ``ahead``, in a table each row also leaves its time in the cell of the next slot (``_before``), and the same aggregate decides.
An idle mark alone has its rows dealt once, by key and a chunk of slots, and compared there.

Elsewhere a cell is compared with the cell before it inside a chunk (a day, or sixteen slots); only the last slot of a chunk can
matter to the next one, and is carried there. So no window holds more than the slots of a chunk, however long a key lives and
however many rows it has.

On a stream the cells of a window are complete when it closes. Earlier cells then come as ``seen``, from the state
that ``Memory`` keeps, and count like any others but are not given out again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import names
from tidemark.functions import clock

RESETS = ("window", "day", "idle", "day_or_idle")
_DAY_US = clock.duration_us("1 day")
#: Slots of a chunk, at least: one in as many is carried to the next chunk.
CHUNK_SLOTS = 16
#: Slots of a chunk of rows, as few as keep a hot key spread: one in as many is sent twice.
NEAR_SLOTS = 64
#: State of marks: the time of the last row of a key.
SEEN = "role int, key string, last timestamp"


@dataclass(frozen=True)
class Mark:
    """Rows that are first for ``keys``: their number as ``name``, and the sums of ``carry``, numbers of those rows.

    ``returned`` names one more count: rows of the ``day`` reset whose key was last there ``return_days`` or more
    days before. ``retention`` bounds how long a stream remembers a key for it.
    """

    name: str | None
    keys: tuple[str, ...]
    reset: str = "day"
    ttl: str | None = None
    carry: tuple[str, ...] = ()
    returned: str | None = None
    return_days: int = 0
    retention: str | None = None

    def __post_init__(self):
        if self.reset not in RESETS:
            raise ValueError(f"unknown reset {self.reset!r}")
        if (self.ttl is None) != (self.reset in ("window", "day")):
            raise ValueError("ttl goes with the idle resets and only with them")
        if self.returned and self.reset != "day":
            raise ValueError("returning keys need the day reset")

    @property
    def ttl_us(self) -> int:
        return clock.duration_us(self.ttl)

    @property
    def idle(self) -> bool:
        return self.ttl is not None

    @property
    def chunk_us(self) -> int:
        """Width of a chunk: a whole number of slots, ``CHUNK_SLOTS`` or about a day of them."""
        return self.ttl_us * max(CHUNK_SLOTS, _DAY_US // self.ttl_us)


class Memory(Protocol):
    """State between the micro-batches of a stream."""

    def seen(self, name: str, cells: DataFrame, marks: Sequence[Mark]) -> DataFrame:
        """Earlier cells of the keys of ``cells``, whose own are remembered under the same name; empty at the start."""

    def latest(self, name: str, schema: str, keys: Sequence[str]) -> DataFrame | None:
        """The rows last remembered under a name, one per key; none at the start."""

    def remember(self, name: str, schema: str, keys: Sequence[str], rows: DataFrame) -> None:
        """Keep rows, one per key, for the micro-batches to come."""


def _by_role(marks: Sequence[Mark], value, otherwise: Column) -> Column:
    """``value`` of the mark of each role; ``otherwise`` where that is None, and for plain sums."""
    out = None
    for i, mark in enumerate(marks, 1):
        own = value(mark)
        if own is not None:
            out = F.when(F.col("role") == i, own) if out is None else out.when(F.col("role") == i, own)
    return otherwise if out is None else out.otherwise(otherwise)


def _slotted(rows: DataFrame, time: str, marks: Sequence[Mark], size: str) -> DataFrame:
    """Add ``_slot``, in which only the earliest row of a key can be first, and ``_day`` if a mark asks for both."""
    at = F.col(time)
    window = clock.slot(at, clock.duration_us(size))
    slot = _by_role(marks, lambda m: clock.slot(at, m.ttl_us) if m.idle else clock.day_number(at).cast("bigint") if m.reset == "day" else None, window)
    day = _by_role(marks, lambda m: clock.day_number(at) if m.reset == "day_or_idle" else None, F.lit(0))
    return rows.withColumns({"_slot": slot, **({"_day": day} if _days(marks) else {})})


def _days(marks: Sequence[Mark]) -> list[str]:
    return ["_day"] if any(m.reset == "day_or_idle" for m in marks) else []


def _carried(marks: Sequence[Mark], by: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(c for m in marks for c in m.carry if c not in by))


def _key(columns: Sequence[str]) -> Column:
    text = [F.col(c).cast("string") for c in columns]
    return text[0] if len(text) == 1 else F.to_json(F.array(*text)) if text else F.lit(None).cast("string")


def mark_cells(df: DataFrame, marks: Sequence[Mark], by: Sequence[str] = (), sums: Mapping[str, Column] | None = None,
               size: str = names.WINDOW, ahead: bool = False) -> DataFrame:
    """Cells of rows with event time ``rt``, for ``firsts`` and ``count_marks``: one scan and one aggregate.

    ``sums`` are measures of all rows, ``by`` the columns that results are grouped by. On a stream the cells
    of a window come out when it closes. Without ``by`` and carried columns a cell is numbers, and Spark
    aggregates by hash. With ``ahead``, in a table, cells of marks that need no more than the slot before have
    ``_before``, the time of the last row there; a cell with nothing but that has no ``first``. Cells of an idle mark alone,
    without sums, are single rows then.
    """
    sums, carried = sums or {}, _carried(marks, by)
    if ahead and not df.isStreaming and not sums and [m.reset for m in marks] == ["idle"]:
        return _row_cells(df, marks[0], [*by, *carried])
    types = {c: df.schema[c].dataType for c in carried}
    ahead = ahead and not df.isStreaming and any(m.idle for m in marks) and not any(m.returned for m in marks)

    def role(number: int, keys: Sequence[str], carry: Sequence[str], values: bool, later: int = 0) -> Column:
        return F.struct(F.lit(number).alias("role"), _key(keys).alias("key"), *([F.lit(later).cast("bigint").alias("_later")] if ahead else []),
                        *[(F.col(c) if c in carry else F.lit(None).cast(types[c])).alias(c) for c in carried],
                        *[(column if values else F.when(F.lit(False), column)).alias(f"_sum_{name}") for name, column in sums.items()])

    roles = [role(0, by, (), True)] if sums else []
    roles += [role(i, m.keys, m.carry, False) for i, m in enumerate(marks, 1)]
    roles += [role(i, m.keys, (), False, m.ttl_us) for i, m in enumerate(marks, 1) if ahead and m.idle]
    rows = df.select("rt", *by, F.explode(F.array(*roles)).alias("_r")).select("rt", *by, "_r.*")
    timely = [F.window("rt", size).alias("window")] if df.isStreaming else []
    own = [*by, *carried]
    slotted, here = _slotted(rows, "rt", marks, size), lambda value: value
    if ahead:
        slotted, here = slotted.withColumn("_slot", F.col("_slot") + F.col("_later")), lambda value: F.when(F.col("_later") == 0, value)
    first = F.min(here(F.struct(F.col("rt").alias("at"), *own) if own else F.col("rt")))
    before = [F.max(F.when(F.col("_later") > 0, F.col("rt"))).alias("_before")] if ahead else []
    cells = slotted.groupBy(*timely, "key", "role", "_slot", *_days(marks)).agg(
        first.alias("first"), F.max(here(F.col("rt"))).alias("last"), *before, *[F.sum(f"_sum_{m}").alias(f"_sum_{m}") for m in sums]).drop("window")
    return cells if own else cells.withColumn("first", F.struct(F.col("first").alias("at")))


def _row_cells(df: DataFrame, mark: Mark, own: Sequence[str]) -> DataFrame:
    """Cells of one row each with the time of the row before as ``_before``, for an idle mark alone.

    A row is shuffled once, by key and chunk of slots; only one of a chunk's last slot also goes to the next chunk, for its time.
    """
    slot, width = clock.slot(F.col("rt"), mark.ttl_us), mark.ttl_us * NEAR_SLOTS
    later = F.when(F.pmod(slot + mark.ttl_us, F.lit(width)) == 0, F.array(F.lit(0), F.lit(mark.ttl_us))).otherwise(F.array(F.lit(0)))
    seen = slot + F.col("_later")
    chunk = seen - F.pmod(seen, F.lit(width))
    columns = dict.fromkeys(["rt", *mark.keys, *own])
    rows = df.select(*columns, F.explode(later).alias("_later")).repartition(chunk, *mark.keys).withColumn("_chunk", chunk)
    before = F.lag("rt").over(Window.partitionBy("_chunk", *mark.keys).orderBy("rt", *own))
    return rows.withColumn("_before", before).where(F.col("_later") == 0).select(
        _key(mark.keys).alias("key"), F.lit(1).alias("role"), slot.alias("_slot"), F.struct(F.col("rt").alias("at"), *own).alias("first"),
        F.col("rt").alias("last"), "_before")


def firsts(cells: DataFrame, marks: Sequence[Mark], by: Sequence[str] = (), seen: DataFrame | None = None, size: str = names.WINDOW) -> DataFrame:
    """First rows of ``cells``: ``role`` (from 1), ``at``, ``by`` and the carried columns, ``away`` (days since the day
    before), and for role 0 the sums of ``by`` and window.

    The cells of a micro-batch are those of its windows, so a slot wider than a window has several: they are merged
    with each other and with what was ``seen``.
    """
    own, sums = [*by, *_carried(marks, by)], [c for c in cells.columns if c.startswith("_sum_")]
    ahead = "_before" in cells.columns
    if ahead and seen is not None:  # of the slot before, what was seen is known too: compare as on a stream
        cells, ahead = cells.where("first.at IS NOT NULL").drop("_before"), False
    slots, first = cells, F.col("first.at").isNotNull() if ahead else F.lit(True)
    if seen is not None:
        none = F.lit(None).cast(cells.schema["first"].dataType).alias("first")
        old = _slotted(seen, "last", marks, size).select("key", "role", "_slot", *_days(marks), none, "last", *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in sums])
        both = cells.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
        slots = both.groupBy("key", "role", "_slot", *_days(marks)).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.max("_old").alias("_old"), *[F.sum(c).alias(c) for c in sums])
        first = ~F.col("_old")
    away = F.lit(None).cast("bigint")
    gap = F.unix_micros("first.at") - F.unix_micros("_before")
    late = _by_role(marks, lambda m: F.col("_before").isNull() | (gap >= m.ttl_us) if m.idle else None, F.lit(True))
    if ahead:
        first = first & late
    elif any(m.idle or m.returned for m in marks):
        slot = F.col("_slot")
        chunk = _by_role(marks, lambda m: slot - F.pmod(slot, F.lit(m.chunk_us)) if m.idle else F.lit(0) if m.returned else None, slot)
        following = _by_role(marks, lambda m: F.when(F.pmod(slot + m.ttl_us, F.lit(m.chunk_us)) == 0, slot + m.ttl_us) if m.idle else None, F.lit(None).cast("bigint"))
        chunks = F.when(following.isNull(), F.array(chunk)).otherwise(F.array(chunk, following))
        placed = slots.select("*", F.posexplode(chunks).alias("_copy", "_chunk"))
        before = Window.partitionBy("key", "role", "_chunk", *_days(marks)).orderBy("_slot")
        slots = placed.withColumns({"_before": F.lag("last").over(before), "_before_slot": F.lag("_slot").over(before)})
        first = first & late & (F.col("_copy") == 0)
        away = _by_role(marks, lambda m: slot - F.col("_before_slot") if m.returned else None, away)
    return slots.where(first).select("role", F.col("first.at").alias("at"), *[F.col(f"first.{c}").alias(c) for c in own], away.alias("away"), *sums)


def count_marks(cells: DataFrame, marks: Sequence[Mark], by: Sequence[str] = (), size: str = names.WINDOW, memory: Memory | None = None,
                name: str = "marks") -> DataFrame:
    """Window results: ``window``, ``by``, the sums of the cells, and what each mark counts; nothing counts as zero.

    In a micro-batch the cells are compared with those that ``memory`` has under ``name``, and remembered there.
    """
    rows = firsts(cells, marks, by, memory.seen(name, cells, marks) if memory else None, size)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    out = [F.coalesce(F.sum(c), F.lit(0)).alias(c.removeprefix("_sum_")) for c in rows.columns if c.startswith("_sum_")]
    for i, mark in enumerate(marks, 1):
        here = F.col("role") == i
        if mark.name:
            out.append(F.sum(F.when(here, one).otherwise(zero)).alias(mark.name))
        out += [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).alias(c) for c in mark.carry]
        if mark.returned:
            out.append(F.sum(F.when(here & (F.col("away") >= mark.return_days), one).otherwise(zero)).alias(mark.returned))
    return rows.groupBy(F.window("at", size).alias("window"), *by).agg(*out)


def last_seen(cells: DataFrame, marks: Sequence[Mark]) -> DataFrame:
    """What has to be remembered of cells: the last time of each key, combined on the map side."""
    lasting = [i for i, m in enumerate(marks, 1) if m.reset != "window"]
    return cells.where(F.col("role").isin(lasting)).groupBy("role", "key").agg(F.max("last").alias("last"))


def still_matters(marks: Sequence[Mark], low: Column) -> Column:
    """Whether a remembered key can matter to rows at ``low`` or later."""
    last = F.col("last")

    def until(mark: Mark) -> Column:
        if mark.idle:
            return F.unix_micros(low) - F.unix_micros(last) < mark.ttl_us
        if not mark.returned:
            return F.to_date(last) >= F.to_date(low)
        return F.unix_micros(low) - F.unix_micros(last) < clock.duration_us(mark.retention) if mark.retention else F.lit(True)

    return _by_role(marks, until, F.lit(False))


def first_rows(df: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), reset: str = "day", ttl: str | None = None,
               previous_day: bool = False) -> DataFrame:
    """First rows of a table (event time ``rt``): columns ``rt``, ``at`` (the same), ``keys``, ``carry``.

    ``previous_day`` adds ``day`` and ``previous_day`` (day numbers), the latter being the day of the key's
    first row before this one; it needs ``reset="day"``.
    """
    mark = Mark(None, tuple(keys), reset, ttl, (*keys, *carry), "returned" if previous_day else None)
    rows = firsts(mark_cells(df, [mark]), [mark])
    day = clock.day_number(F.col("at"))
    extra = [day.alias("day"), (day - F.col("away")).cast("int").alias("previous_day")] if previous_day else []
    return rows.select(F.col("at").alias("rt"), "at", *keys, *carry, *extra)
