"""Configuration-driven routing of the change log to dimensions and facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import names
from tidemark.functions import documents
from tidemark.operators.latest import latest_by_key

DIM = "dim"
FACT = "dwd"
#: A configuration of so many routes is sent to every task; a larger one, as of many versions, is joined by a shuffle.
SENT_ROUTES = 100_000


@dataclass(frozen=True)
class Routed:
    """``dims`` and ``facts`` carry ``sink_table`` and the pruned ``data``; ``unrouted`` matched nothing."""

    dims: DataFrame
    facts: DataFrame
    unrouted: DataFrame


#: One change of a route, as ``route_entries`` gives it.
ENTRY = ("kind string, route_table string, route_type string, sink_table string, sink_columns string, sink_pk string, "
         "sink_extend string, deleted boolean, at bigint")
_ROUTE = ["kind", "route_table", "route_type"]
_LAST = ["at", "deleted", "sink_table", "sink_columns", "sink_pk", "sink_extend"]


def route_entries(feed: DataFrame) -> DataFrame:
    """Changes of routes from the change feed of the configuration.

    A dimension routes by table alone, a fact by table and change type.
    """
    deleted = F.col("op") == "d"
    entry = F.when(deleted, F.col("before")).otherwise(F.col("after"))
    return feed.select(entry.alias("_c"), deleted.alias("deleted"), F.coalesce("ts_ms", F.lit(0)).alias("at")).select(
        F.when(F.col("_c.sink_type") == DIM, DIM).otherwise(FACT).alias("kind"),
        F.col("_c.source_table").alias("route_table"),
        F.when(F.col("_c.sink_type") == DIM, "").otherwise(F.col("_c.source_type")).alias("route_type"),
        F.col("_c.sink_table").alias("sink_table"), F.col("_c.sink_columns").alias("sink_columns"),
        F.coalesce("_c.sink_pk", F.lit("id")).alias("sink_pk"),
        F.coalesce("_c.sink_extend", F.lit("")).alias("sink_extend"), "deleted", "at",
    )


def fold_config(feed: DataFrame) -> DataFrame:
    """Current routing from its change feed: the last entry per route, without deleted routes."""
    return latest_by_key(route_entries(feed), _ROUTE, _LAST).filter(~F.col("deleted")).drop("deleted", "at")


def routes_over_time(entries: DataFrame) -> DataFrame:
    """Routes with the time they hold: from ``valid_from`` to before ``valid_to`` (milliseconds; null: still).

    Of entries of one route at one time the last one counts. A route that was read from the table at the start (time 0)
    holds from the beginning. One window per route: it holds the changes of one line of the configuration.
    """
    once = latest_by_key(entries, [*_ROUTE, "at"], _LAST[1:])
    until = F.lead("at").over(Window.partitionBy(*_ROUTE).orderBy("at"))
    timed = once.withColumns({"valid_from": F.when(F.col("at") > 0, F.col("at")), "valid_to": until})
    return timed.filter(~F.col("deleted")).drop("deleted", "at")


def _holds(config: DataFrame) -> Column:
    """Whether a route holds at the time of a change, if routes have times."""
    if "valid_to" not in config.columns:
        return F.lit(True)
    at, low, high = F.col("ts") * 1000, F.col("valid_from"), F.col("valid_to")
    return (low.isNull() | (at >= low)) & (high.isNull() | (at < high))


def _few(config: DataFrame) -> bool:
    return config.limit(SENT_ROUTES + 1).count() <= SENT_ROUTES


def keep_columns(data: Column, columns: Column) -> Column:
    """The map ``data`` reduced to the keys listed in comma-separated ``columns``."""
    wanted = F.split(columns, ",")
    return F.map_filter(data, lambda key, _: F.array_contains(wanted, key))


def route(changes: DataFrame, config: DataFrame) -> Routed:
    """Send each change to its dimension, its fact, both, or neither.

    ``config`` is the routing as it is now (``fold_config``), or over time (``routes_over_time``): then a change is
    routed as of its ``ts``, so that a replay after a change of the configuration gives what was given before.

    Both branches prune the original ``data``. Facts keep the types of its values; dimensions hold text, as
    their columns are text. Changes name few tables, so a shuffle by table would gather most of them in a few tasks:
    a configuration that was counted and is small is broadcast, and changes stay where they are.
    """
    sent = F.broadcast if _few(config) else lambda part: part
    dim_config = config.filter(F.col("kind") == DIM).drop("kind", "route_type")
    fact_config = config.filter(F.col("kind") == FACT).drop("kind")
    dim_rows = changes.filter(F.col("type").isin(*names.DIM_CHANGE_TYPES))
    same_table = (F.col("table") == F.col("route_table")) & _holds(config)
    same_change = same_table & (F.col("type") == F.col("route_type"))
    times = [c for c in ("valid_from", "valid_to") if c in config.columns]

    text = F.try_variant_get("data", "$", "map<string,string>")
    tagged = ["sink_table", "table", "type", "ts", "xid"]
    dims = dim_rows.join(sent(dim_config), same_table, "inner").select(
        *tagged, text[F.col("sink_pk")].alias("pk"), keep_columns(text, F.col("sink_columns")).alias("data"))
    facts = changes.join(sent(fact_config), same_change, "inner").select(
        *tagged, keep_columns(documents.fields_of(F.col("data")), F.col("sink_columns")).alias("data"))

    dim_change = F.col("type").isin(*names.DIM_CHANGE_TYPES)
    unrouted = (
        changes.join(sent(dim_config.select("route_table", *times)), same_table & dim_change, "left_anti")
        .join(sent(fact_config.select("route_table", "route_type", *times)), same_change, "left_anti")
    )
    return Routed(dims, facts, unrouted)


def topic_records(facts: DataFrame) -> DataFrame:
    """Records whose topic is named by the row: ``topic`` and the pruned data as JSON ``value``."""
    return facts.select(F.col("sink_table").alias("topic"), F.to_json("data").alias("value"))
