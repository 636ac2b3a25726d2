"""References to records that do not exist, and what hangs below them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import materialize


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``table.column`` names ``target.target_key``.

    ``row_key`` identifies the referring row. ``state_column`` and ``loaded_column``
    are those columns of the target, if it has them; ``referrer_loaded`` is when
    the referring row arrived. ``inherit_only`` edges are not checked themselves
    (their key may be missing); they only pass on that the target row is orphaned.
    """

    table: str
    column: str
    row_key: str
    target: str
    target_key: str
    state_column: str | None = None
    loaded_column: str | None = None
    referrer_loaded: str | None = "loaded_at"
    inherit_only: bool = False


SCHEMA = "table_name string, column_name string, row_key string, missing_key string, reason string, period string, kind string, depth int"


def _target(tables: dict[str, DataFrame], ref: Reference, n: int) -> DataFrame:
    """One row per key: whether it is deleted, and when it first arrived."""
    t = tables[ref.target]
    gone = F.max(F.coalesce(F.col(ref.state_column) == "deleted", F.lit(False))) if ref.state_column else F.lit(False)
    first = F.min(ref.loaded_column) if ref.loaded_column else F.lit(None).cast("timestamp_ntz")
    return (
        t.where(F.col(ref.target_key).isNotNull())
        .groupBy(F.col(ref.target_key).alias(f"__t{n}"))
        .agg(F.lit(True).alias(f"__there{n}"), gone.alias(f"__gone{n}"), first.alias(f"__first{n}"))
    )


def direct_orphans(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """Broken references of every referring table, each table scanned once.

    A target is first reduced to one row per key (combined before the shuffle);
    whether it is broadcast is left to the planner, which knows its size. Only
    the broken references are made distinct.
    """
    found = None
    refs = [r for r in refs if not r.inherit_only]
    for name in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == name]
        keys = list(dict.fromkeys(r.row_key for r in own))
        rows = tables[name].select(
            *[F.col(k).alias(f"__row{i}") for i, k in enumerate(keys)],
            *[F.col(r.column).alias(f"__c{n}") for n, r in enumerate(own)],
            (F.col(own[0].referrer_loaded) if own[0].referrer_loaded else F.lit(None).cast("timestamp_ntz")).alias("__at"),
        )
        cases = []
        for n, r in enumerate(own):
            rows = rows.join(_target(tables, r, n), F.col(f"__c{n}") == F.col(f"__t{n}"), "left")
            reason = (
                F.when(F.col(f"__c{n}").isNull(), None)
                .when(F.col(f"__there{n}").isNull(), "missing")
                .when(F.col(f"__gone{n}"), "deleted")
                .when(F.col(f"__first{n}") > F.col("__at"), "late")
            )
            key = F.col(f"__row{keys.index(r.row_key)}").cast("string")
            cases.append(F.struct(F.lit(r.column).alias("column_name"), key.alias("row_key"), F.col(f"__c{n}").cast("string").alias("missing_key"), reason.alias("reason")))
        part = (
            rows.select(F.lit(name).alias("table_name"), F.coalesce(F.date_format("__at", "yyyy-MM"), F.lit("")).alias("period"), F.inline(F.filter(F.array(*cases), lambda c: c["reason"].isNotNull())))
            .where("row_key is not null")
            .distinct()
        )
        found = part if found is None else found.unionByName(part)
    return found.select("table_name", "column_name", "row_key", "missing_key", "reason", "period", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))


def orphan_references(tables: dict[str, DataFrame], refs: list[Reference], cascade: bool = True) -> DataFrame:
    """Direct orphans, and with ``cascade`` the rows that inherit being orphaned.

    A row is inherited when it refers to a row that is itself orphaned, at any
    depth: the frontier of newly orphaned rows is semi-joined down the graph of
    references until it is empty. Reference graphs in which no referring table is
    itself a target need no step at all, and the result stays lazy. Otherwise the
    found rows are written to the shared folder after each step, which also ends
    cycles: a row is entered once.

    A null reference is none; a row without a row key is not reported; empty
    tables give no rows (an empty target makes every reference missing).
    """
    spark = next(iter(tables.values())).sparkSession
    direct = direct_orphans(tables, refs)
    referring = {r.table for r in refs}
    edges = [r for r in refs if r.target in referring and any(p.table == r.target and p.row_key == r.target_key for p in refs)]
    if not cascade or not edges:
        return direct
    found = materialize(direct, "orphans")
    # late arrivals exist by now: they are reported, but nothing below them is lost
    frontier = found.where("reason <> 'late'").select("table_name", "row_key").distinct()
    seen, depth = frontier, 0
    while True:
        depth += 1
        parts = []
        for r in edges:
            up = frontier.where(F.col("table_name") == r.target).select(F.col("row_key").alias("__up"))
            at = F.date_format(r.referrer_loaded, "yyyy-MM") if r.referrer_loaded else F.lit(None).cast("string")
            child = tables[r.table].select(F.col(r.row_key).cast("string").alias("row_key"), F.col(r.column).cast("string").alias("missing_key"), F.coalesce(at, F.lit("")).alias("period"))
            parts.append(
                child.where("row_key is not null")
                .join(up, F.col("missing_key") == F.col("__up"), "left_semi")
                .select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), "row_key", "missing_key", F.lit("inherited").alias("reason"), "period", F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"))
                .distinct()
            )
        step = parts[0]
        for p in parts[1:]:
            step = step.unionByName(p)
        step = materialize(step.join(seen, ["table_name", "row_key"], "left_anti").select(*direct.columns), "orphans")
        if step.isEmpty():
            return found
        found = found.unionByName(step)
        frontier = step.select("table_name", "row_key").distinct()
        seen = seen.unionByName(frontier)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, column, period, reason and kind."""
    return orphans.groupBy("table_name", "column_name", "period", "reason", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("row_key").alias("n_rows"))
