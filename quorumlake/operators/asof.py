"""Attributes as known at the time of an event.

Three forms of the as-of join:

* :func:`asof_left_bucketed` hash-partitions the entities and runs an embedded
  DuckDB ``ASOF LEFT JOIN`` in every bucket.
* :func:`asof_left` is a plain window over the union of both sides, for keys of
  which none holds a large part of the rows.
* :func:`asof_left_history` joins events to the short history of their entity; it
  needs no sort and no even keys, and the analytical model uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def current_versions(versions: DataFrame, key: str, since: str, order: list[Column]) -> DataFrame:
    """One version per (key, since): ties are resolved here, before any join, by
    the first row in ``order``. Rows with a null key or time take no part."""
    rank = Window.partitionBy(key, since).orderBy(*order)
    return versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def asof_left_bucketed(events: DataFrame, versions: DataFrame, key: str, at: str, since: str, buckets: int | None = None, load: DataFrame | None = None) -> DataFrame:
    """``events`` with the columns of the version in force: the latest of the same
    ``key`` with ``since`` <= ``at``; nulls where there is none.

    ``versions`` must hold one row per (key, since): see :func:`current_versions`.
    Its columns other than ``key`` must not clash with those of ``events``.

    Entities are hashed to buckets. An entity with more events than an even share
    of a bucket is hot: its events are spread over as many salts as shares it
    holds, its versions are repeated to each salt, and nothing is dropped. Inside
    a partition the versions of a bucket arrive first and are loaded into DuckDB,
    then its events stream through in Arrow batches, so memory holds the versions
    of a bucket and one batch, however many events there are. Events with a null
    key or time keep null attributes.

    Hot entities are found by counting keys in ``events``; ``load``, rows with the
    same column ``key``, may stand in for them where events are costly to compute:
    a skewed count only makes the buckets less even, never the result wrong.
    """
    spark = events.sparkSession
    n = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    carried = [f for f in versions.schema.fields if f.name != key]
    schema = StructType([*events.schema.fields, *[StructField(f.name, f.dataType, True) for f in carried]])

    # at most n keys can hold more than 1/n of the rows: a bound on what is broadcast
    counts = (events if load is None else load).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * n > F.col("__all")).select("__hot", F.ceil(F.col("__n") * n / F.col("__all")).cast("int").alias("__salts"))
    hot = F.broadcast(hot)

    def bucket(salt: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), salt), F.lit(n)).cast("int")

    ev = events.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*events.columns), F.col("__salts")).cast("int")).otherwise(0))
    ve = versions.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
    left = ev.select(bucket(F.col("__salt")).alias("__bucket"), F.lit(1).alias("__side"), F.struct(*events.columns).alias("__e"), F.lit(None).cast(versions.schema).alias("__v"))
    right = ve.select(bucket(F.col("__salt")).alias("__bucket"), F.lit(0).alias("__side"), F.lit(None).cast(events.schema).alias("__e"), F.struct(*versions.columns).alias("__v"))
    both = left.unionByName(right).repartition(n, "__bucket").sortWithinPartitions("__bucket", "__side")

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    picked = ", ".join([f'e."{c}"' for c in events.columns] + [f'v."{f.name}"' for f in carried])
    query = f'select {picked} from e asof left join v on e."{key}" = v."{key}" and e."{at}" >= v."{since}"'
    missing = [(f.name, wanted.field(f.name).type) for f in carried]

    def run(batches):
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        def fields(held):  # a struct column as a table
            return pa.Table.from_arrays([held], ["x"]).flatten().rename_columns([f.name for f in held.type])

        db = duckdb.connect(":memory:", config={"threads": 1})
        here, known, ready = None, None, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = table.column("__bucket")
            for b in pc.unique(marks).to_pylist():
                part = table.filter(pc.equal(marks, b))
                if b != here:
                    here, known, ready = b, None, False
                is_event = pc.equal(part.column("__side"), 1)
                new, asked = part.filter(pc.invert(is_event)).column("__v"), part.filter(is_event).column("__e")
                if len(new):
                    rows = fields(new)
                    known, ready = rows if known is None else pa.concat_tables([known, rows]), False
                if not len(asked):
                    continue
                found = fields(asked)
                if known is None:
                    for name, kind in missing:
                        found = found.append_column(name, pa.nulls(len(found), kind))
                else:
                    if not ready:
                        db.register("arrived", known)
                        db.execute("create or replace table v as select * from arrived").fetchall()
                        db.unregister("arrived")
                        ready = True
                    db.register("e", found)
                    found = db.sql(query).to_arrow_table()
                    db.unregister("e")
                yield from found.cast(wanted).to_batches()

    return both.mapInArrow(run, schema)


def asof_left(events: DataFrame, versions: DataFrame, key: str, at: str, since: str, carry: list[str]) -> DataFrame:
    """As-of join by one shuffle: both sides in one ordered window per key, versions
    first on equal times; a struct is carried, so a version with null attributes
    still counts as found. Versions must be unique per (key, since)."""
    right = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("__key"), F.col(since).alias("__t"), F.lit(0).alias("__side"), F.struct(*carry).alias("__v"), F.lit(None).cast(events.schema).alias("__e")
    )
    left = events.select(F.col(key).alias("__key"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema["__v"].dataType).alias("__v"), F.struct(*events.columns).alias("__e"))
    order = Window.partitionBy("__key").orderBy(F.col("__t").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__t").isNotNull() & F.col("__key").isNotNull(), F.last("__v", ignorenulls=True).over(order))
    return left.unionByName(right).withColumn("__seen", seen).where("__side = 1").select("__e.*", *[F.col(f"__seen.{c}").alias(c) for c in carry])


def asof_left_history(events: DataFrame, versions: DataFrame, key: str, at: str, since: str, carry: list[str], longest: int = 10_000) -> DataFrame:
    """As-of join against short histories: the versions of an entity become one sorted
    array, events are joined to it by key (broadcast or not, as sizes have it; a hot
    key is split by adaptive execution), and the last version not after the event is
    picked in place. A history of more than ``longest`` versions is an error: use
    :func:`asof_left_bucketed`. Versions must be unique per (key, since)."""
    v = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    held = F.array_sort(F.collect_list(F.struct(F.col(since).alias("since"), F.struct(*carry).alias("v"))))
    history = v.groupBy(F.col(key).alias("__key")).agg(held.alias("__h"))
    history = history.withColumn("__h", F.when(F.size("__h") <= longest, F.col("__h")).otherwise(F.raise_error(F.lit("a history is too long"))))
    known = events.join(history, F.col(key) == F.col("__key"), "left")
    found = F.get(F.reverse(F.filter("__h", lambda x: x["since"] <= F.col(at))), F.lit(0))
    return known.withColumn("__f", found).select(*events.columns, *[F.col(f"__f.v.{c}").alias(c) for c in carry])
