"""Series made from the test tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import Series, fill_gaps

S = Series(keys=("key",), ts="ds", value="y")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, by type (only hours that have any)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.date_trunc("hour", "ts").alias("ds"))
    return e.groupBy("key", "ds").agg(F.count(F.lit(1)).cast("double").alias("y"))


HOURLY = "select event_type as key, date_trunc('hour', ts) as ds, cast(count(*) as double) as y from events group by 1, 2"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long, irregular series; the values of errors are missing."""
    return table(spark, sf_dir, "events").select(F.lit("all").alias("key"), F.col("ts").alias("ds"), F.when(F.col("event_type") != "error", F.col("value")).alias("y"))


TICKS = "select 'all' as key, ts as ds, case when event_type <> 'error' then value end as y from events"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`hourly`, with every sixth hour's value missing."""
    return hourly(spark, sf_dir).withColumn("y", F.when(F.hour("ds") % 6 != 0, F.col("y")))


GAPPY = f"select key, ds, case when hour(ds) % 6 <> 0 then y end as y from ({HOURLY}) h"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue a day, by order priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.date_trunc("day", "o_orderdate").alias("ds"), "o_totalprice")
    return o.groupBy("key", "ds").agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


DAILY = "select o_orderpriority as key, date_trunc('day', o_orderdate)::timestamp as ds, round(sum(o_totalprice), 2) as y from orders group by 1, 2"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue a month in thousands, by order priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.date_trunc("month", "o_orderdate").alias("ds"), "o_totalprice")
    return o.groupBy("key", "ds").agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("y"))


MONTHLY = "select o_orderpriority as key, date_trunc('month', o_orderdate)::timestamp as ds, round(sum(o_totalprice), 2) / 1000 as y from orders group by 1, 2"


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each order in thousands, with month, region and nation of its customer."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    o = table(spark, sf_dir, "orders").join(c, F.expr("o_custkey = c_custkey"))
    return o.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.date_trunc("month", "o_orderdate").alias("ds"), (F.col("o_totalprice") / 1000).alias("y"))


BY_NATION = ("select r_name as region, n_name as nation, date_trunc('month', o_orderdate)::timestamp as ds, o_totalprice / 1000 as y from orders join customer on o_custkey = c_custkey "
             "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")


def wavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, zeros filled in, on top of a wave of 24 hours as strong as the mean and a half."""
    h = fill_gaps(hourly(spark, sf_dir), S, "1h").withColumn("y", F.coalesce("y", F.lit(0.0)))
    mean = F.avg("y").over(Window.partitionBy("key"))
    return h.withColumn("y", F.round(F.col("y") + 1.5 * mean * F.sin(2 * F.pi() * F.hour("ds") / 24), 6))


WAVY = (f"with b as ({HOURLY}), g as (select key, unnest(generate_series(min(ds), max(ds), interval 1 hour)) as ds from b group by key), f as (select g.key, g.ds, coalesce(y, 0.0e0) as y from g left join b on b.key = g.key and b.ds = g.ds) "
        "select key, ds, round(y + 1.5e0 * avg(y) over (partition by key) * sin(2 * pi() * hour(ds) / 24), 6) as y from f")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units a month of all parts, zeros filled in: intermittent."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.date_trunc("month", "l_shipdate").alias("ds"), "l_quantity")
    # one exchange, by key: a month brings the empty ones up to the next, so no grid is joined
    sums = li.repartition("key").groupBy("key", "ds").agg(F.sum("l_quantity").alias("y"))
    ends = table(spark, sf_dir, "lineitem").agg(F.date_trunc("month", F.min("l_shipdate")).alias("a"), F.date_trunc("month", F.max("l_shipdate")).alias("b"))
    w = Window.partitionBy("key").orderBy("ds")
    months = sums.select("key", "ds", "y", F.lead("ds").over(w).alias("later"), (F.row_number().over(w) == 1).alias("first")).crossJoin(F.broadcast(ends))
    months = months.select("key", "y", F.col("ds").alias("own"), F.expr("case when first then a else ds end as low"), F.expr("coalesce(later - interval 1 month, b) as high"))
    grid = months.select("key", "y", "own", F.explode(F.expr("case when low <= high then sequence(low, high, interval 1 month) end")).alias("ds"))
    return grid.select("key", "ds", F.expr("case when ds = own and key is not null then coalesce(y, 0.0D) else 0.0D end as y"))


DEMAND = """select k.key, g.ds, coalesce(s.y, 0.0) as y from (select distinct cast(l_partkey as varchar) as key from lineitem) k
    cross join (select unnest(generate_series(a, b, interval 1 month)) as ds from (select date_trunc('month', min(l_shipdate))::timestamp as a, date_trunc('month', max(l_shipdate))::timestamp as b from lineitem) e) g
    left join (select cast(l_partkey as varchar) as key, date_trunc('month', l_shipdate)::timestamp as ds, sum(l_quantity) as y from lineitem group by 1, 2) s on s.key = k.key and s.ds = g.ds"""


def prepared(base: str) -> str:
    """DuckDB SQL for the prepared frame over a series' SQL."""
    return f"select key, ds, y, row_number() over (partition by key order by ds) - 1 as i, count(*) over (partition by key) as n from ({base}) b"


def shown(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """The columns, doubles rounded (and never minus zero), times as epoch seconds ``t``."""
    out = []
    for c in cols:
        kind = dict(df.dtypes)[c]
        if kind == "double":
            out.append((F.round(c, digits) + 0.0).alias(c))
        elif kind in ("timestamp", "timestamp_ntz"):
            out.append(F.unix_timestamp(F.col(c).cast("timestamp")).alias("t" if c == "ds" else c))
        else:
            out.append(F.col(c))
    return df.select(*out)
