"""Streaming forms of the append logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.sources import tables as S
from wastelake.streaming import logs as O

BOOK = Book()


def events(spark, sf):
    """The event log, one file or a folder of files, as a file stream with the shifted clock."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("bin_id"), (F.col("ts") + F.expr(f"interval {S.SHIFT_DAYS} days")).cast("timestamp_ntz").alias("date"), "event_type")


def drained(spark, stream, name):
    out, checkpoint = O.scratch(spark, name)
    O.run_available(stream, out, checkpoint)
    return spark.read.parquet(out)


@BOOK.add("stream_validate_fk", "select event_id as id, user_id as bin_id from ev where event_type in ('click','signup') and user_id in (select id from bins where id % 4 <> 0)")
def _(spark, sf):
    requests = events(spark, sf).where(F.col("event_type").isin("click", "signup"))
    known = S.bins(spark, sf).where(F.col("id") % 4 != 0)
    return drained(spark, O.accept_known(requests, known).select("id", "bin_id"), "stream-fk")


@BOOK.add("stream_dedup_attempts", "select distinct bin_id, date, was_serviced from visits")
def _(spark, sf):
    attempts = events(spark, sf).where(F.col("event_type").isin("view", "purchase", "error")).select("bin_id", "date", (F.col("event_type") != "error").alias("was_serviced"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return drained(spark, O.dedup_attempts(attempts).select("bin_id", "date", "was_serviced"), "stream-dedup")


@BOOK.add("stream_trend", "select ets::date as day, count(*) as events from ev group by 1 having ets::date + 1 <= (select max(ets) - interval 1 day from ev)".replace("group by 1 having ets::date", "group by ets::date having ets::date"))
def _(spark, sf):
    return drained(spark, O.daily_trend(events(spark, sf), "date"), "stream-trend")


@BOOK.add("stream_requests_since_success", """
    select u.bin_id, s.okat as latest_success, case when s.okat is not null then (select count(*) from requests r where r.bin_id = u.bin_id and r."timestamp" > s.okat) end as submissions_since_success,
      (select count(*) from requests r where r.bin_id = u.bin_id) as total_submissions
    from (select distinct user_id as bin_id from ev where event_type <> 'error') u left join (select bin_id, max(date) as okat from visits where was_serviced group by 1) s on s.bin_id = u.bin_id""")
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "signup"), "request").when(F.col("event_type").isin("view", "purchase"), "success")
    stream = events(spark, sf).select("bin_id", F.col("date").alias("at"), kind.alias("kind")).where(F.col("kind").isNotNull())
    out, checkpoint = O.scratch(spark, "stream-since")
    return O.run_since_success(stream, out, checkpoint)
