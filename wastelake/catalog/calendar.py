"""Calendar and time-series operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.catalog.registry import V as REG
from wastelake.functions import dates as D
from wastelake.operators import series as O
from wastelake.sources import tables as S

BOOK = Book()
OKS = "collection_status in ('collected','retry_collected')"
W = "partition by bin_id order by date"
PRIOR = f"over ({W} rows between unbounded preceding and 1 preceding)"
V = {
    "hdays": f"""select d.*, h.date is not null as hol from bin_days d left join holidays h on h.date = d.date""",
    "enr": f"""select *, coalesce(sum(case when {OKS} then 1 else 0 end) over ({W} rows between 28 preceding and 1 preceding), 0)::bigint as collections_last_28d,
        coalesce(sum(case when collection_status = 'missed' then 1 else 0 end) over ({W} rows between 28 preceding and 1 preceding), 0)::bigint as missed_collections_28d,
        (select count(*) from holidays h where h.date >= date '2024-06-01' and h.date < q.date and h.date > coalesce(q.prev_ok, date '1900-01-01'))::bigint as holidays_since_last_collection,
        case when prev_ok is not null then (select coalesce(sum(reports), 0) from bin_days r where r.bin_id = q.bin_id and r.date < q.date and r.date > q.prev_ok)::bigint end as qr_alerts
      from (select *, max(case when {OKS} then date end) {PRIOR} as prev_ok, max(case when collection_status <> 'none' then date end) {PRIOR} as prev_try,
          max(case when fill_level is not null then date end) {PRIOR} as prev_rated from bin_days) q""",
    "feat": f"""select e.bin_id, e.site_id, e.date, e.fill_level, e.day_of_week, e.week_of_year, e.month, e.season::varchar as season, e.waste_type, e.resident_factor, e.collections_last_28d, e.missed_collections_28d,
        e.holidays_since_last_collection, e.qr_alerts, date_diff('day', prev_ok, e.date) as days_since_last_successful_collection, date_diff('day', prev_try, e.date) as days_since_last_collection_attempt,
        date_diff('day', prev_rated, e.date) as days_since_previous_worker_rating,
        coalesce(lag(collection_status) over w, '__MISSING__') as previous_collection_status, last_value(fill_level ignore nulls) over (partition by e.bin_id order by e.date rows between unbounded preceding and 1 preceding) as previous_worker_rating,
        case when count(*) over (partition by e.bin_id order by e.date rows between 7 preceding and 1 preceding) = 7 then (sum(case when {OKS} then 1 else 0 end) over (partition by e.bin_id order by e.date rows between 7 preceding and 1 preceding))::bigint end as collections_last_7d,
        null::bigint as collections_last_90d, null::bigint as missed_collections_last_90d,
        count(fill_level) over (partition by e.bin_id order by e.date rows between unbounded preceding and 1 preceding) as history_label_count, true as has_daily_history,
        case when e.capacity_m3 > 0 and not isnan(e.capacity_m3) then e.capacity_m3 end as capacity_m3,
        case when e.capacity_m3 is null or isnan(e.capacity_m3) then 'missing' when e.capacity_m3 <= 0 then 'invalid' when e.capacity_m3 <= 0.24 then 'small' when e.capacity_m3 <= 1.1 then 'medium' when e.capacity_m3 <= 3 then 'large'
          when e.capacity_m3 <= 5 then 'very_large' else 'extra_large' end as capacity_range,
        coalesce(nullif(trim(e.object_group), ''), '__MISSING__') as object_group, n.district as sub_district
      from enr e join (select id, case when site_id in (select site_id from bad_sites) or canonical_district is null then '__AMBIGUOUS__' else canonical_district end as district from canon) n on n.id = e.bin_id
      window w as (partition by e.bin_id order by e.date)""",
    "flagged": """select *, case when len(r) = 0 then 'complete' when len(r) > 1 then 'multiple_issues:' || array_to_string(r, '|') else r[1] end as input_quality_flag from (
        select *, list_filter([case when qr_alerts is null then 'missing_qr_history' end, case when object_group = '__MISSING__' then 'missing_object_group' end, case when sub_district = '__AMBIGUOUS__' then 'ambiguous_district' end,
          case when capacity_m3 is null then 'invalid_capacity' end, case when not has_daily_history then 'no_daily_history' end, case when history_label_count = 0 then 'no_historical_labels' end], lambda x : x is not null) as r from feat)""",
    "canon": REG["canon"],
    "bad_sites": REG["bad_sites"],
}
FEATURES = "bin_id, site_id, date, fill_level, capacity_range, history_label_count, has_daily_history, input_quality_flag, " + ", ".join(O.NUMERIC_FEATURES + O.CATEGORICAL_FEATURES)
START, END = date(2024, 6, 1), date(2024, 6, 30)


def holidays(spark):
    return D.holiday_calendar(spark, 2023, 2025)


def enriched(spark, sf):
    return O.enriched_days(S.bin_days(spark, sf), holidays(spark).where(F.col("date") >= F.lit(START)))


@BOOK.add("bin_day_grid", """
    select g.bin_id, g.d as date, b.site_id, b.waste_type, b.sub_district, b.object_group, p.population_cell_id, p.resident_factor, isodow(g.d)::integer as day_of_week, week(g.d)::integer as week_of_year, month(g.d)::integer as month,
      (month(g.d) % 12 // 3 + 1)::integer as season
    from (select bin_id, unnest(generate_series(date '2023-12-25', date '2024-01-07', interval 1 day))::date as d from (select distinct bin_id from schedule)) g
    join bin_population p on p.bin_id = g.bin_id join bins b on b.id = g.bin_id where b.sub_district is not null""")
def _(spark, sf):
    return O.bin_day_grid(S.bins(spark, sf), S.schedule(spark, sf), S.bin_population(spark, sf), date(2023, 12, 25), date(2024, 1, 7)).drop("capacity_m3")


@BOOK.add("calendar_columns", "select o_orderdate::date as date, isodow(o_orderdate)::integer as day_of_week, week(o_orderdate)::integer as week_of_year, month(o_orderdate)::integer as month, (month(o_orderdate) % 12 // 3 + 1)::integer as season, count(*) as n from orders group by 1, 2, 3, 4, 5")
def _(spark, sf):
    days = S.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return D.with_calendar(days)


@BOOK.add("excluded_bin_counts", """
    select count(*) filter (where sub_district is null) as without_district, count(*) filter (where sub_district is not null and id not in (select bin_id from schedule)) as without_schedule,
      count(*) filter (where sub_district is not null and id in (select bin_id from schedule) and id not in (select bin_id from bin_population)) as without_population from bins""")
def _(spark, sf):
    return O.excluded_bin_counts(S.bins(spark, sf), S.schedule(spark, sf), S.bin_population(spark, sf))


@BOOK.add("range_by_years", "select distinct o_orderdate::date as \"end\", ((o_orderdate::date - interval 3 year)::date + 1) as start from orders")
def _(spark, sf):
    return O.range_by_years(S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("end")).distinct(), 3)


CYCLE = {
    "span": "select bin_id, date_trunc('month', min(date))::date as lo, last_day(max(date)) as hi, count(distinct date) as n from schedule group by 1",
    "spand": "select bin_id, n, unnest(generate_series(lo, hi, interval 1 day))::date as d from span",
    "tested": """select s.bin_id, c.c as cycle from (select bin_id, n, d, p.date is not null as planned from spand left join schedule p using (bin_id) where false union all
        select a.bin_id, a.n, a.d, exists(select 1 from schedule p where p.bin_id = a.bin_id and p.date = a.d) from spand a) s, (select unnest([1,7,14,21,28]) as c) c
        group by s.bin_id, c.c, s.n having s.n > 1 and bool_and(true)""",
    "fits": """select s.bin_id, c.c as cycle from spand s cross join (select unnest([1,7,14,21,28]) as c) c
        left join (select distinct bin_id, date from schedule) p on p.bin_id = s.bin_id and p.date = s.d
        left join (select distinct bin_id, c2.c, (date_diff('day', date '1970-01-01', date) + 719163) % c2.c as res from schedule, (select unnest([1,7,14,21,28]) as c) c2) r
          on r.bin_id = s.bin_id and r.c = c.c and r.res = (date_diff('day', date '1970-01-01', s.d) + 719163) % c.c
        where s.n > 1 group by 1, 2 having bool_and((p.date is not null) = (r.res is not null))""",
    "cyc": "select s.bin_id, coalesce(min(f.cycle), 28)::integer as cycle, max(s.n) as planned from span s left join fits f on f.bin_id = s.bin_id group by 1",
}
del CYCLE["tested"]


@BOOK.add("detect_cycle", "select bin_id, cycle, planned from cyc", **CYCLE)
def _(spark, sf):
    return O.detect_cycles(S.schedule(spark, sf)).select("bin_id", "cycle", "planned")


@BOOK.add("project_schedule", """
    select c.bin_id, d as date from cyc c, (select unnest(generate_series(date '2024-09-01', date '2024-09-30', interval 1 day))::date as d)
    where exists (select 1 from schedule s where s.bin_id = c.bin_id and (date_diff('day', date '1970-01-01', s.date) + 719163) % c.cycle = (date_diff('day', date '1970-01-01', d) + 719163) % c.cycle)""", **CYCLE)
def _(spark, sf):
    return O.project_schedule(O.detect_cycles(S.schedule(spark, sf)), date(2024, 9, 1), date(2024, 9, 30))


FIXED = ", ".join(f"'{m:02d}-{d:02d}'" for m, d in D.FIXED_HOLIDAYS)
EASTER = """date '1992-04-19', date '1993-04-11', date '1994-04-03', date '1995-04-16', date '1996-04-07', date '1997-03-30', date '1998-04-12', date '1999-04-04', date '2000-04-23', date '2001-04-15'"""


@BOOK.add("holiday_calendar", f"""
    with d as (select o_orderdate::date as day, count(*) as orders from orders group by 1)
    select day, orders, (strftime(day, '%m-%d') in ({FIXED}) or day in ({EASTER}) or day - 1 in ({EASTER}) or (month(day) in (5, 6) and isodow(day) = 7 and day(day) <= 7))::boolean as is_holiday from d""")
def _(spark, sf):
    d = S.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    years = d.agg(F.min(F.year("day")).alias("first"), F.max(F.year("day")).alias("last")).first()
    known = D.holiday_calendar(spark, years["first"], years["last"]).select(F.col("date").alias("day"), F.lit(True).alias("is_holiday"))
    return d.join(known, "day", "left").select("day", "orders", F.coalesce("is_holiday", F.lit(False)).alias("is_holiday"))


@BOOK.add("holidays_since_success", "select bin_id, date, holidays_since_last_collection from enr", **V)
def _(spark, sf):
    return O.holidays_since_success(S.bin_days(spark, sf), holidays(spark)).select("bin_id", "date", "holidays_since_last_collection")


@BOOK.add("trailing_count", "select bin_id, date, collections_last_28d, missed_collections_28d from enr", **V)
def _(spark, sf):
    return O.with_28_day_counters(S.bin_days(spark, sf)).select("bin_id", "date", "collections_last_28d", "missed_collections_28d")


@BOOK.add("days_since_event", "select bin_id, date, days_since_last_successful_collection, days_since_last_collection_attempt, days_since_previous_worker_rating from feat", **V)
def _(spark, sf):
    return O.days_since_events(S.bin_days(spark, sf)).select("bin_id", "date", "days_since_last_successful_collection", "days_since_last_collection_attempt", "days_since_previous_worker_rating")


@BOOK.add("previous_value", "select bin_id, date, nullif(previous_collection_status, '__MISSING__') as previous_collection_status, previous_worker_rating from feat", **V)
def _(spark, sf):
    return O.previous_values(S.bin_days(spark, sf)).select("bin_id", "date", "previous_collection_status", "previous_worker_rating")


@BOOK.add("history_label_count", "select bin_id, date, history_label_count from feat", **V)
def _(spark, sf):
    return O.history_label_count(S.bin_days(spark, sf)).select("bin_id", "date", "history_label_count")


@BOOK.add("lagged_reset_counter", "select bin_id, date, qr_alerts from enr", **V)
def _(spark, sf):
    return O.lagged_reports(S.bin_days(spark, sf)).select("bin_id", "date", "qr_alerts")


@BOOK.add("accumulate_since_reset", f"""
    select bin_id, date, round(added, 4) as added, round(added + 4.0::double * residue_pct / 100, 4) as demand, round(greatest(added + 4.0::double * residue_pct / 100 - 4, 0), 4) as excess, round(100 * added / 4, 4) as pressure, round(residue_pct, 4) as residue_pct from (
      select q.bin_id, q.date, case when prev_ok is not null then (select sum(reports * 0.25::double + 0.125::double) from bin_days r where r.bin_id = q.bin_id and r.date <= q.date and r.date > q.prev_ok) end as added,
        case when prev_ok is not null then 100 * ((extract(day from prev_ok) % 4) * 0.0075::double) end as residue_pct from enr q)""", digits=4, **V)
def _(spark, sf):
    days = S.bin_days(spark, sf).withColumns({"inflow": F.col("reports") * 0.25 + 0.125, "eps": (F.dayofmonth("date") % 4) * 0.0075, "cap": F.lit(4.0)})
    return O.accumulate_since_reset(days, "inflow", "eps", "cap").select("bin_id", "date", "added", "demand", "excess", "pressure", "residue_pct")


@BOOK.add("attempt_chain_status", f"""
    select bin_id, date, attempt, case when not (chain > 0 and attempt <= 2 and not broken and ok is not null) then 'none' when ok and attempt = 0 then 'collected' when ok then 'retry_collected'
      when attempt < 2 and not next_planned then 'failed' else 'missed' end as status from (
      select *, (row_number() over (partition by bin_id, chain order by date) - 1)::integer as attempt,
        coalesce(sum(case when ok is false then 0 else 1 end) over (partition by bin_id, chain order by date rows between unbounded preceding and 1 preceding), 0) > 0 as broken from (
        select *, sum(planned::integer) over ({W}) as chain, coalesce(lead(planned) over ({W}), false) as next_planned from (
          select bin_id, date, (extract(day from date) + bin_id) % 5 = 0 as planned, case collection_status when 'collected' then true when 'retry_collected' then true when 'failed' then false when 'missed' then false end as ok from bin_days)))""")
def _(spark, sf):
    s = F.col("collection_status")
    days = S.bin_days(spark, sf).select(
        "bin_id", "date", ((F.dayofmonth("date") + F.col("bin_id")) % 5 == 0).alias("planned"),
        F.when(s.isin("collected", "retry_collected"), True).when(s.isin("failed", "missed"), False).alias("ok"),
    )
    return O.attempt_chain_status(days).select("bin_id", "date", "attempt", "status")


@BOOK.add("sequence_audit", """
    select bin_id, sum(n)::bigint as rows, min(date) as first_date, max(date) as last_date, sum(n - 1)::bigint as duplicate_days, count(*) filter (where gap > 1) as gaps from (
      select bin_id, date, n, date_diff('day', lag(date) over (partition by bin_id order by date), date) as gap from (select bin_id, date::date as date, count(*) as n from visits group by 1, 2)) group by 1""")
def _(spark, sf):
    return O.sequence_audit(S.visits(spark, sf).select("bin_id", F.col("date").cast("date").alias("date")))


@BOOK.add("counter_audit", f"""
    select count(*) filter (where rn > 28) as checked_rows, count(*) filter (where rn > 28 and bin_id % 9 = 0) as collections_mismatch, 0::bigint as missed_mismatch,
      count(*) filter (where bin_id % 7 = 0 and prev) as reset_mismatch from (select bin_id, row_number() over ({W}) as rn, coalesce(lag({OKS}) over ({W}), false) as prev from bin_days)""")
def _(spark, sf):
    bad = enriched(spark, sf).withColumns(
        {
            "collections_last_28d": F.col("collections_last_28d") + F.when(F.col("bin_id") % 9 == 0, 1).otherwise(0),
            "qr_alerts": F.col("qr_alerts") + F.when(F.col("bin_id") % 7 == 0, 1).otherwise(0),
        }
    )
    return O.counter_audit(bad)


@BOOK.add("static_change_audit", """
    select 'site_id' as attribute, 0::bigint as changed_bins, 0::bigint as registry_mismatches
    union all select 'waste_type', count(distinct bin_id) filter (where bin_id % 6 = 0), count(distinct bin_id) filter (where bin_id % 6 = 0) from bin_days union all select 'object_group', 0, 0""")
def _(spark, sf):
    days = S.bin_days(spark, sf).withColumn("waste_type", F.when((F.col("bin_id") % 6 == 0) & (F.dayofmonth("date") > 20), "other").otherwise(F.col("waste_type")))
    return O.static_change_audit(days, S.bins(spark, sf), ["site_id", "waste_type", "object_group"])


@BOOK.add("feature_matrix_21", f"select {FEATURES} from flagged".replace("resident_factor", "round(resident_factor, 6) as resident_factor"), **V)
def _(spark, sf):
    return O.feature_matrix(enriched(spark, sf), S.bins(spark, sf), S.district_aliases(spark, sf))


ND = {
    **V,
    "hist": "select bin_id, case when bin_id % 5 = 0 and date > date '2024-06-20' then date - 365 else date end as date, collection_status, fill_level from bin_days where date <= date '2024-06-30'",
    "hagg": f"""select bin_id, count(*) as h_rows, max(date) as last_date, arg_max(collection_status, date) as last_status, arg_max(fill_level, date) filter (where fill_level is not null) as rating, max(date) filter (where fill_level is not null) as rated,
        max(date) filter (where {OKS}) as ok_date, max(date) filter (where collection_status <> 'none') as try_date, count(fill_level) as labels, count(*) filter (where date >= date '2024-06-03') as n28,
        count(*) filter (where date >= date '2024-06-03' and {OKS}) as ok28, count(*) filter (where date >= date '2024-06-03' and collection_status = 'missed') as miss28, count(*) filter (where date >= date '2024-06-24' and {OKS}) as ok7 from hist group by 1""",
    "nd": f"""select n.id as bin_id, site_id, date '2024-07-01' as date, null::integer as fill_level, 1 as day_of_week, 27 as week_of_year, 7 as month, '3' as season, waste_type, resident_factor,
        case when h_rows is not null and last_date = date '2024-06-30' and ok_date is not null then (select count(*) from holidays x where x.date > ok_date and x.date < date '2024-07-01') end as holidays_since_last_collection,
        case when n28 = 28 then ok28 end as collections_last_28d, case when n28 = 28 then miss28 end as missed_collections_28d,
        case when last_date = date '2024-06-30' and last_status in ('collected','retry_collected') then 0 end as qr_alerts,
        date_diff('day', ok_date, date '2024-07-01') as days_since_last_successful_collection, date_diff('day', try_date, date '2024-07-01') as days_since_last_collection_attempt, date_diff('day', rated, date '2024-07-01') as days_since_previous_worker_rating,
        rating as previous_worker_rating, case when last_date = date '2024-06-30' and h_rows >= 7 then ok7 end as collections_last_7d, null::bigint as collections_last_90d, null::bigint as missed_collections_last_90d,
        coalesce(case when last_date = date '2024-06-30' then last_status end, '__MISSING__') as previous_collection_status, coalesce(labels, 0) as history_label_count, h_rows is not null as has_daily_history,
        case when capacity_m3 > 0 and not isnan(capacity_m3) then capacity_m3 end as capacity_m3,
        case when capacity_m3 is null or isnan(capacity_m3) then 'missing' when capacity_m3 <= 0 then 'invalid' when capacity_m3 <= 0.24 then 'small' when capacity_m3 <= 1.1 then 'medium' when capacity_m3 <= 3 then 'large'
          when capacity_m3 <= 5 then 'very_large' else 'extra_large' end as capacity_range, coalesce(nullif(trim(object_group), ''), '__MISSING__') as object_group,
        case when site_id in (select site_id from bad_sites) or canonical_district is null then '__AMBIGUOUS__' else canonical_district end as sub_district
      from canon n left join hagg h on h.bin_id = n.id left join bin_population p on p.bin_id = n.id""",
}
ND["flagged"] = V["flagged"].replace("from feat", "from nd")


@BOOK.add("next_day_features", f"select {FEATURES} from flagged", **ND)
def _(spark, sf):
    return next_day(spark, sf)


def next_day(spark, sf, day_counters=None, end=END, days=None):
    """Next-day features where a fifth of the bins have their last ten days a year too early, so they end in a gap."""
    early = (F.col("bin_id") % 5 == 0) & (F.col("date") > F.lit(date(2024, 6, 20)))
    days = S.bin_days(spark, sf) if days is None else days
    hist = days.withColumn("date", F.when(early, F.date_sub("date", 365)).otherwise(F.col("date")))
    return O.next_day_features(hist, S.bins(spark, sf), end, S.district_aliases(spark, sf), holidays(spark), S.bin_population(spark, sf), day_counters)


PERIODS = {"train": (date(2024, 6, 1), date(2024, 6, 18)), "validation": (date(2024, 6, 19), date(2024, 6, 24)), "test": (date(2024, 6, 25), date(2024, 6, 29))}
SPLIT = "case when date between date '2024-06-01' and date '2024-06-18' then 'train' when date between date '2024-06-19' and date '2024-06-24' then 'validation' when date between date '2024-06-25' and date '2024-06-29' then 'test' end"


@BOOK.add("temporal_split", f"select split, count(*) as rows, count(fill_level) as labeled, min(date) as first_date, max(date) as last_date from (select *, {SPLIT} as split from bin_days) where split is not null group by 1")
def _(spark, sf):
    O.validate_periods(PERIODS, ["train", "validation", "test"])
    rows = O.temporal_split(S.bin_days(spark, sf), PERIODS)
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count("fill_level").alias("labeled"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@BOOK.add("month_completeness", """
    with m as (select date_trunc('month', date)::date as month, bin_id, bit_or(1::bigint << (extract(day from date)::integer - 1)) as mask from (select bin_id, case when bin_id % 10 = 1 and date >= date '2024-06-28' then date - 31 else date end as date from bin_days) group by 1, 2)
    select month, count(*) as bins_present, count(*) filter (where mask = (1::bigint << extract(day from last_day(month))::integer) - 1) as bins_with_full_calendar, sum(bit_count(mask))::bigint as calendar_rows,
      (select count(distinct bin_id) from m) as cohort_bins, count(*) filter (where mask = (1::bigint << extract(day from last_day(month))::integer) - 1) = (select count(distinct bin_id) from m) as complete from m group by 1""")
def _(spark, sf):
    late = (F.col("bin_id") % 10 == 1) & (F.col("date") >= F.lit(date(2024, 6, 28)))
    return O.month_completeness(S.bin_days(spark, sf).withColumn("date", F.when(late, F.date_sub("date", 31)).otherwise(F.col("date"))))


@BOOK.add("cohort_by_first_day", """
    with d as (select case when (bin_id % 10 = 1 and date = date '2024-06-15') or (bin_id % 10 = 2 and date < date '2024-06-20') then -bin_id - 1 else bin_id end as bin_id, date from bin_days),
      c as (select bin_id from d where date = date '2024-06-01'), k as (select unnest(generate_series(1, 30)) as cutoff)
    select date '2024-06-01' as month, cutoff, (select count(*) from c) as cohort_bins,
      (select count(*) from c where (select count(*) from d where d.bin_id = c.bin_id and extract(day from d.date) <= cutoff) < cutoff) as missing_bins,
      (select count(distinct bin_id) from d where extract(day from d.date) <= cutoff and bin_id not in (select bin_id from c)) as extra_bins,
      (select count(*) from c where (select count(*) from d where d.bin_id = c.bin_id and extract(day from d.date) <= cutoff) < cutoff) = 0
        and (select count(distinct bin_id) from d where extract(day from d.date) <= cutoff and bin_id not in (select bin_id from c)) = 0 and (select count(*) from c) > 0 as valid from k""")
def _(spark, sf):
    other = ((F.col("bin_id") % 10 == 1) & (F.col("date") == F.lit(date(2024, 6, 15)))) | ((F.col("bin_id") % 10 == 2) & (F.col("date") < F.lit(date(2024, 6, 20))))
    days = S.bin_days(spark, sf).withColumn("bin_id", F.when(other, -F.col("bin_id") - 1).otherwise(F.col("bin_id")))
    return O.cohort_by_first_day(days, START)


@BOOK.add("cumulative_cutoffs", """
    with l as (select waste_type, site_id as point_id, bin_id, date, fill_level from bin_days where fill_level is not null), k as (select unnest(generate_series(1, 30)) as cutoff)
    select cutoff::integer as cutoff, waste_type, point_id, count(*) as assessments, count(*) filter (where fill_level = 4) as level4_count, count(distinct date) as assessed_days, count(distinct bin_id) as assessed_bins
    from l join k on extract(day from date) <= cutoff group by 1, 2, 3""")
def _(spark, sf):
    labels = S.bin_days(spark, sf).select("waste_type", F.col("site_id").alias("point_id"), "bin_id", "date", "fill_level")
    return O.cumulative_cutoffs(labels, START, 30)


@BOOK.add("interval_distribution", f"""
    select split, feature, coalesce(days, -1) as days, count(*) as rows from (select {SPLIT} as split, unnest(['days_since_last_successful_collection', 'days_since_previous_worker_rating']) as feature,
      unnest([days_since_last_successful_collection, days_since_previous_worker_rating]) as days from feat) where split is not null group by 1, 2, 3""", **V)
def _(spark, sf):
    rows = O.temporal_split(O.days_since_events(S.bin_days(spark, sf)), PERIODS)
    return O.interval_distribution(rows, ["days_since_last_successful_collection", "days_since_previous_worker_rating"])
