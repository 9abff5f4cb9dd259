"""Model data, training and evaluation."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wastelake.catalog import calendar as CC
from wastelake.catalog.book import Book
from wastelake.catalog.registry import V as REG
from wastelake.catalog.views import u
from wastelake.functions import hashing as H
from wastelake.operators import registry as R, series as SE
from wastelake.operators.model import calibration as CA, metrics as M, profile as P, sampling as SA, training as T
from wastelake.session import materialize
from wastelake.sources import tables as S

BOOK = Book()
PRI = u("sample", "bin_id::varchar || ':' || date::varchar")
LAB = {
    "lab": f"select bin_id, date, fill_level, waste_type, object_group, site_id, {PRI} as priority from bin_days where fill_level is not null",
    "firsts": """select bin_id, date from (select *, row_number() over (partition by date, fill_level order by priority) as a, row_number() over (partition by waste_type, object_group, fill_level order by priority) as b from lab) where a = 1 or b = 1""",
}


def labeled(spark, sf):
    return S.bin_days(spark, sf).where(F.col("fill_level").isNotNull()).select("bin_id", "date", "fill_level", "waste_type", "object_group", "site_id")


@BOOK.add("bottom_k_hash_sample", "select bin_id, date, fill_level from lab order by priority, bin_id, date limit 200", **LAB)
def _(spark, sf):
    return SA.bottom_k(labeled(spark, sf), 200).select("bin_id", "date", "fill_level")


@BOOK.add("stratified_min_hash", "select l.bin_id, l.date, l.fill_level, f.bin_id is not null as mandatory from lab l left join firsts f on f.bin_id = l.bin_id and f.date = l.date order by f.bin_id is not null desc, priority, l.bin_id, l.date limit 400", **LAB)
def _(spark, sf):
    rows = SA.stratified_bottom_k(labeled(spark, sf), 400, [["date", "fill_level"], ["waste_type", "object_group", "fill_level"]])
    return rows.select("bin_id", "date", "fill_level", "mandatory")


POOL = u("pool", "site_id::varchar || ':' || waste_type")
POOLS = {
    **REG,
    "pb": f"""select id, site_id, waste_type, object_group, canonical_district as district, capacity_m3, resident_factor as exposure, {POOL} as rank from reasoned where capacity_m3 > 0 and not isnan(capacity_m3) and resident_factor is not null""",
    "labels4": "select rank, site_id, waste_type, unnest(['type:' || coalesce(object_group, ''), 'waste:' || waste_type, 'district:' || coalesce(district, ''), 'zero:' || (exposure = 0)::varchar]) as label from pb",
    "chosen": """select site_id, waste_type from (select distinct rank, site_id, waste_type from pb order by rank, site_id, waste_type limit 40)
        union select site_id, waste_type from (select *, row_number() over (partition by label order by rank, site_id, waste_type) as rn from labels4) where rn = 1
        union select site_id, waste_type from (select * from pb order by exposure / capacity_m3 desc, id limit 5)""",
}


@BOOK.add("pool_sample", "select id, site_id, waste_type from pb where (site_id, waste_type) in (select site_id, waste_type from chosen)", **POOLS)
def _(spark, sf):
    bins = R.population_join(S.bins(spark, sf), S.bin_population(spark, sf))
    named = R.canonical_districts(bins, S.district_aliases(spark, sf))
    usable = named.where((F.col("capacity_m3") > 0) & ~F.isnan("capacity_m3") & F.col("resident_factor").isNotNull())
    rows = usable.select("id", "site_id", "waste_type", "object_group", F.col("canonical_district").alias("district"), F.col("resident_factor").alias("exposure"), "capacity_m3")
    return SA.pool_sample(rows, 40).select("id", "site_id", "waste_type")


@BOOK.add("site_holdout", f"""
    select bin_id, date, site_id in (select site_id from (select distinct site_id from lab) order by {u('holdout', 'site_id')}, site_id limit greatest(1, (select floor(count(distinct site_id) * 0.2) from lab)::integer)) as held_out from lab""", **LAB)
def _(spark, sf):
    return SA.site_holdout(labeled(spark, sf), 0.2).select("bin_id", "date", "held_out")


# --- evaluation ---

SCORED = {
    "sc": "select *, (list_position(probabilities, list_max(probabilities)) - 1)::integer as p, probabilities[4] + probabilities[5] as urgent, fill_level as y, -ln(least(greatest(probabilities[fill_level + 1], 2.220446049250313e-16), 1.0)) as loss from scores",
    "mat": "select a.y, b.p, (select count(*) from sc where sc.y = a.y and sc.p = b.p) as n from (select unnest([0,1,2,3,4]) as y) a, (select unnest([0,1,2,3,4]) as p) b",
    "cls": """select k as class, case when pr > 0 then tp / pr else 0 end as precision, case when su > 0 then tp / su else 0 end as recall, su, pr from (
        select k, (select sum(n) from mat where y = k and p = k)::double as tp, (select sum(n) from mat where y = k)::double as su, (select sum(n) from mat where p = k)::double as pr from (select unnest([0,1,2,3,4]) as k))""",
    "clf": "select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from cls",
}


def cells(spark, sf, threshold=0.5):
    return M.counts(S.scores(spark, sf), threshold=threshold)


@BOOK.add("score_class_probs", "select row_id, p as predicted_fill_level, round(urgent, 6) as needs_collection_probability, urgent >= 0.5 as needs_collection from sc", **SCORED)
def _(spark, sf):
    return M.scored(S.scores(spark, sf), 0.5).select("row_id", "predicted_fill_level", "needs_collection_probability", "needs_collection")


@BOOK.add("probability_audit", "select count(*) as rows, 0::bigint as wrong_length, count(*) filter (where row_id % 10 = 3) as out_of_range, count(*) filter (where row_id % 10 = 3) as sum_not_one from scores")
def _(spark, sf):
    bad = F.when(F.col("row_id") % 10 == 3, F.transform("probabilities", lambda p, i: F.when(i == 0, -1.0).otherwise(p))).otherwise(F.col("probabilities"))
    return M.probability_audit(S.scores(spark, sf).withColumn("probabilities", bad))


@BOOK.add("confusion_matrix", "select y, p, n, round(case when s > 0 then n::double / s else 0 end, 6) as share from (select *, (sum(n) over (partition by y)) as s from mat)", **SCORED)
def _(spark, sf):
    return M.confusion_matrix(cells(spark, sf))


@BOOK.add("class_metrics", "select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, su::bigint as support, pr::bigint as predicted from clf", **SCORED)
def _(spark, sf):
    return M.class_metrics(cells(spark, sf))


@BOOK.add("class_summary", """select sum(su)::bigint as rows, round(avg(f1), 6) as macro_f1, round(sum(f1 * su) / sum(su), 6) as weighted_f1, round(avg(case when su > 0 then recall end), 6) as balanced_accuracy,
    round((select count(*) from sc where y = p)::double / sum(su), 6) as accuracy from clf""", **SCORED)
def _(spark, sf):
    return M.class_summary(cells(spark, sf))


@BOOK.add("ordinal_metrics", """
    select round(sum(n * abs(y - p))::double / sum(n), 6) as mean_absolute_class_error, round(sum(case when abs(y - p) >= 2 then n else 0 end)::double / sum(n), 6) as severe_error_rate,
      round(1 - sum(n * (y - p) * (y - p))::double / (select sum(a.su * b.pr * (a.class - b.class) * (a.class - b.class)) / (select sum(n) from mat) from cls a, cls b), 6) as quadratic_weighted_kappa from mat""", **SCORED)
def _(spark, sf):
    return M.ordinal_metrics(cells(spark, sf))


@BOOK.add("log_loss", "select round(avg(loss), 6) as log_loss, count(*) as rows from sc", **SCORED)
def _(spark, sf):
    return M.log_loss(cells(spark, sf))


RATES = "round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(case when tp > 0 then 2 * (tp / (tp + fp)::double) * (tp / (tp + fn)::double) / (tp / (tp + fp)::double + tp / (tp + fn)::double) else 0 end, 6) as f1"
BIN = {**SCORED, "bt": "select count(*) filter (where y >= 3 and urgent >= 0.5) as tp, count(*) filter (where y < 3 and urgent >= 0.5) as fp, count(*) filter (where y >= 3 and urgent < 0.5) as fn, count(*) filter (where y < 3 and urgent < 0.5) as tn from sc"}


@BOOK.add("binary_metrics", f"select tp, fp, fn, tn, {RATES} from bt", **BIN)
def _(spark, sf):
    return M.binary_metrics(cells(spark, sf))


CURVE = {
    **SCORED,
    "curve": f"""select threshold, tp, fp, fn, tn, coalesce(case when tp + fp > 0 then {RATES.split(' as precision')[0]} end, 0) as precision, round(tp / (tp + fn)::double, 6) as recall,
        {RATES.split('as recall, ')[1]} from (select t as threshold, count(*) filter (where y >= 3 and urgent >= t) as tp, count(*) filter (where y < 3 and urgent >= t) as fp, count(*) filter (where y >= 3 and urgent < t) as fn, count(*) filter (where y < 3 and urgent < t) as tn
        from sc, (select unnest([{', '.join(f'{t}::double' for t in M.THRESHOLDS)}]) as t) group by 1)""",
}


@BOOK.add("threshold_curve", "select * from curve", **CURVE)
def _(spark, sf):
    return M.threshold_curve(S.scores(spark, sf))


@BOOK.add("best_threshold", "select * from curve order by f1 desc, abs(threshold - 0.5), threshold limit 1", **CURVE)
def _(spark, sf):
    return M.best_threshold(M.threshold_curve(S.scores(spark, sf)))


@BOOK.add("group_metrics", """
    with l as (select unnest(['date', 'waste_type', 'capacity_range', 'input_quality_flag']) as "group", unnest([date::varchar, waste_type, capacity_range, input_quality_flag]) as value, y, p, loss, urgent >= 0.5 as flag from sc),
      g as (select "group", value, count(*) as rows, avg((y = p)::integer) as accuracy, avg(abs(y - p)) as mae, avg((abs(y - p) >= 2)::integer) as sev, avg(loss) as ll, sum((y - p) * (y - p))::double as e2,
        count(*) filter (where y >= 3 and flag) as tp, count(*) filter (where flag) as fl, count(*) filter (where y >= 3) as yes from l group by 1, 2),
      c as (select "group", value, k, count(*) filter (where y = k and p = k)::double as tp, count(*) filter (where y = k)::double as su, count(*) filter (where p = k)::double as pr from l, (select unnest([0,1,2,3,4]) as k) group by 1, 2, 3),
      f as (select *, case when su > 0 then tp / su else 0 end as rec, case when tp > 0 then 2 * (tp / pr) * (tp / su) / (tp / pr + tp / su) else 0 end as f1 from c),
      e as (select a."group", a.value, sum(a.su * b.pr * (a.k - b.k) * (a.k - b.k)) as ex from c a join c b on a."group" = b."group" and a.value = b.value group by 1, 2)
    select g."group", g.value, g.rows, round(avg(f.f1), 6) as macro_f1, round(sum(f.f1 * f.su) / g.rows, 6) as weighted_f1, round(avg(case when f.su > 0 then f.rec end), 6) as balanced_accuracy, round(g.accuracy, 6) as accuracy,
      round(g.mae, 6) as mean_absolute_class_error, round(g.sev, 6) as severe_error_rate, round(1 - g.e2 / (max(e.ex) / g.rows), 6) as quadratic_weighted_kappa, round(g.ll, 6) as log_loss,
      round(case when g.tp > 0 then 2 * (g.tp / g.fl::double) * (g.tp / g.yes::double) / (g.tp / g.fl::double + g.tp / g.yes::double) else 0 end, 6) as needs_collection_f1
    from g join f on f."group" = g."group" and f.value = g.value join e on e."group" = g."group" and e.value = g.value group by g."group", g.value, g.rows, g.accuracy, g.mae, g.sev, g.ll, g.e2, g.tp, g.fl, g.yes""", **SCORED)
def _(spark, sf):
    return M.group_metrics(S.scores(spark, sf), threshold=0.5)


BASE = {
    "med": "select waste_type, capacity_range, quantile_cont(fill_level, 0.5) as m from scores where date < date '2024-06-20' group by 1, 2",
    "prior": "select fill_level, count(*)::double / (select count(*) from scores where date < date '2024-06-20') as s from scores where date < date '2024-06-20' group by 1",
    "cum": "select a.fill_level, sum(b.s) as c from prior a join prior b on b.fill_level <= a.fill_level group by 1",
    "maj": "select fill_level as majority from prior order by s desc, fill_level limit 1",
}


@BOOK.add("group_median_baseline", "select waste_type, capacity_range, m as group_median from med", **BASE)
def _(spark, sf):
    return M.group_medians(S.scores(spark, sf).where(F.col("date") < "2024-06-20"), ["waste_type", "capacity_range"])


def baselines(spark, sf):
    s = S.scores(spark, sf)
    train, later = s.where(F.col("date") < "2024-06-20"), s.where(F.col("date") >= "2024-06-20")
    later = later.withColumn("previous_worker_rating", F.when(F.col("row_id") % 4 != 0, (F.col("row_id") % 5).cast("int")))
    return M.baseline_predictions(later, train, H.uniform("draw", F.col("row_id")), ["waste_type", "capacity_range"])


@BOOK.add("majority_stratified_baseline", f"""
    select row_id, (select majority from maj) as dummy_most_frequent, least((select count(*) from cum where round(c, 12) < round(draw, 12)), 4)::integer as dummy_stratified, floor(m + 0.5)::integer as training_group_median
    from (select *, {u('draw', 'row_id')} as draw from scores where date >= date '2024-06-20') s left join med on med.waste_type = s.waste_type and med.capacity_range = s.capacity_range""", **BASE)
def _(spark, sf):
    return baselines(spark, sf).select("row_id", "dummy_most_frequent", "dummy_stratified", "training_group_median")


@BOOK.add("previous_rating_baseline", "select row_id, case when row_id % 4 <> 0 then (row_id % 5)::integer else (select majority from maj) end as previous_rating from scores where date >= date '2024-06-20'", **BASE)
def _(spark, sf):
    return baselines(spark, sf).select("row_id", "previous_rating")


@BOOK.add("model_choice", "select 'model_' || capacity_range as model, 0.5::double as threshold, round(avg((y = p)::integer), 6) as f1 from sc group by 1 order by avg((y = p)::integer) desc, model desc limit 1", **SCORED)
def _(spark, sf):
    per = M.scored(S.scores(spark, sf)).groupBy(F.concat(F.lit("model_"), F.col("capacity_range")).alias("model")).agg(F.avg((F.col("fill_level") == F.col("predicted_fill_level")).cast("double")).alias("f1"))
    return M.model_choice(per.withColumn("threshold", F.lit(0.5)))


@BOOK.add("prediction_audit", "select 0::bigint as repeated_keys, count(*) filter (where row_id % 50 = 7) as missing_keys, count(*) filter (where row_id % 50 <> 7 and row_id % 9 = 0) as argmax_mismatch, round(avg((y = case when row_id % 9 = 0 then (p + 1) % 5 else p end)::integer) filter (where row_id % 50 <> 7), 6) as accuracy, false as score_matches from sc", **SCORED)
def _(spark, sf):
    s = M.scored(S.scores(spark, sf).withColumn("bin_id", F.col("row_id")))
    s = s.withColumn("predicted_fill_level", F.when(F.col("row_id") % 9 == 0, (F.col("predicted_fill_level") + 1) % 5).otherwise(F.col("predicted_fill_level")))
    return M.prediction_audit(s.where(F.col("row_id") % 50 != 7), s, 2.0)


# --- profiles ---

PV = {**CC.V, "pdays": "select *, " + CC.SPLIT + " as split from enr"}
DIMS = ["collection_status", "fill_level", "site_id", "waste_type", "sub_district", "object_group", "population_cell_id", "qr_alerts"]


def enriched(spark, sf):
    return CC.enriched(spark, sf)


def split_days(spark, sf):
    return SE.temporal_split(enriched(spark, sf), CC.PERIODS)


DIM_TYPES = {"collection_status": "string", "fill_level": "int", "site_id": "bigint", "waste_type": "string", "sub_district": "string", "object_group": "string", "population_cell_id": "int", "qr_alerts": "bigint"}


@BOOK.add("column_profile", " union all ".join(
    f"""select '{c}' as feature, '{DIM_TYPES[c]}' as type, count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as "distinct", min({c}::varchar) as smallest, max({c}::varchar) as largest, round(100.0::double * (count(*) - count({c})) / count(*), 6) as missing_pct,
      (select string_agg(v, '|' order by n desc, v) from (select {c}::varchar as v, count(*) as n from enr where {c} is not null group by 1 order by n desc, v limit 3)) as examples from enr""" for c in DIMS
), **CC.V)
def _(spark, sf):
    return P.column_profile(enriched(spark, sf), DIMS).withColumn("examples", F.array_join("examples", "|"))


FAULTS = "from (select bin_id, count(*) as n, min(date) as f, max(date) as l from enr where not (bin_id % 7 = 0 and date = date '2024-06-30') group by 1) d"


@BOOK.add("range_audit", f"""
    select 'wrong_total_rows' as rule, (sum(n) <> 1000)::bigint as rows {FAULTS} union all select 'wrong_daily_bin_count', (count(*) <> (select count(distinct bin_id) from enr))::bigint {FAULTS}
    union all select 'outside_registry', count(*) {FAULTS} where bin_id % 12 = 5 or bin_id not in (select id from bins) union all select 'incomplete_bin_ranges', count(*) {FAULTS} where f <> date '2024-06-01' or l <> date '2024-06-30'
    union all select 'wrong_rows_per_bin', count(*) {FAULTS} where n <> 30 union all select 'registry_attribute_mismatches', count(*) {FAULTS} where bin_id % 11 = 3 and bin_id % 12 <> 5 and bin_id in (select id from bins)
    union all select 'wrong_registry_count', 1""", **CC.V)
def _(spark, sf):
    """One fault per rule: a day lost, bins the registry does not know, an attribute changed, wrong totals but one."""
    days = enriched(spark, sf)
    lost = days.where(~((F.col("bin_id") % 7 == 0) & (F.col("date") == F.lit(date(2024, 6, 30)))))
    registry = S.bins(spark, sf).where(F.col("id") % 12 != 5).withColumn("waste_type", F.when(F.col("id") % 11 == 3, "changed").otherwise(F.col("waste_type")))
    expected = P.Expected(1000, days.select("bin_id").distinct().count(), -1, date(2024, 6, 1), date(2024, 6, 30))
    return P.range_audit(lost, registry, expected, ["site_id", "waste_type", "capacity_m3", "object_group"])


@BOOK.add("domain_audit", """
    select unnest(['invalid_targets','labels_on_unsuccessful_days','unknown_statuses','infinite_numeric','negative_exposure','negative_qr','noninteger_qr','negative_holidays','collections_last_28d_invalid','missed_collections_28d_invalid','counter_sum_over_28','invalid_calendar']) as rule,
      unnest([(select count(*) from enr where fill_level is not null and bin_id % 13 = 0), 0, (select count(*) from enr where bin_id % 17 = 0), (select count(*) from enr where isnan(capacity_m3)), 0, 0, 0, 0, 0, 0, 0, (select count(*) from enr where bin_id % 19 = 0)])::bigint as rows""".replace(
    "unnest([(select count(*) from enr where fill_level is not null and bin_id % 13 = 0), 0, ", "unnest([(select count(*) from enr where fill_level is not null and bin_id % 13 = 0), (select count(*) from enr where fill_level is not null and bin_id % 17 = 0), "), **CC.V)
def _(spark, sf):
    bad = enriched(spark, sf).withColumns(
        {
            "fill_level": F.when((F.col("bin_id") % 13 == 0) & F.col("fill_level").isNotNull(), 9).otherwise(F.col("fill_level")),
            "collection_status": F.when(F.col("bin_id") % 17 == 0, "lost").otherwise(F.col("collection_status")),
            "month": F.when(F.col("bin_id") % 19 == 0, 1).otherwise(F.col("month")),
        }
    )
    return P.domain_audit(bad)


@BOOK.add("split_profile", """
    select split, count(*) as rows, count(fill_level) as labeled_rows, count(distinct bin_id) as bins, count(distinct case when fill_level is not null then bin_id end) as labeled_bins,
      count(distinct case when bin_id not in (select bin_id from t where split = 'train') then bin_id end) as unseen_bins, count(distinct site_id) as sites,
      count(distinct case when site_id not in (select site_id from t where split = 'train') then site_id end) as unseen_sites, round(100.0::double * count(distinct bin_id) / 1000, 6) as registry_coverage_pct
    from t where split is not null group by 1""", **PV, t="select * replace (case when split = 'train' and site_id % 8 = 0 then 'validation' else split end as split) from pdays")
def _(spark, sf):
    moved = F.when((F.col("split") == "train") & (F.col("site_id") % 8 == 0), "validation").otherwise(F.col("split"))
    rows = split_days(spark, sf).withColumn("split", moved)
    return P.split_profile(rows, 1000)


TD = "date::varchar, waste_type, case when capacity_m3 is null or isnan(capacity_m3) then 'missing' when capacity_m3 <= 0 then 'invalid' when capacity_m3 <= 0.24 then 'small' when capacity_m3 <= 1.1 then 'medium' when capacity_m3 <= 3 then 'large' when capacity_m3 <= 5 then 'very_large' else 'extra_large' end, sub_district, object_group, case when qr_alerts is null then 'missing' when qr_alerts <= 0 then 'zero' when qr_alerts <= 1 then 'one' when qr_alerts <= 5 then '2-5' when qr_alerts <= 20 then '6-20' when qr_alerts <= 100 then '21-100' else '101+' end"


@BOOK.add("target_distribution", f"""
    select target, feature, coalesce(value, 'nan') as value, count(*) as rows from (select coalesce(fill_level, -1) as target, unnest(['date', 'waste_type', 'capacity_range', 'sub_district', 'object_group', 'qr_range']) as feature, unnest([{TD}]) as value from enr) group by 1, 2, 3""", **CC.V)
def _(spark, sf):
    return P.target_distribution(enriched(spark, sf))


@BOOK.add("label_availability", "select date, count(*) as rows, round(count(fill_level)::double / count(*), 6) as labeled_share from bin_days group by 1")
def _(spark, sf):
    return P.label_availability(S.bin_days(spark, sf))


@BOOK.add("category_drift", """
    with v as (select split, unnest(['object_group', 'qr_alerts', 'collection_status']) as feature, coalesce(unnest([object_group, qr_alerts::varchar, collection_status]), '__MISSING__') as value from pdays where split is not null),
      n as (select split, feature, value, count(*) as n from v group by 1, 2, 3)
    select split, feature, count(*) as distinct_values, count(*) filter (where (feature, value) not in (select (feature, value) from n where split = 'train')) as unseen_values,
      coalesce(sum(n) filter (where (feature, value) not in (select (feature, value) from n where split = 'train')), 0)::bigint as unseen_rows from n group by 1, 2""", **PV)
def _(spark, sf):
    return P.category_drift(split_days(spark, sf), ["object_group", "qr_alerts", "collection_status"])


@BOOK.add("numeric_drift", " union all ".join(
    f"select split, '{c}' as feature, count(*) as labeled_rows, count({c}) as known_rows, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std_population, round(100.0::double * (1 - count({c})::double / count(*)), 6) as missing_pct from pdays where split is not null and fill_level is not null group by 1"
    for c in ("qr_alerts", "collections_last_28d", "resident_factor")
), **PV)
def _(spark, sf):
    return P.numeric_drift(split_days(spark, sf).where(F.col("fill_level").isNotNull()), ["qr_alerts", "collections_last_28d", "resident_factor"])


@BOOK.add("label_coverage", """
    select c.id, n.rows is not null as has_daily_history, coalesce(n.labels, 0) as labeled_rows, object_group is null as missing_object_group, canonical_district is null as ambiguous_district,
      capacity_m3 is null or isnan(capacity_m3) or capacity_m3 <= 0 as invalid_capacity, site_id in (select site_id from bad_sites) as contradictory_site_districts
    from canon c left join (select bin_id, count(*) as rows, count(fill_level) as labels from bin_days group by 1) n on n.bin_id = c.id""", canon=REG["canon"], bad_sites=REG["bad_sites"])
def _(spark, sf):
    bins = R.ambiguous_districts(S.bins(spark, sf), S.district_aliases(spark, sf))
    return P.label_coverage(bins, S.bin_days(spark, sf))


@BOOK.add("correlated_features", """
    select 'l_quantity' as first, 'l_extendedprice' as second, round(corr(l_quantity, l_extendedprice), 6) as correlation from lineitem having abs(corr(l_quantity, l_extendedprice)) >= 0.3
    union all select 'l_quantity', 'double_quantity', 1.0
    union all select 'l_extendedprice', 'double_quantity', round(corr(l_quantity, l_extendedprice), 6) from lineitem having abs(corr(l_quantity, l_extendedprice)) >= 0.3""")
def _(spark, sf):
    rows = S.table(spark, sf, "lineitem").withColumn("double_quantity", F.col("l_quantity") * 2 + 1)
    return P.correlated_features(rows, ["l_quantity", "l_extendedprice", "l_discount", "double_quantity"], 0.3)


@BOOK.add("importance_rollup", "select p_brand as feature, round(sum(p_retailprice), 4) as importance, count(*) as columns from part group by 1", digits=4)
def _(spark, sf):
    part = S.table(spark, sf, "part")
    return P.importance_rollup(part.select(F.col("p_partkey").alias("encoded"), F.col("p_retailprice").alias("importance")), part.select(F.col("p_partkey").alias("encoded"), F.col("p_brand").alias("feature")))


@BOOK.add("monotone_audit", f"""
    select count(qr) as known_rows, count(*) filter (where not reset and qr < prev - 1e-9) as falls, count(*) filter (where qr < 0 or qr > 3) as out_of_bounds from (
      select *, lag(qr) over (partition by bin_id order by date) as prev, coalesce(lag({CC.OKS}) over (partition by bin_id order by date), true) as reset from (
        select *, case when extract(day from date) = 20 then 0 else qr_alerts end as qr from enr))""", **CC.V)
def _(spark, sf):
    days = enriched(spark, sf).withColumn("qr", F.when(F.dayofmonth("date") == 20, 0).otherwise(F.col("qr_alerts")))
    return P.monotone_audit(days, "qr", 3.0)


@BOOK.add("row_equality_audit", """
    select count(*) as rows, count(*) filter (where bin_id % 31 = 0) as lost, 0::bigint as added, count(*) filter (where bin_id % 31 <> 0 and bin_id % 10 = 4 and date = date '2024-06-03') as changed, 'extra' as new_columns from bin_days""")
def _(spark, sf):
    days = S.bin_days(spark, sf).drop("capacity_m3")
    touched = days.where(F.col("bin_id") % 31 != 0).withColumns({"reports": F.when((F.col("bin_id") % 10 == 4) & (F.col("date") == "2024-06-03"), F.col("reports") + 1).otherwise(F.col("reports")), "extra": F.lit(1)})
    return P.row_equality(days, touched, ["bin_id", "date"])


# --- calibration ---

KNOTS = CA.knot_fractions(0.0)


@BOOK.add("quantile_knots", "select " + ", ".join(f"round(quantile_cont(l_extendedprice / 1000, {q!r}::double), 6) as knot_{i + 1}" for i, q in enumerate(KNOTS)) + " from lineitem")
def _(spark, sf):
    return CA.quantile_knots(S.table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("pressure")))


Y = [0.0] + [(v - 1.5) / 118.5 for v in CA.KNOT_LEVELS]
X = [0.0, 10.0, 25.0, 60.0, 90.0]
SEG = " ".join(f"when x <= {X[i + 1]} then {Y[i]!r}::double + (x - {X[i]}) * {(Y[i + 1] - Y[i]) / (X[i + 1] - X[i])!r}::double" for i in range(4))


@BOOK.add("piecewise_calibration", f"""
    select l_suppkey, l_partkey, l_linenumber, round(x, 4) as pressure, round(least(greatest(r + (120 - r) * (case when x <= 0 then 0 {SEG} else {Y[4]!r}::double + (1 - {Y[4]!r}::double) * (1 - exp(-(x - 90) / 30.0::double)) end), 0), 120), 4) as fullness, count(*) as n
    from (select *, l_extendedprice / 700 as x, l_discount * 30 as r from lineitem) group by 1, 2, 3, 4, 5""", digits=4)
def _(spark, sf):
    x, r = F.col("l_extendedprice") / 700, F.col("l_discount") * 30
    rows = S.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.round(x, 4).alias("pressure"), F.round(CA.fullness(x, r, X[1:]), 4).alias("fullness"))
    return rows.groupBy("l_suppkey", "l_partkey", "l_linenumber", "pressure", "fullness").agg(F.count("*").alias("n"))


# --- training ---

CAT, NUM = SE.CATEGORICAL_FEATURES, SE.NUMERIC_FEATURES
CUT = date(2024, 6, 22)
#: The reference's forest, the deeper of its grid, and a logistic model that runs until it converges.
FOREST = {"numTrees": 150, "maxDepth": 16, "minInstancesPerNode": 10, "subsamplingRate": 0.7, "balanced": True}
LOGISTIC = {"maxIter": 1000, "regParam": 0.05, "balanced": True}
GRIDS = {
    "random_forest": {"numTrees": [150], "maxDepth": [10, 16], "minInstancesPerNode": [10], "subsamplingRate": [0.7], "balanced": [False, True]},
    "logistic": {"maxIter": [1000], "regParam": [0.03, 0.3], "balanced": [False, True]},
}


def matrix(spark, sf):
    return materialize(SE.feature_matrix(enriched(spark, sf), S.bins(spark, sf), S.district_aliases(spark, sf)), "features")


def fitted(spark, sf, kind="random_forest", **params):
    rows = matrix(spark, sf)
    return rows, T.fit(kind, rows.where(F.col("date") <= F.lit(CUT)), NUM, CAT, **(params or FOREST))


def tested(rows):
    return rows.where(F.col("date") > F.lit(CUT))


INPUT = f"select {CC.FEATURES} from flagged"
PREPARED = " union all ".join(
    [f"select '{c}' as feature, null as value, count(*) filter (where {c} is null) as rows, round(sum(coalesce({c}::double, coalesce((select quantile_disc({c}::double, 0.5) from f where date <= date '2024-06-22' and fill_level is not null), 0))), 4) as total from f" for c in NUM]
    + [
        f"select '{c}', case when coalesce({c}::varchar, '__MISSING__') in (select coalesce({c}::varchar, '__MISSING__') from f where date <= date '2024-06-22' and fill_level is not null group by 1 having count(*) >= 5) then coalesce({c}::varchar, '__MISSING__') else '__RARE__' end, count(*), null from f group by 2"
        for c in CAT
    ]
)


@BOOK.add("preprocess_pipeline", f"with f as ({INPUT}) {PREPARED}", digits=4, **CC.V)
def _(spark, sf):
    """Per number the rows without a value and the filled total, per category the rows of each folded value."""
    rows = matrix(spark, sf)
    ready = T.prepare(rows.where((F.col("date") <= F.lit(CUT)) & F.col("fill_level").isNotNull()), NUM, CAT).apply(rows)
    parts = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"), F.col(f"{c}_missing").cast("long").alias("rows"), F.col(f"{c}_filled").alias("total")) for c in NUM]
    parts += [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_text").alias("value"), F.lit(1).cast("long").alias("rows"), F.lit(None).cast("double").alias("total")) for c in CAT]
    return ready.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.feature", "p.value").agg(F.sum("p.rows").alias("rows"), F.round(F.sum("p.total"), 4).alias("total"))


@BOOK.add("train_forest")
def _(spark, sf):
    rows, model = fitted(spark, sf)
    return T.predict(model, tested(rows)).select("bin_id", "date", "fill_level", "predicted_fill_level", "needs_collection_probability")


@BOOK.add("train_second_model")
def _(spark, sf):
    rows, model = fitted(spark, sf, "logistic", **LOGISTIC)
    return T.predict(model, tested(rows)).select("bin_id", "date", "fill_level", "predicted_fill_level", "needs_collection_probability")


def audited(predictions, model, train):
    """One row: coverage of the keys, valid probabilities, consistent class, and whether the fit beats a constant model.

    The fit minimises class-weighted log loss on its training rows; a constant model has ln 5 at best there, as all classes weigh alike.
    """
    p = F.col("probabilities")
    labelled = train.where(F.col("fill_level").isNotNull())
    right = F.element_at("probabilities", F.col("fill_level") + 1)
    by_class = T.predict(model, labelled).groupBy("fill_level").agg(F.avg(-F.ln(F.greatest(right, F.lit(1e-15)))).alias("loss"))
    fitted = by_class.agg((F.avg("loss") < F.ln(F.lit(5.0))).alias("better_than_constant"))
    return predictions.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("bin_id", "date")).alias("repeated_keys"),
        F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).alias("bad_sums"), F.count_if(F.exists(p, lambda x: (x < 0) | (x > 1))).alias("outside"),
        F.count_if(F.array_position(p, F.array_max(p)) - 1 != F.col("predicted_fill_level")).alias("argmax_mismatch"),
    ).join(fitted, F.lit(True))


AUDIT = "0::bigint as repeated_keys, 0::bigint as bad_sums, 0::bigint as outside, 0::bigint as argmax_mismatch, true as better_than_constant"


@BOOK.add("train_forest_audit", f"select count(*) as rows, {AUDIT} from bin_days where date > date '2024-06-22'")
def _(spark, sf):
    rows, model = fitted(spark, sf)
    return audited(T.predict(model, tested(rows)), model, rows.where(F.col("date") <= F.lit(CUT)))


@BOOK.add("train_second_model_audit", f"select count(*) as rows, {AUDIT} from bin_days where date > date '2024-06-22'")
def _(spark, sf):
    rows, model = fitted(spark, sf, "logistic", **LOGISTIC)
    return audited(T.predict(model, tested(rows)), model, rows.where(F.col("date") <= F.lit(CUT)))


@BOOK.add("temporal_grid_search")
def _(spark, sf):
    folds = T.expanding_folds(date(2024, 6, 1), [date(2024, 6, 15), date(2024, 6, 20), date(2024, 6, 25)])
    return T.temporal_grid_search(matrix(spark, sf), GRIDS, folds, NUM, CAT)


SEARCHED = "union all ".join(f"select '{kind}' as model, '{phase}' as phase, 4::bigint as candidates, 8::bigint as fits, 0::bigint as outside " for kind in GRIDS for phase in ("coarse", "refined"))


@BOOK.add("temporal_grid_search_audit", SEARCHED)
def _(spark, sf):
    """Candidates and fits of each phase, and scores or deviations outside 0 to 1."""
    rows = BOOK.queries["temporal_grid_search"](spark, sf)
    valid = F.col("mean_score").between(0, 1) & F.col("std_score").between(0, 1)
    return rows.groupBy("model", "phase").agg(F.count("*").alias("candidates"), F.sum("folds").alias("fits"), F.count_if(~valid).alias("outside"))


FORECAST_DAYS = 3


@BOOK.add("predict_registry_days")
def _(spark, sf):
    """Forecasts of every registry bin for each day of a range, each from the history up to the day before."""
    _, model = fitted(spark, sf)
    days = materialize(S.bin_days(spark, sf), "days")  # read for each day
    ends = [CC.END - timedelta(days=k) for k in range(FORECAST_DAYS)]
    inputs = reduce(DataFrame.unionByName, [CC.next_day(spark, sf, end=end, days=days) for end in ends])
    return T.predict(model, inputs).select("bin_id", "date", "predicted_fill_level", "needs_collection_probability")


@BOOK.add("predict_registry_days_audit", f"select d as date, count(*) as bins, count(*) as forecasts from bins, (select unnest(generate_series(date '2024-07-01' - {FORECAST_DAYS - 1}, date '2024-07-01', interval 1 day))::date as d) group by 1")
def _(spark, sf):
    rows = BOOK.queries["predict_registry_days"](spark, sf)
    valid = F.col("predicted_fill_level").between(0, 4) & F.col("needs_collection_probability").between(0, 1)
    return rows.groupBy("date").agg(F.count_distinct("bin_id").alias("bins"), F.count_if(valid).alias("forecasts"))


@BOOK.add("permutation_importance")
def _(spark, sf):
    rows, model = fitted(spark, sf)
    return T.permutation_importance(model, tested(rows), [*NUM, *CAT])


@BOOK.add("forest_importances")
def _(spark, sf):
    _, model = fitted(spark, sf)
    enc = T.encoded_importances(model, NUM, CAT, spark)
    return P.importance_rollup(enc.select("encoded", "importance"), enc.select("encoded", "feature"))


@BOOK.add("forest_importances_audit", f"select 1.0 as total, {len(CAT) + len(NUM)}::bigint as features, 0::bigint as negative", digits=4)
def _(spark, sf):
    rows = BOOK.queries["forest_importances"](spark, sf)
    return rows.agg(F.sum("importance").alias("total"), F.count("*").alias("features"), F.count_if(F.col("importance") < 0).alias("negative"))
