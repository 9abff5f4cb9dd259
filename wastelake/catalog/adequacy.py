"""Population allocation and adequacy."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.catalog.geography import EDGES
from wastelake.catalog.views import LON_SCALE
from wastelake.functions import bands as B
from wastelake.operators import adequacy as O, allocation as AL
from wastelake.plans.jobs import allocate
from wastelake.session import materialize
from wastelake.sources import tables as S

BOOK = Book()
POLICY = O.Policy(access_distance_m=600.0)
RES = "object_group in ('Daugiabučiai namai','Dvibučiai','Daugiabučių/garažų bendrijos','Sodų bendrijos','Sodų/garažų bendrijos') and capacity_m3 > 0 and not isnan(capacity_m3)"
D2 = "sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2))"
V = {
    **EDGES,
    "pts0": f"""select waste_type, latitude, longitude, sum(capacity_m3) as capacity_m3, min(id) as point_id, count(*) as bin_count, longitude * {LON_SCALE} as x, latitude * 111320.0::double as y
        from bins where {RES} group by 1, 2, 3""",
    "srv": f"""select s.id as cell_id, p.waste_type, arg_min(p.point_id, {{'d': {D2}, 'i': p.point_id}}) as point_id, min({D2}) as distance_m, max(s.residents) as residents
        from (select r.id, r.residents, c.cx * {LON_SCALE} as x, c.cy * 111320.0::double as y from residents r join centroids c on c.id = r.id where r.residents > 0) s, pts0 p group by 1, 2""",
    "pts": "select p.*, coalesce(v.n, 0) as point_residents from pts0 p left join (select waste_type, point_id, sum(residents) as n from srv group by 1, 2) v on v.waste_type = p.waste_type and v.point_id = p.point_id",
    "mem": f"select b.id as bin_id, b.waste_type, p.point_id, p.point_residents * b.capacity_m3 / p.capacity_m3 as factor from bins b join pts p on p.waste_type = b.waste_type and p.latitude = b.latitude and p.longitude = b.longitude where b.{RES}".replace("and capacity_m3 > 0 and not isnan(capacity_m3)", "and b.capacity_m3 > 0 and not isnan(b.capacity_m3)"),
    "thr": "select waste_type, quantile_cont(point_residents / capacity_m3, 0.8) as threshold from pts where point_residents > 0 group by 1",
    "kinds": "select unnest(['Mixed municipal waste','Paper/plastic waste','Glass waste']) as waste_type, unnest([1, 2, 3]) as code",
    "grid": """select c.id * 10 + k.code as feature_id, c.id as cell_id, k.waste_type, case when c.density_text is not null then c.residents end as residents, c.suppressed, c.area_m2 / 10000 as area_ha, c.density_text is not null as population_known,
        s.point_id, s.distance_m, p.capacity_m3 as point_capacity_m3, p.point_residents, coalesce(p.bin_count, 0) as point_bin_count, p.point_residents / p.capacity_m3 as pressure,
        case when s.point_id is not null then p.capacity_m3 * c.residents / p.point_residents when c.density_text is not null then 0 end as attributed_capacity_m3,
        coalesce(p.point_residents / p.capacity_m3 >= t.threshold, false) as high_pressure, coalesce(s.distance_m > 600, false) as long_access
      from residents c cross join kinds k left join srv s on s.cell_id = c.id and s.waste_type = k.waste_type left join pts p on p.waste_type = s.waste_type and p.point_id = s.point_id left join thr t on t.waste_type = k.waste_type""",
    "cnt": """select date_trunc('month', d.date)::date as month, m.waste_type, m.point_id, count(*) as assessments, count(*) filter (where d.fill_level = 4) as level4_count, count(distinct d.date) as assessed_days, count(distinct d.bin_id) as assessed_bins
      from bin_days d join mem m on m.bin_id = d.bin_id where d.fill_level is not null group by 1, 2, 3""",
    # posterior values are fixed by a simple stand-in so that the rule, not the solver, is compared
    "feats": """select g.*, date '2024-06-01' as month, coalesce(c.assessments, 0) as assessments, coalesce(c.level4_count, 0) as level4_count, coalesce(c.assessed_days, 0) as assessed_days, coalesce(c.assessed_bins, 0) as assessed_bins,
        coalesce(c.assessed_bins::double / g.point_bin_count, 0) as bin_coverage, coalesce(c.assessments >= 5 and c.assessed_days >= 3 and c.assessed_bins::double / g.point_bin_count >= 0.5, false) as sufficient_evidence,
        c.level4_count::double / c.assessments as raw_frequency, c.level4_count::double / c.assessments * 4 as exceedance_probability
      from grid g left join cnt c on c.waste_type = g.waste_type and c.point_id = g.point_id""",
    "classed": """select *, case when not population_known or coalesce(residents, 0) = 0 or point_id is null then 'unavailable' when not sufficient_evidence then 'insufficient_evidence'
        when (high_pressure or long_access) and exceedance_probability >= 0.9 then 'priority_shortage' when high_pressure or long_access then 'potential_shortage' when exceedance_probability >= 0.9 then 'overflow_without_pressure' else 'ordinary' end as category,
        array_to_string(list_filter([case when not population_known then 'unknown_population' when residents = 0 then 'no_resident_demand' when point_id is null then 'no_serving_point' end,
          case when high_pressure then 'high_pressure' end, case when long_access then 'long_access' end,
          case when population_known and residents > 0 and point_id is not null and not sufficient_evidence then 'insufficient_fill_evidence' end,
          case when population_known and residents > 0 and point_id is not null and sufficient_evidence and exceedance_probability >= 0.9 then 'elevated_level4' end], lambda x : x is not null), ';') as reasons from feats""",
}
#: The prior by closing grids: each of the next views scores a square of nodes around the best node of the one before.
PRIOR_GRIDS, NODES = 48, 9
LN_K = f"({O.LN_K_LOW!r}::double)", f"({O.LN_K_HIGH!r}::double)"
LOGIT = f"({O.LOGIT_BOUND!r}::double)"
V |= {
    "wgt": "select month, waste_type, assessments as n, level4_count as y, count(*) as weight from cnt group by all",
    "node": f"select (i - {NODES // 2}) / {NODES // 2}::double as dm, (j - {NODES // 2}) / {NODES // 2}::double as dc from range({NODES}) t(i), range({NODES}) u(j)",
    "pg0": f"select month, waste_type, ln(sum(weight * y) / sum(weight * (n - y))) as m, ({LN_K[0]} + {LN_K[1]}) / 2 as c, 0::double as ll from wgt group by all",
}
for _k in range(1, PRIOR_GRIDS + 1):
    _close = 0.7 ** (_k - 1)
    V[f"pg{_k}"] = f"""select month, waste_type, arg_max(m, ll) as m, arg_max(c, ll) as c, max(ll) as ll from (
      select month, waste_type, m, c, sum(weight * (lgamma(y + a) + lgamma(n - y + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b))) as ll from (
        select *, exp(c) / (1 + exp(-m)) as a, exp(c) / (1 + exp(m)) as b from (
          select distinct g.month, g.waste_type, least(greatest(g.m + dm * {_close!r}::double, -{LOGIT}), {LOGIT}) as m, least(greatest(g.c + dc * ({LN_K[1]} - {LN_K[0]}) / 2 * {_close!r}::double, {LN_K[0]}), {LN_K[1]}) as c from pg{_k - 1} g, node))
        join wgt using (month, waste_type) group by all) group by all"""
V |= {
    "prior": f"""select month, waste_type, exp(c) / (1 + exp(-m)) as alpha, exp(c) / (1 + exp(m)) as beta, 1 / (1 + exp(-m)) as mean, exp(c) as concentration, points::bigint as points, -ll as objective,
        least({LOGIT} - abs(m), c - {LN_K[0]}, {LN_K[1]} - c) < 1e-6 as at_bound, true as converged from pg{PRIOR_GRIDS} join (select month, waste_type, sum(weight) as points from wgt group by all) using (month, waste_type)""",
    # the beta distribution as a sum of narrow bars; for a < 1 over x^a, where the density is smooth
    "bars": """select *, sum(mass) over (partition by a, b, lim order by u) as upto from (
        select a, b, lim, u, pow((u + 0.5) / 20000, 1 / least(a, 1)) as x, pow((u + 1) / 20000::double, 1 / least(a, 1)) as edge,
          exp((a - 1) * ln(x) + (b - 1) * ln(1 - x) + (1 - least(a, 1)) * ln(x) - ln(least(a, 1)) + lgamma(a + b) - lgamma(a) - lgamma(b)) / 20000 as mass
        from (select distinct level4_count + alpha as a, assessments - level4_count + beta as b, mean + 0.05 as lim from cnt join prior using (month, waste_type)), range(20000) t(u))""",
    "tails": """select a, b, lim, min(case when upto >= 0.05 and upto - mass < 0.05 then edge - (upto - 0.05) / mass * (edge - before) end) as low, min(case when upto >= 0.95 and upto - mass < 0.95 then edge - (upto - 0.95) / mass * (edge - before) end) as high,
        1 - max(case when before < lim then upto - mass * greatest(0, (edge - lim) / (edge - before)) else 0 end) as exceedance from (select *, pow(u / 20000::double, 1 / least(a, 1)) as before from bars) group by all""",
    "est": """select c.month, c.waste_type, c.point_id, assessments, level4_count, assessed_days, assessed_bins, assessed_bins::double / bin_count as bin_coverage, level4_count::double / assessments as raw_frequency, a / (a + b) as smoothed_frequency,
        low as interval_low, high as interval_high, exceedance as exceedance_probability, assessments >= 5 and assessed_days >= 3 and assessed_bins::double / bin_count >= 0.5 as sufficient_evidence
        from (select *, level4_count + alpha as a, assessments - level4_count + beta as b, mean + 0.05 as lim from cnt join prior using (month, waste_type)) c join tails using (a, b, lim) join pts0 p on p.waste_type = c.waste_type and p.point_id = c.point_id""",
}
FITTED = V | {"feats": """select g.*, date '2024-06-01' as month, coalesce(c.assessments, 0) as assessments, coalesce(c.level4_count, 0) as level4_count, coalesce(c.assessed_days, 0) as assessed_days, coalesce(c.assessed_bins, 0) as assessed_bins,
    coalesce(c.bin_coverage, 0) as bin_coverage, coalesce(c.sufficient_evidence, false) as sufficient_evidence, c.raw_frequency, c.smoothed_frequency, c.interval_low, c.interval_high, c.exceedance_probability
    from grid g left join est c on c.month = date '2024-06-01' and c.waste_type = g.waste_type and c.point_id = g.point_id"""}
CATS = ", ".join(f"count(*) filter (where category = '{c}') as {c}" for c in O.CATEGORIES)


def cells(spark, sf):
    return AL.parse_density(S.cells(spark, sf))


def base(spark, sf):
    c, b = cells(spark, sf), S.bins(spark, sf)
    c, srv, pts = allocate(c, b)
    return c, b, srv, pts


def grid(spark, sf):
    c, b, srv, pts = base(spark, sf)
    thr = O.pressure_thresholds(pts, {"threshold": 0.8})
    return c, b, srv, pts, thr, O.area_type_grid(c, pts, srv, thr, POLICY)


def counts(spark, sf, b, pts):
    return O.assessment_counts(S.bin_days(spark, sf), O.bin_points(b, pts))


def standin(spark, sf):
    """Features whose exceedance is four times the raw rate: checks rules without the solver."""
    c, b, srv, pts, thr, g = grid(spark, sf)
    n = counts(spark, sf, b, pts)
    est = O.evidence_sufficiency(n.join(pts.select("waste_type", "point_id", F.col("bin_count").alias("point_bin_count")), ["waste_type", "point_id"]), POLICY).drop("point_bin_count")
    raw = F.col("level4_count") / F.col("assessments")
    est = est.withColumns({"raw_frequency": raw, "exceedance_probability": raw * 4, "smoothed_frequency": raw, "interval_low": raw, "interval_high": raw})
    months = spark.range(1).select(F.lit(date(2024, 6, 1)).alias("month"))
    return O.adequacy_features(g, est, months, POLICY), c, pts, thr


@BOOK.add("parse_density", "select id, density_per_ha, suppressed, area_m2 / 10000 as area_ha, residents, density_text is not null as population_known from residents")
def _(spark, sf):
    return cells(spark, sf).select("id", "density_per_ha", "suppressed", "area_ha", "residents", "population_known")


@BOOK.add("residential_filter", f"select id, object_group, capacity_m3 from bins where {RES}")
def _(spark, sf):
    return AL.residential(S.bins(spark, sf)).select("id", "object_group", "capacity_m3")


@BOOK.add("collection_points", "select waste_type, point_id, round(capacity_m3, 6) as capacity_m3, bin_count from pts0", **V)
def _(spark, sf):
    return AL.collection_points(S.bins(spark, sf)).select("waste_type", "point_id", "capacity_m3", "bin_count")


@BOOK.add("allocate_residents", "select cell_id, waste_type, point_id, round(distance_m, 3) as distance_m, round(residents, 3) as residents from srv", digits=3, **V)
def _(spark, sf):
    c = cells(spark, sf)
    return AL.serving_points(c, AL.collection_points(S.bins(spark, sf)))


@BOOK.add("resident_factor", """
    select b.id as bin_id, b.waste_type, m.point_id, w.cell as population_cell_id, round(coalesce(m.factor, 0), 4) as resident_factor from bins b left join mem m on m.bin_id = b.id
    left join (select b.id, min(c.id) as cell from bins b join cells c on longitude >= x0 and longitude < x1 and latitude >= y0 and latitude < y1 and not (holed and longitude >= hx0 and longitude < hx1 and latitude >= hy0 and latitude < hy1) group by 1) w on w.id = b.id""", digits=4, **V)
def _(spark, sf):
    c, b, _, pts = base(spark, sf)
    return AL.resident_factors(b, pts, c)


@BOOK.add("allocation_stats", """
    select p.waste_type, sum(bin_count)::bigint as residential_bins, count(*) as points, max(a.allocated) as allocated, max(a.areas) as areas, max(a.d50) as distance_p50, max(a.d90) as distance_p90,
      max(f.f50) as factor_p50, max(f.f90) as factor_p90, max(f.f99) as factor_p99, max(f.fm) as factor_max, round((select sum(residents) from residents) - max(a.allocated), 3) as unallocated
    from pts p join (select waste_type, round(sum(residents), 3) as allocated, count(*) as areas, round(quantile_cont(distance_m, 0.5), 3) as d50, round(quantile_cont(distance_m, 0.9), 3) as d90 from srv group by 1) a on a.waste_type = p.waste_type
    join (select waste_type, round(quantile_cont(factor, 0.5), 3) as f50, round(quantile_cont(factor, 0.9), 3) as f90, round(quantile_cont(factor, 0.99), 3) as f99, round(max(factor), 3) as fm from mem group by 1) f on f.waste_type = p.waste_type group by 1""", digits=3, **V)
def _(spark, sf):
    c, b, srv, pts = base(spark, sf)
    return AL.allocation_stats(c, pts, srv, AL.resident_factors(b, pts, c))


@BOOK.add("allocation_conservation", "select waste_type, round(sum(factor), 3) as allocated, round((select sum(residents) from residents), 3) as residents, true as conserved from mem group by 1", digits=3, **V)
def _(spark, sf):
    c, b, _, pts = base(spark, sf)
    return AL.allocation_conservation(c, AL.resident_factors(b, pts, c))


@BOOK.add("pressure_threshold", "select waste_type, round(threshold, 6) as threshold from thr", **V)
def _(spark, sf):
    _, _, _, pts = base(spark, sf)
    return O.pressure_thresholds(pts, {"threshold": 0.8})


@BOOK.add("area_type_grid", """
    select feature_id, waste_type, round(residents, 3) as residents, point_id, round(distance_m, 3) as distance_m, round(point_capacity_m3, 3) as point_capacity_m3, round(point_residents, 3) as point_residents, point_bin_count,
      round(pressure, 3) as pressure, round(attributed_capacity_m3, 3) as attributed_capacity_m3, high_pressure, long_access from grid""", digits=3, **V)
def _(spark, sf):
    g = grid(spark, sf)[-1]
    return g.select("feature_id", "waste_type", "residents", "point_id", "distance_m", "point_capacity_m3", "point_residents", "point_bin_count", "pressure", "attributed_capacity_m3", "high_pressure", "long_access")


@BOOK.add("assessment_counts", "select * from cnt", **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    return counts(spark, sf, b, AL.collection_points(b))


@BOOK.add("assessment_rejects", """
    select 'duplicate_day' as rule, count(distinct bin_id) as rows from bin_days where date = date '2024-06-05' union all select 'unknown_bin', count(*) from bin_days where bin_id % 12 = 5
    union all select 'attribute_mismatch', count(*) from bin_days where bin_id % 11 = 3 and bin_id % 12 <> 5 union all select 'invalid_label', count(*) from bin_days where fill_level = 4 and date > date '2024-06-25'""".replace(
        "select 'unknown_bin', count(*) from bin_days where bin_id % 12 = 5", "select 'unknown_bin', count(*) + count(*) filter (where date = date '2024-06-05') from bin_days where bin_id % 12 = 5").replace(
        "select 'attribute_mismatch', count(*) from bin_days where", "select 'attribute_mismatch', count(*) + count(*) filter (where date = date '2024-06-05') from bin_days where"))
def _(spark, sf):
    days = S.bin_days(spark, sf)
    days = days.unionByName(days.where(F.col("date") == F.lit(date(2024, 6, 5))))
    days = days.withColumns({"object_group": F.when(F.col("bin_id") % 11 == 3, "changed").otherwise(F.col("object_group")), "fill_level": F.when((F.col("fill_level") == 4) & (F.col("date") > F.lit(date(2024, 6, 25))), 5).otherwise(F.col("fill_level"))})
    return O.assessment_rejects(days, S.bins(spark, sf).where(F.col("id") % 12 != 5))


@BOOK.add("beta_binomial_likelihood", """
    select month, waste_type, round(sum(lgamma(level4_count + 0.8::double) + lgamma(assessments - level4_count + 3.2::double) - lgamma(assessments + 4.0::double) - (lgamma(0.8::double) + lgamma(3.2::double) - lgamma(4.0::double))), 4) as log_likelihood, count(*) as points
    from cnt group by 1, 2""", digits=4, **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    w = counts(spark, sf, b, AL.collection_points(b)).groupBy("month", "waste_type", F.col("assessments").alias("n"), F.col("level4_count").alias("y")).agg(F.count("*").alias("weight"))
    return w.groupBy("month", "waste_type").agg(F.sum(O.log_likelihood(w, F.lit(0.2), F.lit(4.0))).alias("log_likelihood"), F.sum("weight").alias("points"))


@BOOK.add("beta_binomial_prior", "select month, waste_type, round(alpha, 3) as alpha, round(beta, 3) as beta, round(mean, 3) as mean, round(concentration, 3) as concentration, points, round(objective, 3) as objective, at_bound, converged from prior", digits=3, **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    return O.beta_binomial_prior(counts(spark, sf, b, AL.collection_points(b)))


ROUNDED = ", ".join(f"round({c}, 4) as {c}" for c in ("bin_coverage", "raw_frequency", "smoothed_frequency", "interval_low", "interval_high", "exceedance_probability"))


@BOOK.add("posterior_estimates", f"select * replace ({ROUNDED}) from est", digits=4, **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    pts = AL.collection_points(b)
    n = counts(spark, sf, b, pts)
    return O.posterior_estimates(n, pts, O.beta_binomial_prior(n), POLICY)


@BOOK.add("evidence_sufficiency", """
    select c.month, c.waste_type, c.point_id, round(assessed_bins::double / bin_count, 6) as bin_coverage, assessments >= 5 and assessed_days >= 3 and assessed_bins::double / bin_count >= 0.5 as sufficient_evidence
    from cnt c join pts0 p on p.waste_type = c.waste_type and p.point_id = c.point_id""", **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    pts = AL.collection_points(b)
    rows = counts(spark, sf, b, pts).join(pts.select("waste_type", "point_id", F.col("bin_count").alias("point_bin_count")), ["waste_type", "point_id"])
    return O.evidence_sufficiency(rows, POLICY).select("month", "waste_type", "point_id", "bin_coverage", "sufficient_evidence")


@BOOK.add("classify_area", "select month, feature_id, category, reasons from classed", **V)
def _(spark, sf):
    return standin(spark, sf)[0].select("month", "feature_id", "category", F.array_join("reasons", ";").alias("reasons"))


FEATURES = ("month", "feature_id", "cell_id", "waste_type", "point_id", "residents", "distance_m", "pressure", "assessments", "level4_count", "bin_coverage", "smoothed_frequency", "interval_low", "interval_high", "exceedance_probability", "sufficient_evidence", "category", "reasons")


@BOOK.add("adequacy_features", "select " + ", ".join(f"round({c}, 4) as {c}" if c in ("residents", "distance_m", "pressure", "bin_coverage", "smoothed_frequency", "interval_low", "interval_high", "exceedance_probability") else c for c in FEATURES) + " from classed", digits=4, **FITTED)
def _(spark, sf):
    c, b, srv, pts, thr, g = grid(spark, sf)
    n = counts(spark, sf, b, pts)
    est = O.posterior_estimates(n, pts, O.beta_binomial_prior(n), POLICY)
    months = spark.range(1).select(F.lit(date(2024, 6, 1)).alias("month"))
    return O.adequacy_features(g, est, months, POLICY).withColumn("reasons", F.array_join("reasons", ";")).select(*FEATURES)


@BOOK.add("adequacy_quality", """
    select month, waste_type, category, count(*) as areas, count(residents) as known_population_areas, count(*) filter (where residents is null) as missing_population_areas, round(sum(residents), 3) as full_polygon_residents from classed group by 1, 2, 3""", digits=3, **V)
def _(spark, sf):
    return O.category_quality(standin(spark, sf)[0])


@BOOK.add("point_summaries", "select month, waste_type, count(*) as assessed_points, sum(assessments)::bigint as assessments, sum(level4_count)::bigint as level4_count, (select count(*) from pts0 p where p.waste_type = c.waste_type) as points from cnt c group by 1, 2", **V)
def _(spark, sf):
    b = S.bins(spark, sf)
    pts = AL.collection_points(b)
    return O.point_summaries(counts(spark, sf, b, pts), pts)


#: One fault per rule of a feature table; the other rules find nothing.
PLANTED = {
    "negative_numbers": "feature_id % 9 = 0 and distance_m is not null", "probability_bounds": "exceedance_probability > 1", "unknown_reason": "feature_id % 23 = 0", "population_flags": "feature_id % 29 = 0",
    "pressure_flags": "feature_id % 31 = 0", "evidence_flag": "feature_id % 37 = 0", "invalid_area": "feature_id % 41 = 0", "unknown_waste_type": "false", "infinite_numbers": "feature_id % 43 = 0",
}
NO_FAULT = ("unstable_identity", "unknown_category", "population_missingness", "level4_above_assessments", "days_above_assessments", "days_above_month", "bins_above_point", "coverage_mismatch", "raw_frequency_mismatch", "missing_estimate",
            "invented_estimate", "interval_order", "unavailable_without_reason", "duplicate_feature", "missing_waste_types", "uneven_shared_point", "invalid_identity", "invalid_counts", "coverage_bounds", "raw_frequency_bounds", "no_features")


@BOOK.add("adequacy_constraints", " union all ".join([*(f"select '{rule}' as rule, count(*) as violations from classed where {fault}" for rule, fault in PLANTED.items()), *(f"select '{rule}', 0" for rule in NO_FAULT)]), **V)
def _(spark, sf):
    f, broken = standin(spark, sf)[0], lambda k: F.col("feature_id") % k == 0
    f = f.withColumns({
        "distance_m": F.when(broken(9), -F.col("distance_m") - 1).otherwise(F.col("distance_m")), "reasons": F.when(broken(23), F.array(F.lit("because"), *[F.lit(r) for r in O.REASONS])).otherwise(F.col("reasons")),
        "suppressed": F.when(~broken(29), F.col("suppressed")), "long_access": F.when(~broken(31), F.col("long_access")), "sufficient_evidence": F.when(~broken(37), F.col("sufficient_evidence")),
        "area_ha": F.when(broken(41), -1.0).otherwise(F.col("area_ha")), "pressure": F.when(broken(43), float("inf")).otherwise(F.col("pressure")),
    })
    return O.adequacy_constraints(f)


@BOOK.add("artifact_constraints", """
    with streams as (select distinct month, waste_type from classed), assessed as (select distinct month, waste_type from classed where assessments > 0)
    select 'missing_prior' as rule, count(*) as violations from assessed where waste_type = 'Paper/plastic waste' union all select unnest(['unconverged_prior', 'prior_mean']), count(*) from assessed where waste_type = 'Glass waste'
    union all select 'prior_parameters', count(*) from assessed where waste_type = 'Mixed municipal waste' union all select 'missing_threshold', count(distinct waste_type) from streams where waste_type = 'Glass waste'
    union all select 'summary_points', count(*) from (select distinct month, waste_type from cnt where waste_type = 'Glass waste') union all select 'summary_level4', count(*) from (select distinct month, waste_type from cnt where waste_type = 'Mixed municipal waste')
    union all select 'missing_summary', count(*) from streams s where not exists (select 1 from cnt c where c.month = s.month and c.waste_type = s.waste_type)
    union all select 'category_totals', count(*) from (select distinct month, waste_type from classed where category = 'unavailable')
    union all select unnest(['repeated_prior', 'prior_points', 'summary_counts', 'threshold_value', 'policy_bounds']), 0""", **V)
def _(spark, sf):
    f, c, pts, thr = standin(spark, sf)
    f = materialize(f, "features")
    kind = lambda name: F.col("waste_type") == name
    glass, mixed = kind("Glass waste"), kind("Mixed municipal waste")
    priors = f.where("assessments > 0").select("month", "waste_type").distinct().where(~kind("Paper/plastic waste")).select(
        "month", "waste_type", F.when(mixed, 0.0).otherwise(1.0).alias("alpha"), F.lit(4.0).alias("beta"), F.lit(5.0).alias("concentration"), F.when(glass, 2.0).otherwise(0.2).alias("mean"), F.lit(3).alias("points"), (~glass).alias("converged"),
    )
    sums = O.point_summaries(counts(spark, sf, S.bins(spark, sf), pts), pts)
    sums = sums.withColumns({"assessed_points": F.when(glass, F.col("points") + 1).otherwise(F.col("assessed_points")), "level4_count": F.when(mixed, F.col("assessments") + 1).otherwise(F.col("level4_count"))})
    areas = O.category_quality(f).withColumn("areas", F.col("areas") + F.when(F.col("category") == "unavailable", 1).otherwise(0))
    return O.artifact_constraints(f, priors, sums, thr.where(~glass), areas, POLICY)


@BOOK.add("adequacy_catalog", """
    with d as (select distinct o_orderdate::date as day from orders),
      s as (select 'adequacy-' || strftime(date_trunc('month', day), '%Y-%m') as id, last_day(day) as period_end, '1' as schema_version, extract(month from day) % 4 <> 0 as complete from d group by all
        union all select 'adequacy-' || strftime(day, '%Y-%m-%d'), day, '2', false from d)
    select id, period_end, schema_version, complete from s where (schema_version = '1' and complete and period_end <= date '1997-01-20') or (schema_version = '2' and period_end = date '1997-01-20')""")
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    d = S.table(spark, sf, "orders").select(day.alias("day")).distinct()
    monthly = d.select(F.concat(F.lit("adequacy-"), F.date_format("day", "yyyy-MM")).alias("id"), F.last_day("day").alias("period_end"), F.lit("1").alias("schema_version"), (F.month("day") % 4 != 0).alias("complete")).distinct()
    dated = d.select(F.concat(F.lit("adequacy-"), F.col("day").cast("string")).alias("id"), F.col("day").alias("period_end"), F.lit("2").alias("schema_version"), F.lit(False).alias("complete"))
    return O.adequacy_catalog(monthly.unionByName(dated), date(1997, 1, 20))


@BOOK.add("adequacy_summary", f"""
    with f as (select * from classed where cell_id in (select id from cells where x0 <= 25.3 and x1 >= 25.1 and y0 <= 54.75 and y1 >= 54.65)),
      e as (select month, waste_type, count(*) as unique_serving_points, sum(point_bin_count)::bigint as point_bins, round(sum(point_capacity_m3), 3) as full_point_capacity_m3, sum(assessments)::bigint as assessments, sum(level4_count)::bigint as level4_count,
        count(*) filter (where assessments > 0) as assessed_points, count(*) filter (where sufficient_evidence) as sufficient_evidence_points, round(min(bin_coverage), 3) as bin_coverage_min, round(max(bin_coverage), 3) as bin_coverage_max,
        round(sum(level4_count)::double / nullif(sum(assessments), 0), 3) as raw_frequency
        from (select distinct month, waste_type, point_id, point_bin_count, point_capacity_m3, assessments, level4_count, sufficient_evidence, bin_coverage from f where point_id is not null) group by 1, 2)
    select a.*, e.* exclude (month, waste_type) from (select month, waste_type, count(*) as areas, count(residents) as known_population_areas, round(sum(residents), 3) as full_polygon_residents, {CATS} from f group by 1, 2) a
    join e on e.month = a.month and e.waste_type = a.waste_type""", digits=3, **V)
def _(spark, sf):
    f, c, _, _ = standin(spark, sf)
    return O.adequacy_summary(O.features_in(f, c, (25.1, 54.65, 25.3, 54.75)))


@BOOK.add("adequacy_listing", "select feature_id, category, round(residents, 3) as residents from classed where waste_type = 'Glass waste' and category = 'potential_shortage'", digits=3, **V)
def _(spark, sf):
    return O.adequacy_listing(standin(spark, sf)[0], "Glass waste", "potential_shortage").select("feature_id", "category", "residents")


@BOOK.add("adequacy_detail", "select 73::bigint as asked_id, c.feature_id, c.category, round(t.threshold, 4) as threshold, null::varchar as error from classed c left join thr t on t.waste_type = c.waste_type where feature_id = 73", digits=4, **V)
def _(spark, sf):
    f, _, _, thr = standin(spark, sf)
    return O.adequacy_detail(f, thr, 73).select("asked_id", "feature_id", "category", "threshold", "error")


@BOOK.add("policy_sensitivity", f"""
    with q as (select waste_type, quantile_cont(point_residents / capacity_m3, 0.75) as q75, quantile_cont(point_residents / capacity_m3, 0.8) as q80, quantile_cont(point_residents / capacity_m3, 0.9) as q90 from pts where point_residents > 0 group by 1),
      v as (select unnest(['pressure_75','pressure_90','access_200','access_500','evidence_loose','evidence_strict']) as variant, unnest([75,90,80,80,80,80]) as q, unnest([600.0,600,200,500,600,600]) as acc, unnest([5,5,5,5,3,10]) as n, unnest([3,3,3,3,2,5]) as d,
        unnest([0.5,0.5,0.5,0.5,0.25,0.75]) as c, unnest([0.9,0.9,0.9,0.9,0.8,0.95]) as p),
      r as (select f.*, v.variant, coalesce(pressure >= case v.q when 75 then q75 when 80 then q80 else q90 end, false) or coalesce(distance_m > v.acc, false) as sig, assessments >= v.n and assessed_days >= v.d and bin_coverage >= v.c as enough,
        coalesce(exceedance_probability >= v.p, false) as elev from classed f cross join v left join q on q.waste_type = f.waste_type),
      n as (select * exclude (category), category as old, case when not population_known or coalesce(residents, 0) = 0 or point_id is null then 'unavailable' when not enough then 'insufficient_evidence' when sig and elev then 'priority_shortage' when sig then 'potential_shortage'
        when elev then 'overflow_without_pressure' else 'ordinary' end as category from r)
    select month, variant, waste_type, count(*) as areas, count(*) filter (where old <> category) as changed_areas, round(coalesce(sum(coalesce(residents, 0)) filter (where old <> category), 0), 3) as changed_residents,
      count(distinct point_id) filter (where old <> category) as changed_points, {CATS} from n group by 1, 2, 3""", digits=3, **V)
def _(spark, sf):
    f, _, pts, _ = standin(spark, sf)
    return O.policy_sensitivity(f, pts, POLICY)
