"""The registered queries: each operator applied to the order tables in the role of registry files.

Numbers that are not exact are rounded, so that the order in which a sum was taken cannot show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.functions.windows import cum_from_age
from vitalcov.operators import checks, coverage as C, ddm as D, redistribute as R, tabulate as T
from vitalcov.operators.cumulate import cohort_mid_population, growth_rates
from vitalcov.plans import estimate as E
from vitalcov.plans import pipeline as P
from vitalcov.sources import dims, order_tables as O, scratch, tables

YEARS = (1996, 2000)
#: Infants and children apart, and two bands of ten years.
UNEVEN = (0, 1, 5, 10, 15, 20, 25, 30, 35, 45, 55, 60, 65, 70, 75, 80)
E_OPEN = {"Feminino": 8.0, "Masculino": 7.0}
# an illustrative table: any (ratio, e_open) steps do, the real ones come from the user's life tables
E_OPEN_LEVELS = {
    "Feminino": [(0.5, 9.0), (1.0, 8.0), (1.5, 7.0), (2.5, 5.0)],
    "Masculino": [(0.5, 8.0), (1.0, 7.0), (1.5, 6.5), (2.5, 4.5)],
}
CELL = list(T.CELL)
Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# building blocks -------------------------------------------------------------------------------


def death_counts(spark, d, years=None):
    return T.tabulate_events(T.slim_deaths(O.raw_deaths(spark, d, years), dims.SEX_LABELS))


def birth_counts(spark, d, years=None):
    return T.tabulate_events(T.slim_births(O.raw_births(spark, d, years), dims.SEX_LABELS))


def deaths(spark, d, years=None):
    return R.redistribute_unknown(death_counts(spark, d, years))


def births(spark, d, years=None):
    return R.redistribute_unknown(birth_counts(spark, d, years))


def uneven_deaths(spark, d):
    return R.redistribute_unknown(T.tabulate_events(T.slim_deaths(O.raw_deaths(spark, d, YEARS), dims.SEX_LABELS), breaks=UNEVEN))


def uneven_population(spark, d):
    return T.population_counts(O.raw_population(spark, d, YEARS, breaks=UNEVEN), YEARS)


def uneven_input(spark, d):
    return D.ddm_input(uneven_deaths(spark, d), uneven_population(spark, d), *YEARS, UNEVEN)


def population(spark, d, years=None):
    return T.population_counts(O.raw_population(spark, d, years), years)


def e_open(spark):
    return dims.e_open_table(spark, E_OPEN)


def smooth_years():
    return E.neighbour_years(YEARS)


def method_input(spark, d):
    return D.ddm_input(deaths(spark, d, YEARS), population(spark, d, YEARS), *YEARS)


def age_rows(spark, d):
    return E.age_rows(deaths(spark, d, YEARS), population(spark, d, YEARS), e_open(spark), *YEARS)


def estimates(spark, d):
    return E.estimate_birth_coverage(
        deaths(spark, d, YEARS), births(spark, d, YEARS), population(spark, d, YEARS), e_open(spark), YEARS
    )


# records and counts ----------------------------------------------------------------------------


def scan_slim(spark, d):
    return T.slim_deaths(O.raw_deaths(spark, d), dims.SEX_LABELS)


def scan_slim_births(spark, d):
    return T.slim_births(O.raw_births(spark, d), dims.SEX_LABELS)


def age_band(spark, d):
    return T.with_age_band(scan_slim(spark, d))


def age_band_breaks(spark, d):
    return T.with_breaks(scan_slim(spark, d), UNEVEN)


def tabulate_breaks(spark, d):
    return T.tabulate_events(scan_slim(spark, d), breaks=UNEVEN)


def decode_labels(spark, d):
    codebook = spark.sql("SELECT * FROM VALUES ('1', 'Masculino'), ('2', 'Feminino') AS t(sex_code, sex)")
    counted = T.count_by(T.slim_births(O.raw_births(spark, d), codebook), ["geo_code", "sex"])
    shown = C.label_sex(counted, {"Masculino": "m", "Feminino": "f"}, "unknown")
    cells = shown.groupBy("geo_code", "sex").agg(F.sum("n").alias("n"))
    return C.with_names(cells, O.geo_dim(spark, d)).select("geo_name", "geo_ord", "sex", "n")


def tabulate_deaths(spark, d):
    return death_counts(spark, d)


def tabulate_births(spark, d):
    return birth_counts(spark, d)


def tabulate_dirty(spark, d):
    """Codes of other lengths, with blanks, and records without a date of which some have their file's year."""
    return T.tabulate_events(T.slim_deaths(_dirty_deaths(spark, d), dims.SEX_LABELS))


def _dirty_deaths(spark, d):
    key = F.col("l_orderkey") + F.col("l_linenumber")
    raw = O.raw_deaths(spark, d, extra={"_key": key})
    code = F.col("mun_code")
    broken = (
        F.when(key_is(11, 0), F.substring(code, 1, 5)).when(key_is(11, 1), F.concat(code, F.lit("0")))
        .when(key_is(11, 2), F.concat(F.lit(" "), code, F.lit(" "))).when(key_is(11, 3), F.concat(F.lit("x"), F.substring(code, 2, 6))).otherwise(code)
    )
    undated = key_is(7, 0)
    return raw.withColumns(
        {
            "mun_code": broken,
            "year": F.when(~key_is(14, 0), F.year("death_date")),
            "death_date": F.when(~undated, F.col("death_date")),
        }
    )


def tabulate_hierarchy(spark, d):
    """Municipality, state, region and country in one pass, some codes being no codes."""
    records = T.slim_deaths(_dirty_deaths(spark, d), dims.SEX_LABELS, place=T.place_levels())
    return T.tabulate_hierarchy(records, ["municipality", "state", "region"])


def population_hierarchy(spark, d):
    zone = F.when(F.col("geo_code").cast("int") % 2 == 0, "even").otherwise("odd")
    return T.population_hierarchy(O.raw_population(spark, d, all_ages=True), {"state": F.col("geo_code"), "zone": zone})


def record_quality(spark, d):
    """Faults of death records, of which some are filed a year late, and of birth records."""
    late = _dirty_deaths(spark, d).withColumn("year", F.col("year") + F.when(key_is(17, 0), 1).otherwise(0))
    kinds = {"deaths": late, "births": O.raw_births(spark, d)}
    faults = [checks.record_quality(raw, kind, dims.SEX_LABELS) for kind, raw in kinds.items()]
    return faults[0].unionByName(faults[1])


def key_is(modulus, rest):
    return F.col("_key") % modulus == rest


def tabulate_by_nation(spark, d):
    """Another level of place: the nation in place of the state of the municipality."""
    raw = O.raw_deaths(spark, d, extra={"nation": F.lpad(F.col("n_nationkey").cast("string"), 2, "0")})
    return T.tabulate_events(T.slim_deaths(raw, dims.SEX_LABELS, place=F.col("nation")))


def missing_flags(spark, d):
    return R.flag_missing(death_counts(spark, d))


def split_measure(spark, d):
    known, unknown = R.split_measure(F.col("n").cast("double"), F.col("sex").isNull())
    return death_counts(spark, d).select(*CELL, known.alias("n_known"), unknown.alias("n_missing"))


def redistribute_deaths(spark, d):
    return _rounded(deaths(spark, d), 6, "n")


def redistribute_births(spark, d):
    return _rounded(births(spark, d), 6, "n")


def redistribution_mass(spark, d):
    return _rounded(R.redistribution_mass(death_counts(spark, d)), 4, "n_before", "n_after", "n_lost")


def population_total(spark, d):
    return T.population_counts(O.raw_population(spark, d, all_ages=True))


def reband_80(spark, d):
    return _rounded(T.rebands(deaths(spark, d)), 6, "n")


def mean_deaths(spark, d):
    return _rounded(T.mean_over_years(T.rebands(deaths(spark, d, YEARS)), YEARS), 6, "n")


def _sparse_deaths(spark, d):
    """Without some cells of one year or the other, so that they have deaths in one year only."""
    gone = (F.col("age_band") % 25 == 10) & (F.col("year") == F.when(F.col("sex") == "Feminino", YEARS[0]).otherwise(YEARS[1]))
    return deaths(spark, d, YEARS).where(~gone)


def mean_deaths_sparse(spark, d):
    cells = T.mean_over_years(T.rebands(_sparse_deaths(spark, d)), YEARS).withColumnRenamed("n", "mean_deaths")
    rows = D.ddm_input(_sparse_deaths(spark, d), population(spark, d, YEARS), *YEARS).select("geo_code", "sex", "age_band", "deaths")
    return _rounded(rows.join(cells, ["geo_code", "sex", "age_band"], "left"), 6, "deaths", "mean_deaths")


def births_total(spark, d):
    return _rounded(C.births_total(births(spark, d)), 6, "births")


# pairing and checks ----------------------------------------------------------------------------


def deaths_population(spark, d):
    cells = D.deaths_population(T.rebands(deaths(spark, d)), population(spark, d))
    return _rounded(cells, 6, "deaths")


def unmatched_keys(spark, d):
    return checks.unmatched_keys(T.rebands(death_counts(spark, d)), population(spark, d), CELL)


def missing_bands(spark, d):
    return checks.missing_bands(birth_counts(spark, d), D.BANDS)


def densify(spark, d):
    return T.densify(births(spark, d), {"n": F.col("n")}, D.BANDS).withColumn("n", F.round("n", 6))


def ddm_input(spark, d):
    return _rounded(method_input(spark, d), 6, "deaths")


# storage ---------------------------------------------------------------------------------------


def _stored(df, name, schema):
    path = scratch.shared_folder(df.sparkSession, name)
    tables.write_table(df, path, schema, rebalance=schema.endswith("_raw"))
    return path


def stored_deaths(spark, d):
    """All records written in folders of years, two years read back."""
    raw = O.raw_deaths(spark, d).withColumn("year", F.year("death_date"))
    return tables.read_deaths(spark, _stored(raw, "deaths", "deaths_raw"), YEARS)


def stored_births(spark, d):
    return tables.read_births(spark, _stored(O.raw_births(spark, d), "births", "births_raw"), YEARS)


def stored_population(spark, d):
    return tables.read_population(spark, _stored(O.raw_population(spark, d, all_ages=True), "population", "population_raw"), YEARS)


def stored_counts(spark, d):
    """Counts saved by one step and loaded by the next, which wants one year of them."""
    counts = tables.read_table(spark, _stored(death_counts(spark, d), "deaths_counts", "counts"), "counts")
    return counts.where(F.col("year") == YEARS[0])


# windows ---------------------------------------------------------------------------------------


def reverse_cumulative(spark, d):
    summed = cum_from_age(method_input(spark, d), ["pop1", "pop2", "deaths"])
    return _rounded(summed, 6, "deaths", "deaths_cum")


def growth(spark, d):
    return _rounded(growth_rates(method_input(spark, d)), 9, "rx").select("geo_code", "sex", "age_band", "rx")


def mid_population(spark, d):
    mid = cohort_mid_population(method_input(spark, d))
    return _rounded(mid, 6, "pop_mid").select("geo_code", "sex", "age_band", "pop_mid")


def moving_average_deaths(spark, d):
    return _rounded(E.smoothed_cells(deaths(spark, d), O.ALL_YEARS), 6, "n", "n_smooth")


def moving_average_births(spark, d):
    return _rounded(E.smoothed_cells(births(spark, d), O.ALL_YEARS), 6, "n", "n_smooth")


# methods ---------------------------------------------------------------------------------------


def ggb_points(spark, d):
    cols = ["arrivals", "exposure", "ggb_left", "ggb_right"]
    points = D.method_points(method_input(spark, d))
    return _rounded(points, 6, *cols).select("geo_code", "sex", "age_band", *cols)


def _ggb(spark, d, search):
    fitted = D.ggb(D.method_points(method_input(spark, d)), search)
    one = fitted.where(F.col("age_band") == 0).select("geo_code", "sex", "fit_lo", "fit_hi", "ggb", "delta")
    return _rounded(one, 9, "ggb", "delta")


def ggb_fit(spark, d):
    return _ggb(spark, d, D.FitSearch())


def ggb_fit_rms(spark, d):
    return _ggb(spark, d, D.FitSearch(criterion="rms"))


def seg(spark, d):
    rows = D.attach_e_open(method_input(spark, d), e_open(spark))
    rows = D.seg(D.method_points(rows))
    return _rounded(rows.where(F.col("age_band") == 0).select("geo_code", "sex", "seg"), 6, "seg")


def ggb_seg(spark, d):
    rows = D.attach_e_open(method_input(spark, d), e_open(spark))
    combined = D.ggb_seg(D.ggb(D.method_points(rows)))
    return _rounded(combined.where(F.col("age_band") == 0).select("geo_code", "sex", "ggbseg"), 9, "ggbseg")


def ggb_fit_custom(spark, d):
    """The run with the smallest mean distance from its line: a criterion that the library does not have."""

    def distance(ages, x, y, slope, intercept):
        return float(abs(y - slope * x - intercept).mean())

    return _ggb(spark, d, D.FitSearch(criterion=distance))


def _rescaled(spark, d, rescale):
    rows = D.attach_e_open(method_input(spark, d), e_open(spark))
    combined = D.ggb_seg(D.ggb(D.method_points(rows)), rescale=rescale)
    return _rounded(combined.where(F.col("age_band") == 0).select("geo_code", "sex", "ggbseg"), 9, "ggbseg")


def ggb_seg_second(spark, d):
    return _rescaled(spark, d, "second")


def ggb_seg_both(spark, d):
    return _rescaled(spark, d, "both")


def uneven_points(spark, d):
    rows = D.attach_e_open(uneven_input(spark, d), e_open(spark))
    return D.method_points(rows, bands=UNEVEN)


def ggb_points_uneven(spark, d):
    cols = ["arrivals", "exposure", "ggb_left", "ggb_right"]
    return _rounded(uneven_points(spark, d), 6, *cols).select("geo_code", "sex", "age_band", *cols)


def ggb_fit_uneven(spark, d):
    fitted = D.ggb(uneven_points(spark, d), bands=UNEVEN)
    one = fitted.where(F.col("age_band") == 0).select("geo_code", "sex", "fit_lo", "fit_hi", "ggb", "delta")
    return _rounded(one, 9, "ggb", "delta")


def seg_uneven(spark, d):
    rows = D.seg(uneven_points(spark, d))
    return _rounded(rows.where(F.col("age_band") == 0).select("geo_code", "sex", "seg"), 6, "seg")


def ggb_seg_uneven(spark, d):
    combined = D.ggb_seg(D.ggb(uneven_points(spark, d), bands=UNEVEN))
    return _rounded(combined.where(F.col("age_band") == 0).select("geo_code", "sex", "ggbseg"), 9, "ggbseg")


def mid_population_uneven(spark, d):
    mid = cohort_mid_population(uneven_input(spark, d), years=10)
    return _rounded(mid, 6, "pop_mid").select("geo_code", "sex", "age_band", "pop_mid")


def place_levels(spark, d):
    """Levels of their own for every place and sex, derived from the table by sex."""
    places = population(spark, d, YEARS).select("geo_code", "sex").distinct()
    shift = F.coalesce(F.col("geo_code").try_cast("int"), F.lit(0)) % 4 / 10
    steps = F.lit(None).cast("array<struct<ratio:double,e_open:double>>")
    for sex, known in E_OPEN_LEVELS.items():
        table = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(e).alias("e_open")) for r, e in known])
        steps = F.when(F.col("sex") == sex, table).otherwise(steps)
    rows = places.select("geo_code", "sex", F.inline(steps))
    return rows.select("geo_code", "sex", (F.col("ratio") + shift).alias("ratio"), (F.col("e_open") - shift).alias("e_open"))


def e_open_levels_by_place(spark, d):
    read = D.with_e_open(D.method_points(method_input(spark, d)), place_levels(spark, d))
    one = read.where(F.col("age_band") == 0).select("geo_code", "sex", "death_ratio", "e_open")
    return _rounded(one, 6, "death_ratio", "e_open")


def e_open_levels(spark, d):
    read = D.e_open_from_levels(D.method_points(method_input(spark, d)), dims.e_open_levels_table(spark, E_OPEN_LEVELS))
    one = read.where(F.col("age_band") == 0).select("geo_code", "sex", "death_ratio", "e_open")
    return _rounded(one, 6, "death_ratio", "e_open")


def death_coverage(spark, d):
    cover = D.death_coverage(age_rows(spark, d)).select("geo_code", "sex", *D.METHODS)
    return _rounded(cover, 6, *D.METHODS)


def choose_coverage(spark, d):
    return _rounded(D.death_coverage(age_rows(spark, d)).select("geo_code", "sex", "coverage"), 6, "coverage")


def methods_long(spark, d):
    return _rounded(D.coverage_long(D.death_coverage(age_rows(spark, d))), 6, "coverage")


def methods_long_short_list(spark, d):
    cover = D.death_coverage(age_rows(spark, d)).withColumn("mean", F.col("mean_2"))
    return _rounded(D.coverage_long(cover, ["ggb", "ggbseg", "mean"]), 6, "coverage")


def value_range(spark, d):
    long = D.coverage_long(D.death_coverage(age_rows(spark, d)))
    return _rounded(checks.value_range(long, "coverage"), 6, "min_value", "max_value")


# birth coverage --------------------------------------------------------------------------------


def adjust_deaths(spark, d):
    rows = age_rows(spark, d).select("geo_code", "sex", "age_band", "deaths_adj")
    return _rounded(rows, 4, "deaths_adj")


def adjust_deaths_joined(spark, d):
    """Corrected by a coverage that comes from elsewhere: here the share of the largest band."""
    rows = method_input(spark, d)
    coverage = rows.groupBy("geo_code", "sex").agg((F.max("deaths") / F.sum("deaths")).alias("coverage"))
    joined = C.adjust_deaths(rows, coverage)
    return _rounded(joined.select("geo_code", "sex", "age_band", "deaths_adj"), 4, "deaths_adj")


def implied_birth_profile(spark, d):
    profile = C.implied_birth_profile(age_rows(spark, d))
    out = _rounded(profile, 4, "deaths_cum", "pop_cum")
    return _rounded(out, 6, "cdr_adj", "rx", "birth_rate_implied")


def implied_birth_rate(spark, d):
    rate = C.implied_birth_rate(age_rows(spark, d))
    out = _rounded(rate, 4, "deaths_cum", "pop_cum")
    return _rounded(out, 6, "cdr_adj", "rx", "birth_rate_implied")


def birth_coverage(spark, d):
    cols = ["cbr", "birth_rate_implied", "coverage_b", "completeness"]
    return _rounded(estimates(spark, d), 6, *cols)


def birth_coverage_smoothed(spark, d):
    cols = ["cbr", "birth_rate_implied", "coverage_b", "completeness"]
    smooth = [E.smooth_counts(counts(spark, d, smooth_years()), smooth_years(), YEARS) for counts in (deaths, births)]
    return _rounded(
        E.estimate_birth_coverage(*smooth, population(spark, d, YEARS), e_open(spark), YEARS), 6, *cols
    )


def _with_settings(spark, d, table, settings):
    cols = ["cbr", "birth_rate_implied", "coverage_b", "completeness"]
    counts = [deaths(spark, d, YEARS), births(spark, d, YEARS), population(spark, d, YEARS)]
    return _rounded(E.estimate_birth_coverage(*counts, table, YEARS, settings), 6, *cols)


def birth_coverage_median(spark, d):
    return _with_settings(spark, d, e_open(spark), D.Settings(seg_ages=None, summary="median"))


def birth_coverage_levels(spark, d):
    return _with_settings(spark, d, dims.e_open_levels_table(spark, E_OPEN_LEVELS), D.Settings())


def birth_coverage_uneven(spark, d):
    cols = ["cbr", "birth_rate_implied", "coverage_b", "completeness"]
    counts = [uneven_deaths(spark, d), births(spark, d, YEARS), uneven_population(spark, d)]
    return _rounded(E.estimate_birth_coverage(*counts, e_open(spark), YEARS, D.Settings(bands=UNEVEN)), 6, *cols)


def compare_years(spark, d):
    return _rounded(C.compare_years(estimates(spark, d), *YEARS), 6, "coverage_y1", "coverage_y2")


def coverage_ratio(spark, d):
    out = C.coverage_ratio(estimates(spark, d), *YEARS)
    return _rounded(out, 6, "coverage_y1", "coverage_y2", "ratio")


def region_result(spark, d):
    ratios = C.coverage_ratio(estimates(spark, d), *YEARS)
    out = C.attach_regions(ratios, O.geo_dim(spark, d), O.regions(spark, d))
    return _rounded(out, 6, "coverage_y1", "coverage_y2", "ratio").withColumn("geometry", F.hex("geometry"))


def display_order(spark, d):
    """The sorted table, with the place of each row in it."""
    shown = P.display_order(estimates(spark, d), O.geo_dim(spark, d)).select("geo_ord", "geo_name", "sex", "year", "coverage_b")
    return _rounded(shown, 6, "coverage_b")


def state_names(spark, d):
    """The fixed table of places, one more with a quote in its name, beside the births counted for them."""
    places = dims.geo_dim(spark, (*dims.STATES, ("00", "Sant'Ana d'Oeste")))
    counted = birth_counts(spark, d).groupBy("geo_code").agg(F.sum("n").alias("n"))
    return C.with_names(places.select("geo_code").join(counted, "geo_code", "left"), places)


QUERIES: dict[str, Query] = {
    "scan_slim": scan_slim,
    "scan_slim_births": scan_slim_births,
    "age_band": age_band,
    "decode_labels": decode_labels,
    "tabulate_deaths": tabulate_deaths,
    "tabulate_births": tabulate_births,
    "tabulate_dirty": tabulate_dirty,
    "tabulate_by_nation": tabulate_by_nation,
    "missing_flags": missing_flags,
    "split_measure": split_measure,
    "redistribute_deaths": redistribute_deaths,
    "redistribute_births": redistribute_births,
    "redistribution_mass": redistribution_mass,
    "population_total": population_total,
    "reband_80": reband_80,
    "mean_deaths": mean_deaths,
    "mean_deaths_sparse": mean_deaths_sparse,
    "births_total": births_total,
    "deaths_population": deaths_population,
    "unmatched_keys": unmatched_keys,
    "missing_bands": missing_bands,
    "densify": densify,
    "ddm_input": ddm_input,
    "reverse_cumulative": reverse_cumulative,
    "growth_rates": growth,
    "mid_population": mid_population,
    "moving_average_deaths": moving_average_deaths,
    "moving_average_births": moving_average_births,
    "ggb_points": ggb_points,
    "ggb_fit": ggb_fit,
    "ggb_fit_rms": ggb_fit_rms,
    "seg": seg,
    "ggb_seg": ggb_seg,
    "e_open_levels": e_open_levels,
    "death_coverage": death_coverage,
    "choose_coverage": choose_coverage,
    "methods_long": methods_long,
    "methods_long_short_list": methods_long_short_list,
    "value_range": value_range,
    "adjust_deaths": adjust_deaths,
    "adjust_deaths_joined": adjust_deaths_joined,
    "implied_birth_profile": implied_birth_profile,
    "implied_birth_rate": implied_birth_rate,
    "birth_coverage": birth_coverage,
    "birth_coverage_smoothed": birth_coverage_smoothed,
    "birth_coverage_median": birth_coverage_median,
    "birth_coverage_levels": birth_coverage_levels,
    "compare_years": compare_years,
    "coverage_ratio": coverage_ratio,
    "region_result": region_result,
    "display_order": display_order,
    "state_names": state_names,
    "age_band_breaks": age_band_breaks,
    "tabulate_breaks": tabulate_breaks,
    "ggb_points_uneven": ggb_points_uneven,
    "ggb_fit_uneven": ggb_fit_uneven,
    "seg_uneven": seg_uneven,
    "ggb_seg_uneven": ggb_seg_uneven,
    "mid_population_uneven": mid_population_uneven,
    "birth_coverage_uneven": birth_coverage_uneven,
    "ggb_seg_second": ggb_seg_second,
    "ggb_seg_both": ggb_seg_both,
    "ggb_fit_custom": ggb_fit_custom,
    "tabulate_hierarchy": tabulate_hierarchy,
    "population_hierarchy": population_hierarchy,
    "record_quality": record_quality,
    "e_open_levels_by_place": e_open_levels_by_place,
    "stored_deaths": stored_deaths,
    "stored_births": stored_births,
    "stored_population": stored_population,
    "stored_counts": stored_counts,
}
