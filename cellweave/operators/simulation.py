"""Stochastic catalogue: a counter-based stream draws years, days, templates, intensities and shifts.

A number depends on (seed, year, event, draw) only, so any task can make any part of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL

MODULUS, MULTIPLIER = 2147483647, 48271
LENGTH = 366
#: Parts of (0, 1) by which intervals are looked up, and years that one task draws.
PARTS, YEARS_A_TASK = 1024, 500
#: Cells of all templates, of 16 bytes each, up to which every task gets their shapes.
SHAPED = 2_000_000


def uniform(year: str, event: str, draw: int, seed: int = 42) -> str:
    """SQL text of a number in (0, 1): the counter through steps that multiply and square modulo a prime.

    Squares keep neighbouring counters from being a constant apart, as they are under multiplication alone.
    """
    x = f"(CAST({seed} AS BIGINT) * 69621 + {year} * CAST(7919 AS BIGINT) + {event} * CAST(104729 AS BIGINT) + CAST({draw} AS BIGINT) * 1299709 + 1)"
    for _ in range(2):
        x = f"(({x} % {MODULUS}) * {MULTIPLIER} % {MODULUS})"
        x = f"(({x} * {x} + {x}) % {MODULUS})"
    return f"((({x} * {MULTIPLIER} % {MODULUS}) + CAST(0.5 AS DOUBLE)) / {MODULUS})"


def normal(year: str, event: str, draw: int) -> str:
    """SQL text of a standard normal by Box and Muller, from draws ``draw`` and ``draw + 1``."""
    return f"(sqrt(-2 * ln({uniform(year, event, draw)})) * cos(2 * pi() * {uniform(year, event, draw + 1)}))"


def sigma(catalog: DataFrame, least: int = 10, default: float = 0.15) -> DataFrame:
    """One row: median over months 3 to 9 with ``least`` peaks of their coefficient of variation, clipped to 0.1..0.4."""
    months = catalog.where("peak_hail_mm > 0").groupBy(F.month("start_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("peak_hail_mm") / F.avg("peak_hail_mm")).alias("cv"))
    return months.where(F.col("month").between(3, 9) & (F.col("n") >= least)).agg(F.coalesce(F.least(F.greatest(F.median("cv"), F.lit(0.1)), F.lit(0.4)), F.lit(default)).alias("sigma"))


def doy_cdf(catalog: DataFrame, width: float = 10.0) -> DataFrame:
    """(doy, p, cdf): the circular histogram of start days under a Gaussian of ``width`` days, kernel out to 4 widths."""
    spark = catalog.sparkSession
    counts = catalog.groupBy("doy").agg(F.count(F.lit(1)).alias("n"))
    offsets = F.explode(F.sequence(F.lit(-int(4 * width)), F.lit(int(4 * width))))
    spread = counts.select("doy", "n", offsets.alias("d")).select((F.pmod(F.col("doy") + F.col("d") - 1, F.lit(LENGTH)) + 1).alias("doy"), (F.col("n") * F.exp(-(F.col("d") * F.col("d")) / (2 * width * width))).alias("w"))
    days = spark.range(1, LENGTH + 1).select(F.col("id").cast("int").alias("doy"))
    rows = days.join(spread.groupBy("doy").agg(F.sum("w").alias("w")), "doy", "left").fillna(0.0, ["w"])
    share = rows.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy()))
    return share.select("doy", "p", F.sum("p").over(Window.orderBy("doy")).alias("cdf"))


def yearly_counts(spark, rate, years: int) -> DataFrame:
    """(sim_year, n): Poisson counts by inverse transform over a table of the distribution function.

    ``rate`` is a scalar column. The table ends 12 deviations and 50 past the rate, where the function is 1 to the last
    bit, so no draw is cut.
    """
    top = F.ceil(rate + F.sqrt(rate) * 12 + 50).cast("long")
    k = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("k")).withColumn("rate", rate)
    logs = k.withColumn("lf", F.sum(F.ln(F.greatest("k", F.lit(1)))).over(Window.orderBy("k")))
    pmf = F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("lf"))
    table = logs.select("k", F.sum(pmf).over(Window.orderBy("k")).alias("cdf"))
    steps = table.select("k", F.coalesce(F.lag("cdf").over(Window.orderBy("k")), F.lit(0.0)).alias("lo"), "cdf")
    last = F.max("k").over(Window.partitionBy())
    steps = steps.withColumn("hi", F.when(F.col("k") == last, 1.0).otherwise(F.least("cdf", F.lit(1.0)))).where("lo < hi")
    drawn = spark.range(1, years + 1).select(F.col("id").alias("sim_year")).withColumn("u", F.expr(uniform("sim_year", "0", 0))).withColumn("_part", _part(F.col("u")))
    found = drawn.join(F.broadcast(_parted(steps, "lo", "hi")), "_part").where((F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi")))
    return found.select("sim_year", F.col("k").alias("n"))


def template_table(catalog: DataFrame, decay: float = 30.0) -> DataFrame:
    """(draw_doy, template_id, lo, hi): for each drawn day the cumulative shares exp(-circular days / decay).

    Weights depend on the drawn day alone, so drawing a template is a lookup by day and interval.
    """
    days = F.explode(F.sequence(F.lit(1), F.lit(LENGTH)))
    rows = catalog.select(F.col("event_id").alias("template_id"), "doy", days.alias("draw_doy"))
    d = F.abs(F.col("doy") - F.col("draw_doy"))
    rows = rows.withColumn("w", F.exp(-F.least(d, F.lit(LENGTH) - d) / decay))
    w = Window.partitionBy("draw_doy")
    upto = F.sum("w").over(w.orderBy("template_id")) / F.sum("w").over(w)
    rows = rows.withColumn("hi", upto)
    return rows.select("draw_doy", "template_id", F.coalesce(F.lag("hi").over(w.orderBy("template_id")), F.lit(0.0)).alias("lo"), "hi")


def _part(x):
    return F.floor(x * PARTS).cast("int")


def _parted(table: DataFrame, lo: str, hi: str) -> DataFrame:
    """``table`` with a row for each part that the interval from ``lo`` to ``hi`` touches: a number meets only the
    intervals of its part."""
    return table.withColumn("_part", F.explode(F.sequence(_part(F.col(lo)), _part(F.col(hi)))))


def simulate(catalog: DataFrame, years: int, fixed_sigma: float | None = None, shift_cells: float = 3.0, grow: float = 0.25, roll: int | None = None) -> DataFrame:
    """(sim_year, event_idx, draw_doy, template_id, scale, drow, dcol, grown) of every simulated event.

    The older catalogues are parameters: ``fixed_sigma`` for the intensity's deviation, ``shift_cells`` 0 for none, ``roll`` for
    shifts of up to so many rows and columns, each as likely as the others. A year's events are left in one task, so what is
    summed by year, with or without event or cell, needs no exchange.
    """
    spark, tasks = catalog.sparkSession, -(-years // YEARS_A_TASK)
    rate = catalog.agg(F.count(F.lit(1)) / F.count_distinct(F.year("start_date"))).scalar()
    events = yearly_counts(spark, rate, years).where("n > 0").repartition(tasks, "sim_year").select("sim_year", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("event_idx"))
    cdf = doy_cdf(catalog)
    steps = cdf.select(F.col("doy").alias("draw_doy"), F.coalesce(F.lag("cdf").over(Window.orderBy("doy")), F.lit(0.0)).alias("clo"), F.col("cdf").alias("chi"))
    drawn = events.withColumn("u", F.expr(uniform("sim_year", "event_idx", 1))).withColumn("_part", _part(F.col("u")))
    drawn = drawn.join(F.broadcast(_parted(steps, "clo", "chi")), "_part").where((F.col("u") > F.col("clo")) & (F.col("u") <= F.col("chi"))).drop("_part")
    drawn = drawn.withColumn("v", F.expr(uniform("sim_year", "event_idx", 2))).withColumn("_part", _part(F.col("v")))
    picked = drawn.join(_parted(template_table(catalog), "lo", "hi"), ["draw_doy", "_part"]).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = catalog.select(F.col("event_id").alias("template_id"), ((F.row_number().over(Window.orderBy("peak_hail_mm", "event_id")) - 1) / F.greatest(n - 1, F.lit(1))).alias("pct"))
    s = F.least(F.greatest(F.col("pct") * 0.15 + 0.10, F.lit(0.10)), F.greatest(F.lit(0.25), sigma(catalog).scalar()))
    s = s if fixed_sigma is None else F.lit(fixed_sigma)
    out = picked.join(F.broadcast(rank), "template_id").withColumn("scale", F.exp(s * F.expr(normal("sim_year", "event_idx", 3))))
    shift = lambda d: F.bround(F.expr(normal("sim_year", "event_idx", d)) * shift_cells).cast("int")
    if roll is not None:
        shift = lambda d: F.expr(rolled("sim_year", "event_idx", d, roll))
    return out.select("sim_year", "event_idx", "draw_doy", "template_id", "scale", shift(5).alias("drow"), shift(7).alias("dcol"), (F.expr(uniform("sim_year", "event_idx", 9)) < grow).alias("grown")).repartition(tasks, "sim_year")


def rolled(year: str, event: str, draw: int, most: int) -> str:
    """SQL text of a whole number from -most to most, all equally likely."""
    return f"CAST(least(floor({uniform(year, event, draw)} * {2 * most + 1}), {2 * most}) AS INT) - {most}"


def footprints(cells: DataFrame, damage: float, area_km2: float) -> DataFrame:
    """(sim_year, event_idx, n_cells, max_mm, mean_mm, footprint_km2) of the cells at or over ``damage``; an event that has none, by
    its intensity or because it left the grid, has no row."""
    hit = cells.where(F.col("mm") >= damage).groupBy("sim_year", "event_idx")
    return hit.agg(F.count(F.lit(1)).alias("n_cells"), F.max("mm").alias("max_mm"), F.avg("mm").alias("mean_mm"), (F.count(F.lit(1)) * F.lit(area_km2)).alias("footprint_km2"))


def template_shapes(cells: DataFrame) -> DataFrame:
    """(template_id, grown, rows, cols, mms): a template's cells in order, as they are and grown by half-intensity neighbours.

    Scaling and the ceiling keep the order of intensities and halving is exact, so the greatest of a cell's intensities can be
    taken here, once a template, and not in every event that is drawn from it.
    """
    shape = cells.select(F.col("event_id").alias("template_id"), *CELL, "mm")
    shell = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(f).alias("f")) for r, c, f in ((0, 0, 1.0), (-1, 0, 0.5), (1, 0, 0.5), (0, -1, 0.5), (0, 1, 0.5))))
    spread = shape.withColumn("x", F.explode(shell)).select("template_id", (F.col("cell_row") + F.col("x.r")).alias("cell_row"), (F.col("cell_col") + F.col("x.c")).alias("cell_col"), (F.col("mm") * F.col("x.f")).alias("mm"))
    wide = spread.groupBy("template_id", *CELL).agg(F.max("mm").alias("mm"))
    both = shape.withColumn("grown", F.lit(False)).unionByName(wide.withColumn("grown", F.lit(True)))
    packed = both.groupBy("template_id", "grown").agg(F.sort_array(F.collect_list(F.struct(*CELL, "mm"))).alias("x"))
    return packed.select("template_id", "grown", F.col("x.cell_row").alias("rows"), F.col("x.cell_col").alias("cols"), F.col("x.mm").alias("mms"))


def simulated_cells(events: DataFrame, cells: DataFrame, rows: int, cols: int, known_only: bool = True) -> DataFrame:
    """(sim_year, event_idx, cell, mm): scaled, shifted, some grown by half-intensity neighbours, inside the grid and, where
    ``known_only``, among the cells that were ever active.

    A row an event and cell, as a shape has each cell once. Events stay in the tasks they are in, as long as the templates
    have no more than ``SHAPED`` cells together; beyond, events meet their templates by an exchange.
    """
    shapes = template_shapes(cells)
    joined = events.join(F.broadcast(shapes) if cells.count() <= SHAPED else shapes, ["template_id", "grown"])
    spread = joined.select("sim_year", "event_idx", "scale", "drow", "dcol", "rows", "cols", F.posexplode("mms").alias("i", "mm"))
    placed = spread.select("sim_year", "event_idx", (F.col("rows")[F.col("i")] + F.col("drow")).alias("cell_row"), (F.col("cols")[F.col("i")] + F.col("dcol")).alias("cell_col"), F.least(F.col("mm") * F.col("scale"), F.lit(300.0)).alias("mm"))
    inside = placed.where(F.col("cell_row").between(0, rows - 1) & F.col("cell_col").between(0, cols - 1))
    return inside.join(F.broadcast(cells.select(*CELL).distinct()), CELL, "left_semi").select(*placed.columns) if known_only else inside


def empirical_levels(annual: DataFrame, years: int, periods: tuple[int, ...], extra: int = 0) -> DataFrame:
    """(rp, cell, mm): the annual maximum of rank max(1, int(years / rp)) in descending order, 0 past the nonzero ones.

    A cell has a value a year at most, so its window is bounded by the years, and the ranks asked for are picked where it ends.
    The older maps counted ranks from 0, which is ``extra`` 1.
    """
    ranks = {rp: max(1, years // rp) + extra for rp in periods}
    ranked = annual.select(*CELL, "mm", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("mm"))).alias("k"))
    found = ranked.groupBy(*CELL).agg(*(F.max(F.when(F.col("k") == k, F.col("mm"))).alias(f"_{rp}") for rp, k in ranks.items()))
    asked = F.explode(F.array(*(F.struct(F.lit(rp).alias("rp"), F.coalesce(f"_{rp}", F.lit(0.0)).alias("mm")) for rp in ranks)))
    return found.select(*CELL, asked.alias("x")).select("x.rp", *CELL, "x.mm")


def yearly_extremes(cells: DataFrame) -> DataFrame:
    """(sim_year, peak, peak_cells, n_cells, n_events) of simulated cells; peak_cells are the cells of the event that had the peak."""
    per_event = cells.groupBy("sim_year", "event_idx").agg(F.max("mm").alias("peak"), F.count_if(F.col("mm") >= 25.4).alias("n"))
    return per_event.groupBy("sim_year").agg(F.max("peak").alias("peak"), F.max_by("n", F.struct("peak", -F.col("event_idx"))).alias("peak_cells"), F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_events"))


def exceedance_table(per_year: DataFrame, years: int, periods: tuple[int, ...]) -> DataFrame:
    """(rp, peak, peak_cells, n_cells, n_events): each column of ``yearly_extremes`` sorted on its own over the years, so a row is
    not one year."""
    every = per_year.sparkSession.range(1, years + 1).select(F.col("id").alias("sim_year")).join(per_year, "sim_year", "left").fillna(0)
    asked = F.explode(F.array(*(F.struct(F.lit(rp).alias("rp"), F.lit(max(1, years // rp)).alias("k")) for rp in periods)))
    out = per_year.sparkSession.range(1).select(asked.alias("x")).select("x.*")
    for c in ("peak", "peak_cells", "n_cells", "n_events"):
        ranked = every.select(c, F.row_number().over(Window.orderBy(F.desc(c))).alias("k"))
        out = out.join(ranked, "k")
    return out.drop("k")
