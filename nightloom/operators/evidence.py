"""Co-occurrence, exposure lanes, crossings by cell, votes, cross-tabs of lists and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.geo import equal_area_cell, haversine_km
from nightloom.functions.stats import mantel_haenszel
from nightloom.operators.proximity import near_or_comparison
from nightloom.session import cut, small


def exposure_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """focal, neighbour, n: focal records that have a neighbour of a category, each category counted once a focal record.

    ``edges``: a, b undirected; ``labels``: id, label. Categories are made distinct
    per focal record before they are counted, so a record with many neighbours
    adds one row a category.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("neighbour")), "b").select("a", "neighbour").distinct()
    return near.join(labels.select(F.col("id").alias("a"), F.col("label").alias("focal")), "a").groupBy("focal", "neighbour").agg(F.count("*").alias("n"))


def shuffled_labels(rows: DataFrame, stratum: str, label: str, seed: int) -> DataFrame:
    """id, label with the labels of each stratum dealt out anew, in an order drawn from the ids and a seed."""
    by_id = Window.partitionBy(stratum).orderBy("id")
    drawn = Window.partitionBy(stratum).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    ids = rows.select("id", F.col(stratum).alias("_s"), F.row_number().over(by_id).alias("_k"))
    dealt = rows.select(F.col(stratum).alias("_s"), F.col(label).alias("label"), F.row_number().over(drawn).alias("_k"))
    return ids.join(dealt, ["_s", "_k"]).select("id", "label")


def dealt_codes(rows: DataFrame, stratum: str, draws: int) -> DataFrame:
    """id, codes: the code that each record gets in every draw, where draw s deals as ``shuffled_labels`` with seed s; ``rows``: id, stratum, code."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy("id"))
    drawn = Window.partitionBy("_s", "draw").orderBy("_h", "_k")
    ids = cut(rows.select("id", F.col(stratum).alias("_s"), "code", k.alias("_k")))
    all_draws = ids.select("id", "_s", "_k", "code", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("_s", "_k", "code", "draw", F.xxhash64("id", "draw").alias("_h"))
    dealt = all_draws.select("_s", "draw", "code", F.row_number().over(drawn).alias("_k")).groupBy("_s", "_k").agg(F.sort_array(F.collect_list(F.struct("draw", "code"))).alias("_d"))
    return ids.select("id", "_s", "_k").join(dealt, ["_s", "_k"]).select("id", F.col("_d.code").alias("codes"))


def expected_matrix(edges: DataFrame, rows: DataFrame, stratum: str, label: str, draws: int) -> DataFrame:
    """focal, neighbour, expected: the mean of ``exposure_matrix`` over labels shuffled within strata, all draws in one job.

    The categories around a focal record in a draw are bits of whole numbers, so
    a record with many neighbours adds one row a draw.
    """
    codes = cut(rows.select(F.col(label).alias("label")).distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("short").alias("code")))
    n = codes.count()
    hands = cut(dealt_codes(rows.join(small(codes), F.col(label) == F.col("label")).select("id", stratum, "code"), stratum, draws))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.select("a", "b", F.lit(False).alias("own")).union(both.select("a", F.col("a").alias("b"), F.lit(True).alias("own")).distinct())
    each = met.join(hands.withColumnRenamed("id", "b"), "b").select("a", "own", "codes").repartition("a").select("a", "own", F.posexplode("codes").alias("draw", "code"))
    words = [F.bit_or(F.when(~F.col("own") & (F.floor(F.col("code") / 62) == w), F.expr("shiftleft(1L, code % 62)"))).alias(f"_w{w}") for w in range((n + 61) // 62)]
    around = each.groupBy("a", "draw").agg(F.max(F.when(F.col("own"), F.col("code"))).alias("_f"), *words)
    names = [f"_w{w}" for w in range((n + 61) // 62)]
    sets = around.groupBy("_f", *names).agg(F.count("*").alias("n"))
    found = sets.select("_f", "n", F.explode(F.expr(f"filter(sequence(0, {max(n, 1) - 1}), c -> getbit(array({', '.join(names)})[int(c / 62)], c % 62) = 1)")).alias("_g")) if names else sets.select("_f", "n", F.lit(0).alias("_g"))
    f, g = codes.select(F.col("code").alias("_f"), F.col("label").alias("focal")), codes.select(F.col("code").cast("int").alias("_g"), F.col("label").alias("neighbour"))
    return found.groupBy("_f", "_g").agg((F.sum("n") / draws).alias("expected")).join(f, "_f").join(g, "_g").select("focal", "neighbour", "expected")


def cooccurrence(edges: DataFrame, rows: DataFrame, stratum: str, label: str, draws: int = 499) -> DataFrame:
    """focal, neighbour, observed, expected, effect: log2((O + 0.5) / (E + 0.5)) against labels shuffled within strata."""
    edges, rows = cut(edges), cut(rows.select("id", stratum, label))
    seen = exposure_matrix(edges, rows.select("id", F.col(label).alias("label"))).withColumnRenamed("n", "observed")
    mean = expected_matrix(edges, rows, stratum, label, draws)
    both = seen.join(mean, ["focal", "neighbour"], "full").select("focal", "neighbour", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
    return both.withColumn("effect", F.log2((F.col("observed") + 0.5) / (F.col("expected") + 0.5)))


def facility_lane(distances: DataFrame, category: str, stratum: str) -> DataFrame:
    """Odds of each category near a facility against a comparison ring, by Mantel-Haenszel over strata that have both.

    ``distances``: category, stratum, km. All categories share a stratum's totals.
    """
    lane = distances.select(category, stratum, near_or_comparison(F.col("km")).alias("lane")).where("lane is not null")
    n = lane.groupBy(stratum, category).agg(F.count_if(F.col("lane") == "near").alias("a"), F.count_if(F.col("lane") == "comparison").alias("c"))
    total = lane.groupBy(stratum).agg(F.count_if(F.col("lane") == "near").alias("a_total"), F.count_if(F.col("lane") == "comparison").alias("c_total"))
    # a stratum without the category still counts in its totals; strata and categories are labels, their pairs no more than a matrix of them
    grid = n.select(category).distinct().join(small(total))
    full = grid.join(n, [stratum, category], "left").fillna(0, ["a", "c"])
    return mantel_haenszel(full, [category])


# Least crossings, connectors and time bands, and greatest share of one connector, of the tiers of a cell.
CROSSING_TIERS = (("repeated_candidate", 20, 10, 3, 0.35), ("limited_candidate", 5, 4, 0, 0.60))


def connector_cells(segments: DataFrame, buffer_km: float = 0.0, rows: int = 12, columns: int = 24) -> DataFrame:
    """cell, connector, from_id, to_id: equal-area cells that segments run through, sampled three times a cell, without ``buffer_km`` at either end."""
    dx, dy = F.col("to_lon") - F.col("from_lon"), F.col("to_lat") - F.col("from_lat")
    km = haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    rise = F.abs(F.sin(F.radians("to_lat")) - F.sin(F.radians("from_lat"))) / 2 * rows
    s = segments.select("trace_id", "from_id", "to_id", "from_lat", "from_lon", dx.alias("_dx"), dy.alias("_dy"), F.try_divide(F.lit(buffer_km), km).alias("_trim"), F.greatest(F.lit(2), F.ceil(F.greatest(F.abs(dx) / 360 * columns, rise) * 3)).alias("_n")).where("_trim < 0.5")
    at = s.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    f = F.col("_trim") + (1 - 2 * F.col("_trim")) * F.col("_i") / F.col("_n")
    lon = F.pmod(F.col("from_lon") + F.col("_dx") * f + 180.0, F.lit(360.0)) - 180.0
    return at.select(equal_area_cell(F.col("from_lat") + F.col("_dy") * f, lon, rows, columns).alias("cell"), F.col("trace_id").alias("connector"), "from_id", "to_id").distinct()


def cell_opportunities(cells: DataFrame) -> DataFrame:
    """cell, opportunities: pairs of a cell's connectors (``connector_cells``) that share no end, counted without forming any."""
    pairs = lambda n: n * (n - 1) / 2
    n = cells.groupBy("cell").agg(pairs(F.count("*")).alias("_all"))
    ends = cells.select("cell", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("end")).groupBy("cell", "end").agg(F.count("*").alias("_n"))
    shared = ends.groupBy("cell").agg(F.sum(pairs(F.col("_n"))).alias("_shared"))
    return n.join(shared, "cell").select("cell", F.greatest(F.lit(0.0), F.col("_all") - F.col("_shared")).cast("long").alias("opportunities"))


def crossing_cells(crossings: DataFrame, bands: DataFrame, opportunities: DataFrame) -> DataFrame:
    """cell, crossings, connectors, bands, share, tier, opportunities, lift of crossing points (lat, lon, a, b) by equal-area cell.

    ``bands``: connector, band, the periods of each connector; ``opportunities`` by
    cell. share is the largest part of a cell's crossings that one connector takes;
    lift is (crossings + 0.5) / (expected + 0.5) at the rate over all cells.
    """
    at = crossings.select(equal_area_cell(F.col("lat"), F.col("lon")).alias("cell"), "a", "b")
    long = at.select("cell", F.explode(F.array("a", "b")).alias("connector")).groupBy("cell", "connector").agg(F.count("*").alias("n"))
    by = long.groupBy("cell").agg(F.count("*").alias("connectors"), F.max("n").alias("_most"), (F.sum("n") / 2).cast("long").alias("crossings"))
    period = long.join(bands, "connector").groupBy("cell").agg(F.countDistinct("band").alias("bands"))
    out = by.join(period, "cell", "left").join(opportunities, "cell", "left").fillna(0, ["bands", "opportunities"]).withColumn("share", F.col("_most") / F.col("crossings"))
    # one row each: the rate over all cells, those without a crossing included
    whole = opportunities.agg(F.sum("opportunities").alias("_o")).crossJoin(crossings.agg(F.count("*").alias("_c")))
    tier = F.lit("descriptive_only")
    for name, least, connectors, periods, share in reversed(CROSSING_TIERS):
        tier = F.when((F.col("crossings") >= least) & (F.col("connectors") >= connectors) & (F.col("bands") >= periods) & (F.col("share") <= share), name).otherwise(tier)
    lift = (F.col("crossings") + 0.5) / (F.col("opportunities") * F.try_divide("_c", "_o") + 0.5)
    return out.crossJoin(F.broadcast(whole)).select("cell", "crossings", "connectors", "bands", "share", tier.alias("tier"), "opportunities", lift.alias("lift"))


def majority_vote(votes: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, votes, status: the value most often given; blocked by a tie, conflicting if others were given too."""
    n = votes.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("votes"))
    ranked = n.groupBy(group).agg(F.max(F.struct("votes", value)).alias("top"), F.count("*").alias("values"), F.max("votes").alias("_m"))
    ties = n.join(ranked.select(group, F.col("_m").alias("votes")), [group, "votes"]).groupBy(group).agg(F.count("*").alias("leaders"))
    both = ranked.join(ties, group)
    status = F.when(F.col("leaders") > 1, "blocked").when(F.col("values") > 1, "conflict").otherwise("agreed")
    return both.select(group, F.when(F.col("leaders") == 1, F.col(f"top.{value}")).alias(value), F.col("_m").alias("votes"), status.alias("status"))


def list_crosstab(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """a, b, n of two array columns: a record counts once for each pair of its distinct values."""
    pairs = rows.select(key, F.explode(F.array_distinct(a)).alias(a), b).select(key, a, F.explode(F.array_distinct(b)).alias(b))
    return pairs.groupBy(a, b).agg(F.countDistinct(key).alias("n"))


def lane_pairs(rows: DataFrame, site: str, lane: str) -> DataFrame:
    """left, right, sites: pairs of lanes met at the same site, lesser first.

    Lanes of a site are made distinct first; the pairs of a site are as many as its
    lanes allow, and lanes are a short fixed list.
    """
    one = rows.select(site, lane).where(F.col(lane).isNotNull()).distinct()
    return one.select(site, F.col(lane).alias("left")).join(one.select(site, F.col(lane).alias("right")), site).where("left < right").groupBy("left", "right").agg(F.count("*").alias("sites"))


def period_counts(rows: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """period, n by the period of intervals; 'ambiguous' where one spans two, 'unknown' without both ends."""
    a, b = F.date_trunc(unit, start).cast("date"), F.date_trunc(unit, end).cast("date")
    period = F.when(F.col(start).isNull() | F.col(end).isNull(), "unknown").when(a != b, "ambiguous").otherwise(a.cast("string"))
    return rows.groupBy(period.alias("period")).agg(F.count("*").alias("n"))


def delay_bin(days: Column) -> Column:
    """Bin of a reporting delay."""
    out = F.lit("over_10_years")
    for bound, name in ((3652, "up_to_10_years"), (1826, "up_to_5_years"), (365, "up_to_year"), (90, "up_to_quarter"), (30, "up_to_month"), (7, "up_to_week"), (0, "same_day")):
        out = F.when(days <= bound, name).otherwise(out)
    return F.when(days < 0, "negative").when(days.isNotNull(), out)


def worklist(rows: DataFrame, query: str, score: str, key: str, samples: int = 10) -> DataFrame:
    """query, score, n, sample, rank: queries by summed score, count and name, each with its least ``samples`` keys.

    The sample is taken by rank within a query, not gathered and cut.
    """
    total = rows.groupBy(query).agg(F.sum(score).alias("score"), F.count("*").alias("n"))
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy(key))).where(F.col("_k") <= samples)
    sample = few.groupBy(query).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    order = Window.orderBy(F.desc("score"), F.desc("n"), query)
    return total.join(sample, query).withColumn("rank", F.row_number().over(order))


def category_connections(rows: DataFrame, km: float) -> DataFrame:
    """a, b, categories: consecutive records of a day and category within a distance, one row a pair with all its categories.

    ``rows``: id, day, category, at, lat, lon.
    """
    w = Window.partitionBy("day", "category").orderBy("at", "id")
    nxt = rows.withColumn("_n", F.lead(F.struct("id", "lat", "lon")).over(w)).where("_n is not null")
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("_n.lat"), F.col("_n.lon"))
    pairs = nxt.where((far <= km) & (F.col("id") != F.col("_n.id"))).select(F.least("id", "_n.id").alias("a"), F.greatest("id", "_n.id").alias("b"), "category")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def with_controls(report_days: DataFrame, anchors: DataFrame, window: int, shifts: tuple[int, ...], first: str, last: str) -> DataFrame:
    """anchor, role, n: reports within ``window`` days of each anchor and of its shifted control days inside the period.

    ``report_days``: day, n (one row a day); ``anchors``: id, day. Control windows
    that touch another anchor's window are left out.
    """
    days = anchors.select(F.col("id").alias("anchor"), F.explode(F.array(*[F.struct(F.date_add("day", s).alias("at"), F.lit("test" if s == 0 else "control").alias("role")) for s in (0, *shifts)])).alias("x")).select("anchor", "x.at", "x.role")
    inside = days.where((F.col("role") == "test") | ((F.date_add("at", -window) >= F.lit(first).cast("date")) & (F.date_add("at", window) <= F.lit(last).cast("date"))))
    spread = inside.select("anchor", "at", "role", F.explode(F.sequence(F.date_add("at", -window), F.date_add("at", window))).alias("day"))
    taken = anchors.select(F.explode(F.sequence(F.date_add("day", -window), F.date_add("day", window))).alias("day")).distinct()
    soiled = spread.where("role = 'control'").join(taken, "day").select("anchor", "at").distinct()
    clean = spread.join(soiled, ["anchor", "at"], "left_anti")
    return clean.join(report_days, "day", "left").groupBy("anchor", "role").agg(F.countDistinct("at").alias("windows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a position lies inside a ring of (lat, lon) corners, by the parity of crossings to its east."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        meets = lon < F.lit(x1) + (lat - y1) * ((x2 - x1) / ((y2 - y1) or 1e-300))
        crossings = crossings + F.when(spans & meets, 1).otherwise(0)
    return F.coalesce(crossings % 2 == 1, F.lit(False))


def key_values(value: Column) -> Column:
    """Map of a text like 'Key: "v", Other: w'; null for a blank one."""
    pairs = F.regexp_extract_all(value, F.lit(r'([A-Za-z][A-Za-z0-9 _]*:\s*(?:"[^"]*"|[^,"]+))'), 1)
    entry = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^:]*:\s*", ""), '"', ""))))
    return F.when(F.trim(value) != "", F.map_from_entries(entry))


def encode_token(state: Column) -> Column:
    """A struct as an address-safe token: base64 of its JSON without padding."""
    return F.concat(F.lit("v1."), F.rtrim(F.translate(F.base64(F.to_binary(F.to_json(state), F.lit("utf-8"))), "+/\r\n", "-_"), F.lit("=")))


def decode_token(token: Column, schema: str) -> Column:
    """The struct of a token; null for anything else."""
    body = F.translate(F.regexp_extract(token, r"^v1\.([A-Za-z0-9_-]+)$", 1), "-_", "+/")
    padded = F.rpad(body, F.length(body) + F.pmod(-F.length(body), F.lit(4)), F.lit("="))
    return F.when(body != "", F.from_json(F.unbase64(padded).cast("string"), schema))


def axis_order(label: Column, kind: str) -> Column:
    """Sort key of labels along an axis: months by the calendar, decades and numbers by value, unknown labels last."""
    # Month labels.
    months = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
    if kind == "month":
        place = F.array_position(F.array(*[F.lit(m) for m in months]), label)
        return F.when(place > 0, place).otherwise(99).cast("int")
    return F.coalesce(F.regexp_extract(label, r"^-?\d+", 0).try_cast("int"), F.lit(2**31 - 1))


def group_keys(rows: DataFrame, block: list[str], state: str, key: Column) -> DataFrame:
    """id, key for blocks whose known states are one at most; blocks in which states conflict give none."""
    fine = rows.groupBy(*block).agg(F.countDistinct(state).alias("_n")).where("_n <= 1").select(*block)
    return rows.join(fine, block).select("id", key.alias("key"))


def is_subset(left: DataFrame, right: DataFrame) -> bool:
    """Whether every row of ``left``, with its repetitions, is one of ``right``."""
    return left.exceptAll(right).isEmpty()


def apply_merges(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """``rows`` with those the plan merges (key, into) taken away and the number of merged ones beside each that stays."""
    gone = plan.select(key).distinct()
    into = plan.groupBy(F.col("into").alias(key)).agg(F.countDistinct(key).alias("merged"))
    return rows.join(gone, key, "left_anti").join(into, key, "left").withColumn("merged", F.coalesce("merged", F.lit(0)))


def without_collisions(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Pairs whose lineages (arrays) have nothing in common, and how many pairs each shared lineage took away."""
    shared = F.array_intersect(left, right)
    apart = pairs.where(~F.coalesce(F.arrays_overlap(left, right), F.lit(False)))
    return apart, pairs.select(F.explode(shared).alias("lineage")).groupBy("lineage").agg(F.count("*").alias("pairs"))


def role_exchange(counts: DataFrame, roles: int) -> DataFrame:
    """cell, observed, expected, z: observed counts against those of any role being the observed one, cluster by cluster.

    ``counts``: cluster, role ('observed' or a control's name), cell, n, without zeros.
    Were the roles of a cluster exchanged at random, its count in a cell would be
    each of its roles' with equal chance; clusters are independent, so means and
    variances add and nothing has to be drawn.
    """
    by = counts.groupBy("cluster", "cell").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.when(F.col("role") == "observed", F.col("n")).otherwise(0)).alias("o"))
    cell = by.groupBy("cell").agg(F.sum("o").alias("observed"), (F.sum("s") / roles).alias("expected"), F.sum(F.col("q") / roles - F.pow(F.col("s") / roles, 2)).alias("_v"))
    return cell.select("cell", "observed", "expected", F.when(F.col("_v") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("_v")).otherwise(0.0).alias("z"))


def block_bootstrap(blocks: DataFrame, expected: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """focal, neighbour, lower, upper: percentiles of log2((O + 0.5) / (E + 0.5)) when blocks are drawn with Poisson weights.

    ``blocks``: block, focal, neighbour, n. Each block has one weight a draw, from its
    name and the draw's number, so all its cells go together; sums are partial before
    the shuffle and no task gathers the blocks.
    """
    uniform = lambda k: (F.pmod(F.xxhash64("block", F.lit(seed), k), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Cumulative probabilities of a Poisson variable of mean 1.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)

    def weight(k: Column) -> Column:
        u, out = uniform(k), F.lit(0)
        for s in steps:
            out = out + F.when(u > s, 1).otherwise(0)
        return out

    drawn = blocks.select("block", "focal", "neighbour", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight(F.col("draw")))
    sums = drawn.groupBy("focal", "neighbour", "draw").agg(F.sum(F.col("n") * F.col("w")).alias("o"))
    effect = F.log2((F.col("o") + 0.5) / (F.col("expected") + 0.5))
    return sums.join(expected, ["focal", "neighbour"]).groupBy("focal", "neighbour").agg(F.percentile(effect, F.lit(0.025)).alias("lower"), F.percentile(effect, F.lit(0.975)).alias("upper"))


def citations(rows: DataFrame, codes: DataFrame, key: str, direct: str, indirect: str) -> DataFrame:
    """key, role, code, citation of a record's source codes, direct before indirect; unknown codes keep a null citation."""
    each = F.array(F.struct(F.lit("direct").alias("role"), F.upper(F.trim(direct)).alias("code")), F.struct(F.lit("indirect").alias("role"), F.upper(F.trim(indirect)).alias("code")))
    long = rows.select(key, F.explode(each).alias("x")).select(key, "x.*").where("code <> ''")
    return long.join(codes, "code", "left").select(key, "role", "code", "citation")
