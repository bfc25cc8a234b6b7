"""The catalogue as an application object, and the batch build from source files."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import dates, stats
from nightloom.operators import cohort, dedupe, facets, search
from nightloom.operators.predicates import Filters
from nightloom.sources import files

#: Results kept by a catalogue.
KEPT = 12


class Catalogue:
    """Rows with the facet columns (source, type, precision, legend, day, ...) and what is asked of them.

    Results are frames planned lazily; those asked for again come from a bounded
    cache by request, which ``replace`` empties. A request runs under a tag, so a
    superseded one can be cancelled.
    """

    def __init__(self, rows: DataFrame, text: str | None = None) -> None:
        self.rows, self.text, self.generation = rows, text, 0
        self._cache: OrderedDict[str, DataFrame] = OrderedDict()

    def replace(self, rows: DataFrame) -> None:
        """New rows: earlier results are stale."""
        self.rows, self.generation = rows, self.generation + 1
        self._cache.clear()

    def append(self, rows: DataFrame) -> None:
        self.replace(self.rows.unionByName(rows, allowMissingColumns=True))

    def _kept(self, what: str, request: object, build: Callable[[], DataFrame]) -> DataFrame:
        key = hashlib.sha1(json.dumps([what, request, self.generation], sort_keys=True, default=str).encode()).hexdigest()
        if key not in self._cache:
            self._cache[key] = build()
            while len(self._cache) > KEPT:
                self._cache.popitem(last=False)
        self._cache.move_to_end(key)
        return self._cache[key]

    def _searched(self, query: str) -> DataFrame:
        if not query:
            return self.rows
        return search.search(self.rows, self.text or "description", query)

    def facets(self, filters: Filters, query: str = "") -> DataFrame:
        return self._kept("facets", [asdict(filters), query], lambda: facets.drill_sideways(self._searched(query), filters))

    def ids(self, filters: Filters, query: str = "") -> DataFrame:
        return self._kept("ids", [asdict(filters), query], lambda: facets.filtered_ids(self._searched(query), filters))

    def analyse(self, filters: Filters, start: str, end: str, baseline: str, families: tuple[str, ...] = ("source", "type", "legend")) -> DataFrame:
        """family, key, counts of both sides, shares, interval, p and q of every category of every family; one shuffle.

        p and q are null where the baseline is descriptive.
        """

        def build() -> DataFrame:
            held = self.rows.where(Filters(filters.selected, filters.reject, filters.hide_low_precision, filters.exact_day_only, filters.legend).whole())
            sides = cohort.label_cohorts(held, "day", start, end, baseline)
            long = sides.select("active", "reference", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("key")) for f in families])).alias("x")).select("active", "reference", "x.*")
            n = long.groupBy("family", "key").agg(F.count_if("active").alias("a"), F.count_if("reference").alias("c")).where("a + c > 0")
            total = n.groupBy("family").agg(F.sum("a").alias("a_total"), F.sum("c").alias("c_total"))
            a, na, c, nc = (F.col(x) for x in ("a", "a_total", "c", "c_total"))
            low, high = stats.newcombe(a, na, c, nc)
            _, p = stats.two_proportions(a, na, c, nc)
            out = n.join(F.broadcast(total), "family").select("family", "key", "a", "c", stats.rate(a, na).alias("active_share"), stats.rate(c, nc).alias("reference_share"), low.alias("lower"), high.alias("upper"), p.alias("p"))
            if baseline == "full_catalog":
                return out.withColumns({"p": F.lit(None).cast("double"), "q": F.lit(None).cast("double")})
            return stats.benjamini_hochberg(out, "p", "key", ["family"])

        return self._kept("analysis", [asdict(filters), start, end, baseline, families], build)

    def run(self, frame: DataFrame, tag: str) -> list:
        """The rows of a result, as a job that ``cancel`` can end."""
        spark = frame.sparkSession
        spark.addTag(tag)
        try:
            return frame.collect()
        finally:
            spark.removeTag(tag)

    def cancel(self, tag: str) -> None:
        self.rows.sparkSession.interruptTag(tag)


def build_catalogue(spark: SparkSession, sources: dict[str, str], out: str, rows_per_file: int = 100_000) -> dict[str, DataFrame]:
    """Imports source files (path by adapter name), reads dates, removes exact duplicates and writes events, provenance and a manifest.

    An event keeps the record with a position, then the longest description, then
    a native id, then the greatest id; its provenance lists all its records.
    """
    every = reduce(DataFrame.unionByName, [files.import_records(spark, path, name).withColumn("source_name", F.lit(name.split(".")[0])) for name, path in sources.items()])
    dated = every.withColumn("d", dates.date_expression(F.col("date_raw")))
    rec = dated.select("*", F.col("d.start").alias("date_start"), F.col("d.end").alias("date_end"), F.col("d.sort").alias("day"), F.coalesce(F.col("d.precision"), F.lit("unknown")).alias("date_precision")).drop("d")
    key = dedupe.fingerprint(F.coalesce(F.col("day").cast("string"), F.col("date_raw")), F.col("time_raw"), F.col("location_raw"), F.coalesce("description", "summary"))
    keyed = rec.withColumn("id", F.col("canonical_input_id")).withColumn("fingerprint", F.coalesce(key, F.concat(F.lit("single_"), F.col("id"))))
    rank = F.struct(F.col("lat").isNotNull().alias("mapped"), F.length(F.coalesce("description", F.lit(""))).alias("chars"), F.col("native_id").isNotNull().alias("native"), F.col("id").alias("i"))
    kept = dedupe.exact_dedupe(keyed, F.col("fingerprint"), rank, ["id"]).withColumnRenamed("key", "fingerprint")
    events = keyed.join(kept, ["fingerprint", "id"]).drop("id", "_corrupt")
    provenance = keyed.select("fingerprint", "canonical_input_id", "source_name", F.col("_file").alias("source_file"), F.col("_row").alias("source_row_number"))
    listing = files.write_chunks(events, f"{out}/events", "canonical_input_id", rows_per_file)
    provenance.write.mode("overwrite").parquet(f"{out}/provenance")
    return {"events": spark.read.parquet(f"{out}/events"), "provenance": spark.read.parquet(f"{out}/provenance"), "manifest": listing}
