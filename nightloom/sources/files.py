"""Readers and writers: delimited sources, text chronologies, JSON lines, chunked tables with manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.functions.text import join_present, stable_hash
from nightloom.functions.unknown import clean
from nightloom.session import small

_HASHED = ("date_raw", "time_raw", "location_raw", "description")


def read_delimited(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Delimited files with a header, all texts: broken rows in _corrupt as they stand, row numbers from 2 in the order of each file.

    With ``multi_line`` quoted line breaks are kept and a file is one task; without,
    files are split, a quoted break ends its row, and row numbers count over the
    splits of a file by their sizes.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "mode": "PERMISSIVE", "columnPruning": False}
    head = spark.read.csv(path, enforceSchema=False, **{k: v for k, v in options.items() if k != "columnPruning"})
    reader = spark.read.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).schema(head.schema.add("_corrupt", "string"))
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # a split's rows lie together in one partition, so ids count through it
    splits = rows.groupBy("_path", "_start").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    first = splits.select("_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 2).alias("_shift"))
    return rows.join(small(first), ["_path", "_start"]).select(*head.columns, "_corrupt", "_file", (F.col("_id") + F.col("_shift")).cast("int").alias("_row"))


def split_cells(line: Column, header: list[str]) -> Column:
    """cells by header name, extra cells beyond it and the anomaly (extra_columns, missing_columns or null) of a line; quoted cells may hold commas."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    cells = F.transform(quoted, lambda x: F.when(x.rlike(r'(?s)^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    n = len(header)
    names = F.array(*[F.lit(h) for h in header])
    width = F.least(F.size(cells), F.lit(n))
    return F.struct(
        F.map_from_arrays(F.slice(names, F.lit(1), width), F.slice(cells, F.lit(1), width)).alias("cells"),
        F.when(F.size(cells) > n, F.slice(cells, F.lit(n + 1), F.size(cells) - n)).otherwise(F.expr("cast(array() as array<string>)")).alias("extra"),
        F.when(F.size(cells) > n, "extra_columns").when(F.size(cells) < n, "missing_columns").alias("anomaly"),
    )


def _c(name: str) -> Column:
    return clean(F.col(f"`{name}`"))


def _pair(value: Column) -> tuple[Column, Column]:
    parts = F.split(value, r"\s*,\s*")
    return F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")


def _majestic() -> dict[str, Column]:
    lat, lon = _pair(_c("key_vals/LatLong"))
    return {"native_id": _c("source_id"), "date_raw": _c("date"), "time_raw": _c("time"), "location_raw": join_present(_c("location/0"), _c("key_vals/Country")), "country": _c("key_vals/Country"), "lat": lat, "lon": lon, "type_raw": _c("type/0"), "description": _c("desc"), "source_url": _c("key_vals/url")}


def _mufon() -> dict[str, Column]:
    when = F.split(F.regexp_replace(F.col("`Date/Time of Event`"), r"\\n", "\n"), "\n")
    place = F.regexp_replace(_c("Location of Event"), r"\\,", ",")
    return {"native_id": _c("No"), "date_raw": clean(F.try_element_at(when, F.lit(1))), "time_raw": clean(F.try_element_at(when, F.lit(2))), "location_raw": place, "summary": _c("Short Description"), "description": _c("Long Description"), "reported_date_raw": _c("Date Submitted")}


def _nuforc() -> dict[str, Column]:
    when = F.split(F.col("Occurred"), " ", 2)
    return {"native_id": _c("No"), "date_raw": clean(F.try_element_at(when, F.lit(1))), "time_raw": clean(F.try_element_at(when, F.lit(2))), "location_raw": _c("Location"), "shape_raw": _c("Shape"), "duration_raw": _c("Duration"), "description": _c("Description"), "reported_date_raw": _c("Reported"), "posted_date_raw": _c("Posted")}


def _phenomenainon() -> dict[str, Column]:
    return {"native_id": F.coalesce(_c("source_id"), _c("id")), "date_raw": _c("date"), "location_raw": F.coalesce(_c("location"), join_present(_c("city"), _c("country"))), "city": _c("city"), "country": _c("country"), "summary": _c("name"), "description": _c("description")}


def _ufocat() -> dict[str, Column]:
    n = lambda c: _c(c).try_cast("int")
    date = F.when(n("DAY").between(1, 31) & n("MO").between(1, 12), F.format_string("%04d-%02d-%02d", n("YEAR"), n("MO"), n("DAY"))).when(n("MO").between(1, 12), F.format_string("%04d-%02d", n("YEAR"), n("MO"))).otherwise(n("YEAR").cast("string"))
    lat, lon = _c("LATITUDE").try_cast("double"), _c("LONGITUDE").try_cast("double")
    # west longitudes are written without a sign there
    west = F.col("REGION").isin("USA", "CAN", "MEX") & (lon > 0)
    return {"native_id": _c("PRN"), "date_raw": date, "time_raw": _c("TIME"), "location_raw": join_present(_c("LOCATION"), _c("COUNTY"), _c("STATE"), _c("REGION")), "state_province": _c("STATE"), "country": _c("REGION"), "lat": lat, "lon": F.when(west, -lon).otherwise(lon), "type_raw": _c("TYPE"), "shape_raw": _c("SHAPE"), "duration_raw": _c("DUR"), "description": _c("NOTES")}


#: Adapters by file name.
ADAPTERS: dict[str, Callable[[], dict[str, Column]]] = {"majestic.csv": _majestic, "mufonpy.csv": _mufon, "nuforcpy.csv": _nuforc, "phenomenAInon_UPDB.csv": _phenomenainon, "ufocat2023.csv": _ufocat}

#: Columns of an imported record.
RECORD = ("native_id", "date_raw", "time_raw", "location_raw", "city", "state_province", "country", "lat", "lon", "shape_raw", "type_raw", "duration_raw", "description", "summary", "reported_date_raw", "posted_date_raw", "source_url")


def import_records(spark: SparkSession, path: str, adapter: str | None = None) -> DataFrame:
    """Records of a source file in the common columns, with an id from their content and place of origin.

    A row with more or fewer cells than the header keeps those it has under their
    names; anomaly says so, and extra has the cells beyond the header.
    """
    name = adapter or path.rstrip("/").rsplit("/", 1)[-1]
    cols = ADAPTERS[name]()
    rows = read_delimited(spark, path)
    shape = split_cells(F.col("_corrupt"), [c for c in rows.columns if c not in ("_corrupt", "_file", "_row")])
    out = rows.select("_file", "_row", shape["anomaly"].alias("anomaly"), shape["extra"].alias("extra"), *[(cols[c] if c in cols else F.lit(None)).cast("double" if c in ("lat", "lon") else "string").alias(c) for c in RECORD])
    row_hash = F.sha1(F.to_json(F.struct(*[F.col(c) for c in _HASHED]), {"ignoreNullFields": "false"}))
    return out.withColumn("row_hash", row_hash).withColumn("canonical_input_id", stable_hash("cin_", 24, file=F.col("_file"), native=F.col("native_id"), row=F.col("_row"), hash=F.col("row_hash")))


_HEADER = r"(?m)^(?=Event \S+ \([0-9a-f]{8}\)\s*$)"
_LABELS = ("Date", "End date", "Alternate date", "Location", "Locations", "Description", "Source", "Type", "Note", "Attributes", "Extra Data")


def read_chronology(spark: SparkSession, path: str) -> DataFrame:
    """Events of a text chronology: blocks that begin with 'Event id (hash)', labels as columns, references as an array.

    The nearest ``Year:`` heading before a block is its year_heading; labels not
    known stay in ``other``; a block without a date has the warning missing_date.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    blocks = whole.select("file", F.posexplode(F.split("value", _HEADER)).alias("pos", "block"))
    # a heading at the end of one block stands before the next
    headings = F.regexp_extract_all("block", F.lit(r"(?m)^Year:\s*(-?\d+)"), 1)
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = blocks.withColumn("_y", F.try_element_at(headings, F.lit(-1))).withColumn("year_heading", F.last("_y", ignorenulls=True).over(w))
    body = seen.where(F.col("block").rlike(r"^Event \S+ \([0-9a-f]{8}\)")).withColumn("block", F.regexp_replace("block", r"(?m)^Year:.*$", ""))
    label = r"(?:[A-Z][A-Za-z ]{2,20})"

    def field(name: str) -> Column:
        # up to the next label at the start of a line
        return clean(F.regexp_replace(F.regexp_extract("block", rf"(?ms)^{name}:\s*(.*?)(?=^{label}:|\Z)", 1), r"\s+", " "))

    refs = F.transform(F.regexp_extract_all("block", F.lit(rf"(?ms)^Reference:\s*(.*?)(?=^{label}:|\Z)"), 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    known = "|".join([*_LABELS, "Reference", "Year", "Event"])
    pairs = F.regexp_extract_all("block", F.lit(rf"(?m)^(?!(?:{known}):)({label}:[^\n]*)"), 1)
    other = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1), F.trim(F.regexp_replace(p, r"^[^:]*:", "")))))
    return body.select(
        "file", "pos", F.regexp_extract("block", r"^Event (\S+)", 1).alias("event_id"), F.regexp_extract("block", r"\(([0-9a-f]{8})\)", 1).alias("hash"), "year_heading",
        *[field(n).alias(n.lower().replace(" ", "_")) for n in _LABELS], refs.alias("references"), other.alias("other"),
        F.when(field("Date").isNull(), F.array(F.lit("missing_date"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, broken ones kept in _corrupt_record."""
    reader = spark.read.option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A delimited report with a fixed list of columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_chunks(df: DataFrame, path: str, order: str, rows_per_file: int) -> DataFrame:
    """Writes Parquet in ranges of ``order``, at most ``rows_per_file`` a file, and returns its manifest."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return manifest(df.sparkSession, path, order)


def manifest(spark: SparkSession, path: str, order: str) -> DataFrame:
    """file, first, last, rows and bytes of every file of a table."""
    t = spark.read.parquet(path)
    return t.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and SHA-256 of files."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def latest_by_key(cache: DataFrame, keys: list[str], at: str) -> DataFrame:
    """An append-only lookup reduced to the last write of each key."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_v")).select(*keys, "_v.*")


def dictionary_encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``df`` with label columns as codes, and the code table of each, in label order.

    A code is a rank over the distinct labels, which are few beside the rows.
    """
    tables = {}
    for c in columns:
        codes = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = codes.select(F.col(c).alias("label"), (F.row_number().over(Window.orderBy(c)) - 1).alias("code"))
        tables[c] = codes
        df = df.join(codes.select(F.col("label").alias(c), F.col("code").alias(f"{c}_code")), c, "left").drop(c)
    return df, tables
