"""Scans and sinks: explicit schemas, optional sources, GeoJSON, listing payloads, history partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import text

CARDS = "posts array<struct<map_post_card:struct<token:string,price_fields:array<struct<title:string,value:string>>,chips:array<struct<title:string,icon_url_light:string>>>,map_pin_feature:struct<lat:double,lon:double,approximate_location:boolean>>>, count int"
OBSERVATIONS = "records array<struct<series:string,raw_unit:string,raw_value:double,source_id:string,month_jalali:int,transaction_count:double,quality:string>>, sources map<string,struct<title:string,url:string>>"
SNAPSHOT = "collected_on date, scope string, listings long, ppm2 double, ppm2_p25 double, ppm2_p75 double"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file's rows, or an empty table with its columns where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scratch(spark: SparkSession) -> str:
    """A fresh folder name that driver and executors share: under spark.checkpoint.dir, or, where none is named
    and everything runs in one process, in a temporary folder."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        shared = tempfile.mkdtemp(prefix="spark-souk-")
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/souk-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read back: what follows sees one set of rows, however it is planned."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly to all cores, for work that multiplies or hashes the rows of a table that may lie in a
    single file or row group."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each feature of the files (one document each): its properties, the edges of all rings of its
    Polygon or MultiPolygon (holes too, for the even-odd test), their box, and the file it came from."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.json(path, schema=schema, multiLine=True).select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    one = "array<array<array<double>>>"
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, f"array<{one}>"))).otherwise(F.from_json(text, one))
    edge = lambda r, i: F.struct(F.get(r, i)[0].alias("x1"), F.get(r, i)[1].alias("y1"), F.get(r, i + 1)[0].alias("x2"), F.get(r, i + 1)[1].alias("y2"))
    out = f.select("file", "f.properties.*", F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: edge(r, i)))).alias("edges"))
    side = lambda c: F.transform("edges", lambda e: e[c])
    return out.withColumns({"x_min": F.array_min(side("x1")), "x_max": F.array_max(side("x1")), "y_min": F.array_min(side("y1")), "y_max": F.array_max(side("y1"))})


def bounds(df: DataFrame) -> DataFrame:
    """One row: the box of all features."""
    return df.agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))


def catalogue(spark: SparkSession, path: str, places: int = 5, lines: bool = False) -> DataFrame:
    """Places of catalogue documents (one a file; with lines, one a line) with their centroid (rounded) and box; those
    without a box are left out."""
    schema = "districts array<struct<id:long,slug:string,name:string,centroid:struct<latitude:double,longitude:double>,bbox:array<double>>>"
    x = spark.read.json(path, schema=schema, multiLine=not lines).select(F.explode("districts").alias("x")).where("size(x.bbox) = 4")
    box = [F.col("x.bbox")[i].alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return x.select("x.id", "x.slug", "x.name", F.round("x.centroid.latitude", places).alias("lat"), F.round("x.centroid.longitude", places).alias("lon"), *box)


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON document, as a row."""
    return spark.read.json(path, schema=schema, multiLine=True)


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Records with their source's title and url, in toman: thousands of rial are hundreds of toman; an unknown unit
    fails."""
    r = spark.read.json(path, schema=OBSERVATIONS, multiLine=True).select("sources", F.explode("records").alias("r"))
    scale = F.when(F.col("r.raw_unit") == "toman", 1.0).when(F.col("r.raw_unit") == "thousand_rial", 100.0).when(F.col("r.raw_unit") == "million_rial", 100_000.0).when(F.col("r.raw_unit") == "million_toman", 1e6).otherwise(F.raise_error(F.concat(F.lit("unknown unit "), F.col("r.raw_unit"))).cast("double"))
    source = F.element_at("sources", F.col("r.source_id"))
    return r.select("r.series", F.floor(F.col("r.month_jalali") / 100).cast("int").alias("jy"), (F.col("r.month_jalali") % 100).alias("jm"), (F.col("r.raw_value") * scale).alias("value"), "r.transaction_count", "r.quality", source["title"].alias("source"), source["url"].alias("url"))


def cards(df: DataFrame) -> DataFrame:
    """Listing payloads (batch or stream) as ads: token, place, price texts and chips."""
    p = df.select(F.explode("posts").alias("p"))
    return p.select("p.map_post_card.token", "p.map_post_card.price_fields", "p.map_post_card.chips", "p.map_pin_feature.lat", "p.map_pin_feature.lon", F.col("p.map_pin_feature.approximate_location").cast("int").alias("approximate")).where("token is not null")


def ads(cards_: DataFrame) -> DataFrame:
    """Ads of cards() with size, rooms, age, flags and prices read from their chips and texts."""
    with_chips = cards_.withColumn("c", text.chips(F.col("chips")))
    priced = with_chips.withColumn("p", text.card_prices(F.col("price_fields"), F.col("c.size_m2")))
    return priced.select("token", "lat", "lon", F.coalesce("approximate", F.lit(0)).alias("approximate"), "p.price", "p.price_m2", F.col("p.text").alias("price_text"), "c.*")


def newest_file(spark: SparkSession, path: str, fmt: str = "text") -> str | None:
    row = spark.read.format(fmt).load(path).select("_metadata.file_path", "_metadata.file_modification_time").agg(F.max_by("file_path", "file_modification_time")).first()
    return row[0]


def write_history(df: DataFrame, path: str, key: str = "collected_on") -> None:
    """Replaces the partitions of df's keys and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def rounded(df: DataFrame, places: dict[str, int]) -> list[Column]:
    """df's columns, rounded where places says so; NaN and infinity are null."""
    plain = lambda c: F.when(F.abs(c) < float("inf"), c)  # noqa: E731  (false for NaN, which Spark holds largest)
    return [F.round(plain(F.col(c)), places[c]).alias(c) if c in places else F.col(c) for c in df.columns]


def write_document(df: DataFrame, path: str, places: dict[str, int] | None = None) -> None:
    """One JSON object for each row, nulls left out."""
    df.select(*rounded(df, places or {})).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Tidy CSV with a header; nulls are empty fields."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""')
