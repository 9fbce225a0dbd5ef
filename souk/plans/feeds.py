"""Registered queries of sources, sinks, parsers and streaming jobs. Their input files are written by Spark from
the driver's tables, so work grows with those, and read back through the operators."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import text
from souk.operators import geo, joins, quality
from souk.sources import tables
from souk.streaming import jobs

from .market import r6, register, table


def folder_of(df: DataFrame, spark: SparkSession) -> str:
    path = tables.scratch(spark)
    tables.write_csv(df, path)
    return path


@register("select c_custkey, c_name, cast(c_nationkey as varchar) c_nationkey, case when c_acctbal > 0 then c_acctbal end c_acctbal from customer")
def csv_scan(spark, sf):
    """A CSV sink read back with explicit types, a numeric column as text."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return tables.csv(spark, folder_of(c, spark), "c_custkey long, c_name string, c_nationkey string, c_acctbal double")


@register("select 'present' source, count(*) n, max(n_name) last from nation union all select 'absent', 0, null")
def optional_scan(spark, sf):
    """A source that is there and one that is not, which is empty with its columns."""
    kind = "n_nationkey int, n_name string"
    there = tables.optional_csv(spark, folder_of(table(spark, sf, "nation").select("n_nationkey", "n_name"), spark), kind)
    absent = tables.optional_csv(spark, tables.scratch(spark), kind)
    count = lambda df, name: df.agg(F.count("*").alias("n"), F.max("n_name").alias("last")).select(F.lit(name).alias("source"), "n", "last")
    return count(there, "present").unionByName(count(absent, "absent"))


#: A place's size and spot in the plane for made geometries.
SPOT = "nation_spot as (select n_nationkey k, n_name, n_regionkey r, (n_nationkey % 5) * 2.0::double x0, (n_nationkey // 5) * 2.0::double y0 from nation)"


def nation_files(spark, sf) -> str:
    """GeoJSON documents, one for each region: squares with a hole, or two squares, tagged with a level."""
    n = table(spark, sf, "nation").withColumn("x0", F.col("n_nationkey") % 5 * 2.0).withColumn("y0", F.floor(F.col("n_nationkey") / 5) * 2.0)

    def square(a: float, z: float) -> str:
        at = lambda dx, dy: f"array(x0 + {dx + 0.005:.3f}D, y0 + {dy + 0.005:.3f}D)"
        return f"array({at(a, a)}, {at(z, a)}, {at(z, z)}, {at(a, z)}, {at(a, a)})"

    polygon, multi = f"array({square(0, 1.5)}, {square(0.5, 1)})", f"array(array({square(0, 1.5)}), array({square(1.6, 1.75)}))"
    coordinates = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.expr(multi))).otherwise(F.to_json(F.expr(polygon)))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("n_nationkey").alias("poly"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 1, "4").otherwise("5").alias("admin_level"))), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    docs = n.select("n_regionkey", feature.alias("f")).groupBy("n_regionkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("f")), ","), F.lit("]}")).alias("value"))
    path = tables.scratch(spark)
    docs.write.partitionBy("n_regionkey").text(path)
    return path


def nation_features(spark, sf) -> DataFrame:
    return tables.geojson(spark, nation_files(spark, sf), "poly:long,name:string,admin_level:string")


@register(f"""with {SPOT} select k poly, n_name as name, 8::int edges, x0 + 0.005 x_min, x0 + case when k % 3 = 0 then 1.755 else 1.505 end x_max, y0 + 0.005 y_min, y0 + case when k % 3 = 0 then 1.755 else 1.505 end y_max from nation_spot where k % 4 <> 1""")
def geojson_features(spark, sf):
    """Features of several files, of one level, flattened to edges and boxes."""
    return nation_features(spark, sf).where("admin_level = '5'").select("poly", "name", F.size("edges").alias("edges"), "x_min", "x_max", "y_min", "y_max")


@register(f"with {SPOT} select min(x0 + 0.005) x_min, max(x0 + case when k % 3 = 0 then 1.755 else 1.505 end) x_max, min(y0 + 0.005) y_min, max(y0 + case when k % 3 = 0 then 1.755 else 1.505 end) y_max from nation_spot")
def geometry_bounds(spark, sf):
    return tables.bounds(nation_features(spark, sf))


@register(f"""with {SPOT}, p as (select c_custkey id, (c_custkey * 37 % 997) / 100.0::double x, (c_custkey * 91 % 991) / 100.0::double y from customer),
q as (select *, x - x0 u, y - y0 v from p, nation_spot),
h as (select id, k from q where (u > 0.005 and u < 1.505 and v > 0.005 and v < 1.505 and not (k % 3 <> 0 and u > 0.505 and u < 1.005 and v > 0.505 and v < 1.005)) or (k % 3 = 0 and u > 1.605 and u < 1.755 and v > 1.605 and v < 1.755))
select k poly, count(*) points from h group by 1""")
def points_in_shapes(spark, sf):
    """Points in polygons with holes and in polygons of several parts, read from files."""
    c = table(spark, sf, "customer")
    pts = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 997 / 100.0).alias("x"), (F.col("c_custkey") * 91 % 991 / 100.0).alias("y"))
    return geo.locate(pts, nation_features(spark, sf)).where("poly is not null").groupBy("poly").agg(F.count("*").alias("points"))


@register("""with m as (select year(o_orderdate) jy, month(o_orderdate) jm, count(*) n, round(sum(o_totalprice), 0) v from orders group by 1, 2)
select jy, jm, case jm % 4 when 0 then v when 1 then v * 100 when 2 then v * 100000.0 else v * 1e6 end as value, case when jy < 1998 then 'early' else 'late' end source, case when jy >= 1998 and jm <> 3 then n::double end transactions from m""")
def transcriptions(spark, sf):
    """Two transcriptions of one series, a CSV file of the early years and a JSON document of records with units
    and sources, as one table."""
    m = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("jy"), F.month("o_orderdate").alias("jm")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("v"))
    unit = F.element_at(F.array(*map(F.lit, ("toman", "thousand_rial", "million_rial", "million_toman"))), F.col("jm") % 4 + 1)
    records = m.where("jy >= 1998").select(F.struct(F.lit("own").alias("series"), unit.alias("raw_unit"), F.col("v").alias("raw_value"), F.lit("b").alias("source_id"), (F.col("jy") * 100 + F.col("jm")).alias("month_jalali"), F.when(F.col("jm") != 3, F.col("n")).alias("transaction_count"), F.lit("ok").alias("quality")).alias("r"))
    other = records.limit(1).select(F.col("r").withField("series", F.lit("other")).alias("r"))
    doc = records.unionByName(other).agg(F.collect_list("r").alias("records")).withColumn("sources", F.expr("map('a', named_struct('title', 'none', 'url', ''), 'b', named_struct('title', 'late', 'url', 'https://late'))"))
    path = tables.scratch(spark)
    tables.write_document(doc, path)
    late = tables.observations(spark, path).where("series = 'own'").select("jy", "jm", "value", "source", F.col("transaction_count").alias("transactions"))
    scale = F.element_at(F.array(*map(F.lit, (1.0, 100.0, 100_000.0, 1e6))), F.col("jm") % 4 + 1)
    made = folder_of(m.where("jy < 1998").select((F.col("jy") * 100 + F.col("jm")).alias("Month"), (F.col("v") * scale).alias("Price")), spark)
    early = tables.csv(spark, made, "Month int, Price double").select(F.floor(F.col("Month") / 100).cast("int").alias("jy"), (F.col("Month") % 100).alias("jm"), F.col("Price").alias("value"), F.lit("early").alias("source"), F.lit(None).cast("double").alias("transactions"))
    return early.unionByName(late)


def cards(spark, sf) -> DataFrame:
    """Listing cards made from parts, with localised digits and unit words, as JSON payloads of 50 posts."""
    p = table(spark, sf, "part").withColumn("i", F.col("p_partkey") % 7)
    fa = lambda c: F.translate(c.cast("string"), text.DIGITS[:10], text.LOCAL_DIGITS[:10])
    field = lambda title, value: F.struct(F.lit(title).alias("title"), value.alias("value"))
    total = field("قیمت کل :", F.concat(fa(F.floor("p_retailprice")), F.lit(" میلیون تومان")))
    per = field("قیمت هر متر", F.concat(fa(F.col("p_size")), F.lit("٫۵ میلیون")))
    chip = lambda title, icon: F.struct(title.cast("string").alias("title"), icon.cast("string").alias("icon_url_light"))
    none = F.lit(None)
    items = F.array(chip(F.concat(fa(F.col("p_size") * 3), F.lit(" متر")), none), chip(F.when(F.col("i") == 0, F.lit("بدون اتاق")).otherwise(F.concat(fa(F.col("i")), F.lit(" اتاق"))), none), chip(F.when(F.col("p_size") > 40, F.lit("نوساز")).otherwise(F.concat(fa(F.col("p_size") % 30), F.lit(" سال"))), none), chip(none, F.when(F.col("i") > 2, F.lit("https://x/parking.png"))), chip(none, F.when(F.col("i") % 2 == 1, F.lit("https://x/elevator.png"))))
    card = F.struct(F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("t"), F.col("p_partkey"))).alias("token"), F.when(F.col("i") % 3 == 0, F.array(total, per)).otherwise(F.array(total)).alias("price_fields"), items.alias("chips"))
    pin = F.struct((F.col("p_partkey") * 37 % 997 / 100.0).alias("lat"), (F.col("p_partkey") * 91 % 991 / 100.0).alias("lon"), F.when(F.col("i") == 5, True).alias("approximate_location"))
    return p.groupBy(F.floor(F.col("p_partkey") / 50).alias("g")).agg(F.collect_list(F.struct(card.alias("map_post_card"), pin.alias("map_pin_feature"))).alias("posts"), F.count("*").cast("int").alias("count")).drop("g")  # 50 to a page


ADS = """ads as (select 't' || p_partkey token, (p_partkey * 37 % 997) / 100.0::double lat, (p_partkey * 91 % 991) / 100.0::double lon, case when p_partkey % 7 = 5 then 1 else 0 end approximate, floor(p_retailprice) * 1e6 price,
 case when p_partkey % 7 % 3 = 0 then (p_size + 0.5) * 1e6 else floor(p_retailprice) * 1e6 / (p_size * 3) end price_m2, p_size * 3.0::double size_m2, (p_partkey % 7)::double rooms, case when p_size > 40 then 0.0 else p_size % 30 end::double age_years, case when p_partkey % 7 > 2 then 1 else 0 end parking, p_partkey % 7 % 2 elevator, p_partkey from part where p_partkey % 11 <> 0)"""


@register(f"""with {ADS} select token, round(lat, 6) lat, round(lon, 6) lon, approximate, price, round(price_m2, 6) price_m2, size_m2, rooms, age_years, parking::int parking, elevator::int elevator,
 'قیمت کل=' || translate(cast(floor(price / 1e6)::bigint as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' میلیون تومان' || case when p_partkey % 7 % 3 = 0 then ' | قیمت هر متر=' || translate(cast((size_m2 / 3)::bigint as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || '٫۵ میلیون' else '' end price_text from ads""")
def card_ads(spark, sf):
    """Payload documents of listing cards parsed into ads."""
    path = tables.scratch(spark)
    tables.write_document(cards(spark, sf), path)
    got = tables.ads(tables.cards(spark.read.json(path, schema=tables.CARDS)))
    return got.select("token", *r6("lat", "lon"), "approximate", "price", *r6("price_m2"), "size_m2", "rooms", "age_years", "parking", "elevator", "price_text")


@register("""select s_suppkey id, 'place-' || s_suppkey slug, s_name as name, round(s_suppkey / 7.0, 5) lat, round(s_suppkey / 3.0, 5) lon, s_suppkey / 3.0 - 1 x_min, s_suppkey / 7.0 - 1 y_min, s_suppkey / 3.0 + 1 x_max, s_suppkey / 7.0 + 1 y_max from supplier where s_suppkey % 4 <> 0""")
def catalogue_places(spark, sf):
    """Catalogue documents flattened; places without a box are left out."""
    lat, lon = F.col("s_suppkey") / 7.0, F.col("s_suppkey") / 3.0
    place = F.struct(F.col("s_suppkey").alias("id"), F.concat(F.lit("place-"), F.col("s_suppkey")).alias("slug"), F.col("s_name").alias("name"), F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("centroid"), F.when(F.col("s_suppkey") % 4 != 0, F.array(lon - 1, lat - 1, lon + 1, lat + 1)).alias("bbox"))
    path = tables.scratch(spark)
    document = F.floor(F.col("s_suppkey") / 1000).alias("document")  # so many places each
    tables.write_document(table(spark, sf, "supplier").groupBy(document).agg(F.collect_list(place).alias("districts")).drop("document"), path)
    return tables.catalogue(spark, path, lines=True).select("id", "slug", "name", "lat", "lon", "x_min", "y_min", "x_max", "y_max")


@register("""select '{"n_name":"' || n_name || '"' || case when n_nationkey % 2 = 0 then ',"share":' || cast(round(n_nationkey / 8.0, 1) as varchar) else '' end || '}' as value from nation""")
def json_documents(spark, sf):
    """Records as JSON without their null fields, rounded field by field."""
    path = tables.scratch(spark)
    share = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 8.0).otherwise(F.when(F.col("n_nationkey") % 3 == 0, F.lit(float("nan"))))
    tables.write_document(table(spark, sf, "nation").select("n_name", share.alias("share")), path, {"share": 1})
    return spark.read.text(path)


@register("select count(*) n, sum(r_regionkey)::bigint keys from region")
def newest_source(spark, sf):
    """Of several files in a folder the one written last."""
    path = tables.scratch(spark)
    tables.write_csv(table(spark, sf, "nation").coalesce(1).select("n_nationkey", "n_name"), f"{path}/a")
    time.sleep(1.1)  # times of files may be whole seconds
    tables.write_csv(table(spark, sf, "region").coalesce(1).select("r_regionkey", "r_name"), f"{path}/b")
    last = tables.newest_file(spark, f"{path}/*", "text")
    return tables.csv(spark, last, "k int, name string").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@register("""with d as (select cast(ts as date) collected_on, event_type scope, count(*) n from events group by 1, 2) select collected_on, scope, case when day(collected_on) % 2 = 0 then n + 1000 else n end listings from d""")
def history_partitions(spark, sf):
    """Snapshots of all dates, then even days once more: a date's rows are replaced, others stay."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("collected_on"), F.col("event_type").alias("scope")).agg(F.count("*").alias("listings"))
    path = tables.scratch(spark)
    tables.write_history(d, path)
    tables.write_history(d.where(F.day("collected_on") % 2 == 0).withColumn("listings", F.col("listings") + 1000), path)
    return spark.read.parquet(path).select("collected_on", "scope", "listings")


@register("""with d as (select cast(ts as date) d, event_type scope, count(*) n from events group by 1, 2) select d collected_on, scope, n listings, coalesce(n < 0.5 * median(n) over (partition by scope order by d rows between 4 preceding and 1 preceding), false) as incomplete from d""")
def incomplete_snapshots(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("collected_on"), F.col("event_type").alias("scope")).agg(F.count("*").alias("listings"))
    return jobs.incomplete(d).select("collected_on", "scope", "listings", "incomplete")


@register("select props, try_cast(replace(replace(replace(cast(event_id as varchar) || ',000', '7', ''), '13', 'x'), ',', '') as double) as number, case when event_type = 'click' then 1 else 0 end::int clicked from events")
def parsed_numbers(spark, sf):
    """Numbers with thousands separators, bad ones null; a condition as 0 or 1."""
    t = F.replace(F.replace(F.concat(F.col("event_id"), F.lit(",000")), F.lit("7"), F.lit("")), F.lit("13"), F.lit("x"))
    return table(spark, sf, "events").select("props", quality.number(t).alias("number"), (F.col("event_type") == "click").cast("int").alias("clicked"))


def event_files(spark, sf, *by) -> str:
    """The events as Parquet files for a stream, rows of one ``by`` in one file."""
    path = tables.scratch(spark)
    table(spark, sf, "events").repartition(6, *by).write.parquet(path)
    return path


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@register("select event_type, count(distinct event_id) n, count(distinct user_id) users from events group by 1")
def stream_dedup(spark, sf):
    """Arriving files that overlap, deduplicated by key within a watermark, appended and read back."""
    path, out = event_files(spark, sf, F.col("event_id")), tables.scratch(spark)
    table(spark, sf, "events").where("event_id % 3 = 0").repartition(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 3).parquet(path)
    jobs.append_job(jobs.dedup(stream, ["event_id"], "ts", "3650 days"), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@register(f"""with d as (select cast(ts as date) d, event_type scope, count(*) n, median(value) v from events where event_type <> 'error' group by 1, 2)
select scope, cast(date_trunc('week', d) as date) "week", sum(n)::bigint n, round(sum(n * v) / sum(n), 6) level from d where v is not null group by 1, 2""")
def stream_weekly_levels(spark, sf):
    """A stream whose batches replace their dates in the history, and weekly levels from that history."""
    path, out = event_files(spark, sf, F.to_date("ts")), tables.scratch(spark)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(path).where("event_type <> 'error'")
    day = lambda b: b.groupBy(F.to_date("ts").alias("collected_on"), F.col("event_type").alias("scope")).agg(F.count("*").alias("listings"), F.median("value").alias("level"))
    jobs.history_job(stream, day, out, f"{out}-state").awaitTermination()
    return jobs.weekly_levels(spark.read.parquet(out)).select("scope", "week", "n", *r6("level"))


@register(f"""with d as (select cast(ts as date) d, event_type scope, count(*) n, median(value) v from events where event_type <> 'error' group by 1, 2)
select d collected_on, scope, n listings, round(v, 6) "level" from d""")
def stream_split_dates(spark, sf):
    """A stream whose batches hold parts of every date, each batch run twice; the history is that of whole dates."""
    path, out = event_files(spark, sf, F.col("event_id")), tables.scratch(spark)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(path).where("event_type <> 'error'")
    rows = stream.select(F.to_date("ts").alias("collected_on"), F.col("event_type").alias("scope"), "value")

    def twice(*batch):
        jobs.merge_counts(*batch)
        jobs.merge_counts(*batch)

    keys = ["collected_on", "scope"]
    jobs.counting_job(rows, out, f"{out}-state", keys, "value", twice).awaitTermination()
    return jobs.counted_history(spark, out, keys).select("collected_on", "scope", "listings", *r6("level"))


@register("""with d as (select cast(ts as date) d, event_type scope, count(*) n from events where event_type <> 'view' or day(ts) % 5 <> 0 or event_id % 4 = 0 group by 1, 2) select d collected_on, scope, n listings, coalesce(n < 0.5 * median(n) over (partition by scope order by d rows between 4 preceding and 1 preceding), false) as incomplete from d""")
def stream_incomplete(spark, sf):
    """Snapshots flagged as they arrive, in three runs of a stateful job that each go on from the one before; of every
    fifth day's views most are missing."""
    d = table(spark, sf, "events").where("event_type <> 'view' or day(ts) % 5 <> 0 or event_id % 4 = 0")
    d = tables.stored(d.groupBy(F.col("event_type").alias("scope"), F.to_date("ts").alias("collected_on")).agg(F.count("*").alias("listings")))
    path, out = tables.scratch(spark), tables.scratch(spark)
    for a, z in ((1, 9), (10, 20), (21, 31)):
        d.where(F.day("collected_on").between(a, z)).repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(d.schema).parquet(path)
        jobs.append_job(jobs.flag_incomplete(stream), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("collected_on", "scope", "listings", "incomplete")


@register(f"""with {ADS}, {SPOT} select k poly, count(*) n, round(median(price_m2), 6) level from ads join nation_spot on lon > x0 + 0.005 and lon < x0 + 1.505 and lat > y0 + 0.005 and lat < y0 + 1.505 where size_m2 between 20 and 120 and price_m2 between 5e6 and 1e8 group by 1""")
def stream_located_cards(spark, sf):
    """Arriving card payloads parsed, filtered and located by a stream-static join, then rolled up."""
    from .market import points

    path, out = tables.scratch(spark), tables.scratch(spark)
    cards(spark, sf).repartition(3).write.json(path)
    stream = spark.readStream.schema(tables.CARDS).option("maxFilesPerTrigger", 1).json(path)
    _, polygons = points(spark, sf)
    jobs.append_job(jobs.located_ads(stream, polygons, (20, 120), (5e6, 1e8)), out, f"{out}-state").awaitTermination()
    first = spark.read.parquet(out).groupBy("token", "price_m2").agg(F.min("poly").alias("poly"))
    return first.groupBy("poly").agg(F.count("*").alias("n"), F.round(F.median("price_m2"), 6).alias("level"))


@register("select 'without target' \"check\", count(*) n from customer where c_nationkey not in (select n_nationkey from nation where n_nationkey % 5 <> 0) union all select 'only in new', count(*) from part where p_partkey % 3 = 0 and p_partkey not in (select p_partkey from part where p_size > 25)")
def referential_checks(spark, sf):
    """Rows whose key has no target, and units that only the newer table has."""
    c, n, p = (table(spark, sf, x) for x in ("customer", "nation", "part"))
    lost = joins.only_in(c.withColumnRenamed("c_nationkey", "n_nationkey"), n.where("n_nationkey % 5 <> 0"), "n_nationkey")
    new = joins.only_in(p.where("p_partkey % 3 = 0"), p.where("p_size > 25"), "p_partkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return count(lost, "without target").unionByName(count(new, "only in new"))


@register("select event_id, value from (select *, row_number() over (order by md5(event_id || ':3'), event_id) i from events) where i <= 700")
def seeded_sample(spark, sf):
    """700 rows by the order of a hash of key and seed, the same on any partitioning."""
    return joins.seeded_sample(table(spark, sf, "events"), "event_id", 700, 3).select("event_id", "value")


def nested(inner: str, pairs) -> str:
    """replace() calls in SQL, the first pair innermost."""
    for old, new in pairs:
        inner = f"replace({inner}, '{old}', '{new}')"
    return inner


KEY_SQL = nested(nested("regexp_replace(lower(p_name), '[^a-z]', '', 'g')", text.TRANSLITERATION), [(2 * c, c) for c in "abcdefghijklmnopqrstuvwxyz"])


@register(f"""select p_partkey, {KEY_SQL} key, try_cast(nullif(regexp_extract(lower(p_name), '([0-9]+)', 1), '') as bigint) first_number, trim(replace(lower(p_name), 'part', '')) bare, length(p_name)::int chars from part""")
def name_keys(spark, sf):
    """Transliteration keys, first numbers and names without affixes."""
    n = F.lower("p_name")
    return table(spark, sf, "part").select("p_partkey", text.place_key(F.col("p_name")).alias("key"), text.first_integer(n).alias("first_number"), text.without(n, "part").alias("bare"), F.length(n).alias("chars"))


@register("""select s_suppkey, array_to_string(list_transform(string_split(replace(lower(s_name), '#', ' '), ' '), lambda w: case when w in ('e', 'va') then w else upper(w[1]) || w[2:] end), ' ') as name from supplier""")
def display_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.pretty(F.replace(F.lower("s_name"), F.lit("#"), F.lit("-"))).alias("name"))


@register("""with n as (select n_nationkey, lower(n_name) || case n_nationkey % 4 when 0 then ' county' when 1 then '-city' when 2 then '-new-town' else '' end label from nation) select n_nationkey, lower(n_name) bare from n join nation using (n_nationkey)""")
def bare_places(spark, sf):
    """Names without the words that say what kind of place it is."""
    kind = F.element_at(F.array(*map(F.lit, (" County", "-city", "-new-town", ""))), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf, "nation").select("n_nationkey", text.bare_place(F.concat("n_name", kind)).alias("bare"))


