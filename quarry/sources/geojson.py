"""Line-wise GeoJSON of mapped places, as typed candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import representative, source_timestamp
from ..functions.text import normalize_name, present

#: Properties that are no tags, and the parts of an address in order.
META = ("@type", "@id", "@timestamp", "@version", "@changeset", "type", "id", "timestamp", "version", "changeset")
ADDRESS = ("addr:street", "addr:housenumber", "addr:suburb", "addr:city", "addr:state", "addr:postcode")


def read_features(spark: SparkSession, path: str, **place: str) -> DataFrame:
    """The features of a file or folder of GeoJSON lines (see ``features``)."""
    return features(spark.read.text(path), **place)


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def features(lines: DataFrame, city: str | None = None, state: str | None = None, country_code: str | None = None) -> DataFrame:
    """One row per valid feature of ``lines`` (column ``value``).

    Blank lines, lines that are no JSON, and features without type, id or usable
    geometry are left out; a record separator in front is taken off. Nested tags are
    merged into the flat ones, which win; values that are objects or lists are no tags.
    """
    text = F.trim(F.regexp_replace("value", "^\\x1E", ""))
    parsed = lines.select(text.alias("v")).where("v <> ''").select(_map(F.get_json_object("v", "$.properties")).alias("p"), F.get_json_object("v", "$.geometry.type").alias("kind"), F.get_json_object("v", "$.geometry.coordinates").alias("coordinates"))
    scalar = lambda k, v: v.isNotNull() & ~v.rlike("^\\s*[\\[{]")
    flat = F.map_filter("p", lambda k, v: ~k.isin(*META) & scalar(k, v))
    nested = F.map_filter(F.coalesce(_map(F.try_element_at("p", F.lit("tags"))), F.create_map().cast("map<string,string>")), scalar)
    tags = F.map_concat(F.map_filter(nested, lambda k, v: ~F.map_contains_key("flat", k)), F.col("flat"))
    of = lambda *keys: F.coalesce(*(present(F.try_element_at("p", F.lit(k))) for k in keys))
    number = F.regexp_extract(of("@id", "id"), "(\\d+)\\s*$", 1).try_cast("long")
    own = parsed.where("p IS NOT NULL").withColumn("flat", flat).withColumn("tags", tags)
    out = own.select(
        F.lower(F.trim(of("@type", "type"))).alias("osm_type"), number.alias("osm_id"), "tags", representative(F.col("kind"), F.col("coordinates")).alias("at"),
        source_timestamp(F.coalesce(F.try_element_at("p", F.lit("@timestamp")), F.try_element_at("p", F.lit("timestamp")))).alias("source_timestamp"),
    ).where("osm_type IS NOT NULL AND osm_id IS NOT NULL AND at IS NOT NULL")
    tag = lambda k: F.trim(present(F.try_element_at("tags", F.lit(k))))
    name = tag("name")
    return out.select(
        "osm_type", "osm_id", F.coalesce(name, F.lit("")).alias("name"), F.coalesce(normalize_name(name), F.lit("")).alias("normalized_name"), "tags",
        F.col("at.lat").alias("latitude"), F.col("at.lon").alias("longitude"), "source_timestamp", F.concat_ws(", ", *map(tag, ADDRESS)).alias("address"),
        F.lit(city).alias("city"), F.lit(state).alias("state"), F.lit(country_code).alias("country_code"),
    )


def category(tags: Column) -> Column:
    """beauty:, shop: or amenity: with its value, the first there is."""
    return F.coalesce(*(F.concat(F.lit(f"{k}:"), present(F.try_element_at(tags, F.lit(k)))) for k in ("beauty", "shop", "amenity")))


def quality_report(found: DataFrame) -> DataFrame:
    """One row: how many features of each kind there are, and how many have a time and a phone."""
    kinds = {k: F.count_if(F.col("osm_type") == k).alias(f"{k}s") for k in ("node", "way", "relation")}
    return found.agg(F.count("*").alias("features"), *kinds.values(), F.count_if(F.col("source_timestamp").isNotNull()).alias("with_time"), F.count_if(present(F.try_element_at("tags", F.lit("phone"))).isNotNull()).alias("with_phone"))
