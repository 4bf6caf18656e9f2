"""Contacts of places out of pages at hand: tags, the site, what it names as its own, contact pages, link collections, social pages.

Pages are a table; a place's links are joined with it. What a page says is read once,
whoever asks for it, and a place takes the first phone and the first Instagram name
along its links, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import instagram_user, normalize_url, present

#: Tags of websites and social pages in order, and the names of sources.
SOCIAL_TAGS = ("contact:facebook", "facebook", "contact:telegram", "telegram")
SOURCES = {"SITE": "OSM_WEBSITE", "CONTACT": "OSM_WEBSITE_CONTACT_PAGE", "HUB": "OSM_WEBSITE_CONTACT_HUB", "FACEBOOK": "OSM_DIRECT_SOCIAL", "SOCIAL": "OSM_DIRECT_SOCIAL"}
WEBSITE_TAGS = ("contact:website", "website", "url")
LINK = "struct<rank:int,kind:string,url:string>"
CONTACT = "struct<value:string,source:string,url:string>"


def _first_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.trim(present(F.try_element_at(tags, F.lit(k)))) for k in keys))


def _links(urls: Column, first: int, kind) -> Column:
    """An array of links with ranks from ``first`` on; those without a kind are left out."""
    ranked = F.transform(urls, lambda u, i: F.struct((i + first).cast("int").alias("rank"), kind(u).alias("kind"), u.alias("url")))
    return F.coalesce(F.filter(ranked, lambda x: x["kind"].isNotNull()), F.array()).cast(f"array<{LINK}>")


def named_kind(url: Column) -> Column:
    """What a link named as the same is: an Instagram name, a link collection, a Facebook page, or nothing that is looked at."""
    u = F.lower(url)
    return F.when(u.contains("instagram.com"), "NAMED").when(html.is_hub(url), "HUB").when(u.contains("facebook.com") | u.contains("fb.com"), "FACEBOOK")


def enrich(places: DataFrame, pages: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per place: id, ``phone`` and ``instagram`` (``value``, ``source``, ``url``), ``website``, ``official_text``, ``direct_phone``, ``direct_instagram``.

    ``places``: tags, name, country_code. ``pages``: url, html and, where the visible
    text is at hand, text; of several with one url the least html counts, one that
    isn't there says nothing. Links are followed
    in this order, as long as phone or Instagram is missing: the website; what its
    JSON-LD names as the same (an Instagram name if that is missing, a Facebook page
    if the phone is); two contact pages; three link collections; the website if it is
    one itself; the social page of the tags. The text is the place's name and what
    the pages that were looked at say, 20,000 characters at most. Ids must be there
    and tell places apart.
    """
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    direct = instagram_user(F.coalesce(*(present(F.try_element_at(tags, F.lit(k))) for k in ("contact:instagram", "instagram"))))
    social = F.coalesce(*(F.trim(present(F.try_element_at(tags, F.lit(k)))) for k in SOCIAL_TAGS))
    phone = html.tag_phone(tags, F.col("country_code"))
    own = places.select(
        F.col(id_col).alias("id"), "name", F.col("country_code").alias("cc"), F.when(phone.isNotNull(), F.struct(phone["number"].alias("value"), phone["source"].alias("source"), F.lit(None).cast("string").alias("url"))).cast(CONTACT).alias("phone"),
        F.when(direct.isNotNull(), F.struct(direct.alias("value"), F.lit("DIRECT_OSM_INSTAGRAM").alias("source"), F.lit(None).cast("string").alias("url"))).cast(CONTACT).alias("instagram"),
        normalize_url(_first_tag(tags, WEBSITE_TAGS)).alias("website"), F.when(social.startswith("http"), normalize_url(social)).alias("social"),
    )
    open_ = own.where("phone IS NULL OR instagram IS NULL").select("id", "cc", "website", "social")
    told = pages.select("url", "html", F.col("text") if "text" in pages.columns else F.lit(None).cast("string").alias("text")).where("html IS NOT NULL")
    read = lambda asked: asked.join(told.join(asked.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min(F.struct("html", "text")).alias("p")), "url").select(*asked.columns, "p.html", "p.text")
    # the links of each site, found once
    sites = read(open_.select(F.col("website").alias("url")).where("url IS NOT NULL").distinct())
    found = sites.select("url", F.concat(_links(html.same_as(F.col("html")), 100, named_kind), _links(html.contact_links(F.col("url"), F.col("html")), 200, lambda u: F.lit("CONTACT")), _links(html.hub_links(F.col("url"), F.col("html")), 300, lambda u: F.lit("HUB"))).alias("links"))
    one = lambda rank, kind, url, when: F.when(when, F.array(F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), url.alias("url")))).otherwise(F.array().cast(f"array<{LINK}>"))
    site, tag = F.col("website"), F.col("social")
    links = open_.join(found, F.col("website") == F.col("url"), "left").select(
        "id", "cc", "website", F.explode(F.concat(one(0, "SITE", site, site.isNotNull()), F.coalesce("links", F.array().cast(f"array<{LINK}>")), one(400, "HUB", site, html.is_hub(site)), one(500, "SOCIAL", tag, tag.isNotNull()))).alias("l")
    ).select("id", "cc", "website", "l.rank", "l.kind", "l.url")
    # what a page says to those of one country, read once
    asked = links.where("kind <> 'NAMED'").select("url", "cc").distinct()
    number = html.first_phone(F.col("html"), F.col("cc"), "")
    facts = read(asked).withColumn("n", number).select(F.col("url").alias("u"), F.col("cc").alias("c"), F.col("n.number").alias("number"), F.col("n.source").alias("how"), html.first_instagram(F.col("html")).alias("handle"), F.coalesce("text", html.visible_text(F.col("html"))).alias("text"))
    seen = links.join(facts, (F.col("url") == F.col("u")) & F.col("cc").eqNullSafe(F.col("c")), "left")
    named = F.col("kind") == "NAMED"
    source = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))[F.col("kind")]
    steps = seen.select(
        "id", "rank", "kind", F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("value"), F.concat(source, "how").alias("source"), F.col("url"))).cast(CONTACT).alias("phone"),
        F.when(named, F.when(instagram_user(F.col("url")).isNotNull(), F.struct(instagram_user(F.col("url")).alias("value"), F.lit("OSM_WEBSITE_SAMEAS_SOCIAL").alias("source"), F.col("website").alias("url")))).when(F.col("handle").isNotNull(), F.struct(F.col("handle").alias("value"), source.alias("source"), F.col("url"))).cast(CONTACT).alias("instagram"),
        F.col("text"),
    )
    gathered = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "kind", "phone", "instagram", "text"))).alias("steps"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["phone"].isNotNull() & acc["instagram"].isNotNull()
        looked = ~done & ~((x["kind"] == "FACEBOOK") & acc["phone"].isNotNull())
        return F.struct(
            F.when(looked, F.coalesce(acc["phone"], x["phone"])).otherwise(acc["phone"]).alias("phone"),
            F.when(looked, F.coalesce(acc["instagram"], x["instagram"])).otherwise(acc["instagram"]).alias("instagram"),
            F.when(looked & x["text"].isNotNull(), F.concat(acc["text"], x["text"], F.lit(" "))).otherwise(acc["text"]).alias("text"),
        )

    named_text = F.coalesce(F.concat("name", F.lit(" ")), F.lit(""))
    start = F.struct(F.col("phone"), F.col("instagram"), named_text.alias("text"))
    joined = own.join(gathered, "id", "left").withColumn("found", F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)))
    return joined.select(F.col("id").alias(id_col), "found.phone", "found.instagram", "website", F.substring("found.text", 1, html.MOST_TEXT).alias("official_text"), F.col("phone").isNotNull().alias("direct_phone"), F.col("instagram").isNotNull().alias("direct_instagram"))
