import pytest
from oracle import connection, same
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.operators import enrichment
from quarry.plans import contacts, crm  # noqa: F401, contacts adds its queries to those of crm

LD = '<script type="application/ld+json">%s</script>'


@pytest.mark.parametrize(
    "page,links",
    [
        (LD % '{"sameAs": "https://a.example/1"}', ["https://a.example/1"]), (LD % '{"sameAs": ["https://a.example/1", "https://b.example/2", "ftp://no"]}', ["https://a.example/1", "https://b.example/2"]),
        (LD % '[{"sameAs": "https://c.example"}]', ["https://c.example"]), (LD % '{"@graph": [{"x": {"sameAs": ["https://d.example"]}}]}', ["https://d.example"]), (LD % "{broken", []), (LD % "", []), ("no script", []),
        (LD % '{"sameAs": "https://e.example"} {"sameAs": "https://f.example"}', ["https://e.example"]), (LD % '{"sameAs": "https://g.example"}; more', ["https://g.example"]),
    ],
)
def test_links_named_as_the_same(spark, page, links):
    assert spark.createDataFrame([(page,)], "h string").select(html.same_as(F.col("h"))).first()[0] == links


PAGES = [
    ("https://a.example", '<a href="https://instagram.com/p/x">post</a> <a href="/contact">c</a>'), ("https://a.example/contact", "tel (11) 98888-7777 <a href='https://linktr.ee/late'>h</a>"), ("https://linktr.ee/late", '<a href="https://instagram.com/late">i</a>'),
    ("https://b.example", "x " * 30_000), ("https://c.example", None), ("https://d.example", "first"), ("https://d.example", "A first <a href='tel:+55 11 97777-6666'>t</a>"),
]
PLACES = [
    (1, {"website": "a.example"}, "A", "BR"), (2, {"website": "https://b.example", "facebook": " "}, "B", "BR"), (3, {"url": "https://c.example"}, None, None), (4, {}, "D", "BR"), (5, None, "E", "BR"),
    (6, {"website": "https://d.example", "contact:instagram": "@Some.One"}, "F", "US"), (7, {"website": "http://"}, "G", "BR"), (8, {"phone": "11 98888-7777", "instagram": "https://instagram.com/reel/1"}, "H", "BR"),
]


def test_chains_of_odd_places(spark):
    places = spark.createDataFrame(PLACES, "id long, tags map<string,string>, name string, country_code string")
    got = {r.id: r for r in enrichment.enrich(places, spark.createDataFrame(PAGES, "url string, html string")).collect()}
    assert len(got) == len(PLACES)
    assert got[1].phone.asDict() == {"value": "5511988887777", "source": "OSM_WEBSITE_CONTACT_PAGE:TEXT", "url": "https://a.example/contact"}
    assert got[1].instagram is None and got[1].official_text == "A post c tel (11) 98888-7777 h "  # a contact page's links are not followed
    assert len(got[2].official_text) == 20_000 and got[2].phone is None
    assert (got[3].official_text, got[4].official_text, got[5].official_text) == ("", "D ", "E ")
    assert got[6].phone.value == "5511977776666" and got[6].instagram.value == "some.one" and got[6].direct_instagram and not got[6].direct_phone
    assert got[7].website is None and got[8].phone.source == "DIRECT_OSM:phone" and got[8].instagram is None
    assert enrichment.enrich(places.limit(0), spark.createDataFrame(PAGES, "url string, html string")).count() == 0
    assert enrichment.enrich(places, spark.createDataFrame([], "url string, html string")).count() == len(PLACES)


@pytest.mark.parametrize("name", ["enrichment_chain", "page_contacts"])
def test_numbers_and_addresses_in_prose(spark, tmp_path, name):
    own = '<p>that 4379362835490466 of, +55 (11) 98888-7777, a.50@mail6.example.com</p><a href="tel:11 97777-6666">t</a>'
    spark.range(24).selectExpr("id AS page_id", "'https://x.example' AS url", f"'<html>{own}</html>' AS html").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    assert same(crm.QUERIES[name](spark, str(tmp_path)), connection(tmp_path), crm.ORACLE_SQL[name]) == 24


def test_text_of_pages_that_is_at_hand(spark):
    places = spark.createDataFrame([(1, {"website": "https://a.example"}, "A", "BR"), (2, {"website": "https://b.example"}, "B", "BR")], "id long, tags map<string,string>, name string, country_code string")
    pages = spark.createDataFrame([("https://a.example", "<b>masked</b>", "as it was"), ("https://b.example", "<b>html</b>", None)], "url string, html string, text string")
    assert {r.id: r.official_text for r in enrichment.enrich(places, pages).collect()} == {1: "A as it was ", 2: "B html "}
