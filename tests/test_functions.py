"""Literal cases of single functions."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import geo, html, scoring, text

def none():
    return F.lit(None).cast("string")



def value(spark, column, **cols):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'map<string,string>' if isinstance(v, dict) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (text.normalize_name, "Barbearia Alpha!!", "barbearia alpha"),
        (text.normalize_name, "Clínica Odontológica Sorriso", "clinica odontologica sorriso"),
        (text.normalize_name, " !! ", None),
        (text.normalize_phone, "(65) 99999-9999", "65999999999"),
        (text.normalize_phone, "123", None),
        (text.normalize_phone, "0055 1199", "551199"),
        (text.website_host, "https://www.instagram.com/foo", "instagram.com"),
        (text.website_host, "http://exemplo.com.br/path?x=1", "exemplo.com.br"),
        (text.website_host, "Studio.com", "studio.com"),
        (text.instagram_handle, "@BarbeariaAlpha", "barbeariaalpha"),
        (text.instagram_handle, "https://instagram.com/BarbeariaAlpha/", "barbeariaalpha"),
        (text.instagram_user, "https://www.instagram.com/p/ABC123/", None),
        (text.instagram_user, "explore", None),
        (text.instagram_user, "@Studio.Bella", "studio.bella"),
        (text.instagram_user, "https://instagram.com/studio.bella/?hl=pt", "studio.bella"),
        (text.normalize_email, " A@B.Co ", "a@b.co"),
        (text.normalize_email, "no mail", None),
        (text.or_unknown, "  ", "unknown"),
        (text.mask_phone, "+55 65 99999-1234", "***1234"),
        (text.redact, "a token=abc&b", "a token=***&b"),
        (text.normalize_key, "  Salão  de-Beleza ", "salao de-beleza"),
        (text.template_problem, "oi {{nome}} {{outro}}", "INVALID_TEMPLATE_VARIABLE"),
        (text.template_problem, "oi {{nome}}", None),
        (text.template_problem, "", "INVALID_TEMPLATE"),
    ],
)
def test_text(spark, function, given, wanted):
    assert value(spark, function(F.col("x")), x=given) == wanted


@pytest.mark.parametrize(
    "given, country, wanted",
    [
        ("(11) 99999-9999", "BR", "5511999999999"), ("005511999999999", "BR", "5511999999999"), ("(11) 3456-3456", "BR", "551134563456"), ("99999-9999", "BR", None), ("555511999999999", "BR", None),
        ("(11) 99999-9999", None, "5511999999999"), ("+1 415 555 0132", "US", "14155550132"), ("123", "US", None), ("+5565999999999; +5565888888888", "Brasil", "5565999999999"), ("yes", "Brasil", None), ("", "BR", None),
        ("5555123456", "BR", "555555123456"),
    ],
)
def test_recipients(spark, given, country, wanted):
    assert value(spark, text.whatsapp_recipient(F.col("x"), F.col("c")), x=given, c=country) == wanted


def test_contact_phone_never_takes_5555(spark):
    assert value(spark, text.contact_phone(F.col("x"), none()), x="5555123456") is None
    assert value(spark, text.contact_phone(F.col("x"), none()), x="65 99999-9999") == "5565999999999"


def test_template_values_are_replaced_one_after_another(spark):
    out = text.render_template(F.lit("{{nome}}"), nome=F.lit("em {{cidade}}"), cidade=F.lit("Cuiabá"))
    assert value(spark, out, x="") == "em Cuiabá"


def test_html(spark):
    page = '<html><script>var a="tel:1"</script><a href="tel:+55 (65) 99999-9999">x</a> <a HREF=\'/contato\'>c</a><a href="https://linktr.ee/bella">h</a> instagram.com/p/x instagram.com/Studio.Bella a@b.com</html>'
    x = F.col("x")
    assert value(spark, html.visible_text(x), x=page).startswith("x c h instagram.com/p/x")
    assert tuple(value(spark, html.first_phone(x, none(), "SITE"), x=page)) == ("5565999999999", "SITE:TEL")
    assert tuple(value(spark, html.first_phone(x, none(), "SITE"), x="see wa.me/5565999999999 now")) == ("5565999999999", "SITE:WHATSAPP_LINK")
    assert tuple(value(spark, html.first_phone(x, none(), "SITE"), x="Fone (65) 3333-4444")) == ("556533334444", "SITE:TEXT")
    assert value(spark, html.first_instagram(x), x=page) == "studio.bella"
    assert value(spark, html.first_email(x), x=page) == "a@b.com"
    assert value(spark, html.hub_links(F.lit("https://a.com/"), x), x=page) == ["https://linktr.ee/bella"]
    assert value(spark, html.contact_links(F.lit("https://a.com/x/"), x), x=page) == ["https://a.com/contato"]
    assert tuple(value(spark, html.booking_system(x), x="https://calendly.com/x")) == ("IDENTIFIED", "Calendly")
    assert tuple(value(spark, html.booking_system(x), x=None)) == ("UNKNOWN", None)
    for n, wanted in enumerate((["https://a.example/1"], ["https://a.example/1", "https://b.example/2"], ["https://c.example"], ["https://d.example"], [], [])):
        from quarry.plans.crm import LD

        assert value(spark, html.same_as(x), x=LD[n]) == wanted
    contact = value(spark, html.enriched_contact(F.col("tags"), x, [], none()), tags={"phone": "(11) 99999-9999"}, x=page)
    assert (contact.phone.source, contact.instagram.source, contact.instagram.handle) == ("DIRECT_OSM:phone", "WEBSITE", "studio.bella")


def test_geometry(spark):
    x, kind = F.col("x"), F.col("kind")
    at = lambda k, c: value(spark, geo.representative(kind, x), kind=k, x=c)
    assert tuple(at("Point", "[-46.5, -23.5]")) == (-46.5, -23.5)
    assert tuple(at("Polygon", "[[[0,0],[4,0,9],[4,2],[0,2]]]")) == (2.0, 1.0)
    assert at("Polygon", "[]") is None and at("Circle", "[1,2]") is None
    box = geo.around(F.lit(0.0), F.lit(0.0))
    quarters = value(spark, geo.quadrants(box), x="")
    assert len(quarters) == 4 and (quarters[0].south, quarters[0].west, quarters[0].north, quarters[0].east) == (-0.18, -0.18, 0.0, 0.0)
    assert round(value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), x=""), 1) == 111.2


@pytest.mark.parametrize("saved, target, technical, wanted", [(0, 50, 3, "PARTIAL"), (50, 50, 10, "SUCCESS"), (5, 50, 0, "PARTIAL"), (0, 50, 0, "EXHAUSTED")])
def test_run_status(spark, saved, target, technical, wanted):
    assert value(spark, scoring.run_status(F.col("a"), F.col("b"), F.col("c")), a=saved, b=target, c=technical) == wanted


def test_rules_in_order(spark):
    x = F.col("x")
    assert value(spark, scoring.failure_category(x), x="UNHEARD_OF") == "AMBIGUOUS"
    assert [value(spark, scoring.retry_minutes(F.col("n")), n=n) for n in (1, 2, 5)] == [2, 4, 32]
    assert tuple(value(spark, scoring.discovery_outcome(F.lit(0), F.lit(5), F.lit(9), F.lit(9)), x="")) == ("EMPTY", "OSM_POOL_ALL_DUPLICATES")
    assert value(spark, scoring.valid_send(F.lit("123"), F.lit("t"), F.lit("r")), x="") == "INVALID_RECIPIENT"
    assert value(spark, scoring.valid_send(F.lit("5511999999999"), F.lit("t"), F.lit("r")), x="") is None
    assert value(spark, scoring.tokens_left(F.lit(0), F.lit(30), 200), x="") == 100
    got = value(spark, scoring.analysis(x), x='{"opportunity_score": 140, "booking_system_status": "odd", "uses_booking_system": true}')
    assert tuple(got) == ("unknown", "unknown", "UNKNOWN", True, 100)
    assert value(spark, scoring.analysis(x)["opportunity_score"], x='{"opportunity_score": 4.5}') is None
    assert value(spark, scoring.budget(F.lit(10), F.lit(3), F.lit(5), F.lit(20)), x="") == 20


def test_same_as_visits_graph_and_main_entity_first(spark):
    """Of twelve links the first ten in order of the visit stay."""
    link = lambda n: f"https://x.example/{n}"
    node = {"other": {"sameAs": [link(n) for n in range(6, 12)]}, "mainEntity": {"sameAs": [link(3), link(4)]}, "@graph": [{"sameAs": link(1)}, {"sameAs": link(2)}], "sameAs": link(0), "hasPart": {"sameAs": " "}, "about": {"sameAs": link(5)}}
    page = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    got = spark.createDataFrame([(page,)], "h string").select(html.same_as(F.col("h")).alias("s")).first().s
    assert got == [link(n) for n in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)]
