"""What can be read out of web pages that are at hand as text: nothing is fetched."""

from __future__ import annotations

import json
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import contact_phone, instagram_user, normalize_phone, present

#: Hosts of link collections, words of contact pages, marks of booking systems (in the order in which they are tried) and their names.
HUB_HOSTS = ("linktr.ee", "beacons.ai", "bio.site", "lnk.bio", "campsite.bio", "solo.to", "linkbio.co", "msha.ke", "taplink.cc", "linktree")
CONTACT_WORDS = ("contato", "contact", "fale-conosco", "atendimento", "whatsapp")
BOOKING_SIGNALS = (
    "booksy", "agendor", "genda", "calendly", "youcanbook", "hubspot", "pipedrive", "tiny.com.br", "vindi", "mindbody", "wellnessliving", "vagasoft", "salonmanager",
    "shedul", "fresha", "gettimely", "squareup", "appointmentplus", "simplybook", "omnify", "zenplanner", "glossgenius", "mangomint", "boulevard", "phorest",
    "vizzen", "agend", "agenda", "sistema.agenda", "agendei", "iwu", "leadlovers", "rdstation", "contaazul", "mercadoshopt", "loja.booking", "bookingkit", "reserva",
)
AGENDA = "Sistema de agendamento"
BOOKING_NAMES = {
    "booksy": "Booksy", "agendor": "Agendor", "genda": AGENDA, "agend": AGENDA, "sistema.agenda": AGENDA, "agenda": AGENDA, "agendei": AGENDA, "calendly": "Calendly", "fresha": "Fresha",
    "mindbody": "Mindbody", "gettimely": "Timely", "simplybook": "SimplyBook", "hubspot": "HubSpot", "tiny.com.br": "Tiny", "vindi": "Vindi", "phorest": "Phorest", "mangomint": "Mangomint",
}
#: Tags that hold a phone, in order.
PHONE_TAGS = ("contact:whatsapp", "whatsapp", "contact:phone", "phone", "contact:mobile", "mobile", "contact:sms", "sms")
HREF = "(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"
TEL = "(?i)href\\s*=\\s*[\"']\\s*tel:([^\"']+)[\"']"
CHAT_LINK = "(?i)(?:wa\\.me/|phone=)(\\+?[0-9][0-9\\s.()\\-]{7,20})"
NUMBER = "(?:\\+?55\\s?)?\\(?[1-9]{2}\\)?[\\s.-]?[0-9]{4,5}[\\s.-]?[0-9]{4}"
#: Chat links and numbers as the chat-first order reads them.
CHAT_ADDRESS = "(?i)(?:https?://)?(?:www\\.)?(?:wa\\.me/|(?:api|web)\\.whatsapp\\.com/send\\?[^\"'\\s>]*?phone=)([^&\"'\\s<>]+)"
ANY_NUMBER = "(?i)(?:tel:|\\+?[1-9]\\d{1,2}[\\s.-]?)?\\(?\\d{2,4}\\)?[\\s.-]?\\d{3,4}[\\s.-]?\\d{3,4}"
LD_JSON = "(?is)<script[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
MOST_TEXT = 20_000


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def visible_text(html: Column, most: int | None = MOST_TEXT) -> Column:
    """The text without scripts, styles and tags, white space collapsed; of a page's text only the first ``most`` characters are evidence."""
    out = html
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", "\\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out) if most is None else F.substring(F.trim(out), 1, most)


def links(html: Column) -> Column:
    return _all(html, HREF)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def is_hub(url: Column) -> Column:
    return F.coalesce(host_of(url).isin(*HUB_HOSTS), F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def absolute(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Links resolved against the page's address; what can't be resolved is left out."""

    def one(b: str | None, hs) -> list[str]:
        out = []
        for h in hs if hs is not None else []:
            try:
                url = urljoin(b or "", h)
                urlsplit(url)
            except ValueError:
                continue
            out.append(url)
        return out

    return pd.Series([one(b, h) for b, h in zip(base, hrefs)])


def hub_links(base: Column, html: Column, most: int = 3) -> Column:
    """Up to ``most`` different links to link collections, in order."""
    return F.slice(F.array_distinct(F.filter(absolute(base, links(html)), is_hub)), 1, most)


def contact_links(base: Column, html: Column, most: int = 2) -> Column:
    """Up to ``most`` links to contact pages of the same host."""
    named = F.filter(links(html), lambda h: F.lower(h).rlike("|".join(CONTACT_WORDS)))
    return F.slice(F.filter(absolute(base, named), lambda u: F.lower(F.try_parse_url(u, F.lit("HOST"))) == F.lower(F.try_parse_url(base, F.lit("HOST")))), 1, most)


def first_phone(text: Column, country_code: Column, source: str) -> Column:
    """``number`` and ``source`` of the first phone: tel: links, then chat links, then numbers in the text."""
    found = lambda pattern, group, kind: F.transform(
        F.filter(F.transform(_all(text, pattern, group), lambda x: contact_phone(x, country_code)), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("number"), F.lit(f"{source}:{kind}").alias("source"))
    )
    return F.get(F.concat(found(TEL, 1, "TEL"), found(CHAT_LINK, 1, "WHATSAPP_LINK"), found(NUMBER, 0, "TEXT")), F.lit(0))


def chat_first_phone(html: Column) -> Column:
    """The first number of a page in the other order: chat links, then tel: links, then numbers in the text, each decoded and normalised."""

    def number(raw: Column) -> Column:
        n = normalize_phone(F.coalesce(F.try_url_decode(raw), raw))
        return F.when(F.length(n) >= 8, n)

    found = F.concat(_all(html, CHAT_ADDRESS), _all(html, TEL), _all(html, ANY_NUMBER, 0))
    return F.get(F.filter(F.transform(found, number), lambda n: n.isNotNull()), F.lit(0))


def tag_phone(tags: Column, country_code: Column) -> Column:
    """``number`` and ``source`` of the first tag that holds a phone."""
    options = [F.when(n.isNotNull(), F.struct(n.alias("number"), F.lit(f"DIRECT_OSM:{key}").alias("source"))) for key in PHONE_TAGS for n in [contact_phone(present(F.try_element_at(tags, F.lit(key))), country_code)]]
    return F.coalesce(*options)


def first_email(text: Column) -> Column:
    return F.lower(present(F.regexp_extract(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", 0)))


def first_instagram(html: Column) -> Column:
    """The first user that a link names and that is no reserved path."""
    return F.get(F.filter(F.transform(_all(html, "(?i)instagram\\.com/([A-Za-z0-9_.]{1,30})"), instagram_user), lambda x: x.isNotNull()), F.lit(0))


#: Members of a JSON-LD node that are visited before all others.
NESTED = ("@graph", "hasPart", "mainEntity")


def _same_as(node, out: list[str], depth: int, most: int = 50, deepest: int = 6, widest: int = 30) -> None:
    """Links of a node, then of its NESTED members, then of its first ``widest`` members in order; repeats are dropped later."""
    if depth > deepest or len(out) >= most:
        return
    if isinstance(node, list):
        for child in node:
            _same_as(child, out, depth + 1)
    elif isinstance(node, dict):
        own = node.get("sameAs", [])
        out += [x.strip() for x in (own if isinstance(own, list) else [own]) if isinstance(x, str) and x.strip()]
        later = [child for key, child in list(node.items())[:widest] if key not in ("sameAs", "@graph")]
        for child in [*(node[key] for key in NESTED if key in node), *later]:
            if isinstance(child, (dict, list)):
                _same_as(child, out, depth + 1)


@F.pandas_udf(ArrayType(StringType()))
def _walked(scripts: pd.Series) -> pd.Series:
    def one(parts) -> list[str]:
        out: list[str] = []
        for part in parts if parts is not None else []:
            try:
                _same_as(json.JSONDecoder().raw_decode(part.strip())[0], out, 0)  # what follows the first value is passed over
            except ValueError:
                continue
        return out

    return scripts.map(one)


def same_as(html: Column, most: int = 10) -> Column:
    """The first different http links that JSON-LD blocks give as sameAs, at any depth up to six."""
    return F.slice(F.array_distinct(F.filter(_walked(_all(html, LD_JSON)), lambda u: u.startswith("http"))), 1, most)


def booking_system(*sources: Column) -> Column:
    """``status`` (IDENTIFIED or UNKNOWN) and ``system`` by the first mark, in list order, in the sources."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(s, F.lit("")) for s in sources)))
    system = F.lit(None).cast("string")
    for signal in reversed(BOOKING_SIGNALS):
        system = F.when(text.contains(signal), BOOKING_NAMES.get(signal, signal)).otherwise(system)
    return F.struct(F.when(system.isNotNull(), "IDENTIFIED").otherwise("UNKNOWN").alias("status"), system.alias("system"))


def enriched_contact(tags: Column, site_html: Column, extra_html: list[tuple[str, Column]], country_code: Column) -> Column:
    """Phone and Instagram from the tags, else from the site, else from further pages in order, with where each came from."""
    pages = [("WEBSITE", site_html), *extra_html]
    phone = F.coalesce(tag_phone(tags, country_code), *(first_phone(h, country_code, kind) for kind, h in pages))
    direct = instagram_user(F.coalesce(present(F.try_element_at(tags, F.lit("contact:instagram"))), F.try_element_at(tags, F.lit("instagram"))))
    handle = lambda h, kind: F.when(h.isNotNull(), F.struct(h.alias("handle"), F.lit(kind).alias("source")))
    instagram = F.coalesce(handle(direct, "DIRECT_OSM_INSTAGRAM"), *(handle(first_instagram(h), kind) for kind, h in pages))
    return F.struct(phone.alias("phone"), instagram.alias("instagram"))
