"""Countries, states and cities, and what is read out of the tags of a place."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .scoring import cases
from .text import instagram_handle, normalize_key, present

#: Names of countries and their codes, names to show, states of the extracts they are in.
COUNTRY_ALIASES = {
    "brazil": "br", "brasil": "br", "br": "br", "united states": "us", "estados unidos": "us", "us": "us", "usa": "us", "eua": "us", "united states of america": "us",
    "portugal": "pt", "argentina": "ar", "germany": "de", "alemanha": "de", "uk": "gb", "france": "fr", "frança": "fr", "spain": "es", "espanha": "es", "italy": "it", "itália": "it",
    "canada": "ca", "canadá": "ca", "mexico": "mx", "méxico": "mx", "colombia": "co", "colômbia": "co", "chile": "cl", "peru": "pe", "perú": "pe",
    "uruguay": "uy", "uruguai": "uy", "paraguay": "py", "paraguai": "py", "bolivia": "bo", "bolívia": "bo", "ecuador": "ec", "venezuela": "ve",
}
COUNTRY_NAMES = {
    "br": "Brasil", "us": "Estados Unidos", "pt": "Portugal", "ar": "Argentina", "de": "Alemanha", "gb": "Reino Unido", "fr": "França", "es": "Espanha", "it": "Itália", "ca": "Canadá",
    "mx": "México", "co": "Colômbia", "cl": "Chile", "pe": "Peru", "uy": "Uruguai", "py": "Paraguai", "bo": "Bolívia", "ec": "Equador", "ve": "Venezuela",
}
STATES = {
    "distrito federal": "centro-oeste", "df": "centro-oeste", "goias": "centro-oeste", "goiás": "centro-oeste", "go": "centro-oeste", "mato grosso": "centro-oeste", "mt": "centro-oeste", "mato grosso do sul": "centro-oeste", "ms": "centro-oeste",
    "alagoas": "nordeste", "al": "nordeste", "bahia": "nordeste", "ba": "nordeste", "ceara": "nordeste", "ceará": "nordeste", "ce": "nordeste", "maranhao": "nordeste", "maranhão": "nordeste", "ma": "nordeste", "paraiba": "nordeste", "paraíba": "nordeste", "pb": "nordeste",
    "pernambuco": "nordeste", "pe": "nordeste", "piaui": "nordeste", "piauí": "nordeste", "pi": "nordeste", "rio grande do norte": "nordeste", "rn": "nordeste", "sergipe": "nordeste", "se": "nordeste",
    "acre": "norte", "ac": "norte", "amapa": "norte", "amapá": "norte", "ap": "norte", "amazonas": "norte", "am": "norte", "para": "norte", "pará": "norte", "pa": "norte", "rondonia": "norte", "rondônia": "norte", "ro": "norte", "roraima": "norte", "rr": "norte", "tocantins": "norte", "to": "norte",
    "espirito santo": "sudeste", "espírito santo": "sudeste", "es": "sudeste", "minas gerais": "sudeste", "mg": "sudeste", "rio de janeiro": "sudeste", "rj": "sudeste", "sao paulo": "sudeste", "são paulo": "sudeste", "sp": "sudeste",
    "parana": "sul", "paraná": "sul", "pr": "sul", "rio grande do sul": "sul", "rs": "sul", "santa catarina": "sul", "sc": "sul",
}
#: Keys of tags, the first that has a value counts.
CITY_TAGS = ("addr:city", "addr:town", "addr:village", "addr:municipality")
SUBURB_TAGS = ("addr:suburb", "addr:neighbourhood", "addr:district")
WEBSITE_TAGS = ("contact:website", "website", "url")
PHONE_TAGS = ("contact:phone", "phone", "contact:mobile", "mobile")
EMAIL_TAGS = ("contact:email", "email")
INSTAGRAM_TAGS = ("contact:instagram", "instagram")
CATEGORY_TAGS = ("beauty", "shop", "amenity")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def iso_countries(spark: SparkSession) -> tuple[str, ...]:
    """The two-letter country codes that Java knows, in lower case."""
    return tuple(sorted(c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()))


def country_code(x: Column, codes: tuple[str, ...]) -> Column:
    """The code of a country by one of its names, or the code itself; null for what is neither.

    Accents are folded before the lookup, so that names that only stand there with one are not found.
    """
    key = normalize_key(x)
    return F.coalesce(F.try_element_at(literal_map(COUNTRY_ALIASES), key), F.when(key.isin(*codes), key))


def country_name(code: Column) -> Column:
    """The name to show, the code in capitals for others, '' for none."""
    return F.when(present(code).isNull(), "").otherwise(F.coalesce(F.try_element_at(literal_map(COUNTRY_NAMES), F.lower(code)), F.upper(code)))


def extract_of_state(state: Column) -> Column:
    """The extract that holds a state, given by name or code; null if there is none."""
    # names come without accents here, so the accented spellings stand for themselves only
    return F.try_element_at(literal_map(STATES), normalize_key(state))


def same_city(hit: Column, asked: Column) -> Column:
    """Equal but for case, accents and runs of blanks; false if either is missing."""
    return F.coalesce(F.when(hit.isNotNull() & asked.isNotNull(), normalize_key(hit) == normalize_key(asked)), F.lit(False))


def request_problem(country: Column, city: Column, niche: Column) -> Column:
    """Null for a target that can be asked for, otherwise the code of what is wrong."""
    blank = present(city).isNull() | present(niche).isNull()
    return cases((F.coalesce(F.lower(country) != "br", F.lit(True)), "OSM_CATALOG_COUNTRY_NOT_SUPPORTED"), (blank, "OSM_SYNC_INVALID_INPUT"))


def resync_problem(niche: Column, region: Column) -> Column:
    """An old target without niche or region has to be configured first."""
    return F.when(present(niche).isNull() | region.isNull(), "OSM_TARGET_CONFIGURATION_REQUIRED")


def tag(tags: Column, *keys: str) -> Column:
    """The first of some tags that isn't blank."""
    return F.coalesce(*(F.trim(present(F.try_element_at(tags, F.lit(k)))) for k in keys))


def category(tags: Column) -> Column:
    return F.coalesce(*(F.concat(F.lit(f"{k}:"), tag(tags, k)) for k in CATEGORY_TAGS))


def address(tags: Column, city: Column, state: Column) -> Column:
    """"street number, suburb, city - state", without what is missing; null if nothing is there."""
    street = present(F.concat_ws(" ", tag(tags, "addr:street"), tag(tags, "addr:housenumber")))
    place = present(F.concat_ws(" - ", city, state))
    return present(F.concat_ws(", ", street, tag(tags, *SUBURB_TAGS), place))


def candidate_of(tags: Column, source_id: Column, city: Column, state: Column, country: Column, verified: Column) -> Column:
    """A place's tags as a candidate; where they lack city, state or country, those that were asked for.

    Null without a name, and if the place only lies in the box around the city asked
    for and doesn't name that city.
    """
    named, handle = tag(tags, *CITY_TAGS), present(instagram_handle(tag(tags, *INSTAGRAM_TAGS)))
    own_state = F.coalesce(tag(tags, "addr:state"), state)
    out = F.struct(
        tag(tags, "name").alias("business_name"), source_id.alias("source_id"), category(tags).alias("category"), tag(tags, *WEBSITE_TAGS).alias("website"), tag(tags, *PHONE_TAGS).alias("phone"),
        tag(tags, *EMAIL_TAGS).alias("email"), F.coalesce(named, city).alias("city"), own_state.alias("state"), F.coalesce(tag(tags, "addr:country"), country).alias("country"),
        address(tags, F.coalesce(named, F.when(verified, city)), own_state).alias("address"), handle.alias("instagram"), F.when(handle.isNull(), "NOT_FOUND").otherwise("FOUND").alias("instagram_status"),
    )
    return F.when(tag(tags, "name").isNotNull() & (verified | same_city(named, city)), out)
