"""Names, phones, handles, hosts and messages, as expressions that stay in generated code.

Blank means missing: empty, or nothing but white space.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters under the marks, from the Unicode decompositions."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _folds()
#: First parts of a path that are no user names.
RESERVED_HANDLES = ("p", "reel", "reels", "tv", "explore", "accounts", "direct", "developer", "about", "legal", "press", "jobs", "api", "graph", "www", "stories", "s", "g", "u")
BRAZIL = ("br", "brasil", "brazil")
EMAIL = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"
TEMPLATE_VARIABLES = ("nome", "cidade", "nicho", "instagram")
TEMPLATE_LENGTH = 4000


def present(x: Column) -> Column:
    """``x``, null if blank."""
    return F.when(x.rlike("\\S"), x)


def fold_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, MARKED, PLAIN), "\\p{M}", "")


def normalize_name(x: Column) -> Column:
    """Lower case without accents, one blank between runs of a-z and 0-9; null if nothing is left."""
    return present(F.trim(F.regexp_replace(fold_accents(F.lower(x)), "[^a-z0-9]+", " ")))


def normalize_key(x: Column) -> Column:
    """Like a name, but punctuation stays; '' for null."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.trim(F.coalesce(x, F.lit(""))))), "\\s+", " "))


def normalize_phrase(x: Column) -> Column:
    """Like a name, but letters of every script stay; '' for null."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.coalesce(x, F.lit("")))), "[^\\p{L}0-9]+", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` one after another; both normalised."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (phrase != "") & pad(text).contains(pad(phrase))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_phone(x: Column) -> Column:
    """The digits, at least 8 of them; one leading 00 is dropped after that test."""
    return F.when(F.length(digits(x)) >= 8, F.regexp_replace(digits(x), "^00", ""))


def _no_zeros(x: Column) -> Column:
    """The digits without leading pairs of zeros, of which the last is kept if nothing else is there."""
    return present(F.regexp_replace(digits(x), "^(?:00)+(?=.)", ""))


def _first(parts: Column, rule) -> Column:
    return F.get(F.filter(F.transform(parts, rule), lambda v: v.isNotNull()), F.lit(0))


def _national(d: Column) -> Column:
    """Area code 11 to 99, then 8 or 9 digits."""
    return d.rlike("^(?:1[1-9]|[2-9][0-9])[0-9]{8,9}$")


def whatsapp_recipient(phone: Column, country: Column) -> Column:
    """The first of the ``;``-separated numbers that can be a recipient; a missing country is Brazil."""
    land = F.coalesce(fold_accents(F.lower(F.trim(present(country)))), F.lit("br"))

    def one(part: Column) -> Column:
        d = _no_zeros(part)
        own = F.when(F.length(d).between(10, 11), F.when(_national(d), F.concat(F.lit("55"), d))).when(d.startswith("55") & ~d.startswith("5555") & _national(F.substring(d, 3, 20)), d)
        return F.when(land.isin(*BRAZIL), own).otherwise(F.when(F.length(d).between(8, 15), d))

    return _first(F.split(phone, ";"), one)


def contact_phone(phone: Column, country_code: Column) -> Column:
    """As ``whatsapp_recipient`` by country code; a number that begins with 5555 is never taken."""
    code = F.coalesce(F.lower(present(country_code)), F.lit("br"))

    def one(part: Column) -> Column:
        d = _no_zeros(part)
        own = F.when(d.startswith("5555"), None).when(_national(d), F.concat(F.lit("55"), d)).when(d.startswith("55") & _national(F.substring(d, 3, 20)), d)
        return F.when(code == "br", own).otherwise(F.when(F.length(d).between(8, 15), d))

    return _first(F.split(phone, ";"), one)


def with_scheme(x: Column) -> Column:
    """An address with https:// in front if it has no scheme; null if blank."""
    t = F.trim(present(x))
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def normalize_url(x: Column) -> Column:
    """An address with https:// in front if it has no scheme; null if it has no host."""
    url = with_scheme(x)
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), url)


def website_host(x: Column) -> Column:
    """The host in lower case, without www.; what stands before the first slash if the address can't be parsed."""
    url = with_scheme(F.lower(x))
    parsed = F.try_parse_url(url, F.lit("HOST"))
    rough = F.regexp_extract(F.lower(F.trim(x)), "^(?:https?://)?([^/]*)", 1)
    return present(F.regexp_replace(F.coalesce(parsed, rough), "^www\\.", ""))


def instagram_handle(x: Column) -> Column:
    """What follows instagram.com/, or the name itself without @, in lower case."""
    t = F.trim(x)
    in_url = F.regexp_extract(t, "(?i)instagram\\.com/([A-Za-z0-9_.]+)", 1)
    bare = F.regexp_extract(F.trim(F.regexp_replace(t, "^@", "")), "^([^/]*)", 1)
    return present(F.lower(F.when(in_url != "", in_url).otherwise(bare)))


def instagram_user(x: Column) -> Column:
    """A handle of up to 30 characters that is no reserved path."""
    h = F.regexp_replace(F.regexp_extract(instagram_handle(x), "^([^?]*)", 1), "[^a-z0-9_.]", "")
    return F.when((h != "") & (F.length(h) <= 30) & ~h.isin(*RESERVED_HANDLES), h)


def normalize_email(x: Column) -> Column:
    e = F.lower(F.trim(x))
    return F.when(e.rlike(EMAIL), e)


def source_key(source: Column, source_id: Column) -> Column:
    """source_id in lower case behind its source (src without one); null without an id."""
    return F.concat(F.lower(F.coalesce(source, F.lit("src"))), F.lit("_"), F.lower(source_id))


def template_problem(template: Column) -> Column:
    """Null for a template that can be rendered, otherwise what is wrong with it."""
    unknown = F.regexp_replace(template, "\\{\\{(" + "|".join(TEMPLATE_VARIABLES) + ")\\}\\}", "").rlike("\\{\\{[^}]+\\}\\}")
    return F.when(present(template).isNull(), "INVALID_TEMPLATE").when(F.length(template) > TEMPLATE_LENGTH, "INVALID_TEMPLATE_TOO_LONG").when(unknown, "INVALID_TEMPLATE_VARIABLE")


def render_template(template: Column, **values: Column) -> Column:
    """The template with its variables replaced one after another; null if it or the outcome isn't allowed."""
    out = template
    for name in TEMPLATE_VARIABLES:
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(values.get(name, F.lit("")), F.lit("")))
    return F.when(template_problem(template).isNull() & (F.length(out) <= TEMPLATE_LENGTH), out)


def redact(x: Column) -> Column:
    """Values of assignments that may be secrets, masked."""
    return F.coalesce(F.regexp_replace(x, "(?i)(password|token|secret|url|database_url|key)=[^\\s&]+", "$1=***"), F.lit("Erro desconhecido"))


def mask_phone(x: Column) -> Column:
    return F.concat(F.lit("***"), F.substring(digits(x), -4, 4))


def or_unknown(x: Column) -> Column:
    return F.coalesce(F.trim(present(x)), F.lit("unknown"))


def request_key(x: Column, otherwise: Column) -> Column:
    """A request key of up to 64 letters, digits, dots, dashes and underscores; ``otherwise`` in its place if it is none."""
    t = F.trim(x)
    return F.when(t.rlike("^[A-Za-z0-9._-]{1,64}$"), t).otherwise(otherwise)


def shortened(x: Column, length: int) -> Column:
    return F.substring(x, 1, length)
