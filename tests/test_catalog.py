from pyspark.sql import functions as F

from quarry.functions import codes, html, places
from quarry.operators import pool


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_countries(spark):
    rows = [("Brasil",), (" estados   unidos ",), ("França",), ("México",), ("jp",), ("xx",), ("",), (None,)]
    code = places.country_code(F.col("x"), places.iso_countries(spark))
    assert values(spark, code, rows, "x string") == ["br", "us", None, "mx", "jp", None, None, None]
    assert values(spark, places.country_name(F.col("x")), [("BR",), ("jp",), (" ",), (None,)], "x string") == ["Brasil", "JP", "", ""]


def test_addresses(spark):
    rows = [({"addr:street": "A", "addr:housenumber": "1", "addr:suburb": "S"}, "C", "X"), ({"addr:housenumber": " 2 "}, None, "X"), ({"addr:street": " "}, None, None), (None, "C", None)]
    got = values(spark, places.address(F.col("tags"), F.col("city"), F.col("state")), rows, "tags map<string,string>, city string, state string")
    assert got == ["A 1, S, C - X", "2, X", None, "C"]


def test_chat_links_come_first(spark):
    rows = [
        ('<a href="tel:+55 11 3333-4444">x</a> <a href="https://api.whatsapp.com/send?text=a&phone=%2B5511999998888&x=1">y</a>',), ('<a href="tel:+55 11 3333-4444">x</a> (11) 99999-8888',), ("ligue (11) 3333-4444",),
        ("ligue (11) 99999-8888",),  # the fixed pattern takes eight digits at most after an area code, so it begins behind it here
        ('<a href="https://wa.me/123">x</a>',), ('<a href="https://wa.me/%zz5511999998888">x</a>',), ("",), (None,),
    ]
    assert values(spark, html.chat_first_phone(F.col("x")), rows, "x string") == ["5511999998888", "551133334444", "1133334444", "999998888", None, "5511999998888", None, None]


def test_network_errors(spark):
    rows = [("SocketTimeoutException", "Connect timed out"), ("SocketTimeoutException", None), ("IOException", "Read timed out"), (None, None), ("IOException", "connection reset, read timeout")]
    late, never = "WHATSAPP_READ_TIMEOUT", "WHATSAPP_SERVICE_CONNECT_FAILED"
    assert values(spark, codes.network_error(F.col("k"), F.col("m")), rows, "k string, m string") == [never, late, late, never, never]


def test_one_send_is_claimed(spark):
    rows = [(1, "QUEUED", "2030-01-01", 0), (2, "QUEUED", "2020-01-02", 3), (3, "QUEUED", "2020-01-01", 1), (4, "SENT", None, 2)]
    sends = spark.createDataFrame(rows, "id long, status string, t string, attempts int").select("id", "status", F.to_timestamp("t").alias("next_attempt_at"), "attempts", F.lit(None).cast("timestamp").alias("last_attempt_at"))
    got = {r["id"]: (r["status"], r["attempts"], r["last_attempt_at"] is not None) for r in pool.claim_next(sends, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {1: ("QUEUED", 0, False), 2: ("QUEUED", 3, False), 3: ("SENDING", 2, True), 4: ("SENT", 2, False)}
    assert pool.claim_next(sends.limit(0), F.current_timestamp()).count() == 0


def test_fixed_maps_as_written_out(spark):
    code = places.country_code(F.col("x"), places.iso_countries(spark))
    wanted = {"Brazil": "br", "united states of america": "us", "Portugal": "pt", "Alemanha": "de", "UK": "gb", "Espanha": "es", "Italy": "it", "Canadá": "ca", "Colômbia": "co", "perú": "pe", "Uruguai": "uy", "paraguay": "py", "Bolívia": "bo", "Ecuador": "ec", "Venezuela": "ve", "ad": "ad"}
    assert dict(zip(wanted, values(spark, code, [(k,) for k in wanted], "x string"))) == wanted
    names = {"us": "Estados Unidos", "de": "Alemanha", "gb": "Reino Unido", "fr": "França", "it": "Itália", "mx": "México", "uy": "Uruguai", "ec": "Equador"}
    assert dict(zip(names, values(spark, places.country_name(F.col("x")), [(k,) for k in names], "x string"))) == names
    extracts = {"df": "centro-oeste", "Goiás": "centro-oeste", "MT": "centro-oeste", "mato grosso do sul": "centro-oeste", "AL": "nordeste", "Ceará": "nordeste", "paraiba": "nordeste", "Rio Grande do Norte": "nordeste", "se": "nordeste", "Acre": "norte", "Amapá": "norte", "Pará": "norte", "to": "norte"}
    assert dict(zip(extracts, values(spark, places.extract_of_state(F.col("x")), [(k,) for k in extracts], "x string"))) == extracts
    errors = {"recipient_not_on_whatsapp": "RECIPIENT_NOT_ON_WHATSAPP", "invalid_recipient": "WHATSAPP_INVALID_RECIPIENT", "invalid_text": "WHATSAPP_INVALID_TEXT", "text_too_long": "WHATSAPP_TEXT_TOO_LONG", "session_not_connected": "WHATSAPP_NOT_CONNECTED", "invalid_request_id": "WHATSAPP_INVALID_REQUEST_ID"}
    assert dict(zip(errors, values(spark, codes.remote_error(F.col("x"), F.lit(400)), [(k,) for k in errors], "x string"))) == errors
    labels = {"NEW": "Novo", "MESSAGE_READY": "Mensagem pronta", "REPLIED": "Respondeu", "SCHEDULED": "Agendado", "NOT_INTERESTED": "Nao interessado", "DO_NOT_CONTACT": "Nao prospectar"}
    assert dict(zip(labels, values(spark, codes.label(F.col("x"), codes.LEAD_LABELS), [(k,) for k in labels], "x string"))) == labels
