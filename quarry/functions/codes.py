"""Codes of errors, kinds of failures, labels of statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .places import literal_map
from .scoring import cases

#: Kinds of errors, codes of the messaging service, statuses and their labels and badges.
NO_CONNECTION = ("ConnectException", "UnknownHostException", "NoRouteToHostException")
REMOTE_CODES = {
    "recipient_not_on_whatsapp": "RECIPIENT_NOT_ON_WHATSAPP", "recipient_check_failed": "WHATSAPP_RECIPIENT_CHECK_FAILED", "invalid_recipient": "WHATSAPP_INVALID_RECIPIENT",
    "invalid_text": "WHATSAPP_INVALID_TEXT", "text_too_long": "WHATSAPP_TEXT_TOO_LONG", "invalid_request_id": "WHATSAPP_INVALID_REQUEST_ID", "invalid_session_id": "WHATSAPP_INVALID_SESSION",
    "session_not_connected": "WHATSAPP_NOT_CONNECTED", "qr_not_available": "WHATSAPP_QR_NOT_AVAILABLE", "unauthorized": "WHATSAPP_AUTH_MISMATCH",
}
PROVIDER_TERMINAL = ("RECIPIENT_NOT_ON_WHATSAPP", "WHATSAPP_INVALID_RECIPIENT", "WHATSAPP_INVALID_TEXT", "WHATSAPP_TEXT_TOO_LONG", "WHATSAPP_INVALID_REQUEST_ID", "INVALID_TEMPLATE")
PROVIDER_TRANSIENT = ("WHATSAPP_NOT_CONNECTED", "WHATSAPP_RECIPIENT_CHECK_FAILED", "WHATSAPP_SERVICE_CONNECT_FAILED")
RUN_TERMINAL = ("SUCCESS", "PARTIAL", "EXHAUSTED", "FAILED")
RUN_ACTIVE = ("QUEUED", "RUNNING")
CAMPAIGN_LABELS = {
    "CREATED": ("Criada", "badge-gray"), "DISCOVERING": ("Buscando", "badge-blue"), "ANALYZING": ("Analisando", "badge-blue"), "GENERATING": ("Gerando", "badge-blue"),
    "COMPLETED": ("Concluida", "badge-green"), "FAILED": ("Falha", "badge-red"), "PARTIAL": ("Concluída — parcial", "badge-orange"), "EXHAUSTED": ("Concluída — 0 novos leads", "badge-gray"),
}
LEAD_LABELS = {
    "NEW": ("Novo", "badge-gray"), "ANALYZING": ("Analisando", "badge-blue"), "ANALYZED": ("Analisado", "badge-blue"), "MESSAGE_READY": ("Mensagem pronta", "badge-orange"),
    "APPROVED": ("Aprovado", "badge-green"), "SENT": ("Enviado", "badge-green"), "REPLIED": ("Respondeu", "badge-blue"), "INTERESTED": ("Interessado", "badge-green"),
    "SCHEDULED": ("Agendado", "badge-blue"), "CONVERTED": ("Convertido", "badge-green"), "NOT_INTERESTED": ("Nao interessado", "badge-gray"), "DO_NOT_CONTACT": ("Nao prospectar", "badge-red"), "ERROR": ("Erro", "badge-red"),
}


def network_error(kind: Column, message: Column) -> Column:
    """The code of a failed call by the kind of its first cause, then by the message: no connection, or no answer after one."""
    text, timeout = F.lower(F.coalesce(message, F.lit(""))), kind == "SocketTimeoutException"
    never = kind.isin(*NO_CONNECTION) | (timeout & text.contains("connect"))
    late = ~text.rlike("connection (refused|reset)|failed to connect|connect timed out") & text.rlike("read time(d out|out)")
    return cases((never, "WHATSAPP_SERVICE_CONNECT_FAILED"), (kind.contains("SocketTimeout") | late, "WHATSAPP_READ_TIMEOUT"), otherwise="WHATSAPP_SERVICE_CONNECT_FAILED")


def remote_error(error: Column, status: Column) -> Column:
    """The code of what the service answered, else by the status of the answer."""
    return F.coalesce(F.try_element_at(literal_map(REMOTE_CODES), error), F.when(status == 404, "WHATSAPP_QR_NOT_AVAILABLE").otherwise("WHATSAPP_SEND_FAILED"))


def provider_failure(code: Column) -> Column:
    """The provider's own class of a failure; the queue's class, by its longer lists, decides later."""
    return cases((code.isin(*PROVIDER_TERMINAL), "TERMINAL"), (code.isin(*PROVIDER_TRANSIENT), "TRANSIENT"), otherwise="AMBIGUOUS")


def run_is_over(status: Column) -> Column:
    return F.coalesce(status.isin(*RUN_TERMINAL), F.lit(False))


def run_is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*RUN_ACTIVE), F.lit(False))


def label(status: Column, labels: dict[str, tuple[str, str]]) -> Column:
    """A status's label; an unknown status is its own."""
    return F.coalesce(F.try_element_at(literal_map({k: v[0] for k, v in labels.items()}), status), status)


def badge(status: Column, labels: dict[str, tuple[str, str]]) -> Column:
    return F.coalesce(F.try_element_at(literal_map({k: v[1] for k, v in labels.items()}), status), F.lit("badge-gray"))
