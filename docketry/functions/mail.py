"""Mail messages, address lists and mail dates."""

from __future__ import annotations

import email
import email.policy
import hashlib
from datetime import timezone
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PEOPLE = "array<struct<name:string,email:string>>"
SCHEMA = (
    f"message_id string, date_raw string, date_iso string, subject string, `from` {_PEOPLE}, `to` {_PEOPLE}, cc {_PEOPLE}, bcc {_PEOPLE}, reply_to {_PEOPLE}, headers map<string,string>, "
    "body_text string, body_html string, attachments array<struct<filename:string,content_type:string,size_bytes:bigint,sha256:string>>"
)


def people(value: str | None) -> list[dict]:
    """Names and addresses of a header, as written; entries without an address fall out."""
    return [{"name": n, "email": a} for n, a in getaddresses([value or ""]) if a]


def utc_iso(value: str | None) -> str | None:
    """Mail date as an ISO stamp in UTC; without zone it counts as UTC."""
    try:
        d = parsedate_to_datetime(value)
    except (TypeError, ValueError, IndexError):
        return None
    return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()


def _content(part) -> str:
    try:
        return part.get_content()
    except (LookupError, UnicodeDecodeError, KeyError, AttributeError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def parse(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, rich = m.get_body(("plain",)), m.get_body(("html",))
    if plain is None:
        plain = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_attachment()), None)
    files = []
    for a in m.iter_attachments():
        data = a.get_payload(decode=True) or b""
        digest = hashlib.sha256(data).hexdigest()
        files.append({"filename": a.get_filename() or f"attachment-{digest[:8]}", "content_type": a.get_content_type(), "size_bytes": len(data), "sha256": digest})
    h = lambda n: str(m[n]) if m[n] is not None else None
    lists = {k: people(h(n)) for k, n in (("from", "From"), ("to", "To"), ("cc", "Cc"), ("bcc", "Bcc"), ("reply_to", "Reply-To"))}
    return {"message_id": h("Message-ID"), "date_raw": h("Date"), "date_iso": utc_iso(h("Date")), "subject": h("Subject"), **lists, "headers": {k: str(v) for k, v in m.items()}, "body_text": _content(plain) if plain is not None else None, "body_html": _content(rich) if rich is not None else None, "attachments": files}


def _parse_all(raw: pd.Series) -> pd.DataFrame:
    names = ["message_id", "date_raw", "date_iso", "subject", "from", "to", "cc", "bcc", "reply_to", "headers", "body_text", "body_html", "attachments"]
    return pd.DataFrame([parse(bytes(r)) if r is not None else dict.fromkeys(names) for r in raw], columns=names)


def parsed(raw: Column) -> Column:
    """Struct of one message's bytes; nulls for null."""
    return F.pandas_udf(_parse_all, SCHEMA)(raw)


def _people_all(values: pd.Series) -> pd.Series:
    return values.map(people)


def addresses(value: Column) -> Column:
    return F.pandas_udf(_people_all, _PEOPLE)(value)


def _iso_all(values: pd.Series) -> pd.Series:
    return values.map(utc_iso)


def mail_date(value: Column) -> Column:
    """Mail date to an ISO stamp in UTC, or null."""
    return F.pandas_udf(_iso_all, "string")(value)


def address_text(people_: Column) -> Column:
    one = lambda p: F.when(F.coalesce(p["name"], F.lit("")) != "", F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">"))).otherwise(p["email"])
    return F.array_join(F.transform(people_, one), ", ")


def transcript(m: Column) -> Column:
    """A parsed message as text for people: header lines, a blank line, the body, then its attachments."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    files = F.transform(m["attachments"], lambda a: F.concat(F.lit("- "), a["filename"], F.lit(" ("), a["content_type"], F.lit(", "), a["size_bytes"].cast("string"), F.lit(" bytes)")))
    heads = [line("From", address_text(m["from"])), line("To", address_text(m["to"])), line("Cc", address_text(m["cc"])), line("Date", F.coalesce(m["date_iso"], m["date_raw"])), line("Subject", m["subject"])]
    body = F.coalesce(m["body_text"], m["body_html"], F.lit(""))
    return F.concat_ws("\n", *heads, F.lit(""), body, F.when(F.size(files) > 0, F.concat(F.lit("\nAttachments:\n"), F.array_join(files, "\n"))))
