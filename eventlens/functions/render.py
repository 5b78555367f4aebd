"""Message bodies for incidents. ``details`` is a column of any type; it is shown as JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventlens.schema import JSON_TEXT

# Texts that receivers of the messages see.
ALERT = "Security Incident Alert"
UNKNOWN = "Unknown"
NO_DESCRIPTION = "No description available"
PRETTY = {"pretty": "true", **JSON_TEXT}


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def subject(title: Column) -> Column:
    return F.concat(F.lit(f"{ALERT}: "), _or(title, UNKNOWN))


def escaped(text: Column) -> Column:
    """Text that HTML shows as it is: event types and titles come from logs that anybody may write to."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def email_body(title: Column, severity: Column, timestamp: Column, description: Column, details: Column) -> Column:
    """HTML page with one paragraph per field."""
    fields = [("Title", _or(title, UNKNOWN)), ("Severity", _or(severity, UNKNOWN)), ("Timestamp", _or(timestamp, UNKNOWN))]
    rows = [F.concat(F.lit(f"<p><strong>{name}:</strong> "), escaped(value), F.lit("</p>")) for name, value in fields]
    return F.concat_ws(
        "\n",
        F.lit(f"<html><body><h2>{ALERT}</h2>"),
        *rows,
        F.lit("<p><strong>Description:</strong></p>"),
        F.concat(F.lit("<p>"), escaped(_or(description, NO_DESCRIPTION)), F.lit("</p>")),
        F.lit("<p><strong>Details:</strong></p>"),
        F.concat(F.lit("<pre>"), escaped(F.coalesce(F.to_json(details, PRETTY), F.lit("{}"))), F.lit("</pre>")),
        F.lit("</body></html>"),
    )


def _text(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def chat_blocks(title: Column, severity: Column, timestamp: Column, description: Column, details: Column) -> Column:
    """JSON array of message blocks: a header, two fields, the description and the details."""
    none_text = F.lit(None).cast("struct<type:string,text:string>")
    none_fields = F.lit(None).cast("array<struct<type:string,text:string>>")

    def block(kind: str, text: Column = none_text, fields: Column = none_fields) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), fields.alias("fields"))

    def marked(name: str, value: Column) -> Column:
        return _text("mrkdwn", F.concat(F.lit(f"*{name}:*\n"), value))

    body = F.concat(F.lit("```"), F.coalesce(F.to_json(details, PRETTY), F.lit("{}")), F.lit("```"))
    return F.to_json(
        F.array(
            block("header", _text("plain_text", subject(title))),
            block(
                "section",
                fields=F.array(marked("Severity", _or(severity, UNKNOWN)), marked("Timestamp", _or(timestamp, UNKNOWN))),
            ),
            block("section", marked("Description", _or(description, NO_DESCRIPTION))),
            block("section", marked("Details", body)),
        )
    )
