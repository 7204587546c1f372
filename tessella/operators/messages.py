"""Message envelopes, keys and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE = ("encrypted_message string, encrypted_aes_key string, iv string, signature string, "
            "sender_fingerprint string, timestamp string")
REQUIRED = ["encrypted_message", "encrypted_aes_key", "iv"]


def envelope_decode(messages: DataFrame) -> DataFrame:
    """(message_id, body) → fields and a status per message."""
    text = F.col("body").try_cast("string")
    raw = F.try_to_binary(text, F.lit("base64"))
    doc = F.from_json(F.decode(raw, "UTF-8"), ENVELOPE, {"mode": "PERMISSIVE"})
    valid = F.json_object_keys(F.decode(raw, "UTF-8")).isNotNull()
    missing = F.lit(False)
    for f in REQUIRED:
        missing = missing | (F.coalesce(F.col(f"e.{f}"), F.lit("")) == "")
    return messages.withColumns({"e": doc, "ok": valid}).select(
        "message_id", "e.*",
        F.when(~F.coalesce("ok", F.lit(False)), "bad format").when(missing, "missing fields")
        .otherwise("ok").alias("status"))


def key_fingerprints(keys: DataFrame) -> DataFrame:
    return keys.withColumn("fingerprint", F.sha2("pem", 256))


def signer_lookup(decoded: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct fingerprints are looked up, so a busy sender is one row."""
    known = key_fingerprints(keys).select(F.col("fingerprint").alias("sender_fingerprint"), "key_name")
    asked = decoded.select("sender_fingerprint").distinct().join(known, "sender_fingerprint", "left")
    signed = (F.coalesce("signature", F.lit("")) != "") & (F.coalesce("sender_fingerprint", F.lit("")) != "")
    return decoded.where("status = 'ok'").join(asked, "sender_fingerprint", "left").select(
        "message_id", "key_name",
        F.when(~signed, "not provided").when(F.col("key_name").isNull(), "key not found")
        .otherwise("provided").alias("signature_status"))


def unique_contacts(contacts: DataFrame) -> DataFrame:
    """The first of a nickname is kept, later ones are rejected."""
    first = contacts.groupBy("nickname").agg(F.min("contact_id").alias("first_id"))
    return contacts.join(first, "nickname").select(
        "contact_id", "nickname", "path", (F.col("contact_id") == F.col("first_id")).alias("accepted"))


def contact_resolve(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    book = unique_contacts(contacts).where("accepted").select("nickname", "path")
    return requests.join(book, "nickname", "left").select(
        "message_id", "nickname", "path", F.col("path").isNotNull().alias("known"))


def message_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sender", "recipient").agg(
        F.count("*").alias("messages"), F.max("created_at").alias("last_at"))
