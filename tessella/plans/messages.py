"""Message-log queries; envelopes are derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import messages as ms
from tessella.plans.registry import query
from tessella.sources.tables import table

ENV_SQL = """env AS (SELECT conv_id * 100 + turn AS message_id, conv_id, turn, text,
  '{"encrypted_message":"' || md5(text) || '","encrypted_aes_key":"' || md5(role) || '"'
  || CASE WHEN conv_id % 11 = 3 THEN '' ELSE ',"iv":"' || turn || '"' END
  || CASE WHEN turn % 2 = 0 THEN ',"signature":"s' || turn || '","sender_fingerprint":"' || sha256('pem' || (conv_id % 150)) || '"' ELSE '' END
  || '}' AS js FROM conversations),
body AS (SELECT *, CASE WHEN conv_id % 13 = 5 THEN 'not base64 !!' WHEN conv_id % 13 = 6 THEN to_base64(encode('plain ' || turn))
  ELSE to_base64(encode(js)) END AS body FROM env),
dec AS (SELECT message_id, TRY(decode(from_base64(body))) AS doc FROM body),
f AS (SELECT message_id, CASE WHEN json_valid(doc) THEN doc END AS doc FROM dec),
decoded AS (SELECT message_id, doc->>'$.encrypted_message' AS encrypted_message, doc->>'$.encrypted_aes_key' AS encrypted_aes_key,
  doc->>'$.iv' AS iv, doc->>'$.signature' AS signature, doc->>'$.sender_fingerprint' AS sender_fingerprint,
  CASE WHEN doc IS NULL THEN 'bad format' WHEN doc->>'$.iv' IS NULL THEN 'missing fields' ELSE 'ok' END AS status FROM f)"""


def _envelopes(spark, d):
    js = F.concat(
        F.lit('{"encrypted_message":"'), F.md5("text"), F.lit('","encrypted_aes_key":"'), F.md5("role"), F.lit('"'),
        F.when(F.col("conv_id") % 11 == 3, "").otherwise(F.concat(F.lit(',"iv":"'), "turn", F.lit('"'))),
        F.when(F.col("turn") % 2 == 0, F.concat(
            F.lit(',"signature":"s'), "turn", F.lit('","sender_fingerprint":"'),
            F.sha2(F.concat(F.lit("pem"), F.col("conv_id") % 150), 256), F.lit('"'))).otherwise(""), F.lit("}"))
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        F.when(F.col("conv_id") % 13 == 5, "not base64 !!")
        .when(F.col("conv_id") % 13 == 6, F.base64(F.concat(F.lit("plain "), "turn").cast("binary")))
        .otherwise(F.base64(js.cast("binary"))).alias("body"))


def _keys(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("key_name"), F.concat(F.lit("pem"), "s_suppkey").alias("pem"))


@query("envelope_decode", f"WITH {ENV_SQL} SELECT * FROM decoded")
def envelope_decode(spark, d):
    return ms.envelope_decode(_envelopes(spark, d)).drop("timestamp")


@query("key_fingerprint", "SELECT s_name AS key_name, sha256('pem' || s_suppkey) AS fingerprint FROM supplier")
def key_fingerprint(spark, d):
    return ms.key_fingerprints(_keys(spark, d)).select("key_name", "fingerprint")


@query("signer_lookup", f"""WITH {ENV_SQL} SELECT message_id, s_name AS key_name,
CASE WHEN signature IS NULL THEN 'not provided' WHEN s_name IS NULL THEN 'key not found' ELSE 'provided' END AS signature_status
FROM decoded LEFT JOIN supplier ON sha256('pem' || s_suppkey) = sender_fingerprint WHERE status = 'ok'""")
def signer_lookup(spark, d):
    return ms.signer_lookup(ms.envelope_decode(_envelopes(spark, d)), _keys(spark, d))


def _contacts(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("contact_id"),
        F.concat_ws("-", "c_mktsegment", F.col("c_custkey") % 100).alias("nickname"),
        F.concat(F.lit("/keys/"), "c_name", F.lit(".pem")).alias("path"))


BOOK = """contacts AS (SELECT c_custkey AS id, c_mktsegment || '-' || (c_custkey % 100) AS nickname, '/keys/' || c_name || '.pem' AS path FROM customer),
first AS (SELECT nickname, min(id) AS id FROM contacts GROUP BY ALL)"""


@query("contact_uniqueness", f"""WITH {BOOK} SELECT contacts.id AS contact_id, contacts.nickname, path,
contacts.id = first.id AS accepted FROM contacts JOIN first USING (nickname)""")
def contact_uniqueness(spark, d):
    return ms.unique_contacts(_contacts(spark, d))


@query("contact_resolve", f"""WITH {BOOK}, q AS (SELECT conv_id * 100 + turn AS message_id, 'MACHINERY-' || conv_id AS nickname FROM conversations)
SELECT q.message_id, q.nickname, path, path IS NOT NULL AS known FROM q
LEFT JOIN (SELECT contacts.nickname, path FROM contacts JOIN first USING (nickname, id)) b ON b.nickname = q.nickname""")
def contact_resolve(spark, d):
    asked = table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        F.concat(F.lit("MACHINERY-"), "conv_id").alias("nickname"))
    return ms.contact_resolve(asked, _contacts(spark, d))


@query("message_log", """SELECT user_id AS sender, event_id * 17 % 40 AS recipient, count(*) AS messages,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY ALL""")
def message_log(spark, d):
    log = table(spark, d, "events").select(
        F.col("user_id").alias("sender"), (F.col("event_id") * 17 % 40).alias("recipient"),
        F.col("ts").alias("created_at"))
    return ms.message_counts(log).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))
