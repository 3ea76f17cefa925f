"""Quality, entitlement and audit jobs D01-D20."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_email
from ..operators import quality as D
from ..sources import adapters as src
from ..sources.adapters import (
    DEVICES_SQL, MESSAGES_SQL, PAYMENTS_SQL, PROFILES_SQL, SIGNALS_SQL, canonical_mail_sql, stamp,
)
from .common import global_walk_sql
from .registry import query, with_ctes

AS_OF = "2000-06-01 00:00:00"
TEAM = "('admin', 'publisher', 'moderator')"


def _as_of(text: str = AS_OF):
    return F.lit(text)


@query("d01_validate_signal_legs", with_ctes(SIGNALS_SQL, """
x AS (SELECT id, l_linenumber AS n, (round(l_discount * 100) + 150) / 100 AS a, (round(l_tax * 100) * 30 + 140) / 100 AS b FROM signals),
y AS (SELECT id, CASE WHEN n = 6 THEN 'invalid json' WHEN n = 5 THEN 'not a list' WHEN n = 7 THEN 'fewer than two odds'
    WHEN 1 / a + 1 / b >= 1 THEN 'no arbitrage' END AS reason, round((1 - (1 / a + 1 / b)) / (1 / a + 1 / b) * 100, 2) AS r FROM x)""", """
SELECT reason, count(*) AS n, round(sum(CASE WHEN reason IS NULL THEN r END), 2) AS roi, count(DISTINCT id) AS ids FROM y GROUP BY 1"""))
def legs(spark, sf_dir):
    v = D.validate_signal_legs(src.signals(spark, sf_dir))
    return v.groupBy("reason").agg(
        F.count("*").alias("n"), F.round(F.sum("roi"), 2).alias("roi"), F.count_distinct("id").alias("ids"))


@query("d02_clamp_signal_dates", with_ctes(SIGNALS_SQL, """
SELECT strftime(least(greatest(coalesce(expires_at, created_at + INTERVAL 10 MINUTES), created_at + INTERVAL 1 MINUTE),
  created_at + INTERVAL 2 HOURS), '%Y-%m-%d %H:%M:%S') AS expires, count(*) AS n FROM signals GROUP BY 1"""))
def clamp(spark, sf_dir):
    s = src.signals(spark, sf_dir)
    return D.clamp_signal_dates(s, F.col("created_at")).groupBy(stamp(F.col("expires_at")).alias("expires")).agg(
        F.count("*").alias("n"))


@query("d03_audit_append", with_ctes(SIGNALS_SQL, PROFILES_SQL, """
SELECT s.id AS signal_id, author_id, email AS author_mail, title, CAST(roi AS DOUBLE) AS roi FROM signals s
LEFT JOIN profiles p ON p.id = s.author_id"""))
def audit(spark, sf_dir):
    a = D.audit_append(src.signals(spark, sf_dir), src.profiles(spark, sf_dir), _as_of())
    return a.select("signal_id", "author_id", "author_mail", "title", F.col("roi").cast("double").alias("roi"))


@query("d04_canonical_email", with_ctes(PROFILES_SQL, f"SELECT id, {canonical_mail_sql('email')} AS canon FROM profiles"))
def canon(spark, sf_dir):
    return src.profiles(spark, sf_dir).select("id", canonical_email(F.col("email")).alias("canon"))


@query("d05_one_trial_per_person", with_ctes(PROFILES_SQL, f"""
c AS (SELECT *, {canonical_mail_sql('email')} AS canon FROM profiles),
r AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY created_at, id) AS rn FROM c)""", f"""
SELECT id, CASE WHEN ok THEN 'ok' ELSE 'already used' END AS outcome,
  CASE WHEN ok THEN strftime(greatest(coalesce(sub_expires_at, TIMESTAMP '{AS_OF}'), TIMESTAMP '{AS_OF}') + INTERVAL 2 DAYS,
    '%Y-%m-%d %H:%M:%S') END AS new_expiry
FROM (SELECT *, rn = 1 AND canon NOT IN (SELECT canon FROM c WHERE id % 10 = 0) AS ok FROM r)"""))
def trial(spark, sf_dir):
    p = src.profiles(spark, sf_dir)
    grants = p.filter(F.col("id") % 10 == 0).select(canonical_email(F.col("email")).alias("canon_email"))
    out = D.one_trial_per_person(p.withColumn("requested_at", F.col("created_at")), grants, _as_of())
    return out.select("id", "outcome", stamp(F.col("new_expiry")).alias("new_expiry"))


KEPT_SQL = f"""
kept AS (SELECT d.* FROM devices d JOIN profiles p ON p.id = d.user_id QUALIFY p.role IN {TEAM}
  OR row_number() OVER (PARTITION BY user_id ORDER BY last_seen DESC, session_id) <= 3)"""


@query("d06_keep_recent_devices", with_ctes(DEVICES_SQL, PROFILES_SQL, KEPT_SQL, """
SELECT user_id, session_id, EXISTS (SELECT 1 FROM kept k WHERE k.user_id = d.user_id AND k.session_id = d.session_id) AS kept
FROM devices d"""))
def devices(spark, sf_dir):
    d = src.devices(spark, sf_dir)
    kept = D.keep_recent_devices(d, src.profiles(spark, sf_dir), 3)
    gone = D.evicted_devices(d, kept)
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))).select(
        "user_id", "session_id", "kept")


@query("d07_device_still_valid", with_ctes(DEVICES_SQL, PROFILES_SQL, KEPT_SQL, f"""
req AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN ''
  ELSE concat(event_type, '-', hour(ts) % 4) END AS session_id FROM events)""", f"""
SELECT event_id, coalesce(session_id, '') = '' OR user_id IN (SELECT id FROM profiles WHERE role IN {TEAM})
  OR user_id NOT IN (SELECT user_id FROM kept)
  OR EXISTS (SELECT 1 FROM kept k WHERE k.user_id = r.user_id AND k.session_id = r.session_id) AS valid FROM req r"""))
def valid(spark, sf_dir):
    p = src.profiles(spark, sf_dir)
    known = D.keep_recent_devices(src.devices(spark, sf_dir), p, 3)
    at = F.col("ts").cast("timestamp")
    session = F.when(F.col("event_type") == "click", "").when(
        F.col("event_type") != "view", F.concat_ws("-", F.col("event_type"), (F.hour(at) % 4).cast("string")))
    user = F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1000000000).otherwise(F.col("user_id"))  # some have no device
    req = src.table(spark, sf_dir, "events").select("event_id", user.alias("user_id"), session.alias("session_id"))
    return D.device_still_valid(req, known, p).select("event_id", "valid")


@query("d08_rate_limit_flags", """
WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT event_id, user_id, rn, FALSE AS blocked, [t] AS taken FROM r WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, len(recent) >= 5, CASE WHEN len(recent) >= 5 THEN recent ELSE list_append(recent, t) END
  FROM (SELECT n.*, list_filter(w.taken, lambda x: n.t - x < 172800000000) AS recent
        FROM walk w JOIN r n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
SELECT event_id, blocked FROM walk""")
def limits(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events")
    return D.rate_limit_flags(ev, 5, 2 * 86400, ["user_id"]).select("event_id", "blocked")


@query("d08_global_rate_limit", f"""
WITH RECURSIVE {global_walk_sql(21, 3600, ">=")}
SELECT event_id, walk.rn IS NULL AS blocked FROM r LEFT JOIN walk USING (rn)""")
def global_limit(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events")
    return D.rate_limit_flags(ev, 20, 3600, over=True).select("event_id", "blocked")


ENTITLED = f"(SELECT id FROM profiles WHERE sub_expires_at > TIMESTAMP '{AS_OF}' OR role IN {TEAM})"


@query("d09_entitled_rows", with_ctes(MESSAGES_SQL, PROFILES_SQL, f"""
SELECT conv_id, turn, room FROM messages WHERE room IS DISTINCT FROM 'surebets' OR user_id IN {ENTITLED}"""))
def entitled(spark, sf_dir):
    reads = src.messages(spark, sf_dir).withColumn("viewer_id", F.col("user_id"))
    return D.entitled_rows(reads, src.profiles(spark, sf_dir), _as_of()).select("conv_id", "turn", "room")


@query("d10_privileged_accounts", with_ctes(PROFILES_SQL, f"""
SELECT id, email, username, role, status FROM profiles
WHERE role <> 'user' OR sub_expires_at > TIMESTAMP '{AS_OF}' + INTERVAL 60 DAYS"""))
def accounts(spark, sf_dir):
    return D.privileged_accounts(src.profiles(spark, sf_dir), _as_of()).drop("sub_expires_at", "created_at")


@query("d11_account_census", with_ctes(PROFILES_SQL, f"""
SELECT count(*) AS accounts, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (role = 'publisher') AS publishers,
  count(*) FILTER (role = 'moderator') AS moderators, count(*) FILTER (sub_expires_at > TIMESTAMP '{AS_OF}') AS active,
  count(*) FILTER (sub_expires_at > TIMESTAMP '{AS_OF}' + INTERVAL 60 DAYS) AS unusually_long FROM profiles"""))
def census(spark, sf_dir):
    return D.account_census(src.profiles(spark, sf_dir), _as_of())


@query("d12_access_without_payment", with_ctes(PROFILES_SQL, PAYMENTS_SQL, f"""
SELECT id, email, username, role FROM profiles p WHERE role = 'user' AND sub_expires_at > TIMESTAMP '{AS_OF}'
  AND (SELECT count(*) FROM payments r WHERE r.user_id = p.id AND r.status = 'approved') = 0"""))
def unpaid(spark, sf_dir):
    return D.access_without_payment(src.profiles(spark, sf_dir), src.payments(spark, sf_dir), _as_of()).drop("sub_expires_at")


@query("d13_username_duplicates", with_ctes(PROFILES_SQL, """
SELECT lower(username) AS username, count(*) AS n FROM profiles WHERE username IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""))
def name_dups(spark, sf_dir):
    return D.username_duplicates(src.profiles(spark, sf_dir))


@query("d13_username_available", with_ctes(PROFILES_SQL, """
SELECT concat('NAME', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'X' ELSE '' END) AS name, NOT EXISTS (SELECT 1 FROM profiles
  WHERE lower(username) = concat('name', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END)) AS available FROM supplier"""))
def available(spark, sf_dir):
    key = F.col("s_suppkey")
    names = src.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("NAME"), key.cast("string"), F.when(key % 2 == 0, "X").otherwise("")).alias("name"))
    return D.username_available(names, src.profiles(spark, sf_dir))


@query("d14_devices_per_user", with_ctes(DEVICES_SQL, PROFILES_SQL, """
SELECT user_id, count(*) AS devices, username, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM devices JOIN profiles ON profiles.id = user_id GROUP BY 1, 3"""))
def per_user(spark, sf_dir):
    d = D.devices_per_user(src.devices(spark, sf_dir), src.profiles(spark, sf_dir))
    return d.withColumn("last_seen", stamp(F.col("last_seen")))


@query("d15_stamp_identity", with_ctes(MESSAGES_SQL, PROFILES_SQL, """
SELECT conv_id, turn, coalesce(role, 'user') AS sender_role, coalesce(username, split_part(coalesce(email, ''), '@', 1)) AS username,
  email, length(text) AS n_chars FROM (SELECT * REPLACE (CASE WHEN conv_id % 4 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id)
  FROM messages) LEFT JOIN profiles ON id = user_id"""))
def stamped(spark, sf_dir):
    sender = F.when(F.col("conv_id") % 4 == 0, F.col("user_id") + 1000000000).otherwise(F.col("user_id"))  # some are unknown
    m = src.messages(spark, sf_dir).withColumn("sender_role", F.lit("admin")).withColumn("user_id", sender)
    s = D.stamp_identity(m, src.profiles(spark, sf_dir))
    return s.select("conv_id", "turn", "sender_role", "username", "email", F.length("text").alias("n_chars"))


SIGNUPS_SQL = """
signups AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS id, concat('new', c_custkey, '@mail.example') AS email,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'NAME' ELSE 'Name' END, c_custkey - c_custkey % 9, 'x') END AS username
  FROM customer)"""


@query("d16_signup_defaults", with_ctes(PROFILES_SQL, SIGNUPS_SQL, """
fresh AS (SELECT *, row_number() OVER (PARTITION BY lower(username) ORDER BY id) AS rn FROM signups WHERE id NOT IN (SELECT id FROM profiles))""", """
SELECT id, email, CASE WHEN username <> '' AND rn = 1 AND NOT EXISTS (SELECT 1 FROM profiles k WHERE lower(k.username) = lower(f.username))
  THEN username END AS username, 'user' AS role, 'pending' AS status FROM fresh f"""))
def signup(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.concat(F.when(key % 2 == 0, "NAME").otherwise("Name"), (key - key % 9).cast("string"), F.lit("x"))
    signups = src.table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, key).otherwise(key + 1000000000).alias("id"),
        F.concat(F.lit("new"), key.cast("string"), F.lit("@mail.example")).alias("email"),
        F.when(key % 4 == 0, "").otherwise(name).alias("username"))
    return D.signup_defaults(signups, src.profiles(spark, sf_dir))


@query("d17_guarded_update", with_ctes(PROFILES_SQL, """
SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 'renamed' ELSE p.username END AS username,
  CASE WHEN p.id % 3 = 0 AND a.role = 'admin' THEN 'publisher' ELSE p.role END AS role,
  CASE WHEN p.id % 3 = 0 AND a.role = 'admin' THEN 'blocked' ELSE p.status END AS status
FROM profiles p LEFT JOIN profiles a ON a.id = p.id % 100"""))
def guarded(spark, sf_dir):
    p = src.profiles(spark, sf_dir)
    changes = p.filter(F.col("id") % 3 == 0).select(
        "id", (F.col("id") % 100).alias("actor_id"), F.lit("renamed").alias("username"), F.lit("publisher").alias("role"),
        F.lit("blocked").alias("status"))
    return D.guarded_update(p, changes, p).select("id", "username", "role", "status")


@query("d18_active_listing", """
SELECT p_partkey AS id, p_brand AS kind, p_size AS sort FROM part WHERE p_size % 2 = 0 ORDER BY kind, sort, id""")
def listing(spark, sf_dir):
    rows = src.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_size").alias("sort"),
        (F.col("p_size") % 2 == 0).alias("active"))
    return D.active_listing(rows).drop("active")


@query("d19_own_or_admin_rows", with_ctes(PAYMENTS_SQL, PROFILES_SQL, """
SELECT id, user_id, v AS viewer_id FROM (SELECT *, CASE WHEN id % 3 = 0 THEN user_id ELSE id % 200 END AS v FROM payments)
WHERE v = user_id OR v IN (SELECT id FROM profiles WHERE role = 'admin')"""))
def own(spark, sf_dir):
    reads = src.payments(spark, sf_dir).withColumn(
        "viewer_id", F.when(F.col("id") % 3 == 0, F.col("user_id")).otherwise(F.col("id") % 200))
    return D.own_or_admin_rows(reads, src.profiles(spark, sf_dir)).select("id", "user_id", "viewer_id")


@query("d20_authorised_writes", with_ctes(PROFILES_SQL, """
w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'signal' WHEN 1 THEN 'message' ELSE 'payment' END AS kind, user_id AS actor_id,
  CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS owner_id,
  CASE event_type WHEN 'view' THEN 'surebets' WHEN 'click' THEN 'general' END AS room FROM events)""", """
SELECT event_id, CASE WHEN kind = 'signal' AND actor_id <> owner_id THEN 'author is not the actor'
  WHEN kind = 'signal' AND role NOT IN ('admin', 'publisher') THEN 'not a publisher'
  WHEN kind = 'message' AND room = 'surebets' AND role NOT IN ('admin', 'publisher') THEN 'room is gated'
  WHEN kind = 'payment' AND actor_id <> owner_id THEN 'owner is not the actor' END AS reason
FROM w JOIN profiles p ON p.id = actor_id"""))
def writes(spark, sf_dir):
    e = F.col("event_id")
    w = src.table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 3 == 0, "signal").when(e % 3 == 1, "message").otherwise("payment").alias("kind"),
        F.col("user_id").alias("actor_id"), F.when(e % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("owner_id"),
        F.when(F.col("event_type") == "view", "surebets").when(F.col("event_type") == "click", "general").alias("room"))
    return D.authorised_writes(w, src.profiles(spark, sf_dir)).select("event_id", "reason")
