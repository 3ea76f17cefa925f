"""Data-quality, entitlement and audit jobs over membership tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import GATED_ROOM, PRIVILEGED_ROLES, PUBLISHING_ROLES
from ..functions.text import canonical_email
from .budget import grant


def _now(as_of: Column) -> Column:
    return as_of.cast("timestamp")


def _mins(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def validate_signal_legs(signals: DataFrame) -> DataFrame:
    """Add ``reason`` (NULL when accepted) and the recomputed ``roi``.

    Unreadable prices and prices up to 1 are ignored, as published.
    """
    legs = F.col("legs")
    elements = F.from_json(legs, "array<string>")
    odds = F.filter(
        F.transform(elements, lambda e: F.get_json_object(e, "$.odd").try_cast("double")),
        lambda o: o.isNotNull() & (o > 1),
    )
    out = signals.withColumn("__odds", F.coalesce(odds, F.array().cast("array<double>")))
    s = F.aggregate("__odds", F.lit(0.0), lambda acc, o: acc + 1.0 / o)
    out = out.withColumn("__roi", F.try_divide(1.0 - s, s) * 100.0)
    reason = (
        F.when(F.try_parse_json(legs).isNull(), "invalid json")
        .when(~F.ltrim(legs).startswith("["), "not a list")
        .when(F.size("__odds") < 2, "fewer than two odds")
        .when(F.col("__roi") <= 0, "no arbitrage")
    )
    return (
        out.withColumn("reason", reason)
        .withColumn("roi", F.when(F.col("reason").isNull(), F.round("__roi", 2)))
        .drop("__odds", "__roi")
    )


def clamp_signal_dates(signals: DataFrame, now: Column) -> DataFrame:
    """Creation is now; expiry defaults to +10 min and stays in [+1 min, +2 h]."""
    t = _now(now)
    expiry = F.coalesce(F.col("expires_at"), t + _mins(10))
    return signals.withColumn("expires_at", F.least(F.greatest(expiry, t + _mins(1)), t + _mins(120))).withColumn(
        "created_at", t
    )


def audit_append(signals: DataFrame, profiles: DataFrame, logged_at: Column) -> DataFrame:
    """Audit rows of published signals with the author's address."""
    mails = profiles.select(F.col("id").alias("author_id"), F.col("email").alias("author_mail"))
    return signals.join(mails, "author_id", "left").select(
        F.col("id").alias("signal_id"), "author_id", "author_mail", "title", "roi", "legs", "expires_at",
        _now(logged_at).alias("logged_at"),
    )


def one_trial_per_person(requests: DataFrame, grants: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Grant the first request per canonical address, once for all time."""
    rows = requests.withColumn("canon_email", canonical_email(F.col("email")))
    firsts = rows.filter(F.col("email").isNotNull()).groupBy("canon_email").agg(
        F.min_by("id", F.struct("requested_at", "id")).alias("id")
    )
    granted = firsts.join(grants.select("canon_email"), "canon_email", "left_anti").select("id", F.lit(True).alias("__ok"))
    base = F.greatest(F.coalesce("sub_expires_at", _now(as_of)), _now(as_of))
    return rows.join(granted, "id", "left").select(
        *rows.columns,
        F.when(F.col("email").isNull(), "unknown account").when(F.col("__ok"), "ok").otherwise("already used").alias("outcome"),
        F.when(F.col("__ok"), base + F.make_dt_interval(days=F.lit(days))).alias("new_expiry"),
    )


def privileged(profiles: DataFrame, roles: list[str] | None = None) -> DataFrame:
    return profiles.filter(F.col("role").isin(roles or PRIVILEGED_ROLES)).select(F.col("id").alias("user_id"))


def keep_recent_devices(devices: DataFrame, profiles: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest devices per member; privileged members keep all.

    Returns the kept rows; the evicted ones are the complement.
    """
    team = privileged(profiles)
    newest = Window.partitionBy("user_id").orderBy(F.desc("last_seen"), "session_id")
    plain = (
        devices.join(team, "user_id", "left_anti")
        .withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n).drop("rank")
    )
    return plain.unionByName(devices.join(team, "user_id", "left_semi"))


def evicted_devices(devices: DataFrame, kept: DataFrame) -> DataFrame:
    """Devices that were not kept."""
    return devices.join(kept.select("user_id", "session_id"), ["user_id", "session_id"], "left_anti")


def device_still_valid(requests: DataFrame, devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``valid``: no session, privileged, no device registered, or this device registered."""
    team = privileged(profiles).withColumn("__team", F.lit(True))
    known = devices.select("user_id").distinct().withColumn("__known", F.lit(True))
    mine = devices.select("user_id", "session_id").distinct().withColumn("__mine", F.lit(True))
    blank = F.coalesce("session_id", F.lit("")) == ""
    out = (
        requests.join(team, "user_id", "left").join(known, "user_id", "left").join(mine, ["user_id", "session_id"], "left")
    )
    valid = blank | F.coalesce("__team", F.lit(False)) | F.col("__known").isNull() | F.coalesce("__mine", F.lit(False))
    return out.select(*requests.columns, valid.alias("valid"))


def rate_limit_flags(
    events: DataFrame, limit: int, window_s: int, by: list[str] | None = None, over: bool = False, order: str = "event_id"
) -> DataFrame:
    """Add ``blocked`` from the number of earlier accepted attempts in the window.

    ``over=False`` blocks from ``limit`` accepted ones on, ``over=True`` only above; what is blocked leaves no row and does
    not count. Rows exactly ``window_s`` old have left the window.
    """
    accepted = grant(events, limit + 1 if over else limit, by, window_s, keep_edge=False, order=order)
    return accepted.withColumn("blocked", ~F.col("granted")).drop("granted")


def _entitled(as_of: Column) -> Column:
    return (F.col("sub_expires_at") > _now(as_of)) | F.col("role").isin(PRIVILEGED_ROLES)


def entitled_rows(reads: DataFrame, profiles: DataFrame, as_of: Column, room: str | None = "room") -> DataFrame:
    """Read attempts (``viewer_id`` on each row) the viewer is entitled to.

    With a room column only the gated room asks for an entitlement.
    """
    ok = profiles.filter(_entitled(as_of)).select(F.col("id").alias("viewer_id"))
    if room is None:
        return reads.join(ok, "viewer_id", "left_semi")
    gated = F.col(room).eqNullSafe(F.lit(GATED_ROOM))
    return reads.filter(~gated).unionByName(reads.filter(gated).join(ok, "viewer_id", "left_semi"))


def privileged_accounts(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Any role above member, or a subscription longer than 60 days."""
    far = _now(as_of) + F.make_dt_interval(days=F.lit(60))
    return profiles.filter((F.col("role") != "user") | (F.col("sub_expires_at") > far)).select(
        "id", "email", "username", "role", "status", "sub_expires_at", "created_at"
    ).orderBy(F.desc("created_at"), "id")


def account_census(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Six counts in one pass."""
    now = _now(as_of)
    return profiles.agg(
        F.count("*").alias("accounts"),
        *[F.count_if(F.col("role") == r).alias(r + "s") for r in ("admin", "publisher", "moderator")],
        F.count_if(F.col("sub_expires_at") > now).alias("active"),
        F.count_if(F.col("sub_expires_at") > now + F.make_dt_interval(days=F.lit(60))).alias("unusually_long"),
    )


def access_without_payment(profiles: DataFrame, payments: DataFrame, as_of: Column) -> DataFrame:
    """Active members without one approved payment."""
    paid = payments.filter(F.col("status") == "approved").select(F.col("user_id").alias("id"))
    return (
        profiles.filter((F.col("sub_expires_at") > _now(as_of)) & (F.col("role") == "user"))
        .join(paid, "id", "left_anti")
        .select("id", "email", "username", "role", "sub_expires_at").orderBy(F.desc("sub_expires_at"), "id")
    )


def username_duplicates(profiles: DataFrame) -> DataFrame:
    """Usernames used more than once, whatever the case."""
    return (
        profiles.filter(F.col("username").isNotNull()).groupBy(F.lower("username").alias("username"))
        .agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def username_available(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``available`` to each asked name."""
    taken = profiles.filter(F.col("username").isNotNull()).select(F.lower("username").alias("__low")).distinct()
    taken = taken.withColumn("__hit", F.lit(True))
    return names.join(taken, F.lower("name") == F.col("__low"), "left").select(
        *names.columns, F.col("__hit").isNull().alias("available")
    )


def devices_per_user(devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """Number of devices and the latest use per member."""
    per = devices.groupBy("user_id").agg(F.count("*").alias("devices"), F.max("last_seen").alias("last_seen"))
    names = profiles.select(F.col("id").alias("user_id"), "username")
    return per.join(names, "user_id").orderBy(F.desc("devices"), "user_id")


def stamp_identity(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sender role, name and address come from the profile, never from the row."""
    who = profiles.select(F.col("id").alias("user_id"), "role", F.col("username").alias("__name"), F.col("email").alias("__mail"))
    keep = [c for c in messages.columns if c not in ("sender_role", "username", "email")]
    local = F.substring_index(F.coalesce("__mail", F.lit("")), "@", 1)
    return messages.select(*keep).join(who, "user_id", "left").select(
        *keep, F.coalesce("role", F.lit("user")).alias("sender_role"), F.coalesce("__name", local).alias("username"),
        F.col("__mail").alias("email"),
    )


def signup_defaults(signups: DataFrame, profiles: DataFrame) -> DataFrame:
    """New profiles: known ids skipped, blank or taken names dropped, role and status forced."""
    new = signups.join(profiles.select("id"), "id", "left_anti").withColumn("username", F.nullif("username", F.lit("")))
    low = F.lower("username").alias("__low")
    taken = profiles.filter(F.col("username").isNotNull()).select(low)
    owners = (
        new.filter(F.col("username").isNotNull()).groupBy(low).agg(F.min("id").alias("id"))
        .join(taken, "__low", "left_anti").select("id", F.lit(True).alias("__own"))
    )
    return new.join(owners, "id", "left").select(
        "id", "email", F.when(F.col("__own"), F.col("username")).alias("username"),
        F.lit("user").alias("role"), F.lit("pending").alias("status"),
    )


def guarded_update(old: DataFrame, changes: DataFrame, actors: DataFrame) -> DataFrame:
    """Apply profile changes; privileges move only when the actor is an administrator."""
    guarded = ["role", "status", "sub_expires_at", "sub_plan"]
    admins = actors.filter(F.col("role") == "admin").select(F.col("id").alias("actor_id"), F.lit(True).alias("__admin"))
    new = changes.join(admins, "actor_id", "left").select(
        "id", F.lit(True).alias("__changed"), F.coalesce("__admin", F.lit(False)).alias("__admin"),
        *[F.col(c).alias(f"__n_{c}") for c in old.columns if c in changes.columns and c != "id"],
    )
    cols = []
    for c in old.columns:
        if f"__n_{c}" not in new.columns:
            cols.append(F.col(c))
            continue
        may = F.col("__changed") & (F.col("__admin") if c in guarded else F.lit(True))
        cols.append(F.when(may, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
    return old.join(new, "id", "left").select(*cols)


def active_listing(rows: DataFrame) -> DataFrame:
    """Active rows in display order."""
    return rows.filter(F.col("active")).orderBy("kind", "sort", "id")


def own_or_admin_rows(reads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Read attempts on one's own rows, or on any row by an administrator."""
    admins = profiles.filter(F.col("role") == "admin").select(F.col("id").alias("viewer_id"))
    own = F.col("viewer_id").eqNullSafe(F.col("user_id"))
    return reads.filter(own).unionByName(reads.filter(~own).join(admins, "viewer_id", "left_semi"))


def authorised_writes(writes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``reason`` (NULL when accepted) to a batch of writes.

    ``writes``: ``kind`` (signal, message or payment), ``actor_id``, ``owner_id``, ``room``.
    """
    who = profiles.filter(F.col("role").isin(PUBLISHING_ROLES)).select(
        F.col("id").alias("actor_id"), F.lit(True).alias("__pub"))
    publisher = F.coalesce("__pub", F.lit(False))
    own = F.col("actor_id").eqNullSafe(F.col("owner_id"))
    reason = (
        F.when((F.col("kind") == "signal") & ~own, "author is not the actor")
        .when((F.col("kind") == "signal") & ~publisher, "not a publisher")
        .when((F.col("kind") == "message") & F.col("room").eqNullSafe(F.lit(GATED_ROOM)) & ~publisher, "room is gated")
        .when((F.col("kind") == "payment") & ~own, "owner is not the actor")
    )
    return writes.join(who, "actor_id", "left").select(*writes.columns, reason.alias("reason"))
