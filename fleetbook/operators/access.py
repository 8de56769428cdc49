"""User access reports: access list, profiles, existence, sessions, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.functions.filters import ListFilter
from fleetbook.functions.predicates import contains_ci
from fleetbook.sources.tables import Tables


def _semi(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    if ids is None:
        return df
    k = ids.select(F.col(ids.columns[0]).alias("__k")).distinct()
    return df.join(k, df[key] == k["__k"], "left_semi")


def last_login(t: Tables) -> DataFrame:
    """Latest session start per user (partial aggregation: a hot user is reduced map-side)."""
    return t.sessions.groupBy("user_id").agg(F.max("start_time").alias("start_time"))


def access_report(t: Tables, user_type: str, flt: ListFilter | None = None) -> DataFrame:
    """Users of an access class with their last login.

    'authorized' selects type = 'authorized'; any other value selects type <> 'authorized'
    (NULL type in neither).  Archived users are included.  A name term filters by ILIKE.
    """
    flt = flt or ListFilter()
    u = t.users
    cls = (F.col("type") == "authorized") if user_type == "authorized" else (F.col("type") != "authorized")
    cond = cls if not flt.is_searched else cls & contains_ci("name", flt.name)
    u = u.filter(cond).select("id", "name", "email", "authentication_times", "status")
    s = last_login(t)
    return (u.join(s, u["id"] == s["user_id"], "left")
            .select("id", "name", "email", "authentication_times", "status", "start_time"))


def user_profile(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Contact details of live users (image '' when unset)."""
    u = _semi(t.users.filter(F.col("archived_at").isNull()), "id", ids)
    return u.select("id", "name", "email", "phone_no",
                    F.coalesce(F.col("image"), F.lit("")).alias("image"))


def existing_users(t: Tables, requests: DataFrame) -> DataFrame:
    """The requests whose email AND phone both equal one live user's."""
    live = t.users.filter(F.col("archived_at").isNull()).select(
        F.col("email").alias("__e"), F.col("phone_no").alias("__p"))
    return requests.join(live, (requests["email"] == live["__e"])
                         & (requests["phone_no"] == live["__p"]), "left_semi")


def latest_open_session(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per user, the newest session not yet ended (a NULL start counts as newest, as in a
    descending order; ties: highest session id).

    The maximum of a (start_time, id) struct is a partial aggregate: a user holding a large
    share of all sessions is reduced per map task, not ranked in one window partition.
    """
    s = _semi(t.sessions.filter(F.col("end_time").isNull()), "user_id", ids)
    newest = F.max(F.struct(F.col("start_time").isNull().alias("unset"), "start_time", "id"))
    return (s.groupBy("user_id").agg(newest.alias("m"))
            .select("user_id", F.col("m.id").alias("session_id"), F.col("m.start_time").alias("start_time")))


def user_status(t: Tables, emails: DataFrame | None = None) -> DataFrame:
    """Access type, status and warning count by email (archived users included)."""
    u = _semi(t.users, "email", emails)
    return u.select("email", "type", "status", "authentication_times")
