"""Login attempts: outcome per attempt and the resulting user state and sessions.

Policy, one attempt at a time in ``seq`` order:
* the text between the first and second '@' must be the company domain -> else ``bad_domain``
  (no '@' at all -> ``invalid``);
* the e-mail must belong to a user (archived ones included) -> else ``wrong_email``;
* ``password_ok`` must be true -> else ``wrong_password``;
* NULL ``authentication_times`` -> ``invalid`` (the service cannot read it);
* type 'unauthorized' with 0 warnings -> ``warned`` (status warned, warnings + 1);
  'unauthorized' with warnings > 0 -> ``blocked_now`` (type blocked, status black_listed,
  warnings + 1); 'blocked' -> ``blocked``; anything else -> ``session`` (a session starts).

Only valid attempts (past the three checks) move a user's state, and the state reached
depends only on how many valid attempts came before.  So the batch needs each valid
attempt's rank among its user's valid attempts, capped at 3: computed from the user's first
and second valid ``seq`` (two partial aggregates), never from a window over a hot user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.plans.batch import Changes, new_id
from fleetbook.sources.tables import Tables, conform


def login_outcomes(t: Tables, attempts: DataFrame, company_domain: str) -> Changes:
    """Apply login ``attempts`` (seq, ts, email, password_ok).

    Returns ``Changes`` with tables ``users`` (new state), ``sessions`` (with the started
    sessions appended) and ``login_outcomes`` (seq, email, user_id, outcome); ``rejects`` are
    the attempts whose outcome is not ``session``.
    """
    domain = F.try_element_at(F.split(F.col("email"), "@"), F.lit(2))
    u = t.users.select(F.col("id").alias("user_id"), F.col("email").alias("__ue"),
                       F.col("type").alias("__type"),
                       F.col("authentication_times").alias("__times"))
    a = attempts.join(u, attempts["email"] == u["__ue"], "left")
    pre = (F.when(domain.isNull(), F.lit("invalid"))
           .when(domain != F.lit(company_domain), F.lit("bad_domain"))
           .when(F.col("user_id").isNull(), F.lit("wrong_email"))
           .when(~F.coalesce(F.col("password_ok"), F.lit(False)), F.lit("wrong_password"))
           .when(F.col("__times").isNull(), F.lit("invalid")))
    a = a.withColumn("__pre", pre)
    valid = a.filter(F.col("__pre").isNull())

    s1 = valid.groupBy("user_id").agg(F.min("seq").alias("__s1"))
    s2 = (valid.join(s1, "user_id").filter(F.col("seq") > F.col("__s1"))
          .groupBy("user_id").agg(F.min("seq").alias("__s2")))
    ranks = s1.join(s2, "user_id", "left")

    # only valid attempts have a user to join; the others (many without any) are not shuffled by it
    none = F.lit(None).cast(a.schema["seq"].dataType)
    invalid = a.filter(F.col("__pre").isNotNull()).withColumn("__s1", none).withColumn("__s2", none)
    a = valid.join(ranks, "user_id", "left").select(*a.columns, "__s1", "__s2").unionByName(invalid)
    k = (F.when(F.col("seq") == F.col("__s1"), F.lit(1))
         .when(F.col("seq") == F.col("__s2"), F.lit(2)).otherwise(F.lit(3)))
    unauth = F.col("__type") == "unauthorized"
    # stage 1 = first warning pending, 2 = block pending, 3+ = already blocked
    stage = k + F.when(F.col("__times") > 0, F.lit(1)).otherwise(F.lit(0))
    decided = (F.when(unauth & (F.col("__times") >= 0) & (stage == 1), F.lit("warned"))
               .when(unauth & (F.col("__times") >= 0) & (stage == 2), F.lit("blocked_now"))
               .when(unauth & (F.col("__times") >= 0), F.lit("blocked"))
               .when(F.col("__type") == "blocked", F.lit("blocked"))
               .otherwise(F.lit("session")))
    outcomes = a.select("seq", "email", "user_id", "ts",
                        F.coalesce(F.col("__pre"), decided).alias("outcome"))

    # New user state from the number of valid attempts (1 or >= 2) per user.
    n = ranks.select("user_id", F.when(F.col("__s2").isNotNull(), F.lit(2)).otherwise(F.lit(1)).alias("__n"))
    users = t.users.join(n, t.users["id"] == n["user_id"], "left")
    un = (F.col("type") == "unauthorized") & F.col("__n").isNotNull()
    t0 = F.col("authentication_times")
    warn_only = un & (t0 == 0) & (F.col("__n") == 1)
    block = un & (((t0 == 0) & (F.col("__n") == 2)) | (t0 > 0))
    new_cols = []
    for f in t.users.schema.fields:
        c = F.col(f.name)
        if f.name == "authentication_times":
            c = F.when(warn_only, t0 + 1).when(block, t0 + 1).otherwise(t0)
            c = F.when(un & (t0 == 0) & (F.col("__n") == 2), t0 + 2).otherwise(c)
        elif f.name == "status":
            c = F.when(warn_only, F.lit("warned")).when(block, F.lit("black_listed")).otherwise(c)
        elif f.name == "type":
            c = F.when(block, F.lit("blocked")).otherwise(c)
        new_cols.append(c.cast(f.dataType).alias(f.name))
    users = users.select(*new_cols)

    idt = t.sessions.schema["id"].dataType
    started = outcomes.filter(F.col("outcome") == "session").select(
        new_id("session", "seq", idt).alias("id"), F.col("user_id"),
        F.col("ts").cast("timestamp").alias("start_time"))
    started = conform(started, t.sessions.schema)
    rejects = outcomes.filter(F.col("outcome") != "session").select(
        F.col("seq").cast("long").alias("seq"), F.col("outcome").alias("reason"))
    return Changes({"users": users, "sessions": t.sessions.unionByName(started),
                    "login_outcomes": outcomes.drop("ts")}, rejects, {"sessions": started})
