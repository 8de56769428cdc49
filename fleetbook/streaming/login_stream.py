"""Login policy as a stream: every micro-batch of attempts is applied with the batch operator.

What an attempt does depends only on the user's stored state and on whether 0, 1 or more valid
attempts came before it, which W16 has in closed form.  So the stream keeps no state of its own:
users and sessions are tables; each micro-batch reads the users the last one committed, writes
the buckets of the users it touched, and adds the sessions it starts to theirs, together with the
outcomes: what is written follows the attempts, not the tables.  Equals W16 on the whole log when attempts
arrive in ``seq`` order across micro-batches; later arrivals are taken as they come.  Malformed
lines go to the rejects.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetbook.operators.login import login_outcomes
from fleetbook.streaming.request_stream import apply_request_stream

OPERATION = "login_attempts"
OUTCOMES = "login_outcomes"


def login_policy_stream(spark: SparkSession, attempts_dir: str, base_dir: str, out_root: str, checkpoint_dir: str,
                        company_domain: str, max_files_per_trigger: int = 1, available_now: bool = True,
                        buckets: int = 64) -> StreamingQuery:
    """Start the stream; ``current_tables`` then has users and sessions, ``emitted`` the outcomes."""
    return apply_request_stream(spark, OPERATION, partial(login_outcomes, company_domain=company_domain), attempts_dir,
                                base_dir, out_root, checkpoint_dir, max_files_per_trigger, available_now, buckets)
