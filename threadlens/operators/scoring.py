"""Row-level rules on thread metadata (X5-X12, X31, F6, F8): pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X


def priority_score() -> Column:
    """Weighted rule sum clamped to 0..100."""
    days = F.col("days_since_last")
    s = (F.when(F.col("is_urgent"), C.SCORE_URGENT).otherwise(0)
         + F.when(F.col("last_asks_score"), C.SCORE_RESPONSE).otherwise(0)
         + F.when(days < C.RECENT_DAYS_BELOW, C.SCORE_RECENT)
         .when(days > C.STALE_DAYS_ABOVE, C.SCORE_STALE).otherwise(0)
         + F.when(F.col("participant_count") > C.PARTICIPANTS_ABOVE, C.SCORE_PARTICIPANTS).otherwise(0)
         + F.when(F.col("has_delay"), C.SCORE_DELAY).otherwise(0)
         + F.when(F.col("email_count") > C.VOLUME_ABOVE, C.SCORE_VOLUME).otherwise(0)
         + F.when(F.col("is_customs"), C.SCORE_CUSTOMS).otherwise(0)
         + F.when(F.col("is_transport"), C.SCORE_TRANSPORT).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), s)).cast("bigint")


def priority_level(score: Column) -> Column:
    """Level bands."""
    e = None
    for bound, name in C.LEVEL_BANDS:
        e = F.when(score >= bound, F.lit(name)) if e is None else e.when(score >= bound, F.lit(name))
    return e.otherwise(F.lit(C.LEVEL_DEFAULT))


def priority_factors() -> Column:
    """Texts of the rules that fired, in rule order."""
    days = F.col("days_since_last")
    return X.labels([
        (F.col("is_urgent"), C.FACTOR_URGENT),
        (F.col("last_asks_score"), C.FACTOR_RESPONSE),
        (days < C.RECENT_DAYS_BELOW, C.FACTOR_RECENT),
        ((days >= C.RECENT_DAYS_BELOW) & (days > C.STALE_DAYS_ABOVE), C.FACTOR_STALE),
        (F.col("participant_count") > C.PARTICIPANTS_ABOVE, C.FACTOR_PARTICIPANTS),
        (F.col("has_delay"), C.FACTOR_DELAY),
        (F.col("email_count") > C.VOLUME_ABOVE, C.FACTOR_VOLUME),
        (F.col("is_customs"), C.FACTOR_CUSTOMS),
        (F.col("is_transport"), C.FACTOR_TRANSPORT),
    ])


def thread_status() -> Column:
    """Activity text from whole days since the last message, '+ - URGENT'."""
    d = F.col("days_since_last")
    ds = d.cast("string")
    base = (F.when(d == 0, F.lit("Active today"))
            .when(d == 1, F.lit("Active yesterday"))
            .when(d < 7, F.concat(F.lit("Active "), ds, F.lit(" days ago")))
            .otherwise(F.concat(F.lit("Last activity "), ds, F.lit(" days ago"))))
    return F.when(F.col("is_urgent"), F.concat(base, F.lit(" - URGENT"))).otherwise(base)


def next_action() -> Column:
    """Waiting phrase > response needed > stale follow-up > monitor."""
    d = F.col("days_since_last")
    return (F.when(F.col("last_waiting_on").isNotNull(), F.lit(C.NEXT_WAITING))
            .when(F.col("last_asks_insight"), F.lit(C.NEXT_RESPONSE))
            .when(d > C.STALE_DAYS_ABOVE,
                  F.replace(F.lit(C.NEXT_FOLLOW_UP), F.lit("{days}"), d.cast("string")))
            .otherwise(F.lit(C.NEXT_MONITOR)))


def with_scores(meta: DataFrame, p: Params) -> DataFrame:
    """Adds score, level, factors, status, insight fields, archive decision."""
    return meta.select("*", *_score_columns(p))


@X.per_session
def _score_columns(p: Params) -> list:
    score = priority_score()
    return [
        score.alias("priority_score"),
        priority_level(score).alias("priority_level"),
        priority_factors().alias("priority_factors"),
        thread_status().alias("current_status"),
        F.col("last_asks_insight").alias("response_needed"),
        F.col("last_waiting_on").alias("waiting_on"),
        F.col("last_sender").alias("last_responder"),
        next_action().alias("next_action"),
        (F.col("days_since_last") > F.lit(p.archive_days)).alias("is_archived"),
    ]


@X.per_session
def requires_attention(p: Params) -> Column:
    """F8: score >= 40, or response needed, or urgent."""
    return (F.col("priority_score") >= p.attention_score) | F.col("response_needed") | F.col("is_urgent")


@X.per_session
def suggested_actions(p: Params) -> Column:
    """Suggested actions; none apply -> 'Monitor for updates'."""
    acts = X.labels([
        (F.col("response_needed"), C.ACTION_REPLY),
        (F.col("is_urgent"), C.ACTION_URGENT),
        (F.col("has_delay"), C.ACTION_DELAY),
        (F.col("priority_score") >= p.handle_today_score, C.ACTION_HIGH),
        (F.col("duration_days") > p.long_running_days, C.ACTION_LONG),
    ])
    return F.when(F.size(acts) > 0, acts).otherwise(F.array(F.lit(C.ACTION_MONITOR)))
