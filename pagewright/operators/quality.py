"""Confidence and flags of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import Str, _c, once

from .geometry import looks_tabular

MIN_CONF = 60.0
REVIEW = "review-vision"


def mean_conf(words: Str) -> Column:
    """Mean confidence of the words that are not blank and not -1; 0 for none."""
    kept = F.filter(_c(words), lambda w: (w["conf"] != -1) & (F.trim(w["text"]) != ""))
    total = lambda k: F.aggregate(k, F.lit(0).cast("bigint"), lambda a, w: a + w["conf"])
    return once(kept, lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) > 0, total(k) / F.size(k)).otherwise(0.0))


def issues(conf: Str, words: Str, least: float | Str = MIN_CONF) -> Column:
    """low_confidence and table_like_unstructured, in that order, on the confidence before rounding."""
    low = _c(conf) < (F.lit(least) if isinstance(least, float) else _c(least))
    found = F.array(F.when(low, "low_confidence"), F.when(looks_tabular(words), "table_like_unstructured"))
    return F.filter(found, lambda x: x.isNotNull())


def flag(issues_: Str) -> Column:
    """Any issue asks for review."""
    return F.when(F.size(_c(issues_)) > 0, REVIEW)


def stamp_rejected(issues_: Str, rejected: Str) -> Column:
    """The mark of a rejected text layer, added after flagging, so that it does not flag by itself."""
    have = F.coalesce(_c(issues_), F.array().cast("array<string>"))
    return F.when(F.coalesce(_c(rejected), F.lit(False)), F.array_union(have, F.array(F.lit("text_layer_rejected")))).otherwise(have)


def flag_reasons(issues_: Str, conf: Str, words: Str, flag_: Str, least: float | Str = MIN_CONF) -> Column:
    """Why a page was flagged: its issues, or what they would be, or the flag itself."""
    again = issues(conf, words, least)
    own = F.coalesce(_c(issues_), F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).when(F.size(again) > 0, again).when(_c(flag_).isNotNull(), F.array(_c(flag_))).otherwise(own)
