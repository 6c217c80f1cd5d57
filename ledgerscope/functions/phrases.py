"""Explanation text (E7, E8) as Spark SQL expressions.

Numbers use ``format_number`` (half-even on the exact binary value, like
Python's format specs), with grouping commas removed where the text has none.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_sql(v: str) -> str:
    """-Rs.1,234 style: sign, currency prefix, grouped whole units."""
    return f"concat(CASE WHEN {v} < 0 THEN '-' ELSE '' END, 'Rs.', format_number(abs({v}), 0))"


def fixed_sql(v: str, places: int) -> str:
    """Plain fixed-point text without grouping commas."""
    return f"regexp_replace(format_number({v}, {places}), ',', '')"


ORIGIN_RATIO_TAIL = "x the origin account's pre-transaction balance"
DEST_RATIO_TAIL = "x this destination's historical average received amount"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


def _int(v: str) -> str:
    return f"cast(cast({v} as bigint) as string)"


def _either(cond: str, yes: str, no: str) -> str:
    return f"CASE WHEN {cond} THEN {yes} ELSE {no} END"


# The description of each model feature's value.
def template(feature: str, v: str) -> str | None:
    m, f1, f2 = money_sql(v), fixed_sql(v, 1), fixed_sql(v, 2)
    t = {
        "amount": f"concat('the transaction amount is ', {m})",
        "log_amount": f"concat('the log-scaled transaction amount is ', {f2})",
        "balance_change_orig": _either(f"{v} >= 0", f"concat('the origin account balance decreased by ', {m})",
                                       f"concat('the origin account balance increased by ', {money_sql('-' + v)})"),
        "balance_error_orig": _either(
            f"abs({v}) < 1e-6",
            _lit("the origin balance exactly matches the expected debit formula (oldbalance - amount = newbalance)"),
            f"concat('the origin balance deviates from the expected debit formula by ', {m})"),
        "drained_to_zero": _either(f"{v} = 1", _lit("the transaction drains the origin account to exactly zero"),
                                   _lit("the origin account is not fully drained by this transaction")),
        "origin_balance_zero_before": _either(
            f"{v} = 1", _lit("the origin account already had a zero balance before this transaction"),
            _lit("the origin account had a non-zero balance before this transaction")),
        "amount_to_origin_balance_ratio": f"concat('the transaction amount is ', {f1}, "
                                          f"{_lit(ORIGIN_RATIO_TAIL)})",
        "balance_change_dest": _either(f"{v} >= 0", f"concat('the destination account balance increased by ', {m})",
                                       f"concat('the destination account balance decreased by ', "
                                       f"{money_sql('-' + v)})"),
        "balance_error_dest": _either(
            f"abs({v}) < 1e-6",
            _lit("the destination balance exactly matches the expected credit formula (oldbalance + amount = "
                 "newbalance)"),
            f"concat('the destination balance deviates from the expected credit formula by ', {m})"),
        "dest_balance_artifact_flag": _either(
            f"{v} = 1", _lit("the destination's balance fields are both zero (an untracked/mule-like destination "
                             "pattern)"),
            _lit("the destination's balance fields look normally tracked")),
        "hour_of_day": f"concat('it occurred at hour ', {_int(v)}, ' of the simulated 24-hour cycle')",
        "hour_sin": _lit("part of this transaction's cyclical time-of-day encoding"),
        "hour_cos": _lit("part of this transaction's cyclical time-of-day encoding"),
        "is_transfer": _either(f"{v} = 1", _lit("it is a TRANSFER transaction"), _lit("it is a CASH_OUT transaction")),
        "hist_dest_txn_count": f"concat('this destination has ', {_int(v)}, ' prior recorded transactions')",
        "hist_dest_unique_origin_count": f"concat('this destination has received from ', {_int(v)}, "
                                         f"' distinct senders historically')",
        "hist_dest_total_amount": f"concat('this destination has received ', {m}, ' historically')",
        "hist_dest_avg_amount": f"concat('this destination typically receives around ', {m})",
        "hist_dest_max_amount": f"concat('the largest amount this destination has ever received is ', {m})",
        "destination_is_new": _either(
            f"{v} = 1", _lit("the destination account has no prior transaction history (brand new)"),
            _lit("the destination account has prior transaction history")),
        "amount_to_dest_avg_ratio": f"concat('the amount is ', {f1}, "
                                    f"{_lit(DEST_RATIO_TAIL)})",
        "amount_to_type_avg_ratio": f"concat('the amount is ', {f1}, "
                                    f"'x the historical average amount for this transaction type')",
        "high_amount_indicator": _either(
            f"{v} = 1", _lit("the amount exceeds the historical 95th-percentile threshold for this transaction type"),
            _lit("the amount is within the normal range for this transaction type")),
    }
    return t.get(feature)


def phrase_sql(feature: str, v: str) -> str:
    """E7 for a feature known when the plan is built; unknown: 'f = v'."""
    return template(feature, v) or f"concat({_lit(feature + ' = ')}, cast({v} as string))"


def phrase_case_sql(feature: str, v: str, features: list[str]) -> str:
    """E7 where the feature is data (e.g. a lambda variable): one CASE over the
    known features; only the matching branch is evaluated."""
    whens = " ".join(f"WHEN {feature} = '{f}' THEN {template(f, v)}" for f in features if template(f, v))
    return f"CASE {whens} ELSE concat({feature}, ' = ', cast({v} as string)) END"


def phrase_for(feature: str, value_col: str | None = None) -> Column:
    return F.expr(phrase_sql(feature, f"cast(`{value_col or feature}` as double)"))


def money(v: Column) -> Column:
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("Rs."), F.format_number(F.abs(v), 0))


def fixed(v: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(v, places), ",", "")


def narrative_sql(score: str, band: str, pos: str, neg: str) -> str:
    """One sentence from the band and the top contributors' phrases."""
    s3 = fixed_sql(score, 3)
    pp = f"transform({pos}, c -> c.phrase)"
    npp = f"transform({neg}, c -> c.phrase)"
    title = f"concat(upper(substring({band}, 1, 1)), lower(substring({band}, 2)))"
    return f"""CASE
      WHEN {band} IN ('HIGH', 'MEDIUM') AND size({pos}) > 0 THEN
        concat({title}, ' risk (score ', {s3}, ') because ', array_join(slice({pp}, 1, 2), ' and '), '.')
      WHEN {band} = 'LOW' AND size({pos}) > 0 AND size({neg}) > 0 THEN
        concat('Low risk overall (score ', {s3}, '). The model\\'s strongest score-raising factor was that ',
               try_element_at({pp}, 1), ', but this was outweighed by: ', array_join(slice({npp}, 1, 2), '; '), '.')
      WHEN {band} = 'LOW' AND size({pos}) > 0 THEN
        concat('Low risk overall (score ', {s3}, '), despite ', try_element_at({pp}, 1), '.')
      WHEN {band} = 'LOW' THEN
        concat('Low risk (score ', {s3}, '): no score-raising factors found among the model\\'s top contributing features.')
      ELSE concat('Risk score ', {s3}, ' (', {band}, ').') END"""
