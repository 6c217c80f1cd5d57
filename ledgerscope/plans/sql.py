"""DuckDB oracle building blocks. Only raw tables are registered on the
oracle side, so every oracle inlines the ledger as CTEs."""

LEDGER_CTES = """
base AS (
  SELECT *, floor(epoch(ts)) AS epoch_s, json_extract_string(props, '$.k') AS k FROM events
),
ledger AS (
  SELECT event_id,
    cast(floor((epoch_s - 1704067200) / 3600) AS int) + 1 AS step,
    CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'view' THEN 'CASH_IN' WHEN 'click' THEN 'CASH_OUT'
                    WHEN 'signup' THEN 'DEBIT' ELSE 'TRANSFER' END AS type,
    value AS amount,
    concat('C', cast(user_id AS varchar)) AS nameOrig,
    CASE WHEN event_type = 'purchase' THEN concat('M', k) ELSE concat('C', k) END AS nameDest,
    CASE WHEN event_id % 5 = 0 THEN 0.0e0 WHEN event_id % 5 IN (1, 2) THEN value ELSE value * 4 END AS oldbalanceOrg,
    CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0.0e0 ELSE value * 4 - value END AS newbalanceOrig,
    CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN 0.0e0 ELSE value * 2 END AS oldbalanceDest,
    CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN 0.0e0 ELSE value * 2 + value END AS newbalanceDest,
    cast(CASE WHEN event_type IN ('click', 'error') AND
              ((event_id % 5 IN (1, 2) AND event_id % 7 IN (0, 3))
               OR (cast(floor((epoch_s - 1704067200) / 3600) AS int) + 1) % 29 = 0)
         THEN 1 ELSE 0 END AS int) AS isFraud,
    cast(CASE WHEN event_type = 'error' AND value > 200 THEN 1 ELSE 0 END AS int) AS isFlaggedFraud
  FROM base
)"""


def with_ledger(*ctes: str) -> str:
    """``WITH <ledger CTEs>, <more CTEs>`` prefix."""
    parts = [LEDGER_CTES.strip()] + [c.strip() for c in ctes if c.strip()]
    return "WITH " + ",\n".join(parts) + "\n"
