"""Reference dates and settings used when the operators run on the supplied test tables."""

AS_OF_ORDERS = "2000-12-31"      # as-of day on the order time line
AS_OF_EVENTS = "2024-01-20"      # as-of day on the event time line
CHURN_DAYS = 180                 # inactivity that counts as churn on the order time line
RISK_THRESHOLD = 0.50
BUDGET = 5_000_000
HORIZON_DAYS = 90
STATUS_DORMANT_DAYS = 90
STATUS_RISK_DAYS = 180
SNAPSHOT_END = "2001-06-30"
SHORT, MID, LONG = 7, 14, 20       # feature windows on the event time line
