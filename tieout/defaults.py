"""Thresholds and names used when a caller passes nothing else."""

# Required columns, column aliases, category rules, metric definitions, thresholds and
# confidence priors. They have to stay as they are for results to agree with existing reports.

SOURCE_COLUMNS = ["transaction_id", "date", "account_code", "entity_code", "amount"]
MAPPING_COLUMNS = ["source_account_code", "target_account_code", "metric_category"]
TARGET_COLUMNS = ["metric", "group_by", "period", "amount"]

SOURCE_ALIASES = {
    "transaction_id": ["txn_id", "trans_id", "id", "transaction"],
    "date": ["transaction_date", "posting_date", "value_date", "period_date"],
    "account_code": ["account", "acc_code", "gl_account", "account_number"],
    "entity_code": ["entity", "company_code", "cost_center", "legal_entity"],
    "amount": ["value", "net_amount", "transaction_amount", "debit_credit"],
}
MAPPING_ALIASES = {
    "source_account_code": ["src_account", "source_code", "from_account", "account_code", "source_account"],
    "target_account_code": ["tgt_account", "target_code", "to_account", "mapped_code", "target_account"],
    "metric_category": ["metric", "category", "account_type", "kpi", "classification"],
    "target_account_name": ["target_name", "tgt_name", "to_name"],
    "source_account_name": ["src_name", "source_name", "from_name", "account_name"],
}
TARGET_ALIASES = {
    "metric": ["kpi", "measure", "metric_name", "indicator"],
    "group_by": ["entity", "region", "bu", "business_unit", "group", "segment", "dimension"],
    "period": ["quarter", "year", "reporting_period", "fiscal_period", "fiscal_quarter"],
    "amount": ["value", "target", "expected", "reported_value", "target_amount"],
}

# Order matters: the first rule whose text occurs in the category wins.
CATEGORY_RULES = [
    ("rev", "Revenue"), ("revenue", "Revenue"), ("sales", "Revenue"),
    ("cogs", "COGS"), ("cost of goods", "COGS"), ("cost of sales", "COGS"), ("cost of revenue", "COGS"),
    ("opex", "OpEx"), ("operating expense", "OpEx"), ("operating expenses", "OpEx"),
    ("g&a", "OpEx"), ("sga", "OpEx"), ("overhead", "OpEx"),
    ("interco", "Intercompany"), ("intercompany", "Intercompany"), ("ic", "Intercompany"),
]

DERIVED_METRICS = {
    "Gross Margin": ("Revenue", "COGS"),
    "Operating Profit": ("Gross Margin", "OpEx"),
}
REVENUE_CATEGORIES = ["Revenue"]
HEADLINE_PATTERN = "(?i)Total|Group|All"
REVENUE_PATTERN = "(?i)rev|sales"

DEFAULT_CURRENCY = "USD"
DEFAULT_CATEGORY = "Revenue"
GAP_THRESHOLD = 1000.0
LARGE_GAP = 1_000_000.0
NOISE_FLOOR = 1.0
TOP_N = 10
CONNECTOR_ROWS = 500
TOLERANCE = 0.01
STOP_SHARE = 0.95
CAUSAL_SHARE = 0.5
FUZZY_MIN_SCORE = 80
GATE_TRIGGER = 0.80
RUN_GAP_SECONDS = 3600
OUTLIER_SHARE = 0.05
OUTLIER_MIN_ACCOUNTS = 10
OUTLIER_TREES = 100
OUTLIER_SAMPLE = 256
SUCCESS_STATUSES = ["succeeded", "success", "completed"]
ELIMINATION_ACCOUNT = "9999"
FIX_CONFIDENCE = {"add_mapping": 0.95}
OTHER_FIX_CONFIDENCE = 0.75
CONFIDENCE = {
    "mapping_gap": 0.95,
    "intercompany": 0.85,
    "hierarchy": 0.80,
    "manual_adjustment": 0.65,
    "residual": 0.0,
}
