"""Parameters that a query and its oracle share."""

SEVERITY = 0.10
MASTER = 2027
REPEATS = 3
DRAWS = 200
SEED = 7
DOSES = (0.05, 0.10, 0.20, 0.30)
DOSE_REPEATS = 2
EVENT_REPEATS = REPEATS
CHANNELS = (
    "missing_measures",
    "value_noise",
    "orphan_foreign_keys",
    "stale_timestamps",
    "dimension_drift",
    "duplicate_facts",
)
DOSE_CHANNELS = CHANNELS
#: Six defects more for sampled attribution, in the order of the players, and how many orders are drawn.
WIDE_CHANNELS = (
    *CHANNELS,
    "mild_noise",
    "cut_prices",
    "lost_discounts",
    "unit_mixup",
    "wrong_refunds",
    "late_week",
)
WIDE_ORDERS = 6
SCAN_DATES = ("1996-01-01", "1997-01-01")
SCAN_QUANTITY = (10, 20)
HASH_SAMPLE = 500
ORDERS = 40
TRIALS = 10
BUDGETS = (2, 4, 8)
MODEL_SEVERITY = 0.15
MODEL_MASTER = 2027
SPLITS = 3
TEST_SIZE = 0.30
GENERATOR_SEED = 2027
EVIDENCE = (
    ("cells", "==", REPEATS * 64 * 8),
    ("largest_loss", "<=", 1.0),
    ("clean_loss", "==", 0.0),
    ("status_copies", "<", 0.1001),
    ("status_copies", ">", 0.0999),
    ("missing_on_status", "==", 0.0),
)
#: Every column of every given table, by how its values are written for a fingerprint.
FINGERPRINTS = {
    "region": {"text": ("r_regionkey", "r_name")},
    "nation": {"text": ("n_nationkey", "n_name", "n_regionkey")},
    "customer": {"text": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "number": ("c_acctbal",)},
    "supplier": {"text": ("s_suppkey", "s_name", "s_nationkey"), "number": ("s_acctbal",)},
    "part": {"text": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "number": ("p_retailprice",)},
    "orders": {
        "text": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        "number": ("o_totalprice",),
        "time": ("o_orderdate",),
    },
    "lineitem": {
        "text": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
        "number": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        "time": ("l_shipdate",),
    },
    "events": {"text": ("event_id", "user_id", "event_type", "props"), "number": ("value",), "time": ("ts",)},
    "documents": {"text": ("doc_id", "text", "lang", "source", "n_chars")},
    "embeddings": {"text": ("vec_id", "label"), "vector": ("embedding",)},
    "labels": {"text": ("doc_id", "quality", "toxic")},
    "pages": {"text": ("page_id", "url", "html")},
    "benchmark": {"text": ("item_id", "text")},
    "conversations": {"text": ("conv_id", "turn", "role", "text")},
}
