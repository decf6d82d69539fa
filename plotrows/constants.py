"""Fixed values that must equal the original scripts' for identical results.

Fixed values (kept verbatim, in their natural order):
"""

# --- fixed values: label grammar tokens -------------------------------------
BOS_TOKEN = "<|BOS|>"
X_START = "<x_start>"
X_END = "<x_end>"
Y_START = "<y_start>"
Y_END = "<y_end>"

# --- fixed values: special-token vocabulary, in its original order -----------
SPECIAL_TOKENS = [
    "<line>",
    "<vertical_bar>",
    "<scatter>",
    "<dot>",
    "<horizontal_bar>",
    X_START,
    X_END,
    Y_START,
    Y_END,
    BOS_TOKEN,
]

# --- fixed values: label formats ----------------------------------------------
LABEL_TYPES = ["xxyy", "xyxy", "bos_xxyy", "bos_xyxy"]

# --- fixed values: series delimiters -----------------------------------------
XXYY_VALUE_SEP = ";"
XXYY_MIDDLE = "<x_end> <y_start>"          # what the encoder writes
XXYY_MIDDLE_TIGHT = "<x_end><y_start>"     # also accepted by the decoder
XYXY_CELL_SEP = " | "
XYXY_ROW_SEP = " <0x0A> "
XYXY_NEWLINE = "<0x0A>"

# --- fixed values: canonical class map (D11: one map for every stage) --------
CLASS_TO_INDEX = {"dot": 0, "horizontal_bar": 1, "vertical_bar": 2, "line": 3, "scatter": 4}
CHART_TYPES = ["dot", "horizontal_bar", "vertical_bar", "line", "scatter"]

# --- fixed values: routes of the series scorers -----------------------------
ROUTE_HORIZONTAL = "horizontal_bar"
ROUTE_SCATTER_LINE = "scatter_line"
ROUTE_DEFAULT = "all"

# --- fixed values: fallbacks -------------------------------------------------
DEFAULT_CLASS = "line"                 # empty predicted class / listing default
FAILED_SERIES = ["0"]                   # xxyy decode failure
RECORD_FALLBACK_SERIES = "0;0"         # any other per-record failure

# --- fixed values: the constant text prompt given to the series model -------
SERIES_PROMPT = "Generate underlying data table of the figure below:"

# --- fixed values: training constants ---------------------------------------
PAD_TOKEN = "<pad>"
MAX_LABEL_TOKENS = 512
INITIAL_BEST_LOSS = 1e5
INITIAL_BEST_ACCURACY = -1.0
SEED = 42


# --- fixed values: pandas' default missing-value words (read_csv) -----------
PANDAS_NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
