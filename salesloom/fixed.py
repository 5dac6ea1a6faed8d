"""Fixed values.

Everything in this file is data that has to have exactly these values for results to come out
right: header spellings, category spellings, date formats, bins, thresholds, default fills and
message wording.  No logic lives here.
"""

# --- fixed values: accepted header spellings, by canonical column (compared trimmed, lower case)
HEADER_SPELLINGS = {
    "brand": ["brand", "brands", "品牌", "汽车品牌", "厂商", "制造商", "make", "manufacturer"],
    "model": ["model", "models", "车型", "型号", "车名", "名称", "vehicle", "name"],
    "sales_volume": [
        "sales_volume", "sales", "销量", "销售量", "销售辆数", "月销量", "月度销量", "销售数量",
        "volume", "sold",
    ],
    "sales_price": [
        "sales_price", "price", "价格", "售价", "销售价格", "价格(万)", "价格（万）", "价格(万元)",
        "单价", "指导价", "售价(万)",
    ],
    "energy_type": [
        "energy_type", "energy", "fuel", "能源", "能源类型", "燃油类型", "动力类型", "燃料",
        "fuel_type", "powertrain",
    ],
    "sale_date": [
        "sale_date", "date", "销售日期", "日期", "销售时间", "日期(年/月)", "月份", "report_date",
        "month",
    ],
}

# --- fixed values: category spellings, by canonical category (compared trimmed, case-sensitive)
CATEGORY_SPELLINGS = {
    "油车": [
        "油车", "燃油车", "汽油车", "汽油", "燃油", "柴油", "柴油车", "传统燃油", "内燃机",
        "gasoline", "diesel", "petrol", "燃油版", "汽油版",
    ],
    "电车": [
        "电车", "电动", "纯电动", "新能源", "纯电", "电动版", "电动汽车", "纯电动汽车", "新能源车",
        "electric", "ev", "bev",
    ],
    "混动": [
        "混动", "油电混合", "插电混动", "插混", "混合动力", "混动车", "油电混动", "混合", "增程式",
        "hybrid", "phev", "plug-in",
    ],
}

# --- fixed values: spellings counted in each volume share
SHARE_SPELLINGS = {
    "oil": ["油车", "燃油车", "汽油车"],
    "electric": ["电车", "电动", "纯电动", "新能源"],
    "hybrid": ["混动", "油电混合", "插电混动"],
}

# --- fixed values: texts a CSV cell may hold for "missing" (the public pandas default list)
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: date formats in the order they are tried: (shape, Spark datetime pattern)
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^\d{4}/\d{1,2}$", "yyyy/M"),
    (r"^\d{4}\.\d{1,2}$", "yyyy.M"),
    (r"^\d{4}年\d{1,2}月$", "yyyy年M月"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]

# --- fixed values: formats of the generic fallback, tried after the list above
FALLBACK_DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
]

# --- fixed values: entity names that count as "no entity"
INVALID_NAMES = ["", "未知", "unknown", "Unknown", "NaN", "nan"]

# --- fixed values: fills
UNKNOWN_TEXT = "未知"
UNKNOWN_DATE_TEXT = "2024-01"
UNKNOWN_ITEM = "未知车型"
UNKNOWN_CATEGORY = "油车"
DEFAULT_FILLS = {
    "brand": "未知品牌", "model": "未知车型", "sales_volume": 0.0, "sales_price": 0.0,
    "energy_type": "油车",
}

# --- fixed values: price histogram (label, low inclusive, high exclusive; None = open)
PRICE_BINS = [
    ("10万以下", 0.0, 10.0), ("10-20万", 10.0, 20.0), ("20-30万", 20.0, 30.0),
    ("30-50万", 30.0, 50.0), ("50万以上", 50.0, None),
]

# --- fixed values: price segments of the correlation analysis; the last is open, as its label says
PRICE_SEGMENTS = [
    ("0-10万", 0.0, 10.0), ("10-15万", 10.0, 15.0), ("15-20万", 15.0, 20.0),
    ("20-25万", 20.0, 25.0), ("25-30万", 25.0, 30.0), ("30-50万", 30.0, 50.0),
    ("50万以上", 50.0, None),
]

# --- fixed values: seasonal factor per month, and the factor without a month
SEASONAL_FACTORS = {
    1: 0.95, 2: 0.55, 3: 1.05, 4: 0.98, 5: 1.02, 6: 1.08,
    7: 0.92, 8: 0.96, 9: 1.15, 10: 1.10, 11: 1.12, 12: 1.18,
}
NAIVE_FACTOR = 1.005

# --- fixed values: thresholds
Z_LIMIT = 3.0
Z_MIN_ROWS = 3            # z-scores need more rows than this
MIN_POINTS = 5            # correlation and regression
MIN_STRATUM = 3
SIGNIFICANT_P = 0.05
SMALL_SLICE = 0.02
INTERVAL_Z = 1.96
HIGH_PRICE = 25.0
LOW_PRICE = 12.0

# --- fixed values: category markers for the regression indicators
ELECTRIC_MARKS = ["电"]
HYBRID_MARKS = ["混", "DM", "PHEV"]

# --- fixed values: labels and message wording
OTHER_SLICE = "其他"
STRENGTH_WORDS = [(0.8, "强"), (0.5, "中等"), (0.3, "弱")]
POSITIVE_WORD, NEGATIVE_WORD, NO_CORRELATION = "正相关", "负相关", "几乎无线性相关"
ABOVE_WORD, BELOW_WORD = "高于", "低于"
SEGMENT_TAGS = {"top": "高销量主力", "high": "高端车型", "low": "经济车型", "mid": "中端均衡"}
SMALL_STRATUM_NOTE = "样本不足"
MSG_EMPTY = "输入 DataFrame 为空"
MSG_DUPLICATES = "删除 %d 行完全重复数据"
MSG_OUTLIERS = "%s 列检测到 %d 个异常值 (|Z|>3)，已替换为中位数 %s"
MSG_RANGE = "%s 列检测到 %d 个数值超出用户设定范围，已替换为中位数 %s"
MSG_INVALID = "删除 %d 行品牌/车型为空的无效数据"
MSG_NO_MISSING = "未检测到缺失值"
MSG_NO_OUTLIERS = "未检测到异常值"
MSG_DROPPED = "舍弃 %d 行含有缺失值的数据"
MSG_NONE_TO_DROP = "未检测到缺失值，无需舍弃"
MSG_CUSTOM_FILL = "%s 列 %d 个缺失值已填充为「%s」"
MSG_DEFAULT_FILL = "%s 列 %d 个缺失值已填充为默认值「%s」"
MSG_MISSING_COLUMNS = "数据缺少必需列: %s。当前列名: %s。"
MSG_FILE_EMPTY = "文件内容为空"
MSG_BAD_FORMAT = "仅支持 JSON 和 CSV 格式"
MSG_BAD_JSON = "无法解析 JSON 文件"
MSG_NOTHING_LEFT = "清洗后无有效数据"
MSG_UPLOADED = "上传成功！共导入 %d 条数据"
MSG_NO_BOUND = "不限"
MSG_TOO_FEW = "有效数据不足（需 ≥%d 条，当前 %d 条）"
MSG_TOO_FEW_TO_TRAIN = "有效数据不足 5 条，无法训练"
MSG_NOT_READY = "模型未就绪，请先上传数据"
MSG_UPLOAD_FIRST = "请先上传数据"
MSG_NEGATIVE_R2 = "当前数据量较小，R²为负，处于探索性分析模式"
MSG_UPLOAD_UNKNOWN = "历史记录不存在或无权访问"
MSG_UPLOAD_EMPTY = "该历史记录没有可恢复的明细数据（可能上传于历史功能上线之前）"
MSG_ACTIVATED = "已切换到所选历史数据"
MSG_DELETED = "已删除该历史记录"
MSG_FARTHEST = "距簇%d质心最远，可能属于其他细分市场"
MSG_RESIDUAL = "实际销量%.0f，%s回归预测%.0f"
MSG_EQUATION = "销量 ≈ %.0f + %.1f × 价格"
MSG_MODEL_EQUATION = "月销量 = %s + %s×价格 + 能源效应"
MSG_NO_CHART_ROWS = "筛选条件下无数据"
