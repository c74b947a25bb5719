"""Patterns, word lists, the target schema and its ranges, as the results depend on them."""

from __future__ import annotations

#: Fixed values: (entity type, field, category, confidence, characters before, after, pattern), in emission order.
PATTERNS = [
    ("isin", "ISIN", "identifiers", 0.95, 20, 20, r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b"),
    ("cusip", "CUSIP", "identifiers", 0.85, 20, 20, r"\b([0-9]{3}[A-Z0-9]{5}[0-9])\b"),
    ("ticker", "Ticker", "identifiers", 0.90, 30, 10, r"\(([A-Z]{2,5})\)"),
    ("ticker", "Ticker", "identifiers", 0.92, 10, 10, r"(?i)(?:ticker|symbol)[:\s]+([A-Z]{1,5})\b"),
    ("fund_name", "LegalName", "descriptive", 0.85, 10, 10, ""),
    ("nav", "NAV", "pricing", 0.92, 20, 20, r"(?i)(?:NAV|Net\s+Asset\s+Value)[:\s]*\$?([\d,]+\.?\d*)"),
    ("expense_ratio", "ExpenseRatio", "fees", 0.93, 20, 20, r"(?i)(?:Expense\s+Ratio|ER)[:\s]*([\d.]+)\s*%"),
    ("yield", "Yield", "income", 0.90, 20, 20, r"(?i)(?:SEC\s+)?(?:Yield|Distribution\s+Rate)[:\s]*([\d.]+)\s*%"),
    ("total_assets", "TotalNetAssets", "size", 0.88, 20, 20, r"(?i)(?:Total\s+(?:Net\s+)?Assets|AUM)[:\s]*\$?([\d,.]+)\s*(Million|Billion|[MB])\b"),
    ("star_rating", "StarRating", "ratings", 0.95, 20, 20, r"(?i)(?:Rating|Stars?)[:\s]*(?:([1-5])\s*(?:stars?|★)|([★]{1,5}))"),
    ("analyst_rating", "AnalystRating", "ratings", 0.94, 20, 20, r"(?i)(?:Analyst\s+Rating|Medalist\s+Rating)[:\s]*(Gold|Silver|Bronze|Neutral|Negative)"),
    ("inception_date", "InceptionDate", "descriptive", 0.90, 20, 20, r"(?i)(?:Inception\s+Date|Established)[:\s]*(\w+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{2}-\d{2})"),
    ("currency", "BaseCurrency", "descriptive", 0.92, 20, 20, r"(?i)(?:Currency|Base Currency|Denomination)[:\s]*(USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|HKD|SGD)"),
    ("standard_deviation", "StandardDeviation_3Y", "risk", 0.88, 30, 10, r"(?i)(?:Standard\s+Deviation|Std\.?\s*Dev\.?)[:\s]*([\d.]+)"),
    ("sharpe_ratio", "SharpeRatio_3Y", "risk", 0.88, 20, 10, r"(?i)Sharpe\s+Ratio[:\s]*(-?[\d.]+)"),
    ("beta", "Beta_3Y", "risk", 0.87, 10, 10, r"(?i)\bBeta[:\s]*(-?[\d.]+)"),
    ("alpha", "Alpha_3Y", "risk", 0.87, 10, 10, r"(?i)\bAlpha[:\s]*(-?[\d.]+)"),
    ("category", "CategoryName", "classification", 0.90, 20, 20, r"(?i)(?:Category|Classification)[:\s]+([A-Za-z\s\-]+?)(?:\n|\||$)"),
]
NUMERIC = {"nav", "expense_ratio", "yield", "total_assets", "standard_deviation", "sharpe_ratio", "beta", "alpha"}

#: Words, in lower case, of which a text must hold one for the pattern to match at all.
TRIGGERS = {
    "nav": ("nav", "net"), "yield": ("yield", "rate"), "total_assets": ("assets", "aum"), "star_rating": ("rating", "star"), "analyst_rating": ("rating",), "inception_date": ("inception", "established"),
    "currency": ("currency", "denomination"), "standard_deviation": ("dev",), "sharpe_ratio": ("sharpe",), "beta": ("beta",), "alpha": ("alpha",), "category": ("category", "classification"),
}
#: Fixed value: how entities of text come about.
METHOD = "rule_based"

#: Further patterns of the surface that the default extraction does not use.
EXTRA_PATTERNS = {
    "return_pct": r"(-?[\d.]+)\s*%",
    "dollar_amount": r"(?i)\$([\d,]+\.?\d*)\s*(million|billion|[mb])?\b",
    "r_squared": r"(?i)R-?Squared[:\s]*([\d.]+)",
    "return_ytd": r"(?i)(?:YTD|Year[\s-]*to[\s-]*Date)[:\s]*(-?[\d.]+)\s*%",
    "return_1y": r"(?i)1[\s-]*(?:Year|Yr\.?)[:\s]*(-?[\d.]+)\s*%",
}

#: The words that make a run of capitalised words a fund's name.
NAME_WORDS = "Fund|ETF|Trust|Portfolio|Index|Shares|Admiral|Investor|Institutional"

#: Upper-case words that are no tickers.
NOT_TICKERS = (
    "THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HAS HIS HOW ITS MAY NEW NOW OLD SEE WAY WHO DID GET LET SAY SHE TOO USE "
    "INC LTD PLC ETF NAV SEC USD EUR ANN AVG YTD NET PER ADV FUND BOND DATE RATE YEAR FROM WITH THAT THIS HAVE BEEN WILL MORE WHEN "
    "SOME THAN THEM THEN WHAT YOUR EACH"
).split()

#: Fund categories, in order of preference.
CATEGORIES = [
    "Large Blend", "Large Growth", "Large Value", "Mid-Cap Blend", "Mid-Cap Growth", "Mid-Cap Value", "Small Blend", "Small Growth", "Small Value",
    "Foreign Large Blend", "Foreign Large Growth", "Foreign Large Value", "Diversified Emerging Mkts", "China Region", "India Equity",
    "Intermediate Core Bond", "Intermediate Core-Plus Bond", "Short-Term Bond", "Long-Term Bond", "High Yield Bond", "Inflation-Protected Bond", "Bank Loan",
    "Allocation--30% to 50% Equity", "Allocation--50% to 70% Equity", "Allocation--70% to 85% Equity", "Allocation--85%+ Equity",
    "Target-Date 2025", "Target-Date 2030", "Target-Date 2035", "Target-Date 2040", "Target-Date 2045", "Target-Date 2050",
    "Technology", "Health", "Financial", "Real Estate", "Natural Resources", "Utilities", "Communications", "Commodities Broad Basket",
    "Equity Precious Metals", "Money Market - Taxable", "Money Market - Tax-Free", "Multialternative", "Market Neutral", "Long-Short Equity",
]

#: Fund families.
FAMILIES = [
    "Vanguard", "BlackRock", "Fidelity", "State Street", "Schwab", "T. Rowe Price", "Capital Group", "American Funds", "JP Morgan", "JPMorgan",
    "Morgan Stanley", "Goldman Sachs", "Invesco", "Franklin Templeton", "PIMCO", "Dimensional", "Dodge & Cox", "MFS", "Putnam", "Hartford",
    "John Hancock", "Principal", "Nuveen", "WisdomTree", "First Trust", "VanEck", "ProShares", "iShares", "SPDR", "Direxion", "Global X",
]

#: Asset classes and the words that show them, in order.
ASSET_CLASSES = {
    "Equity": ["equity", "stock", "shares", "growth", "value", "blend", "cap"],
    "Fixed Income": ["bond", "fixed income", "debt", "treasury", "corporate bond", "municipal"],
    "Allocation": ["allocation", "balanced", "target-date", "lifecycle"],
    "Alternative": ["alternative", "hedge", "long-short", "market neutral", "managed futures"],
    "Commodities": ["commodity", "commodities", "gold", "precious metals", "natural resources"],
    "Money Market": ["money market", "cash", "liquidity"],
}

#: Fixed values: (field, type, category, required, longest, precision, pattern, least, most).
SCHEMA = [
    ("SecId", "string", "identifiers", True, 10, None, None, None, None),
    ("ISIN", "string", "identifiers", False, 12, None, r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$", None, None),
    ("CUSIP", "string", "identifiers", False, 9, None, r"^[0-9]{3}[A-Z0-9]{5}[0-9]$", None, None),
    ("Ticker", "string", "identifiers", False, 10, None, None, None, None),
    ("LegalName", "string", "descriptive", True, 256, None, None, None, None),
    ("FundFamily", "string", "descriptive", False, 128, None, None, None, None),
    ("CategoryName", "string", "classification", False, 64, None, None, None, None),
    ("GlobalAssetClassId", "string", "classification", False, 32, None, None, None, None),
    ("InceptionDate", "date", "descriptive", False, None, None, r"^\d{4}-\d{2}-\d{2}$", None, None),
    ("BaseCurrency", "string", "descriptive", True, 3, None, None, None, None),
    ("NAV", "decimal", "pricing", False, None, 4, None, None, None),
    ("NAVDate", "date", "pricing", False, None, None, r"^\d{4}-\d{2}-\d{2}$", None, None),
    ("TotalNetAssets", "decimal", "size", False, None, 2, None, None, None),
    ("ExpenseRatio", "decimal", "fees", False, None, 4, None, None, None),
    ("Yield", "decimal", "income", False, None, 4, None, None, None),
    *[(f"Return_{p}", "decimal", "performance", False, None, 4, None, None, None) for p in ("1M", "3M", "YTD", "1Y", "3Y", "5Y", "10Y")],
    *[(f"{m}_3Y", "decimal", "risk", False, None, 4, None, None, None) for m in ("StandardDeviation", "SharpeRatio", "Beta", "Alpha")],
    ("StarRating", "integer", "ratings", False, None, None, None, 1, 5),
    ("AnalystRating", "string", "ratings", False, 16, None, None, None, None),
    ("StyleBox", "string", "classification", False, 32, None, None, None, None),
    ("TopHoldings", "array", "holdings", False, None, None, None, None, None),
    ("SectorWeights", "object", "allocation", False, None, None, None, None, None),
]
FIELDS = [f[0] for f in SCHEMA]
ALLOWED = {"GlobalAssetClassId": list(ASSET_CLASSES), "AnalystRating": ["Gold", "Silver", "Bronze", "Neutral", "Negative"]}

#: Points that a field adds to a record's quality; the second list counts zero as present.
POINTS_TRUE = {
    **dict.fromkeys(["ISIN", "CUSIP", "Ticker", "LegalName", "SecId"], 5.0),
    **dict.fromkeys(["FundFamily", "CategoryName", "InceptionDate", "BaseCurrency", "GlobalAssetClassId"], 3.0),
    **dict.fromkeys(["NAV", "TotalNetAssets", "ExpenseRatio"], 5.0),
    **dict.fromkeys(["StarRating", "AnalystRating"], 2.5),
}
POINTS_SET = {**dict.fromkeys([f for f in FIELDS if f.startswith("Return_")], 3.57), **dict.fromkeys(["StandardDeviation_3Y", "SharpeRatio_3Y", "Beta_3Y", "Alpha_3Y"], 3.75)}
#: Fields that completeness counts.
REQUIRED = ["SecId", "LegalName", "BaseCurrency"]
OPTIONAL = "ISIN CUSIP Ticker FundFamily CategoryName InceptionDate NAV TotalNetAssets ExpenseRatio Return_1Y Return_3Y Return_5Y StandardDeviation_3Y SharpeRatio_3Y StarRating".split()

#: Inclusive bounds outside which a value is warned of.
RANGES = {
    "NAV": (0.01, 100000), "ExpenseRatio": (0.0, 10.0), "Yield": (-5.0, 30.0), "TotalNetAssets": (0.1, 5000000), "Return_1M": (-50, 50), "Return_3M": (-60, 100),
    "Return_YTD": (-80, 200), "Return_1Y": (-80, 300), "Return_3Y": (-50, 100), "Return_5Y": (-30, 80), "Return_10Y": (-20, 50), "StandardDeviation_3Y": (0, 100),
    "SharpeRatio_3Y": (-5, 10), "Beta_3Y": (-3, 5), "Alpha_3Y": (-50, 50), "StarRating": (1, 5),
}

#: Words of a table row that name a period, and the period.
PERIODS = [
    ("1 month", "1M"), ("1 mo", "1M"), ("3 month", "3M"), ("3 mo", "3M"), ("ytd", "YTD"), ("year to date", "YTD"), ("1 year", "1Y"), ("1 yr", "1Y"),
    ("3 year", "3Y"), ("3 yr", "3Y"), ("5 year", "5Y"), ("5 yr", "5Y"), ("10 year", "10Y"), ("10 yr", "10Y"),
]
#: Date formats, tried in order.
DATES = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yy"]
