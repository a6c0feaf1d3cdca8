"""Fixed vocabularies: values that results depend on."""

from __future__ import annotations

# Section types, and which of them hold tables.
SECTION_TYPES = (
    "balance_sheet",
    "profit_loss",
    "cash_flow",
    "schedule",
    "note_to_accounts",
    "directors_report",
    "mda",
    "auditors_report",
    "management_profile",
    "vision_mission",
    "risk_factors",
    "shareholders_info",
    "corporate_governance",
    "standalone_financials",
    "consolidated_financials",
    "other",
)
STRUCTURED_TYPES = (
    "balance_sheet",
    "profit_loss",
    "cash_flow",
    "schedule",
    "note_to_accounts",
    "standalone_financials",
    "consolidated_financials",
)
NARRATIVE_TYPES = tuple(t for t in SECTION_TYPES if t not in STRUCTURED_TYPES)

# Phrases that mark a question about a statement table.
TABLE_PHRASES = (
    "balance sheet",
    "profit and loss",
    "p&l",
    "eps",
    "earnings per share",
    "cash flow statement",
    "total assets",
    "total liabilities",
    "net worth",
    "shareholders equity",
    "revenue from operations",
    "ebitda",
    "net profit",
    "pat",
    "gross block",
    "depreciation",
    "retained earnings",
)

# Tiers of questions and how each is answered.
STRATEGIES = {"T1": "pageindex_tree", "T2": "hybrid", "T3": "pageindex_refs", "T4": "vector_multi_doc"}
CONFIDENCE = 0.7

# Retrieval settings.
RRF_K, CANDIDATES, FINAL = 60, 50, 10
CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
CONTEXT_TOKENS = 25000

# Agents and their helpers.
AGENTS = {
    "quantitative": ("dcf_modeller", "peer_comparator", "segment_splitter"),
    "qualitative": ("mgmt_tracker", "moat_scorer", "capex_intent"),
    "risk_governance": ("litigation_scanner", "promoter_history", "related_party"),
    "sentiment": ("fii_dii_tracker", "sector_rotation", "news_sentiment"),
}

# Ratios shown, with label and bands (higher is better, green from, yellow from; or lower is better, up to).
RATIOS = (
    ("NIM_pct", "Net Interest Margin", True, 3.5, 2.8),
    ("Gross_NPA_pct", "Gross NPA", False, 1.5, 3.0),
    ("Net_NPA_pct", "Net NPA", False, 1.5, 3.0),
    ("ROE_pct", "Return on Equity", True, 15.0, 10.0),
    ("ROA_pct", "Return on Assets", True, 1.5, 0.8),
    ("CAR_pct", "Capital Adequacy", True, 15.0, 12.0),
    ("PB_Ratio", "Price / Book", False, 3.0, 5.0),
    ("PE_Ratio", "Price / Earnings", False, 20.0, 35.0),
    ("Gross_Margin_pct", "Gross Margin", True, 20.0, 10.0),
    ("EBITDA_Margin_pct", "EBITDA Margin", True, 20.0, 10.0),
    ("Debt_to_Equity", "Debt / Equity", False, 0.5, 1.5),
    ("Current_Ratio", "Current Ratio", True, 2.0, 1.0),
    ("ROCE_pct", "ROCE", True, 15.0, 10.0),
)

# Dashboard sections in order.
DASHBOARD = ("executive_summary", "key_ratios", "investment_pillars", "risk_dashboard", "sentiment")

# Block types by the names that page JSON uses for them.
BLOCK_TYPES = {
    "table": ("table", "tabular", "grid"),
    "heading": ("heading", "header", "title", "h1", "h2", "h3", "h4", "h5", "h6"),
    "image": ("image", "figure", "chart"),
    "list": ("list", "bullet", "numbered_list"),
    "text": ("text", "paragraph", "para"),
}

# Formats of announcement dates, first match wins.
DATE_FORMATS = (
    "dd-MMM-yyyy HH:mm:ss",
    "dd-MMM-yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy",
)

# English words that a keyword index leaves out.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
