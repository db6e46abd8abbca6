"""Word lists, lookup tables and patterns whose exact content decides results."""

from __future__ import annotations

# Entity patterns of the chunk index (the percentage pattern without a trailing word boundary,
# which no ordinary percentage could meet).
ENTITY_PATTERNS = {
    "companies": r"(?:[A-Z][a-zA-Z0-9\s&,]+(?:Inc|LLC|Ltd|Corporation|Corp|Company|Co|LP|LLP|SA|GmbH|Plc|AG|NV)\.?)",
    "monetary_values": r"(?:\$\s*\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?|\d+(?:,\d{3})*(?:\.\d+)?\s*(?:USD|EUR|GBP|JPY|CAD|AUD))",
    "percentages": r"(?:\b\d+(?:\.\d+)?%)",
    "dates": r"(?:\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b)",
    "financial_metrics": r"(?:revenue|EBITDA|net income|profit|earnings|assets|liabilities|equity|P/E ratio|market cap)",
}
LITERAL_PERCENT = r"(?:\b\d+(?:\.\d+)?%\b)"

# Synonyms by canonical term; where a synonym stands twice, the later canonical term wins.
SYNONYMS = {
    "revenue": ["sales", "turnover", "income", "earnings", "proceeds"],
    "profit": ["earnings", "net income", "bottom line", "gain", "surplus"],
    "liability": ["debt", "obligation", "payable", "responsibility"],
    "asset": ["property", "holding", "investment", "resource"],
    "merger": ["acquisition", "consolidation", "takeover", "integration", "combination"],
    "shareholder": ["stockholder", "investor", "owner", "equity holder"],
    "dividend": ["payout", "distribution", "return", "yield"],
    "capital": ["funds", "financing", "investment", "money", "equity"],
    "valuation": ["appraisal", "assessment", "evaluation", "worth", "value"],
    "dilution": ["watering down", "reduction", "decrease", "diminution"],
}

# Indicator phrases of document categories, in order of precedence.
CATEGORY_INDICATORS = {
    "financial_statement": ["balance sheet", "income statement", "cash flow", "statement of financial position", "profit and loss", "annual report", "quarterly report", "10-K", "10-Q", "financial results"],
    "due_diligence": ["due diligence", "DD report", "findings", "compliance assessment", "risk assessment", "SWOT analysis"],
    "contract": ["agreement", "contract", "terms and conditions", "parties agree", "hereby", "obligations", "termination clause", "effective date", "binding agreement"],
    "regulatory_filing": ["SEC filing", "form 8-K", "proxy statement", "prospectus", "S-1", "registration statement", "disclosure", "regulatory compliance", "securities", "exchange commission"],
    "valuation": ["valuation", "fair market value", "DCF", "discounted cash flow", "NPV", "net present value", "EBITDA multiple", "comparable analysis"],
    "market_analysis": ["market analysis", "industry overview", "competitive landscape", "market share", "growth projections", "market size", "CAGR", "competitive advantage"],
    "legal_memo": ["legal memorandum", "legal analysis", "legal opinion", "counsel", "liability", "legal risk", "jurisdiction", "statutory", "regulation", "compliance"],
    "tax_document": ["tax", "taxation", "tax implications", "tax structure", "tax liability", "depreciation", "amortization", "tax-free", "tax benefit", "IRS"],
}

# Keywords of statement types, in order of precedence.
STATEMENT_KEYWORDS = {
    "balance_sheet": ["balance sheet", "statement of financial position", "assets and liabilities", "total assets", "total liabilities", "stockholders' equity", "shareholders' equity", "current assets", "non-current assets", "long-term assets", "current liabilities", "non-current liabilities", "long-term liabilities"],
    "income_statement": ["income statement", "profit and loss", "statement of operations", "statement of earnings", "statement of comprehensive income", "revenue", "sales", "gross profit", "operating income", "net income", "cost of goods sold", "cost of revenue", "operating expenses", "tax expense"],
    "cash_flow": ["cash flow statement", "statement of cash flows", "cash flows", "operating activities", "investing activities", "financing activities", "net cash provided by", "net cash used in", "cash and cash equivalents"],
}

# Statement title patterns of chunks, in order of precedence.
STATEMENT_PATTERNS = {
    "income_statement": r"(?i)(consolidated\s+)?(statements?\s+of\s+|)(income|profit\s+and\s+loss|operations|earnings)",
    "balance_sheet": r"(?i)(consolidated\s+)?(statements?\s+of\s+|)(financial\s+position|balance\s+sheets?)",
    "cash_flow": r"(?i)(consolidated\s+)?(statements?\s+of\s+|)cash\s+flows?",
    "statement_of_equity": r"(?i)(consolidated\s+)?(statements?\s+of\s+|)(stockholders'|shareholders'|equity|changes\s+in\s+equity)",
    "notes": r"(?i)notes\s+to\s+(consolidated\s+|)financial\s+statements",
    "management_discussion": r"(?i)(item\s+7\.?\s*)?management'?s?\s+discussion\s+and\s+analysis",
    "risk_factors": r"(?i)(item\s+1A\.?\s*)?risk\s+factors",
}
# Patterns of tables and periods, and the terms, of chunks.
TABLE_PATTERN = r"(?:\s*\d+[\s,]*)(?:\s*\d+[\s,]*)(?:\s*\d+[\s,]*)"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
PERIOD_PATTERNS = [
    rf"(?i)(?:year(?:s)?|quarter(?:s)?)?\s*ended\s+(?:(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|(?:\d{{1,2}}/\d{{1,2}}/\d{{2,4}}))",
    r"(?i)(?:fiscal\s+years?|quarters?)\s+\d{4}(?:\s*-\s*\d{4})?",
    r"(?i)(?:q[1-4]|first|second|third|fourth)\s+quarter(?:\s+of|\s+\d{4})",
]
CHUNK_TERMS = ["revenue", "income", "profit", "loss", "ebitda", "assets", "liabilities", "equity", "cash flow", "balance", "earnings", "eps", "dividend", "depreciation", "amortization", "tax", "interest", "debt", "capital", "expense", "margin"]

# Amount patterns of metrics named in a text; the first match counts.
METRIC_PATTERNS = {
    "revenue": r"(?i)(?:revenue|sales|turnover)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "ebitda": r"(?i)EBITDA\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "net_income": r"(?i)(?:net income|profit|earnings)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "assets": r"(?i)(?:total assets|assets)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "liabilities": r"(?i)(?:total liabilities|liabilities)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "equity": r"(?i)(?:equity|shareholder's equity|stockholder's equity)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
    "pe_ratio": r"(?i)(?:price[- ]to[- ]earnings|P/E|PE) ratio\s*(?:of|:)?\s*(\d+(?:\.\d+)?)",
    "market_cap": r"(?i)(?:market capitalization|market cap)(?:s)?\s*(?:of|:)?\s*(?:US)?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|m|b|M|B))?)",
}

# Task patterns of questions, in order of precedence.
TASK_PATTERNS = {
    "ratio_analysis": [r"\bratio analysis\b", r"\bfinancial ratio", r"\bprofitability ratio", r"\bliquidity ratio", r"\bdebt to equity\b", r"\bcurrent ratio\b", r"\bquick ratio\b", r"\broi\b", r"\broe\b", r"\bebitda margin\b", r"\bgross margin\b", r"\boperating margin\b"],
    "trend_analysis": [r"\btrend analysis\b", r"\bhistorical trend", r"\bfinancial trend", r"\btrend over time\b", r"\bgrowth rate", r"\byear over year\b", r"\bquarter over quarter\b", r"\bcagr\b"],
    "valuation": [r"\bvaluation\b", r"\bcompany value\b", r"\bvaluation model", r"\bdcf\b", r"\bdiscounted cash flow\b", r"\bprice to earnings\b", r"\bp/e\b", r"\bebitda multiple\b", r"\bev/ebitda\b", r"\bfair value\b", r"\bintrinsic value\b", r"\bcomparable companies\b", r"\bcomps\b"],
    "risk_assessment": [r"\brisk assessment\b", r"\brisk analysis\b", r"\brisk exposure\b", r"\bfinancial risk\b", r"\bcredit risk\b", r"\bmarket risk\b", r"\bliquidity risk\b", r"\boperational risk\b", r"\brisk factors\b", r"\brisk mitigation\b"],
    "forecasting": [r"\bforecast\b", r"\bprojection\b", r"\bprojected\b", r"\bestimate future\b", r"\bfuture performance\b", r"\bfinancial model\b", r"\bprediction\b", r"\bgrowth projection\b", r"\bestimated revenue\b"],
    "document_extraction": [r"\bextract\b", r"\bpull\b", r"\bfind\b.*\bfrom.*\bdocument", r"\bdata extraction\b", r"\bextract information\b", r"\bpull data\b", r"\bget.*\bfrom.*\breport"],
    "document_summarization": [r"\bsummarize\b", r"\bsummary\b", r"\bkey points\b", r"\bmain findings\b", r"\boverview\b", r"\bhighlight\b", r"\bcondense\b", r"\bbrief\b"],
    "table_interpretation": [r"\btable\b", r"\bfinancial table\b", r"\bspreadsheet\b", r"\bfinanical data\b", r"\brows?\b.*\bcolumns?\b", r"\bdata in the table\b", r"\binterpret the table\b", r"\btabular data\b", r"\bexcel\b"],
    "income_statement_analysis": [r"\bincome statement\b", r"\bprofit and loss\b", r"\bp&l\b", r"\brevenue\b", r"\bsales\b", r"\bgross profit\b", r"\boperating expense\b", r"\bnet income\b", r"\bebitda\b", r"\boperating income\b", r"\bcost of goods sold\b", r"\bcogs\b", r"\bexpense\b"],
    "balance_sheet_analysis": [r"\bbalance sheet\b", r"\bassets?\b", r"\bliabilities?\b", r"\bequity\b", r"\bdebt\b", r"\bcurrent assets?\b", r"\bcurrent liabilities?\b", r"\binventory\b", r"\baccounts receivable\b", r"\baccounts payable\b", r"\blong-term debt\b", r"\bshareholders equity\b", r"\bbook value\b"],
    "cash_flow_analysis": [r"\bcash flow\b", r"\bcash from operations\b", r"\boperating cash flow\b", r"\bfree cash flow\b", r"\binvesting activities\b", r"\bfinancing activities\b", r"\bcapital expenditure\b", r"\bcapex\b", r"\bdividend\b", r"\brepurchase\b", r"\bcash on hand\b"],
    "due_diligence": [r"\bdue diligence\b", r"\bm&a\b", r"\bmerger and acquisition\b", r"\btarget company\b", r"\bacquisition target\b", r"\bcomprehensive review\b", r"\bfinancial due diligence\b", r"\blegal due diligence\b", r"\boperational due diligence\b"],
    "red_flag_identification": [r"\bred flags?\b", r"\bwarning signs?\b", r"\bfinanical irregularities\b", r"\baccounting issues\b", r"\bfraud\b", r"\bmisstatement\b", r"\baccounting manipulation\b", r"\bfinancial fraud\b", r"\birreguarities\b", r"\baudit issues\b", r"\bmaterial weakness\b"],
    "compliance_check": [r"\bcompliance\b", r"\bregulatory\b", r"\bregulation\b", r"\bfinancial regulations\b", r"\bcompliant\b", r"\baccounting standards\b", r"\bgaap\b", r"\bifrs\b", r"\bsec\b", r"\bsarbanes-oxley\b", r"\bsox\b", r"\blegal requirement\b"],
    "question_answering": [r"\bwhat\b.*\?", r"\bhow\b.*\?", r"\bwhen\b.*\?", r"\bwhere\b.*\?", r"\bwhy\b.*\?", r"\bcan you tell me\b", r"\bexplain\b", r"\bcould you provide\b"],
    "general_financial": [r"\bfinance\b", r"\bfinancial\b", r"\bmoney\b", r"\bcapital\b", r"\binvestment\b", r"\bdollar\b", r"\beuro\b", r"\bcurrency\b", r"\beconomic\b", r"\bmarket\b"],
}
# Patterns of complex questions and of financial context, and the complex tasks.
COMPLEX_PATTERNS = [r"\bcompare\b", r"\banalyze\b", r"\bcorrelation\b", r"\bcausation\b", r"\bimpact of\b", r"\brelationship between\b", r"\btradeoff\b", r"\bscenario analysis\b", r"\bsensitivity analysis\b", r"\bwhat-if\b", r"\bcomplex\b", r"\badvanced\b", r"\bsophisticated\b", r"\bdetailed\b", r"\bnuanced\b", r"\bmultifaceted\b"]
CONTEXT_PATTERNS = [r"\b\$\d+\b", r"\bdollars\b", r"\beuros\b", r"\byuans?\b", r"\byens?\b", r"\bpounds\b", r"\bcurrency\b", r"\bpercentage\b", r"\bcompany\b", r"\bcorporation\b", r"\benterprise\b", r"\bfirm\b", r"\borganization\b", r"\bbusiness\b"]
COMPLEX_TASKS = ["valuation", "risk_assessment", "due_diligence", "red_flag_identification"]
# The kind of model each task is routed to.
TASK_PROVIDER = {
    "ratio_analysis": "anthropic", "valuation": "anthropic", "risk_assessment": "anthropic", "due_diligence": "anthropic", "red_flag_identification": "anthropic", "compliance_check": "anthropic",
    "document_extraction": "openai", "document_summarization": "openai", "table_interpretation": "openai", "question_answering": "openai",
    "trend_analysis": "hybrid", "forecasting": "hybrid", "income_statement_analysis": "hybrid", "balance_sheet_analysis": "hybrid", "cash_flow_analysis": "hybrid",
    "general_financial": "openai", "non_financial": "openai",
}
# Entity patterns of questions.
QUERY_ENTITY_PATTERNS = {
    "monetary_values": r"(?i)\$\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|m|b|k))?",
    "percentages": r"\d+(?:\.\d+)?\s?%",
    "statements": r"(?i)\b(?:income statement|balance sheet|cash flow|p&l|profit and loss)\b",
    "ratios": r"(?i)\b(?:roi|roe|roa|ebitda|gross margin|net margin|current ratio|debt[- ]to[- ]equity|p/e|ev/ebitda)\b",
}

# Dictionary of financial terms.
FINANCIAL_TERMS = {
    "METRIC": ["Revenue", "Net Income", "EBITDA", "Gross Profit", "Operating Income", "Total Assets", "Total Liabilities", "Shareholders' Equity", "Cash Flow", "Free Cash Flow", "Capital Expenditure", "Dividend", "Interest Expense", "Tax Expense", "Depreciation", "Amortization", "Inventory", "Accounts Receivable", "Accounts Payable", "Long-term Debt", "Current Assets", "Current Liabilities"],
    "RATIO": ["P/E Ratio", "EPS", "ROI", "ROE", "ROA", "Current Ratio", "Quick Ratio", "Debt-to-Equity", "Gross Margin", "Operating Margin", "Net Profit Margin", "Asset Turnover", "Inventory Turnover", "Interest Coverage", "Dividend Yield", "Payout Ratio", "Cash Ratio", "ROIC", "Debt Ratio", "Acid-Test Ratio"],
    "STATEMENT": ["Balance Sheet", "Income Statement", "Cash Flow Statement", "Statement of Changes in Equity", "Notes to Financial Statements", "Management Discussion and Analysis", "Audit Report", "Annual Report", "Quarterly Report", "10-K", "10-Q", "8-K", "Prospectus", "Proxy Statement"],
    "REGULATION": ["GAAP", "IFRS", "SOX", "FASB", "SEC", "IAS", "ASC", "Dodd-Frank", "Basel III", "PCAOB", "AICPA", "IASB", "ESMA", "FCA", "FINRA", "IRS", "CRA", "HMRC"],
}
# Weights of terms in embeddings.
TERM_WEIGHTS = {
    "balance sheet": 1.8, "income statement": 1.8, "cash flow statement": 1.8, "financial statement": 1.7, "annual report": 1.6, "quarterly report": 1.6, "10-k": 1.7, "10-q": 1.7,
    "revenue": 1.5, "ebitda": 1.7, "net income": 1.6, "profit": 1.5, "gross margin": 1.6, "operating margin": 1.6, "profit margin": 1.6, "cash flow": 1.6, "free cash flow": 1.7, "liquidity": 1.5, "solvency": 1.5, "debt": 1.5, "leverage": 1.5,
    "ratio": 1.6, "p/e": 1.8, "price to earnings": 1.8, "price-to-earnings": 1.8, "eps": 1.6, "roe": 1.7, "return on equity": 1.7, "roi": 1.7, "return on investment": 1.7, "debt to equity": 1.7, "current ratio": 1.7, "quick ratio": 1.7,
    "risk": 1.5, "volatility": 1.5, "default": 1.6, "bankruptcy": 1.6, "material weakness": 1.8, "going concern": 1.8, "internal control": 1.6,
    "acquisition": 1.7, "merger": 1.7, "due diligence": 1.8, "synergy": 1.6, "target company": 1.7, "valuation": 1.7, "earn-out": 1.7, "purchase price": 1.6, "deal structure": 1.6,
}
# Phrases of titles, periods, dates, amounts and units that are tagged.
STATEMENT_TITLES = r"\b(?:balance\s+sheet|statement\s+of\s+financial\s+position|income\s+statement|profit\s+and\s+loss|statement\s+of\s+operations|cash\s+flow\s+statement|statement\s+of\s+cash\s+flows|statement\s+of\s+changes\s+in\s+equity|statement\s+of\s+comprehensive\s+income)\b"
PERIOD_PHRASES = r"\b(?:year(?:s)?\s+end(?:ed|ing)?|quarter(?:s)?\s+end(?:ed|ing)?|month(?:s)?\s+end(?:ed|ing)?|period\s+end(?:ed|ing)?|fiscal\s+year|(?:q[1-4]|fy\d{2,4}))\b"
DATE_PHRASES = r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{2,4})\b"
MONEY_PHRASES = r"(?:[$€£¥]|\b(?:USD|EUR|GBP|JPY|CAD|AUD|CHF)\b)\s*(?:\d{1,3}(?:,\d{3})+\.\d+|\d+\.\d+|\.\d+|\d{1,3}(?:,\d{3})+|\d+)(?:\s*(?:million|billion|trillion|m|b|t))?"
UNIT_PHRASES = r"\b\d+(?:\.\d+)?(?:\s*(?:thousand|million|billion|trillion|percent|k|m|b|t|%))\b"
# File types, metadata keys of a prompt, and entities expected in a collection.
FILE_TYPES = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".tsv", ".txt", ".md", ".pptx", ".ppt", ".html", ".json"]
CONTEXT_KEYS = ["source", "filename", "file_type", "doc_category", "statement_type", "financial_period", "company", "date", "page", "section"]
EXPECTED_ENTITIES = ["revenue", "income", "profit", "loss", "ebitda", "assets", "liabilities", "equity", "cash flow", "earnings", "eps", "dividend", "debt", "capital", "margin"]

# Words of financial tables, and how an amount starts.
TABLE_WORDS = ["assets", "liabilities", "equity", "revenue", "income", "expense", "cash", "profit", "loss", "total", "net", "gross", "operating", "current", "non-current", "long-term", "short-term"]
AMOUNT_START = r"\$\s*[\d,]+\.?\d*|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+"

# Patterns of periods in statements, and of company names and tickers.
PERIOD_YEAR = r"(?:fiscal|year|fy|FY|Fiscal Year)?\s*(?:ended|ending)?\s*(?:in|on|,)?\s*(\d{4})"
PERIOD_QUARTER = r"(?:Q|q)(\d)\s*(?:FY|fiscal year|fy|year)?[\s,]*(\d{4})"
PERIOD_MONTHS = r"(?:three|six|nine|twelve|3|6|9|12)\s*months?\s*(?:ended|ending)\s*(?:in|on)?\s*((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"
COMPANY_SUFFIX = r"((?:[A-Z][a-z]*\s*)+(?:Inc\.|Corporation|Corp\.|Company|Co\.|Ltd\.|Limited|LLC|LLP|LP|plc|PLC|Group|Holdings|Holding|N\.V\.|S\.A\.|SE|NV|SA))"
COMPANY_LISTED = r"((?:[A-Z][a-z]*\s*)+)(?:\((?:NASDAQ|NYSE|OTCBB|OTCQB|OTCQX|LSE|TSX|CSE|HKEX|SSE|SZSE):?\s*([A-Z]+(?:\.[A-Z])?)\))"

# Section headers and notes of reports.
HEADER_PATTERN = r"(?:^|\n)(?:(?:[A-Z][A-Z\s]+[A-Z]\.?)|(?:\d+\.\s+[A-Z][a-zA-Z\s]+)|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+:))"
NOTE_PATTERN = r"(?:^|\n)(?:NOTE|Note)\s+(\d+)[\.:]?\s+([A-Z][A-Za-z \t]+)"
