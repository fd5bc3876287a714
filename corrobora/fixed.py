"""Limits, word lists, patterns and sentence formats that define the expected results."""

# --- fixed values: limits ---------------------------------------------------------------------
HEADING_MAX_CHARS = 80
BIG_FONT_RATIO = 1.15
MIN_PAGE_TEXT_CHARS = 20
TARGET_CHARS = 900
MAX_PARAGRAPH_CHARS = 1200
MIN_CHUNK_CHARS = 40
HEADER_MIN_PAGES = 3
HEADER_MAX_CHARS = 60
OCR_LOW = 0.80
OCR_ROW_GAP = 0.5
OCR_PARAGRAPH_GAP = 1.5
CANDIDATES = 20
RRF_K = 60
TOP_K = 10
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
EMBED_BATCH = 32
QUOTE_MIN, QUOTE_MAX = 10, 300
SEGMENT_MIN = 12
FUZZY_TEXT, FUZZY_OCR = 92, 88
QUESTION_MAX = 500
SENTENCE_MAX = 400
RELATED_CHARS = 240
RELATED_INSUFFICIENT, RELATED_EVIDENCE_ONLY = 3, 5
MAX_FILE_MB = 20
EXTENSIONS = ["pdf", "docx", "txt", "png", "jpg", "jpeg"]
SIGNATURES = {"pdf": "25504446", "docx": "504B0304", "png": "89504E47", "jpg": "FFD8FF"}

# --- fixed values: patterns (Java regular expressions) ------------------------------------------
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
# the characters that WS matches
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_CHAR = r"[\p{L}\p{N}_]"
HEADING = r"^(\d+(\.\d+)*\.?|Section|Article|Clause|Schedule|Annex)" + WS + r"+[^\s\p{Z}]"
COLON_THEN_TEXT = r":" + WS + r"*[^\s\p{Z}]"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d+(\s*(of|/)\s*\d+)?\s*$"
SENTENCE_END = r"(?<=[.!?])" + WS + "+"
TOKEN = r"([a-z0-9]+)"
ELLIPSIS = r"\.{3,}|…"
SUPERSESSION_CUE = r"(?i)(?<![\p{L}\p{N}_])(replac|amend|supersed|overrid)"
EVIDENCE_IDS = r"\s*[\(\[]\s*[EC]\d+(?:\s*(?:,|and|&)\s*[EC]\d+)*\s*[\)\]]"
STAGE_FIELD = r'(\w+)=("[^"]*"|\S+)'
QUOTE_CHARS_FROM, QUOTE_CHARS_TO = "‘’“”–—‑−", "''\"\"----"
QUOTE_EDGE = " \t\n\"'.…"
QUOTE_STRIP = "\"'“”‘’ \t\n"

# --- fixed values: number, unit, money, date and yes/no vocabulary -------------------------------
UNIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALE_WORDS = {"hundred": 100, "thousand": 1000}
DAY_QUALIFIERS = {"business": "business day", "working": "business day", "calendar": "day"}
CURRENCIES = {
    "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP",
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR",
}
MULTIPLIERS = {"k": 10**3, "m": 10**6, "million": 10**6, "billion": 10**9, "lakh": 10**5, "lakhs": 10**5,
               "crore": 10**7, "crores": 10**7}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
NEGATIVE_CUES = ["not permitted", "not allowed", "prohibited", "may not", "shall not"]
POSITIVE_CUES = ["permitted", "allowed", "required", "may", "shall"]
NO_SCOPE = ["", "general", "all", "n/a", "none", "null"]
VALUE_TYPES = ["duration", "date", "money", "percent", "number", "boolean", "text", "none"]

# --- fixed values: number, money and date patterns -------------------------------------------------
_word = "|".join(sorted([*UNIT_WORDS, *SCALE_WORDS], key=len, reverse=True))
_end = r"(?![\p{L}\p{N}_])"  # end of a word, for letters of any language
_start = r"(?<![\p{L}\p{N}_])"
_space = r"[\s\p{Z}]"
DIGITS = r"\d[\d,]*(?:\.\d+)?"
NUMBER = rf"(?:(?:{_word}){_end}(?:(?:{_space}|-)+(?:{_word}){_end})*(?:{_space}*\({_space}*{DIGITS}{_space}*\))?|{DIGITS})"
# a number starts with a digit or one of the first letters of the number words
_number_start = r"(?=[zotfsenh\d])(?<![\p{L}\p{N}_.])"
QUANTITY = rf"(?i){_number_start}({NUMBER})(?:{_space}*-?{_space}*([A-Za-z]+))?(?:{_space}+([A-Za-z]+))?"
NET_DAYS = rf"(?i){_start}net{_space}+(\d+){_end}"
PERCENT = rf"(?i){_number_start}({NUMBER}){_space}*(?:%|percent{_end}|per{_space}+cent{_end})"
_suffix = rf"(?:{_space}*(k|m|million|billion|lakhs?|crores?){_end})?"
MONEY_PREFIX = rf"(?i)(US\$|USD|EUR|GBP|INR|Rs\.?|\$|€|£|₹){_space}*({DIGITS}){_suffix}"
MONEY_SUFFIX = rf"(?i)({DIGITS}){_suffix}{_space}*(USD|EUR|GBP|INR|dollars?|euros?|pounds?|rupees?){_end}"
MONTH_NUMBERS = {m.lower(): i for i, m in enumerate(MONTHS, 1)} | {m[:3].lower(): i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
_month = "|".join(sorted(MONTH_NUMBERS, key=len, reverse=True))
DATE_ISO = rf"{_start}(\d{{4}}-\d{{2}}-\d{{2}}){_end}"
DATE_DMY = rf"(?i){_start}(\d{{1,2}})(?:st|nd|rd|th)?{_space}+({_month})\.?,?{_space}+(\d{{4}}){_end}"
DATE_MDY = rf"(?i){_start}({_month})\.?{_space}+(\d{{1,2}})(?:st|nd|rd|th)?,?{_space}+(\d{{4}}){_end}"

# --- fixed values: sentences shown to the reader -----------------------------------------------------
REJECT_TYPE = "Unsupported file type"
REJECT_EMPTY = "File is empty"
REJECT_LARGE = f"File is larger than {MAX_FILE_MB} MB"
REJECT_SIGNATURE = "File content does not match its extension"
NO_TEXT = "No readable text found"
UNREADABLE = "Could not read this file"
HEADLINE_INSUFFICIENT = "The uploaded documents do not contain enough evidence to answer this."
HEADLINE_EVIDENCE_ONLY = "Automatic analysis is unavailable right now. These are the most relevant passages."
HEADLINE_DEFAULT = "Here is what the documents state."
REASON_EVIDENCE_ONLY = "Automatic analysis was unavailable, so only the closest passages are shown."
REASON_NO_DOCUMENTS = "No processed documents are available yet."
REASON_NO_CLAIMS = "None of the retrieved passages states an answer to this question."
REASON_DISAGREE = "Because the documents disagree, no single answer is given."
REASON_AMBIGUOUS = "The question can be read in more than one way"
REASON_UNCOVERED = "No evidence was found for: "
REASON_INFERRED = "The documents do not state this directly; the answer is inferred."
REASON_LOW_SCAN = "All supporting text comes from a low-quality scan."
REASON_CHECK_FAILED = "The conflict check could not be completed."
NOTE_TEXT = "%s states that it replaces or amends an earlier provision."
REASON_NOTE = "%s states that it replaces an earlier provision."
REASON_NOTE_CONFLICT = "%s states that it replaces an earlier provision; the conflict is still shown so you can decide."
REASON_AGREE = "%s independent documents state the same thing directly."
REASON_ONE_DOCUMENT = "Only one document (%s) states %s."
REASON_ONE_DIRECT = "Only one document states %s directly."
REASON_ONLY_SCANS = "Support for %s comes only from low-quality scans."
REASON_TEXT_BASIS = "Positions on %s were compared as text, which is less exact than numeric comparison."
REASON_CONDITIONS = "Different values apply to different conditions"
REASON_DISCARDED = "because the quote could not be found in the source."
WARNING_KEYWORD_ONLY = "Semantic search is unavailable; keyword search only."
WARNING_NO_ANALYSIS = "Automatic analysis unavailable."
QUESTION_EMPTY, QUESTION_LONG = "empty_question", "question_too_long"
