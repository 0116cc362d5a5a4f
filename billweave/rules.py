# -*- coding: utf-8 -*-
"""Rule tables.

Everything an operator matches text against lives here, as plain data.  Operators
take these as arguments, so a caller can pass other word lists.  Each list is of
fixed length (at most a few dozen entries); that is the size bound behind every
place where a rule list is inlined into a plan or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Keyword lists for message and document relevance.
# ---------------------------------------------------------------------------
HEB_POS = (
    "חשבונית",
    "חשבונית מס",
    "חשבונית מס קבלה",
    "קבלה",
    "ארנונה",
    "שובר תשלום",
    "דרישת תשלום",
    "אגרת",
    "היטל",
    "מספר נכס",
)
EN_POS = ("invoice", "tax invoice", "receipt", "bill")
HEB_NEG = (
    "תלוש שכר",
    "תלוש",
    "משכורת",
    "שכר",
    "ברוטו",
    "נטו",
    "הפרשות פנסיה",
    "שעות נוספות",
    "פקודות יומן",
    "דוח סיכום סליקה",
    "דוח סליקה מפורט",
    "תלוש שכר לחודש",
    "טופס 161",
    "תמחיר חודשי",
)
# The second mail provider stops at the first eight Hebrew negatives.
HEB_NEG_SHORT = HEB_NEG[:8]
EN_NEG = (
    "payslip",
    "pay slip",
    "salary",
    "payroll",
    "net pay",
    "gross pay",
    "employee",
    "employer",
)
HEB_MUNICIPAL = (
    "ארנונה",
    "עיריית",
    "עיריה",
    "שובר תשלום",
    "רשות מקומית",
    "תאגיד מים",
    "מיתב",
)
WEAK_POS = ("חשבונית", "קבלה")
FORGIVEN_NEG = ("שכר",)
TRUSTED_PROVIDERS = (
    "myinvoice.bezeq.co.il",
    "my.bezeq.co.il",
    "bmy.bezeq.co.il",
    "icount.co.il",
    "greeninvoice.co.il",
    "ezcount.co.il",
    "tax.gov.il",
    "gov.il",
    "quickbooks.intuit.com",
    "stripe.com",
)
TRUSTED_SENDER_DOMAINS = ("ravpass.co.il", "hopon.co.il")
SKIP_DIRS = ("_tmp", "quarantine", "duplicates")
SKIP_DIRS_HASH_INDEX = ("_tmp", "quarantine")

# Amount and identifier hints in page text.
AMOUNT_SYMBOLS = ("₪", "$", "€", 'ש"ח', "שח", "ILS", "NIS", "USD", "EUR")
AMOUNT_PATTERNS = (
    r"(?<![\p{L}\p{N}_])\d{1,3}(?:[.,]\d{3})+[.,]\d{2}(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])\d+[.,]\d{2}(?![\p{L}\p{N}_])",
)
INVOICE_ID_PATTERNS = (
    r"מס.?ר\s*חשבונית",
    r"חשבונית\s*מס.?ר",
    r"מס.?ר\s*קבלה",
    r"receipt\s*(?:no|#)",
    r"invoice\s*(?:no|#)",
)

# Secrets removed from report text, in this order.
REDACTIONS = (
    (r"(?i)Authorization:\s*Bearer\s+\S+", "[REDACTED_AUTH_HEADER]"),
    (r"(?i)Bearer\s+\S+", "[REDACTED_BEARER_TOKEN]"),
    (r"""[^\s'",;]*(?:credentials|token)\.json""", "[REDACTED_CREDENTIAL_PATH]"),
    (
        r"""[^\s'",;]*\.msal[\w.-]*\.bin|[^\s'",;]*msal[_\w.-]*cache[\w.-]*\.bin""",
        "[REDACTED_TOKEN_CACHE_PATH]",
    ),
)

# Month names.
MONTHS = {
    "ינואר": 1,
    "פברואר": 2,
    "מרץ": 3,
    "מרס": 3,
    "אפריל": 4,
    "מאי": 5,
    "יוני": 6,
    "יולי": 7,
    "אוגוסט": 8,
    "ספטמבר": 9,
    "ספטמבער": 9,
    "אוקטובר": 10,
    "נובמבר": 11,
    "דצמבר": 12,
    "january": 1,
    "jan": 1,
    "february": 2,
    "feb": 2,
    "march": 3,
    "mar": 3,
    "april": 4,
    "apr": 4,
    "may": 5,
    "june": 6,
    "jun": 6,
    "july": 7,
    "jul": 7,
    "august": 8,
    "aug": 8,
    "september": 9,
    "sept": 9,
    "sep": 9,
    "october": 10,
    "oct": 10,
    "november": 11,
    "nov": 11,
    "december": 12,
    "dec": 12,
}
MONTH_LABELS_HE = (
    "ינואר",
    "פברואר",
    "מרץ",
    "אפריל",
    "מאי",
    "יוני",
    "יולי",
    "אוגוסט",
    "ספטמבר",
    "אוקטובר",
    "נובמבר",
    "דצמבר",
)

# Vendor markers in priority order (some are visual-order Hebrew).
VENDOR_MARKERS = (
    ("יול ימר", "רמי לוי תקשורת"),
    ("פרטנר", 'חברת פרטנר תקשורת בע"מ'),
    ("רנטרפ", 'חברת פרטנר תקשורת בע"מ'),
    ("partner communications", 'חברת פרטנר תקשורת בע"מ'),
    ("support@pango.co.il", "Pango"),
    ("pango.co.il", "Pango"),
    ("pango", "Pango"),
    ("פנגו", "Pango"),
    ("בזק-ג'ן בע\"מ", "בזק-ג'ן בע\"מ"),
    ('בזק-ג׳ן בע"מ', 'בזק-ג׳ן בע"מ'),
    ("מ\"עב ן'ג-קזב", 'בזק-ג׳ן בע"מ'),
    ('דן חברה לתחבורה ציבורית בע"מ', 'דן חברה לתחבורה ציבורית בע"מ'),
    ('מ"עב תירוביצ הרובחתל הרבח ןד', 'דן חברה לתחבורה ציבורית בע"מ'),
    ("משרד התחבורה והבטיחות בדרכים", "משרד התחבורה והבטיחות בדרכים"),
    ("םיכרדב תוחיטבהו הרובחתה דרשמ", "משרד התחבורה והבטיחות בדרכים"),
    ("אופק הפקות", "אופק הפקות"),
    ("הפקות אופק", "אופק הפקות"),
    ("אופק", "אופק הפקות"),
    ("ofek productions", "אופק הפקות"),
    ("סטינג", "STINGTV"),
    ("stingtv", "STINGTV"),
    ("סי יתורש", "STINGTV"),
    ("יתורש סי", "STINGTV"),
    ("just simple ltd", "JUST SIMPLE LTD"),
)
KEREN_TERMS = ("קרן", "מדריכת", "הורים", "ותינוקות")
KEREN_VENDOR = "קרן-מדריכת הורים ותינוקות"
PETAH_TIKVA_KEYWORDS = ("פתח תק", "הווקת חתפ")
PETAH_TIKVA_MARKERS = (
    "עיריית",
    "עריית",
    "עירייה",
    "עיריה",
    "ערייה",
    "עריה",
    "עירית",
    "ערית",
    "העירייה",
    "העיריה",
    "תיעיר",
    "תיעירת",
    "רשות מקומית",
)
PETAH_TIKVA_VENDOR = "עיריית פתח תקווה"
GENERIC_MUNICIPAL_VENDOR = "רשות מקומית"
TRANSPORT_HEBREW = (
    "תירוביצ הרובחת",
    "תירוביצה הרובחת",
    "תירוביצה הרובחתה",
    "התחבורה הציבורית",
    "וק-בר",
    "רב-קו",
)
TRANSPORT_LATIN = ("ravpass", "rav-kav", "ravkav", "rav kav")
TRANSPORT_INVOICE_FOR = "רב-קו - טעינה"
COMPANY_SUFFIXES = ('מ"עב', 'בע"מ', "Ltd", "חברה")

# Category rules (category, weight, vendor keys, keywords), in order.
CATEGORY_RULES = (
    (
        "transportation",
        0.95,
        (
            'דן חברה לתחבורה ציבורית בע"מ',
            "משרד התחבורה והבטיחות בדרכים",
            "תירוביצ הרובחת",
            "תירוביצה הרובחת",
            "התחבורה הציבורית",
            "רב-קו",
            "וק-בר",
            "pango",
            "פנגו",
            "ravpass",
            "rav-kav",
            "ravkav",
            "rav kav",
        ),
        (
            "תחבורה ציבורית",
            "חניה",
            "חניון",
            "פירוט החניות",
            "parking",
            "ravpass",
            "rav-kav",
            "bus",
            "train",
            "light rail",
            "travel card",
        ),
    ),
    (
        "communication",
        1.0,
        (
            "בזק",
            "bezeq",
            "cellcom",
            "partner",
            "פרטנר",
            "hot",
            "yes",
            "סטינג",
            "stingtv",
            "רמי לוי",
            "רמי לוי תקשורת",
            "rami levy",
            "rami-levy",
        ),
        ("תקשורת", "אינטרנט", "internet", "fiber", "broadband"),
    ),
    (
        "utilities",
        0.9,
        ("חשמל", "חברת החשמל", "מים", "תאגיד מים", "ארנונה", "city", "municipality"),
        ("bill", "utility"),
    ),
    (
        "software_saas",
        0.8,
        ("google", "microsoft", "aws", "stripe", "notion", "slack"),
        ("subscription", "license"),
    ),
    ("finance", 0.7, ("visa", "mastercard", "amex", "isracard"), ("כרטיס אשראי",)),
    (
        "services",
        0.6,
        ("קרן-מדריכת הורים ותינוקות", "אופק הפקות"),
        ("שירות", "service", "support"),
    ),
)

# Markers of the municipal page split and breakdown.
DIRECT_DEBIT_LABELS = ('סה"כ יגבה מהחשבון', 'סה"כ יגבה')
DIRECT_DEBIT_WORDS = ("יגבה", "לתשלום")
MUNICIPAL_BREAKDOWN_MARKERS = ("חיוב תקופתי", "חיוב שנתי", "הנחת גביה", "הנחת תשלום")
MUNICIPAL_TEXT_MARKERS = ("ארנונה", "עיריית", "רשות מקומית", "תאגיד מים", "onecity")
PARTNER_TEXT_MARKERS = ("פרטנר", "partner", "Partner")
PARTNER_PAGE_WORDS = ("חשבון", "תקופתי")
PARTNER_PERIODIC_MARKERS = ("חשבון תקופתי", "מקור-תקופתי", "חשבון מקור-תקופתי")
PARTNER_TOTAL_PATTERNS = (
    r"סה[\"״']?כ\s+חיובים\s+וזיכויים\s+לתקופת\s+החשבון\s+כולל\s+מע\"?מ",
    r"סה[\"״']?כ\s+לתשלום",
)
PARTNER_BASE_PATTERN = r"סה[\"״']?כ\s+חיובי\s+החשבון\s+לא\s+כולל\s+מע\"?מ"
PARTNER_VAT_PATTERN = r"מע\"?מ%?\s*18"

# Labelled amounts used when resolving totals and VAT.
INLINE_TOTAL_MARKERS = ('םלוש כ"הס', 'םולשתל כ"הס', "םולשתל")
TOTAL_LINE_MARKERS = ('סה"כ', "סה״כ", "סהכ", 'סה"כ לתשלום', 'סה"כ לתשלום בש"ח')
BLOCK_TOTAL_MARKERS = ('כ"הס', 'סה"כ')
BASE_MARKER = 'מ"עמ ינפל'
VAT_ON_MARKER = 'לע מ"עמ'
VAT_MARKERS = ('לע מ"עמ', 'מ"עמ ')
VAT_LINE_MARKER = 'מ"עמ'
VAT_LIABLE_MARKER = 'מ"עמל'
TOTAL_MARKS = ('כ"סה', 'סה"כ')
VAT_MARKS = ('מ"מע', 'מע"מ')
INCLUDING_MARK = "כולל"
TOTAL_REGEX = r"סה.?\"?כ.?[:\-]?\s*([\d.,]+)"
TOTAL_PATTERNS = (
    r"סה.?\"?כ.? ?לתשלום[^\d]*([\d.,]+)",
    r"([\d.,]+)\s+סה.?\"?כ.? ?לתשלום",
    r"סה.?\"?כ.? ?לתשלום(?:.|\n){0,40}?([\d.,]+)",
    r"כ.?\"?הס[^\n]{0,40}?םולשתל[^\n]{0,40}?ח.?\"?ש[^\n]{0,40}?מ\"?עמ[^\d]*([\d.,]+)",
    r"([\d.,]+)\s+מ\"?עמ[^\n]{0,40}?ח.?\"?ש[^\n]{0,40}?םולשתל[^\n]{0,40}?כ.?\"?הס",
)
# per pattern the literals it needs
TOTAL_PATTERN_WORDS = (("לתשלום",), ("לתשלום",), ("לתשלום",), ("םולשתל", "הס"), ("םולשתל", "הס"))
TOTAL_NEAR_PATTERNS = (
    r"סה.?\"?כ.? ?לתשלום",
    r"כ.?\"?הס[^\n]{0,40}?םולשתל[^\n]{0,40}?מ\"?עמ",
    r"ח.?\"?ש[^\n]{0,20}?םולשתל",
)
DEBIT_LINE_PATTERN = r"סה.?\"?כ.? ?יגבה[^:]*:\s*([0-9,\.\s]+?)(?:\n|$)"
DEBIT_BLOCK_PATTERN = r"סה.{0,4}?יגבה[^:]*:\s*([\s\S]*?)\n\s*4"
DEBIT_TEXT_PATTERN = r"סה.?\"?כ.? ?יגבה[^0-9]+([\d.,]+)"
SHEKEL_TOTAL_PATTERN = r"₪\s*([\d.,]+)\s*[:\-]?\s*כ[\"״']?הס"
SHEKEL_PATTERN = r"₪\s*([\d.,]+)"
VAT_PATTERNS = (
    r"סה.?\"?כ.? ?מע\"?מ[^\d]*([\d.,]+)",
    r"([\d.,]+)\s+סה.?\"?כ.? ?מע\"?מ",
    r"מ\"?עמ[^\n]{0,30}?כ.?\"?הס[^\d]*([\d.,]+)",
    r"([\d.,]+)\s+כ.?\"?הס[^\n]{0,30}?מ\"?עמ",
)
VAT_PATTERN_WORDS = (("מע", "סה"), ("מע", "סה"), ("עמ", "הס"), ("עמ", "הס"))
VAT_NEAR_PATTERNS = (r"סה.?\"?כ.? ?מע\"?מ", r"מ\"?עמ[^\n]{0,30}?כ.?\"?הס")
VAT_RATE_PATTERNS = (
    r"([\d.,]+)\s*%[^\n]{0,15}?מ\s*[\"״']?\s*ע\s*[\"״']?\s*מ",
    r"מ\s*[\"״']?\s*ע\s*[\"״']?\s*מ[^%\d]{0,15}?([\d.,]+)\s*%",
    r"VAT[^%\d]{0,15}?([\d.,]+)\s*%",
)
STANDARD_VAT_PERCENT = 18.0
BLOCK_START_MARKERS = ('ח"שב', "חשב כ")
BLOCK_END_MARKERS = (
    "סכנה",
    "סה",
    'סה"',
    "סה''כ יגבה",
    'סה"כ יגבה',
    "Sample text",
    "ללוכ בויח",
    "ןובשחה טוריפ",
    "עצבמב לולכ",
)
STING_START = "ןובשחה טוריפ"
STING_END_MARKERS = ("עצבמב לולכ", "תמלשומה", "Sample")
STING_PHRASES = (
    ("שירותי תוכן בינלאומיים", ("שירותי תוכן בינלאומיים", "םיימואלניב ןכות יתוריש")),
    ("ספריות וערוצי פרימיום", ("ספריות וערוצי פרימיום", "םוימירפ יצורעו תוירפס")),
)

# Invoice number patterns with their priority, and a word each needs.
ID_SHORTCUTS = (
    (r"מס.?['׳]?\s+חשבון\s+תקופתי[:\s-]*([\d-]{6,})", ("תקופתי",)),
    (
        r"(\d{4,})\s*:\s*(?:חשבונית\s*מס/קבלה\s*מספר|רפסמ\s*הלבק/סמ\s*תינובשח)",
        ("חשבונית", "תינובשח"),
    ),
)
ID_RECEIPT_SHORTCUT = r"(\d{3,})\s+קבלה\s+מס\s+חשבונית"
ID_PERIODIC_SHORTCUT = r"([\d-]{6,})[\s\S]{0,80}?[:]?יתפוקת"
ID_PATTERNS = (
    (r"חשבונית\s+מס\s+קבלה\s*(\d+)", 0, "חשבונית"),
    (r"חשבונית(?:\s+מס)?(?:\s+קבלה)?\s*(?:מספר|No\.?)\s*[:\-]?\s*(\d+)", 0, "חשבונית"),
    (r"(\d{4,})\s*רפסמ\s*תינובשח", 0, "תינובשח"),
    (r"(\d{4,})\s*רפסמ\s*קיתב\s*מ\"עמ", 1, "קיתב"),
    (r"(\d{4,})\s+רפסמ", 2, "רפסמ"),
    (r"מספר\s+(\d{4,})", 2, "מספר"),
    (r"מס.?['׳]?\s*מסלקה/שובר/ספח[:\s]+(\d{4,})", 0, "מסלקה"),
    (r"מסלקה/שובר/ספח[:\s]+(\d{4,})", 1, "מסלקה"),
)
ID_LINE_MARKER = "רפסמ"

# Dates, due dates, references.
DATE_TOKEN = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
INVOICE_DATE_PATTERNS = (
    r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\s*:ךיראת",
    r"תאריך\s*[:\-]?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    r"Date\s*[:\-]?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    r"תאריך\s*הדפסה\s*[:\-]?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
)
PERIOD_AUTOPAY_PATTERN = r"(?:\d{2}/\d{2}/\d{4}.{0,40}?){2,}הוראת הקבע"
PERIOD_RANGE_PATTERN = (
    r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\s*[-–]\s*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"
)
PERIOD_BILINGUAL_PATTERN = r"(\d{4})\s+([א-ת]+)\s*[-–]\s*([א-ת]+)"
PERIOD_MONTH_PATTERN = r"(?:תקופה|billing|statement|month|חודש)\D*([A-Za-zא-ת]+)\s+(\d{4})"
DUE_DATE_PATTERNS = (
    r"(?:Due Date|Payment Due|לתשלום עד|מועד תשלום|תאריך אחרון לתשלום)\D{0,15}([0-9./-]{6,10})",
    r"מועד אחרון[:\s]+([0-9./-]{6,10})",
)
REFERENCE_PATTERNS = (
    r"(?:PO|P\.O\.|Purchase Order)[\s#:=-]*([A-Z0-9-]{4,})",
    r"מספר\s+(?:הזמנה|לקוח|חוזה|עסקה)[\s#:=-]*([0-9-]{4,})",
    r"(?:Customer ID|Account Number)[\s#:=-]*([A-Z0-9-]{4,})",
)

# What the invoice is for.
PARKING_WORDS = ("חניון", "חניה")
PARKING_LATIN = "parking"
PARKING_DETAILS = "פירוט החניות"
PARKING_LABEL = "חניה"
KEREN_FOR_PATTERN = r"פירוט\s+(20\d{2})\s+([א-ת]+)\s+תנועה\s+חוג"
OFEK_MONTHS = "אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר|ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי"
OFEK_VARIANTS = (
    (r"חוג\s+תיאטרון\s+חודש\s+(MONTH)", "חוג תיאטרון חודש "),
    (r"(MONTH)\s+חודש\s+תיאטרון\s+חוג", "חוג תיאטרון חודש "),
    (r"חוג\s+חודש\s+(MONTH)", "חוג חודש "),
    (r"(MONTH)\s+חודש\s+חוג", "חוג חודש "),
)
JUST_SIMPLE_MARKER = "just simple ltd"
JUST_SIMPLE_TERMS = ("תפעול", "פנסיוני", "שוטף")
JUST_SIMPLE_LABEL = "תפעול פנסיוני- שוטף "
JUST_SIMPLE_HEADERS = ("תאור", "תיאור")
JUST_SIMPLE_STOPS = ("כמות", 'סה"כ', "סכום", "פירוט", "אופן")
JUST_SIMPLE_PERIOD = r"(?<![\p{L}\p{N}_])(?:0?[1-9]|1[0-2])/\d{2}(?![\p{L}\p{N}_])"
PARTNER_DETAIL_WORDS = ("פירוט", "חיובים", "זיכויים", "החשבון")
PARTNER_DETAIL_STOPS = ('סה"כ', "סהכ", 'כ"הס')
PARTNER_DETAIL_LABEL = "פירוט חיובים וזיכויים לתקופת החשבון"
PARTNER_SEGMENT_PATTERN = (
    r"פירוט\s+חיובים\s+וזיכויים\s+לתקופת\s+החשבון\s+(.*?)\s+סה\"?כ\s+חיובי\s+החשבון"
)
PARTNER_MOBILE_PATTERN = r"(\d+)מנויי\s*סלולר"
PARTNER_LINE_PATTERN = r"(\d+)מנוי\s*תמסורת\s*([\d-]+)"
PARTNER_GENERAL_PATTERN = r"תנועות\s+כלליות\s+בחשבון\s+הלקוח"
PARTNER_GENERAL_LABEL = "תנועות כלליות בחשבון הלקוח"
ITEMS_HEADER = ":םיטרפ"
ITEMS_STOPS = ("טקמ", 'כ"הס', 'סה"כ', "כסה")
CHARGE_DETAIL = "פירוט החיוב"
CHARGE_DETAIL_SKIPS = ('סה"כ', "סהכ", "תיאור", "כתובת", "מס' זיהוי", "מספר זיהוי", "מס'")
ASSET_WORD = "נכס"
FOR_SEPARATORS = (" עבור ", " - ")
BUSINESS_TAX = "ארנונה לעסקים"
PROPERTY_TAX = "ארנונה"

# ---------------------------------------------------------------------------
# Message scoring (link-first and keyword-first models).
# ---------------------------------------------------------------------------
SCORE_KEYWORDS = {
    "hebrew_core": (
        "חשבונית",
        "חשבונית מס",
        "קבלה",
        "אסמכתא",
        "תשלום",
        "דרישת תשלום",
        "קבלה מס",
        "חשבונית מס קבלה",
        "חיוב",
        "זיכוי",
        "שובר תשלום",
    ),
    "english_core": (
        "invoice",
        "tax invoice",
        "receipt",
        "payment receipt",
        "billing statement",
        "payment request",
        "charge",
        "credit note",
    ),
    "hebrew_context": (
        "מספר חשבונית",
        "סכום לתשלום",
        "יתרה לתשלום",
        "פירוט חיובים",
        "לצפייה בחשבונית",
        "הורדה",
        "הורד",
        "הורד קובץ",
        "קישור לחשבונית",
    ),
    "english_context": (
        "invoice number",
        "amount due",
        "balance due",
        "view invoice",
        "download invoice",
        "download receipt",
        "statement",
    ),
    "municipal_he": (
        "ארנונה",
        "שובר תשלום",
        "עיריית",
        "עיריה",
        "עירייה",
        "רשות מקומית",
        "תאגיד מים",
        "ביוב",
        "אגרת",
        "היטל",
    ),
    "donation_he": ("תרומה", "עמותה", 'מלכ"ר', 'ע"ר'),
}
STRICT_KEYWORDS = (
    "חשבונית",
    "חשבונית מס",
    "חשבונית מס קבלה",
    "קבלה",
    "invoice",
    "tax invoice",
    "receipt",
)
ATTACHMENT_EXTENSIONS = (".pdf", ".tif", ".tiff", ".jpg", ".jpeg", ".png", ".xlsx", ".xls")
ATTACHMENT_NAME_HINTS = ("invoice", "receipt", "חשבונית", "קבלה", "שובר", "ארנונה")
ATTACHMENT_NOTICE_PATTERN = (
    r"(?:הודעה|מידע|דף\s*הסבר|הסבר|notice|info|information).{0,20}(?:חשבונית|קבלה)"
)
SUBJECT_STRONG_PATTERN = (
    r"(?:חשבונית|קבלה)|(?<![\p{L}\p{N}_])(?:invoice|receipt)(?![\p{L}\p{N}_])"
)
DONATION_RECEIPT_WORD = "קבלה"
URL_KEYWORDS = (
    "invoice",
    "receipt",
    "statement",
    "bill",
    "חשבונית",
    "קבלה",
    "תשלום",
    "payment",
    "download",
    "voucher",
    "shovar",
    "ארנונה",
)
LINK_TRUSTED = (
    "greeninvoice.co.il",
    "icount.co.il",
    "ezcount.co.il",
    "priority-software.com",
    "sap.com",
    "zoho.com",
    "xero.com",
    "quickbooks.intuit.com",
    "stripe.com",
    "paypal.com",
    "wix.com",
    "shopify.com",
    "tax.gov.il",
    "freshbooks.com",
    "waveapps.com",
    "cardcom.co.il",
    "myinvoice.bezeq.co.il",
    "bezeq.co.il",
)
LINK_PATH_PATTERNS = (
    "invoice",
    "receipt",
    "billing",
    "payments",
    "download",
    "documents",
    "חשבונית",
    "קבלה",
    "תשלום",
    "voucher",
    "ארנונה",
)
LINK_SUFFIXES = (".pdf",)
LINK_HTTP_ALLOWED = ("citypay.co.il",)
TRACKING_DOMAINS = ("webversion.net", "web-view.net", "mandrillapp.com", "s4.exct.net")
TRACKING_PREFIXES = ("click.", "image.", "view.", "trailer.")
DOWNLOAD_URL_HINTS = ("pdf", "invoice", "download", "receipt", "חשבונית", "קבלה")
DEFAULT_SENDER_RULES = ("+@bezeq.co.il",)
MIN_CONFIDENCE = 0.55
MIN_PDF_BYTES = 6000
VERIFY_THRESHOLDS = {"none": 0.0, "light": 0.30, "strict": 0.45}
STRATEGIES = (
    ("attachments_and_keywords_recent", ("invoice", "receipt", "חשבונית", "קבלה")),
    (
        "keywords_only_recent",
        ("invoice", "receipt", "statement", "billing", "חשבונית", "קבלה", "תשלום"),
    ),
    ("hebrew_bias", ("חשבונית", "חשבונית מס", "קבלה", "תשלום", "חשבונית מס קבלה")),
    (
        "provider_whitelist_bump",
        (
            "greeninvoice.co.il",
            "icount.co.il",
            "ezcount.co.il",
            "quickbooks.intuit.com",
            "stripe.com",
            "paypal.com",
            "zoho.com",
            "xero.com",
            "shopify.com",
            "tax.gov.il",
            "cardcom.co.il",
            "myinvoice.bezeq.co.il",
            "bezeq.co.il",
        ),
    ),
    (
        "municipal_hebrew",
        (
            "ארנונה",
            "שובר תשלום",
            "עיריית",
            "עיריה",
            "רשות מקומית",
            "תאגיד מים",
            "אגרת",
            "היטל",
        ),
    ),
)
# The keyword-first (second) model: extra words, weights and its own link rules.
V2_EXTRA_ENGLISH_CORE = ("statement", "bill")
V2_HEBREW_CONTEXT = (
    "מספר חשבונית",
    "סכום לתשלום",
    "יתרה לתשלום",
    "פירוט חיובים",
    "לצפייה בחשבונית",
    "הורדה",
    "הורד קובץ",
    "קישור לחשבונית",
)
V2_EXTRA_ENGLISH_CONTEXT = ("view bill", "download bill")
V2_NAME_HINTS = ("invoice", "receipt", "חשבונית", "קבלה", "statement", "bill")
V2_URL_KEYWORDS = (
    "invoice",
    "receipt",
    "statement",
    "bill",
    "חשבונית",
    "קבלה",
    "תשלום",
    "payment",
    "download",
    "view",
)
V2_TRUSTED = (
    "greeninvoice.co.il",
    "icount.co.il",
    "ezcount.co.il",
    "priority-software.com",
    "sap.com",
    "zoho.com",
    "xero.com",
    "quickbooks.intuit.com",
    "intuit.com",
    "stripe.com",
    "paypal.com",
    "wix.com",
    "shopify.com",
    "tax.gov.il",
    "gov.il",
    "freshbooks.com",
    "waveapps.com",
)
V2_PATH_PATTERNS = (
    "invoice",
    "receipt",
    "billing",
    "payments",
    "download",
    "documents",
    "חשבונית",
    "קבלה",
    "תשלום",
    "bill",
    "statement",
    "view",
)
V2_SUFFIXES = (".pdf", ".html", ".htm", ".aspx")
V2_QUERY_WORDS = ("invoice", "receipt", "doc", "download", "statement", "bill")
V2_HEBREW_WEIGHT = 1.2
V2_ENGLISH_WEIGHT = 1.0
V2_ATTACHMENT_BONUS = 0.25
V2_LINK_BONUS = 0.25
# The page-hit variant.
SUBJECT_HE_PATTERN = r"(?:חשבונית|קבלה|ארנונה|שובר\s*תשלום|דריש(?:ת|ה)\s*תשלום)"
SUBJECT_EN_PATTERN = r"(?:invoice|receipt|statement|bill)"
PAGE_HEBREW_KEYWORDS = (
    "חשבונית",
    "חשבונית מס",
    "חשבונית מס קבלה",
    "קבלה",
    "ארנונה",
    "שובר תשלום",
    "דרישת תשלום",
    "אגרת",
    "היטל",
)
PAGE_ENGLISH_KEYWORDS = ("invoice", "tax invoice", "receipt", "bill", "statement")

# Support-page button scoring.
BUTTON_REQUIRED = "חשבונ"
BUTTON_EXCLUDED = ("שאלה:", "סימולטור")
BUTTON_SCORES = (
    (("נאמן למקור",), 5),
    (("לחודש", "לתקופת"), 4),
    (("לחץ לפתיחת",), 3),
    (("קישור",), 2),
    (("כפתור תמיכה",), 1),
)
PROVIDER_ALIASES = {
    "graph": "outlook",
    "msgraph": "outlook",
    "outlook": "outlook",
    "microsoft": "outlook",
    "gmail": "gmail",
}
CHARGE_EVENT_TYPE = "ad_account_billing_charge"


@dataclass(frozen=True)
class TermRules:
    """Positive and negative terms; Latin terms match without case, Hebrew as is."""

    latin_pos: tuple = EN_POS
    raw_pos: tuple = HEB_POS
    latin_neg: tuple = EN_NEG
    raw_neg: tuple = HEB_NEG
    municipal: tuple = HEB_MUNICIPAL
    weak: tuple = WEAK_POS
    forgiven: tuple = FORGIVEN_NEG


SECOND_PROVIDER_TERMS = TermRules(raw_neg=HEB_NEG_SHORT)


@dataclass(frozen=True)
class KeywordFirstRules:
    """Words of the keyword-first model: core words by language and words around them."""

    hebrew: tuple = SCORE_KEYWORDS["hebrew_core"]
    english: tuple = SCORE_KEYWORDS["english_core"] + V2_EXTRA_ENGLISH_CORE
    context: tuple = V2_HEBREW_CONTEXT + SCORE_KEYWORDS["english_context"] + V2_EXTRA_ENGLISH_CONTEXT


@dataclass(frozen=True)
class LinkRules:
    keywords: tuple = URL_KEYWORDS
    path_patterns: tuple = LINK_PATH_PATTERNS
    suffixes: tuple = LINK_SUFFIXES
    trusted: tuple = LINK_TRUSTED
    http_allowed: tuple = LINK_HTTP_ALLOWED
    tracking: tuple = TRACKING_DOMAINS
    tracking_prefixes: tuple = TRACKING_PREFIXES


@dataclass(frozen=True)
class ScoreRules:
    hebrew: tuple = SCORE_KEYWORDS["hebrew_core"] + SCORE_KEYWORDS["hebrew_context"]
    english: tuple = SCORE_KEYWORDS["english_core"] + SCORE_KEYWORDS["english_context"]
    municipal: tuple = SCORE_KEYWORDS["municipal_he"]
    donation: tuple = SCORE_KEYWORDS["donation_he"]
    donation_word: str = DONATION_RECEIPT_WORD
    strict: tuple = STRICT_KEYWORDS
    subject_strong: str = SUBJECT_STRONG_PATTERN
    notice: str = ATTACHMENT_NOTICE_PATTERN
    extensions: tuple = ATTACHMENT_EXTENSIONS
    name_hints: tuple = ATTACHMENT_NAME_HINTS
    sender_rules: tuple = ()
    negatives: tuple = ()
    subject_boosts: tuple = ()
    links: LinkRules = field(default_factory=LinkRules)
