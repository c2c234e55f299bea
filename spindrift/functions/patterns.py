"""Patterns, keywords, weights and hints that results depend on, as data."""

# Null spellings.
INGEST_NULLS = ("", "NULL", "null", "None", "none", "N/A", "n/a", "NA", "na", "NaN", "nan", "#N/A", "#NULL!", "NIL", "nil", "-", "--", "?", "missing", "MISSING", "unknown", "UNKNOWN")
PARSER_NULLS = ("nan", "NaN", "NULL", "null", "")
HEALTH_NULLS = ("N/A", "", "NULL", "null")
JSON_NULLS = ("N/A", "NA", "NULL", "NONE", "")

# Value typing.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_PREFIXES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{1,2}/\d{1,2}/\d{2,4}")
CURRENCY = (r"^\$[\d,]+\.?\d*$", r"^\d+\.\d{2}$", r"^\$\d+$")
BOOLEANS = ("true", "false", "1", "0", "yes", "no", "y", "n")
VALUE_PATTERNS = {
    "email_like": r"@.*\.",
    "phone_like": r"\d{3}[-.]?\d{3}[-.]?\d{4}",
    "ssn_like": r"\d{3}-?\d{2}-?\d{4}",
    "url_like": r"https?://",
    "zip_code_like": r"^\d{5}(-\d{4})?$",
    "credit_card_like": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}
MEDICAL = {"icd_10": r"^[A-Z]\d{2}(\.\d{1,3})?$", "cpt_code": r"^\d{5}$", "npi": r"^\d{10}$", "mrn": r"^[A-Z0-9]{6,12}$"}
PIPELINE_IDS = (r"^[A-Z]{1,3}\d{6,10}$", r"^P\d{6,8}$", r"^[A-Z]\d{2}\.\d{1,2}$", r"^\d{10}$")
NAME_TYPES = {
    "age": "integer", "weight": "float", "height": "float", "temperature": "float", "blood_pressure": "string", "diagnosis": "categorical",
    "medication": "categorical", "gender": "categorical", "race": "categorical", "ethnicity": "categorical",
}
ORDINAL_SCALES = (
    ("low", "medium", "high"),
    ("small", "medium", "large"),
    ("poor", "fair", "good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
)

# Detector families: confidence threshold, weight in the risk score, patterns.
PII_FAMILIES = {
    "ssn": (0.8, 1.0, (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b")),
    "phone": (0.7, 0.7, (r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s?\d{3}-\d{4}\b", r"\b\d{3}\.\d{3}\.\d{4}\b", r"\b\d{3}\s\d{3}\s\d{4}\b", r"\b1?\s?\d{3}\s?\d{3}\s?\d{4}\b")),
    "email": (0.9, 0.8, (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",)),
    "credit_card": (0.8, 1.0, (r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b", r"\b6011[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b")),
    "drivers_license": (0.6, 0.7, (r"\b[A-Z]{1,2}\d{6,8}\b", r"\b\d{8,9}\b")),
    "passport": (0.6, 0.9, (r"\b[A-Z]{2}\d{7}\b", r"\b\d{9}\b")),
    "ip_address": (0.9, 0.5, (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",)),
    "address": (0.7, 0.8, (
        r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b",
        r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\.?\s*,?\s*[A-Za-z\s]+,?\s*[A-Z]{2}\s*\d{5}(-\d{4})?\b",
    )),
    "zip_code": (0.8, 0.5, (r"\b\d{5}(-\d{4})?\b",)),
    "date_of_birth": (0.6, 0.8, (r"\b(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])/(19|20)\d{2}\b", r"\b(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b")),
    "mrn": (0.5, 0.9, (r"\b[A-Z0-9]{6,12}\b",)),
    "npi": (0.7, 0.7, (r"\b\d{10}\b",)),
    "insurance_id": (0.5, 0.8, (r"\b[A-Z]{2,3}\d{6,9}\b", r"\b\d{9,12}\b")),
}
#: What a text must hold for any of a family's patterns to match.
PII_NEEDS = {
    "ssn": (r"\d{3}",), "phone": (r"\d{3}",), "email": (r"@",), "credit_card": (r"\d{3}",), "drivers_license": (r"\d{3}",), "passport": (r"\d{3}",), "ip_address": (r"\d\.\d",),
    "address": (r"\d\s", r"Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl"),
    "zip_code": (r"\d{3}",), "date_of_birth": (r"\d{3}",), "mrn": (r"[A-Z0-9]{6}",), "npi": (r"\d{3}",), "insurance_id": (r"\d{3}",),
}
#: Not in the default set: ``\b`` before ``(`` never matches after white space.
PHONE_IN_PARENTHESES = (0.7, 0.7, (r"\(\d{3}\)\s?\d{3}-\d{4}\b",))
NAMES_WEIGHT = 0.6
NAME_COLUMN_HINTS = ("name", "first", "last", "fname", "lname", "patient", "client")
DESCRIPTIONS = {
    "ssn": "Social Security Number", "phone": "Phone Number", "email": "Email Address", "credit_card": "Credit Card Number", "drivers_license": "Driver's License",
    "passport": "Passport Number", "ip_address": "IP Address", "address": "Street Address", "zip_code": "ZIP Code", "date_of_birth": "Date of Birth",
    "mrn": "Medical Record Number", "npi": "National Provider Identifier", "insurance_id": "Insurance ID", "names": "Personal Names",
}
HIPAA_FAMILIES = ("mrn", "npi", "insurance_id", "ssn", "names", "date_of_birth", "address")
FINANCIAL_FAMILIES = ("credit_card", "ssn")
URGENT_FAMILIES = ("ssn", "credit_card", "passport", "mrn")

FIRST_NAMES = (
    "james robert john michael david william richard charles joseph thomas christopher daniel paul mark donald george kenneth steven edward brian ronald"
    " anthony kevin jason matthew gary timothy jose larry jeffrey frank scott eric stephen andrew raymond gregory joshua jerry dennis walter patrick peter"
    " harold douglas henry carl arthur ryan roger mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty helen sandra"
    " donna carol ruth sharon michelle laura kimberly deborah dorothy emily amy angela ashley brenda emma olivia cynthia marie janet catherine frances christine"
).split()
LAST_NAMES = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin"
    " lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green adams nelson"
    " baker hall rivera campbell mitchell carter roberts gomez phillips evans turner diaz parker cruz edwards collins reyes stewart morris morales murphy"
    " cook rogers gutierrez ortiz morgan cooper peterson bailey reed kelly howard ramos kim cox ward richardson watson brooks chavez wood james bennett gray"
    " mendoza ruiz hughes price alvarez castillo sanders patel myers long ross foster jimenez"
).split()

# The pipeline's own detector.
PIPELINE_PII = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{9}\b", r"\b\d{3}\s\d{2}\s\d{4}\b"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "phone": (r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s\d{3}-\d{4}\b", r"\b\d{10}\b"),
    "credit_card": (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",),
    "drivers_license": (r"\b[A-Z]{1,2}\d{6,8}\b",),
}
PIPELINE_NAMES = (r"\b[A-Z][a-z]+\s[A-Z][a-z]+\b", r"\b[A-Z][a-z]+,\s[A-Z][a-z]+\b")
PII_KEYWORDS = ("name", "ssn", "social", "email", "phone")
PHI_KEYWORDS = {
    "medical_record_number": ("mrn", "medical_record", "patient_id", "chart_number"),
    "diagnosis": ("diagnosis", "condition", "disease", "disorder", "syndrome"),
    "medication": ("medication", "drug", "prescription", "rx", "medicine"),
    "procedure": ("procedure", "surgery", "operation", "treatment"),
    "provider": ("doctor", "physician", "nurse", "provider", "clinician"),
    "insurance": ("insurance", "policy", "member_id", "subscriber"),
    "facility": ("hospital", "clinic", "facility", "department"),
}
PIPELINE_MRN = r"\b[A-Z]{0,3}\d{6,10}\b"
PIPELINE_ICD = r"\b[A-Z]\d{2}(\.\d{1,2})?\b"
PHI_DATE_TERMS = ("birth", "visit", "admission", "discharge")

PII_MASKS = ((("ssn", "social"), "XXX-XX-XXXX"), (("email",), "masked@email.com"), (("phone",), "XXX-XXX-XXXX"), (("name",), "MASKED_NAME"))
PHI_MASKS = (
    (("diagnosis", "condition"), "MASKED_DIAGNOSIS"),
    (("medication", "drug"), "MASKED_MEDICATION"),
    (("provider", "doctor", "physician"), "MASKED_PROVIDER"),
    (("mrn", "medical_record"), "MRN_MASKED"),
)

# The redaction script reports these whatever the input.
DECLARED_PII = {"CLAIM_ID": 0.95, "MEMBER_ID": 0.95, "ID": 0.95, "LAST_NAME": 0.98, "AGE": 0.90, "PROVIDER_ZIP": 0.85}
DECLARED_PHI = {"DIAGNOSIS_CODE": 0.95, "PROCEDURE_CODE": 0.90, "DRG_CODE": 0.85, "ICD9_PROCEDURE": 0.90}

# Healthcare columns.
CLAIM_FIELDS = ("CLAIM_ID", "MEMBER_ID", "CLAIM_TYPE", "ADMISSION_TYPE", "PROVIDER_ZIP", "PROVIDER_SPECIALTY", "DIAGNOSIS_CODE", "PROCEDURE_CODE", "TOTAL_CHARGE", "COPAY", "COINSURANCE", "ADJUDICATION_STATUS", "CLAIM_COST")
PATIENT_FIELDS = ("ID", "LAST_NAME", "AGE", "GENDER", "DRG_CODE", "ICD9_PROCEDURE", "STATUS")
CLAIM_PROJECTION = ("CLAIM_ID", "MEMBER_ID", "CLAIM_TYPE", "ADMISSION_TYPE", "PROVIDER_SPECIALTY", "PROVIDER_ZIP", "DIAGNOSIS_CODE", "PROCEDURE_CODE", "COPAY", "COINSURANCE", "TOTAL_CHARGE", "ADJUDICATION_STATUS")
PATIENT_PROJECTION = ("CLAIM_ID", "ID", "LAST_NAME", "AGE", "GENDER", "DRG_CODE", "ICD9_PROCEDURE", "CLAIM_COST", "STATUS")
NUMERIC_FIELDS = ("PROVIDER_ZIP", "TOTAL_CHARGE", "COPAY", "COINSURANCE", "AGE", "DRG_CODE", "ICD9_PROCEDURE", "CLAIM_COST")
TYPOS = {"Emergny": "Emergency"}
ICD_STRICT = r"^[A-Z]\d{2}(\.\d{1,2})?$"
FIELD_HINTS = {
    "CLAIM_ID": {"type": "string", "pattern": r"^(IQV|CMS)\d+$"},
    "MEMBER_ID": {"type": "string", "pattern": r"^(M|PT)\d+$"},
    "CLAIM_TYPE": {"type": "categorical", "categories": ("Inpatient", "Outpatient", "Pharmacy")},
    "ADMISSION_TYPE": {"type": "categorical", "categories": ("Emergency", "Elective", "Urgent", "Newborn")},
    "PROVIDER_SPECIALTY": {"type": "categorical", "categories": ("Oncology", "Orthopedics", "Pediatrics", "Cardiology", "General Practice")},
    "DIAGNOSIS_CODE": {"type": "string", "pattern": ICD_STRICT},
    "TOTAL_CHARGE": {"type": "float", "min": 0.0, "max": 100000.0},
    "AGE": {"type": "integer", "min": 0.0, "max": 120.0},
    "GENDER": {"type": "categorical", "categories": ("M", "F")},
}
HEALTH_CONTEXT = {
    "demographics": ("age", "birth"),
    "clinical": ("diagnosis", "condition", "disease"),
    "medication": ("medication", "drug", "prescription"),
    "provider": ("provider", "doctor", "physician"),
    "financial": ("insurance", "payer", "coverage"),
}
EXPECTED_RANGES = {"age": (0.0, 120.0), "weight": (0.0, 1000.0), "height": (0.0, 300.0)}

# Defaults of the seeded claim and patient generators.
ADMISSION_TYPES = ("Emergency", "Elective", "Urgent", "Routine")
ADJUDICATION = ("Approved", "Pending", "Denied", "Under Review")
PATIENT_STATUS = ("Active", "Processed", "Completed", "Under Review")
SYNTHETIC_LAST_NAMES = (
    "Anderson Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin"
).split()
