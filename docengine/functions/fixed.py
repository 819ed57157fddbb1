"""Word lists, patterns and weights that results depend on, stated as they are."""

# document types by title and file name, in order
TITLE_TYPES = [
    ("기술기준", ["기술기준", "기술 기준", "technical standard"]),
    ("작업표준", ["작업표준", "작업 표준", "work standard"]),
    ("현황보고", ["현황", "보고서", "report", "status"]),
    ("매뉴얼", ["매뉴얼", "manual", "가이드", "guide"]),
]
FILE_TYPES = [("기술기준", ["기술기준", "tech_standard"]), ("작업표준", ["작업표준", "work_standard"])]
OTHER_TYPE = "일반문서"
# document types by identifiers in headers and section titles, in order
IDENTIFIER_TYPES = [("기술기준", ["기술기준", "technical standard", "tp-"]), ("작업표준", ["작업표준", "work standard", "ws-"])]

# keywords, units, entities, cross references
DOMAIN_KEYWORDS = ["온도", "압력", "속도", "출선", "고로", "안전", "점검", "측정", "제어", "운전", "temperature", "pressure", "speed", "safety", "control", "operation"]
UNITS = [r"\d+\.?\d*\s*°C", r"\d+\.?\d*\s*℃", r"\d+\.?\d*\s*bar", r"\d+\.?\d*\s*kg", r"\d+\.?\d*\s*m/s"]
ENTITIES = [r"고로\s*\d+호?", r"터빈\s*\d+호?", r"펌프\s*\d+호?", r"밸브\s*\d+", r"[A-Z]{2,}-\d+"]
CROSS_REFERENCES = [r"표\s*\d+[-.]?\d*", r"그림\s*\d+[-.]?\d*", r"도\s*\d+[-.]?\d*", r"Table\s*\d+[-.]?\d*", r"Figure\s*\d+[-.]?\d*", r"Fig\.\s*\d+[-.]?\d*"]
TOKENS = [r"[가-힣]{2,}", r"[A-Za-z]{3,}", r"[A-Za-z0-9-]{3,}"]
IDENTIFIERS = [
    r"[A-Z]{2,3}-\d{3,}-\d{3,}-\d{3,}",
    r"(?:Rev\.|Version|v\.?)\s*\d+(?:\.\d+)*",
    r"\d+(?:\.\d+)*\.",
    r"(?:참조|Reference|Ref\.)\s*[:\-]?\s*[^\n]+",
    r"\d{2,4}[.\-/]\d{1,2}[.\-/]\d{1,4}",
    r"[A-Z]{1,3}\d{2,6}(?:[A-Z]\d*)?",
]
DOCUMENT_NUMBER = IDENTIFIERS[0]
DOCUMENT_KEYWORDS = ["기술기준", "작업표준", "안전사항", "점검사항", "목적", "적용범위", "관련문서", "용어정의"]
DOCUMENT_ENTITIES = [r"TP-\d+", r"WS-\d+", r"\d+\.\d+\.\d+", r"Rev\.\d+"]

# classes of sentences and sections, in order
SENTENCE_CLASSES = [("procedure_step", ["단계", "step", "절차"]), ("safety_notice", ["주의", "경고", "위험", "caution", "warning"])]
SENTENCE_WEIGHTS = {"procedure_step": 1.8, "safety_notice": 2.5, "technical_reference": 2.0, "numbered_item": 1.5, "general_statement": 1.0}
SECTION_TYPES = [("purpose", ["목적", "purpose"]), ("scope", ["범위", "scope"]), ("procedure", ["절차", "procedure"]), ("safety", ["안전", "safety"]), ("reference", ["참조", "reference"])]
SECTION_FACTORS = [(1.3, ["목적", "purpose", "개요"]), (1.4, ["안전", "safety", "위험"]), (1.2, ["절차", "procedure", "방법"])]
REFERENCE_WORDS = ["참조", "reference", "ref."]

# headings
HEADING_LEVELS = [(r"^\d+\.\s+", 1), (r"^\d+\.\d+\s+", 2), (r"^\d+\.\d+\.\d+\s+", 3), (r"^[가-힣]\.\s+", 2), (r"^[가-힣]\)\s+", 2), (r"^\([가-힣]\)\s+", 3)]
HEADINGS = [r"^\d+\.\s+", r"^\d+\.\d+\s+", r"^[가-힣]\.\s+", r"^[가-힣]\)\s+", r"^\([가-힣]\)\s+", r"^\d+\)\s+"]
STRUCTURAL = [r"^\d+\.\s+", r"^\d+\.\d+\s+", r"^\d+\.\d+\.\d+\s+", r"^[①②③④⑤⑥⑦⑧⑨⑩]"]
NUMBERED = r"^(\d+(?:\.\d+)*)\s+(.+?)$"

# field types and importance
DATE_LIKE = r"\d{2,4}[-/.]\d{1,2}[-/.]\d{1,4}"
CODE_LIKE = r"[A-Z]{2,4}-\d{3}-\d{3}"
CRITICAL_WORDS = ["문서번호", "document", "제목", "title", "번호"]
TYPE_IMPORTANCE = {"code": "critical", "title": "critical", "date": "high", "number": "medium", "header": "medium", "footer": "low"}
NAME_IMPORTANCE = [("critical", ["문서번호", "document_number", "code"]), ("critical", ["제목", "title", "날짜", "date"]), ("high", ["버전", "version", "rev"])]
FIELD_PATTERNS = [
    ("code", [r"TP-\d{3}-\d{3}-\d{3}", r"[A-Z]{2,4}-\d{3}-\d{3}-\d{3}", r"문서번호[:\s]*([A-Z0-9-]+)"]),
    ("date", [r"\d{2}\.\d{2}\.\d{2}", r"\d{4}-\d{2}-\d{2}", r"시행일[:\s]*(\d{2}\.\d{2}\.\d{2})", r"날짜[:\s]*(\d{4}-\d{2}-\d{2})"]),
    ("version", [r"Rev\.?\s*(\d+)", r"개정[:\s]*(\d+)", r"버전[:\s]*(\d+)", r"V\.?\s*(\d+)"]),
    ("title", [r"^[가-힣\s\(\)]+(?:기준|표준|절차|지침)", r"^[\d\.]+\s+([가-힣\s]+)"]),
]
# position profiles: name, lowest and highest y, typical height
PROFILES = [("header", 0.0, 150.0, 30.0), ("title", 100.0, 250.0, 40.0), ("content", 200.0, 800.0, 20.0), ("footer", 750.0, 850.0, 25.0)]
PROFILE_OF_FIELD = {"code": "header", "title": "title", "date": "header", "version": "header", "header": "header", "text": "content"}
# element template: name, element type, extraction method, required, patterns
TECHNICAL_STANDARD = (
    "technical_standard_v1",
    [
        ("document_number", "fixed", "regex", True, [r"TP-\d{3}-\d{3}-\d{3}", r"[A-Z]{2,3}-\d{3}-\d{3}-\d{3}", r"문서번호[:\s]*([A-Z0-9-]+)"]),
        ("effective_date", "fixed", "regex", True, [r"\d{2}\.\d{2}\.\d{2}", r"\d{4}-\d{2}-\d{2}", r"시행일[:\s]*(\d{2}\.\d{2}\.\d{2})"]),
        ("revision", "fixed", "regex", False, [r"Rev\.(\d+)", r"개정[:\s]*(\d+)", r"버전[:\s]*(\d+)"]),
        ("author", "fixed", "regex", False, [r"작성자[:\s]*([가-힣\s]+)", r"작성[:\s]*([가-힣\s]+)"]),
        ("section_headers", "structural", "pattern", True, [r"^\d+\.\s+(.+)", r"^\d+\.\d+\s+(.+)", r"^\d+\.\d+\.\d+\s+(.+)"]),
        ("process_flow", "diagram", "inference", False, [r"[①②③④⑤⑥⑦⑧⑨⑩]", r"\d+\.\s*[^→]*→", r"단계|수순|흐름|프로세스"]),
    ],
)
ELEMENT_FIELD = {"fixed": "text", "structural": "header", "content": "text", "table": "table_cell", "diagram": "diagram"}
# metadata keys that fill missing template fields, in order
METADATA_KEYS = [("document_number", ["document_number", "doc_number"]), ("effective_date", ["effective_date", "date"]), ("author", ["author", "creator"]), ("revision", ["version", "revision"]), ("department", ["department", "dept"])]
METADATA_FIELDS = [("title", "title", "critical"), ("document_number", "code", "critical"), ("effective_date", "date", "high"), ("author", "text", "medium"), ("version", "version", "medium"), ("revision", "version", "medium")]
FIELD_KEYWORDS = [("문서번호", ["TP-", "문서번호"]), ("제목", ["기준", "표준", "절차"]), ("적용범위", ["적용범위", "범위"]), ("목적", ["목적", "목표"]), ("작성자", ["작성자", "담당자"])]
TECH_WORDS = ["적용범위", "목적", "기준", "방법", "절차", "주의사항", "참고사항"]

# process steps
STEP_PATTERNS = [(r"①([^②③④⑤⑥⑦⑧⑨⑩]+)", 1), (r"②([^③④⑤⑥⑦⑧⑨⑩]+)", 2), (r"③([^④⑤⑥⑦⑧⑨⑩]+)", 3), (r"④([^⑤⑥⑦⑧⑨⑩]+)", 4), (r"⑤([^⑥⑦⑧⑨⑩]+)", 5)]
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
SHORT_STEP = "풍량확보 및 연화융착대형성"

# chunk length limits
CHUNK_LIMITS = {"metadata": 200, "header": 100, "content": 512, "table": 800, "diagram": 400, "process_flow": 600, "section": 1000}
# layout labels and block types
BLOCK_TYPES = {"text": "paragraph", "title": "title", "heading": "heading", "table": "table", "figure": "image", "image": "image", "caption": "caption", "footnote": "footnote", "list": "list", "diagram": "diagram"}
