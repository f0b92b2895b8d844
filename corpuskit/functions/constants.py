"""Fixed values that results depend on."""

# Words left out of a processed query.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can this that these those it its i my me we our you your he his she her they their "
    "what which who whom when where how about into through during before after above below between each so than too very "
    "just also then any all both few more most other some such own same"
).split()

# Words left out of a keyword search.
KEYWORD_STOP_WORDS = (
    "a an the is in it of to for and or on at by from with me my our your their find show get give list tell what which how "
    "where when who why can could would should do does did we i you he she they this that these those are was were been be has "
    "had have not but so any all some about related regarding concerning information document documents file files please"
).split()

# Expansions of query terms.
EXPANSIONS = {
    "ai": ["artificial intelligence", "machine learning"],
    "ml": ["machine learning"],
    "nlp": ["natural language processing"],
    "api": ["application programming interface"],
    "db": ["database"],
    "doc": ["document"],
    "docs": ["documents", "documentation"],
    "config": ["configuration"],
    "auth": ["authentication", "authorisation"],
    "ui": ["user interface"],
    "ux": ["user experience"],
    "vs": ["versus", "compared to"],
    "k8s": ["kubernetes"],
    "ci": ["continuous integration"],
    "cd": ["continuous delivery", "continuous deployment"],
    "rag": ["retrieval augmented generation"],
    "llm": ["large language model"],
    "ocr": ["optical character recognition"],
}

# Words that show a query's intent.
COMPARISON_WORDS = "vs versus compare difference differences between better worse pros cons or".split()
FACTUAL_WORDS = "who what when where why how which define explain describe tell mean means".split()
NAVIGATIONAL_WORDS = "find open show go navigate search locate get file document folder path".split()

# Words that have no initial in an abbreviation.
INITIAL_STOP_WORDS = "a an the of and for in to at by or with on as from its is are be".split()

# Words left out of file names.
FILENAME_STOP_WORDS = "pdf doc docx txt md the a an of in on at for and or to by from with".split()

# Terms too common to tell folders apart.
GENERIC_TERMS = (
    "data report analysis management system process review plan strategy performance service solution information project team "
    "work business company organization requirement document guide overview update summary assessment evaluation "
    "implementation development application infrastructure technology digital enterprise global new key main core high low "
    "current future total list type use based level area structure approach objective result output input value quality "
    "standard policy procedure control framework monitoring reporting vendor supplier req north south east west central region "
    "zone travel personal home family tax renovation budget notes planning"
).split()

# Files that are read, folders that are not, system roots, name parts of private files, catch-all folders.
EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".xlsx", ".pptx"]
EXCLUDED_DIRS = [
    "node_modules", ".git", ".venv", ".claude", "__pycache__", "target", "dist", "build", ".next", ".nuxt",
    "$Recycle.Bin", "Windows", "Program Files", "Program Files (x86)", "AppData", "System Volume Information",
]
SYSTEM_ROOTS = ["C:/Windows", "C:/Program Files", "C:/Program Files (x86)", "C:/ProgramData", "C:/System Volume Information", "/etc", "/sys", "/proc", "/dev", "/boot"]
PERSONAL_WORDS = "personal home garden family renovation private hobby leisure".split()
DUMP_FOLDERS = ["misc", "miscellaneous", "temp", "temporary", "tmp", "unsorted", "new folder", "various", "other", "general", "dump", "inbox", "staging", "to sort", "random", "junk", "files", "stuff"]
LOCK_PREFIX = "~$"

# Entity and relationship types, and parts of keys whose values are never logged.
ENTITY_TYPES = "Document Person Organization Project Technology Concept Location Event Product".split()
RELATIONSHIP_TYPES = "MENTIONS RELATED_TO BELONGS_TO REFERENCES AUTHORED_BY PART_OF OWNS MEMBER_OF DEPENDS_ON SIMILAR_TO".split()
SENSITIVE_KEYS = "password secret key token credential subscription_key api_key auth".split()

# What is small talk rather than a question.
SMALL_TALK = (
    r"(?i)^\s*(hi+|hello+|hey+|howdy|greetings?|good\s+(morning|afternoon|evening|day)|thanks?|thank\s+you|thx|cheers|bye+|goodbye|"
    r"ok+|okay|sure|yes|no|yep|nope|who\s+are\s+you|what\s+are\s+you|help)\s*[.!?]?\s*$"
)

# How texts write an abbreviation with its definition.
ABBREVIATION_FIRST = r"\b([A-Z]{2,8})\s*\(([a-zA-Z][^()]{2,79})\)"
DEFINITION_FIRST = r"\b((?:[A-Z][a-zA-Z\-]*\s+){1,7}[A-Z][a-zA-Z\-]*)\s*\(([A-Z]{2,8})\)"
