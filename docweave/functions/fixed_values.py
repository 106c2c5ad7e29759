"""Values that results depend on, as plain text."""

# Separators and limits.
FIELD_SEPARATOR = "<SEP>"
TUPLE_DELIMITER = "<|#|>"
COMPLETION_MARKER = "<|COMPLETE|>"
CHUNK_TOKENS, CHUNK_OVERLAP = 1200, 100
RERANK_TOKENS, RERANK_OVERLAP, CHARS_PER_TOKEN = 480, 32, 4
MAX_FILE_PATHS, MAX_SOURCE_IDS, MAX_ENTITY_NAME = 100, 300, 256
SUMMARY_CHARS = 250
ENTITY_BUDGET, RELATION_BUDGET, TOTAL_BUDGET = 6000, 8000, 30000
BELONGS_TO_WEIGHT, BELONGS_TO_KEYWORDS = 10.0, "belongs_to,part_of,contained_in"

# Words of names that are no entities.
LAYOUT_WORDS = (
    "page index", "page number", "footer content", "header content", "page footnote", "page footnote content",
    "bounding box", "bounding box coordinates", "reference type", "token type", "token types", "image path",
)
AMBIGUOUS_WORDS = (
    "paper", "title", "other", "others", "they", "them", "their", "ours", "all", "labels", "this paper", "our paper",
    "our work", "this study",
)
NOISE_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "in", "on", "to", "for", "by", "and", "or", "et", "new",
    "related", "none", "null", "n/a", "na", "tr", "rt", "tt", "xt", "etc", "content", "analysis", "method", "results",
    "source", "total", "team", "list", "url",
)
SLASH_PHRASES = ("and/or", "input/output", "output/input", "read/write", "yes/no", "on/off")
FILE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "svg", "ico", "pdf", "doc", "docx", "txt", "xlsx", "xls",
    "pptx", "ppt", "html", "htm", "md", "csv", "py", "js", "ts", "java", "cpp", "c", "h", "go", "rs", "rb", "sh", "bat",
    "yaml", "yml", "json", "xml", "toml", "cfg", "ini", "conf", "log", "env", "lock",
)
LATEX_COMMANDS = (
    "mathbf", "mathcal", "frac", "sum", "prod", "sqrt", "alpha", "beta", "gamma", "delta", "epsilon", "varepsilon",
    "mathbb", "mathrm", "text",
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")

# Patterns that tell paths from other names.
URL_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
LATEX_DELIMITERS = r"(\\\(|\\\)|\\\[|\\\]|\$[^$]+\$)"
LETTER_PAIR = r"^[A-Za-z]/[A-Za-z]$"
WINDOWS_PATH = r"^[A-Za-z]:[\\/]"
UNC_PATH = r"^(?:\\\\|//)[^\\/\s]+[\\/][^\\/\s]+"
RELATIVE_PATH = r"^(?:\.{1,2}|~)[\\/]"
IMAGE_PATH_LINE = r"(?im)^\s*image path\s*:\s*(.+?)\s*$"

# Patterns of labels and noise, without regard to case.
LOCATOR_WITH_TITLE = (
    r"^(?:table|figure|fig|eq|equation|formula|section|sec|chapter|ch|appendix|app|page|p|ref|reference|footnote|fn)\.?\s*"
    r"(?:[A-Za-z]?\d+(?:\.\d+)*|[A-Za-z])\s*[:\-]\s*.+$"
)
BARE_LOCATOR = (
    r"^(?:table|figure|fig|eq|equation|formula|section|sec|chapter|ch|appendix|app|page|p|ref|reference|footnote|fn)\.?\s*"
    r"(?:[A-Za-z]?\d+(?:\.\d+)*|[A-Za-z])$"
)
REFERENCE_BRACKET = r"^(?:ref|reference)\s*\[\s*\d+\s*\]$"
TABLE_WITH_TITLE = r"^table\.?\s*(?:[A-Za-z]?\d+(?:\.\d+)*|[A-Za-z])\s*[:\-]\s*.+$"
FIGURE_WITH_TITLE = r"^(?:figure|fig)\.?\s*(?:[A-Za-z]?\d+(?:\.\d+)*|[A-Za-z])\s*[:\-]\s*.+$"
EQUATION_WITH_TITLE = r"^(?:eq|equation|formula)\.?\s*(?:[A-Za-z]?\d+(?:\.\d+)*|[A-Za-z])\s*[:\-]\s*.+$"
MODAL_SUFFIX = r"\s*\((?:table|image|equation)\)$"
IMAGE_STEM = r"^image(?:_|-)[a-z0-9]{4,}$"
PAGE_LABEL = r"^page\s+\d+$"
COORDINATE_LABEL = r"^coordinates?\s*\[[^\]]+\]$"
COORDINATE_BOX = r"\[\s*-?\d+(?:\.\d+)?\s*(?:,\s*-?\d+(?:\.\d+)?\s*){1,}\]"

# Repairs of a tuple delimiter, in order; (pattern, what replaces it is the delimiter itself).
DELIMITER_REPAIRS = (
    r"<\|#\|*?#\|>",
    r"<\|\\#\|>",
    r"<\|+>",
    r"<.?\|#\|.?>",
    r"<\|?#\|?>",
    r"<[^|]#\|>|<\|#[^|]>",
    r"<\|#\|+(?!>)",
    r"<\|#:(?!>)",
    r"<\|+#>",
    r"<\|\|(?!>)",
    r"(?<!<)\|#\|>",
    r"<\|#\|>\|",
    r"\|\|#\|\|",
)

# Where a section of a structured text starts.
SECTION_PATTERNS = (
    r"^#{1,6}\s+.+",
    r"^.+\n[=\-]{3,}\s*$",
    r"^(?:\d+(?:\.\d+)*[.)]?|[IVXLCM]+[.)])\s+[A-Z\u4e00-\u9fff][^\n]{2,100}$",
    r"^[A-Z][A-Z \-]{7,59}$",
)

# Marks in prompts.
CONTEXT_MARKER = "---Context---"
REFERENCE_MARKER = "Reference Document List (Each entry starts with a [reference_id] that corresponds to entries in the Document Chunks):"
EMPTY_INSTRUCTIONS = ("", "{user_prompt}", "none", "null", "n/a")
ANSWER_SUFFIXES = ("Please answer based on the context provided.", "Please answer based on the context and images provided.")
INSTRUCTIONS_LINE = r"(?i)^\s*(?:\d+\.\s*)?Additional Instructions:\s*"
QUERY_LINE = r"(?im)^\s*---User Query---\s*$"
STALE_LINES = (
    r"(?im)^\s*User (?:Question|Query)\s*:\s*.*$",
    r"(?im)^\s*Please answer based on the context(?: and images)? provided\.?\s*$",
    r"(?im)^\s*Please answer based on the provided context\.?\s*$",
)

# What stands for an answer about a block that names nothing.
UNNAMED_ENTITY, UNTYPED_ENTITY, SHORT_SUMMARY = "unknown_entity", "unknown", 100
