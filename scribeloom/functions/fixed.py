"""Names, word lists, patterns and texts that results depend on."""

# Categories in match order, and their default name prefixes.
CATEGORIES = ("CREATE", "READ", "UPDATE", "DELETE")
OTHER = "OTHER"
CREATE_PREFIXES = ("create", "add", "insert", "save", "new")
READ_PREFIXES = ("get", "query", "list", "find", "select", "count", "load")
UPDATE_PREFIXES = ("update", "set", "modify", "patch", "enable", "disable")
DELETE_PREFIXES = ("delete", "remove", "del", "clear")

# HTTP verb of a category.
VERBS = {"CREATE": "POST", "READ": "GET", "UPDATE": "PUT", "DELETE": "DELETE", "OTHER": "POST"}

# What makes a type worth showing next to a method.
TYPE_SUFFIXES = ("DTO", "VO")
PACKAGE_KEYWORDS = (".dto", ".vo", ".entity")
ANNOTATION_WHITELIST = ("Entity", "jakarta.persistence.Entity", "javax.persistence.Entity")

# Task states, their rank in a sorted list, and task scopes.
STATUSES = ("QUEUED", "RUNNING", "PARTIAL", "SUCCEEDED", "FAILED", "CANCELLED")
DONE_MESSAGE = "Done"
STATUS_RANK = {"QUEUED": 1, "RUNNING": 2, "PARTIAL": 3, "SUCCEEDED": 4, "FAILED": 5, "CANCELLED": 6}
UNKNOWN_RANK = 99
PENDING = ("QUEUED", "RUNNING", "PARTIAL")
SCOPES = ("METHOD", "CLASS")
CLASS_TASK = "CLASS"
RESUME_MESSAGE = "Auto-resume"

# Class paths left out of call graphs, as whole-path patterns.
EXCLUDED_PATHS = (
    r"java\/awt\/.*",
    r"javax\/swing\/.*",
    r"sun\/.*",
    r"com\/sun\/.*",
    r"org\/apache\/commons\/logging\/.*",
    r"org\/slf4j\/.*",
    r"ch\/qos\/logback\/.*",
    r"org\/apache\/log4j\/.*",
    r"org\/jetbrains\/.*",
)

# Headings of context texts.
ENTRY_METHOD = "# Entry Method"
METHOD_SOURCE = "# Method Source"
CALLGRAPH_SUMMARY = "# Callgraph Summary"
SLICES = "# Slices"
RELATED_TYPES = "# Related Types (DTO/VO/Entity/Enum)"
CALLED_METHODS = "# Called Methods / 被调方法"
ENTRY_CLASS = "# Entry Class"
CLASS_SOURCE = "# Class Source"
PUBLIC_METHODS = "# Public Methods"
DEFAULT_SUMMARY = "[stub] CG+Slice for "
TRUNCATED = "... [truncated]"
NUMBERED_LINE = "%6d | %s\n"

# Chat requests.
SYSTEM_MESSAGE = "You are a helpful assistant for Java API documentation. Answer in Chinese Markdown only."
ERROR_SNIPPET = 240
REPLY_ERROR = "RuntimeException"

# The placeholder document.
STUB_NAME = "接口名称："
STUB_NOTE = "接口说明：示例占位，由 Stub 生成（推断）"
STUB_VERB = "请求方式："
INFERRED = "（推断）"
STUB_TABLES = (
    "",
    "输入参数：",
    "",
    "|参数名|类型|是否必须|说明|",
    "|---|---|---|---|",
    "|param|Object|否|示例占位|",
    "",
    "输出参数：",
    "",
    "|参数名|类型|是否必须|说明|",
    "|---|---|---|---|",
    "|code|int|是|状态码|",
    "|message|String|是|提示信息|",
    "",
)
