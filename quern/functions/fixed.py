"""Word lists, limits and texts that results must show exactly."""

# -- row limits -------------------------------------------------------------
RESULT_ROWS = 1000  # 5000 in production: pass max_rows
PREVIEW_ROWS = 100
EXPORT_ROWS = 10_000
PAGE_SIZE = 20

# -- statement rules --------------------------------------------------------
TOKEN_WORDS = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE", "GRANT", "REVOKE")
SUBSTRING_WORDS = ("DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE")
STRICT_WORDS = ("DROP", "DELETE", "UPDATE", "INSERT", "TRUNCATE", "ALTER")
INJECTION_PATTERNS = ("--", "/*", "*/", ";--", "' OR '1'='1")

SQL_EMPTY = "SQL不能为空"
WORD_ERROR = ("不允许使用 ", " 操作")
INJECTION_ERROR = "检测到潜在的SQL注入风险: "
USER_MISSING = "用户ID缺失"

# -- question checks --------------------------------------------------------
QUESTION_MAX_CHARS = 1000
QUESTION_EMPTY = "用户问题不能为空"
QUESTION_TOO_LONG = "问题描述过长，请控制在1000字符以内"
QUESTION_BAD_USER = "无效的用户ID"

# -- workflow progress per finished step -----------------------------------
STEP_PROGRESS = {
    "input_validation": 10,
    "sql_generation": 40,
    "sql_validation": 60,
    "sql_execution": 80,
    "result_processing": 100,
    "error_handling": 0,
}

# -- hints for failed questions --------------------------------------------
ERROR_HINTS = {
    "语法": ("请检查您的问题描述是否清晰明确", "尝试使用更简单的表达方式"),
    "权限": ("您可能没有访问相关数据的权限", "请联系管理员获取必要的权限"),
    "超时": ("查询可能涉及大量数据，请尝试缩小查询范围", "添加时间范围或其他过滤条件"),
}
DEFAULT_HINTS = ("请尝试重新描述您的查询需求", "或联系技术支持获取帮助")

# -- error codes ------------------------------------------------------------
ERROR_CODES = {
    400001: "参数验证失败",
    400002: "业务逻辑错误",
    401001: "认证失败",
    403001: "权限不足",
    404001: "资源未找到",
    429001: "请求频率限制",
    500000: "服务器内部错误",
    500001: "数据库错误",
    500002: "查询引擎错误",
    500003: "LLM服务错误",
    500004: "向量数据库错误",
    500005: "查询处理错误",
    500006: "配置错误",
    502001: "外部服务错误",
}
UNKNOWN_ERROR = "未知错误"

# -- column types in generated table definitions ----------------------------
DDL_TYPES = {
    "string": "VARCHAR(255)",
    "integer": "INT",
    "decimal": "DECIMAL(10,2)",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "datetime": "DATETIME",
    "text": "TEXT",
}
DDL_DEFAULT_TYPE = "VARCHAR(255)"
NO_DESCRIPTION = "无描述"

# -- domains of metadata columns --------------------------------------------
FIELD_TYPES = (
    "string", "integer", "float", "decimal", "boolean", "date", "datetime", "time", "text", "json", "array",
)
MASKING_KINDS = ("none", "mask", "encrypt", "hash", "replace")
TERM_TYPES = ("admin", "user")
UPDATE_METHODS = ("real_time", "daily", "weekly", "monthly", "manual")

# -- task states ------------------------------------------------------------
# running and success are the task table's words for processing and completed
SAME_STATES = (("running", "processing"), ("success", "completed"))
ACTIVE_STATES = ("pending", "running", "processing")
EXPIRABLE_STATES = ("success", "completed", "failed", "cancelled")
FINAL_STATES = ("success", "completed", "failed", "cancelled", "timeout")

# -- question routing: first matching key word decides ----------------------
ROUTES = (("销售", "sales_orders"), ("订单", "sales_orders"), ("用户", "users"))
ROUTE_OTHER = "other"
