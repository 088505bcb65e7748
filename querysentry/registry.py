"""Names and constants shared by every operator, kept in one place.

The values in this module are fixed values: results only agree with existing
data sets, trained models and reports if they stay exactly as written.
"""

from __future__ import annotations

# --- Fixed values: serialised trees -----------------------------------------
TREE_SEPARATOR = "||-||"
EMPTY_TREE = "||-||"
NODE_FIELDS = 6
MIN_RULE_KIND = 832
MAX_RULE_KIND = 1844

# --- Fixed values: input columns --------------------------------------------
STATEMENT_COLUMNS = [
    "full_query",
    "label",
    "user_inputs",
    "attack_stage",
    "tamper_method",
    "attack_status",
    "statement_type",
    "query_template_id",
    "attack_id",
    "attack_technique",
    "split",
]

LOG_COLUMNS = [
    "query_id",
    "n_terminal",
    "n_nonterminal",
    "is_syntax_error",
    "semantic_tree",
    "depth",
]

METADATA_COLUMNS = [
    "label",
    "full_query",
    "statement_type",
    "query_template_id",
    "user_inputs",
    "attack_id",
    "attack_technique",
    "split",
    "attack_status",
    "attack_stage",
    "tamper_method",
    "template_split",
]

SPLITS = ["train", "test", "val"]

# --- Fixed values: tag vocabularies (family, ordered tags) --------------------
ACTIONS = ["CREATE", "DELETE", "MODIFY", "EXECUTE", "READ"]
ACTION_BLANK = "A_NONE"

OBJECTS = [
    "TABLESPACE",
    "TABLE",
    "INDEX",
    "VIEW",
    "USER",
    "PROCEDURE",
    "DATABASE",
    "FUNCTION",
    "INSTANCE",
    "LOGFILE",
    "SERVER",
    "TRIGGER",
]
OBJECT_BLANK = "O_NONE"

CONSTANT_OBJECTS = [
    "TABLESPACE",
    "TRIGGER",
    "USER",
    "VIEW",
    "SERVER",
    "INSTANCE",
    "LOGFILE",
]

TAG_VOCABULARIES = {
    "chatgpt": [
        "DDL_ALTER",
        "DDL_CREATE",
        "DDL_DROP",
        "DML_DELETE_TRUNCATE",
        "DML_INSERT_REPLACE",
        "DML_MAINTENANCE",
        "DML_SELECT",
        "DML_UPDATE",
        "EXPRESSION_LOGIC",
        "PARTITIONING_STORAGE",
        "PRIVILEGES_SECURITY",
        "PROCEDURAL_LOGIC",
        "REPLICATION_MANAGEMENT",
        "SERVER_ADMIN",
        "SHOW_DESCRIBE_EXPLAIN",
        "STATEMENT_CONTROL",
        "STATEMENT_HELP",
        "STATEMENT_MANAGEMENT",
        "TRANSACTION_CONTROL",
        "WINDOW_ANALYTICS",
    ],
    "claude": [
        "ADMINISTRATIVE",
        "CLAUSE_COMPONENT",
        "CONSTRAINT_DEFINITION",
        "DATA_IMPORT_EXPORT",
        "DATA_TYPE",
        "DDL_STATEMENT",
        "DML_STATEMENT",
        "ENTRY_POINT",
        "EXPRESSION",
        "FUNCTION_CALL",
        "IDENTIFIER",
        "LITERAL_VALUE",
        "OPTIONAL_MODIFIER",
        "QUERY_STRUCTURE",
        "REPLICATION_CLUSTER",
        "STORED_PROCEDURE",
        "SYNTAX_ELEMENT",
        "TABLE_REFERENCE",
        "TRANSACTION_CONTROL",
        "USER_MANAGEMENT",
    ],
    "llama": [
        "DCL",
        "DDL",
        "DML",
        "Database",
        "Event",
        "Function",
        "Indexing",
        "Locking",
        "Procedure",
        "Query",
        "Role",
        "Security",
        "Server",
        "Table",
        "Tablespace",
        "Transaction",
        "Trigger",
        "User",
        "Utility",
        "View",
    ],
    "gpt-oss": [
        "Clause-Modifier",
        "Constraint",
        "DDL-Statement",
        "DML-Statement",
        "Data-Type",
        "Event-Scheduling",
        "Expression",
        "Identifier",
        "Index-Definition",
        "Join-Clause",
        "Literal",
        "Options-List",
        "Partition-Clause",
        "Predicate",
        "Privilege-Control",
        "Replication-Control",
        "Stored-Program",
        "Transaction-Control",
        "Utility-Statement",
        "Window-Function",
    ],
    "mistral": [
        "Data Definition",
        "Data Import/Export",
        "Data Manipulation",
        "Data Query",
        "Database Management",
        "Locking & Concurrency",
        "Miscellaneous Operations",
        "Replication & Clustering",
        "Resource Management",
        "Security & Privileges",
        "Statement Control",
        "Stored Procedures & Functions",
        "System Information",
        "System Maintenance",
        "System Variables",
        "Temporary Objects",
        "Transaction Control",
        "Triggers & Events",
        "User Management",
        "Views",
    ],
}

# --- Fixed values: feature names, in training order ----------------------------
SYNTACTIC = ["n_terminal", "n_nonterminal", "is_syntax_error", "depth", "n_parser_invoc"]

KEYWORD_STATS = ["avg_c_sqlkywds", "max_c_sqlkywds", "min_c_sqlkywds"]

LEXICAL = [
    "len_query",
    "has_null",
    "has_comment",
    "has_query_keywords",
    "has_union",
    "has_database_keywords",
    "has_connection_keywords",
    "has_file_keywords",
    "has_exec",
    "has_string_functions",
    "c_comparison",
    "has_exist_keyword",
    "has_floor",
    "has_rand",
    "has_group",
    "has_order",
    "has_length",
    "has_ascii",
    "has_concat",
    "has_if",
    "has_count",
    "has_sleep",
    "has_tautology",
    "c_num",
    "c_upper",
    "c_space",
    "c_special",
    "c_arith",
    "c_square_brackets",
    "c_round_brackets",
    "has_multiline_comment",
    "c_curly_brackets",
]

# --- Fixed values: word lists of the lexical features --------------------------
WORD_FLAGS = {
    "has_null": "null",
    "has_union": "union",
    "has_exec": "exec",
    "has_exist_keyword": "exists",
    "has_floor": "floor",
    "has_rand": "rand",
    "has_group": "group",
    "has_order": "order",
    "has_length": "length",
    "has_ascii": "ascii",
    "has_concat": "concat",
    "has_if": "if",
    "has_count": "count",
    "has_sleep": "sleep",
}
WORD_SET_FLAGS = {
    "has_query_keywords": ["select", "update", "drop", "insert", "create"],
    "has_string_functions": ["substr", "substring", "mid", "asc"],
}
SUBSTRING_FLAGS = {
    "has_database_keywords": ["sysobjects", "msysobjects", "version", "information_schema"],
    "has_connection_keywords": ["inner join", "and", "or", "xor"],
    "has_file_keywords": ["load_file", "infile", "outfile", "dumpfile"],
}
COMPARISON_OPERATORS = ["=", "<", ">", "<=", ">=", "<>", "!="]

# --- Fixed values: server error codes that still leave a usable trace -----------
TRACEABLE_ERRORS = [
    1044, 1048, 1049, 1054, 1062, 1064, 1093, 1094, 1105, 1109, 1136, 1140, 1142,
    1146, 1193, 1222, 1227, 1241, 1242, 1248, 1264, 1265, 1288, 1292, 1305, 1317,
    1327, 1364, 1366, 1370, 1406, 1451, 1452, 1525, 1582, 1584, 1630, 1690, 1772,
    2014, 3024, 3141, 3691, 3980, 3995,
]

# --- Fixed values: hyper-parameters ---------------------------------------------
MAX_FALSE_POSITIVE_RATE = 0.001
CONFIDENCE_Z = 1.96
SVM_NU = 0.05
AE_LEARNING_RATE = 0.001
AE_EPOCHS = 100
AE_BATCH = 4096
LOF_NEIGHBOURS = 20
LOF_OFFSET = -1.5

# --- Default keyword lexicon ------------------------------------------------------
# The common statement, clause and function words. The complete word list of a
# server version is a parameter: see sources.dimensions.keyword_lexicon, which
# reads one-word-per-line exports of the server's own keyword and function tables.
CORE_KEYWORDS = [
    "ADD", "ALL", "ALTER", "ANALYZE", "AND", "AS", "ASC", "BEFORE", "BETWEEN", "BIGINT",
    "BINARY", "BLOB", "BY", "CALL", "CASCADE", "CASE", "CHANGE", "CHAR", "CHARACTER",
    "CHECK", "COLLATE", "COLUMN", "CONSTRAINT", "CONVERT", "CREATE", "CROSS",
    "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "CURRENT_USER", "DATABASE",
    "DATABASES", "DECIMAL", "DECLARE", "DEFAULT", "DELETE", "DESC", "DESCRIBE", "DISTINCT",
    "DIV", "DOUBLE", "DROP", "DUAL", "ELSE", "EXCEPT", "EXISTS", "EXPLAIN", "FALSE",
    "FETCH", "FLOAT", "FOR", "FOREIGN", "FROM", "FUNCTION", "GRANT", "GROUP", "HAVING",
    "IF", "IGNORE", "IN", "INDEX", "INFILE", "INNER", "INSERT", "INT", "INTEGER",
    "INTERSECT", "INTERVAL", "INTO", "IS", "JOIN", "KEY", "KEYS", "KILL", "LEFT", "LIKE",
    "LIMIT", "LINES", "LOAD", "LOCK", "LONG", "MATCH", "MOD", "NATURAL", "NOT", "NULL",
    "NUMERIC", "OF", "ON", "OPTION", "OR", "ORDER", "OUT", "OUTER", "OUTFILE", "OVER",
    "PARTITION", "PRIMARY", "PROCEDURE", "RANGE", "RANK", "READ", "REGEXP", "RENAME",
    "REPEAT", "REPLACE", "RETURN", "REVOKE", "RIGHT", "RLIKE", "ROW", "ROWS", "SCHEMA",
    "SCHEMAS", "SELECT", "SET", "SHOW", "SQL", "TABLE", "THEN", "TO", "TRIGGER", "TRUE",
    "UNION", "UNIQUE", "UPDATE", "USAGE", "USE", "USING", "VALUES", "VARCHAR", "WHEN",
    "WHERE", "WHILE", "WINDOW", "WITH", "WRITE", "XOR",
]
CORE_FUNCTIONS = [
    "ABS", "ASCII", "AVG", "BENCHMARK", "CAST", "CEIL", "CHAR_LENGTH", "COALESCE",
    "CONCAT", "CONCAT_WS", "COUNT", "DATE", "DAY", "EXTRACT", "ExtractValue", "FLOOR",
    "GREATEST", "GROUP_CONCAT", "HEX", "HOUR", "IFNULL", "INSTR", "LEAST", "LENGTH",
    "LOAD_FILE", "LOCATE", "LOWER", "MAX", "MD5", "MEMBER OF", "MID", "MIN", "!",
    "NOT BETWEEN", "NOT EXISTS", "NOT IN", "NOT LIKE", "NOT REGEXP", "NOW", "ORD",
    "RAND", "ROUND", "SLEEP", "SOUNDS LIKE", "SUBSTR", "SUBSTRING", "SUM", "TIME",
    "TRIM", "UpdateXML", "UPPER", "USER", "VERSION",
]

VOCABULARIES = ["expert", *TAG_VOCABULARIES]
MODES = ["expert", "expert-no-const", "ruleid", *TAG_VOCABULARIES]


def kind_columns() -> list[str]:
    """Names of the grammar-rule count columns, one per rule number."""
    return [f"kind_{kind}" for kind in range(MIN_RULE_KIND, MAX_RULE_KIND + 1)]


def tag_columns(mode: str) -> list[str]:
    """Semantic tag columns a mode trains on; rule-id mode has none."""
    if mode == "expert":
        return ACTIONS + OBJECTS
    if mode == "expert-no-const":
        return ACTIONS + [o for o in OBJECTS if o not in CONSTANT_OBJECTS]
    if mode == "ruleid":
        return []
    if mode in TAG_VOCABULARIES:
        return list(TAG_VOCABULARIES[mode])
    raise ValueError(f"Unknown mode: {mode}")


def vocabulary_of(mode: str) -> str:
    """Vocabulary whose tags a mode counts."""
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    return mode if mode in TAG_VOCABULARIES else "expert"


def vocabulary_tags(vocabulary: str) -> list[tuple[str, str]]:
    """Ordered (family, tag) pairs of a vocabulary, blank markers included."""
    if vocabulary == "expert":
        return [("action", t) for t in ACTIONS + [ACTION_BLANK]] + [
            ("object", t) for t in OBJECTS + [OBJECT_BLANK]
        ]
    if vocabulary in TAG_VOCABULARIES:
        return [("tag", t) for t in TAG_VOCABULARIES[vocabulary]]
    raise ValueError(f"Unknown vocabulary: {vocabulary}")


def feature_order(mode: str, lexical: bool = False) -> list[str]:
    """The training order of a mode's numeric columns.

    Rule-id mode ends with one column per rule number.
    """
    names = SYNTACTIC + tag_columns(mode) + KEYWORD_STATS
    if mode == "ruleid":
        names = names + kind_columns()
    return names + (LEXICAL if lexical else [])
