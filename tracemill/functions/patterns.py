"""Regular expressions, word lists and tables that decide results (Java syntax)."""

# Line formats.
JSON_LINE = r"^\s*\{.*\}\s*$"
JSON_OPEN = r"^\s*(?:\{\s*(?:[\"}]|$)|\[\s*(?:[\[{\"\]tfn]|-?\d+\s*[,\]]|$))"
XML_TAG = r"^\s*<[\w!?][^>]*>\s*$"
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
SYSLOG_START = r"(?i)^(?:<\d{1,3}>)?" + MONTHS + r"\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+"
SYSLOG = r"(?i)^(?:<(\d{1,3})>)?(" + MONTHS + r"\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.\-/]+)(?:\[(\d+)\])?:\s*(.*)$"
ACCESS_START = r"^\S+\s+\S+\s+\S+\s+\[.+?\]\s+\".+?\"\s+\d{3}\s+\d+"
ACCESS = r"^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+\"([^\"]*)\"\s+(\d{3})\s+(\S+)(?:\s+\"([^\"]*)\"\s+\"([^\"]*)\")?"
LOGFMT_LINE = r"^(?:\w[\w.\-]*=(?:\"[^\"]*\"|\S+)\s*){2,}"
KEY_VALUE_LINE = r"(?:\w[\w.\-]*\s*[:=]\s*(?:\"[^\"]*\"|\S+)\s*){2,}"
LOGFMT_PAIR = r"(\w[\w.\-]*)=(\"[^\"]*\"|\S+)"
KEY_VALUE_PAIR = r"(\w[\w.\-]*)\s*[:=]\s*(\"[^\"]*\"|\S+)"
HEX_DUMP_START = r"^[0-9A-Fa-f]{4,8}\s+(?:[0-9A-Fa-f]{2}\s){4,}"
HEX_DUMP = r"^\s*[0-9a-fA-F]{4,8}[\s:]*((?:\s+[0-9a-fA-F]{2})+)(?:\s+\|[^|]*\|)?$"
HEX_GUTTER = r"\|([^|]+)\|\s*$"
CONTINUOUS_HEX = r"^[0-9A-Fa-f]{16,}$"
SECTION_HEADER = r"^---\s+.+\s+---\s*$"
SECTION_NAME = r"^---\s+(.+?)\s+---\s*$"
CONTINUATION = r"^(?:\s+at\s|Caused by:|\.{3}\s*\d+\s*more|\s{4,}\S|\t\S)"
PRINTABLE_RUN = r"[\x20-\x7e]{4,}"
EVENT_NAME = r"^([A-Z][A-Z0-9_]+)\s*:\s*(.*)$"

# Things inside a line.
ISO_TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
ANY_TIMESTAMP = r"(?i)(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|" + MONTHS + r"\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
LEVEL_WORD = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|NOTICE|ALERT|EMERG(?:ENCY)?)\b"
LEVEL_HINT = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
NUMBER = r"^[+-]?\d+(?:\.\d+)?$"

# What a template puts in place of variable parts, in this order.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
HEX = r"\b[0-9A-Fa-f]{8,}\b"
QUOTED = r"\"[^\"]*\"|'[^']*'"
NUM = r"\b\d+(?:\.\d+)?\b"

# Attack patterns, on lower-cased text.
SQL_INJECTION = r"(?:'\s+or\s+1=1|union\s+select|drop\s+table)"
SCRIPT_INJECTION = r"(?:<script|javascript:|onerror=)"
SHELL_INJECTION = r"(?:\$\(|`.+`|\|\s*sh\b)"

# Levels.
SEVERITY = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")
ERROR_LEVELS = ("ERROR", "FATAL", "CRITICAL", "ALERT", "EMERGENCY")
NULL_WORDS = ("null", "none", "nan", "n/a")
STATUS_WORDS = ("pass", "warn", "warning", "fail", "error", "ok")

# First bytes (hex) of binary formats.
MAGIC = (
    ("504B0304", "zip"),
    ("1F8B08", "gzip"),
    ("789C", "zlib"),
    ("7801", "zlib"),
    ("78DA", "zlib"),
    ("425A68", "bzip2"),
    ("FD377A585A00", "xz"),
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("25504446", "pdf"),
    ("7F454C46", "elf"),
    ("4D5A", "pe_executable"),
)

# Files with these extensions are decoded as binary.
BINARY_EXTENSIONS = ("bin", "dat", "blob", "logbin", "evtx", "pcap", "pcapng", "db", "sqlite", "parquet", "avro", "orc", "pb", "msgpack", "bson")
