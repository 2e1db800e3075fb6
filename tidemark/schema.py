"""Record schemas, the header registry and fixed values of the catalog model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column roles of every known table header, oldest first.
HEADERS: dict[str, tuple[str, ...]] = {
    "| Company OA | Last Updated Time |": ("company_and_question", "updated"),
    "| Company | OA Question | Last Updated Time |": ("company", "question", "updated"),
    "| Company | OA Question | Practice (Beta) | Last Updated Time |": ("company", "question", "practice", "updated"),
    "| Company | OA Question | Practice (Beta) | Uploaded Time |": ("company", "question", "practice", "updated"),
    "| Company | OA Question | Practice (Beta) | Updated Time |": ("company", "question", "practice", "updated"),
    "| Company | OA Question | Practice | Updated Time |": ("company", "question", "practice", "updated"),
    "| Company | OA Question | Practice | Updated |": ("company", "question", "practice", "updated"),
    "| Company | OA / Interview Question | Practice | Updated |": ("company", "question", "practice", "updated"),
    "| Company | OA / Interview Question | Practice format | Practice | Updated |": ("company", "question", "format", "practice", "updated"),
    "| Company | OA / Interview Question | Format | Practice | Updated |": ("company", "question", "format", "practice", "updated"),
}
# Format labels, formats by the key's first segment, and cells that mean "no company".
FORMATS = ("Coding", "SQL", "System design", "Low-level design", "AI coding")
ROUTES = {"problems": "Coding", "system-design": "System design", "low-level-design": "Low-level design", "project-coding": "AI coding"}
SENTINELS = ("unattributed", "unknown company")
# Change kinds and overlay statuses, in order; formats that can have an origin.
KINDS = ("added", "removed", "retitled", "relinked", "recompanied")
STATUSES = ("todo", "attempted", "solved", "revisit")
ELIGIBLE = ("Coding", "SQL")
# Words that title fingerprints drop, expand and strip.
STOPWORDS = ("a", "an", "the", "of", "in", "to", "with", "for")
ABBREVIATIONS = {"min": "minimum", "max": "maximum", "num": "number", "len": "length", "str": "string", "arr": "array", "char": "character", "dup": "duplicate", "avg": "average", "freq": "frequency"}
LEADING_VERBS = ("get", "find", "implement", "is", "compute", "calculate", "return", "determine")
DIFFICULTY = {1: "Easy", 2: "Medium", 3: "Hard"}

RETENTION_DAYS = 180
ROW_DROP_LIMIT = 0.10
DIVERGENCE_FLOOR, DIVERGENCE_FRACTION = 25, 0.01
MIN_PREFIX = 3

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in fields.split())])


RAW_ROW = _struct("company_cell:string title:string url:string format:string updated:string source:string source_ord:int line_no:int")
PROBLEM = _struct(
    "id:string key:string title:string url:string companies:strings format:string upstream_updated:string first_seen:string "
    "last_seen:string state:string removed_on:string aliases:strings sources:strings"
)
PERSONAL = _struct("id:string status:string difficulty:int notes:string solution_url:string tags:strings updated_at:string migrated_from:string")
ORIGIN = _struct("id:string site:string url:string title:string difficulty:string paid:boolean")
POSTING = _struct("id:string token:string")
PREFIX = _struct("prefix:string token:string")
_STATE = _struct("title:string companies:strings url:string key:string")
CHANGE = T.StructType([*_struct("kind:string id:string key:string title:string").fields, T.StructField("before", _STATE), T.StructField("after", _STATE), *_struct("previous_id:string previous_key:string").fields])
_ENTRY = T.StructType(
    [
        T.StructField("stat", _struct("question__title:string question__title_slug:string")),
        T.StructField("difficulty", _struct("level:int")),
        T.StructField("paid_only", T.BooleanType()),
    ]
)
CATALOGUE = T.StructType([T.StructField("stat_status_pairs", T.ArrayType(_ENTRY))])
