"""Row rules as columns: each rule gives null, or an error (field, message)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Limits and the blocked expressions, searched anywhere and in any case.
MAX_STRING, MAX_ARRAY, MAX_FEATURE_STRING, FEATURE_BOUND = 1000, 10_000, 100, 1e10
MIN_TRAINING_ROWS, MAX_TRAINING_ROWS, MAX_ML_ROWS = 10, 100_000, 10_000
MAX_IDENTIFIER = 200
IDENTIFIER = r"^[A-Za-z0-9 ._:-]+$"
BLOCKED = (
    r"import\s+os", r"import\s+subprocess", r"import\s+sys", r"__import__", r"exec\s*\(", r"eval\s*\(",
    r"compile\s*\(", r"\.\./|\.\.\\", r"/etc/|/proc/|/dev/", r"<script", r"javascript:",
)
# Characters and their HTML entities, the ampersand first.
ENTITIES = (
    ("&", "&amp;"), ('"', "&quot;"), ("'", "&#x27;"), ("<", "&lt;"), (">", "&gt;"),
    ("/", "&#x2F;"), ("\\", "&#x5C;"), ("`", "&#96;"),
)

Rule = Callable[[Column, str], Column]


def error(field: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), text.alias("message"))


def _first(x: Column, field: str, required: bool, *tests: tuple[Column, str]) -> Column:
    """First failing test as the error; a missing value fails only when required."""
    out = F.when(x.isNull(), error(field, "is required") if required else F.lit(None))
    for failed, message in tests:
        out = out.when(F.coalesce(failed, F.lit(False)), error(field, message))
    return out


def present(x: Column, field: str) -> Column:
    return _first(x, field, True)


def blocked(x: Column) -> Column:
    """Any blocked expression in the whole text."""
    return x.rlike("(?i)" + "|".join(f"(?:{p})" for p in BLOCKED))


def string(min_length: int = 0, max_length: int = MAX_STRING, pattern: str | None = None, required: bool = True) -> Rule:
    def rule(x: Column, field: str) -> Column:
        tests = [
            (F.length(x) < min_length, f"must be at least {min_length} characters"),
            (F.length(x) > max_length, f"exceeds maximum length of {max_length} characters"),
        ]
        if pattern:
            tests.append((~x.rlike(f"^(?:{pattern})"), "does not match required pattern"))
        return _first(x, field, required, *tests, (blocked(x), "blocked pattern detected"))

    return rule


def number(low: float | None = None, high: float | None = None, required: bool = True, whole: bool = False) -> Rule:
    """Castable and not NaN; an infinity passes unless bounded. ``whole`` truncates first."""

    def rule(x: Column, field: str) -> Column:
        v = x.try_cast("double")
        if whole:
            v = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")
        tests = [(v.isNull(), "must be a number"), (F.isnan(v), "must be a finite number")]
        if low is not None:
            tests.append((v < low, f"must be at least {low:g}"))
        if high is not None:
            tests.append((v > high, f"must be at most {high:g}"))
        return _first(x, field, required, *tests)

    return rule


def array(min_length: int = 0, max_length: int = MAX_ARRAY, item: Callable[[Column], Column] | None = None, required: bool = True) -> Rule:
    """Length bounds, and a test every item has to pass."""

    def rule(x: Column, field: str) -> Column:
        tests = [
            (F.size(x) < min_length, f"must have at least {min_length} items"),
            (F.size(x) > max_length, f"exceeds maximum length of {max_length} items"),
        ]
        if item is not None:
            tests.append((~F.forall(x, item), "has an invalid item"))
        return _first(x, field, required, *tests)

    return rule


def one_of(allowed: Sequence, required: bool = True) -> Rule:
    text = ", ".join(map(str, allowed))
    return lambda x, field: _first(x, field, required, (~x.isin(*allowed), f"must be one of: {text}"))


def identifier(x: Column, field: str) -> Column:
    missing = x.isNull() | (x == "")
    bad = (F.length(x) > MAX_IDENTIFIER) | ~x.rlike(IDENTIFIER)
    return F.when(missing, error(field, "is required")).when(bad, error(field, "is not a valid identifier"))


def byte_cap(most: int) -> Rule:
    return lambda x, field: _first(x, field, False, (F.octet_length(x) > most, f"exceeds {most} bytes"))


def json_kind(x: Column, path: str) -> Column:
    """JSON type of the value at a path (BOOLEAN, BIGINT, STRING, ...), null if absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), path, "variant"))


def strict_boolean(path: str, required: bool = True) -> Rule:
    """The JSON value at the path is a boolean, not a number or text that looks like one."""

    def rule(x: Column, field: str) -> Column:
        kind = json_kind(x, path)
        absent = kind.isNull() | (kind == "VOID")
        return F.when(absent, error(field, "is required") if required else F.lit(None)).when(
            kind != "BOOLEAN", error(field, "must be a boolean")
        )

    return rule


def json_object(required: Mapping[str, Rule], optional: Mapping[str, Rule] | None = None) -> Callable[[Column, str], Column]:
    """First error of a JSON object against per-key rules on the text of each value."""
    optional = optional or {}

    def rule(x: Column, field: str) -> Column:
        values = F.from_json(x, "map<string,string>")
        found = [F.when(values.isNull(), error(field, "must be an object"))]
        for key, check in required.items():
            found.append(F.when(~F.map_contains_key(values, key), error(f"{field}.{key}", "is missing")))
            found.append(F.when(F.map_contains_key(values, key), check(values[key], f"{field}.{key}")))
        for key, check in optional.items():
            found.append(F.when(F.map_contains_key(values, key), check(values[key], f"{field}.{key}")))
        return F.coalesce(*found)

    return rule


def known_keys(values: Column, keys: Sequence[str]) -> Column:
    """A map without the keys outside the schema."""
    return F.map_filter(values, lambda k, v: k.isin(*keys))


def feature_map_errors(x: Column) -> Column:
    """Errors of a JSON feature object: bounded numbers, short text, booleans; nothing else."""
    entries = F.map_entries(F.from_json(x, "map<string,variant>"))

    def entry_error(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        v = F.try_variant_get(e["value"], "$", "double")
        text = F.try_variant_get(e["value"], "$", "string")
        numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
        message = (
            F.when(blocked(e["key"]), F.lit("blocked pattern detected"))
            .when(numeric & (F.abs(v) > FEATURE_BOUND), F.lit("out of bounds"))
            .when(numeric | (kind == "BOOLEAN"), F.lit(None))
            .when((kind == "STRING") & (F.length(text) > MAX_FEATURE_STRING), F.lit("text too long"))
            .when((kind == "STRING") & blocked(text), F.lit("blocked pattern detected"))
            .when(kind == "STRING", F.lit(None))
            .otherwise(F.lit("unsupported type"))
        )
        return F.struct(e["key"].alias("field"), message.alias("message"))

    return F.filter(F.transform(entries, entry_error), lambda r: r["message"].isNotNull())


def escape_html(x: Column) -> Column:
    for char, entity in ENTITIES:
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def finite_or_zero(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def sanitise(df: DataFrame) -> DataFrame:
    """HTML-escaped text and finite numbers in every column, arrays included."""
    from pyspark.sql import types as T

    out = {}
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.StringType):
            out[f.name] = escape_html(c)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out[f.name] = finite_or_zero(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out[f.name] = F.transform(c, escape_html)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.transform(c, finite_or_zero)
    return df.withColumns(out) if out else df


def parse_json(df: DataFrame, column: str, value: str = "value", failure: str = "parse_error") -> DataFrame:
    """Parsed value, and the failure text where the column is not valid JSON."""
    parsed = F.try_parse_json(F.col(column))
    return df.withColumns(
        {value: parsed, failure: F.when(F.col(column).isNotNull() & parsed.isNull(), F.lit("Invalid JSON"))}
    )


def check_rows(df: DataFrame, rules: Sequence[tuple[str, Column, Rule]]) -> DataFrame:
    """Add ``errors``: the error of every failing rule, at most one per field rule."""
    found = [rule(x, field) for field, x, rule in rules]
    return df.withColumn("errors", F.array_compact(F.array(*found)))


def split_rows(df: DataFrame, rules: Sequence[tuple[str, Column, Rule]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors)."""
    checked = check_rows(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def training_size(df: DataFrame, low: int = MIN_TRAINING_ROWS, high: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Row count with the verdicts of the training and the request size rules."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.col("n").between(low, high).alias("trainable"), (F.col("n") <= MAX_ML_ROWS).alias("within_request_cap")
    )
