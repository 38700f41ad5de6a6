"""Normalisation of raw requests: routes, errors, users, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions import events as ev
from lumenlog.functions.text import let

# --- fixed values -------------------------------------------------------------
HTTP_CODES = {
    400: "BAD_REQUEST",
    401: "UNAUTHORIZED",
    403: "FORBIDDEN",
    404: "NOT_FOUND",
    409: "CONFLICT",
    422: "VALIDATION_ERROR",
    429: "RATE_LIMITED",
    500: "INTERNAL_ERROR",
    502: "BAD_GATEWAY",
    503: "SERVICE_UNAVAILABLE",
    504: "GATEWAY_TIMEOUT",
}
DEFAULT_REDACT_PATHS = [
    "body.password",
    "body.currentPassword",
    "body.newPassword",
    "body.confirmPassword",
    "body.secret",
    "body.apiKey",
    "body.token",
    "body.accessToken",
    "body.refreshToken",
    "body.cardNumber",
    "body.cvv",
    "body.ssn",
    "headers.authorization",
    "headers.cookie",
    "headers.x-api-key",
]
REDACTED = "[REDACTED]"
MAX_MESSAGE = 200
# --- end of fixed values ------------------------------------------------------


# --- routes -------------------------------------------------------------------
def _rooted(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def canonical_route(method: Column, path: Column, template: Column | None = None, base_path: str = "") -> Column:
    """``METHOD /path``: template preferred, query string dropped, base path added once."""
    actual = F.substring_index(path, "?", 1)
    chosen = actual if template is None else F.coalesce(F.nullif(template, F.lit("")), actual)
    full = _rooted(chosen)
    if base_path:
        base = base_path.removesuffix("/")
        full = F.when(F.startswith(chosen, F.lit(base)), full).otherwise(F.concat(F.lit(base), full))
    return F.concat(F.upper(method), F.lit(" "), full)


# --- errors -------------------------------------------------------------------
def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _json_text(raw: Column, field: str) -> Column:
    """Field of a JSON object as text; arrays become their items joined by commas."""
    value = F.get_json_object(raw, f"$.{field}")
    items = F.array_join(F.from_json(value, "array<string>"), ",")
    return _filled(F.when(F.startswith(value, F.lit("[")), items).otherwise(value))


def _is_object(raw: Column) -> Column:
    return F.startswith(F.ltrim(raw), F.lit("{"))


def _is_array(raw: Column) -> Column:
    return F.startswith(F.ltrim(raw), F.lit("["))


def http_code(status: Column) -> Column:
    names = {k: v for k, v in HTTP_CODES.items()}
    return ev.lookup(status, names, F.concat(F.lit("HTTP_"), status.cast("string")))


def error_code(raw: Column, status: Column) -> Column:
    """Stable code of an error response (JSON text).

    A structured body gives its first filled code field, else the bare status; any
    other body gives the name of the status.
    """
    fields = [_json_text(raw, f) for f in ("errorCode", "code", "error", "statusCode")]
    return (
        F.when(_is_object(raw), F.coalesce(*fields, status.cast("string")))
        .when(_is_array(raw), status.cast("string"))
        .otherwise(http_code(status))
    )


def truncate_message(message: Column) -> Column:
    return F.when(
        F.length(message) > MAX_MESSAGE, F.concat(F.substring(message, 1, MAX_MESSAGE - 3), F.lit("..."))
    ).otherwise(message)


def error_message(raw: Column, fallback: Column) -> Column:
    """Short message of an error response, at most 200 characters."""
    items = F.from_json(raw, "array<string>")
    extra = F.size(items) - 3
    listed = F.concat(
        F.array_join(F.slice(items, 1, 3), "; "),
        F.when(extra > 0, F.concat(F.lit("... (+"), extra.cast("string"), F.lit(" more)"))).otherwise(""),
    )
    structured = F.coalesce(*[_json_text(raw, f) for f in ("errorMessage", "message", "error")], fallback)
    # A bare JSON string is decoded as the only item of a list.
    plain = F.element_at(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 1)
    text = (
        F.when(raw.isNull(), fallback)
        .when(_is_array(raw), listed)
        .when(_is_object(raw), structured)
        .when(F.startswith(F.ltrim(raw), F.lit('"')), plain)
        .otherwise(fallback)
    )
    return truncate_message(text)


def validation_errors(raw: Column, limit: int = 10) -> Column:
    """Listed validation errors: the array itself, or the body's message or errors array."""
    def as_list(text):
        return F.when(_is_array(text), F.from_json(text, "array<string>"))

    found = F.coalesce(
        as_list(raw), as_list(F.get_json_object(raw, "$.message")), as_list(F.get_json_object(raw, "$.errors"))
    )
    return F.slice(found, 1, limit)


def plain_error(code: Column, status: Column, class_name: Column, message: Column) -> Column:
    """{code, message} of an exception that is no HTTP error."""
    return F.struct(
        F.coalesce(_filled(code), _filled(status.cast("string")), _filled(class_name), F.lit("UNKNOWN")).alias("code"),
        truncate_message(F.coalesce(_filled(message), F.lit("Unknown error"))).alias("message"),
    )


def unknown_error(thrown: Column) -> Column:
    """{code, message} of something thrown that is no error at all, given as JSON text: a string's own text, an object's or list's JSON."""
    text = F.ltrim(thrown)
    plain = F.element_at(F.from_json(F.concat(F.lit("["), thrown, F.lit("]")), "array<string>"), 1)
    message = (
        F.when(F.startswith(text, F.lit('"')), plain)
        .when(_is_object(thrown) | _is_array(thrown), F.substring(text, 1, MAX_MESSAGE))
        .otherwise(F.lit("Unknown error"))
    )
    return F.struct(F.lit("UNKNOWN").alias("code"), truncate_message(F.coalesce(message, F.lit("Unknown error"))).alias("message"))


# --- requests ------------------------------------------------------------------
SOURCES = ("body", "params", "query", "headers")


def request_value(path: str, sources: dict[str, Column] | None = None) -> Column:
    """Value at a dotted path such as ``body.user.id``; null for an unknown source.

    ``sources`` maps body, params, query and headers to JSON text columns.
    """
    source, _, rest = path.partition(".")
    if source not in SOURCES:
        return F.lit(None).cast("string")
    column = (sources or {}).get(source, F.col(source))
    return json_path(column, rest)


def json_path(column: Column, path: str) -> Column:
    if not path:
        return column
    return F.get_json_object(column, "$" + "".join(f"['{p}']" for p in path.split(".")))


def request_user(id_path: str, role_path: str, sources: dict[str, Column] | None = None) -> Column:
    """User struct from request paths; a missing role counts as unknown, hence guest."""
    uid = _filled(request_value(id_path, sources))
    role = F.coalesce(_filled(request_value(role_path, sources)), F.lit("UNKNOWN"))
    return ev.user_struct(uid, role)


def session_user(user: Column) -> Column:
    """User struct from the authenticated user (JSON text)."""
    role = F.coalesce(_filled(json_path(user, "role")), F.lit("UNKNOWN"))
    return ev.user_struct(_filled(json_path(user, "id")), role)


def is_redacted(path: str, redact_paths: Sequence[str]) -> bool:
    """Decided once per configured path: equal, or same last segment below a dot."""
    return any(path == r or path.endswith("." + r.rsplit(".", 1)[-1]) for r in redact_paths)


def clip_string(value: Column, max_length: int = 200) -> Column:
    return F.when(
        F.length(value) > max_length, F.concat(F.substring(value, 1, max_length), F.lit("..."))
    ).otherwise(value)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _bounded_json(text: Column, value: Column, max_depth: int, max_length: int, depth: int = 0) -> Column:
    """JSON text of a value: strings cut, lists to 10 items, objects to their first 20 keys, depth limited.

    ``value`` is the variant, which knows the kinds but sorts its keys; ``text`` is the same value's
    JSON (a bare string's content), which has the keys in the order they came in.
    """

    def container(kind: Column) -> Column:
        items = value.cast("array<variant>")
        if depth >= max_depth:
            array = F.concat(F.lit('"[Array('), F.size(items).cast("string"), F.lit(')]"'))
            return F.when(F.startswith(kind, F.lit("ARRAY")), array).otherwise(F.lit('"[Object]"'))

        def below(t, v):
            return _bounded_json(t, v, max_depth, max_length, depth + 1)

        texts = F.slice(F.from_json(text, "array<string>"), 1, 10)
        array = F.concat(F.lit("["), F.array_join(F.zip_with(texts, F.slice(items, 1, 10), below), ","), F.lit("]"))
        ordered = F.slice(F.map_entries(F.from_json(text, "map<string,string>")), 1, 20)
        pairs = let(
            value.cast("map<string,variant>"),
            lambda known: F.transform(
                ordered, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), below(e["value"], F.element_at(known, e["key"])))
            ),
        )
        obj = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        return F.when(F.startswith(kind, F.lit("ARRAY")), array).otherwise(obj)

    return let(
        _kind(value),
        lambda kind: F.when(kind == "STRING", _quoted(clip_string(value.cast("string"), max_length)))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), container(kind))
        .otherwise(F.coalesce(value.cast("string"), F.lit("null"))),
    )


def sanitized_json(value: Column, text: Column, max_depth: int = 2, max_length: int = 200) -> Column:
    """Bounded text of a variant and its JSON text: a string is cut, an object or list is bounded JSON, null is null."""
    return let(
        _kind(value),
        lambda kind: F.when(kind == "STRING", clip_string(value.cast("string"), max_length))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), _bounded_json(text, value, max_depth, max_length))
        .otherwise(value.cast("string")),
    )


def _variant_path(parsed: Column, path: str) -> Column:
    """Variant at a dotted path of a variant."""
    if not path:
        return parsed
    return F.try_variant_get(parsed, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")


def _present_map(values: dict[str, Column]) -> Column:
    pairs = [part for key, value in values.items() for part in (F.lit(key), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def request_meta(
    paths: Sequence[str],
    redact: Sequence[str] = (),
    replacement: str = REDACTED,
    max_length: int = 200,
    max_depth: int = 2,
    sources: dict[str, Column] | None = None,
) -> Column:
    """Allow-listed request values as a map keyed by the last path segment.

    Redaction is settled while the plan is built, so a secret is never read into
    the output. Where two paths share a key the later one wins.
    """
    rules = [*DEFAULT_REDACT_PATHS, *redact]
    known = [p for p in paths if p.partition(".")[0] in SOURCES]
    if not known:
        return F.create_map().cast("map<string,string>")

    def bounded(value: Column, text: Column) -> Column:
        return let(value, lambda v: sanitized_json(v, text, max_depth, max_length))

    def collect(parsed):
        out: dict[str, Column] = {}
        for path in known:
            source, _, rest = path.partition(".")
            value = _variant_path(parsed[source], rest)
            if is_redacted(path, rules):
                shown = let(value, lambda v: F.when(v.isNotNull() & (_kind(v) != "VOID"), replacement))
            else:
                shown = bounded(value, json_path((sources or {}).get(source, F.col(source)), rest))
            key = path.rsplit(".", 1)[-1]
            out[key] = F.coalesce(shown, out[key]) if key in out else shown
        return _present_map(out)

    # Every source is parsed once and every value looked up once.
    used = sorted({p.partition(".")[0] for p in known})
    return let(F.struct(*[F.try_parse_json((sources or {}).get(s, F.col(s))).alias(s) for s in used]), collect)


def response_meta(
    response: Column, paths: Sequence[str], succeeded: Column, max_length: int = 200, max_depth: int = 2
) -> Column:
    """Response values of successful requests, keyed ``response_`` plus the path with underscores."""

    def collect(parsed):
        def bounded(path):
            return let(_variant_path(parsed, path), lambda v: sanitized_json(v, json_path(response, path), max_depth, max_length))

        return _present_map({f"response_{p.replace('.', '_')}": bounded(p) for p in paths})

    return F.when(succeeded, let(F.try_parse_json(response), collect))


def redact_map(bag: Column, redact: Sequence[str] = (), replacement: str = REDACTED) -> Column:
    """Mask the values of a map whose key is, or ends in, a redacted field name."""
    names = sorted({r.rsplit(".", 1)[-1] for r in [*DEFAULT_REDACT_PATHS, *redact]})
    return F.transform_values(
        bag, lambda k, v: F.when(F.substring_index(k, ".", -1).isin(names), F.lit(replacement)).otherwise(v)
    )


def sanitize(value: Column, dtype: T.DataType, max_depth: int = 2, max_length: int = 200, depth: int = 0) -> Column:
    """Bounded copy of a value: strings cut, lists to 10 items, objects to 20 keys, depth limited.

    The depth of a column is known from its type, so the cut-off is a literal.
    """
    if isinstance(dtype, T.StringType):
        return clip_string(value, max_length)
    nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))
    if not nested:
        return value
    if depth >= max_depth:
        text = F.lit("[Object]")
        if isinstance(dtype, T.ArrayType):
            text = F.concat(F.lit("[Array("), F.size(value).cast("string"), F.lit(")]"))
        return F.when(value.isNotNull(), text)
    below = dict(max_depth=max_depth, max_length=max_length, depth=depth + 1)
    if isinstance(dtype, T.ArrayType):
        return F.transform(F.slice(value, 1, 10), lambda v: sanitize(v, dtype.elementType, **below))
    if isinstance(dtype, T.MapType):
        kept = F.map_from_entries(F.slice(F.map_entries(value), 1, 20))
        return F.transform_values(kept, lambda _, v: sanitize(v, dtype.valueType, **below))
    fields = [sanitize(value[f.name], f.dataType, **below).alias(f.name) for f in dtype.fields[:20]]
    return F.when(value.isNotNull(), F.struct(*fields))
