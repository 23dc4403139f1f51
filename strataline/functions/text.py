"""Text, path and name expressions. Each takes and gives a Column, so Catalyst sees them whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- paths ---------------------------------------------------------------


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def dirname(path) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"^(.*/)?[^/]*$", 1), r"/$", "")


def suffix(path) -> Column:
    """Lower-cased extension with its dot; empty without one. A leading dot starts a name."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def module_of(path) -> Column:
    return F.when(dirname(path) == "", F.lit("<root>")).otherwise(dirname(path))


def language_of(path) -> Column:
    """Language of a path by its extension."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, suffix(path)), F.lit("unknown"))


def file_kind(name) -> Column:
    """What a file is for, by its name; the first rule that fits."""
    n = F.lower(_c(name))
    ends = lambda *xs: reduce(lambda a, b: a | b, [n.endswith(x) for x in xs])
    return (
        F.when(n.startswith("test_") | ends("_test.py"), "test")
        .when(n.isin("routes", "endpoints", "views", "api"), "api")
        .when(n.contains("schema") | ends(".pydantic"), "schema")
        .when(n.contains("middleware"), "middleware")
        .when(n.contains("model") | n.contains("entity"), "model")
        .when(n.isin("config", "settings"), "config")
        .when(n.isin("utils", "helpers", "tools"), "util")
        .when(ends(".component.tsx", ".component.jsx", ".vue"), "component")
        .when(n.startswith("use") | ends(".hook."), "hook")
        .otherwise("unknown")
    )


def runtime_path(path) -> Column:
    """A path without leading slashes and without one of the usual roots."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"^/+", ""), r"^(src/|lib/|app/)", "")


def relative_to(path, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(_c(path).startswith(root), F.substring(_c(path), len(root) + 1, 1 << 30)).otherwise(_c(path))


def suggested_test_path(path) -> Column:
    """Where a file's test goes: beside it, by the habits of its language."""
    folder = F.when(dirname(path) == "", "").otherwise(F.concat(dirname(path), F.lit("/")))
    return F.when(suffix(path) == ".py", F.concat(folder, F.lit("test_"), basename(path))).otherwise(F.concat(folder, stem(path), F.lit(".test"), suffix(path)))


def is_test_file(path) -> Column:
    n = basename(path)
    return n.rlike(r"_test\.py$") | n.startswith("test_") | n.rlike(r"\.(test\.(js|ts|tsx)|spec\.(js|ts))$")


def is_sensitive_path(path) -> Column:
    p = F.lower(_c(path))
    return basename(p).isin(*fixed.SENSITIVE_NAMES) | reduce(lambda a, b: a | b, [p.contains(t) for t in fixed.SENSITIVE_TOKENS])


def is_unsafe_path(path) -> Column:
    p = _c(path)
    return p.contains("..") | p.startswith("/") | p.contains("~") | p.contains("$") | (F.coalesce(p, F.lit("")) == "")


def safe_basename(path) -> Column:
    return F.regexp_replace(basename(path), r"[^\w\s\-.]", "_")


def mentions_path(reference, path) -> Column:
    """Whether a reference is to a path: itself, it with a line or anchor, below it, or a segment equal to it."""
    r, p = _c(reference), _c(path)
    return (r == p) | r.startswith(F.concat(p, F.lit(":"))) | r.startswith(F.concat(p, F.lit("#"))) | r.startswith(F.concat(p, F.lit("/"))) | F.array_contains(F.split(r, "/"), p)


# -- words ---------------------------------------------------------------


def words(text) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def token_estimate(text) -> Column:
    return F.floor(F.size(words(F.coalesce(_c(text), F.lit("")))) * F.lit(1.3)).cast("int")


def keywords(text) -> Column:
    """The first five lower-cased words that aren't stopwords and have over two letters."""
    stop = F.array(*[F.lit(w) for w in fixed.STOPWORDS])
    return F.slice(F.filter(words(F.lower(_c(text))), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2)), 1, 5)


def code_terms(text) -> Column:
    """Words that look like names in code: with an underscore, or a capital first."""
    return F.filter(words(text), lambda w: w.contains("_") | (F.substring(w, 1, 1).rlike(r"\p{Lu}")))


def enhanced_question(question, terms) -> Column:
    """A question with up to five terms after it."""
    return F.when(F.size(terms) > 0, F.concat(_c(question), F.lit(" "), F.array_join(F.slice(terms, 1, 5), " "))).otherwise(_c(question))


def truncated(text, limit: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n\n... truncated "), (F.length(t) - limit).cast("string"), F.lit(" characters ..."))).otherwise(t)


def masked(secret) -> Column:
    s = _c(secret)
    return F.when(F.length(s) > 12, F.concat(F.substring(s, 1, 8), F.lit("..."), F.substring(s, -4, 4))).otherwise(F.lit("***"))


def is_snake_case(name) -> Column:
    return _c(name).rlike(r"^[a-z][a-z0-9_]*$")


def is_camel_case(name) -> Column:
    return _c(name).rlike(r"^[a-z][a-zA-Z0-9]*$") & _c(name).rlike(r"[A-Z]")


def snake_case(name) -> Column:
    return F.lower(F.regexp_replace(_c(name), r"(?<!^)(?=[A-Z])", "_"))


def purpose_of(name) -> Column:
    """What a function is for, by how its name begins; null if nothing is known."""
    n = F.lower(_c(name))
    out = None
    for starts, purpose in fixed.PURPOSES:
        test = reduce(lambda a, b: a | b, [n.startswith(s) for s in starts])
        out = F.when(test, purpose) if out is None else out.when(test, purpose)
    return out


def stable_id(*parts, short: bool = False) -> Column:
    """A hash of parts joined by colons: 64 hex digits, or the first 16."""
    digest = F.sha2(F.concat_ws(":", *[_c(p).cast("string") for p in parts]), 256)
    return F.substring(digest, 1, 16) if short else digest


def anchor(text) -> Column:
    """A heading's link target."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\w\s-]", ""), r"[\s]+", "-")


def export_name(path, extension: str = ".md") -> Column:
    return F.concat(F.regexp_replace(_c(path), r"[/\\.]", "_"), F.lit(extension))


def element_query(kind, name, params, returns, code) -> Column:
    """The text by which an element is embedded."""
    params_text = F.when(F.size(params) > 0, F.concat(F.lit("Parameters: "), F.array_join(params, ", ")))
    return F.concat_ws(" | ", F.concat(_c(kind), F.lit(": "), _c(name)), params_text, F.concat(F.lit("Returns: "), _c(returns)), F.substring(_c(code), 1, 300))


# -- answers of language models -------------------------------------------


def without_fences(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(text)), r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```\s*$", ""))


def without_thoughts(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?is)<think>.*?</think>", ""))


def confidence(text) -> Column:
    """The stated confidence, 0 if none, within 0 and 1."""
    found = F.regexp_extract(_c(text), fixed.CONFIDENCE, 1)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(found != "", found.cast("double")))), F.lit(0.0))


def answer_text(text) -> Column:
    """An answer without the lines that state its confidence."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: ~F.trim(x).rlike("^" + fixed.CONFIDENCE))
    return F.trim(F.array_join(lines, "\n"))


def citations(text) -> Column:
    """Each cited (path, start, end) of a text, in order."""
    found = F.regexp_extract_all(_c(text), F.lit(fixed.CITATION), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, fixed.CITATION, k)
    return F.transform(
        found,
        lambda x: F.struct(
            part(x, 1).alias("path"),
            part(x, 2).cast("int").alias("start"),
            F.when(part(x, 3) != "", part(x, 3)).otherwise(part(x, 2)).cast("int").alias("end"),
        ),
    )


def salvaged_json(text) -> Column:
    """The JSON object or array inside a text: fenced, bare, or the widest brackets; null if there is none."""
    t = without_fences(without_thoughts(text))
    return F.coalesce(*[F.when(F.get_json_object(x, "$").isNotNull(), x) for x in (t, F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1))])


def cleaned_list(values, fallback) -> Column:
    """Trimmed strings, none empty, eight at most; the fallback if none are left."""
    kept = F.slice(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), 1, 8)
    return F.when(F.size(kept) > 0, kept).otherwise(fallback)


def js_parameters(raw, required: bool = False) -> Column:
    """Names in a JavaScript or TypeScript parameter list; only those without a default if `required`."""
    tokens = F.filter(F.transform(F.split(_c(raw), ","), lambda t: F.trim(t)), lambda t: t != "")
    if required:
        tokens = F.filter(tokens, lambda t: ~t.contains("="))
    names = F.transform(tokens, lambda t: F.regexp_extract(F.regexp_replace(F.trim(F.split(t, ":")[0]), r"^\.+", ""), r"^([^\s=]*)", 1))
    return F.filter(names, lambda n: ~n.isin("", "{", "["))


# -- checks of input; the messages are fixed values ---------------------------


def collection_error(name) -> Column:
    """Why a collection's name is refused; empty if it isn't."""
    n = F.trim(_c(name))
    return (
        F.when(F.coalesce(_c(name), F.lit("")) == "", "Collection name cannot be empty")
        .when(n == "", "Collection name cannot be whitespace only")
        .when(F.length(n) > 63, "Collection name must be at most 63 characters")
        .when(~n.rlike(r"^[a-zA-Z0-9_-]+$"), "Collection name can only contain letters, numbers, underscores, and hyphens")
        .when(F.lower(n).isin(*fixed.RESERVED_NAMES), F.concat(F.lit("'"), n, F.lit("' is a reserved name and cannot be used")))
        .otherwise("")
    )


def collection_name(name) -> Column:
    n = F.regexp_replace(F.replace(F.trim(_c(name)), F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_-]", "")
    return F.when(F.coalesce(n, F.lit("")) == "", "default_collection").otherwise(F.substring(n, 1, 63))


def project_name_error(name) -> Column:
    n = _c(name)
    return (
        F.when(F.coalesce(n, F.lit("")) == "", "Name cannot be empty")
        .when(F.length(n) < 3, "Name must be at least 3 characters")
        .when(F.length(n) > 64, "Name must be at most 64 characters")
        .when(~n.rlike(r"^[a-zA-Z][a-zA-Z0-9_-]*$"), "Name must start with a letter and contain only letters, numbers, underscores, and hyphens")
        .otherwise("")
    )


def question_error(question, least: int = 3, most: int = 2000) -> Column:
    q = F.regexp_replace(_c(question), r"^\s+|\s+$", "")
    return (
        F.when(F.coalesce(_c(question), F.lit("")) == "", "Question cannot be empty")
        .when(q == "", "Question cannot be whitespace only")
        .when(F.length(q) < least, f"Question must be at least {least} characters")
        .when(F.length(q) > most, f"Question must be at most {most} characters")
        .otherwise("")
    )


def clean_question(question, most: int = 2000) -> Column:
    q = F.regexp_replace(F.regexp_replace(F.coalesce(_c(question), F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")
    return F.substring(q, 1, most)


def api_key_error(key) -> Column:
    k = F.trim(_c(key))
    return (
        F.when(F.coalesce(_c(key), F.lit("")) == "", "API key cannot be empty")
        .when(k == "", "API key cannot be whitespace only")
        .when(F.length(k) < 10, "API key appears to be too short")
        .when(F.lower(k).isin(*fixed.PLACEHOLDER_KEYS), "API key appears to be a placeholder value")
        .otherwise("")
    )


def file_error(path, size) -> Column:
    """Why a file isn't taken; empty if it is."""
    mb = F.format_string("%.2f", _c(size) / (1024 * 1024))
    return (
        F.when(~F.coalesce(suffix(path), F.lit("")).isin(*fixed.SOURCE_EXTENSIONS), F.lit("Unsupported file type. Supported types: " + ", ".join(sorted(fixed.SOURCE_EXTENSIONS))))
        .when(_c(size) > fixed.MOST_FILE_BYTES, F.concat(F.lit("File size ("), mb, F.lit("MB) exceeds maximum allowed size (10MB)")))
        .otherwise("")
    )


def is_trivial_commit(message) -> Column:
    """Commits that are hardly decisions: by how they begin, or of under five words."""
    m = F.lower(F.trim(_c(message)))
    return reduce(lambda a, b: a | b, [m.startswith(p) for p in fixed.TRIVIAL_PREFIXES]) | (F.size(words(m)) < 5)


def asks_for_decisions(question) -> Column:
    q = F.lower(_c(question))
    return reduce(lambda a, b: a | b, [q.contains(w) for w in ("why", "who", "decision", "reason")])


def is_blank(text) -> Column:
    return ~F.coalesce(_c(text), F.lit("")).rlike(r"\S")


def line_count(text) -> Column:
    """Newlines in a text."""
    return F.length(_c(text)) - F.length(F.replace(_c(text), F.lit("\n"), F.lit("")))
