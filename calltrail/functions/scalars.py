"""Scalar functions over trace columns, all built from Spark's own expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the trace contract.
MARKERS = ("skipped", "depth", "error", "truncated")
MARKER_TEXT = {"skipped": "<skipped:", "depth": "<depth:", "error": "<error:", "truncated": "<truncated>"}
USABLE_RESOLUTIONS = ("debugInfo", "generatedState", "sequencePoints", "stateMachine")
ALIASES = {"sequencePoints": "debugInfo", "stateMachine": "generatedState"}
SENSITIVE_NAMES = ("password", "token", "secret", "key", "ssn", "email", "auth", "credential")
# Fixed values too: the credential patterns.
CREDENTIALS = {
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "pem": r"-----BEGIN [A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE)-----",
    "base64": r"(?:^|[^A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}={0,2})(?:$|[^A-Za-z0-9+/=])",
}
# A fixed value too: paths of generated source.
GENERATED = r"(^|/)(obj|generated|target/generated-(test-)?sources)/|\.(g|generated)\.(cs|java|js|ts)$"
# Words that name nothing in a patch.
STOP_WORDS = ("private", "public", "protected", "internal", "static", "const", "readonly", "decimal", "string", "bool", "true", "false", "return", "class", "record", "struct", "namespace")


def backslashes_to_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_rooted(path: Column) -> Column:
    """Absolute on any system: /..., \\..., X:\\ or X:/."""
    return path.rlike(r"^(/|\\|[A-Za-z]:[\\/])")


def path_class(path: Column, root: Column, segment_safe: bool = True) -> Column:
    """missing, relative, normalized (a known root was stripped) or still-absolute."""
    p = backslashes_to_slashes(path)
    return (
        F.when(path.isNull() | (path == ""), "missing").when(~is_rooted(path), "relative").when(F.startswith(p, F.lit("/_/")) | _under(p, root, segment_safe), "normalized").otherwise("still-absolute")
    )


def _under(p: Column, root: Column, segment_safe: bool) -> Column:
    r = F.lower(F.rtrim(backslashes_to_slashes(root), F.lit("/")))
    r = F.concat(r, F.lit("/")) if segment_safe else r
    return (F.length(root) > 0) & F.startswith(F.lower(p), r)


def normalize_path(path: Column, root: Column, segment_safe: bool = True) -> Column:
    """Repo-relative path with slashes; null for missing, unchanged (slashes only) for still-absolute."""
    p = backslashes_to_slashes(path)
    r = F.rtrim(backslashes_to_slashes(root), F.lit("/"))
    rest = F.ltrim(F.substring(p, F.length(r) + 1, F.length(p)), F.lit("/"))
    return F.when(path.isNull() | (path == ""), None).when(~is_rooted(path), p).when(F.startswith(p, F.lit("/_/")), F.substring(p, F.lit(4), F.length(p))).when(_under(p, root, segment_safe), rest).otherwise(p)


def common_root(paths: Column) -> Column:
    """Aggregate: longest common directory of paths, segment by segment and without case.

    Folders are compared as arrays of segments, so what lies between the least and the greatest shares what these share; as strings, A.Tests would lie between A and A/B.
    """
    folder = F.split(F.regexp_replace(backslashes_to_slashes(paths), r"/[^/]*$", ""), "/")
    lower = F.transform(folder, F.lower)
    lo, hi, spelled = F.min(lower), F.max(lower), F.min_by(folder, lower)
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(lo), F.size(hi))), lambda i: F.slice(lo, F.lit(1), i) == F.slice(hi, F.lit(1), i))
    return F.array_join(F.slice(spelled, F.lit(1), F.size(F.filter(same, lambda x: x))), "/")


def first_difference(b_args: Column, p_args: Column, b_return: Column, p_return: Column, b_exception: Column, p_exception: Column) -> Column:
    return F.when(~b_args.eqNullSafe(p_args), "argsDigest").when(~b_return.eqNullSafe(p_return), "returnDigest").when(~b_exception.eqNullSafe(p_exception), "exceptionType")


def partial_markers(*rendered: Column) -> Column:
    """Sorted names of the markers in any of the renderings."""
    text = F.concat_ws("\n", *rendered)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(m)) for m, t in MARKER_TEXT.items()])))


def confidence(markers: Column) -> Column:
    return F.when(F.size(markers) > 0, "Partial").otherwise("Exact")


def declaring_type(method: Column) -> Column:
    """Before the parameters and before the last dot; a name without a dot is its own type."""
    return F.regexp_replace(F.substring_index(method, "(", 1), r"\.+[^.]*$", "")


def simple_type(type_name: Column) -> Column:
    return F.substring_index(F.substring_index(type_name, ".", -1), "`", 1)


def short_member(method: Column) -> Column:
    return F.concat_ws(".", simple_type(declaring_type(method)), F.substring_index(F.substring_index(method, "(", 1), ".", -1))


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def is_generated_source(path: Column) -> Column:
    return F.coalesce(path.rlike(GENERATED), F.lit(False))


def sha_digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def truncate(text: Column, limit: int = 2000, mark: str = "<truncated>") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def sensitive_name(name: Column, words: tuple[str, ...] = SENSITIVE_NAMES) -> Column:
    """Whether the name contains one of the words, whatever the case; null is no name."""
    return F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False))


def digest_only_type(name: Column, prefixes: tuple[str, ...]) -> Column:
    """Types whose values are never shown, by whole-segment prefixes of their full names."""
    n = F.lower(name)
    under = lambda p: (n == p) | F.startswith(n, F.lit(p + ".")) | F.startswith(n, F.lit(p + "`"))
    return F.coalesce(reduce(or_, (under(p.lower()) for p in prefixes), F.lit(False)), F.lit(False))


def digest_only_path(path: Column, parts: tuple[str, ...]) -> Column:
    """Files whose values are never shown: a part is a run of whole path segments, wherever it stands."""
    p = F.concat(F.lit("/"), F.lower(F.trim(backslashes_to_slashes(path), F.lit("/"))), F.lit("/"))
    inside = [F.contains(p, F.lit("/" + x.replace("\\", "/").strip("/").lower() + "/")) for x in parts]
    return F.coalesce(reduce(or_, inside, F.lit(False)) & (F.trim(path) != ""), F.lit(False))


def has_credential(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in CREDENTIALS.values()))


def redact(text: Column) -> Column:
    return F.when(has_credential(text), "<redacted>").otherwise(text)


def path_like(text: Column) -> Column:
    """Rooted on some system, with something below the root; text with a NUL is no path."""
    return (F.length(text) > 2) & ~F.contains(text, F.lit("\x00")) & text.rlike(r"^\p{L}:[\\/]|^/[^/]*/|^\\\\")


def string_text(text: Column, temp: str = "") -> Column:
    """A string as a digest shows it: quoted, or without what differs between machines where it is a path."""
    inside = F.startswith(F.lower(text), F.lit(temp.lower())) if temp else F.lit(False)
    return F.when(path_like(text), F.when(inside, "<tempfile>").otherwise("<path>")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def in_scope(value: Column, include: list[str], exclude: list[str] = (), sep: str = ".") -> Column:
    """Whole-segment prefixes; exclusion beats inclusion, and no inclusion list includes all."""
    under = lambda p: (value == p) | F.startswith(value, F.lit(p + sep))
    any_of = lambda ps: reduce(or_, map(under, ps), F.lit(False))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def list_items(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))


def display_text(text: Column) -> Column:
    text = F.regexp_replace(text, r"<([^>]+)>k__BackingField=", "$1=")
    return F.replace(F.regexp_replace(text, r"\b(Primitive|StructuralFields):", ""), F.lit("`"), F.lit("'"))


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def value_or_exception(value: Column, exception: Column) -> Column:
    """What a call came to, as shown in a report."""
    return F.when(exception.isNotNull(), F.concat(F.lit("exception "), code_text(exception))).otherwise(code_text(display_text(F.coalesce(value, F.lit("(not rendered)")))))


def code_text(text: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(text, F.lit("`"), F.lit("'")), F.lit("`"))


def invocation(method: Column, args: Column) -> Column:
    """A member's own name with the arguments that were rendered."""
    name = F.substring_index(F.substring_index(method, "(", 1), ".", -1)
    return F.concat(name, F.lit("("), display_text(F.coalesce(args, F.lit("arguments not rendered"))), F.lit(")"))


def duration_seconds(text: Column) -> Column:
    n = F.regexp_extract(text, r"^(\d+)[hd]$", 1)
    return F.when(n != "", n.cast("long") * F.when(F.endswith(text, F.lit("d")), 86400).otherwise(3600))


def share_percent(part: Column, whole: Column, if_none: float) -> Column:
    return F.when(whole == 0, F.lit(float(if_none))).otherwise(part * 100.0 / whole)


def identifiers(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct identifiers of four characters or more, as they are spelt."""
    return F.array_except(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), 1), lambda x: F.length(x) >= 4)), F.array(*map(F.lit, stop)))


def side_identifiers(patch: Column) -> Column:
    """Identifiers of a patch that stand on one side only (added or removed lines); all of both sides where there is none such."""
    lines = F.split(patch, "\n")
    side = lambda sign: identifiers(F.array_join(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))), "\n"))
    added, removed = side("+"), side("-")
    only = F.concat(F.array_except(added, removed), F.array_except(removed, added))
    return F.when(F.size(only) > 0, only).otherwise(F.array_union(added, removed))


def source_rule(n: Column, exact: Column) -> Column:
    """notApplicable without members, anyNone under five, ratio (80 %) from five on."""
    return F.when(n == 0, "notApplicable").when(n < 5, "anyNone").otherwise("ratio")


def source_unavailable(n: Column, exact: Column) -> Column:
    return F.when(n == 0, False).when(n < 5, exact == 0).otherwise(F.floor(exact * 100 / n) < 80)


def exact_percent(n: Column, exact: Column) -> Column:
    return F.when(n == 0, 100).otherwise(F.floor(exact * 100 / n)).cast("int")


def source_partial(n: Column, exact: Column) -> Column:
    return (n >= 5) & exact_percent(n, exact).between(80, 99)


def implausible_change_set(commits: Column, files: Column) -> Column:
    return (commits <= 3) & (files > 250)


# The sentences of a report.
def assertion_reaction(executing: Column, reacted: Column) -> Column:
    ran = F.concat(executing.cast("string"), F.when(executing == 1, " test executed this; ").otherwise(" tests executed this; "))
    asserted = F.when(reacted == 0, "none asserted on the changed value.").when(reacted == 1, "1 test had an assertion react.").otherwise(F.concat(reacted.cast("string"), F.lit(" tests had an assertion react.")))
    return F.concat(ran, asserted)
