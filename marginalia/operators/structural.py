"""Comments that must stay whatever they say: directives, licenses, todos. Rules are a table of the program."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

SCRIPTS = ("javascript", "typescript", "tsx")
# The directives that tools read in comments, by language.
RULES = (
    (("python",), r"(?i)^#\s*(noqa\b|type:|pyright:|pylint:|mypy:|ruff:|isort:|fmt:|pragma\b|nosec\b|noinspection\b|cython:|distutils:|%%)"),
    (
        SCRIPTS,
        r"(?i)(eslint-(disable|enable)(-next-line|-line)?\b|@ts-(ignore|expect-error|nocheck|check)\b|prettier-ignore\b|biome-ignore\b"
        r"|istanbul ignore\b|c8 ignore\b|v8 ignore\b|@flow\b|@jsx[-\w]*|@license\b|@preserve\b|@generated\b|#region\b|#endregion\b"
        r"|\bwebpack\w*\s*:|@vite-ignore\b|\bvite\b\s*:?\s*ignore)",
    ),
    (SCRIPTS, r"^(///\s*<reference|//#\s*source(MappingURL|URL))"),
    (
        ("yaml",),
        r"(?i)^#\s*(yaml-language-server:|yamllint\b|prettier-ignore\b|noqa\b|checkov:skip\b|bridgecrew:skip\b|kics-scan\b|tflint-ignore\b"
        r"|trivy:ignore\b|renovate:|ansible-lint\b|kube-linter\b|nosemgrep\b|ruleid:|pragma\b|@formatter:|region\b|endregion\b|language\s*=)",
    ),
    (("rust",), r"(?i)(SAFETY:|@generated\b|\bANCHOR(_END)?:|grcov-excl-|LCOV_EXCL_)"),
    (("rust",), r"(?i)^//\s*(region\b|endregion\b|noinspection\b|@formatter:|language\s*=|nosemgrep\b)"),
    ((), r"(?i)(\b(vim|vi|ex):\s*set(tings?)?\b|-\*-.*?-\*-)"),
)
# An encoding declaration, notes that the keep rule spares, and what makes a comment of kind todo or directive.
CODING = r"(?i)coding[:=]\s*[-\w.]+"
TODO = r"\b(TODO|FIXME|XXX|HACK|NOTE)\b"
TODO_KIND = r"\b(TODO|FIXME|XXX|HACK)\b|(?i:@todo\b)"
RUNNER = r"@(jest|vitest)-environment\b"


def is_directive(comment: Column, language: Column, line: Column, offset: Column, is_block: Column, is_doc: Column) -> Column:
    """Whether tools or lawyers read the comment. ``line`` counts from 0, ``offset`` from the file's first
    character behind a byte order mark; ``is_doc`` marks doc comments of the language itself."""
    found = (language.isin("python", "yaml") & (offset == 0) & F.startswith(comment, F.lit("#!"))) | (
        (language == "python") & (line <= 1) & T.unicode_rlike(comment, CODING)
    )
    found = found | (language.isin(*SCRIPTS) & is_block & comment.rlike(r"^/\*[*!]")) | is_doc | T.names_license(comment)
    for languages, pattern in RULES:
        hit = T.unicode_rlike(comment, pattern)
        found = found | (language.isin(*languages) & hit if languages else hit)
    return found


def is_structural(comment: Column, *place: Column) -> Column:
    """A directive, or a note about work to do."""
    return T.unicode_rlike(comment, TODO) | is_directive(comment, *place)


def comment_kind(comment: Column, directive: Column, documents: Column) -> Column:
    """directive (a test runner's), api_doc, todo, directive or inline, the first that holds.

    ``documents``: one of its tokens is a doc comment or a block that begins with ``/**``, or it is a docstring.
    ``directive``: what ``is_directive`` says. Nulls of either don't hold.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(T.unicode_rlike(comment, RUNNER), "directive").when(holds(documents), "api_doc")
        .when(T.unicode_rlike(comment, TODO_KIND), "todo").when(holds(directive), "directive").otherwise("inline")
    )


def placement(own_line: Column, docstring_of: Column) -> Column:
    """module_head, class_head or function_head for docstrings of a ``docstring_of``, else before_statement or trailing."""
    return F.when(docstring_of.isNotNull(), F.concat(docstring_of, F.lit("_head"))).when(own_line, "before_statement").otherwise("trailing")


def name_matches(name: Column, patterns: Column) -> Column:
    """Whether a dotted name is one of the patterns or ends with one behind a dot; no patterns match nothing."""
    return F.exists(patterns, lambda p: (name == p) | F.endswith(name, F.concat(F.lit("."), p)))


def decorator_name(decorator: Column) -> Column:
    """A decorator's dotted name, without the at sign and whatever stands behind it."""
    return F.regexp_extract(decorator, r"\A@?([\p{L}\p{N}_.]*)", 1)


def keeps_docstring(text: Column, kind: Column, source: Column, decorators: Column, base_matches: Column, keep_decorators: Column) -> Column:
    """Whether a docstring stays whatever it says: a doctest, a module's in a file that reads ``__doc__``, a license
    notice, one whose decorator is kept or whose class has a kept base. Nulls of any don't hold."""
    rules = (
        F.contains(text, F.lit(">>>")), (kind == "module") & F.contains(source, F.lit("__doc__")), T.names_license(text),
        F.exists(decorators, lambda d: name_matches(decorator_name(d), keep_decorators)), base_matches,
    )
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out
