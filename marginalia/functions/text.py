"""Text scalars as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are no content, as the evidence rules define them.
STOP_WORDS = (
    "the a an and or of to in is it this that for on with as be are was by from if at not we its use so then when".split()
)
# Line starts that mark code.
CODE_STARTS = ("def ", "class ", "import ", "from ", "return ", "if ", "for ", "while ", "const ", "let ", "var ", "function ", "export ", "}")
# Fixed value: words of a license notice.
LICENSE = r"(?i)\b(license|copyright|SPDX)\b"
# The patterns of ticket references, numbers, quotes and units, as the evidence rules define them.
TRACKER = r"@\w+|\b[A-Z]{2,}-\d+\b|#\d+|https?://"
NUMBER = r"(?U)\b[0-9]+(?:\.[0-9]+)?"
NUMBER_UNIT = r"((?U)\b[0-9]+(?:\.[0-9]+)?[A-Za-z]*)"
QUOTED = r"""(?U)(?:^|[^\w"'])("[^"\n]+"|'[^'\n]+')"""
UNIT_WORD = (
    r"(?U)(?i:\b(?:milli|micro|nano)seconds?\b|\bseconds\b|\bmsecs?\b|\bms\b|\bminutes?\b|\bhours?\b|\bdays?\b"
    r"|\b(?:kilo|mega|giga)?bytes?\b|\bpx\b|\bpercent(?:age)?\b)|\b[KMGT]i?B\b|毫秒|秒|分钟|小时|天|字节"
)
UNIT_AFTER_NUMBER = r"(?U)(?i:[0-9]+\s*(?:(?:s|secs?|second|mins?|h|hrs?)\b|%))"
PY_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def is_separator(line: Column) -> Column:
    """Three or more characters, all of them separator punctuation."""
    return F.trim(line).rlike(r"^[-=*#~_+/|.]{3,}$")


def unicode_rlike(text: Column, pattern: str) -> Column:
    """Word borders, word characters, digits and white space of all scripts, not of ASCII alone."""
    return text.rlike("(?U)" + pattern)


def names_license(line: Column) -> Column:
    """A word of a license notice; few lines hold one at all, and only those meet the pattern."""
    low = F.lower(line)
    return (F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("spdx"))) & unicode_rlike(line, LICENSE)


def is_code_like(line: Column) -> Column:
    t = F.trim(line)
    punct = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", ""))
    return F.when(t == "", False).otherwise(
        t.rlike(r"^(?:" + "|".join(map(re.escape, CODE_STARTS)) + r")|[;{}]$|=>|->|\);| = .*\(") | (punct / F.length(t) > 0.35)
    )


def clean_line(line: Column) -> Column:
    """A comment line without its delimiters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^(/\*+!?|\*+/|//[/!]*|#+!?|\*+|<!--)\s?", ""), r"\s*(\*+/|-->)$", ""))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-cased words, identifiers split at ``_`` and case boundaries; distinct, in first-seen order."""
    split = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(split, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def numbers(text: Column) -> Column:
    """Numbers that begin a word, distinct, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1))


def quoted(text: Column) -> Column:
    """What stands between quotation marks that don't follow a word, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(QUOTED), 1), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def mentions(text: Column) -> Column:
    """Back-ticked spans, then identifiers (calls, dotted, snake and camel case), distinct, first seen first."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([^`\s]+)`"), 1)
    ident = F.regexp_extract_all(
        text,
        # Fixed value: the pattern of an identifier in prose.
        F.lit(r"((?U)\b[A-Za-z_]\w*\(\)|\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|\b[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+\b|\b[a-z]+[A-Z]\w*)"),
        1,
    )
    keep = lambda m: (F.length(mention_key(m)) >= 3) & ~F.lower(mention_key(m)).isin(*STOP_WORDS)
    return F.array_distinct(F.filter(F.concat(ticked, ident), keep))


def mention_key(mention: Column) -> Column:
    return F.element_at(F.split(F.replace(mention, F.lit("()"), F.lit("")), r"\."), -1)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a))


def signature_echo(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def unit_literal(comment: Column, code: Column) -> Column:
    """What ties the first unit in a comment to the code's first number, or null."""
    word, after = F.regexp_extract(comment, UNIT_WORD, 0), F.trim(F.regexp_extract(comment, UNIT_AFTER_NUMBER, 0))
    unit, number = F.when(word != "", word).when(after != "", after), F.regexp_extract(code, NUMBER, 0)
    return F.when(unit.isNotNull() & (number != ""), F.concat(F.lit("unit "), unit, F.lit(" next to literal "), number))


def py_splitlines(text: Column) -> Column:
    parts = F.split(text, PY_LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def expand_tabs(line: Column, size: int = 8) -> Column:
    """A line's tabs as spaces up to the next multiple of ``size``: a fold over the pieces between tabs."""
    pieces = F.split(line, "\t", -1)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        return F.struct(F.concat(s["text"], piece, F.repeat(F.lit(" "), size - at % size)).alias("text"), (at + size - at % size).alias("at"))

    folded = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)
    return F.when(F.contains(line, F.lit("\t")), F.concat(folded["text"], F.element_at(pieces, -1))).otherwise(line)


def clean_doc(text: Column) -> Column:
    """A docstring without its indentation: tabs expanded, the first line's leading white space gone, the others'
    least indentation (in bytes, lines of white space alone left out) taken off, empty lines at both ends dropped."""
    left = lambda x: F.regexp_replace(x, r"(?U)\A\s+", "")
    rows = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(expand_tabs(x), r"\r+\z", ""))
    box = F.array(F.struct(rows.alias("r")))
    rest = lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))

    def dedent(x: Column) -> Column:
        others = rest(x["r"])
        margin = F.array_min(F.transform(F.filter(others, lambda y: left(y) != ""), lambda y: F.octet_length(y) - F.octet_length(left(y))))
        return F.struct(x["r"].alias("r"), margin.alias("m"))

    def cut(x: Column) -> Column:
        tail = lambda y: F.substring(F.encode(y, "utf-8"), x["m"] + 1, F.octet_length(y))
        short = lambda y: F.when(F.is_valid_utf8(tail(y)), F.decode(tail(y), "utf-8")).otherwise("")
        others = F.when(x["m"].isNull(), rest(x["r"])).otherwise(F.transform(rest(x["r"]), short))
        return F.concat(F.array(left(F.get(x["r"], F.lit(0)))), others)

    lines = F.element_at(F.transform(F.transform(box, dedent), cut), 1)
    return F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def split_of(key: Column) -> Column:
    """train, dev or test by SHA-1 mod 10: as 16 = 6 mod 10 and 6 * 6 = 6, only digit sums matter."""
    digits = F.transform(F.split(F.sha1(key), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    rest = (F.lit(6) * total(F.slice(digits, 1, 39)) + F.element_at(digits, 40)) % 10
    return F.when(rest <= 4, "train").when(rest <= 6, "dev").otherwise("test")


def is_dev(key: Column) -> Column:
    """SHA-1 mod 5 = 0; 16 = 1 mod 5, so the digit sum decides."""
    digits = F.transform(F.split(F.sha1(key), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(F.slice(digits, 1, 40), F.lit(0), lambda s, x: s + x) % 5 == 0


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over each part's byte length (8 bytes, little endian) and bytes."""
    framed = []
    for p in parts:
        data = F.encode(p, "UTF-8")
        big = F.unhex(F.lpad(F.hex(F.length(data).cast("long")), 16, "0"))
        framed += [F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)]), data]
    return F.sha2(F.concat(*framed), 256)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(ext.isin("py", "pyi"), "python").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").when(ext.isin("ts", "mts", "cts"), "typescript")
        .when(ext == "tsx", "tsx").when(ext.isin("yaml", "yml"), "yaml").when(ext == "rs", "rust")
    )


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__)/|(^|/)(test_[^/]*|conftest)\.py$|_test\.(py|rs)$|\.(test|spec)\.[jt]sx?$")


# Tool names in co-author trailers, and mail domains.
TOOLS = (("claude", "claude-code"), ("cursor", "cursor"), ("copilot", "copilot"), ("devin", "devin"), ("codex", "codex"), ("openai", "codex"))
AGENT_DOMAINS = (("anthropic.com", "claude-code"), ("cursor.sh", "cursor"), ("cursor.com", "cursor"), ("devin.ai", "devin"), ("openai.com", "codex"))


def agent_of_email(email: Column) -> Column:
    e = F.lower(F.trim(email))
    domain, local = F.substring_index(e, "@", -1), F.regexp_extract(e, "^(.*)@", 1)
    found = F.when((domain == "users.noreply.github.com") & F.contains(local, F.lit("copilot")), "copilot")
    for d, tool in AGENT_DOMAINS:
        found = found.when(domain == d, tool)
    return F.when(F.contains(e, F.lit("@")), found)


def agent_of(message: Column, author: Column, committer: Column) -> Column:
    """The tool behind a commit: a trailer's name, then the committer's, author's or a trailer's address."""
    trailers = F.filter(F.split(message, "\n"), lambda x: F.startswith(F.lower(x), F.lit("co-authored-by:")))
    names = F.transform(trailers, lambda x: F.lower(F.element_at(F.split(F.substring(x, 16, 10_000), "<"), 1)))

    def tool(n):
        found = F.when(F.contains(n, F.lit(TOOLS[0][0])), TOOLS[0][1])
        for word, name in TOOLS[1:]:
            found = found.when(F.contains(n, F.lit(word)), name)
        return found

    first = lambda a: F.try_element_at(F.array_compact(a), F.lit(1))
    mails = F.transform(trailers, lambda x: agent_of_email(F.regexp_extract(x, "<([^>]*)", 1)))
    return F.coalesce(first(F.transform(names, tool)), agent_of_email(committer), agent_of_email(author), first(mails))
