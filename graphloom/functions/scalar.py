"""Column functions: scores, tokens, paths, redaction. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifier tokens of scores, and secrets with what stands for them (fixed values).
TOKEN = "[A-Za-z_][A-Za-z0-9_]+"
SECRETS = [
    ("sk-[A-Za-z0-9]{20,}", "[REDACTED_OPENAI_KEY]"),
    ("AKIA[0-9A-Z]{16}", "[REDACTED_AWS_ACCESS_KEY]"),
    ("(?i)(api[_-]?key|token|secret)\\s*[:=]\\s*['\"][^'\"]+['\"]", '$1="[REDACTED]"'),
    ("(?s)-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
]
#: Suffixes and their languages (fixed values).
LANGUAGES = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}


def tokens(text: Column) -> Column:
    """Distinct lower-cased identifiers of two letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower))


def words(text: Column) -> Column:
    """Distinct tokens as a full-text index splits them: runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))


def _overlap(query: Column, other: Column) -> Column:
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, other)) / F.size(query))


def lexical_score(query: Column, name: Column, qualified_name: Column) -> Column:
    """N1."""
    q, n, qn = F.lower(F.trim(query)), F.lower(name), F.lower(qualified_name)
    return (
        F.when(q == "", F.lit(0.0))
        .when((q == n) | (q == qn), F.lit(1.0))
        .when(F.contains(n, q), F.lit(0.9))
        .when(F.contains(qn, q), F.lit(0.8))
        .otherwise(_overlap(tokens(q), F.array_union(tokens(name), tokens(qualified_name))))
    )


def structural_score(rank: Column, callers: Column, callees: Column) -> Column:
    """N3."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(rank, F.lit(0.0)), F.lit(0.0)) + 0.1 * F.log(1.0 + F.greatest(callers, zero) + F.greatest(callees, zero))


def semantic_score(query: Column, signature: Column, docstring: Column) -> Column:
    """N4."""
    return _overlap(tokens(query), tokens(F.concat_ws(" ", signature, docstring)))


def hybrid_score(lexical: Column, structural: Column, semantic: Column, hybrid: bool = True) -> Column:
    """N5; without ``hybrid`` only the structure counts."""
    return 0.55 * lexical + 0.35 * structural + 0.1 * semantic if hybrid else structural


def estimate_tokens(text: Column) -> Column:
    """N7."""
    n = F.octet_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3.5))).cast("bigint")


def relevance(terms: Column, name: Column, qualified_name: Column, signature: Column) -> Column:
    """Terms contained in name, qualified name or signature."""
    where = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, qualified_name, signature)]
    return F.size(F.filter(terms, lambda t: reduce(lambda a, b: a | b, [F.contains(w, t) for w in where])))


def context_score(ppr: Column, rank: Column, depth: Column, found: Column) -> Column:
    """N9."""
    near = F.when(depth == 0, 1.0).when(depth == 1, 0.7).when(depth == 2, 0.4).otherwise(0.25)
    return ppr * F.greatest(F.coalesce(rank, F.lit(0.0)), F.lit(1e-9)) * near * (1.0 + F.least(0.08 * found, F.lit(0.25)))


def redact(text: Column) -> tuple[Column, Column]:
    """The text without secrets, and how many were found; patterns apply one after the other."""
    hits = F.lit(0).cast("bigint")
    for pattern, instead in SECRETS:
        hits = hits + F.regexp_count(text, F.lit(pattern)).cast("bigint")
        text = F.regexp_replace(text, pattern, instead)
    return text, hits


def is_test_path(path: Column) -> Column:
    """F12."""
    p = F.lower(path)
    return F.contains(p, F.lit("/test")) | F.contains(p, F.lit("\\test")) | F.endswith(p, F.lit("_test.py"))


def entry_score(rank: Column, inbound: Column, outbound: Column, path: Column) -> Column:
    """N11."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    bonus = F.when(base.rlike("^(main|app|server|cli|index)"), F.lit(0.35)).otherwise(F.lit(0.0))
    return F.round(0.6 * rank + 0.25 * inbound + 0.1 * outbound + bonus, 6)


def hot_score(rank: Column, inbound: Column, outbound: Column) -> Column:
    """N12."""
    return F.round(2.0 * inbound + outbound + 10.0 * rank, 6)


def language_of(path: Column) -> Column:
    """S3."""
    suffix = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    found = F.lit(None).cast("string")
    for end, language in LANGUAGES.items():
        found = F.when(suffix == end, F.lit(language)).otherwise(found)
    return found


def module_name(path: Column) -> Column:
    """The path without suffix, its parts joined by dots."""
    parts = F.filter(F.split(F.regexp_replace(path, "\\.[^./]*$", ""), "/"), lambda p: ~p.isin("", "."))
    return F.array_join(parts, ".")


def visibility(name: Column, language: Column) -> Column:
    """N14."""
    return F.when(language == "go", F.when(name.rlike("^[A-Z]"), "public").otherwise("private")).when(F.startswith(name, F.lit("_")), "private").otherwise("public")


def type_tokens(name: Column) -> Column:
    """The lower-cased name and its last segments by '.', '::' and '/'."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    last = [F.element_at(F.split(n, s), -1) for s in ("\\.", "::", "/")]
    return F.array_distinct(F.filter(F.array(n, *last), lambda t: t != ""))


def method_owner(qualified_name: Column) -> Column:
    """The last but one segment, or nothing."""
    parts = F.split(qualified_name, "\\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def fallback_id(text: Column) -> Column:
    """N19."""
    return F.crc32(text.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))


def normal_path(path: Column) -> Column:
    """N20: '.' and '..' are resolved."""
    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def signature_hash(signature: Column) -> Column:
    """N21."""
    return F.sha2(F.coalesce(signature, F.lit("")).cast("binary"), 256)


def repo_id(path: Column) -> Column:
    """Sixteen hex digits of the path's hash."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def symbol_uri(repo: Column, qualified_name: Column, path: Column, scheme: str = "graph") -> Column:
    """``scheme://repo/qualified_name#path``."""
    return F.concat(F.lit(f"{scheme}://"), repo, F.lit("/"), qualified_name, F.lit("#"), path)


def parse_symbol_uri(uri: Column) -> Column:
    """Its three parts, each null if the text is no such URI."""
    part = lambda i: F.nullif(F.regexp_extract(uri, "^[a-z]+://([^/]+)/([^#]+)#(.*)$", i), F.lit(""))
    return F.struct(part(1).alias("repo_id"), part(2).alias("qualified_name"), part(3).alias("file_path"))


def glob_regex(pattern: str) -> str:
    """F8: ``*`` crosses slashes, ``?`` is one character, ``[...]`` a set."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
        i += 1
    return f"(?s)^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """On the whole path or its last part."""
    regex = glob_regex(pattern)
    return path.rlike(regex) | F.element_at(F.split(path, "/"), -1).rlike(regex)


#: What a failed stage is called (fixed values).
ERROR_CATEGORIES = {"FileNotFoundError": "file_not_found", "PermissionError": "permission_denied", "OSError": "io_error", "SyntaxError": "syntax_error"}
STAGE_CATEGORIES = {"extract": "extractor_failure", "import_resolve": "import_resolution_failure", "callgraph": "callgraph_failure", "pagerank": "pagerank_failure"}


def diagnostic_category(stage: Column, error: Column) -> Column:
    """A failure's category, from the exception's name if that says enough, else from the stage."""
    found = F.when(F.startswith(stage, F.lit("store_")), F.lit("database_write_failure")).otherwise(F.lit("unexpected_error"))
    for column, names in ((stage, STAGE_CATEGORIES), (error, ERROR_CATEGORIES)):
        for name, category in names.items():
            found = F.when(column == name, F.lit(category)).otherwise(found)
    return found


def risk(direct: Column, transitive: Column, types: Column | None = None) -> Column:
    """A10: blast radius counts two kinds of dependents, change impact three."""
    total = direct + transitive + (F.lit(0) if types is None else types)
    high, medium = (10, 3) if types is None else (12, 4)
    return F.when(total >= high, "high").when(total >= medium, "medium").otherwise("low")
