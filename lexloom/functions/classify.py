"""What kind of text a file holds, and which files must stay where they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonx
from .spaces import blank, stripped

# Extensions, code patterns, sensitive names.
PROSE = (".md", ".txt", ".markdown", ".rst", ".typ", ".typst", ".tex")
CONFIG = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env")
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".lock", ".css", ".scss", ".html", ".xml", ".sql", ".sh", ".bash", ".zsh", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".swift", ".kt", ".lua", ".dockerfile", ".makefile", ".csv")
CODE_LINE = "^\\s*(?:(?:import |from .+ import |require\\(|const |let |var )|(?:def |class |function |async function |export )|(?:if\\s*\\(|for\\s*\\(|while\\s*\\(|switch\\s*\\(|try\\s*\\{)|[\\}\\]\\);]+\\s*$|@\\w+|\"[^\"]+\"\\s*:\\s*|\\w+\\s*=\\s*[{\\[\\(\"'])"
YAML_LINE = "^(?:---|\\w[\\w\\s]*:\\s|- .*:)"
SENSITIVE_NAME = "(?i)^(?:\\.env(\\..+)?|\\.netrc|credentials(\\..+)?|secrets?(\\..+)?|passwords?(\\..+)?|id_(rsa|dsa|ecdsa|ed25519)(\\.pub)?|authorized_keys|known_hosts|.*\\.(pem|key|p12|pfx|crt|cer|jks|keystore|asc|gpg))$"
SENSITIVE_PARTS = (".ssh", ".aws", ".gnupg", ".kube", ".docker")
SENSITIVE_TOKENS = ("secret", "credential", "password", "passwd", "apikey", "accesskey", "token", "privatekey")
LIMIT_BYTES = 500_000


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dotted part with its dot, lower case; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(file_name(path), ".(\\.[^.]+)$", 1))


def by_extension(ext: Column) -> Column:
    return F.when(ext.isin(*PROSE), "natural_language").when(ext.isin(*CONFIG), "config").when(ext.isin(*CODE), "code").when(ext != "", "unknown")


def head(text: Column, lines: int) -> Column:
    return F.slice(F.split(text, "\n"), 1, lines)


def is_json(text: Column) -> Column:
    """Whether the first 10,000 characters parse whole."""
    return jsonx.valid(F.substring(text, 1, 10_000))


def share(lines: Column, hit) -> Column:
    """The share of lines with a solid character that are hits; 0 without any."""
    solid = F.size(F.filter(lines, lambda x: ~blank(x)))
    return F.when(solid > 0, F.size(F.filter(lines, hit)) / solid).otherwise(0.0)


def is_yaml(text: Column) -> Column:
    return share(head(text, 30), lambda x: stripped(x).rlike(YAML_LINE)) > 0.6


def is_code(text: Column) -> Column:
    return share(head(text, 50), lambda x: x.rlike(CODE_LINE)) > 0.4


def kind_of(path: Column, text: Column) -> Column:
    """By extension; without one by content: JSON, YAML, code, else prose. A text that is null is unknown."""
    content = F.when(text.isNull(), "unknown").when(is_json(text) | is_yaml(text), "config").when(is_code(text), "code").otherwise("natural_language")
    return F.coalesce(by_extension(extension(path)), content)


def is_sensitive(path: Column) -> Column:
    name = file_name(path)
    plain = F.regexp_replace(F.lower(name), "[_\\-\\s.]", "")
    inside = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(x) for x in SENSITIVE_PARTS)))
    return name.rlike(SENSITIVE_NAME) | inside | plain.rlike("|".join(SENSITIVE_TOKENS))


def wants_compression(path: Column, text: Column) -> Column:
    return (kind_of(path, text) == "natural_language") & ~path.endswith(".original.md")


def refusal(path: Column, text: Column, candidate: Column) -> Column:
    """Why a text is left alone, in the order of the checks, or null."""
    return (
        F.when(F.octet_length(text) > LIMIT_BYTES, "too large")
        .when(is_sensitive(path), "sensitive path")
        .when(~wants_compression(path, text), "not natural language")
        .when(blank(text), "empty input")
        .when(blank(F.coalesce(candidate, F.lit(""))), "empty output")
        .when(stripped(candidate) == stripped(text), "identical output")
    )
