"""File paths: hidden parts, source types, languages of code, exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension, languages by extension and name, what is never indexed.
SOURCE_TYPES = {
    "md": "markdown", "pdf": "pdf", "docx": "docx", "dotx": "docx", "html": "html", "htm": "html", "txt": "plaintext", "csv": "plaintext",
    "json": "plaintext", "yaml": "plaintext", "yml": "plaintext", "epub": "epub",
}
LANGUAGES = {
    "py": "python", "go": "go", "tf": "hcl", "tfvars": "hcl", "hcl": "hcl", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript",
    "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "sh": "bash", "bash": "bash",
    "yaml": "yaml", "yml": "yaml", "json": "plaintext", "txt": "plaintext", "csv": "plaintext", "md": "markdown", "rst": "plaintext", "toml": "toml",
    "sql": "sql", "xml": "plaintext", "html": "html", "htm": "html", "css": "css", "scss": "plaintext",
}
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "plaintext"}
EXCLUDED_NAMES = (".DS_Store", ".terraform.lock.hcl", "go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock")
EXCLUDED_DIRS = (".idea", ".vscode", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", "dist", "build", ".egg-info", "vendor", ".terraform", "cdk.out")
VAULT_SKIP = (".obsidian", ".trash", ".git")


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text behind the last dot of the name, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def is_hidden(path: Column) -> Column:
    """Whether any component of the path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def source_type(path: Column) -> Column:
    return F.coalesce(_map(SOURCE_TYPES)[extension(path)], F.lit(""))


def code_language(path: Column) -> Column:
    return F.coalesce(_map(LANGUAGE_NAMES)[base_name(path)], _map(LANGUAGES)[extension(path)], F.lit(""))


def is_excluded(path: Column) -> Column:
    return base_name(path).isin(*EXCLUDED_NAMES) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))


def is_indexable_code(path: Column) -> Column:
    return ~is_excluded(path) & (code_language(path) != "")


def skipped_in_vault(relative: Column, folders: list[str] | None = None) -> Column:
    """Paths below a vault that are left out: its own folders, named folders, anything hidden."""
    names = [*VAULT_SKIP, *(folders or [])]
    parts = F.split(relative, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, names))) | is_hidden(relative)
