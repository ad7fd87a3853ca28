"""Predicates and classifications of paths and file names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that the rules are about.
SKIPPED_DIRS = (
    ".git node_modules target dist build __pycache__ .pycache vendor .next .nuxt coverage .cache .tox .venv .eggs .mypy_cache "
    ".ruff_cache .pytest_cache .turbo .parcel-cache .svelte-kit out .output .vercel .netlify .gradle .idea .scala-build .bloop .metals"
).split()
LANGUAGE_OF_EXTENSION = {
    "bash": "sh bash bats",
    "c": "c h",
    "cpp": "cpp hpp cc cxx",
    "csharp": "cs",
    "elixir": "ex exs",
    "go": "go",
    "java": "java",
    "javascript": "js jsx",
    "kotlin": "kt kts",
    "php": "php phtml",
    "python": "py pyi",
    "ruby": "rb",
    "rust": "rs",
    "scala": "scala sc",
    "swift": "swift",
    "tsx": "tsx",
    "typescript": "ts",
}
LANGUAGE_OF_NAME = {
    "bash": ".bashrc .bash_profile .bash_aliases .profile",
    "dockerfile": "Dockerfile Containerfile",
    "make": "Makefile GNUmakefile",
    "ruby": "Vagrantfile Rakefile",
}
MANIFESTS = "Cargo.toml package.json go.mod pyproject.toml setup.py pom.xml build.gradle build.sbt composer.json mix.exs".split()
KIND_OF_EXTENSION = {"markdown": "md mdx rst", "structured": "json yaml yml toml xml ini", "tabular": "csv tsv", "log": "log"}
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock composer.lock Gemfile.lock poetry.lock go.sum bun.lockb".split()
SECRET_NAMES = ".netrc .npmrc .pgpass .htpasswd".split()
SECRET_EXTENSIONS = "pem key p12 pfx pkcs12 keystore jks".split()
ENV_TEMPLATES = "example sample template dist defaults".split()
MIME = {
    "image/png": "png",
    "image/jpeg": "jpg jpeg",
    "image/gif": "gif",
    "image/svg+xml": "svg",
    "image/webp": "webp",
    "image/x-icon": "ico",
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/gzip": "gz tgz",
    "application/x-tar": "tar",
    "application/wasm": "wasm",
    "font/woff2": "woff woff2",
    "font/ttf": "ttf otf",
    "audio/mpeg": "mp3",
    "video/mp4": "mp4",
}
FIXTURE_DIRS = "mock mocks fixture fixtures stub stubs fake fakes example examples".split()
VENDOR_DIRS = "node_modules vendor dist build .git target __pycache__ .venv venv pkg out".split()
MOST_BYTES = 500_000
MINIFIED_FROM = 100_000


def inverted(table: dict[str, str]) -> dict[str, str]:
    """value -> key, of space separated values."""
    return {word: key for key, words in table.items() for word in words.split()}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small literal map, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Text after the last dot of the name, unless the name begins with that dot; null if there is none."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def any_part(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def in_skipped_dir(path: Column) -> Column:
    """Some directory above the file has a skipped name."""
    return any_part(parent(path), SKIPPED_DIRS)


def file_kind(path: Column) -> Column:
    """``code:<language>``, markdown, structured, tabular, log or other: by extension, or by name where there is none."""
    ext, name = extension(path), basename(path)
    by_ext = F.coalesce(F.concat(F.lit("code:"), lookup(ext, inverted(LANGUAGE_OF_EXTENSION))), lookup(ext, inverted(KIND_OF_EXTENSION)))
    by_name = F.coalesce(F.concat(F.lit("code:"), lookup(name, inverted(LANGUAGE_OF_NAME))), F.when(name.startswith(".env"), "structured"))
    return F.coalesce(F.when(ext.isNotNull(), by_ext).otherwise(by_name), F.lit("other"))


def mime_type(path: Column) -> Column:
    return F.coalesce(lookup(extension(path), inverted(MIME)), F.lit("application/octet-stream"))


def is_lock_file(path: Column) -> Column:
    return basename(path).isin(LOCK_FILES)


def is_minified_name(path: Column) -> Column:
    """``x.min.js`` (not ``.min.js``) or ``x-min.js``, in any case."""
    return basename(path).rlike(r"(?i)^(.+\.min|.*-min)\.[^.]*$")


def is_secret_name(path: Column) -> Column:
    """Names that commonly hold credentials or private keys; public keys and environment templates do not."""
    name = F.lower(basename(path))
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1))
    env = F.when(name == ".env", True).when(name.startswith(".env."), ~F.substr(name, F.lit(6)).isin(ENV_TEMPLATES))
    other = name.isin(SECRET_NAMES) | name.startswith("credentials") | F.coalesce(ext.isin(SECRET_EXTENSIONS), F.lit(False))
    return F.when(F.coalesce(ext == "pub", F.lit(False)), False).otherwise(F.coalesce(env, other | name.rlike("_(rsa|dsa|ecdsa|ed25519)")))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"\.test\.|\.spec\.|__tests__/")


def enters_walk(path: Column, size: Column) -> Column:
    """Files that a search looks into: not in a skipped directory, not minified by name, not over ``MOST_BYTES``."""
    return ~in_skipped_dir(path) & ~is_minified_name(path) & (size <= MOST_BYTES)


def estimated_lines(size: Column) -> Column:
    return F.greatest(F.floor(size / 40), F.lit(1)).cast("long")


def ancestors(path: Column) -> Column:
    """Every directory above a file, from the top, '' first."""
    above = F.split(parent(path), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(above)), lambda n: F.array_join(F.slice(above, F.lit(1), n), "/"))
    return F.when(parent(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), each))
