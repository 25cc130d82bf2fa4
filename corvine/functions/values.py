"""Names and extensions that decide how a path is treated."""

from __future__ import annotations

# Directories that are never entered.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", ".next", ".turbo", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__", ".venv", "venv",
    ".env", "dist", "build", "out", "target", "coverage", "vendor", ".idea", ".vscode", ".gradle", ".bundle", ".DS_Store",
]

# Files that are never indexed.
SKIP_FILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock", "composer.lock", "Pipfile.lock", "poetry.lock", "Cargo.lock",
    "Gemfile.lock", "uv.lock", "Podfile.lock", "mix.lock", ".DS_Store", "Thumbs.db",
]

# Base names that may hold secrets, without case.
SECRET_NAMES = (
    r"^\.env(\..+)?$",
    r"\.pem$",
    r"\.key$",
    r"\.crt$",
    r"\.p12$",
    r"\.pfx$",
    r"^credentials.*$",
    r"^id_rsa.*$",
    r"^id_ed25519.*$",
    r"^id_ecdsa.*$",
    r"^id_dsa.*$",
    r"^\.netrc$",
    r"^\.npmrc$",
    r"^\.pypirc$",
)

# Extensions of binary files.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "tif", "tiff", "avif", "svg", "mp4", "mov", "mkv", "webm", "avi", "wmv", "mp3", "wav", "ogg",
    "flac", "m4a", "zip", "tar", "gz", "tgz", "bz2", "7z", "rar", "xz", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "ttf", "otf", "woff",
    "woff2", "eot", "exe", "dll", "so", "dylib", "a", "o", "obj", "class", "jar", "war", "wasm", "pyc", "pyo", "bin", "onnx", "pt", "ckpt",
    "safetensors", "h5", "pb", "pack", "idx",
]

# The language of an extension.
EXTENSION_LANGUAGE = {
    "ts": "typescript",
    "tsx": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "pyi": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "kts": "kotlin",
    "scala": "scala",
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "cs": "csharp",
    "fs": "fsharp",
    "rb": "ruby",
    "php": "php",
    "swift": "swift",
    "html": "html",
    "htm": "html",
    "css": "css",
    "scss": "scss",
    "less": "less",
    "json": "json",
    "jsonc": "json",
    "yml": "yaml",
    "yaml": "yaml",
    "toml": "toml",
    "xml": "xml",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "fish": "shell",
    "ps1": "powershell",
    "md": "markdown",
    "mdx": "markdown",
    "rst": "restructuredtext",
    "sql": "sql",
    "proto": "protobuf",
    "graphql": "graphql",
    "gql": "graphql",
    "vue": "vue",
    "svelte": "svelte",
    "dart": "dart",
    "ex": "elixir",
    "exs": "elixir",
    "erl": "erlang",
    "hs": "haskell",
    "lua": "lua",
    "r": "r",
    "jl": "julia",
}

# Names without an extension that still have a language.
NAME_LANGUAGE = {
    "dockerfile": "dockerfile",
    "makefile": "make",
    "rakefile": "ruby",
    "gemfile": "ruby",
    "procfile": "config",
    ".gitignore": "config",
    ".dockerignore": "config",
    ".prettierrc": "json",
    ".eslintrc": "json",
}

# Kinds and labels of a status.
STATUS_KIND = {"queued": "queued", "cloning": "running", "parsing": "running", "embedding": "running", "indexing": "running", "done": "ready", "ready": "ready", "failed": "failed"}
STATUS_LABEL = {"queued": "Queued", "cloning": "Cloning", "parsing": "Parsing", "embedding": "Embedding", "indexing": "Indexing", "done": "Ready", "ready": "Ready", "failed": "Failed"}

# Topics of the help responder: the first rule with a word found in the lower-cased text wins.
HELP_RULES = (
    ("index", ("index",)),
    ("search", ("search",)),
    ("chat", ("chat",)),
    ("architecture", ("architecture",)),
    ("error", ("error",)),
    ("guide", ("guide",)),
    ("help", ("help", "what can")),
    ("greeting", ("hello", "hi", "hey")),
)
HELP_DEFAULT = "unknown"
