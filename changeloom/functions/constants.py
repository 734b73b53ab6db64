"""Fixed values.  They must equal the published behaviour for results to agree."""

from __future__ import annotations

# File extension -> language.
EXTENSION_LANGUAGE = {
    ".py": "python", ".pyx": "python", ".pyi": "python",
    ".java": "java", ".kt": "kotlin", ".gradle": "java",
    ".lisp": "common-lisp", ".lsp": "common-lisp", ".cl": "common-lisp", ".asd": "common-lisp",
    ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".edn": "clojure",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby",
    ".rs": "rust",
    ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".go": "go",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp",
    ".ex": "elixir", ".exs": "elixir", ".hs": "haskell",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".el": "emacs-lisp", ".vim": "vim", ".lua": "lua", ".nix": "nix",
    ".scala": "scala", ".sbt": "scala", ".swift": "swift", ".ml": "ocaml", ".mli": "ocaml",
}

# Well-known file name (lower case) -> language.
FILE_NAME_LANGUAGE = {
    "cargo.toml": "rust", "cargo.lock": "rust",
    "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "kotlin",
    "gemfile": "ruby", "rakefile": "ruby",
    "setup.py": "python", "pyproject.toml": "python", "requirements.txt": "python",
    "project.clj": "clojure", "deps.edn": "clojure",
    "package.json": "javascript", "yarn.lock": "javascript",
    "go.mod": "go", "go.sum": "go", "flake.nix": "nix", "mix.exs": "elixir",
    "stack.yaml": "haskell", "cabal.project": "haskell",
}

# URL prefixes, removed one after the other in this order.
URL_PREFIXES = ["https://", "http://", "git@", "ssh://git@", "ssh://"]

# Preferred remotes and branches, best first.
REMOTE_PRIORITY = ["origin", "upstream"]
BRANCH_PRIORITY = ["HEAD", "main", "master", "trunk", "develop", "stable", "production"]

# Noise files for labelling (path, kind, body).
LABEL_NOISE = [
    (".DS_Store", "binary", None),
    ("src/.DS_Store", "binary", None),
    ("__pycache__/main.cpython-311.pyc", "binary", None),
    ("src/__pycache__/utils.cpython-311.pyc", "binary", None),
    (".pytest_cache/v/cache/lastfailed", "text", "{}"),
    (".pytest_cache/README.md", "text", "# pytest cache\n"),
    ("main.py.swp", "binary", None),
    (".idea/workspace.xml", "text", '<project version="4"/>\n'),
    (".vscode/settings.json", "text", '{"editor.formatOnSave": true}\n'),
    ("dist/bundle.js.map", "binary", None),
    ("target/debug/incremental/.fingerprint", "binary", None),
    (".env.local", "text", "NEXT_PUBLIC_API_URL=http://localhost:3000\nDEBUG=true\n"),
    ("secrets.env", "text", "API_KEY=development_only_do_not_commit\n"),
    ("npm-debug.log", "text", "0 verbose cli /usr/local/bin/npm\n"),
    ("yarn-error.log", "text", "error An unexpected error occurred.\n"),
    ("Thumbs.db", "binary", None),
    ("desktop.ini", "text", "[.ShellClassInfo]\nIconResource=folder.ico\n"),
]

# Noise files for augmentation (path, kind, body, ignore pattern).
AUGMENT_NOISE = [
    (".DS_Store", "binary", None, ".DS_Store"),
    ("src/.DS_Store", "binary", None, ".DS_Store"),
    ("__pycache__/main.cpython-311.pyc", "binary", None, "__pycache__/"),
    ("src/__pycache__/utils.cpython-311.pyc", "binary", None, "__pycache__/"),
    (".pytest_cache/v/cache/lastfailed", "text", "{}", ".pytest_cache/"),
    (".pytest_cache/README.md", "text", "# pytest cache\n", ".pytest_cache/"),
    ("main.py.swp", "binary", None, "*.swp"),
    (".idea/workspace.xml", "text", '<project version="4"/>\n', ".idea/"),
    (".vscode/settings.json", "text", '{"editor.formatOnSave": true}\n', ".vscode/"),
    ("dist/bundle.js.map", "binary", None, "*.map"),
    (".env.local", "text", "NEXT_PUBLIC_API_URL=http://localhost:3000\nDEBUG=true\n", ".env.local"),
    ("secrets.env", "text", "API_KEY=dev_only_do_not_commit\n", "*.env"),
    ("npm-debug.log", "text", "0 verbose cli /usr/local/bin/npm\n", "npm-debug.log"),
    ("yarn-error.log", "text", "error An unexpected error occurred.\n", "yarn-error.log"),
    ("Thumbs.db", "binary", None, "Thumbs.db"),
    ("desktop.ini", "text", "[.ShellClassInfo]\nIconResource=folder.ico\n", "desktop.ini"),
]

# Globs of machine-generated files.
GENERATED_GLOBS = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock", "Gemfile.lock",
    "composer.lock", "Pipfile.lock", "go.sum", "flake.lock",
    "*.min.js", "*.min.css", "*.bundle.js",
    "*.tfstate", "*.tfstate.backup",
]

# Limits.
MIN_REPO_COMMITS = 10
FIRST_PARENT_CAP = 500
COMMIT_POOL_CAP = 5000
MAX_FILES = 20
MAX_DIFF_CHARS = 200_000
MAX_PROMPT_DIFF_CHARS = 30_000
NOISE_PROBABILITY = 0.3
MAX_ATTEMPTS = 3
FILE_DIFF_CHARS = 6_000
TOTAL_DIFF_CHARS = 120_000
UNTRACKED_CHARS = 50
BINARY_CHARS = 30
PRIOR_SUMMARIES = 4
MAX_MATCHES = 50
READ_FILE_CHARS = 50_000
CONTEXT_LINES = 3
SUMMARY_TOKENS = 125
RECENT_TOOL_TOKENS = 2_500
TRUNCATED_SUMMARY_CHARS = 512
SEQUENCE_TOKENS = 8192
