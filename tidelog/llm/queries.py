"""The registered queries of this subpackage and their SQL."""

from . import chat, decontaminate, dedup, html, near, pack, secrets, spans, toxicity, urls

MODULES = (secrets, dedup, spans, chat, urls, html, toxicity, near, decontaminate, pack)
SQL = {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
QUERIES = {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}
