"""Secret redaction: ordered patterns, then key-value pairs, hex and base64 runs.

Patterns run in the JVM as a chain of regular-expression replacements. The three rules that look at the matched value
(quoted pair, unquoted pair, base64 run) need code per match and run in one Arrow-batched pandas UDF; only
texts that could match reach it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds and shapes of credentials, in the order in which they are replaced.
PATTERNS = [
    ("pem", r"(?s)-----BEGIN [^-]+-----.*?-----END [^-]+-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("conn-string", r"(?i)[a-z][a-z0-9+.\-]*://[^\s:/@]+:[^\s]+@(?=(?:\[[^\]\s]+\]|[^\s/?#:@]+)(?::\d+)?(?:[/?#\s),;]|$))"),
    ("openrouter", r"sk-or-v1-[a-f0-9]+"),
    ("provider-secret", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("api-key", r"sk-[A-Za-z0-9_-]{16,}"),
    ("aws", r"AKIA[A-Z0-9]{16}"),
    ("github-pat", r"\bgithub_pat_[A-Za-z0-9_]{40,}"),
    ("github", r"gh[posru]_[A-Za-z0-9]{36,}"),
    ("gcp", r"AIza[A-Za-z0-9_-]{35}"),
    ("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("slack-app", r"xapp-[0-9]-[A-Za-z0-9-]{20,}"),
    ("npm", r"npm_[A-Za-z0-9]{36}"),
    ("pypi", r"pypi-AgEIcHlwaS[A-Za-z0-9_-]{16,}"),
    ("cloudflare", r"cfat_[A-Za-z0-9]{20,}"),
    ("bearer", r"Bearer\s+[A-Za-z0-9._~+/-]{20,}"),
    ("basic-auth", r"Basic\s+[A-Za-z0-9+/]{16,}={0,2}"),
]
KEYWORDS = r"(?:password|passwd|secret|token|credential|api_key|apikey|_key)"
HEX = r"\b[a-fA-F0-9]{40,}\b"
# Shapes that point to a secret without holding it.
POINTERS = r"(?:op://[^\s,=]+|(?i:vault)(?:://|:)[^\s,=]+|(?i:keyring)://[^\s,=]+|\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*|<[^<>\s]+>)"
SEGMENT, FINGERPRINT = 16, 43

_POINTER = re.compile(POINTERS)
_QUOTED = re.compile(rf"""(?is)\b(\w*{KEYWORDS}\w*)(["']?\s*[=:]\s*)(["'])((?:\\.|(?!\3)[^\\])*)\3""")
_PAIR = re.compile(rf"""(?i)\b(\w*{KEYWORDS}\w*)(["']?\s*[=:]\s*)(?!["'])(\S{{8,}})""")
_HEX = re.compile(HEX)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])")
_CLOSERS = "\"'`,;)]}>"


def _quoted(m: re.Match) -> str:
    key, sep, quote, value = m.groups()
    keep = len(value.strip()) < 8 or _POINTER.fullmatch(value)
    return m[0] if keep else f"{key}{sep}{quote}[REDACTED:value]{quote}"


def _pair(m: re.Match) -> str:
    value = m[3]
    body = value.rstrip(_CLOSERS)
    if _POINTER.fullmatch(value) or not body or _POINTER.fullmatch(body):
        return m[0]
    return f"{m[1]}{m[2]}[REDACTED:value]{value[len(body):]}"


def _run(m: re.Match) -> str:
    """Base64 runs go, except key fingerprints (43 characters after SHA256:) and runs that read as paths."""
    run = m[0]
    if len(run) == FINGERPRINT and "=" not in run and m.string[: m.start()].endswith("SHA256:"):
        return run
    path = "/" in run and "+" not in run and "=" not in run and max(map(len, run.split("/"))) < SEGMENT
    return run if path else "[REDACTED:base64]"


def conditional(text: str) -> str:
    """The rules that depend on the value, in order."""
    return _BASE64.sub(_run, _HEX.sub("[REDACTED:hex]", _PAIR.sub(_pair, _QUOTED.sub(_quoted, text))))


@F.pandas_udf(T.StringType())
def _conditional(texts: pd.Series) -> pd.Series:
    return texts.map(conditional, na_action="ignore")


def scrub_patterns(c: Column) -> Column:
    """The patterns alone."""
    for kind, pattern in PATTERNS:
        c = F.regexp_replace(c, pattern, f"[REDACTED:{kind}]")
    return c


def scrub(c: Column) -> Column:
    """All rules. The pre-test is wider than the conditional rules, so it only saves texts that none can match."""
    c = scrub_patterns(c)
    maybe = c.rlike(rf"(?i){KEYWORDS}|[A-Za-z0-9+/]{{40}}")
    return F.coalesce(_conditional(F.when(maybe, c)), c)


def scrub_tree(payload: str) -> str:
    """String leaves of a JSON document."""

    def walk(x):
        if isinstance(x, str):
            for kind, pattern in PATTERNS:
                x = re.sub(pattern, f"[REDACTED:{kind}]", x)
            return conditional(x)
        if isinstance(x, list):
            return [walk(y) for y in x]
        return {k: walk(y) for k, y in x.items()} if isinstance(x, dict) else x

    return json.dumps(walk(json.loads(payload)), ensure_ascii=False)
