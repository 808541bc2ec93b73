"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def secrets(text: str | None) -> dict:
    text = text or ""
    kinds = [
        ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    base = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    more = []
    allow = re.compile(r"^(?:[A-Za-z]+|[0-9]+|[-_=+/]+|[A-Za-z]+(?:[-_/][A-Za-z]+)*|.*(?i:example|placeholder|changeme|lorem).*)$")
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = ((digits + "abcdef", 3.0), (digits + "ABCDEF", 3.0), (low + digits, 3.5), (up + digits, 3.4), (None, 3.7))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        best = dict.fromkeys(range(len(classes)), False)
        for k, (alphabet, least) in enumerate(classes):
            for i in range(len(m[0]) - 19):
                w = m[0][i : i + 20]
                if alphabet is None or all(c in alphabet for c in w):
                    h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
                    best[k] |= h >= least - 1e-9
        if any(best.values()) and not allow.match(m[0]):
            more.append((m.start(), 3, f"entropy:{m.start()}:{m.end()}"))
    return {
        **{f"n_{k}": sum(x[1] == i for x in base) for i, (k, _, _) in enumerate(kinds)},
        "base_sha256": sha(",".join(x[2] for x in sorted(base))),
        "spans": ",".join(x[2] for x in sorted(base + more)),
    }
