"""Reports inside alignment headers: JSON, base64, chunks in comment lines."""

from __future__ import annotations

import base64
import json
import re

PREFIX = "krak:report:"  # fixed value of the format
CHUNK = 60 * 1024
#: Keys of an entry in order.
KEYS = ("pct_fragments", "num_fragments_clade", "num_fragments_direct", "rank_code", "taxon_id", "name", "indent", "minimizer_count", "distinct_minimizer_count")


def to_comments(entries: list[dict]) -> list[str]:
    """Comment texts that hold the entries; one at least."""
    text = base64.b64encode(json.dumps([{k: e.get(k) for k in KEYS} for e in entries], separators=(",", ":")).encode()).decode()
    parts = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)] or [""]
    return [f"{PREFIX}{k}/{len(parts)}:{p}" for k, p in enumerate(parts, 1)]


def parse_chunk(body: str) -> tuple[int, int, str]:
    m = re.fullmatch(r"(\d+)/(\d+):(.*)", body, re.DOTALL)
    if not m:
        return 1, 1, body
    index, total = int(m[1]), int(m[2])
    if not 0 < index <= total:
        raise ValueError(f"embedded report chunk {index}/{total} is out of range")
    return index, total, m[3]


def from_header(header: list[str]) -> list[dict] | None:
    """The entries in a header's @CO lines; None if there are none. Chunks must be complete, single and of one report."""
    bodies = [c[len(PREFIX) :] for line in header if line.startswith("@CO\t") and (c := line[4:]).startswith(PREFIX)]
    if not bodies:
        return None
    chunks = [parse_chunk(b) for b in bodies]
    totals = {t for _, t, _ in chunks}
    if len(totals) > 1:
        raise ValueError("embedded report chunks have different totals")
    total = totals.pop()
    if len(chunks) > total:
        raise ValueError("more embedded report chunks than their total says: is the report embedded twice?")
    seen = [k for k, _, _ in chunks]
    if len(set(seen)) < len(seen):
        raise ValueError("duplicate embedded report chunk")
    if missing := set(range(1, total + 1)) - set(seen):
        raise ValueError(f"missing embedded report chunks {sorted(missing)}")
    data = json.loads(base64.b64decode("".join(p for _, _, p in sorted(chunks)), validate=True))
    return [{k: e.get(k) if k.endswith("minimizer_count") else e[k] for k in KEYS} for e in data]
