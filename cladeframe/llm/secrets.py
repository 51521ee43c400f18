"""Secret scans with probabilistic automata inferred from labelled credentials (operator 1)."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm._common import in_slices

#: The base patterns of the contract, in the order of the kinds, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates of the method: unbroken runs of credential characters.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}", re.ASCII)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*?-----END [A-Z ]*PRIVATE KEY-----", re.ASCII)
LEAST = 16

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
_HEXA = "0123456789abcdef"
_SYMBOL = {c: "9" for c in _DIGIT} | {c: "a" if c in "aeiou" else "b" for c in _LOWER} | {c: "A" if c in "AEIOU" else "B" for c in _UPPER}
#: Public credential formats as (prefix, alphabet, lengths, suffix): the labelled credentials are drawn from them.
FORMATS = (
    ("ghp_", _ALNUM, (36,), ""), ("gho_", _ALNUM, (36,), ""), ("ghs_", _ALNUM, (36,), ""), ("ghu_", _ALNUM, (36,), ""),
    ("github_pat_", _ALNUM + "_", (82,), ""), ("glpat-", _ALNUM + "_-", (20,), ""), ("npm_", _ALNUM, (36,), ""),
    ("pypi-AgEIcHlwaS5vcmc", _ALNUM + "_-", (60, 100, 140), ""), ("sk_live_", _ALNUM, (24, 34, 99), ""), ("sk_test_", _ALNUM, (24, 34, 99), ""),
    ("rk_live_", _ALNUM, (24, 34), ""), ("pk_live_", _ALNUM, (24, 34), ""), ("AIza", _ALNUM + "_-", (35,), ""), ("ya29.", _ALNUM + "_-", (60, 100, 140), ""),
    ("xoxb-", _DIGIT, (12,), "-|d12|-|a24"), ("xoxp-", _DIGIT, (12,), "-|d12|-|d12|-|h32"), ("SG.", _ALNUM + "_-", (22,), ".|b43"),
    ("eyJ", _ALNUM + "_-", (17, 33, 45), ".eyJ|b60|.|b43"), ("sk-", _ALNUM, (48,), ""), ("sk-proj-", _ALNUM + "_-", (48, 80, 120), ""), ("hf_", _ALNUM, (34,), ""), ("dop_v1_", _HEXA, (64,), ""),
    ("shpat_", _HEXA, (32,), ""), ("key-", _HEXA, (32,), ""), ("SK", _HEXA, (32,), ""), ("AC", _HEXA, (32,), ""), ("ASIA", _UPPER + "234567", (16,), ""),
    ("EAACEdEose0cBA", _ALNUM, (60, 100), ""), ("", _ALNUM + "+/", (40,), ""), ("", _ALNUM, (20, 24, 32, 40, 50), ""), ("", _LOWER + _DIGIT, (20, 24, 32, 40), ""), ("", _UPPER + _DIGIT, (20, 32), ""), ("", _ALNUM + "+/", (43, 86), "="), ("", _ALNUM + "+/", (64,), ""),
)
SAMPLES, SEED = 120, 20240611
#: Characters that a fixed beginning may have.
LONGEST_HEAD = 40


def labelled_credentials(samples: int = SAMPLES, seed: int = SEED, formats: tuple = FORMATS) -> list[str]:
    """A bounded labelled sample: for each public format so many credentials, the same on each run."""
    draw = random.Random(seed)
    pools = {"d": _DIGIT, "a": _ALNUM, "h": _HEXA, "b": _ALNUM + "_-"}
    text = lambda pool, n: "".join(draw.choice(pool) for _ in range(n))
    out = []
    for prefix, pool, lengths, suffix in formats:
        for k in range(samples):
            tail = "".join(text(pools[p[0]], int(p[1:])) if re.fullmatch(r"[dahb]\d+", p) else p for p in suffix.split("|")) if suffix else ""
            out.append(prefix + text(pool, lengths[k % len(lengths)]) + tail)
    return out


def symbol(c: str) -> str:
    """Characters as the automata see them beyond a format's head: vowels, consonants and digits by class."""
    return _SYMBOL.get(c, c)


def inferred_heads(samples: list[str], least: int) -> frozenset[str]:
    """Fixed beginnings of the formats, told by the prefix tree of the samples.

    A prefix is fixed where so many samples share it and so many go on from it in ways that fewer share: there the
    fixed part ends and the random part begins.
    """
    count: Counter = Counter(s[:k] for s in samples for k in range(1, min(len(s), LONGEST_HEAD) + 1))
    stay: Counter = Counter()
    for prefix, n in count.items():
        if n >= least:
            stay[prefix] += n
            stay[prefix[:-1]] -= n
    return frozenset(p for p, n in stay.items() if p and n >= least)


def encode(token: str, heads: frozenset[str]) -> tuple[str, ...]:
    """The longest inferred head as it is, or a mark of what kinds of characters a token without one mixes, then classes."""
    n = next((k for k in range(min(LONGEST_HEAD, len(token)), 0, -1) if token[:k] in heads), 0)
    rest = [symbol(c) for c in token[n:]]
    kinds = {"l" if c in "ab" else "U" if c in "AB" else c if c == "9" else "" for c in rest}
    return (*token[:n], "|" if n else "|" + "".join(sorted(kinds)), *rest)


class Automaton:
    """A probabilistic deterministic finite automaton by state merging (the public ALERGIA method)."""

    def __init__(self, samples: list[tuple[str, ...]], alpha: float = 0.1):
        self.count: dict[int, int] = defaultdict(int)
        self.final: dict[int, int] = defaultdict(int)
        self.next: dict[int, dict[str, int]] = defaultdict(dict)
        self.flow: dict[int, Counter] = defaultdict(Counter)
        made = 1
        for s in samples:
            at = 0
            for c in s:
                self.count[at] += 1
                self.flow[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = made
                    made += 1
                at = self.next[at][c]
            self.count[at] += 1
            self.final[at] += 1
        self.next = defaultdict(dict, {k: dict(sorted(v.items())) for k, v in self.next.items()})
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.symbols = len({c for f in self.flow.values() for c in f}) + 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.count[a], self.count[b]
            if nb <= self.bound**2:  # b is in the tree: neither it nor what is below has the counts to differ from anything
                continue
            if self._differ(self.final[a], na, self.final[b], nb):
                return False
            for c in {*self.flow[a], *self.flow[b]}:
                if self._differ(self.flow[a][c], na, self.flow[b][c], nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, to in self.next[b].items():
                self.flow[a][c] += self.flow[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red, known = [0], {0}
        while (step := next(((r, c) for r in red for c, to in self.next[r].items() if to not in known), None)) is not None:
            parent, c = step
            at = self.next[parent][c]
            for r in red:
                if self._compatible(r, at):
                    self.next[parent][c] = r
                    self._fold(r, at)
                    break
            else:
                red.append(at)
                known.add(at)
        for table in (self.count, self.final, self.next, self.flow):
            for k in [k for k in table if k not in known]:
                del table[k]

    def score(self, s: tuple[str, ...]) -> float:
        """Log likelihood of the symbols and the end; a step never seen costs as one thousandth of a count."""
        at, total = 0, 0.0
        for c in s:
            n = self.count[at]
            seen = self.flow[at][c] if at in self.flow else 0
            total += math.log((seen + 1e-3) / (n + 1e-3 * self.symbols))
            at = self.next[at].get(c, at) if at in self.next else at
        return total + math.log((self.final[at] + 1e-3) / (self.count[at] + 1e-3 * self.symbols))


#: Pieces of everyday long tokens: words, paths, addresses, versions, dates, numbers and UUIDs.
_PLAIN_PIECES = ("alpha", "report", "house", "Reading", "the", "configuration", "index", "data", "set", "Internal", "process", "and", "value", "www", "example", "com", "html", "users", "local", "share", "version", "ciones", "lichkeit", "mente", "heitung", "release", "notes", "image", "large", "final")
_PLAIN_ENDS = ("", ".html", ".jpg", ".tar.gz", ".csv", ".png")


def _word(draw: random.Random) -> str:
    """A word of speakable syllables, as languages have them."""
    return "".join(draw.choice(("", "b", "d", "k", "l", "m", "n", "r", "s", "t", "v", "st", "tr", "ch", "sch")) + draw.choice(("a", "e", "i", "o", "u", "ei", "ou", "ie")) + draw.choice(("", "", "n", "r", "s", "t", "ng", "nd")) for _ in range(draw.randint(1, 4)))


def _plain(draw: random.Random, kind: int) -> str:
    words = [draw.choice(_PLAIN_PIECES) if draw.random() < 0.5 else _word(draw) for _ in range(draw.randint(3, 8))]
    digits = lambda n: "".join(draw.choice(_DIGIT) for _ in range(n))
    number = lambda: digits(draw.randint(1, 5))
    if kind == 0:
        return "".join(words).lower()
    if kind == 1:
        return "/".join(words)
    if kind == 2:
        return "-".join(words) + draw.choice(["", "-2021", ".html", "-12"])
    if kind == 3:
        return "_".join(words).upper() if draw.random() < 0.5 else "_".join(words)
    if kind == 4:
        return ".".join(words) + draw.choice(["", ".", "..."])
    if kind == 5:
        return "-".join("".join(draw.choice(_HEXA) for _ in range(n)) for n in (8, 4, 4, 4, 12))
    if kind == 6:
        return draw.choice(["", "v", "id="]) + draw.choice([".", "-", "/", ""]).join(str(draw.randint(1, 9999)) for _ in range(draw.randint(4, 7)))
    if kind == 7:
        return words[0].lower() * (draw.random() < 0.5) + "".join(w.capitalize() for w in words) + draw.choice(["", number()])
    if kind == 8:
        return draw.choice("_-").join(words).lower() + draw.choice("_-") + number() + draw.choice(_PLAIN_ENDS)
    if kind == 9:
        path = "".join(draw.choice("//-_") + draw.choice([w, w.lower(), w[0]]) for w in words[2:]) + draw.choice(["", "/" + number()])
        return draw.choice(["", "/", "//", "//www."]) + ".".join(words[:2]).lower() + path + draw.choice(_PLAIN_ENDS)
    if kind == 10:
        return "".join(draw.choice(_UPPER) for _ in range(draw.randint(2, 4))) + draw.choice(["", "_", "-"]) + digits(draw.randint(8, 10)) + draw.choice(["", "_", "-"]) + digits(draw.randint(6, 12)) + draw.choice(_PLAIN_ENDS)
    if kind == 11:
        return draw.choice("-_").join(words[:3]).lower() + "-" + ".".join(number() for _ in range(3)) + draw.choice(["", "-linux-x86_64", "_amd64", "-win32"]) + draw.choice(_PLAIN_ENDS)
    if kind == 12:
        return "".join(draw.choice(_LOWER) for _ in range(draw.randint(2, 6))) + draw.choice("_.-") + draw.choice(["", "-".join(words[:2]) + "-"]) + ".".join(number() for _ in range(3)) + draw.choice(["", "-linux-x86_64", "_amd64", "-win32"]) + draw.choice(_PLAIN_ENDS)
    if kind == 13:
        return "".join(words[:4]).lower() + draw.choice([".", "-", "/", ""]) + number()
    return draw.choice("_-/+=.xX0") * draw.randint(LEAST, 60) + draw.choice(["", draw.choice(_PLAIN_PIECES)])


def plain_tokens(samples: int = 50 * SAMPLES, seed: int = SEED + 1) -> list[str]:
    """The background sample: tokens of 16 characters and more that are no credentials."""
    draw, out = random.Random(seed), []
    while len(out) < samples:
        t = _plain(draw, len(out) % 15)
        if len(t) >= LEAST:
            out.append(t)
    return out


def _read_model(data: bytes) -> Model:
    """A model of this module from what a training process wrote."""
    import base64
    import pickle

    return pickle.loads(base64.b64decode(data.split(b"model:")[-1]))


class Model:
    """Automata of credentials and of plain tokens, and the ratio a character that separates their samples best."""

    def __init__(self, good: list[str], plain: list[str], least: int = SAMPLES // 2):
        self.heads = inferred_heads(good, least)
        self.yes, self.no = (Automaton([encode(t, self.heads) for t in some]) for some in (good, plain))
        marks = sorted([(self.ratio(t), 1) for t in good[::3]] + [(self.ratio(t), 0) for t in plain])
        wrong = best = sum(1 for _, y in marks if not y)
        self.cut = marks[0][0] - 1e-9
        for k, (r, y) in enumerate(marks):
            wrong += 1 if y else -1
            if wrong < best:
                best, self.cut = wrong, (r + marks[min(k + 1, len(marks) - 1)][0]) / 2

    def ratio(self, token: str) -> float:
        """Log likelihood of a token as a credential against that as a plain token, a character."""
        e = encode(token, self.heads)
        return (self.yes.score(e) - self.no.score(e)) / len(token)


_model: list[Model] = []


def model() -> Model:
    """The model, trained once a process; tasks get the driver's."""
    if not _model:
        # The prefix trees take some hundred times what the automata do, so they live and go in a process of their own.
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
        made = subprocess.run([sys.executable, "-m", "cladeframe.llm.secrets"], env={**os.environ, "PYTHONPATH": path}, stdout=subprocess.PIPE, check=True)
        _model.append(_read_model(made.stdout))
    return _model[0]


def _with_model(run):
    """run for mapInArrow in a process that has the model of the driver, a few thousand numbers."""
    held = model()

    def given(batches):
        _model[:] = [held]
        yield from run(batches)

    return in_slices(given)


def likelihood_ratio(token: str) -> float:
    """Format log likelihood of a candidate against plain tokens, a character, less the threshold."""
    return model().ratio(token) - model().cut


@lru_cache(maxsize=65536)
def _is_secret(token: str) -> bool:
    return likelihood_ratio(token) > 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's patterns, by start and then kind."""
    low = text.lower() if text.isascii() else text
    out = []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")) if low is not text else True:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _trimmed(start: int, run: str) -> tuple[int, str]:
    """A run without the punctuation of its sentence and without what stands before its last inner equals sign."""
    token = run if run.endswith("=") else run.rstrip(".=-")
    lead = token.rstrip("=").rfind("=") + 1 if "=" in token[:-2] else 0
    return start + lead, token[lead:]


def _is_key_block(block: str) -> bool:
    """Whether the lines of a private key block are credentials by their likelihood, all in all."""
    lines = [x for x in block.split("-----")[2].split() if len(x) >= LEAST]
    return bool(lines) and sum(likelihood_ratio(x) * len(x) for x in lines) > 0


def method_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the automata add: all candidates are scored; those that lie inside a base span or a key block are in it already."""
    out = [(m.start(), 3, m.end()) for m in PEM.finditer(text) if _is_key_block(m[0])] if "PRIVATE KEY-----" in text else []
    taken = sorted([*base, *out])
    reach, k = -1, 0  # both run through the text: the farthest end of the spans that begin at or before the candidate
    for m in CANDIDATE.finditer(text):
        start, token = _trimmed(m.start(), m[0])
        if len(token) < LEAST or not _is_secret(token):
            continue
        while k < len(taken) and taken[k][0] <= start:
            reach, k = max(reach, taken[k][2]), k + 1
        if start + len(token) > reach:
            out.append((start, 3, start + len(token)))
    return out


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by start and then kind, in code points."""
    base = base_spans(text or "")
    return base, sorted(base + method_spans(text or "", base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(documents: DataFrame) -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, n_format, base_sha256 and spans.

    Needs doc_id and text; other columns are ignored. Base spans are those of the contract's patterns. The method
    adds spans of kind format: every run of 16 and more credential characters is scored by two automata, inferred by
    merging the compatible states of prefix trees of labelled credentials and of plain tokens, and is a secret if the
    log likelihood ratio a character passes the threshold that separates the labelled samples best; those that a base
    span holds whole are not listed twice. Lines of a private key block are scored together, and the block is one
    span. Training is bounded by SAMPLES credentials a format, happens on the driver, and the automata go to the tasks. One pass over each
    text, no shuffle. A null text is empty; each row is judged by itself, so repeated rows give repeated results.
    """

    def run(batches):
        for batch in batches:
            rows = [find_secrets(t.as_py()) for t in batch.column(1)]
            n = [Counter(k for _, k, _ in every) for _, every in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array([c[k] for c in n], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()), pa.array([joined(e) for _, e in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"],
            )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_with_model(run), "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in find_secrets(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(documents: DataFrame) -> DataFrame:
    """documents, all columns and rows, with secrets in text replaced by [SECRET]; n_chars, if there, follows."""
    names = documents.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [redact(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[k].to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema])
    return documents.mapInArrow(_with_model(run), schema)


if __name__ == "__main__":
    import base64
    import pickle

    from cladeframe.llm import secrets as named  # so that the model's classes have the module's name

    print("model:" + base64.b64encode(pickle.dumps(named.Model(named.labelled_credentials(), named.plain_tokens()))).decode())
