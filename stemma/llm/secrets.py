"""Secret scans: three fixed patterns and a battery of randomness tests.

A candidate token (16 or more characters of an encoding alphabet, with a digit
and a letter) gets an inferred encoding. Under the hypothesis that its symbols
are uniform on that alphabet, three p-values are found: chi-squared uniformity
over alphabet bins, Wald-Wolfowitz runs above and below the middle, and lag-1
serial correlation. Fisher's method combines them; a token passes if uniformity
is not rejected. The same token also gets an e-value against text: its
likelihood under the uniform law over that under a sticky letter model. This
grows with the length, so short tokens need better evidence. Benjamini and
Hochberg's rule on the e-values of a document's candidates controls the false
discoveries.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts, replace_texts, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as those of all runs that have 24 characters
_HEX = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

LEAST = 16
_CLASS = bytes(c if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=" else 32 for c in range(256))
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide; the first that holds all symbols is inferred.
ENCODINGS = [
    ("hex", _DIGIT + "abcdef"),
    ("hexupper", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _LOWER + _DIGIT),
    ("base36upper", _UPPER + _DIGIT),
    ("base62", _UPPER + _LOWER + _DIGIT),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
]
_INDEX = [(name, {c: k for k, c in enumerate(letters)}) for name, letters in ENCODINGS]
#: Letters from frequent to rare; the weight of the k-th is 1 / (k + 2).
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
_RANKED = {c: 1 / (k + 2) for k, c in enumerate(_FREQUENT)}
_LETTER = {c: w / sum(_RANKED.values()) for c, w in _RANKED.items()}
STAY = 0.92  # in text, the next symbol is of the same class (lower, upper, digit, sign)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for n in range(1, 500):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> tuple[str, list[int], int] | None:
    """(name, symbol numbers, alphabet size) of a token without its padding, or None."""
    body = token.rstrip("=")
    for name, index in _INDEX:
        if all(c in index for c in set(body)):
            return name, [index[c] for c in body], len(index)
    return None


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, of runs and of serial correlation, for uniform symbols."""
    n = len(symbols)
    bins = max(2, min(16, n // 4))
    counts = Counter(s * bins // size for s in symbols)
    share = Counter(s * bins // size for s in range(size))
    chi = sum((counts[k] - n * share[k] / size) ** 2 / (n * share[k] / size) for k in range(bins))
    uniform = _upper_gamma((bins - 1) / 2, chi / 2)
    high = [2 * s >= size for s in symbols]
    a = sum(high)
    b = n - a
    runs = 1.0
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / math.sqrt(var)) if var > 0 else 1.0
    middle = sum(symbols) / n
    spread = sum((s - middle) ** 2 for s in symbols)
    serial = 0.0
    if spread:
        r = sum((x - middle) * (y - middle) for x, y in zip(symbols, symbols[1:])) / spread
        serial = _two_sided((r + 1 / n) * math.sqrt(n))
    return uniform, runs, serial


def combined(p_values: tuple[float, ...]) -> float:
    """Fisher's method."""
    x = -2 * sum(math.log(max(p, 1e-300)) for p in p_values)
    return _upper_gamma(len(p_values), x / 2)


def _kind(c: str) -> int:
    return 0 if c in _LOWER else 1 if c in _UPPER else 2 if c in _DIGIT else 3


def log_e_value(token: str, size: int) -> float:
    """Log likelihood of the token under uniform symbols, less that under the letter model."""
    text, before = 0.0, None
    for c in token.rstrip("="):
        kind = _kind(c)
        text += math.log(0.25 if before is None else STAY if kind == before else (1 - STAY) / 3)
        text += math.log(_LETTER[c.lower()] if kind < 2 else 0.1 if kind == 2 else 0.25)
        before = kind
    return -len(token.rstrip("=")) * math.log(size) - text


def discoveries(candidates: list[tuple[int, int, str]], alpha: float = 0.001, q: float = 0.01) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates that look random, at false-discovery rate q."""
    judged = []
    for start, end, token in candidates:
        found = infer_encoding(token)
        if found:
            name, symbols, size = found
            judged.append((log_e_value(token, size), combined(battery(symbols, size)) >= alpha, f"random_{name}", start, end))
    judged.sort(key=lambda x: (-x[0], x[3]))
    keep = max((k for k, x in enumerate(judged, 1) if x[0] >= math.log(len(judged) / (q * k))), default=0)
    return [x[2:] for x in judged[:keep] if x[1]]


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    lower = raw.lower()
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def secret_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by start, then kind as listed; whole tokens that the battery adds where they reach beyond them."""
    text = text or ""
    raw = text.encode()
    order = {"assign": 0, "access": 1, "hex": 2}
    base = sorted(base_spans(text, raw), key=lambda s: (s[1], order[s[0]]))
    added: list[tuple[str, int, int]] = []
    if any(len(w) >= LEAST and not w.isalpha() for w in raw.translate(_CLASS).split()):
        ends = 0
        covered = []  # base spans merged, to test tokens by one pass
        for _, s, e in base:
            if covered and s <= ends:
                covered[-1][1] = ends = max(ends, e)
            else:
                covered.append([s, e])
                ends = e
        k, candidates = 0, []
        for m in TOKEN.finditer(text):
            while k < len(covered) and covered[k][1] <= m.start():
                k += 1
            token = m[0]
            # what base spans leave of a token is judged for all of it; a short rest with what they cover
            rest, at, j = [], m.start(), k
            while j < len(covered) and covered[j][0] < m.end():
                rest.append(text[at : max(at, covered[j][0])])
                at = max(at, covered[j][1])
                j += 1
            left = "".join([*rest, text[at : m.end()]])
            if not left.rstrip("="):
                continue
            token = left if len(left) >= LEAST else token
            if any(c in _DIGIT for c in token) and any(c.isalpha() for c in token):
                candidates.append((m.start(), m.end(), token))
        added = sorted(discoveries(candidates), key=lambda s: s[1])
    return base, added


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SECRETS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _secrets(ids: list, texts: list) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in SECRETS.split(", ")}
    order = {"assign": 0, "access": 1, "hex": 2}
    for i, text in zip(ids, texts):
        base, added = secret_spans(text)
        n = Counter(k for k, _, _ in base)
        spans = sorted([*base, *added], key=lambda s: (s[1], order.get(s[0], 3), s[0]))
        for values, x in zip(out.values(), (i, n["assign"], n["access"], n["hex"], hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))):
            values.append(x)
    return out


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document. Null and empty texts have no spans (the digest of an empty list)."""
    return map_texts(docs, _secrets, SECRETS)


def mask(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each merged span replaced by ``mark``; null stays null."""
    base, added = secret_spans(text)
    if not base and not added:
        return text
    out, at, spans = [], 0, sorted((s, e) for _, s, e in [*base, *added])
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, if there is one, brought up to date."""
    return replace_texts(docs, lambda texts: [mask(t) for t in texts])


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
