"""Secret scanning: fixed patterns plus a linear-chain conditional random field (operator 8).

The patterns find assignments, access keys and long hexadecimal runs. The field tags every
token of a text as outside, begin or inside of a secret from its shape, the words next to it
and features of the whole text; Viterbi finds the best tags. It is trained on generated,
labelled lines (a fixed seed, TRAINING_LINES of them), by gradient ascent on the likelihood.

Scores of all tokens come from tables, for a batch of texts at once. A token whose score for
outside exceeds the others by more than all transitions around it could make up for is
outside in every best tagging, so the chain may be decoded between such tokens; this gives
the tags that decoding the whole chain gives.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

TOKEN = re.compile(r"[\w+/.-]+(?:={1,2}(?![\w+/.=-]))?|[^\s\w+/.-]")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key", "credential", "auth", "bearer", "privatekey", "private_key", "accesskey", "access_key", "pwd")
_ANY_KEYWORD = re.compile("|".join(KEYWORDS))
TRAINING_LINES, SEED = 2400, 20
OUTSIDE, BEGIN, INSIDE = range(3)
#: Distinct tokens whose features are kept, characters of texts scored at once, tokens of a longer text at once.
VOCABULARY, BATCH_CHARS, SLICE = 1 << 16, 1 << 18, 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, sorted; code points, end exclusive."""
    spans = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(spans, key=lambda s: (s[0], s[2]))


#: What a token tells of itself, in the order of the weights.
SHAPES = (
    "bias", "len<4", "len4-7", "len8-15", "len16-23", "len24-39", "len40+", "digit", "upper", "lower", "letters+digits", "hex", "numeric", "dots", "dash-or-under",
    "capital-word", "mixed-case-inside", "changes>=4", "changes>=8", "distinct>=10", "keyword", "separator", "symbol", "known-prefix", "ends-with-dot", "slash",
    "identifier", "padded", "uuid", "consonants", "not-ascii",
)
#: What its neighbours and the whole text tell.
NEAR = ("prev-separator", "prev-quote", "prev2-separator", "near-keyword", "prev-keyword", "next-quote", "next-symbol", "prev-numeric", "prev-plain", "next-plain", "prev-dashes", "prev-random", "keyed")
WHOLE = ("file-keyword", "file-symbols", "file-digits")
FEATURES = SHAPES + NEAR + WHOLE
INDEX = {name: i for i, name in enumerate(FEATURES)}
#: Prefixes that vendors publish for their keys.
PREFIX = re.compile(r"AKIA|gh[pousr]_|github_pat_|sk[-_]|pk[-_]|rk_|xox[abprs]-|eyJ|glpat-|AIza|npm_|SG\.|hf_")
IDENTIFIER = re.compile(r"[A-Za-z]?[a-z]+\d?(?:[A-Z][a-z]+\d?)*|[a-z]+\d?(?:[_-][a-z]+\d?)*|[A-Z]+\d?(?:[_-][A-Z]+\d?)*|[A-Z]{1,4}-?\d{1,5}")
NUMERIC = re.compile(r"[\d.+/-]+|[+-]?\d[\d.]*[A-Za-z]{1,3}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.IGNORECASE)
# Bits that a token shows to its neighbours.
_SEPARATOR, _QUOTE, _KEYWORD, _SYMBOL, _NUMERIC, _PLAIN, _DASHES, _RANDOM = (1 << k for k in range(8))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def has_keyword(text: str) -> bool:
    lower = text.lower()
    return _ANY_KEYWORD.search(lower) is not None if len(lower) < 200 else any(k in lower for k in KEYWORDS)


def _length(n: int) -> str:
    return "len<4" if n < 4 else "len4-7" if n < 8 else "len8-15" if n < 16 else "len16-23" if n < 24 else "len24-39" if n < 40 else "len40+"


@lru_cache(1 << 12)
def _word_shape(length: str, upper: bool, lower: bool, dot: bool, varied: bool, odd: bool, ascii_: bool, keyword: bool) -> tuple[str, ...]:
    """The features of a word of letters, lower case or only its first capital, with or without a dot."""
    tests = {"upper": upper, "lower": lower, "distinct>=10": varied, "keyword": keyword, "ends-with-dot": dot, "identifier": ascii_, "consonants": odd, "not-ascii": not ascii_}
    return ("bias", length, "capital-word", *(name for name, x in tests.items() if x))


def shape(token: str) -> tuple[str, ...]:
    """The features that a token has on its own."""
    n = len(token)
    word = token[:-1] if token[-1:] == "." else token
    if word.isalpha() and (word.islower() or word[1:].islower() or len(word) == 1):
        upper = word[0].isupper()
        return _word_shape(_length(n), upper, len(word) > 1 or not upper, n > 1 and token[-1] == ".", n >= 10 and len(set(token)) >= 10, CONSONANTS.search(word) is not None, token.isascii(), has_keyword(token))
    digit, upper, lower = any(c.isdigit() for c in token), any(c.isupper() for c in token), any(c.islower() for c in token)
    numeric = digit and NUMERIC.fullmatch(token) is not None
    word = token.rstrip(".")
    changes = sum(1 for _ in groupby(map(_kind, token))) - 1
    tests = {
        "digit": digit, "upper": upper, "lower": lower, "letters+digits": digit and (upper or lower) and not numeric, "hex": n >= 8 and digit and lower and re.fullmatch("[0-9a-f]+", token),
        "numeric": numeric, "dots": "." in token[:-1], "dash-or-under": "-" in token or "_" in token, "mixed-case-inside": upper and lower and any(c.isupper() for c in token[1:]),
        "changes>=4": changes >= 4, "changes>=8": changes >= 8, "distinct>=10": len(set(token)) >= 10, "keyword": has_keyword(token), "separator": token in ("=", ":"),
        "symbol": n == 1 and not token.isalnum(), "known-prefix": n >= 12 and PREFIX.match(token), "ends-with-dot": n > 1 and token.endswith("."), "slash": "/" in token,
        "identifier": IDENTIFIER.fullmatch(word), "padded": token.endswith("="), "uuid": UUID.fullmatch(word), "consonants": CONSONANTS.search(token), "not-ascii": not token.isascii(),
    }
    return ("bias", _length(n), *(name for name, x in tests.items() if x))


def shown(token: str, on: tuple[str, ...]) -> int:
    """The bits that a token with these features shows to its neighbours."""
    bits = _SEPARATOR * ("separator" in on) | _QUOTE * (token in ("\"", "'", "`")) | _KEYWORD * ("keyword" in on) | _SYMBOL * ("symbol" in on)
    random_ = len(token) >= 16 and "identifier" not in on and "numeric" not in on and "capital-word" not in on and "dots" not in on
    return bits | _NUMERIC * ("numeric" in on) | _PLAIN * ("capital-word" in on) | _DASHES * token.endswith("---") | _RANDOM * random_


def neighbours(bits: np.ndarray) -> np.ndarray:
    """Of each token of a sequence, as bits in the order of NEAR, what those around it show."""
    before = lambda k: np.concatenate([np.zeros(min(k, len(bits)), bits.dtype), bits[:-k]])
    p1, p2, p3, n1 = before(1), before(2), before(3), np.concatenate([bits[1:], np.zeros(min(1, len(bits)), bits.dtype)])
    has = lambda x, flag: (x & flag) != 0
    separated, near = has(p1, _SEPARATOR), has(p1 | p2 | p3, _KEYWORD)
    found = (
        separated, has(p1, _QUOTE), has(p2, _SEPARATOR), near, has(p1, _KEYWORD), has(n1, _QUOTE), has(n1, _SYMBOL) & ~has(n1, _QUOTE), has(p1, _NUMERIC), has(p1, _PLAIN), has(n1, _PLAIN),
        has(p1, _DASHES), has(p1, _RANDOM), near & (separated | has(p2, _SEPARATOR)),
    )
    return sum(x.astype(np.int32) << k for k, x in enumerate(found))


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    symbols = text.count("=") + text.count("{") + text.count(";")
    tests = (has_keyword(text), symbols * 100 > n, text.count("0") + text.count("1") + text.count("5") > n * 0.02)
    return [name for name, x in zip(WHOLE, tests, strict=True) if x]


# --- training -----------------------------------------------------------------------------

_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
#: What the lines of training and of the test (held_out) are made of; names, prefixes and sentences differ.
_NAMES = (
    ("password", "passwd", "token", "secret", "api_key", "apikey", "PASSWORD", "auth_token", "client_secret", "ACCESS_KEY"),
    ("pwd", "DB_PASSWORD", "access_key", "API_KEY", "sessionSecret", "privateKey", "refresh_token", "Passwd"),
)
_PREFIXES = (("ghp_", "sk-", "xoxb-", "AIza", "rk_"), ("gho_", "pk_live_", "glpat-", "npm_", "xoxp-"))
_SECRET_LINES = (
    ("{n}={s}", "{n} = \"{s}\"", "{n}: '{s}'", "\"{n}\": \"{s}\",", "export {n}={s}", "Authorization: Bearer {s}", "auth: Bearer {s} {w}", "{w} {w} {s} {w}", "{w} {w} {k} {w}", "the {n} is {s} {w} {w}",
     "{w} login {w} {n} {s} {w}", "-----BEGIN RSA PRIVATE KEY----- {b} -----END", "-----BEGIN EC PRIVATE KEY----- {b} -----END RSA", "{w} {w} : {k}", "curl -H {q}X-Token: {s}{q} {u}", "{k}", "{w}: {s}, {w} {w}"),
    ("{n}:{s}", "set {n} {s} {w}", "<{n}>{s}</{n}>", "{n} => '{s}';", "Bearer {s}", "our {n} was {s} {w}", "{w} {w} key {k} {w} {w}", "use {k} for {w} {w}", "-----BEGIN OPENSSH PRIVATE KEY----- {b} -----END OPENSSH",
     "{w} {s}", "\"Authorization\" : \"token {k}\""),
)
_CLEAN_LINES = (
    ("{w} {w} {w} {w} {w}.", "{w} +{d} ({d}) {d}-{d} {w}", "{w} {d}.{d}.{d}.{d} {w}", "card {D} {w}", "{w}.{w}{d}@{w}.example.com {w}", "{d}-{d}-{d} {w} {d}:{d}", "see {u} {w}", "{w} v{d}.{d}.{d} {w}", "the {n} {w} is {w} and {w}",
     "a {n} of {w} {w} {d}", "{w}-{w}-{w} {W} {w}", "{i}({i}, {i})", "{i} = {i}.{i}({d});", "order {D} of {w}", "DE{D} {w}", "{p} {w} {w}", "{w} {c} {w} {c}", "{n}: {w} {w} {w}", "{n} = {i}", "commit {h} {w} {w}", "{W} {W} {w}: {d} {w}", "{g} {w}", "{n} must be {w}"),
    ("{w}, {w} {w}; {w}", "tel {d} {d} {d} {w}", "ip {d}.{d}.{d}.{d}:{d}", "{u}", "{w}@{w}.test, {w}", "{d}/{d}/{d} {W}", "{i} {i} {i}", "if {i} == {d}: {i}()", "isbn {d}-{d}-{d}-{d}", "{p}", "no {n} {w} {w}", "{n} policy: {w} {w}", "{c}-{d} {w} {w}", "{h} {w} {w}", "{g}", "{w} ({w}) {D}", "forgot {n} ? {w}"),
)


def labelled_lines(n: int, seed: int, held_out: bool = False) -> list[tuple[str, list[tuple[int, int]]]]:
    """n generated lines with the (start, end) of their secrets."""
    r, part, done = random.Random(seed), int(held_out), []
    syllables = (("an", "re", "th", "sch", "ou", "ed", "ti", "on", "le", "ver", "gen", "es", "ió", "qu"), ("in", "ra", "ph", "str", "eu", "ing", "to", "er", "la", "mo", "ken", "ás", "ö", "zu"))[part]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 6)))
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    plain = lambda: r.choice((word(), word(), word(), word().capitalize(), word() + r.choice(".,!")))
    mixed = _LETTERS + _DIGITS

    def value() -> str:
        kind = r.randrange(9)
        if kind < 2:
            return some(r.randint(12, 48), mixed)
        if kind == 2:
            return some(r.choice((16, 20, 24, 32, 40, 64)), "0123456789abcdef")
        if kind == 3:
            return some(r.randint(28, 60), mixed + "+/") + r.choice(("", "=", "=="))
        if kind == 4:
            return some(r.randint(20, 44), _LETTERS)
        if kind == 5:
            return f"eyJ{some(r.randint(14, 30), mixed)}.{some(20, mixed)}.{some(20, mixed + '-_')}"
        if kind == 6:
            return f"{word().capitalize()}{r.choice(('', '-', '_'))}{word().capitalize()}{r.randint(1, 9999)}{r.choice(('', '!', '#'))}".rstrip("!#")
        return known()

    def known() -> str:
        return r.choice(_PREFIXES[part]) + some(r.randint(20, 40), r.choice((mixed, mixed, _LETTERS)))

    fill = {
        "w": plain, "W": lambda: word().upper(), "n": lambda: r.choice(_NAMES[part]), "d": lambda: str(r.randint(0, 10 ** r.randint(1, 4))), "D": lambda: some(r.randint(8, 22), _DIGITS), "q": lambda: r.choice("\"'"),
        "i": lambda: r.choice((word() + word().capitalize(), f"{word()}_{word()}", word().upper() + "_" + word().upper(), word() + str(r.randint(0, 9)))), "c": lambda: some(r.randint(1, 4), _LETTERS[:26]) + some(r.randint(1, 5), _DIGITS),
        "u": lambda: f"https://{word()}.example.net/{word()}/{r.randint(1, 9999)}{r.choice(('', '/' + word() + '.html', '?' + word() + '=' + word()))}", "p": lambda: "/".join(["", word(), word(), word() + r.choice((".txt", ".py", ".tar.gz"))]),
        "h": lambda: some(r.randint(7, 12), "0123456789abcdef"), "g": lambda: "-".join(some(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)), "s": value, "k": known,
        "b": lambda: " ".join(some(r.choice((48, 64)), mixed + "+/") for _ in range(r.randint(2, 5))),
    }
    for _ in range(n):
        text, spans = "", []
        lines = [r.choice((_SECRET_LINES if r.random() < 0.5 else _CLEAN_LINES)[part])]
        lines = [r.choice(_CLEAN_LINES[part])] * (r.random() < 0.3) + lines + [r.choice(_CLEAN_LINES[part])] * (r.random() < 0.3)
        for k, line in enumerate(lines):
            text += "\n" * bool(k)
            for piece in re.split(r"(\{\w\})", line):
                put = fill[piece[1]]() if piece[:1] == "{" and piece[-1:] == "}" and len(piece) == 3 else piece
                if piece in ("{s}", "{k}", "{b}"):
                    spans.append((len(text), len(text) + len(put)))
                text += put
        done.append((text, spans))
    return done


def tags(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The tokens of text and their tags."""
    tokens, found = [], []
    for m in TOKEN.finditer(text):
        tokens.append(m.group())
        inside = [s for s, e in spans if s < m.end() and m.start() < e]
        found.append(OUTSIDE if not inside else BEGIN if m.start() <= inside[0] or not found or found[-1] == OUTSIDE else INSIDE)
    return tokens, found


@lru_cache(4)
def train(lines: int = TRAINING_LINES, seed: int = SEED, steps: int = 110) -> tuple[tuple[tuple[float, ...], ...], tuple[tuple[float, ...], ...]]:
    """(weights of each feature by tag, transitions by tag and next tag) after Adam steps on the likelihood."""
    data = [(file_features(t), *tags(t, spans)) for t, spans in labelled_lines(lines, seed)]
    data = sorted((d for d in data if d[1]), key=lambda d: -len(d[1]))
    n, longest = len(data), len(data[0][1])
    x = np.zeros((longest, n, len(FEATURES)), np.float32)
    gold = np.zeros((longest, n, 3), np.float32)
    length = np.array([len(d[1]) for d in data])
    live = [int((length > t).sum()) for t in range(longest)]  # lines are sorted: the first ones are still there at t
    for i, (whole, tokens, own) in enumerate(data):
        on = [shape(t) for t in tokens]
        near = neighbours(np.array([shown(t, o) for t, o in zip(tokens, on, strict=True)], np.int32))
        for j, tag in enumerate(own):
            x[j, i, [INDEX[f] for f in (*on[j], *whole)]] = 1
            x[j, i, len(SHAPES) : len(SHAPES) + len(NEAR)] = near[j] >> np.arange(len(NEAR)) & 1
            gold[j, i, tag] = 1
    flat = x.reshape(-1, len(FEATURES))
    want = flat.T @ gold.reshape(-1, 3)
    need = np.einsum("tia,tib->ab", gold[:-1], gold[1:])
    need[OUTSIDE] += gold[0].sum(0)
    w, a = np.zeros((len(FEATURES), 3), np.float32), np.zeros((3, 3), np.float32)  # a chain starts as if after an outside token
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    for step in range(1, steps + 1):
        e = (flat @ w).reshape(longest, n, 3)
        # Probabilities, scaled at each place: alpha sums to 1 over the tags.
        m, top = np.exp(a), np.exp(e - e.max(2, keepdims=True))
        alpha, scale = np.zeros_like(e), np.ones((longest, n), np.float32)
        for t in range(longest):
            k = live[t]
            now = (alpha[t - 1, :k] @ m if t else m[OUTSIDE]) * top[t, :k]
            scale[t, :k] = now.sum(1)
            alpha[t, :k] = now / scale[t, :k, None]
        beta, got = np.ones_like(e), np.zeros((3, 3), np.float32)
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            ahead = top[t + 1, :k] * beta[t + 1, :k] / scale[t + 1, :k, None]
            beta[t, :k] = ahead @ m.T
            got += m * (alpha[t, :k].T @ ahead)
        p = alpha * beta
        got[OUTSIDE] += p[0].sum(0)
        for k, (g, v) in enumerate((((want - flat.T @ p.reshape(-1, 3)) / n - 0.002 * w, w), ((need - got) / n - 0.002 * a, a))):
            one, two = moments[2 * k], moments[2 * k + 1]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            v += 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    a = a.astype(float)
    a[OUTSIDE, INSIDE] = -1e9  # a secret begins before it goes on
    return tuple(map(tuple, w.astype(float).tolist())), tuple(map(tuple, a.tolist()))


def viterbi(emissions: list[tuple[float, float, float]], steps: tuple[tuple[float, ...], ...], closed: bool = False) -> list[int]:
    """The best tags of a chain that starts after an outside token; closed: and ends before one."""
    score, back = [-1e18, -1e18, -1e18], []
    score[OUTSIDE] = 0.0
    for e in emissions:
        came, now = [], []
        for tag in range(3):
            best = max(range(3), key=lambda p: score[p] + steps[p][tag])  # noqa: B023
            came.append(best)
            now.append(score[best] + steps[best][tag] + e[tag])
        back.append(came)
        score = now
    tag = max(range(3), key=lambda t: score[t] + (steps[t][OUTSIDE] if closed else 0.0))
    found = []
    for came in reversed(back):
        found.append(tag)
        tag = came[tag]
    return found[::-1]


class Tagger:
    """A trained field, with the scores of the tokens that it has met (at most VOCABULARY of them)."""

    def __init__(self, model):
        weights, self.steps = model
        w, a = np.array(weights), np.array(self.steps)
        self.weights = w
        near = w[len(SHAPES) : len(SHAPES) + len(NEAR)]
        self.near = (np.arange(1 << len(NEAR))[:, None] >> np.arange(len(NEAR)) & 1) @ near
        # What the transitions around a token can gain at most if its tag t is changed to outside,
        # and the same where the next token goes on and then has to begin.
        self.gain, self.gain_next = np.zeros(3), np.zeros(3)
        for t in (BEGIN, INSIDE):
            came = max(a[p, t] - a[p, OUTSIDE] for p in range(3))
            self.gain[t] = came + max(0.0, *(a[t, n] - a[OUTSIDE, n] for n in (OUTSIDE, BEGIN)))
            self.gain_next[t] = came + a[t, INSIDE] - a[OUTSIDE, BEGIN] + max(0.0, *(a[INSIDE, n] - a[BEGIN, n] for n in range(3)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.kinds: dict[tuple, tuple] = {}
        self.own, self.bits = np.zeros((1024, 3)), np.zeros(1024, np.int32)
        self.own[0] = 0.0, -1e6, -1e6  # between texts

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        fresh = list(set(tokens).difference(known))
        if fresh:
            first = len(known)
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            while len(known) > len(self.bits):
                self.own, self.bits = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.bits, np.zeros_like(self.bits)])
            rows, kinds = [], self.kinds
            for token in fresh:
                on = shape(token)
                key = (on, shown(token, on))
                row = kinds.get(key)
                if row is None:
                    if len(kinds) > VOCABULARY // 8:
                        kinds.clear()
                    row = kinds[key] = (*self.weights[[INDEX[f] for f in on]].sum(0).tolist(), key[1])
                rows.append(row)
            rows = np.array(rows)
            self.own[first : len(known)], self.bits[first : len(known)] = rows[:, :3], rows[:, 3]
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def _scores(self, tokens: list[str]) -> np.ndarray:
        """(tokens, 3) scores without the features of the whole text."""
        if len(self.known) > VOCABULARY:
            self._forget()
        ids = self._ids(tokens)
        return self.own[ids] + self.near[neighbours(self.bits[ids])]

    def _whole(self, text: str) -> np.ndarray:
        return self.weights[[INDEX[f] for f in file_features(text)]].sum(0)

    def _open(self, e: np.ndarray) -> np.ndarray:
        """Which tokens may be other than outside in a best tagging."""
        later = np.concatenate([e[1:, INSIDE] - e[1:, BEGIN], [0.0]])
        more = [e[:, t] - e[:, OUTSIDE] + np.maximum(self.gain[t], later + self.gain_next[t]) for t in (BEGIN, INSIDE)]
        return np.maximum(*more) >= -1e-6

    def _tagged(self, e: np.ndarray, last: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """(token, tag) of the tokens that aren't outside. last: which tokens end a text."""
        at = np.flatnonzero(self._open(e))
        if not len(at):
            return
        turn = np.flatnonzero(np.diff(at) > 1)
        for i, j in zip(at[np.concatenate([[0], turn + 1])].tolist(), at[np.concatenate([turn, [len(at) - 1]])].tolist(), strict=True):
            ends = j + 1 == len(e) if last is None else bool(last[j])
            for k, tag in enumerate(viterbi(e[i : j + 1].tolist(), self.steps, closed=not ends), i):
                if tag != OUTSIDE:
                    yield k, tag

    def _of_long(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, tag) in a long text, SLICE tokens at a time: a slice ends at an outside token."""
        matches, whole = TOKEN.finditer(text), self._whole(text)
        held: list[tuple[str, int, int]] = []
        done, found = 0, []
        while True:
            more = [(m.group(), m.start(), m.end()) for m in islice(matches, SLICE)]
            held += more
            e = self._scores([t for t, _, _ in held])
            e += whole
            e[:done] = 0.0, -1e6, -1e6  # decided, there for their neighbours only
            stop = len(held)
            if more:  # the scores of the last two tokens aren't known yet
                sure = np.flatnonzero(~self._open(e)[: max(0, stop - 2)])
                if not len(sure) or sure[-1] < done:
                    continue
                stop = int(sure[-1]) + 1
            for k, tag in self._tagged(e[:stop]) if not more else self._tagged(e[:stop], np.zeros(stop, bool)):
                found.append((held[k][1], held[k][2], tag))
            if not more:
                return found
            kept = max(0, stop - 3)
            held, done = held[kept:], stop - kept

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, tag) of each text's tokens that aren't outside, in order."""
        result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > BATCH_CHARS:
                result[i] = self._of_long(text)
                continue
            group.append(i)
            size += len(text)
            if size > BATCH_CHARS:
                self._of_group(texts, group, result)
                group, size = [], 0
        if group:
            self._of_group(texts, group, result)
        return result

    def _of_group(self, texts: list[str], group: list[int], result: list) -> None:
        tokens: list[str] = []
        counts = []
        for i in group:
            own = TOKEN.findall(texts[i])
            counts.append(len(own))
            tokens += own
            tokens += ("", "", "")
        counts = np.array(counts)
        e = self._scores(tokens)
        e += np.repeat(np.array([self._whole(texts[i]) for i in group]), counts + 3, axis=0)
        first = np.cumsum(counts + 3) - counts - 3
        last = np.zeros(len(tokens), bool)
        last[(first + counts - 1)[counts > 0]] = True
        marked: dict[int, dict[int, int]] = {}
        for k, tag in self._tagged(e, last):
            g = int(np.searchsorted(first, k, "right")) - 1
            marked.setdefault(g, {})[k - int(first[g])] = tag
        for g, tag in marked.items():
            i = group[g]
            result[i] = [(m.start(), m.end(), tag[k]) for k, m in enumerate(TOKEN.finditer(texts[i])) if k in tag]


@lru_cache(2)
def tagger(model) -> Tagger:
    return Tagger(model)


def crf_spans(tagged: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what the field tags, from its tokens: each secret without the tokens that base spans touch."""
    found, open_ = [], False
    for start, end, tag in tagged:
        if any(start < e and s < end for s, e, _ in base):
            open_ = False
        elif tag == INSIDE and open_:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
            open_ = True
    return found


def spans_of(texts: list[str], model) -> list[list[tuple[int, int, int]]]:
    """Of each text the base spans, and those of the field that lie outside them, by start, then kind."""
    found = []
    for text, tagged in zip(texts, tagger(model).tagged(texts), strict=True):
        base = base_spans(text)
        found.append(sorted([*base, *((a, b, 3) for a, b in crf_spans(tagged, base))], key=lambda s: (s[0], s[2])))
    return found


def all_spans(text: str, model) -> list[tuple[int, int, int]]:
    return spans_of([text], model)[0]


def redact(text: str, model, mark: str = "[SECRET]") -> str:
    """text with each secret (of an assignment: its value) replaced by mark."""
    return _redacted(text, all_spans(text, model), mark)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    hide = []
    for a, b, kind in spans:
        hide.append((ASSIGN.match(text, a).start(2), b) if kind == 0 else (a, b))
    result, at = [], 0
    for a, b in sorted(hide):
        if a >= at:
            result += [text[at:a], mark]
        at = max(at, b)
    return "".join([*result, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in own] for own in spans_of([x.as_py() or "" for x in batch.column(1)], model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return find


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of start, end, kind) of every row of docs.

    Offsets are code points, end exclusive; spans are sorted by start, then kind in the
    order of KINDS. Spans of different patterns may overlap; those of the field overlap no
    pattern's: of a secret that the field tags, only the tokens next to a pattern's span count. Null and empty texts have none; repeated rows and null ids are kept as they
    are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(_finder(shared), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets in `text` replaced by mark and, if there is one, n_chars brought up to date.

    No row is dropped; texts without secrets and nulls stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train())
    column = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(column).to_pylist()
            clean_ = [_redacted(t, own, mark) if t else t for t, own in zip(texts, spans_of([t or "" for t in texts], model), strict=True)]
            yield batch.set_column(column, batch.schema.field(column), pa.array(clean_, batch.schema.field(column).type))

    cleaned = small_batches(docs).mapInArrow(clean, docs.schema)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind)).select(docs.columns)
