"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base spans follow fixed patterns. Around every digit, @, cue ("password:") and title ("Mrs.") the text is cut into
tokens, and whole candidate segments of up to ``MAX_TOKENS`` tokens are scored by features of the span as a whole (its
shape, counts, check digits, length) and of its neighbours. A dynamic programme over bounded segments then chooses
boundaries and kinds jointly. The field adds phones without a country code, secrets such as keys, tokens and passwords,
bank and account numbers, social security numbers and announced names; a span that touches base spans is added only if it
holds them whole and more. Its
weights are fitted at start on sentences from a fixed generator (``training_sentences``), so that they are the same for
every input. Texts without any of those marks are done after one look at their bytes.

Edge cases: null counts as empty and has no spans; texts of any length are searched whole, in linear time and with a few
bytes of memory a token; repeated rows get the same spans; of equally good segmentations that with fewer entities is
taken; other columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, append, arrow_map, plus, slices

#: The kinds, base ones first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "account", "name")
ORDER = {k: i for i, k in enumerate(KINDS)}
MAX_TOKENS, MAX_CHARS, CONTEXT = 16, 96, 4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W_]+|\s+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def mod97(text: str) -> bool:
    """The check of an international bank account number."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """start, kind, end of the base patterns' matches, leftmost and not overlapping within a kind; what fails a kind's
    test is dropped. Each pattern passes once over the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and _LOCAL.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append((a, "email", m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], ORDER[s[1]]))


# --- candidates ------------------------------------------------------------------------------------

#: Words that announce a kind.
CUES = {
    "secret": "token key secret password passwd passphrase passcode pwd apikey bearer auth authorization credential credentials",
    "phone": "phone tel telephone call mobile fax cell",
    "account": "account acct konto iban bank routing card number",
    "ssn": "ssn social security",
    "name": "mr mrs ms dr prof name",
    "plain": "commit sha md5 checksum hash version isbn uuid id",
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words.split()}
#: What makes a value without a digit worth a look: a cue with a sign of assignment, or a title before a capital.
_ANNOUNCED = r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|(?:access|private)[ _-]?key|bearer|credentials?)[\"']?(?:\s{0,2}[:=]{1,2}|\sis\b)\s{0,2}[\"']?"
_TITLED = r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\b\.?|(?i:name)(?:\sis|:))\s{1,2}(?=[^\W\d_a-z])"
_MARK = re.compile(rf"(?P<plain>[0-9@])|(?P<announced>{_ANNOUNCED})|(?P<titled>{_TITLED})")
PLAIN, ANNOUNCED, TITLED = 1, 2, 3
#: Parts of announcements, in lower case, and what makes one of them a mark; titles as they are written.
_PARTS = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential", b"name")
_SAID = re.compile(rb"[a-z]+[\"']?(?:\s{0,2}[:=]|\sis\b)")
_TITLES = (b"Mr", b"Ms", b"Dr", b"Prof")
_TITLE = re.compile(rb"(?:Mrs?|Ms|Dr|Prof)\b\.?\s")

BUCKETS, FEATURES = 1 << 12, 20
_NAMES: dict[str, int] = {}


def _bucket(name: str) -> int:
    if len(_NAMES) > 50_000:
        _NAMES.clear()
    if (k := _NAMES.get(name)) is None:
        k = _NAMES[name] = zlib.crc32(name.encode()) % BUCKETS
    return k


def _kind(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c


def features(span: str, before: list[str], after: str) -> list[int]:
    """Buckets of the features of a span and of the words around it (nearest first)."""
    kinds = [_kind(c) for c in span]
    digits, upper, lower = kinds.count("9"), kinds.count("A"), kinds.count("a")
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", re.sub(r"[^\W0-9_]+", "a", span[:48]))
    solid = digits + upper + lower == len(span)
    hexa = solid and digits > 0 and upper + lower > 0 and all(c in "0123456789abcdefABCDEF" for c in span)
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    word = (before[0] if before else "").lower()
    cue = next((k for w in before if (k := _CUE_OF.get(w.lower()))), "")
    size = len(span).bit_length() if len(span) < 24 else 5 + (len(span) >= 32) + (len(span) >= 48)
    titled = all(w[:1].isupper() and w[1:].islower() for w in re.split(r"[ .'-]+", span) if w)
    dated = digits >= 8 and span[:2] in ("19", "20") and span[4:6] <= "12" and span[6:8] <= "31"
    names = [
        f"digits{min(digits, 20)}", f"letters{min(upper + lower, 8).bit_length()}", f"shape{shape}", f"solid{solid}{size}", f"hex{hexa}{size}",
        f"mix{lower > 0}{upper > 0}{digits > 0}{size}", f"turns{min(turns, 24) // 3}{solid}", f"open{span.count('(')}{span.count(')')}", f"first{kinds[0]}", f"last{kinds[-1]}",
        f"blank{min(span.count(' '), 3)}", f"dots{min(span.count('.'), 4)}{min(span.count('-'), 4)}", f"before{_CUE_OF.get(word) or _kind(word[:1])}", f"cue{cue}", f"cue{cue}{size}{digits > 0}",
        f"edge{_kind(before[0][-1:]) if before else ''}{_kind(after[:1])}", f"hexcue{hexa}{cue}", f"titled{titled}{upper}", f"dated{dated}{digits}{span[:3] if digits == 13 else ''}", "bias",
    ]
    return [_bucket(n) for n in names]


#: An address without a user's password before it or a path behind it; letters of any script.
_ADDRESS = re.compile(r"[\w.%+-]+@(?:[\w-]+\.)+[\w-]*\w")
#: A date, with what may follow it.
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./ ])(?:0[1-9]|1[0-2])\1[0-3][0-9](?![0-9])")
_SECRET_LEFT, _SECRET_RIGHT = " \t\n\r\"'`=:([{<,;|>", " \t\n\r\"'`)]}>,;.|<&!?"


def allowed(span: str, left: str = "", right: str = "", announced: bool = False, titled: bool = False) -> np.ndarray:
    """0 for kinds that a span may be between two characters, minus infinity for those that its check digits, ranges,
    counts or edges rule out. ``announced`` and ``titled``: it follows a cue, or a title."""
    digits = "".join(c for c in span if c in "0123456789")
    parts, packed, blank = span.split("."), span.replace(" ", ""), " " in span
    numeric = len(digits) + span.count(" ") + span.count("-") == len(span)
    apart = not (left.isalnum() or right.isalnum())
    ok = (
        _ADDRESS.fullmatch(span) is not None,
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        numeric and 12 <= len(digits) <= 19 and luhn(digits),
        9 <= len(digits) <= 15 and len(digits) + sum(span.count(c) for c in " ().+-/") == len(span) and not _DATE.match(span),
        not blank and "@" not in span and (len(span) >= 16 or announced and len(span) >= 6) and (left in _SECRET_LEFT and right in _SECRET_RIGHT),
        apart and 15 <= len(packed) <= 34 and packed.isascii() and packed[:2].isalpha() and packed.isupper() and packed.isalnum() and packed[2:4].isdigit() and mod97(packed),
        apart and bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}([ -])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}", span)),
        apart and numeric and 8 <= len(digits) <= 19,
        titled and apart and not digits and all(w[:1].isupper() and w.isalpha() for w in re.split(r"[ .'-]+", span) if w),
    )
    return np.where(ok, 0.0, -np.inf)


Candidates = tuple[np.ndarray, np.ndarray, np.ndarray]


class Region:
    """The tokens of a stretch of text; its candidate segments are made when asked for, end by end."""

    def __init__(self, text: str, starts: np.ndarray, stops: np.ndarray, marked: np.ndarray) -> None:
        self.text, self.starts, self.stops, self.marked = text, starts, stops, marked

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.stops[i]]

    def _ends(self, i: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """End token, features and allowed kinds of the candidates that start at token ``i``."""
        first = self.word(i)
        if not (first[0].isalnum() or first[0] in "+(_-/"):
            return
        a, near, some, blanks, digits, groups, dots = int(self.starts[i]), None, 0, False, 0, 0, 0
        announced, titled = self.marked[i] == ANNOUNCED, self.marked[i] == TITLED
        number, solid, name, upper = True, True, titled, len(first) > 3 and first[:2].isalpha() and first.isascii()
        left = self.text[a - 1] if a else ""
        open_ = left in _SECRET_LEFT
        for j in range(i + 1, min(len(self), i + MAX_TOKENS) + 1):
            tok, b = self.word(j - 1), int(self.stops[j - 1])
            if tok.isspace():
                if "\n" in tok or len(tok) > 2:
                    return
                blanks, solid = True, False
                continue
            some |= int(self.marked[j - 1])
            if tok.isdecimal():
                digits, groups = digits + len(tok), groups + 1
            else:
                number = number and tok in "+().-/"
                dots += tok == "."
            number = number and digits < 20 and groups < 8 and not (dots and blanks)
            name = name and (tok[0].isupper() if tok[0].isalpha() else tok in ".'-")
            upper = upper and tok.isalnum() and tok == tok.upper()
            if not (number or solid or name or upper) or b - a > MAX_CHARS:
                return
            if not some or not (tok[-1].isalnum() or solid and tok in "=_-/+"):
                continue
            size, right = b - a, self.text[b : b + 1]
            if not (
                number and (digits > 7 or dots == 3)
                or solid and (open_ and right in _SECRET_RIGHT and size > (5 if announced else 15) or size > 4 and "@" in self.text[a:b])
                or upper and 14 < size < 43 or name
            ):
                continue
            span = self.text[a:b]
            may = allowed(span, left, right, announced, titled)
            if np.isneginf(may).all():
                continue
            if near is None:
                near = [w for k in range(i - 1, max(-1, i - 8), -1) if not (w := self.word(k)).isspace()][:5]
            after = next((w for k in range(j, min(len(self), j + 2)) if not (w := self.word(k)).isspace()), "")
            yield j, features(span, near, after), may

    def ends(self) -> Iterator[Candidates | None]:
        """For each end token 1, 2, ...: the candidates' first tokens, features and allowed kinds."""
        waiting: dict[int, list] = {}
        for i in range(len(self)):
            for j, f, may in self._ends(i):
                waiting.setdefault(j, []).append((i, f, may))
            got = waiting.pop(i + 1, None)
            yield got and tuple(map(np.array, zip(*got)))


class Field:
    """Log-linear weights of segments by kind, and of a kind after a kind; label 0 is a token outside of any entity."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((BUCKETS, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def best(self, region: Region) -> list[tuple[int, int, str]]:
        """Segments (first token, end token, kind) of the best segmentation; only the scores of the last tokens are kept."""
        size, n, ring = len(KINDS) + 1, len(region), MAX_TOKENS + 1
        v, width, came = np.full((ring, size), -np.inf), np.ones((n + 1, size), np.int8), np.zeros((n + 1, size), np.int8)
        v[0, 0], k, before, stay = 0, np.arange(size - 1), 0.0, float(self.t[0, 0])
        # While no entity ends, the score of "outside" alone goes on, as a plain number.
        for j, found in enumerate(region.ends(), 1):
            now = v[j % ring]
            if before is None:
                out = v[(j - 1) % ring] + self.t[:, 0]
                came[j, 0] = out.argmax()
                before = float(out[came[j, 0]])
            else:
                before += stay
            now[:] = -np.inf
            now[0] = before
            if found:
                i, f, may = found
                ways = v[i % ring][:, :, None] + self.t[None, :, 1:]
                score = ways.max(1) + self.w[f].sum(1) + may
                pick = score.argmax(0)
                now[1:], width[j, 1:], came[j, 1:] = score[pick, k], j - i[pick], ways[pick, :, k].argmax(1)
                before = None
        j, y, segments = n, int(v[n % ring].argmax()), []
        while j > 0:
            i, k = j - int(width[j, y]), int(came[j, y])
            if y:
                segments.append((i, j, KINDS[y - 1]))
            j, y = i, k
        return segments[::-1]

    def expected(self, ends: list[Candidates | None]) -> tuple[float, list[np.ndarray | None], np.ndarray]:
        """The log of the partition sum, the probability of each candidate as each kind, and the expected number of each
        transition, over all segmentations."""
        n, size = len(ends), len(KINDS) + 1
        a, b = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        scores = [e and self.w[e[1]].sum(1) + e[2] for e in ends]
        a[0, 0] = 0
        for j in range(1, n + 1):
            a[j, 0] = _lse(a[j - 1] + self.t[:, 0])
            if ends[j - 1]:
                a[j, 1:] = _lse(_lse((a[ends[j - 1][0]][:, :, None] + self.t[None, :, 1:]).transpose(1, 0, 2)) + scores[j - 1])
        b[n] = 0
        for j in range(n, 0, -1):
            b[j - 1] = np.logaddexp(b[j - 1], self.t[:, 0] + b[j, 0])
            if ends[j - 1]:
                for i, s in zip(ends[j - 1][0].tolist(), scores[j - 1]):
                    b[i] = np.logaddexp(b[i], _lse((self.t[:, 1:] + s + b[j, 1:]).T))
        total, moves, each = _lse(a[n]), np.zeros_like(self.t), []
        for j in range(1, n + 1):
            moves[:, 0] += np.exp(a[j - 1] + self.t[:, 0] + b[j, 0] - total)
            each.append(None)
            if ends[j - 1]:
                p = np.exp(a[ends[j - 1][0]][:, :, None] + self.t[None, :, 1:] + (scores[j - 1] + b[j, 1:])[:, None, :] - total)
                moves[:, 1:] += p.sum(0)
                each[-1] = p.sum(1)
        return float(total), each, moves

    def step(self, ends: list[Candidates | None], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the log-likelihood of the gold segments (first token, end token, label), in order."""
        _, each, moves = self.expected(ends)
        label, at = 0, 0
        for i, j, y in gold:
            moves[label, 0] -= i > at
            moves[0, 0] -= max(0, i - at - 1)
            moves[0 if i > at else label, y] -= 1
            label, at = y, j
        moves[label, 0] -= len(ends) > at
        moves[0, 0] -= max(0, len(ends) - at - 1)
        self.t -= rate * moves
        some = [(j, e, p) for j, (e, p) in enumerate(zip(ends, each), 1) if e]
        if not some:
            return
        place = {(i, j): n for n, (i, j) in enumerate((i, j) for j, e, _ in some for i in e[0].tolist())}
        f, q = np.concatenate([e[1] for _, e, _ in some]), np.concatenate([p for *_, p in some])
        for i, j, y in gold:
            if (i, j) in place:
                q[place[i, j], y - 1] -= 1
        far = np.abs(q).max(1) > 1e-3
        np.add.at(self.w, f[far], -rate * q[far][:, None, :])


def _lse(x: np.ndarray) -> np.ndarray:
    m = np.maximum(x.max(0), -1e300)
    with np.errstate(divide="ignore"):
        return m + np.log(np.exp(x - m).sum(0))


def regions(text: str) -> Iterator[Region]:
    """The stretches of text around marks. Windows of characters are tokenised, and cut where marks lie far apart."""
    reach, window, marks = 2 * MAX_CHARS, None, []
    for m in _MARK.finditer(text):
        kind = {"plain": PLAIN, "announced": ANNOUNCED, "titled": TITLED}[m.lastgroup]
        a = m.start() if kind == PLAIN else m.end()
        if window and a - reach > window[1]:
            yield from _cut(text, window, marks)
            window, marks = None, []
        window = (window[0] if window else max(0, a - reach), a + reach)
        marks.append((a, kind))
    if window:
        yield from _cut(text, window, marks)


def _cut(text: str, window: tuple[int, int], marks: list[tuple[int, int]]) -> Iterator[Region]:
    lo, hi = window[0], min(len(text), window[1])
    while lo > 0 and text[lo - 1].isalnum():
        lo -= 1
    while hi < len(text) and text[hi].isalnum():
        hi += 1
    spans = np.array([m.span() for m in _TOKEN.finditer(text, lo, hi)], np.int64).reshape(-1, 2)
    marked = np.zeros(len(spans), np.int8)
    for a, kind in marks:
        k = int(np.searchsorted(spans[:, 0], a, "right")) - 1
        if a < spans[k, 1]:
            marked[k] = max(marked[k], kind)
    hot = np.flatnonzero(marked)
    for part in np.split(hot, np.flatnonzero(np.diff(hot) > 2 * (CONTEXT + MAX_TOKENS)) + 1) if len(hot) else ():
        a, b = max(0, int(part[0]) - CONTEXT - MAX_TOKENS), min(len(spans), int(part[-1]) + CONTEXT + MAX_TOKENS)
        yield Region(text, spans[a:b, 0], spans[a:b, 1], marked[a:b])


# --- training --------------------------------------------------------------------------------------

Sentence = tuple[str, list[tuple[int, int, str]]]


def training_sentences(n: int = 1400, seed: int = 41) -> list[Sentence]:
    """Sentences with entities of each kind in common formats, and with numbers and names that are none; always the
    same for a seed. The formats are those that issuers of keys, banks and offices publish."""
    rng = random.Random(seed)
    plain = "the of and to report sent by from with for on our last order item page call value code is was at".split()
    pick, number = rng.choice, lambda k: "".join(rng.choices("0123456789", k=k))
    of = lambda letters, k: "".join(rng.choices(letters, k=k))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = low + up + "0123456789"

    def word() -> str:
        return pick(plain) if rng.random() < 0.5 else of("aeinrstlo", 1) + of(low + "éüñ", rng.randint(1, 9))

    def words(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def card(k: int = 16) -> str:
        body = number(k - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban() -> str:
        land, body = of(up, 2), of("0123456789", rng.choice([12, 14, 16, 18, 20]))
        body = body if rng.random() < 0.7 else of(up, 4) + body[4:]
        packed = next(land + f"{c:02d}" + body for c in range(2, 99) if mod97(land + f"{c:02d}" + body))
        return packed if rng.random() < 0.5 else " ".join(packed[i : i + 4] for i in range(0, len(packed), 4))

    def quads(d: str, sign: str) -> str:
        return sign.join(d[i : i + 4] for i in range(0, len(d), 4))

    def secret() -> tuple[str, str, str]:
        free = pick([
            lambda: "AKIA" + of(up + "234567", 16), lambda: "gh" + pick("pous") + "_" + of(alnum, 36), lambda: pick(["sk_live_", "sk_test_", "glpat-", "hf_"]) + of(alnum, pick([20, 24, 34])), lambda: "xox" + pick("bap") + "-" + number(11) + "-" + of(alnum, 24),
            lambda: "AIza" + of(alnum + "_-", 34) + "x", lambda: "eyJ" + of(alnum, 17) + "." + of(alnum, 24) + "." + of(alnum + "_-", 20) + "Q", lambda: of(alnum, rng.randint(20, 44)), lambda: of(alnum + "+/", 38) + "a=",
        ])
        said = pick([lambda: of("0123456789abcdef", pick([32, 40, 64])), lambda: of(alnum, rng.randint(6, 20)), lambda: of(low, rng.randint(6, 12)) + pick(["", number(2), "!" + number(1)]) + pick("xyz9"), free])
        cue = pick(["password", "passwd", "api_key", "token", "secret", "apikey", "Password", "access_key", "client_secret", "auth token", "Bearer token", "private key"])
        sign, quote = pick([": ", "=", " = ", ":", " is "]), pick(["", "", '"', "'"])
        if rng.random() < 0.35:
            return "", free() if rng.random() < 0.7 else of("0123456789abcdef", pick([32, 40, 64])), ""
        return cue + sign + quote, said(), quote

    def first_last() -> str:
        name = lambda: of(up, 1) + of(low, rng.randint(2, 8))
        return pick([name, lambda: f"{name()} {name()}", lambda: f"{name()} {of(up, 1)}. {name()}", lambda: f"{name()} {name()}-{name()}"])()

    def make(kind: str) -> tuple[str, str, str]:
        """What stands before, the entity, and what closes it."""
        own = of(low, rng.randint(3, 8))
        if kind == "email":
            return "", pick([f"{own}.{number(2)}@{of(low, 5)}.{of(low, 4)}.com", f"{own}@{own[::-1]}.org", f"{own}_{number(2)}@host.net", f"{of(up, 1)}{own}+{of(low, 3)}@{of(low, 6)}.co.uk"]), ""
        if kind == "ip":
            return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), ""
        if kind == "card":
            return pick(["", "card ", "card number "]), pick([lambda x: x, lambda x: quads(x, " "), lambda x: quads(x, "-")])(card(pick([15, 16, 16, 16]))), ""
        if kind == "phone":
            a, b, c, d = number(3), number(3), number(4), number(2)
            return pick(["", "", "tel ", "tel: ", "call ", "phone: ", "fax ", "my number is "]), pick([f"+1 ({a}) {b}-{c}", f"+{d} {a} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d} {number(2)} {c} {number(4)}", f"0{number(2)} {c} {number(4)}", f"0{number(3)} {number(7)}"]), ""
        if kind == "iban":
            return pick(["", "IBAN ", "IBAN: ", "account "]), iban(), ""
        if kind == "ssn":
            area = pick([k for k in range(1, 900) if k != 666])
            return pick(["", "SSN ", "SSN: ", "social security number "]), f"{area:03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", ""
        if kind == "account":
            k = pick([13, 14, 15, 16, 16, 16, 16, 17, 18, 19])
            body = pick("12345678") + number(k - 1)
            while luhn(body) or body[:2] in ("19", "20") or k == 13 and body[:3] in ("978", "979"):
                body = pick("345678") + number(k - 1)
            if rng.random() < 0.25:
                return pick(["account ", "account number ", "acct: ", "Konto "]), number(pick([8, 9, 10, 11, 12])), ""
            return pick(["", "", "", "account "]), pick([body, body, body, quads(body, " ") if k == 16 else body, quads(body, "-") if k == 16 else body]), ""
        if kind == "name":
            return pick(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "my name is ", "Name: ", "Prof. "]), first_last(), ""
        return secret()

    none: list[Callable[[], str]] = [
        lambda: number(rng.randint(1, 8)), lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", lambda: f"{number(3)},{number(3)}",
        lambda: f"{number(2)}%", lambda: f"${number(3)}.{number(2)}", lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: f"{pick(plain)}{number(2)}", lambda: f"{number(3)} {number(4)}", lambda: f"{number(4)}-{number(4)}",
        lambda: f"@{pick(plain)}", lambda: number(24), lambda: f"{number(2)} {pick(plain)} {number(2)}", lambda: f"({number(4)})", lambda: f"{number(3)}-{number(2)}", lambda: f"{number(5)}-{number(3)}-{number(6)}",
        lambda: number(pick([9, 10, 11, 12])), lambda: f"{number(4)} {number(4)} {number(4)}", lambda: f"3{number(2)}.{number(3)}.{number(2)}.{number(1)}", lambda: f"97{pick('89')}{number(10)}", lambda: f"ISBN 97{pick('89')}-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: f"20{number(2)}0{rng.randint(1, 9)}1{number(1)}{number(6)}", lambda: " ".join(number(rng.randint(1, 3)) for _ in range(8)), lambda: f"commit {of('0123456789abcdef', 40)}", lambda: f"sha {of('0123456789abcdef', 64)}", lambda: "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: f"https://{of(low, 7)}.com/{of(low, 9)}/{number(4)}", lambda: f"IMG_20{number(6)}_{number(6)}.jpg", lambda: f"#{of('0123456789abcdef', 6)}", lambda: f"the {pick(['token', 'key', 'secret', 'password'])} is {word()}", lambda: f"{pick(['token', 'secret', 'key'])}: {pick(plain)}",
        lambda: f"chapter-{number(2)}-of-the-{of(low, 6)}-{of(low, 7)}", lambda: f"http://{of(low, 12)}.org/{of(low, 8)}-{of(low, 6)}-{number(2)}.html", lambda: f"the name is {word()}", lambda: of(low, rng.randint(16, 24)) + number(1), lambda: f"{number(2)}/{number(2)}/{number(4)}",
    ]
    out = []
    for k in range(n):
        text, spans = words(4), []
        for m in range(rng.randint(1, 2)):
            kind = (*KINDS, "secret", "account", *[""] * 7)[(7 * k + 5 * m + rng.randint(0, 17)) % 18]
            lead, value, close = make(kind) if kind else ("", pick(none)(), "")
            text += " " + lead
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value + close + pick([" ", ". ", ", "]) + words(3)
        out.append((text, spans))
    return out


def gold_segments(region: Region, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """The spans inside a region as first token, end token and label."""
    at, to = {int(a): k for k, a in enumerate(region.starts)}, {int(b): k + 1 for k, b in enumerate(region.stops)}
    return [(at[a], to[b], ORDER[kind] + 1) for a, b, kind in spans if a in at and b in to]


def trimmed(ends: list[Candidates | None], gold: list[tuple[int, int, int]]) -> tuple[list[Candidates | None], list[tuple[int, int, int]]] | None:
    """A region without the tokens before its first candidate and after its last one, which are outside whatever the
    weights are."""
    if not any(ends):
        return None
    lo = max(0, min(int(e[0].min()) for e in ends if e) - 1)
    hi = max(j for j, e in enumerate(ends, 1) if e) + 1
    return [e and (e[0] - lo, *e[1:]) for e in ends[lo:hi]], [(i - lo, j - lo, y) for i, j, y in gold]


def fit(sentences: list[Sentence], rounds: int = 3) -> Field:
    field, data = Field(), []
    for text, spans in sentences:
        for region in regions(text):
            if some := trimmed(list(region.ends()), gold_segments(region, spans)):
                data.append(some)
    for r in range(rounds):
        random.Random(r).shuffle(data)
        for ends, gold in data:
            field.step(ends, gold, 0.25 / (1 + r))
    return field


_FIELD: list[Field] = []


def fitted() -> Field:
    """The field of the generator's sentences; fitted once in a process."""
    if not _FIELD:
        _FIELD.append(fit(training_sentences()))
    return _FIELD[0]


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and these with those the field adds, as (start, kind, end) in order."""
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0, np.int64)
    starts = [a for a, _ in taken]
    more = []
    for region in regions(text):
        for i, j, kind in field.best(region):
            a, b = int(region.starts[i]), int(region.stops[j - 1])
            k = int(np.searchsorted(starts, b)) if starts else 0
            n = int(np.searchsorted(reach, a, "right"))
            if n >= k or all(a <= x and y <= b and y - x < b - a for x, y in taken[n:k]):
                more.append((a, kind, b))
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[1]]))


# --- Spark -----------------------------------------------------------------------------------------

PII = T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])))


def _searched(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rows that hold a digit, an @, or what may be a cue or title."""
    look = np.zeros(256, bool)
    look[[*range(48, 58), 64]] = True
    hit, raw = look[data], data.tobytes()
    for text, parts, sure in ((raw.lower(), _PARTS, _SAID), (raw, _TITLES, _TITLE)):
        for part in parts:
            at = text.find(part)
            while at >= 0:
                hit[at] |= sure.match(text, at) is not None
                at = text.find(part, at + 1)
    count = np.concatenate([[0], np.cumsum(hit)])
    return np.flatnonzero(count[offs[1:]] > count[offs[:-1]])


def _finding(text: str, field: Field) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                column, out = part.column(text), [[] for _ in range(part.num_rows)]
                for r in _searched(data, offs).tolist():
                    base, both = all_spans(column[r].as_py(), field)
                    own = set(base)
                    out[r] = [{"kind": k, "start": a, "end": b, "base": (a, k, b) in own} for a, k, b in both]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
                yield append(part, {"pii": pa.array(out, kind)})

    return run


def _clean(value: str | None, spans: list[dict] | None) -> str | None:
    if not value or not spans:
        return value
    out, done, merged = [], 0, []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [value[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, value[done:]])


def _redacting(text: str, pii: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, _, _ in slices(batch, text):
                hit = part.column(pii).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
                values = part.column(text).to_pylist()
                for r in np.flatnonzero(hit).tolist():
                    values[r] = _clean(values[r], part.column(pii)[r].as_py())
                yield append(part, {text: pa.array(values, pa.string())}).select(part.schema.names)

    return run


def find_pii(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """Adds ``pii``, an array of (kind, start, end, base) in order of start and kind; offsets in code points, end exclusive."""
    return arrow_map(df, _finding(text, field or fitted()), plus(df.schema, PII))


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Puts ``[KIND]`` in the text where spans lie; of overlapping ones the first, then longest, names the whole stretch.
    Texts without spans, and null, stay as they are."""
    return arrow_map(df, _redacting(text, pii), df.schema)


def find_and_redact(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``redact(find_pii(df))`` in one pass and without the spans: the columns stay as they are, one named ``pii`` too."""
    find, put = _finding("text", field or fitted()), _redacting("text", "pii")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            alone, at = pa.RecordBatch.from_arrays([batch.column(text)], ["text"]), batch.schema.names.index(text)
            cleaned = [b.column("text") for b in put(find(iter([alone])))]
            yield batch.set_column(at, batch.schema.field(at), pa.concat_arrays(cleaned)) if cleaned else batch

    return arrow_map(df, run, df.schema)
