"""Personal data: base patterns, and candidates that boosted trees decide on.

Base kinds (email, ip, card, phone) are exact patterns with checks; their spans always stand. Beyond them, high-recall
generators propose overlapping spans (keys, assigned secrets, hex strings, signed tokens, private keys, national numbers,
account numbers, labelled and local telephone numbers, addresses spelled with at and dot). Gradient-boosted trees score each from its format and its context;
thresholds are set on held-out examples of calibrated probabilities, and among overlapping spans the longest is taken
(then the likeliest), unless a base span overlaps.

No table labels personal data, so the trees learn from ``EXAMPLES`` seeded synthetic candidates, made here by the rules of
``_example``; the number is a parameter. Training takes seconds on the driver; the model is a few kilobytes.

Scale: one pass over the texts, no shuffle. Patterns use possessive runs or anchors, so time is linear in a text's length. No
candidate is bounded in length, so a span takes a whole token or none of it.

Defined results: null text has no span; offsets are code points; repeated rows each give their own; an empty table none.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import batch_of, ddl, pieces, ship, table, texts
from .boosting import Boosted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "address")
EXAMPLES = 9000
RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS[4:]), ("n_spans", pa.int64())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = end = m.end()
            out.append(("email", start, end))
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


#: What keys of secrets are called, and lines before numbers of persons.
_KEYS = r"password|passwd|pwd|passphrase|token|secret|api[_-]?key|auth|credential|access[_-]?key|private[_-]?key|session|_key\b"
_LABELS = ("phone", "telephone", "telefon", "tel", "mobile", "mobil", "cell", "fax", "call", "hp", "whatsapp", "reach", "handy", "ssn", "account", "acct", "passport", "iban", "konto")
_PEM = r"(?:[A-Z]{2,10} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
#: Candidate generators: kind; whether a match holds a digit; texts in lower case one of which has to be there (none: no matter);
#: the pattern, whose last group is the span; and what the 64 characters before the match have to end with, if anything. So a
#: search starts at rare characters. High recall; the trees decide. Spans are whole tokens of any length; a key's name may go
#: on for 40 characters after its word.
GENERATORS = [
    ("secret", False, (), re.compile(r"(?:=>|[=:])(?=[ \t]{0,3}[\"']?[^\s\"',;]{6})"), re.compile(rf"(?i)(?:{_KEYS})[a-z0-9_.-]{{0,40}}[\"']?[ \t]{{0,3}}$")),
    ("secret", False, (), re.compile(r"(?<![A-Za-z0-9_])([A-Z]{2}[A-Z0-9]{12,}+)(?![A-Za-z0-9_])"), None),
    ("secret", True, (), re.compile(r"(?<![A-Za-z0-9_-])((?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{16,}+)(?![A-Za-z0-9])"), None),
    ("secret", False, ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?)"), None),
    ("secret", False, ("private key",), re.compile(rf"(-----BEGIN {_PEM}(?:[A-Za-z0-9+/=\s]*+-----END {_PEM})?)"), None),
    ("secret", False, ("bearer",), re.compile(r"(?i)\bbearer[ \t]{1,3}([a-z0-9._~+/=-]{16,}+)"), None),
    ("secret", True, ("token", "secret", "key", "password"), re.compile(r"(?<![A-Za-z0-9/+_.=-])((?=[A-Za-z/_.-]*+[0-9])[A-Za-z0-9/+_.=-]{12,}+)(?![A-Za-z0-9])"), re.compile(r"(?i)(?:token|secret|key|password)(?: is|:|=)? [\"']?$")),
    ("number", True, (), re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), None),
    ("number", True, (), re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), None),
    ("number", True, (), re.compile(r"(?<![0-9.+-])(\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9.-])"), None),
    ("number", True, (), re.compile(r"(?<![0-9.])([0-9]{9,19})(?![0-9.])"), None),
    ("number", True, _LABELS, re.compile(r"(?<![0-9(])(\(?[0-9][0-9 ()./-]{5,24}[0-9])(?![0-9])"), re.compile(rf"(?i)\b(?:{'|'.join(_LABELS)})\b(?:[ \t](?:me|us|on|at|number|no\b\.?|is)){{0,2}}[.:#]{{0,2}}[ \t]{{0,3}}$")),
    ("number", True, ("passport", "licen"), re.compile(r"(?<![A-Za-z0-9])((?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,10}+)(?![A-Za-z0-9])"), re.compile(r"(?i)\b(?:passport|licen[cs]e)(?: (?:no\b\.?|number))?[.:#]{0,2}[ \t]{1,3}$")),
    ("address", False, ("dot",), re.compile(r"(?i)(?<![a-z0-9._%+-])([a-z0-9._%+-]++ ?(?: at |\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?: dot |\(dot\)|\[dot\]) ?[a-z0-9-]++)+)"), None),
]
#: What a pattern without a group assigns: the token after it. Signs within a token that was taken aren't tried again.
_VALUE = re.compile(r"[ \t]{0,3}[\"']?([^\s\"',;]{6,}+)")
_WORDS = ("password", "token", "secret", "key", "ssn", "iban", "account", "phone", "tel", "call", "order", "version", "page", "mobile", "fax", "cell", "passport", "auth")
#: Before a hash, and about a number, that is of no person.
_HASHED = ("commit", "sha", "md5", "checksum", "revision", "hash ", "uuid", "id ", "rev ")
_COUNTED = ("population", "isbn", "build", "invoice", "order", "timestamp", "distance", "page", "version", "years", "score", "sector", "chapter", "verse", "over", "a ratio")
_ASKED = ("mail", "write", "contact", "reach", "address")
_VERBS = frozenset("meet look point stare arrive be see start gather stop stood sat aim laugh met looked arrived one it us them".split())
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "id", "uk", "io")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end); spans may overlap. A pattern is left out only where nothing that each of its matches needs is there."""
    digit, low, out = _DIGIT.search(text), text.lower(), []
    for k, (_, needs, hints, pattern, before) in enumerate(GENERATORS):
        if (digit or not needs) and (not hints or any(h in low for h in hints)):
            found = (m for m in pattern.finditer(text) if before is None or before.search(text, max(0, m.start() - 64), m.start()))
            if pattern.groups:
                out += [(k, *m.span(1)) for m in found]
                continue
            taken = 0
            for m in found:
                if m.end() > taken:
                    start, taken = _VALUE.match(text, m.end()).span(1)
                    out.append((k, start, taken))
    return out


def describe(text: str, generator: int, start: int, end: int) -> list[float]:
    """Format of the span, and the 32 characters before and 12 after it. Of a span, the first 512 characters are counted."""
    s = text[start:end]
    n, s = len(s), s[:512]
    counts = {c: s.count(c) for c in set(s)}
    digits, upper, lower = sum(map(str.isdigit, s)), sum(map(str.isupper, s)), sum(map(str.islower, s))
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    m, kinds = len(s), ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    entropy = -sum(v / m * math.log2(v / m) for v in counts.values())
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    longest = max((len(w) for w in re.findall(r"[a-z]+|[A-Z]+", s)), default=0)
    vowels = sum(c in "aeiouAEIOU" for c in s) / max(1, upper + lower)
    return [
        n, digits / m, upper / m, lower / m, entropy, len(counts), sum(c in "0123456789abcdef" for c in s) / m, s.count("-") + s.count(" ") + s.count("."), turns / m, longest / m, vowels, s.count("_"), s.count("-"),
        float(bool(_UUID.fullmatch(s))), float(s[0].isdigit()), float(s[0] == "0"), float(s[0] == "("), float(s.lower().rpartition("dot")[2].strip(" )]") in _ENDINGS), float("(at" in s.lower() or "[at" in s.lower()),
        float(s.lower().split(" at ")[0] in _VERBS), float(any(c in s.split(" ")[0] for c in "._0123456789")), float(any(w in before for w in _ASKED)), float(s.startswith("eyJ")), float("PRIVATE KEY" in s), float("(" in s[1:] or "[" in s),
        float(before[-1:] in ("=", ":", '"', "'")), float("=" in before), float(before.endswith(("= ", ": "))), float(any(w in before for w in _HASHED)), float(any(w in before for w in _COUNTED)), float(after[:1] == " " and after[1:2].isalpha()), float("bearer" in before),
        *(float(w in before) for w in _WORDS), *(float(generator == k) for k in range(len(GENERATORS))),
    ]


def _example(rng: random.Random) -> tuple[str, int, int, int, int] | None:
    """A text with one candidate: (text, generator, start, end, label)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda a=2, b=9: pick(letters, rng.randint(a, b))
    spoken = lambda k: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s")) for _ in range(k))
    digits = lambda n: pick("0123456789", n)
    hexa = lambda n: pick("0123456789abcdef", n)
    code = lambda n: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", n)
    mixed = lambda n: pick(letters + letters.upper() + "0123456789", n)
    local = lambda: rng.choice([f"0{digits(3)} {digits(7)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"(0{digits(2)}) {digits(6)}", f"0{digits(2)}-{digits(8)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)}-{digits(4)}-{digits(4)}", f"0{digits(4)} {digits(6)}"])
    named = lambda: rng.choice(["", "my_", "db_", "client_", "aws_", "X-", "MAIN_", "stripe."]) + rng.choice(["password", "secret", "token", "api_key", "apiKey", "auth_token", "secret_access_key", "SECRET_KEY", "private_key", "access_key", "passwd", "credentials"])
    assign = lambda: rng.choice(["=", " = ", ": ", ":", '="', "='", " => ", '": "'])
    number_word = lambda: rng.choice(["phone ", "phone: ", "tel ", "tel: ", "Tel. ", "mobile ", "mobile: ", "fax: ", "call ", "call me on ", "cell: ", "HP ", "reach us at ", "whatsapp: ", "Telefon ", "phone number: "])
    made = rng.choice([
        (1, lambda: (rng.choice(["password=", "passwd: ", "pwd=", "secret=", "auth: "]), hexa(rng.randint(10, 40)))),
        (1, lambda: (rng.choice(['token = "', 'api_key="', "token=", "secret: "]), hexa(rng.randint(24, 48)))),
        (1, lambda: (named() + assign(), rng.choice([mixed, hexa, lambda n: pick(letters + letters.upper() + "0123456789+/", n)])(rng.randint(12, 44)))),
        (1, lambda: (named() + assign(), spoken(rng.randint(3, 6)) + digits(rng.randint(1, 4)))),
        (1, lambda: (named() + assign(), pick(letters + "0123456789&!$#%@.", rng.randint(8, 20)) + digits(1))),
        (1, lambda: ("", "AKIA" + code(16))),
        (1, lambda: (rng.choice(["", "key ", "token "]), rng.choice(["sk_live_", "pk_test_", "ghp_", "gho_", "npm_", "xoxb-" + digits(12) + "-", "sk-", "rk_live_", "glpat-", "AIza", "hf_"]) + mixed(rng.randint(20, 40)))),
        (1, lambda: (rng.choice(["", "token: ", "session=", "jwt "]), "eyJ" + mixed(rng.randint(12, 40)) + ".eyJ" + mixed(rng.randint(12, 60)) + rng.choice(["", "." + mixed(rng.randint(20, 43))]))),
        (1, lambda: (rng.choice(["Authorization: Bearer ", "bearer "]), mixed(rng.randint(20, 60)))),
        (1, lambda: ("", "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----")),
        (1, lambda: (rng.choice(["the token: ", "refresh token ", "key is ", "secret: "]), mixed(rng.randint(6, 9)) + rng.choice("/._-") + mixed(rng.randint(8, 24)) + digits(1))),
        (1, lambda: (rng.choice(["", "key "]), rng.choice(["ASIA", "AIZA", "GHP"]) + code(rng.randint(16, 32)))),
        (1, lambda: (rng.choice(["", "ssn ", "ssn: "]), f"{digits(3)}-{digits(2)}-{digits(4)}")),
        (1, lambda: (rng.choice(["iban ", "account ", "IBAN: ", "pay to "]), rng.choice(["DE", "GB", "FR", "NL"]) + digits(2) + rng.choice([digits(18), "".join(" " + digits(4) for _ in range(4)) + " " + digits(2), "NWBK" + digits(14), "".join(" " + code(4) for _ in range(5))]))),
        (1, lambda: (number_word(), local())),
        (1, lambda: (number_word(), local())),
        (1, lambda: (rng.choice(["", number_word()]), f"({digits(3)}) {digits(3)}-{digits(4)}".replace(") ", rng.choice([") ", ")-"])))),
        (1, lambda: (rng.choice(["account ", "account: ", "account number: ", "bank account "]), digits(rng.randint(9, 14)))),
        (1, lambda: (rng.choice(["passport ", "passport no. ", "passport number: "]), pick("ABCDEFGHKLMNPRTUVWXYZ", 1) + digits(2) + pick("X0123456789", 6))),
        (1, lambda: (rng.choice(["password=", "passwd=", "pwd=", "secret=", "api_key=", "token="]), word(10, 24))),
        (1, lambda: (rng.choice(["password=", "token=", "secret: "]), hexa(rng.randint(96, 256)))),
        (1, lambda: (rng.choice(["", "key ", "digest "]), hexa(rng.randint(24, 160)))),
        (1, lambda: (rng.choice(["mail ", "write to ", "contact ", "email me: ", ""]), f"{spoken(2)}{rng.choice([' at ', ' (at) ', '[at]', ' [at] '])}{spoken(2)}{rng.choice([' dot ', ' (dot) ', '[dot]', ' [dot] '])}{rng.choice(_ENDINGS)}")),
        (1, lambda: (rng.choice(["", "mail "]), f"{spoken(2)}{rng.choice('._')}{spoken(2)} at {spoken(2)} dot {rng.choice([spoken(2) + ' dot ', ''])}{rng.choice(_ENDINGS)}")),
        (0, lambda: ("", f"{rng.choice(sorted(_VERBS))} at {rng.choice(['the', 'a', 'one', spoken(2)])} dot {rng.choice(['on', 'in', 'of', 'that', spoken(2), *_ENDINGS])}")),
        (0, lambda: ("", f"{spoken(2)} at {rng.choice(['the', 'a', 'one', 'ten'])} dot {rng.choice(['on', 'in', 'of', 'that', spoken(2)])}")),
        (0, lambda: (rng.choice(["order ", "page ", "version ", "", "population ", "ISBN ", "build ", "invoice ", "timestamp ", "a distance of ", "over "]), digits(rng.randint(9, 19)))),
        (0, lambda: ("", digits(rng.choice([9, 10, 11, 12, 13, 14, 16, 16, 17, 18, 19])))),
        (0, lambda: ("", digits(rng.randint(12, 19)))),
        (0, lambda: (rng.choice(["fixed in commit ", "sha256: ", "md5 ", "sha1=", "revision ", "commit: ", "checksum ", "hash "]), hexa(rng.choice([32, 40, 64])))),
        (0, lambda: (rng.choice(["", "id ", "uuid: ", "request "]), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}")),
        (0, lambda: ("", "-".join(spoken(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))) + "-" + digits(rng.choice([1, 4])))),
        (0, lambda: ("", "_".join(spoken(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))) + rng.choice(["_v", "_", ""]) + digits(1))),
        (0, lambda: ("", ("_".join(spoken(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))) + digits(1)).upper())),
        (0, lambda: ("", spoken(rng.randint(6, 9)).capitalize() + digits(1))),
        (0, lambda: ("", rng.choice(["IMG_", "DSC_", "backup-", "scan_"]) + f"20{digits(6)}" + rng.choice("_-") + digits(6))),
        (0, lambda: ("", rng.choice(letters) * rng.randint(14, 24) + digits(1))),
        (0, lambda: ("", spoken(rng.randint(6, 9)) + digits(1))),
        (0, lambda: (rng.choice(["token: ", "secret: ", "password: ", "auth: ", "the secret key: "]), rng.choice([spoken(rng.randint(2, 4)), "required", "optional", "nothing", "disabled"]))),
        (0, lambda: (rng.choice(["token = ", "key = ", "auth = ", "session = "]), f"{spoken(2)}({spoken(2)})")),
        (0, lambda: ("", spoken(rng.randint(7, 12)).upper())),
        (0, lambda: ("", pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.randint(1, 3)) * rng.randint(8, 14))),
        (0, lambda: ("", spoken(rng.randint(7, 12)).upper())),
        (0, lambda: (rng.choice(["page ", "version ", "", "order ", "see page ", "sector ", "the years "]), f"{digits(3)} {digits(3)} {digits(3)}")),
        (0, lambda: (rng.choice(["order ", "version ", "page ", "score "]), f"{digits(3)}{rng.choice('.-')}{digits(3)}{rng.choice('.-')}{digits(3)}")),
        (0, lambda: (rng.choice(["", "the years ", "over "]), f"1{digits(3)} 1{digits(3)} 1{digits(3)}")),
    ])
    label, (lead, body) = made[0], made[1]()
    head = " ".join(rng.choice((word(), spoken(2))) for _ in range(rng.randint(0, 5)))
    head += " " if head else ""
    tail = rng.choice([" ", '" ', ". ", " was found ", " people ", ""])
    text = head + lead + body + tail + (word() if tail else "")
    found = [c for c in candidates(text) if c[1] < len(head + lead + body) and c[2] > len(head + lead)]
    return (text, *rng.choice(found), label) if found else None


@functools.lru_cache(maxsize=2)
def model(examples: int = EXAMPLES, seed: int = 0, precision: float = 0.99) -> tuple[Boosted, dict[str, float]]:
    """The trees and a threshold for each added kind: the least at which held-out examples above it reach ``precision``, at least a half."""
    rng = random.Random(seed)
    made = [e for e in (_example(rng) for _ in range(examples)) if e]
    x = np.array([describe(t, g, a, b) for t, g, a, b, _ in made])
    y = np.array([e[4] for e in made], float)
    kind = np.array([GENERATORS[e[1]][0] for e in made])
    fit = np.arange(len(y)) % 3 != 0
    trees = Boosted().fit(x[fit], y[fit]).calibrate(x[~fit], y[~fit])
    p, thresholds = trees.probability(x[~fit]), {}
    for k in KINDS[len(BASE) :]:
        own, truth = p[kind[~fit] == k], y[~fit][kind[~fit] == k]
        order = np.argsort(-own)
        share = np.cumsum(truth[order]) / np.arange(1, len(own) + 1)
        good = own[order][share >= precision]
        thresholds[k] = max(0.5, float(good.min())) if len(good) else 1.1
    return trees, thresholds


def find(batch: list[str], trees: Boosted, thresholds: dict[str, float]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; each list by kind as in KINDS, then start."""
    base = [base_spans(t) for t in batch]
    found = [(i, *c) for i, t in enumerate(batch) for c in candidates(t)]
    added: dict[int, list[tuple[float, Span]]] = {}
    if found:
        p = trees.probability(np.array([describe(batch[i], g, a, b) for i, g, a, b in found]))
        for (i, g, a, b), q in zip(found, p.tolist(), strict=True):
            if q >= thresholds[GENERATORS[g][0]]:
                added.setdefault(i, []).append((q, (GENERATORS[g][0], a, b)))
    out = []
    for i, own in enumerate(base):
        taken = list(own)
        for _, s in sorted(added.get(i, []), key=lambda z: (z[1][1] - z[1][2], -z[0], z[1][1], z[1][0])):
            if all(s[2] <= t[1] or s[1] >= t[2] for t in taken):
                taken.append(s)
        out.append((own, sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones together, replaced by [KIND] of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """RESULT's columns for each row of ``docs``."""
    ship(docs.sparkSession)
    trees, thresholds = model(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = find(batch.column(1).to_pylist(), trees, thresholds)
            counts = {f"n_{k}": [sum(s[0] == k for s in every) for _, every in spans] for k in KINDS}  # all of a base kind are base spans
            yield batch_of(RESULT, doc_id=batch.column(0), **counts, base_sha256=[hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in spans], spans=[joined(s) for _, s in spans], n_spans=[len(s) for _, s in spans])

    return texts(docs).mapInArrow(run, ddl(RESULT))


def redact(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind, ``n_chars`` (where there) counted anew; other columns stay."""
    ship(docs.sparkSession)
    trees, thresholds = model(examples)
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            old = batch.column(at).to_pylist()
            new = [None if t is None else redacted(t, s) for t, (_, s) in zip(old, find([t or "" for t in old], trees, thresholds), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, type=batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t is None else len(t) for t, n in zip(new, batch.column(k).to_pylist(), strict=True)], type=batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents")).select(*[f.name for f in RESULT])
