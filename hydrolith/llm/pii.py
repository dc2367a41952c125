"""Personal data by a semi-Markov conditional random field beside base rules.

The base rules are exact patterns. The field looks at the text around digits,
at signs and spelled-out addresses: every run of up to ``LONGEST`` tokens is a
candidate, whole-span features score it for each kind, and dynamic programming
chooses boundaries and kinds together. It adds spans that no base span of the
text touches. Its weights are fitted by conditional likelihood on made-up
sentences, so they depend on no corpus and are the same everywhere.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 20
#: Characters that the field reads on either side of a trigger, and how many more
#: at most to the next white space.
AROUND, FURTHER = 48, 64
#: Log-odds by which a span must beat the best reading without it.
MARGIN = 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starting only where a number starts gives the same matches in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base rules by kind, then start; end exclusive."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# The field: tokens, candidates, features.

HEX = frozenset("0123456789abcdefABCDEF")
#: Groups of an IPv6 address are one token each.
TOKEN = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{1,4}(?=:[0-9a-fA-F])|(?<=:)[0-9a-fA-F]{1,4}(?![0-9A-Za-z])|[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
SPACE = re.compile(r"\s")
TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]|\sat\s\w+\sdot\s", re.IGNORECASE)
#: Every text that has a trigger has this (Arrow's white space is ASCII's).
MAYBE = r"(?s)[0-9@]|[\[({].?at.?[\])}]|dot"
AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
SHAPES = {
    "email": re.compile(rf"[\w.%+-]+{AT}[\w-]+(?:{DOT}[\w-]+)+", re.IGNORECASE),
    "ip": re.compile(r"(?:[0-9]{1,3}(?:\.|\s?[\[(]\.[\])]\s?)){3}[0-9]{1,3}|(?:[0-9a-f]{1,4}:){3,7}:?[0-9a-f]{1,4}", re.IGNORECASE),
    "card": re.compile(r"[0-9]{4}([ .\-/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19}"),
    "phone": re.compile(r"(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3}"),
}
#: Words that announce a kind.
CUES = {
    "email": {"mail", "email", "write", "contact", "courriel", "correo", "schreib"},
    "ip": {"ip", "host", "server", "address", "adresse", "login", "from"},
    "card": {"card", "visa", "credit", "karte", "carte", "tarjeta", "paid"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "appel", "llame", "whatsapp"},
}
#: Words whose numbers are no personal data.
PLAIN = {"version", "isbn", "page", "pages", "chapter", "order", "no", "in", "since", "year", "room", "section", "total", "eur", "usd"}
#: What follows a span that has been cut too early.
GOES_ON = re.compile(r"(?:\s?[\[({]?\s?(?:dot|\.)\s?[\])}]?\s?|:|[ -])(?:[0-9]|[a-z]{2,4}\b)", re.IGNORECASE)
#: What comes before a span that begins too late.
BEGAN = re.compile(r"(?:\+|\b00)[0-9]{1,3}[ .-]?\Z")
NAMES = ["bias", "shape", "luhn", "digits", "cue", "plain", "glued", "spaced", "tokens", "quad", "groups", "dashed", "led", "goes_on", "began"]
SIZE = len(NAMES) * len(KINDS)


def features(kind: str, span: str, before: list[str], ahead: str, after: str, tokens: int) -> np.ndarray:
    """Features of a whole candidate: ``before`` is the words to its left,
    ``ahead`` some text before it and ``after`` some behind it."""
    left, right = ahead[-1:], after[:1]
    digits = "".join(c for c in span if "0" <= c <= "9")
    words = {w.lower() for w in before}
    lo, hi = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}[kind]
    x = np.zeros(SIZE)
    x[KINDS.index(kind) * len(NAMES) :][: len(NAMES)] = (
        1.0,
        float(bool(SHAPES[kind].fullmatch(span))),
        float(len(digits) >= 13 and len(digits) <= 19 and luhn(digits)),
        float(lo <= len(digits) <= hi),
        float(bool(words & CUES[kind])),
        float(bool(words & PLAIN)),
        float(left.isalnum() or right.isalnum() or left in "@.-/:#$€" and left != "" or right in "@%€/" and right != ""),
        sum(c.isspace() for c in span) / 4,
        tokens / LONGEST,
        float(all(int(p) <= 255 for p in re.findall(r"[0-9]+", span)[:8] if len(p) < 9)),
        float(len(re.findall(r"[0-9]+", span)) in (3, 4)),
        float("-" in span),
        float(span[0] in "(0+"),
        float(bool(GOES_ON.match(after))),
        float(bool(BEGAN.search(ahead))),
    )
    return x


def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, np.ndarray]]]:
    """Tokens and candidates (first token, past the last, kind, features). Only
    candidates of the right shape, or nearly, are listed; all else is plain."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    # How many signs or words of an address, and how many digits, come before each token.
    ats, digits = [0], [0]
    for a, b in tokens:
        t = text[a:b]
        ats.append(ats[-1] + (t == "@" or t.lower() == "at"))
        digits.append(digits[-1] + sum("0" <= c <= "9" for c in t))
    out = []
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        opens = first in "(+" or first in HEX
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            b = tokens[j - 1][1]
            if "\n" in text[tokens[j - 2][1] if j - i > 1 else a : b]:
                break
            address, number = ats[j] > ats[i], opens and text[b - 1] in HEX and digits[j] > digits[i]
            if not (address or number):
                continue
            span = text[a:b]
            near = j - i <= 8 and first.isdigit() and span[-1].isdigit() and sum(c.isdigit() for c in span) >= 6
            for kind in KINDS:
                if (address if kind == "email" else number) and (kind != "email" and near or SHAPES[kind].fullmatch(span)):
                    before = [text[p:q] for p, q in tokens[max(0, i - 3) : i]]
                    out.append((i, j, kind, features(kind, span, before, text[max(0, a - 6) : a], text[b : b + 12], j - i)))
    return tokens, out


def log_sum(a: float, b: float) -> float:
    return b if a == -np.inf else a if b == -np.inf else max(a, b) + np.log1p(np.exp(-abs(a - b)))


def marginals(n: int, edges: list[tuple[int, int, float]]) -> tuple[float, np.ndarray]:
    """Log partition over segmentations of n tokens, where a token alone may be
    plain (score 0), and the probability of each candidate."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    outof: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(edges):
        into[j].append(k)
        outof[i].append(k)
    f, g = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    f[0] = g[n] = 0.0
    for j in range(1, n + 1):
        f[j] = f[j - 1]
        for k in into[j]:
            f[j] = log_sum(f[j], f[edges[k][0]] + edges[k][2])
    for i in range(n - 1, -1, -1):
        g[i] = g[i + 1]
        for k in outof[i]:
            g[i] = log_sum(g[i], g[edges[k][1]] + edges[k][2])
    return f[n], np.array([np.exp(f[i] + s + g[j] - f[n]) for i, j, s in edges])


def best(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Indices of the candidates of the best segmentation."""
    value, back = [0.0] * (n + 1), [-1] * (n + 1)
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(edges):
        into[j].append(k)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in into[j]:
            if value[edges[k][0]] + edges[k][2] > value[j]:
                value[j], back[j] = value[edges[k][0]] + edges[k][2], k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(back[j])
            j = edges[back[j]][0]
    return out[::-1]


def made_up(seed: int) -> tuple[str, list[Span]]:
    """A sentence with up to two entities, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ter", "in", "lo", "de", "sti", "on", "um", "ra"]) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    at, dot = r.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", ".")])
    good = {
        "email": lambda: word() + r.choice(["", "." + word(), num(2)]) + at + word() + dot + r.choice(["com", "org", "example" + dot + "net"]),
        "ip": lambda: r.choice([".", "[.]", "."]).join(str(r.randint(0, 255)) for _ in range(4)) if r.random() < 0.8 else ":".join(f"{r.randint(1, 65535):x}" for _ in range(8)),
        "card": card,
        "phone": lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(4)}"]),
    }
    bad = [
        lambda: r.choice(["version ", "v"]) + ".".join(str(r.randint(0, 20)) for _ in range(3)), lambda: f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", lambda: f"{r.randint(1, 99)}:{num(2)}",
        lambda: f"order {num(r.randint(6, 12))}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"page {num(3)} {num(3)}",
        lambda: num(16)[:-1] + "x", lambda: " ".join(num(r.randint(1, 4)) for _ in range(r.randint(2, 6))), lambda: f"{num(4)} - {num(4)}", lambda: f"{word()} at {word()} the {word()}", lambda: f"{num(8)}{word()}{num(6)}",
    ]
    text, spans = " ".join(word() for _ in range(r.randint(1, 4))), []
    for _ in range(r.randint(1, 3)):
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            cue = r.choice(sorted(CUES[kind])) + r.choice([" ", ": "]) if r.random() < 0.4 else ""
            value = good[kind]()
            spans.append((kind, len(text) + 1 + len(cue), len(text) + 1 + len(cue) + len(value)))
            text += " " + cue + value
        else:
            text += " " + r.choice(bad)()
        text += r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 3)))
    return text, spans


@cache
def weights(sentences: int = 800, rounds: int = 12) -> np.ndarray:
    """Fits the field by stochastic steps on its conditional likelihood."""
    data = []
    for seed in range(sentences):
        text, spans = made_up(seed)
        tokens, cand = lattice(text)
        truth = [(kind, a, b) in spans for kind, a, b in ((k, tokens[i][0], tokens[j - 1][1]) for i, j, k, _ in cand)]
        if cand:
            data.append((len(tokens), [(i, j) for i, j, _, _ in cand], np.array([x for *_, x in cand]), np.array(truth, float)))
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-3)
    order = random.Random(0)
    for _ in range(rounds):
        order.shuffle(data)
        for n, place, x, truth in data:
            s = x @ w
            _, p = marginals(n, [(i, j, v) for (i, j), v in zip(place, s.tolist(), strict=True)])
            g = (truth - p) @ x - 0.002 * w
            seen += g * g
            w += 0.3 * g / np.sqrt(seen)
    return w


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches around triggers, apart from each other and in order: each
    reaches ``AROUND`` characters either way and on to the next white space,
    ``FURTHER`` more at most; stretches that meet are one."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1] and b <= out[-1][1]:
            continue
        left = [x.end() for x in SPACE.finditer(text, max(0, a - FURTHER), a)]
        right = SPACE.search(text, b, min(len(text), b + FURTHER))
        a = left[-1] if left else max(0, a - FURTHER)
        b = right.start() if right else min(len(text), b + FURTHER)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, base: list[Span], w: np.ndarray) -> list[Span]:
    """Spans of the field that touch no base span, in order, each once."""
    out = []
    taken, at = sorted((a, b) for _, a, b in base), 0
    for a, b in regions(text):
        tokens, cand = lattice(text[a:b])
        edges = [(i, j, float(x @ w) - MARGIN) for i, j, _, x in cand]
        for k in best(len(tokens), edges):
            i, j, kind, _ = cand[k]
            lo, hi = a + tokens[i][0], a + tokens[j - 1][1]
            while at < len(taken) and taken[at][1] <= lo:
                at += 1
            # Base spans of two kinds may overlap: look on while they can touch.
            if not any(s < hi and e > lo for s, e in takewhile(lambda t: t[0] < hi, taken[max(0, at - len(KINDS)) :])):
                out.append((kind, lo, hi))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


RESULT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
SQL_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
NONE = hashlib.sha256(b"").hexdigest()


def _batches(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[Span], list[Span]]]]]:
    for b in batches:
        text = b.column("text")
        likely = pc.fill_null(pc.match_substring_regex(text, MAYBE, ignore_case=True), False).to_pylist()
        found = []
        for i, yes in enumerate(likely):
            if yes:
                t = text[i].as_py()
                base = base_spans(t)
                found.append((base, added_spans(t, base, w)))
            else:
                found.append(([], []))
        yield b, found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, the hash of the base spans and
    all spans. A row for each row; null and empty texts have none."""
    small_batches(docs.sparkSession)
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _batches(batches, w):
            count = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() if base else NONE for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *count, sha, pa.array([joined(x + y) for x, y in found], pa.string())], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SQL_RESULT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals; of spans that
    overlap, the one that begins first (then the longer) is named."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span masked; other columns unchanged, but
    ``n_chars`` counts the new text where it is a column."""
    small_batches(docs.sparkSession)
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _batches(batches, w):
            text = b.column("text")
            if any(x or y for x, y in found):
                new = pa.array([masked(t.as_py(), x + y) if x or y else t.as_py() for t, (x, y) in zip(text, found, strict=True)], text.type)
                b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), new)
            yield b

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op7_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
