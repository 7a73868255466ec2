"""Personal data by base patterns and a semi-Markov conditional random field.

Four patterns give the base spans. Around words with a digit or an @, a semi-Markov CRF scores whole candidate spans
(their shape, digits, checks, the words before them) for each type, and dynamic programming over spans of bounded
length picks boundaries and types together. It adds secrets and entities that the patterns miss; base spans stay.
The field is trained by likelihood on generated sentences, the same on every machine; the regions that it decodes
are independent of each other, since text without digits and @ holds no candidate.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
#: Tokens and characters of the longest span, words around a trigger that its region takes in, and their length.
MOST_TOKENS, MOST_CHARS, AROUND, REACH = 14, 72, 2, 60
#: Characters from which a region is cut at a line end; at twice as many it is at a blank.
MOST_REGION = 4096
#: Words that announce a secret.
CUES = ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "auth")
#: Of the training: generated sentences, passes, step.
SENTENCES, PASSES, STEP = 360, 6, 0.4
#: Log odds that an added span must lead leaving it out by.
MARGIN = 1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda s: "".join(c for c in s if "0" <= c <= "9")
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15],
    }


def bucket(n: int) -> str:
    return next((str(k) for k in (0, 1, 2, 3, 4, 6, 8, 12, 15, 19, 24, 32, 48) if n <= k), "more")


def shape(s: str) -> str:
    """Runs of digits, lower- and upper-case letters as one mark each; the rest as it is."""
    return re.sub(r"(.)\1+", r"\1+", "".join("9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper() else c for c in s))


@lru_cache(maxsize=4096)  # workers outlive a job
def whole_span(s: str) -> tuple[str, ...]:
    """Features of a span that do not depend on its surroundings."""
    digits = [c for c in s if "0" <= c <= "9"]
    solid = "".join(digits)
    groups = re.findall(r"[0-9]+", s)
    out = [f"len={bucket(len(s))}", f"digits={bucket(len(digits))}", f"groups={bucket(len(groups))}"]
    form = shape(s)
    if len(form) <= 12:
        out.append(f"shape={form}")
    if re.fullmatch(r"[A-Za-z0-9]+", s):
        upper, lower = any(c.isupper() for c in s), any(c.islower() for c in s)
        out.append(f"one={'U' * upper}{'l' * lower}{'9' * bool(digits)}:{bucket(len(s))}")
        if re.fullmatch(r"[0-9a-f]+", s) and digits and lower:
            out.append(f"hex={len(s) >= 12}:{len(s) >= 16}")
        if upper and digits and not lower:
            out.append(f"code={len(s) >= 16}")
    if 13 <= len(solid) <= 19 and re.fullmatch(r"[0-9][0-9 -]*", s):
        out.append(f"luhn={luhn(solid)}")
    if re.fullmatch(r"[0-9]+([.][0-9]+){3}", s):
        out.append(f"octets={all(int(g[-4:]) <= 255 for g in groups)}")
    if "@" in s:
        out.append(f"at={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', s))}")
    if s[0] == "+" and len(digits) >= 7:
        out.append(f"plus={bool(re.fullmatch(r'[+][0-9][ ().0-9-]+[0-9]', s))}")
    if re.fullmatch(r"[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}", s):
        out.append("local")
    return tuple(out)


class Region:
    """A stretch of text, its tokens, and the spans that may be entities."""

    def __init__(self, text: str):
        found = [m.span() for m in TOKEN.finditer(text)]
        self.text, self.tokens = text, found
        self.spans: list[tuple[int, int, tuple[str, ...]]] = []  # first token, token after the last, features
        for i, (a, _) in enumerate(found):
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            for j in range(i + 1, min(len(found), i + MOST_TOKENS) + 1):
                b = found[j - 1][1]
                s = text[a:b]
                if b - a > MOST_CHARS or "\n" in s:
                    break
                if text[b - 1].isalnum() and text[b - 1] < "\x80" and TRIGGER.search(s):
                    self.spans.append((i, j, whole_span(s) + self.around(a, b)))

    def around(self, a: int, b: int) -> tuple[str, ...]:
        before, after = self.text[max(0, a - 14) : a].lower(), self.text[b : b + 1]
        cue = next((c for c in CUES if c in before), "")
        sign = before.rstrip(" \"'")[-1:]
        return (f"cue={bool(cue)}:{sign in ('=', ':') and bool(sign)}", f"left={'w' if before[-1:].isalnum() else 'joint' if before[-1:] in ('.', '-', '@', '+', '_') and before else 'free'}", f"right={'w' if after.isalnum() else 'joint' if after in ('-', '@', '_') and after else 'free'}")


class Field:
    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def scores(self, region: Region) -> list[tuple[int, int, tuple[str, ...], list[float]]]:
        w = self.weights
        return [(i, j, f, [w.get((k, "bias"), 0.0) + sum(w.get((k, x), 0.0) for x in f) for k in KINDS]) for i, j, f in region.spans]

    def gradient(self, region: Region, gold: set[tuple[int, int, str]]) -> dict[tuple[str, str], float]:
        """Of the log-likelihood: features of the true spans less those that the field expects."""
        n, scored = len(region.tokens), self.scores(region)
        starts, ends = defaultdict(list), defaultdict(list)
        for x in scored:
            starts[x[0]].append(x)
            ends[x[1]].append(x)
        total = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = total([forward[j - 1], *(forward[i] + s for i, _, _, ss in ends[j] for s in ss)])
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = total([backward[i + 1], *(backward[j] + s for _, j, _, ss in starts[i] for s in ss)])
        out: dict[tuple[str, str], float] = defaultdict(float)
        for i, j, f, ss in scored:
            for k, s in zip(KINDS, ss):
                g = ((i, j, k) in gold) - math.exp(forward[i] + s + backward[j] - forward[n])
                if abs(g) > 1e-6:
                    for x in ("bias", *f):
                        out[k, x] += g
        return out

    def decode(self, region: Region) -> list[tuple[int, int, str]]:
        """The best spans, as offsets into the region."""
        n, ends = len(region.tokens), defaultdict(list)
        for i, j, _, ss in self.scores(region):
            best = max(range(len(KINDS)), key=ss.__getitem__)
            if ss[best] > MARGIN:
                ends[j].append((i, ss[best], KINDS[best]))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j], back[j] = top[j - 1], None
            for i, s, k in ends[j]:
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if back[j]:
                i, k = back[j]
                out.append((region.tokens[i][0], region.tokens[j - 1][1], k))
                j = i
            else:
                j -= 1
        return out[::-1]


def sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated training sentence and its entities."""
    word = lambda: "".join(r.choice("aeionrstlmd") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + r.choice("abcdef") + r.choice("0123456789")

    def card() -> str:
        body = num(15)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    entity = {
        "email": lambda: ("", f"{word()}{r.choice(['', '.', '_'])}{r.choice(['', num(2), word()])}".rstrip("._") + f"@{word()}.{r.choice(['com', 'org', 'example.com', 'net'])}", ""),
        "ip": lambda: ("", ".".join(str(r.randint(0, 255)) for _ in range(4)), ""),
        "card": lambda: ("", card(), ""),
        "phone": lambda: ("", r.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]), ""),
        "secret": lambda: r.choice([
            ("", "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(18)) + num(2), ""),
            (f"{r.choice(CUES)}=", hexa(r.randint(10, 40)), ""),
            (f"{r.choice(CUES)} = \"", hexa(r.randint(16, 40)), "\""),
            (f"{r.choice(CUES)}: ", hexa(r.randint(12, 32)), ""),
        ]),
    }
    plain = [word, lambda: f"{num(1)}.{num(1)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: num(r.randint(1, 8)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: word() + num(2), lambda: f"@{word()}", lambda: f"{num(5)}.{num(3)}.{num(3)}.{num(1)}", lambda: f"{r.choice(CUES)} {word()}", lambda: f"1{num(13)}", lambda: f"{num(1)}{num(3)},{num(3)}", lambda: word().upper() + num(1), lambda: f"{num(1)} - {num(2)} - {num(1)}"]
    text, gold = "", []
    for _ in range(r.randint(4, 9)):
        if r.random() < 0.3:
            kind = r.choice(KINDS)
            left, s, right = entity[kind]()
            gold.append((len(text) + len(left), len(text) + len(left) + len(s), kind))
            text += left + s + right
        else:
            text += r.choice([word, r.choice(plain)])()
        text += r.choice([" ", " ", " ", ", ", ". "])
    return text, gold


@cache
def trained() -> Field:
    r, field = random.Random(5), Field()
    examples = []
    for _ in range(SENTENCES):
        text, gold = sentence(r)
        region = Region(text)
        at = {t[0]: i for i, t in enumerate(region.tokens)}
        end = {t[1]: i + 1 for i, t in enumerate(region.tokens)}
        examples.append((region, {(at[a], end[b], k) for a, b, k in gold if a in at and b in end}))
    for k in KINDS:
        field.weights[k, "bias"] = -3.0
    seen: dict[tuple[str, str], float] = defaultdict(lambda: 1e-6)
    for _ in range(PASSES):
        r.shuffle(examples)
        for region, gold in examples:
            for x, g in field.gradient(region, gold).items():
                seen[x] += g * g
                field.weights[x] += STEP * g / math.sqrt(seen[x])
    return field


def triggered(text: str) -> Iterator[tuple[int, int]]:
    """The regions around words with a digit or an @: AROUND words, and REACH characters, on each side."""
    begin = end = None
    m = TRIGGER.search(text)
    while m:
        a, b = m.start(), m.end()
        for _ in range(AROUND + 1):
            low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            a = max(text.rfind(" ", low, max(low, a - 1)) + 1, low)
            b = x if (x := text.find(" ", b + 1, high)) >= 0 else high
        if end is not None and a <= end:
            end = b
            # no span holds a line end; a stretch without any is cut at a blank
            if end - begin > MOST_REGION and (cut := max(text.rfind("\n", begin, end), begin) if end - begin <= 2 * MOST_REGION else text.rfind(" ", begin, end)) > begin:
                yield begin, cut
                begin = cut
        else:
            if end is not None:
                yield begin, end
            begin, end = a, b
        m = TRIGGER.search(text, m.end())
    if end is not None:
        yield begin, end


def find(text: str, field: Field) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str]]]:
    """Base spans, and all spans (first place, place after the last, kind) by kind and place."""
    if not TRIGGER.search(text):
        return {k: [] for k in BASE}, []
    base = base_spans(text)
    taken = sorted(s for k in BASE for s in base[k])
    every = [(a, b, k) for k in BASE for a, b in base[k]]
    for begin, end in triggered(text):
        for a, b, k in field.decode(Region(text[begin:end])):
            if not any(x < begin + b and begin + a < y for x, y in taken):
                every.append((begin + a, begin + b, k))
    return base, sorted(every, key=lambda s: (KINDS.index(s[2]), s[0]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of docs.

    Places are code points, ends exclusive. A null text counts as empty. Repeated rows each get their row; a null id
    stays null. Very long texts are searched in regions around triggers; of labellings that score the same the one found
    first by the decoder's order is taken; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = trained()
        for b in batches:
            counts, digests, spans, added = [], [], [], []
            for text in b.column(1).to_pylist():
                base, every = find(text, field)
                counts.append([len(base[k]) for k in BASE])
                listed = joined([(x, y, k) for k in BASE for x, y in base[k]])
                digests.append(hashlib.sha256(listed.encode()).hexdigest())
                spans.append(joined(every))
                added.append(len(every) - sum(counts[-1]))
            arrays = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"n_{k} long" for k in BASE], "base_sha256 string", "spans string", "n_added long"]))
