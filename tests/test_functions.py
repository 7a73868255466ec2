from __future__ import annotations

import base64
from datetime import UTC, datetime

import pytest
from quernstone.functions import redact as R
from quernstone.functions.when import parse_when
from quernstone.operators.search import term_query

NOW = datetime(2026, 3, 31, 15, 30, tzinfo=UTC)


@pytest.mark.parametrize(
    ("phrase", "first", "last"),
    [
        ("2026-01-05", "2026-01-05T00:00:00+00:00", "2026-01-05T23:59:59.999000+00:00"),
        ("2026-02", "2026-02-01T00:00:00+00:00", "2026-02-28T23:59:59.999000+00:00"),
        ("2025", "2025-01-01T00:00:00+00:00", "2025-12-31T23:59:59.999000+00:00"),
        ("last 2 days", "2026-03-29T15:30:00+00:00", "2026-03-31T15:30:00+00:00"),
        ("1m", "2026-02-28T15:30:00+00:00", "2026-03-31T15:30:00+00:00"),
        ("yesterday", "2026-03-30T00:00:00+00:00", "2026-03-30T23:59:59.999000+00:00"),
        ("this week", "2026-03-30T00:00:00+00:00", "2026-04-05T23:59:59.999000+00:00"),
        ("last month", "2026-02-01T00:00:00+00:00", "2026-02-28T23:59:59.999000+00:00"),
        ("in july", "2025-07-01T00:00:00+00:00", "2025-07-31T23:59:59.999000+00:00"),
        ("last tuesday", "2026-03-24T00:00:00+00:00", "2026-03-24T23:59:59.999000+00:00"),
        ("tue", "2026-03-31T00:00:00+00:00", "2026-03-31T23:59:59.999000+00:00"),
    ],
)
def test_when(phrase, first, last):
    assert tuple(x.isoformat() for x in parse_when(phrase, NOW)) == (first, last)


@pytest.mark.parametrize("phrase", ["", "soon", "2026-13", "2026-02-30", "1500", "0d", "20000 days", "2026-02-30T10:00"])
def test_when_nothing(phrase):
    assert parse_when(phrase, NOW) is None


SECRETS = {
    "aws": "AK" + "IA" + "ABCDEFGHIJKLMNOP",
    "github": "gh" + "p_" + "a1B2" * 9,
    "slack": "xo" + "xb-" + "0123456789ab",
    "npm": "np" + "m_" + "a1B2" * 9,
    "private-key": "-----BEGIN " + "PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----",
}


def redact(spark, texts):
    rows = R.redacted(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()
    return [(r.masked, [(h.rule, h.type) for h in r.hits or () for _ in range(h.n)]) for r in rows]


def test_redact_providers(spark):
    given = [f"before {SECRETS[k]} after" for k in sorted(SECRETS)]
    found = redact(spark, given)
    for k, (text, hits) in zip(sorted(SECRETS), found):
        assert [h[1] for h in hits] == [k] and SECRETS[k] not in text and text.startswith("before ‹redacted:") and text.endswith("› after")
    assert redact(spark, [t for t, _ in found]) == [(t, []) for t, _ in found]


#: A text, and rule and type of its hits.
CONDITIONS = [
    ('api_token = "q8Zr2Lx9Vw4Tn6Bk"', ("generic-assignment", "generic")), ("apiKey: q8Zr2Lx9Vw4Tn6Bk, x", ("generic-assignment", "generic")), ("password := `q8Zr2Lx9Vw4Tn6Bk`", ("generic-assignment", "generic")), ("Authorization: Bearer q8Zr2Lx9Vw4Tn6BkA1", ("authorization-bearer", "generic")),
    ("monkey = 'q8Zr2Lx9Vw4Tn6Bk'", None), ("token = process.env.TOKEN_VALUE", None), ("token == q8Zr2Lx9Vw4Tn6Bk", None), ("token != q8Zr2Lx9Vw4Tn6Bk", None), ("secret = your-key-goes-here", None), ("key = 1234567890123", None),
    ("postgres://app:q8Zr2Lx9@db/x", ("basic-auth-url", "basic-auth")), ("postgres://app:test@db/x", None), ("id 123e4567-e89b-12d3-a456-426614174000 sha " + "ab12" * 10, None), ("k Zk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x ", ("high-entropy-token", "entropy")),
    ("x\\nZk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x", ("high-entropy-token", "entropy")), ("abcdefghijklmnopqrstuvwxyz0123", None), ("sha256-Zk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x", None), ("req_Zk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x", None), ("", None), (None, None),
]


def test_redact_conditions(spark):
    for (given, want), (text, hits) in zip(CONDITIONS, redact(spark, [t for t, _ in CONDITIONS])):
        assert hits == ([want] if want else []), given
        assert (text == given) == (want is None)
    assert "\\n‹redacted:" in redact(spark, ["x\\nZk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x"])[0][0]


def test_redact_masks_in_rule_order_and_keeps_protected_spans(spark):
    aws = SECRETS["aws"]
    inside = f"data:image/png;base64,{aws}AAAA"
    (text, hits), = redact(spark, [f'token = "{aws}" {inside} \ue000\ue001 {aws} twice {aws}'])
    assert hits == [("aws-access-key-id", "aws")] * 3 and text.count("‹redacted:aws:") == 3 and inside in text and "\ue000\ue001" in text


def test_redact_is_idempotent(spark):
    import random

    r = random.Random(4)
    pieces = [*SECRETS.values(), " ", "\n", "‹redacted:aws:01234567›", "token = ", "'", '"', "‹", "›", "\ue000\ue001", "Bearer ", "Zk9mQ2xR7vT4nW8pL3sB6yH1jD5fG0cAZk9x", "\\", "%41", "漢", "://a:", "@"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    once = [t for t, _ in redact(spark, texts)]
    assert [t for t, _ in redact(spark, once)] == once


def test_no_piece_of_a_secret_survives(spark):
    """Secrets that begin with one another, that stand twice, and that stand inside longer words."""
    import random

    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    minted = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts, secrets = [], []
    for _ in range(120):
        short = minted(17) + "7"
        longer = short + minted(12)
        hub = "gh" + "p_" + minted(36)
        held = [short, longer, hub, hub + minted(20)]
        r.shuffle(held)
        texts.append(" ".join(x if x.startswith("gh") else f'token = "{x}",' for x in held + held[:2]))
        secrets.append(held)
    for (text, hits), held in zip(redact(spark, texts), secrets):
        assert len(hits) == 6
        assert not [x for x in held for i in range(len(x) - 7) if x[i : i + 8] in text]


def test_masks_stand_where_the_match_is(spark):
    aws = SECRETS["aws"]
    (text, hits), (one, _) = redact(spark, [f"{aws}X {aws} Y{aws} {aws}", aws])
    assert text == f"{aws}X {one} Y{aws} {one}" and len(hits) == 2
    (text, hits), = redact(spark, ["abcdefgh password: abcdefgh%Q1z9-abcdefgh"])
    assert text.startswith("abcdefgh password: ‹redacted:generic:") and len(hits) == 1


def test_redact_long_keys_and_names(spark):
    body = "\n".join("QUJD" * 16 for _ in range(200_000))
    texts = ["-----BEGIN " + "PRIVATE KEY-----\n" + body + " end", "data:;base64," + "QUJD" * 10 + "\n" + "QUJD" * 10, "data:image/png" + ";a=b" * 50_000 + ";base64," + "QUJD" * 300, "my_monkey = 'q8Zr2Lx9Vw4Tn6Bk'", "my_key = 'q8Zr2Lx9Vw4Tn6Bk'", "token += 'q8Zr2Lx9Vw4Tn6Bk'"]
    found = redact(spark, texts)
    assert found[0][0].startswith("‹redacted:private-key:") and found[0][0].endswith("› end") and len(found[0][0]) < 60
    assert [len(h) for _, h in found] == [1, 0, 0, 0, 1, 0] and found[2][0] == texts[2]
    assert elide(spark, [texts[2]])[0].startswith("‹elided:image/png:")


def elide(spark, texts):
    return [r.elided for r in R.elided(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()]


def test_elide(spark):
    payload = "iVBORw0KGgo" + base64.b64encode(bytes(600)).decode().rstrip("=")
    plain = base64.b64encode(bytes(range(256)) * 3).decode()
    texts = [f"x data:image/png;base64,{payload} y", f" {payload} ", "A" * 900, f'{{"media_type": "image/webp", "data": "{plain}"}} and {{"type": "base64", "data": "{plain}"}}', f'{{"data": "{plain}"}}', None, "iVBORw0KGgo" + "A" * 3_000_000]
    n = len(plain)
    want = [f"x ‹elided:image/png:{len(payload) + 22} bytes› y", f" ‹elided:image/png:{len(payload)} bytes› ", "A" * 900, f'{{"media_type": "image/webp", "data": "‹elided:image/webp:{n} bytes›"}} and {{"type": "base64", "data": "‹elided:application/octet-stream:{n} bytes›"}}', texts[4], None, "‹elided:image/png:3000011 bytes›"]
    found = elide(spark, texts)
    assert found == want
    assert elide(spark, found) == found


def passage_by_hand(text, terms, most=200, lead=40):
    import re

    if text is None or len(text) <= most:
        return text
    same = lambda w, t: w == t or min(len(w), len(t)) >= 4 and (w.startswith(t) or t.startswith(w))
    found = [(m.start(), m.end(), max((t for t in terms if same(m.group().lower(), t)), key=lambda t: (len(t), t), default=None)) for m in re.finditer(r"‹[^›]*›|\w+", text) if m.group()[0] != "‹"]
    found = [h for h in found if h[2]]
    at, best = 0, None
    for a, _, _ in found:
        low = max(0, min(a - lead, len(text) - most))
        held = [t for x, y, t in found if low <= x and y <= low + most]
        score = (-len(set(held)), -len(held), a)
        if best is None or score < best:
            best, at = score, a
    low = max(0, min(at - lead, len(text) - most))
    high = low + most
    word = lambda i: 0 <= i < len(text) and bool(re.match(r"\w", text[i]))
    if low and word(low - 1):
        while word(low):
            low += 1
    if high < len(text) and word(high):
        while word(high - 1):
            high -= 1
    return re.sub("‹[^›]*$", "", re.sub("^[^‹›]*›", "", text[low:high])).strip(" ")


def test_snippets_by_hand(spark):
    import random

    from quernstone.functions.snippets import dense_snippets

    r = random.Random(11)
    words = ["needle", "needles", "need", "thread", "thr", "Threads", "filler", "é漢字", "a", "‹redacted:aws:01234567›", "x_y"]
    texts = [None, "", "short needle", "needle " * 2000]
    for _ in range(150):
        texts.append("".join(r.choice(words if r.random() < 0.2 else words[6:]) + r.choice([" ", ". ", ", ", "\n"]) for _ in range(r.randrange(5, 200))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for terms in (["needle", "thread"], ["thread", "a", "needle"], ["absent"], []):
        found = {x.k: x.snippet for x in dense_snippets(rows, "k", "t", terms).collect()}
        assert found == {i: passage_by_hand(t, terms) for i, t in enumerate(texts)}


def test_term_query():
    q = term_query("The deployment of the DEPLOYMENT to a_b")
    assert q.all == ("the", "deployment", "of", "to", "a_b") and q.any == ("deployment", "a_b") and q.prefixes == {"deployment"}
