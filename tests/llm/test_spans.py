"""Personal data and secrets against plain patterns and brute force."""
import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from math import log2
from pathlib import Path

import pytest

from postsift.llm import pii, secrets

ROOT = Path(__file__).parents[2]
PLAIN_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
PLAIN_SECRETS = [
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
               r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", None),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m) >= 32),
]


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text, rules):
    out = []
    for k, (kind, pattern, ok) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if (ok(m.group()) if ok else len(m.group(2)) >= 8):
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


PII_TEXTS = ["", "a@b.c", "a@b.c_x@y.z", "x@@y.z a.b+c@d-e.f.g.", "@b.c a@ a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.999", "0001.02.3.4",
             "1" * 4000 + ".1.1.1", "9" * 4000, "4111 1111 1111 1111", "4111-1111 1111-1111x", "4111  1111 1111 1111", "+1 (555) 123-4567.",
             "+49 30 1234567+1", "é+44 20 7946 0958é", "a" * 20000, "a" * 20000 + "@", "+1" + "(" * 20000, "1.1.1." * 3000, "日本 a@b.co 日本 1.1.1.1"]


def noise(n, pool, seed):
    r = random.Random(seed)
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_base_pii_is_the_plain_search():
    pool = ["a", "b.", "@", ".", "-", "1", "23", "255", "4111111111111111", " ", "+", "(", ")", "_", "é", "0", "+49 30 "]
    for t in PII_TEXTS + noise(4000, pool, 1) + noise(2000, list("0123456789.+ @a-"), 2):
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == plain(t, PLAIN_PII), t[:200]


def test_checksums():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.routing_sum("021000021") and not pii.routing_sum("021000022") and not pii.routing_sum("0" * 9)
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


def kinds(text):
    return [s[0] for s in pii.find(text)]


def test_added_kinds_need_checksum_or_context():
    assert kinds("pay to IBAN GB82 WEST 1234 5698 7654 32 TODAY") == ["iban"]
    assert kinds("pay to DE89370400440532013000 now") == ["iban"]
    assert kinds("pay to DE89370400440532013001 now") == []
    assert kinds("SSN: 219-09-9999") == ["ssn"] and kinds("part 219-09-9999") == [] and kinds("SSN: 000-12-3456") == []
    assert kinds("bank routing number 021000021") == ["routing"] and kinds("number 021000021") == []
    assert kinds("born on 1980-02-03") == ["date_of_birth"] and kinds("on 1980-02-03") == [] and kinds("born 1980-13-03") == []
    assert kinds("ordinary words, 12 of them, nothing private. The and 1999 for 3.5") == []


def test_ibans_in_a_row():
    be, no, gb = "BE68539007547034", "NO9386011117947", "GB82 WEST 1234 5698 7654 32"
    for ibans in ([be, no], [no, be], [no] * 5, [be, gb, no, "BE68 5390 0754 7034", no], [no, be] * 300):
        text = " ".join(ibans)
        found = [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"]
        assert found == ibans
    assert pii.redact(f"AB12 INVOICE {no} PAID") == "AB12 INVOICE <IBAN> PAID"
    assert pii.redact(f"AB12 CD34 EF56 {be} {no}, x{be} {no}x") == f"AB12 CD34 EF56 <IBAN> <IBAN>, x{be} {no}x"
    assert "iban" not in kinds("AB12 " * 20000)


def test_context_moves_the_score():
    t = "call my phone +1 555 123 4567"
    with_word, without = pii.find(t)[0][3], pii.find("xxxx xx xxxxx +1 555 123 4567")[0][3]
    against = pii.find("isbn +1 555 123 4567")[0][3]
    assert with_word > without > against


def test_redaction():
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("plain") == "plain"
    assert pii.redact("mail a@b.co or 1.2.3.4!") == "mail <EMAIL> or <IP>!"
    t = "+1.2.3.4.5.6.7.8.9"        # phone and ip overlap
    assert pii.redact(t).count("<") == 1 and not re.search("[0-9]", pii.redact(t))


SECRET_TEXTS = ["", "token = abcdefgh", "TOKEN='abcdefg'", "api_key: 'x.y=z/1+2-3_4'", "apikey=abcdefghij", "ſecret=abcdefgh1", "toKen=abcdefgh1",
                "token" + " " * 20000, "secret secret=token=12345678", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "xAKIAAKIA0123456789Z", "f" * 32,
                "f" * 31, "g" + "0a" * 20 + "G", "password==========", "日本token=abcdefgh日本"]


def test_base_secrets_are_the_plain_search():
    pool = ["token", "Secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "deadbeef", "0123456789abcdef", "AKIA", "Z9", "-", ".", "é", "/"]
    for t in SECRET_TEXTS + noise(4000, pool, 3):
        assert [s for s in secrets.find(t) if s[0] in secrets.BASE] == plain(t, PLAIN_SECRETS), t[:200]


def plain_stretches(s, threshold, w):
    out = []
    for i in range(len(s) - w + 1):
        h = -sum(c / w * log2(c / w) for c in Counter(s[i:i + w]).values())
        if h >= threshold - 1e-9 / w:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + w)
            else:
                out.append((i, i + w))
    return out


def test_incremental_entropy_is_the_entropy():
    r = random.Random(4)
    for _ in range(800):
        s = "".join(r.choice("abcdefgh0123456789ABCXYZ+/"[:r.randint(2, 26)]) for _ in range(r.randint(0, 90)))
        for th in (2.0, 3.0, 3.9):
            assert secrets.hot_stretches(s, th) == plain_stretches(s, th, secrets.WINDOW)


def test_entropy_and_allow_list():
    key = "q8Zt3LxVb0RnY7uKe2WmHs5C"
    assert secrets.find(f"use {key} here") == [("entropy", 4, 4 + len(key))]
    assert [s[0] for s in secrets.find("id 9f86d081884c7d659a2f")] == ["entropy"]
    for fine in ("550e8400-e29b-41d4-a716-446655440000", "averylongwordwithoutanyspace", "a-path/with/many/words/in_it",
                 "CamelCaseNameOfSomething12", "1234567890-1234567890", "AbC0dEfGhIjKlMnOpQrStUEXAMPLE"):
        assert secrets.find(f"see {fine} there") == [], fine
    assert secrets.find("sha256: 9f86d081884c7d659a2f") == []
    assert [s[0] for s in secrets.find(f"token={key}")] == ["assign"]      # no second span over a base span


def test_sample_words_allow_their_token_only():
    key = "q7Rt2LmZx9Kd4VbN8sWp3HcY"
    for text in (key, f"id={key}", f"path=/example/v1/{key}", f"your_app={key}", f"a/xxxx/{key}/placeholder"):
        found = [s for s in secrets.find(text) if s[0] == "entropy"]
        assert any(text[a:b] in key and b - a >= 20 or key in text[a:b] for _, a, b in found), text
    for text in (f"EXAMPLE{key}", f"x={key}example", f"/your-{key}/"):
        assert not secrets.find(text), text


def test_allow_list_is_linear():
    r, old = random.Random(6), re.compile(r"(?:[A-Z]?[a-z]{2,}){3,}[0-9]{0,3}")
    new = re.compile(next(p for p in secrets.ALLOWED if p.startswith("(?:[A-Z]?+")))
    for _ in range(20000):
        s = "".join(r.choice(("a", "bc", "def", "Ab", "Cde", "Fghi", "X") if r.random() < 0.97 else "09/") for _ in range(r.randint(5, 14)))
        s = (s + "".join(r.choice("019") for _ in range(r.randint(0, 4))))[:34]
        if len(s) >= 20:
            assert bool(old.fullmatch(s)) == bool(new.fullmatch(s)), s
    code = "import sys; from postsift.llm import secrets; run = 'qwertyuiop' * 1000; print(secrets.find(f'see {run}0a {run}/Z9 {run}12 there'))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60, cwd=ROOT)
    assert done.stdout == "[]\n", done.stderr


@pytest.mark.parametrize("module,texts", [(pii, PII_TEXTS), (secrets, SECRET_TEXTS)])
def test_operators(spark, module, texts):
    rows = [(None if i == 2 else i, t, "s", 1) for i, t in enumerate([None, *texts, texts[-1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int")
    out = module.digests(df).collect()
    assert [r.doc_id for r in out] == [r[0] for r in rows]
    for (_, t, *_), r in zip(rows, out):
        found = module.find(t)
        base = [s for s in found if s[0] in module.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)
        assert [r[f"n_{k}"] for k in module.BASE] == [sum(s[0] == k for s in base) for k in module.BASE]
    assert [[tuple(s)[:3] for s in r.spans] for r in module.spans(df).collect()] == [[s[:3] for s in module.find(r[1])] for r in rows]
    assert module.digests(df.limit(0)).count() == 0


def test_redacted_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in pii.redacted(df).collect()] == [(1, "<EMAIL>"), (1, "<EMAIL>"), (None, None), (2, "")]
