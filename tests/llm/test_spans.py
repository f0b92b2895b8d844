"""PII and secret scans against the plain patterns, run by Python's re."""

import hashlib
import math
import random
import re

import pytest

from corpuskit.llm import pii, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def plain_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def random_texts(bits, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)]


PII_BITS = ["a@b.c", "@", ".", "x_y", "é", "😀", " ", "-", "+1 (202) 555-0147", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.4.5", "256.1.1.1", "+4", "7", "%", "DE89 3704 0044 0532 0130 00", "card ", "378282246310005", "\n"]


def write(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pii_equals_plain_patterns(spark, tmp_path):
    texts = [*random_texts(PII_BITS, 150, 1), None, "", "9" * 30_000, "a" * 30_000 + "@b.cc", "1.1.1.1 " * 2000, "+" + "(" * 20_000]
    rows = {x.doc_id: x for x in pii.op2_pii(spark, write(spark, tmp_path, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = plain_pii(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert rows[i].spans.split(",")[: len(want)] == (want or rows[i].spans.split(",")[:0])


def test_pii_checksums_and_context(spark):
    df = spark.createDataFrame([(1, "my IBAN DE89370400440532013000 and DE88370400440532013000"), (2, "card 378282246310005"), (3, "nr 378282246310005"), (4, "AT61 1904 3002 3457 3201 CODE and é AT611904300234573201 CODE NAME or GB82 WEST 1234 5698 7654 32")], "doc_id long, text string")
    rows = {x.doc_id: x for x in pii.find_pii(df).collect()}
    assert [(s.start, s.end, s.score) for s in rows[1].pii_iban] == [(8, 30, 1.0)]
    assert [(s.start, s.end) for s in rows[4].pii_iban] == [(0, 24), (36, 56), (70, 97)]
    assert len(rows[2].pii_short_card) == 1 and not rows[3].pii_short_card


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cc now +1 202 555 0147!"), (2, None), (3, "plain"), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert got == {1: "é mail <EMAIL> now <PHONE>!", 2: None, 3: "plain", 4: ""}


SECRET = {
    "assign": r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
SECRET_BITS = ["password", "PASSWD", "ſecret", "secret", "toKen", " ", "=", ": ", "'", '"', "abc123xyz", "Zx9", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "api_key", "apikey", "pwd=", "Xk29vLq8Tz", "\n"]


def plain_secrets(text):
    found = []
    for i, (k, p) in enumerate(SECRET.items()):
        for m in re.finditer(p, text or ""):
            if {"assign": k != "assign" or len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[k]:
                found.append((m.start(), i, f"{k}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_texts_of_many_spans_take_linear_time(spark):
    import time

    many = 64_000
    text = " ".join(f"u{i % 1000}@ex.org" for i in range(many))
    mixed = "".join(f"tel +1 (202) 555 {i % 10000:04d} at 10.0.{i % 256}.{i % 200} " for i in range(3000))
    rows = [(1, text, "en", "s", 0), (2, mixed, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    begun = time.time()
    got = {x.doc_id: x for x in pii.find_pii(df).collect()}
    out = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert time.time() - begun < 60
    assert [(x.start, x.end) for x in got[1].pii_email] == [m.span() for m in re.finditer(PLAIN["email"], text)] and len(got[1].pii_email) == many
    assert [(x.start, x.end) for x in got[2].pii_ip] == [m.span() for m in re.finditer(PLAIN["ip"], mixed)]
    assert {x.score for x in got[2].pii_phone} == {1.0}
    assert out[1] == " ".join(["<EMAIL>"] * many) and out[2].count("<PHONE>") == 3000 == out[2].count("<IP>")


def test_secrets_equal_plain_patterns(spark, tmp_path):
    texts = [*random_texts(SECRET_BITS, 300, 2), None, "", "f" * 50_000, "token=" + "a" * 20_000, "password" + " " * 5_000 + "=" + "x" * 9]
    rows = {x.doc_id: x for x in secrets.op7_secrets(spark, write(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_secrets(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(w.startswith(k + ":") for w in want) for k in SECRET]
        assert set(want) <= set(rows[i].spans.split(",")) or not want


@pytest.mark.parametrize("weak, strong", [("password123", "xK9vTq2LzR8w"), ("qwertyuiop", "q7eZt1u8op"), ("19990101", "83920174652"), ("aaaaaaaaaa", "ajcnxeqpwz")])
def test_guess_cost_orders_values(weak, strong):
    assert secrets.guess_cost(weak)[0] < 8 < secrets.guess_cost(strong)[0] or secrets.guess_cost(weak)[0] + 3 < secrets.guess_cost(strong)[0]


def every_part(text, ranks):
    """log10 of the guesses of each way to read a whole text as one part, by the definitions alone."""
    rows = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
    beside = {x + y for r in rows for x, y in zip(r, r[1:])} | {y + x for r in rows for x, y in zip(r, r[1:])}
    low, out = text.lower(), []
    if len(text) >= 3 and low in ranks:
        out.append(math.log10(ranks[low] + 1) + (0.3 if text != low else 0.0))
    if re.fullmatch(r"(19|20)\d\d", text):
        out.append(2.1)
    if re.fullmatch(r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])([-/.]?(0[1-9]|[12]\d|3[01]))?", text):
        out.append(4.0)
    if len(text) >= 3 and len(set(text)) == 1:
        out.append(math.log10((10 if text[0].isdigit() else 26 if text[0].isalpha() else 33) * len(text)))
    if len(text) >= 3 and all(x + y in beside for x, y in zip(low, low[1:])):
        out.append(math.log10(40 * len(text)))
    return out


def least_cost(text, ranks):
    n = len(text)
    least = [0.0] + [math.inf] * n
    for end in range(1, n + 1):
        for at in range(end):
            brute = sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in text[at:end])
            least[end] = min([least[end], least[at] + brute + 0.3, *(least[at] + c + 0.3 for c in every_part(text[at:end], ranks))])
    return least[n]


def test_guess_cost_is_the_minimum():
    r = random.Random(5)
    words = secrets.Dictionary(["passw", "word", "rty2", "zzx"])
    drawn = ["".join(r.choice(["pass", "word", "a", "1", "12", "qwe", "rty", "2001", "zz", "X", "1999-12", "1111", "0", "asdfg", "--", "uiop"]) for _ in range(r.randrange(1, 7))) for _ in range(400)]
    for v in [*drawn, "qwertyuiopassword", "1111111119991231", "a" * 150 + "qwertyuiop" * 9, "", "20011231", "2001-1-1", "PASSWORDpassword"]:
        cost, parts = secrets.guess_cost(v, words)
        assert cost == pytest.approx(least_cost(v, words.rank)), v
        assert [a for a, _, _ in parts] == [0, *(b for _, b, _ in parts[:-1])][: len(parts)] and (not v or parts[-1][1] == len(v))
    assert secrets.guess_cost("qwertyuiopassword")[0] < 3.5 and secrets.guess_cost("1111111119991231")[0] < 6.6


def test_vocabulary_words_are_cheap():
    words = secrets.vocabulary(secrets.default_tokenizer())
    assert len(words.rank) > 10_000 and words.rank["password"] == 1
    assert secrets.guess_cost("mountainwindow", words)[0] < 9.5 < secrets.guess_cost("mountainwindow")[0]


LONG = hashlib.sha512(b"1").hexdigest() * 8
VALUES = [
    ("Authorization: Bearer ", LONG[:1000], " end"),
    ("authorization: BEARER ", LONG[:1000], ""),
    ("x PWD=", "Xk29vLq8TzR4", ";"),
    ("Server=a;Pwd=", "Xk29vLq8TzR4", ";"),
    ("db_pwd=", "Xk29vLq8TzR4" * 40, "\n"),
    ("PassPhrase: ", "Xk29vLq8TzR4", ""),
    ("postgres://" + "u" * 200 + ":", "Xk29vLq8TzR4" * 30, "@host/db"),
]


@pytest.mark.parametrize("before, value, after", VALUES)
def test_whole_values_in_context(spark, before, value, after):
    spans = [x for x in secrets.scan((before + value + after).encode()) if x[0] == "value"]
    assert spans == [("value", len(before), len(before + value), secrets.guess_cost(value)[0])]


def test_words_that_only_end_like_context():
    assert [x for x in secrets.scan(b"xpwd=Xk29vLq8TzR4 forbearer Xk29vLq8TzR4") if x[0] == "value"] == []


def test_long_runs_take_linear_time():
    texts = [b"pwd=" + b"aZ1" * 30_000, b"://" + b"u" * 200_000, b"://u" * 50_000, b"pwd " * 50_000, b"Bearer " + b" " * 200_000]
    assert [sum(x[0] == "value" for x in secrets.scan(t)) for t in texts] == [1, 0, 0, 0, 0]
