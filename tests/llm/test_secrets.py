import hashlib
import random
import re

from lakesnap.llm import secrets

KEYWORD = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def assigns(t):
    """The assign pattern by hand."""
    out, k = [], 0
    low = "".join(c.lower() if c.isascii() else c for c in t)
    while k < len(t):
        word = next((w for w in KEYWORD if low.startswith(w, k)), None)
        end = None
        if word:
            p = k + len(word)
            p += p < len(t) and t[p] in "\"'"
            while p < len(t) and t[p] == " ":
                p += 1
            if p < len(t) and t[p] in ":=":
                p += 1
                while p < len(t) and t[p] == " ":
                    p += 1
                p += p < len(t) and t[p] in "\"'"
                q = p
                while q < len(t) and t[q] in VALUE:
                    q += 1
                end = q if q > p else None
                if end and q - p >= 12:
                    out.append((k, 0, q))
        k = end or k + 1
    return out


def base(t):
    runs = lambda chars, least, kind, start="": [(m.start(), kind, m.end()) for m in re.finditer(f"{start}[{chars}]+", t) if m.end() - m.start() >= least]
    return sorted(assigns(t) + runs("A-Z0-9", 18, 1, "AKIA") + runs("0-9a-f", 16, 2))


def test_base_spans_equal_the_rules():
    rnd = random.Random(1)
    parts = ["password", "PassWD", "secret", "to", "token", "api_key", "APIkey", "api", "=", ": ", ":", " ", "'", '"', "AKIA", "AKIAIOSFODNN7", "EXAMPLE", "deadbeef", "0123456789abcdef", "é", "\U0001f600", "ſecret", "K", "x", "\n", "Zx9+/_.=-", "abcdefghijkl"]
    for _ in range(4000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert secrets.spans(t)[0] == base(t), t


def test_novel_strings_near_sensitive_words():
    key = "q7Zt9LmX2vKp8RwYb4NcD6fGh1Js"
    said = f'client.auth(bearer "{key}")'
    assert [(a, k) for a, k, _ in secrets.spans(said)[1]] == [(said.index(key), 3)]
    for plain in (f"the word {key} alone", "auth getElementByIdentifierConfiguration", "auth AAAAAAAAAAAAAAAAAAAAAAAA1"):
        assert secrets.spans(plain)[1] == []
    n = secrets.Novelty()
    assert n.bits("def f(): return", key) > 5 > 3 > n.bits("configuration parameter", "configuration_parameter_configuration")


def test_repeated_keys_are_reported_at_each_place():
    key = "q7Zt9LmX2vKp8RwYb4NcD6fGh1Js"
    line = f"bearer {key}\n"
    for t in (f"bearer {key} ... bearer {key}", f"bearer {key} " + "plain words " * 70 + f"bearer {key}", line * 500, f"bearer {key} and {key}Tail9", f'password = "{key}" and bearer {key}'):
        assert key in t and key not in secrets.redacted(t), t
    assert secrets.spans(f"bearer {key}, {key}")[1] == [(7, 3, 35), (37, 3, 65)]
    for far in range(1024 - 60, 1024 + 60):  # the text around ends within a repetition
        t = f"bearer {key} " + " " * far + f" bearer {key}"
        assert len(secrets.spans(t)[1]) == 2
    assert secrets.beside("abXcdXef", "X", 5, 6) == "abcdef"


def random_key(n, seed):
    return "".join(random.Random(seed).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n - 2)) + "x7"


def test_whole_statements_and_blocks_are_sensitive():
    key, far = "q7Zt9LmX2vKp8RwYb4NcD6fGh1Js", "some plain words that stand between here and there, and then some more"
    body = [random_key(64, k) for k in range(6)] + ["q9Tz+w=="]
    pem = lambda end, kind="": f"-----BEGIN {kind}PRIVATE KEY-----{end}" + end.join(body)
    jwt = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiI4NDkyMDE3NyIsIm5hbWUiOiJKYW5lIFJvZSJ9", "e30", random_key(43, 9)]
    for t in (
        f"token {far} {key}", f"{key} {far} is the bearer", f"api key, {far}: {key}", f"private-key {far} {key}", f"Access Key {far} {key}", f"pass-word {far} {key}",
        f'"auth": {{\n"user": "{far}",\n"id": "{key}"\n}}', f'{{\n"id": "{key}",\n"of": {{"x": 1}},\n"n": "{far}",\n"kind": "secret"\n}}', f'"auth":\n{{\n"n": "{far} }}",\n"id": "{key}"\n}}',
        f'"auth": {{"user": "{far}",\n"id": "{key}"', f"auth:\n  user: {far}\n\n  id: {key}", f"[auth]\nuser is {far}\n\nid is {key}\n[other]\n", f"login(token,\n'{far}',\n'{key}')", f"secret {far} \\\n{key}",
    ):
        assert secrets.redacted(t) == t.replace(key, "<secret>"), t
    for t, parts in ((f"Authorization: Bearer {'.'.join(jwt)}\nx", jwt), (f"bearer {far} ab12Cd34eF56.Gh78iJ90kL.mN12oP34qR", ["ab12Cd34eF56.Gh78iJ90kL.mN12oP34qR"])):
        assert not any(x in secrets.redacted(t) for x in parts), t
    for t in (pem("\n") + "\n-----END PRIVATE KEY-----\nend", pem("\n", "RSA ") + "\n", f'x = "{pem(chr(92) + "n")}{chr(92)}n-----END PRIVATE KEY-----{chr(92)}n"', pem("\r\n") + "\r\n-----END PRIVATE KEY-----"):
        assert not any(x in secrets.redacted(t) for x in body), t
    for t in (f"bearer {far}\nthe word {key}", f"f(auth)\ng({{'far': '{far}', 'x': '{key}'}})", f"[auth]\n[other]\n{far}\nid is {key}", f"auth {{}} {far}\n{key[:8]} {far} {key}"):
        assert secrets.redacted(t) == t, t


def test_ranges_of_long_texts():
    rnd = random.Random(3)
    parts = ["token ", "x ", "{", "}", "[", "]", "(", ")", "\n", "\r\n", "  ", "- ", "-----BEGIN X-----", "-----END X-----", "[s]", ":", ",", "word", "q7Zt9LmX2vKp8RwYb4NcD6fGh1Js", "."]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 30)))
        got = secrets.sensitive_ranges(t)
        assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False)), t
        assert all(any(a <= m.start() and m.end() <= b for a, b in got) for m in secrets.SENSITIVE.finditer(t)), t
        assert all("token" in t[a:b] for a, b in got)
    for t in ("{" * 300_000, "{[(" * 50_000 + "}" * 50_000, "-----BEGIN " * 30_000, "a.b" * 100_000 + " token", "(}" * 100_000 + "token\n" * 50_000):
        secrets.spans("token q7Zt9LmX2vKp8RwYb4NcD6fGh1Js " + t)


def test_rows_and_redaction(spark):
    t = "x password = hunter2hunter2 y deadbeefdeadbeef00"
    rows = [(1, t, 1), (1, t, 1), (2, None, 1), (3, "", 1), (None, "é" + t, 1), (4, "word " * 200_000 + t, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hex int")
    got = secrets.secret_scan(df).collect()
    for (d, text, _), r in zip(rows, got, strict=True):
        want = base(text or "")
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex) == (d, *(sum(k == x for _, k, _ in want) for x in range(3)))
        assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest() and r.spans.startswith(secrets.joined(want))
    assert secrets.secret_scan(df.limit(0)).count() == 0
    masked = [r[0] for r in df.select(secrets.redact_column(df.text)).collect()]
    assert masked[0] == "x <secret> y <secret>" and masked[2] is None and masked[3] == "" and masked[4] == "éx <secret> y <secret>"
