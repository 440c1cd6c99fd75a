"""Secret spans against plain re-implementations; guess costs against exhaustive segmentation."""

import hashlib
import random
import re

from threadlens.llm import secret_scan as S


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "abcd1234", "short", "AKIA",
             "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "x=y", "ſecret", "K", "tokens", "==", "."]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [f"{k}:{a}:{b}" for k, a, b in S.spans(text) if k != "guess"] == base_spans(text), text


def slow_cost(value, ranks):
    """Cheapest segmentation over all substrings, each priced by itself."""
    n = len(value)
    low = "".join(c.lower() if c.isascii() else c for c in value)
    best = [0.0] + [float("inf")] * n

    def prices(a, b):
        s, l = value[a:b], low[a:b]
        out = [sum(map(S.char_cost, s))]
        for w, more in ((l, 0.0), (l.translate(S.LEET), 0.5)):
            if len(l) > 1 and w in ranks:
                out.append(ranks[w] + more + (0.0 if s == l else 0.5))
                break
        if len(l) > 1 and all((x, y) in S.NEAR for x, y in zip(l, l[1:])):
            out.append(S.char_cost(s[0]) + 0.3 * len(l))
        for p in range(1, 5):
            if len(s) >= 2 * p and all(s[i] == s[i - p] for i in range(p, len(s))):
                out.append(sum(map(S.char_cost, s[:p])) + 0.3 + 0.05 * (len(s) - 2 * p))
        if re.fullmatch(r"(19|20)\d\d", s):
            out.append(S.YEAR)
        if re.fullmatch(r"(19|20)\d\d([-/._]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])", s) or \
                re.fullmatch(r"(0[1-9]|[12]\d|3[01])([-/._]?)(0[1-9]|1[0-2])\2(19|20)\d\d", s):
            out.append(S.DAY)
        return min(out)

    for b in range(1, n + 1):
        best[b] = min(best[a] + S.START + prices(a, b) for a in range(b))
    return best[n]


def test_guess_cost_is_the_cheapest_segmentation():
    rng = random.Random(6)
    parts = ["password", "P@ssw0rd", "qwerty", "asdf", "1234", "aaaa", "abab", "xyzxyz", "2024", "2023-01-31", "31.12.1999",
             "Zq", "9", "!", "k7", "dragon", "é"]
    for _ in range(1500):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
        assert abs(S.guess_cost(v) - slow_cost(v, S.RANKS)) < 1e-9, v


def test_weak_and_strong_values():
    assert S.guess_cost("password123") < 10 and S.guess_cost("qwertyuiop") < 10 and S.guess_cost("aaaaaaaaaaaaaaaa") < 10
    assert S.guess_cost("x9$Lq2!vTz7w") > 10
    assert [k for k, *_ in S.spans("pwd: x9$Lq2!vTz7w")] == ["guess"]
    assert S.spans("pwd: password123") == [] and S.spans("my secret is safe with you") == []
    assert len(S.spans("token=" + "a1B2" * 50_000)) >= 1  # long values take linear time


def test_redaction():
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b'
    found = S.spans(text)
    assert S.redact(text, found) == 'a <SECRET>" b' and S.spans(S.redact(text, found)) == []


def test_edges_and_columns(spark):
    schema = "doc_id long, text string, spans string, id int, n_chars long"
    assert S.scan_secrets(spark.createDataFrame([], schema)).count() == 0
    secret = "secret=" + "f3ef4d6b2755a36d7d9c25bd72c4d5f6"
    rows = [(None, None, "a", 1, None), (1, "", "b", 2, 0), (2, secret, "c", 3, 39), (2, secret, "c", 3, 39),
            (3, "x " * 100_000 + secret, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = S.scan_secrets(docs).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 3, 3, 3]
    red = S.redact_documents(docs)
    assert red.columns == docs.columns
    got = {(r.doc_id, r.text, r.n_chars) for r in red.collect()}
    assert (2, "<SECRET>", 8) in got and (None, None, None) in got and (1, "", 0) in got
    assert sum(r.text is not None and r.text.endswith("<SECRET>") for r in red.collect()) == 3


def test_registered_query(spark):
    from threadlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op2_secret_scan"](spark, sf).collect()
    assert len(out) == len(docs) and sum(r.n_assign for r in out) > 5
    for r in out:
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == want


def guesses(text, **kw):
    return [text[a:b] for k, a, b in S.spans(text, **kw) if k == "guess"]


def test_contexts_find_the_value_behind_links_whole():
    key = "Q!x9#Lp2v@Zz"
    for text in (f"Authorization: Bearer {key}", f"my password is {key}", f"secret token: {key}", f"token password: {key}",
                 f"SECRET_KEY = {key}", f"AWS_SECRET_ACCESS_KEY='{key}'", f'{{"Authorization": "Bearer {key}"}}',
                 f"password: is token: {key}", f"password:\t{key}, and more"):
        assert guesses(text) == [key], text
        assert key not in S.redact(text, S.spans(text))
    assert guesses("password: 'correct horse battery staple'") == ["correct horse battery staple"]
    assert guesses('pwd="it is \\"q7\\" Zx9", x') == ['it is \\"q7\\" Zx9']
    assert guesses("password: pÄß9$wörtQx!7 x") == ["pÄß9$wörtQx!7"]
    assert guesses("password: weak token: Q!x9#Lp2v@Zz") == [key]
    assert guesses("the secretary requires x9$Lq2!vTz7w") == [] and guesses("the secret ingredient") == []


def test_many_contexts_take_linear_time():
    for part in ("token ", "token 'a ", 'token "', "password: is ", "token_", "token='", "password=x, "):
        S.spans(part * 40_000)


def test_prose_is_no_secret_by_ranks_of_the_documents(spark):
    prose = "We describe the secret ingredient, password requirements and token classification. Authorization: administrators only. "
    more = "The requirements for administrators: every ingredient of the classification is described in internationalization guides."
    hidden = "password: xqzkvjwpfhgm"
    texts = [prose + more] * 3 + [hidden] * 5 + ["password = internationalization", "token: 'classification-requirements'"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    cheap = {r.key: sorted((c.start, c.end) for c in r.cheap) for r in S.cheap_values(docs).collect()}
    assert set(cheap) == {S.text_key(t) for t in texts if t != hidden}  # copies of a secret are not its price
    assert cheap[S.text_key(texts[-2])] == [(11, 31)]
    red = {r.doc_id: r.text for r in S.redact_documents(docs).collect()}
    assert all(red[i] == texts[i] for i in range(3)) and all("xqz" not in red[i] for i in range(3, 8))
    found = {r.id: [x.kind for x in r.spans] for r in S.scan_secrets(docs).collect()}
    assert all(("guess" in kinds) == (texts[i] == hidden) for i, kinds in found.items())
    assert guesses("password = internationalization") != []  # by the frequent words of passwords alone


def test_contexts_in_names_on_the_next_line_in_brackets_in_sentences_and_in_urls():
    key = "Q!x9#Lp2v&Zz9"
    for text in (f"db_pass={key}", f"PASS: {key}", f"password:\n{key}", f"password =\r\n  {key}", f"password (staging): {key}",
                 f"token [prod] = {key}", f"the password for the admin account is {key}", f"Password for wifi: {key}",
                 f"https://user:{key}@host/x", f"postgres://:{key}@db:5432", f"the secret of our build server was {key}."):
        assert [g.rstrip(".") for g in guesses(text)] == [key], text
        assert key not in S.redact(text, S.spans(text))
    for prose in ("pass the salt: it is needed", "password requirements are strict and long", "bypass=xqzkvjwpfhgm1", "compass: x9$Lq2!vTz7w",
                  "the secret ingredient of the soup is cinnamon", "password:\n\nx9$Lq2!vTz7w", "see https://example.org/a:b@c",
                  "The token was issued by the authority on 2024-01-01", "passage (first): a b"):
        assert guesses(prose) == [], prose


def test_shortest_value_follows_from_the_limit():
    assert S.shortest(10.0) == 7 and guesses("pin token: 9!x", min_guesses=3.0) == ["9!x"]
    rng = random.Random(4)
    for limit in (2.0, 5.0, 10.0, 20.0):
        n = S.shortest(limit) - 1
        assert all(S.guess_cost("".join(rng.choice("!?$%&aB3é") for _ in range(n))) < limit for _ in range(200))


def test_recall_on_planted_values():
    """Random values in every form of context, within prose: at least 0.9 are found whole."""
    rng = random.Random(12)
    alphabet = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#$%&*+-_=?"
    forms = ["password: {}", "password={}", "passwd {}", "db_pass={}", "pwd = '{}'", 'api_key: "{}"', "SECRET_KEY={}", "Authorization: Bearer {}",
             "my password is {}", "the password for the admin account is {}", "password (staging): {}", "password:\n{}", "token -> {}",
             "https://user:{}@host/", '{{"secret": "{}"}}', "export ACCESS_KEY={}", "credentials: {}", "the token of the job was {}"]
    found, n = 0, 0
    for form in forms:
        for _ in range(40):
            value = "".join(rng.choice(alphabet) for _ in range(rng.randint(10, 24))).strip("-_=+*.")
            text = f"Some words stand here. {form.format(value)} and more follows, on its own."
            n += 1
            found += any(value in text[a:b] for _, a, b in S.spans(text))
    assert found / n >= 0.95, found / n
