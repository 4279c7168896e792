import base64
import hashlib
import math
import random
import re
import string

from sparklog.llm import secret_scan as s
from sparklog.llm.queries import op7_secret_scan

from .helpers import SF, no_documents, odd_documents, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def test_query_against_regular_expressions(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    rows = op7_secret_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r["doc_id"]])
        counts = [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, hashlib.sha256(joined(want).encode()).hexdigest()]


def test_fixed_patterns(spark):
    texts = [
        "password: token: abcdefghij", "Api_Key='AbCdEf+/12' x APIKEY = short", "é🎉 secret=\"123456\" passwd:1234567", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA", "x" + "0" * 23 + " " + "abcdef0123" * 3 + "AKIA" + "0" * 24,
        "token=secret=abcdefgh" * 300, "paſſword=1234567 toKen=1234567 toKen=1234567", "secret\n=1234567 secret  :  '1234567'", "a" * 24,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in s.secrets(df, out="x").collect():
        assert [tuple(x) for x in r["x"] if x["kind"] != "random"] == plain_spans(r["text"])


def test_random_tokens_and_written_ones(spark):
    rnd = random.Random(5)
    letters = string.ascii_letters + string.digits
    tokens = [base64.b64encode(rnd.randbytes(24)).decode() for _ in range(40)] + ["".join(rnd.choices(letters, k=32)) for _ in range(40)] + ["".join(rnd.choices(string.ascii_lowercase + string.digits, k=28)) for _ in range(40)]
    written = ["internationalization2024document", "user_id_1234567_customer_table_v2", "/usr/local/lib/python3/site-packages", "2024-01-02T03-04-05-customer-events", "the-quick-brown-fox-jumps-over-13-dogs", "abcdefghijklmnopqrstuvwxyz0123456789", "x1x1x1x1x1x1x1x1x1x1x1x1x1x1"]
    df = spark.createDataFrame([(i, f"é {t} here") for i, t in enumerate(tokens + written)], "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["x"]] for r in s.secrets(df, out="x").collect()}
    assert sum(found[i] == [(2, 3, "random", 2 + len(t))] for i, t in enumerate(tokens)) >= 0.95 * len(tokens)
    assert all(not found[len(tokens) + i] for i in range(len(written)))
    many = spark.createDataFrame([(1, " ".join(tokens + written))], "doc_id long, text string")
    assert len(s.secrets(many, out="x").first()["x"]) >= 0.95 * len(tokens)


def plain_battery(token):
    """p of each test and their combination, the likelihood ratio's logarithm, for one token."""
    token = token.rstrip("=")
    alphabet = next(letters for pattern, letters in s.ENCODINGS if re.search(pattern, token))
    x, n, k = [alphabet.index(c) for c in token], len(token), len(alphabet)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    cells = max(2, min(k, n // 5))
    chi = 0.0
    for j in range(cells):
        inside = [v for v in range(k) if v * cells // k == j]
        seen = sum(v in inside for v in x)
        chi += (seen - n * len(inside) / k) ** 2 / (n * len(inside) / k)
    df = cells - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [v * 2 >= k for v in x]
    a, b = sum(high), n - sum(high)
    expected = 2 * a * b / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    mean = sum(x) / n
    square = sum((v - mean) ** 2 for v in x)
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / square if square else 0
    p = [tail(z) if z > 0 else 0.5, 2 * tail(abs(runs - expected) / math.sqrt(spread)) if spread > 0 else 0.0, 2 * tail(abs(r * math.sqrt(n) + 1 / math.sqrt(n))) if square else 0.0]
    half = -sum(math.log(max(v, 1e-99)) for v in p)
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in token]
    moves = sum(u != v for u, v in zip(kind, kind[1:], strict=False))
    written = sum(math.log(s.IN_CLASS[c]) for c in kind) + math.log(0.25) + moves * math.log(s.LEAVE) + (n - 1 - moves) * math.log(s.STAY)
    return p, min(1.0, math.exp(-half) * (1 + half + half * half / 2)), -n * math.log(k) - written


def plain_random(text, fdr=0.01, reject=0.001):
    taken = [(a, b) for a, _, _, b in plain_spans(text)]
    found = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
        if any(a < m.end() and m.start() < b for a, b in taken) or not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]):
            continue
        tests, battery, log_e = plain_battery(m[0])
        found.append((m.start(), m.end(), min(1.0, math.exp(-log_e) / max(battery, 1e-99)), 3 * min(tests)))
    order = sorted(f[2] for f in found)
    limit = max([p for i, p in enumerate(order, 1) if p * len(order) <= i * fdr], default=-1)
    return [(a, 3, "random", b) for a, b, p, random_p in found if p <= limit and random_p >= reject]


def test_query_against_plain_battery(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    got = {r["doc_id"]: r["spans"] for r in op7_secret_scan(spark, SF).collect()}
    assert got == {doc: joined(sorted(plain_spans(text) + plain_random(text))) for doc, text in docs.items()}


def test_made_texts_against_plain_battery(spark):
    rnd = random.Random(11)
    makers = [
        lambda: base64.b64encode(rnd.randbytes(rnd.randint(12, 40))).decode(), lambda: "".join(rnd.choices(string.ascii_uppercase + "234567", k=rnd.randint(18, 40))), lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.randint(18, 40))),
        lambda: "_".join(rnd.choices(["user", "Table2", "v2", "customer", "id", "backup", "2024", "Report"], k=6)), lambda: f"secret={rnd.randint(10**4, 10**9)}", lambda: "AKIA" + "".join(rnd.choices(string.ascii_uppercase, k=18)),
        lambda: "x" * 30 + "1", lambda: "password=" + "".join(rnd.choices(string.ascii_letters + string.digits, k=24)) + ".abc", lambda: "".join(rnd.choices(string.ascii_letters + string.digits, k=30)) + "_token: 'abcdef1'",
    ]
    texts = ["".join(rnd.choice(makers)() + rnd.choice([" ", "\n", ".", "", "é ", "="]) for _ in range(rnd.randint(1, 12))) for _ in range(250)]
    rows = s.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out="x").collect()
    bad = [(r["text"], [tuple(x) for x in r["x"]]) for r in rows if [tuple(x) for x in r["x"]] != sorted(plain_spans(r["text"]) + plain_random(r["text"]))]
    assert len(bad) <= 1  # the tails are approximations, to seven digits
    assert sum(x["kind"] == "random" for r in rows for x in r["x"]) > 50


def test_columns_of_any_name_stay(spark):
    names = ["found_assign_cut", "found_hex_len", "found_random_end", "found_access_token", "scanned_text", "masked_text", "sorted_p", "FOUND_hex"]
    df = spark.createDataFrame([(1, "token=abcdef1 x", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = s.secrets(df)
    assert found.columns == [*df.columns, "secrets"]
    assert list(found.first())[2:-1] == names


def test_long_texts_are_linear(spark):
    one = "token=abcdef1 " + "0123456789abcdef" * 2 + " " + base64.b64encode(random.Random(1).randbytes(24)).decode() + " "
    df = spark.createDataFrame([(1, one * 6000)], "doc_id long, text string")
    found = s.secrets(df).first()["secrets"]
    assert len(found) == 3 * 6000


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Pandas|Arrow", op7_secret_scan(spark, SF)._jdf.queryExecution().toString())


def test_odd_rows(spark):
    docs = odd_documents(spark, "found_hex string")
    found = s.secrets(docs)
    assert found.columns == [*docs.columns, "secrets"]
    assert all(r["secrets"] == [] and r["found_hex"] == "x" for r in found.collect())
    assert s.secrets(no_documents(spark)).count() == 0
    assert s.secrets(docs.withColumnRenamed("found_hex", "secrets")).columns == docs.columns[:-1] + ["secrets"]
