import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from halogrid.llm.secrets import ALLOW, CLASSES, WINDOW, redact, secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        c = m[0]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or any(re.search(a, c) for a in ALLOW):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "mixed"
        spans = []
        for i in range(len(c) - WINDOW + 1):
            n = Counter(c[i : i + WINDOW].lower() if kind == "hex" else c[i : i + WINDOW])
            h = -sum(x / WINDOW * math.log2(x / WINDOW) for x in n.values())
            if h >= CLASSES[kind][1] - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + WINDOW
                else:
                    spans.append([i, i + WINDOW])
        more += [(m.start() + s, 3, m.start() + e) for s, e in spans if not any(b[0] <= m.start() + s and b[2] >= m.start() + e for b in base)]
    names = ("assign", "access", "hex", "entropy")
    show = lambda xs: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(xs))
    return (*(sum(b[1] == k for b in base) for k in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more))


def make():
    r = random.Random(1)
    token = lambda n, a: "".join(r.choice(a) for _ in range(n))
    b62, hexa = CLASSES["mixed"][0], "0123456789abcdef"
    rows = [None, "", "password", 'x "PassWord" : "abc12345-more" y', "secret=token:abcdefghijk", "token=short token='longenough1'", "api-key=aaaaaaaaaa apikey = bbbbbbbbbb api_key:cccccccc",
            "AKIAAKIAAKIA0123 AKIAABC AKIA" + "Z9" * 20, "é😀 ñ secret: " + token(30, b62) + " 😀 " + token(40, hexa), "toKen=password=abcdefgh", "ſecret=abcdefghi toKen=abcdefgh12"]
    rows += ["😀" * r.randint(0, 3) + " ".join(r.choice(["the", "ñu", token(r.randint(18, 60), b62), token(r.randint(28, 50), hexa), token(25, hexa.upper()), "key_value_name_12_of_list", "page-2024-01-01-index-of-things", "aB3" * 12, "123e4567-e89b-12d3-a456-426614174000", "password=" + token(9, b62), "x" * 30 + "1"]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    rows += [token(3000, b62) + " a " * 2000 + token(64, hexa)]
    return rows


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(rows)], "doc_id long, text string, spans string, s string").repartition(3)
    got = {x.doc_id: (x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans) for x in secrets(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert got[i] == brute(t), t
    assert sum("entropy" in g[4] for g in got.values()) > 50


def test_redact(spark):
    rows = make()
    df = spark.createDataFrame([(i, t, "l", None if t is None else len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, n_chars long")
    out = {x.doc_id: x for x in redact(df).collect()}
    for i, t in enumerate(rows):
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute(t)[4].split(",") if s]
        if not spans:
            assert out[i].text == t and out[i].n_chars == (None if t is None else len(t))
            continue
        gone = {p for s, e in spans for p in range(s, e)}
        want = "".join("" if p in gone and p - 1 in gone and not any(p == s for s, _ in spans if p - 1 not in gone) else "[SECRET]" if p in gone else c for p, c in enumerate(t))
        assert out[i].text == want and out[i].n_chars == len(want)
    assert redact(df).columns == df.columns


def test_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in secrets(df).select(F.count("*"))._jdf.queryExecution().toString()
    assert secrets(df.limit(0)).collect() == []
