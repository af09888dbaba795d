import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

from colloquy.llm import secret_scan as ss

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute_test(value):
    plain = re.sub("[^A-Za-z0-9]", "", value)
    if re.fullmatch("[0-9]*", plain) or len(plain) < 16:
        return None
    kind = "hex" if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", value) else "base32" if re.fullmatch("[A-Z2-7]+=*", value) else "base62" if re.fullmatch("[A-Za-z0-9]+", value) else "base64"
    n = len(plain)
    two, three = ss.ALIKE[kind]
    equal = sum(c * (c - 1) / 2 for c in Counter(plain).values())
    pairs = n * (n - 1) / 2
    uniform = (pairs * two - equal) / math.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two**2))
    group = ["u" if c.isupper() else "l" if c.islower() else "d" for c in plain]
    runs = sum(a != b for a, b in zip(group, group[1:], strict=False))
    changes = (runs - 0.12 * (n - 1)) / math.sqrt(0.12 * 0.88 * (n - 1))
    v = [c in "aeiouyAEIOUY" for c in plain]
    m = sum(v) / n
    serial = (sum(a and b for a, b in zip(v, v[1:], strict=False)) / (n - 1) - m * m) / (m * (1 - m)) if 0 < m < 1 else 0
    z = (uniform + changes + (max(-1, min(1, serial)) + 0.35) * math.sqrt(n)) / math.sqrt(3)
    low = max(x for x in ss.LENGTHS if x <= n)
    p = math.erfc(z / math.sqrt(2)) / 2
    return f"{kind}:{low}", min(ss.MOST_BIN, int(-20 * math.log10(p))) if z > 0 and p else (ss.MOST_BIN if z > 0 else 0)


def brute(rows):
    tests = {k: [(m.start(), m.end(), *t) for m in re.finditer(ss.CANDIDATE, text or "") if (t := brute_test(m[0]))] for k, (_, text) in enumerate(rows)}
    by = defaultdict(Counter)
    for found in tests.values():
        for *_, stratum, b in found:
            by[stratum][b] += 1
    least = {}
    for stratum, bins in by.items():
        total, upto = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            upto += bins[b]
            if 10 ** (-b / 20) <= 0.01 * upto / total:
                least[stratum] = b
    out = []
    for k, (doc, text) in enumerate(rows):
        base = brute_base(text)
        more = [(s, 3, e) for s, e, stratum, b in tests[k] if b >= least.get(stratum, 10**9) and not any(x < e and s < y for x, _, y in base)]
        write = lambda spans: ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        count = Counter(x[1] for x in base)
        out.append((doc, count[0], count[1], count[2], hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + more))))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(ss.op6_secret_scan(spark, sf)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    key = lambda n, abc=string.ascii_letters + string.digits: "".join(rng.choice(abc) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "é😀 password = 'abcdef' token:abc secret=token:abcdefgh Api_Key: xyz.123=="), (4, "AKIAAKIA" + "A" * 15 + " AKIA" + "B" * 16), (4, "AKIA" + "B" * 16)]
    rows += [(5, " ".join(f"password={k:06d}" for k in range(3000))), (6, f"x {key(40)} y {key(64, '0123456789abcdef')} z"), (None, f"the {key(32)}"), (7, "internationalization of words incomprehensibilities thoroughly-documented-identifiers")]
    rows += [(8, key(100_000)), (9, "1234567890123456789012345"), (10, "a" * 30 + " " + "password:" * 30), (11, "PASSWORD=\"QWERTYuiop\" pass" "word='short'")]
    rows += [(100 + k, f"pressurecooking{'abcdefghijkl'[k % 12]}notwithstanding") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'b' as base", "'c' as candidates", "1 as secrets").write.parquet(f"{tmp_path}/documents.parquet")
    found = result(ss.op6_secret_scan(spark, str(tmp_path)))
    assert found == brute(rows)
    spans = {r[0]: r[5] for r in found}
    assert spans[1] == spans[2] == spans[7] == "" and spans[9] == "hex:0:25" and spans[6].startswith("random:2:42") and spans[5].count("assign") == 3000
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert ss.find_secrets(docs.limit(0)).collect() == []
