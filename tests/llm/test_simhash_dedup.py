import numpy as np
import xxhash

from colloquy.llm import simhash_dedup as sh


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)]


def texts():
    base = [f"word{i} alpha beta gamma delta w{i * 7} w{i * 11} epsilon zeta {i}" for i in range(30)]
    long = " ".join(f"t{i % 977} u{i % 31}" for i in range(60_000))
    many = base + base[:5] + [b.upper() for b in base[5:8]] + [long, long + " end", None, "", " \t\n", "one", "one", "ÄÖ x"]
    return [(i * 3 + 1, t) for i, t in enumerate(many)] + [(None, "lonely text without id"), (None, base[0])]


def as_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def query(spark, tmp_path, rows, extra=""):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as row", "2 as id", "3 as component_id").write.parquet(f"{path}/documents.parquet")
    return sh.op9_simhash_dedup(spark, path)


def test_matches_brute_force(spark, tmp_path):
    rows = texts()
    assert as_rows(query(spark, tmp_path, rows)) == sorted(brute_components(rows), key=str)


def test_whole_table_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_rows(sh.op9_simhash_dedup(spark, sf_dir)) == sorted(brute_components(rows), key=str)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []


def near_prints(n, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, n // 2, dtype=np.uint64)
    near = values.copy()
    for k in range(3):
        near ^= np.where(rng.random(len(near)) < 0.7, np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64), np.uint64(0))
    return np.unique(np.concatenate([values, near])).view(np.int64)


def brute_links(values):
    v = values.view(np.uint64)
    x = np.bitwise_count(v[:, None] ^ v[None, :])
    i, j = np.nonzero(np.triu(x <= 2, 1))
    return {tuple(sorted((int(values[a]), int(values[b])))) for a, b in zip(i, j, strict=True)}


def components_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_bit_sliced_runs_find_every_pair():
    for seed, n in ((1, 10), (2, 130), (3, 700)):
        values = near_prints(n, seed)
        run = np.sort(np.random.default_rng(seed).integers(0, 3, len(values)))
        i, j = sh.links_in_runs(run, values, np.full(len(values), 2))
        found = {tuple(sorted((int(values[a]), int(values[b])))) for a, b in zip(i, j, strict=True)}
        same = {int(v): int(r) for v, r in zip(values, run, strict=True)}
        assert found == {(a, b) for a, b in brute_links(values) if same[a] == same[b]}


def test_links_with_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 50)
    rng = np.random.default_rng(7)
    hot = rng.integers(0, 2**14, 400, dtype=np.int64) << 20
    values = np.unique(np.concatenate([near_prints(300, 5), hot]))
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = [(r.a, r.b) for r in sh.fingerprint_links(df).collect()]
    assert components_of(found) == components_of(brute_links(values))


def test_one_fingerprint_of_most_rows(spark, tmp_path):
    rows = [(k, None if k % 2 else "") for k in range(4000)] + [(9000 + k, t) for k, (_, t) in enumerate(texts()[:30])] + [(None, None)] * 20
    others = {i: c for i, _, c in brute_components(rows[4000:4030])}
    want = [(i, f"{brute_print(t):016x}", others[i] if t else 0) for i, t in rows]
    assert as_rows(query(spark, tmp_path, rows)) == sorted(want, key=str)


def test_exactly_half_of_the_shingles_is_not_over_half():
    for k in range(40):
        text = f"a{k} b c d"  # two shingles: a bit set in one of them is 0
        first, second = (xxhash.xxh64_intdigest(s, 42) for s in (f"a{k} b c".encode(), b"b c d"))
        assert sh.fingerprint(text) & (2**64 - 1) == first & second


def test_keep_one(spark):
    rows = texts() + [(1, texts()[0][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'fr' as lang", "'s' as source", "1L as n_chars")
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    groups = {(r[2], r[1] if r[2] is None else "") for r in brute_components(rows)}
    assert len(kept.collect()) == len(groups)
    assert sh.keep_one(docs.limit(0)).collect() == []
