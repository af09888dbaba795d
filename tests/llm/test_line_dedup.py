import hashlib
import random

from colloquy.llm import line_dedup as ld

BLANK = " \t\n\x0b\f\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=20, documents=3):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text)."""
    key = lambda line: line.strip(BLANK).translate(UPPER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= documents and max(holders[key(x)]) != (-1 if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.dedup_lines(df, **kw).collect()), key=str)


def planted(n=150, seed=4):
    rng = random.Random(seed)
    shared = [f"  This LINE number {k} stands in many documents" + "\t" * (k % 3) for k in range(12)]
    rows = []
    for i in range(n):
        lines = [f"own line {i} {k} of some length, nobody else's" for k in range(rng.randrange(6))]
        lines += rng.choices(shared, k=rng.randrange(5)) + ["short", "", "x" * 19, "É" * 20]
        rng.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    return rows


def test_matches_brute_force(spark):
    rows = planted()
    # Hot line within and over documents, text of many words of bitmap, nulls, empties, repeated rows and ids.
    rows += [(200 + k, "the one line that a third of all documents hold\n" * (1 + k % 4)) for k in range(90)]
    rows += [(300, "\n".join(["the one line that a third of all documents hold", f"between {0}"] * 400)), (299, "\n".join(f"line {k} of a very long document" if k % 7 else "the one line that a third of all documents hold" for k in range(1000)))]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "\r\n the one line that a third of all documents hold \r\n"), (None, None), (None, "the one line that a third of all documents hold")]
    rows += [rows[3], rows[3], (rows[3][0], "another text\nthe one line that a third of all documents hold\nof the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df.repartition(5)) == brute(rows)


def test_least_length_and_documents(spark):
    rows = [(1, "abcde\nabc"), (2, "ABCDE \nabc"), (3, "zzzzz"), (4, "x" * 20), (5, "x" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, least_length=5, least_documents=2) == brute(rows, 5, 2)
    assert [r[2] for r in found(df)] == [0] * 5


def test_two_documents_do_not_lose_lines_but_three_do(spark):
    line = "exactly twenty chars"
    for n, lost in ((2, [0, 0]), (3, [1, 1, 0])):
        df = spark.createDataFrame([(k, line) for k in range(n)], "doc_id long, text string")
        assert [r[2] for r in found(df)] == lost
    assert len(line) == 20


def test_a_repeated_line_of_one_document_stays(spark):
    df = spark.createDataFrame([(1, "the same line, over and over\n" * 50)], "doc_id long, text string")
    assert found(df)[0][1:3] == (51, 0)


def test_empty_table_and_columns_of_clashing_names(spark):
    schema = "doc_id long, text string, t int, doc string, n_lines string, lost int, `of` int, at int, a int, b int, part int, n_dropped int, which int"
    assert ld.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(k, "a line that all of the three hold", 1, "d", "mine", 2, 3, 4, 5, 6, 7, 8, 9) for k in range(3)]
    out = ld.dedup_lines(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_lines_, r.n_dropped_, r.t) for r in out] == [("", "mine", 1, 1, 1), ("", "mine", 1, 1, 1), ("a line that all of the three hold", "mine", 1, 0, 1)]


def test_bitmaps_hold_words_that_lose_a_line_only(spark):
    text = "\n".join("a line that all of the three hold" if k in (0, 63, 64, 700) else "" for k in range(701))
    rows = [(1, text), (2, text), (3, text)]
    maps = {r.doc: [(w.word, w.bits) for w in r.lost] for r in ld.bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bits = [(0, 1 - 2**63), (1, 1), (10, 1 << 60)]
    assert maps == {1: bits, 2: bits}


def test_the_query_gives_digests(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in ld.op13_line_dedup(spark, sf_dir).collect())
    assert got == [(i, n, lost, hashlib.sha256(kept.encode()).hexdigest()) for i, n, lost, kept in sorted(brute(docs))]
