import hashlib
import random
from collections import Counter

from panelwise.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected(texts, min_docs, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    common = {k for k, n in count.items() if n >= min_docs}
    return [(len(lines), [x for x in lines if key(x) not in common]) for lines in split]


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


TEXTS = [
    None, "", "\n", "A line\nB", "a LINE \r\nb\n", "\ta line\x0b\n\n\nÄ", "ä\nB ", "only me", " b", "b \nB", "İ b\nİ B", "B" * 5,
    "x\n" * 30 + "A line", "same\ntext", "same\ntext", "A line\nA line\nA line",
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_report_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for min_docs, min_chars in ((2, 1), (3, 1), (3, 3), (100, 1), (1, 0)):
        got = rows(line_dedup.line_report(df, min_docs=min_docs, min_chars=min_chars))
        want = [(i, n, n - len(kept), digest(kept)) for i, (n, kept) in enumerate(expected(TEXTS, min_docs, min_chars))]
        assert got == sorted(want, key=repr), (min_docs, min_chars)


def test_random_texts(spark):
    chance = random.Random(5)
    words = ["a", " A", "b\t", "", " ", "cookie NOTICE", "Été", "été", "z" * 40]
    texts = ["\n".join(chance.choice([*words, str(chance.random())]) for _ in range(chance.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = rows(line_dedup.line_report(df, min_docs=8))
    assert got == sorted([(i, n, n - len(kept), digest(kept)) for i, (n, kept) in enumerate(expected(texts, 8))], key=repr)


def test_columns_of_any_name_stay_and_null_stays_null(spark):
    names = "doc_id long, text string, row string, lines int, dropped string, d1 long, h1 long, key string, position int, n_lines long"
    df = spark.createDataFrame([(i, t, "r", i, None, 1, 2, "k", 3, 4) for i, t in enumerate(TEXTS)], names)
    got = line_dedup.drop_common_lines(df, min_docs=3)
    assert got.columns == df.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    want = {i: None if t is None else "\n".join(kept) for i, (t, (_, kept)) in enumerate(zip(TEXTS, expected(TEXTS, 3), strict=True))}
    assert kept == want


def test_repeated_rows_ids_and_null_ids(spark):
    data = [(1, "a\nb")] * 3 + [(1, "a\nc"), (None, "a\nb"), (None, None), (2, "A \nd")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(line_dedup.line_report(df, min_docs=5))
    want = [(i, n, n - len(kept), digest(kept)) for (i, _), (n, kept) in zip(data, expected([t for _, t in data], 5), strict=True)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_report(df).count() == 0 and line_dedup.drop_common_lines(df).columns == ["doc_id", "text"]


def test_very_long_text_and_hot_line(spark):
    """A text of 100,000 lines, every second one common, and a line in every document."""
    long_text = "\n".join(f"line {i}" if i % 2 else f"cut {i % 50}" for i in range(100_000))
    texts = [long_text] + ["\n".join(f"cut {j}" for j in range(50)) + f"\nown {i}" for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = rows(line_dedup.line_report(df))
    assert got == sorted([(i, n, n - len(kept), digest(kept)) for i, (n, kept) in enumerate(expected(texts, 10))], key=repr)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.line_report(df)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InArrow", "InPandas"))
