"""Small document tables: the given one, and odd rows."""

import pytest

ODD = [
    (900001, None),
    (900002, ""),
    (900003, "   \n\t \x0b "),
    (900004, "one"),
    (900005, "one two three"),
    (900006, "one two three four"),
    (900007, "same text here, again and again and again and again"),
    (900008, "same text here, again and again and again and again"),
    (900009, "SAME text here, again and again and again and again"),
    (900010, "é中文 \U0001f600 emoji  wide space no-break"),
    (900011, "a.b@c.de+f@g.hi x@y.z a@b 1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.255"),
    (900012, "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 9)"),
    (900013, "x" * 5000 + "@" + "y" * 5000 + " " + "7" * 5000 + "." * 50 + "1.1.1.1"),
    (900014, "word " * 6000),
    (900015, "line\nline\nline\n\n\n" * 40 + "#*$%&|<>" * 30),
    (900016, "GB82 WEST 1234 5698 7654 32 and token = 0123456789abcdef0123456789abcdef ssn 123-45-6789"),
    (900016, "repeated id"),
    (900016, "repeated id"),
    (None, "no id"),
    (None, None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (i, t, ["en", "de", None][n % 3], ["s0", "s1", None][n % 3], len(t or ""), "x")
        for n, (i, t) in enumerate(ODD)
    ]
    # columns that clash with names the operators use themselves
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string"
    )


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def both(docs, odd_docs):
    return docs.unionByName(odd_docs.drop("fingerprint"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
