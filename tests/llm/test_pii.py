import hashlib
import re

from pyspark.sql import functions as F

from tickerloom.llm import pii
from tickerloom.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [
        f"{k}:{m.start()}:{m.end()}"
        for k, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if valid(k, m[0])
    ]


def test_query_matches_plain_search(spark, sf_dir, both, monkeypatch):
    monkeypatch.setattr(pii, "table", lambda *_: both)
    rows = QUERIES["op6_pii_spans"](spark, sf_dir).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in both.collect())
    assert len(rows) == len(texts)
    expected = sorted(
        (i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), *(
            sum(s.startswith(k) for s in base_spans(t)) for k in PLAIN))
        for i, t in texts
    )
    found = sorted(
        (str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows
    )
    assert found == expected
    for r in rows:  # the base spans stay among all spans
        listed = [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256


def test_checksums_and_context(spark):
    texts = [
        "GB82 WEST 1234 5698 7654 32",
        "GB82 WEST 1234 5698 7654 33",
        "ssn 123-45-6789",
        "part 123-45-6789",
        "key " + "0f" * 16,
        "hash " + "0f" * 16,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = pii.with_spans(rows).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in found] == [["iban"], [], ["ssn"], [], ["secret"], []]
    assert all(0.6 <= s.score <= 1 for r in found for s in r.spans)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(500))
    row = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [(s.start, s.end) for s in row.spans] == [m.span() for m in re.finditer(PLAIN["email"], text)]


def test_long_runs_stay_fast(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "+1" + "(" * 100_000
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert pii.with_spans(rows).select(F.size("spans")).first()[0] >= 1


def test_stage_masks_and_keeps_columns(spark, both):
    out = pii.pii_stage(spark, both, "")
    assert out.columns == both.columns and out.count() == both.count()
    text = {r.doc_id: r for r in out.collect()}[900012]
    assert text.text.startswith("[CARD], 4111-1111-1111-1112 [PHONE]") and text.n_chars == len(text.text)
    assert {r.doc_id: r.text for r in out.collect()}[900001] is None


def test_empty_table(no_docs):
    assert pii.with_spans(no_docs).count() == 0


def test_one_context_word_serves_a_list(spark):
    numbers = [f"{i}-45-6789" for i in (123, 234, 345, 456)]
    texts = [
        "SSN: " + ", ".join(numbers),
        ", ".join(numbers) + " ssn",
        "token: " + "0f" * 16 + " " + "1e" * 16,
        "ssn " + "." * 36 + "123-45-6789",
        "ssn " + "." * 37 + "123-45-6789",
        "\U0001f600ssn 123-45-6789,\U0001f600234-56-7890" + "." * 60 + "345-67-8901",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.with_spans(rows).collect()}
    for i, text in enumerate(texts):
        expected = []
        for kind in pii.ADDED[1:]:
            for m in re.finditer(kind.pattern, text):
                around = text[max(0, m.start() - 40) : m.start()] + "\n" + text[m.end() : m.end() + 40]
                if re.search(rf"(?i)\b(?:{'|'.join(kind.words)})", around):
                    expected.append(m.span())
        assert found[i] == expected
    assert [len(found[i]) for i in range(6)] == [3, 3, 2, 1, 0, 2]


def test_context_reaches_over_short_matches(spark):
    # card numbers, and the short numbers before them, are matches of one pattern
    card = "4111111111111111"
    texts = ["visa" + "".join(f",{i}" for i in range(10, 21)) + "," + card, "visa" + ",1" * 19 + "," + card, card + ",12" * 9 + " visa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = pii.with_spans(rows).orderBy("doc_id").collect()
    assert [[s.score for s in r.spans] for r in found] == [[1.0], [0.7], [1.0]]
