"""Personal data: base spans against plain code, and what contexts add."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pageframe.llm import privacy

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                yield kind, m.start(), m.end()


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (privacy.KINDS.index(s[0]), s[1])))


def same_as_plain(spark, texts, schema="doc_id long, text string"):
    docs = spark.createDataFrame(list(enumerate(texts)), schema)
    got = {r.doc_id: r for r in privacy.found(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = list(base(text))
        assert got[i].base_sha256 == hashlib.sha256(told(want).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in privacy.KINDS] == [sum(s[0] == k for s in want) for k in privacy.KINDS], text
    return got


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(5)
    odd = [None, "", " ", "@", "a@b", "a@b.c", "x a@b.c_d@e.f y", "a@b.c.d@e.f", "😀 é a.b+c@d-e.f.g 😀 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.2.3.000255", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
           "4111111111111111 4111111111111111", "+1 (743) 555-3824", "+1 2", "+12345678)", "+1234567890123456", "++49 30 1234567-8-", "a+1 555 555 5555@b.c", "1" * 5000, "a" * 20000 + "@", "a." * 9000 + "@b" + ".c" * 9000, "1." * 9000, "1 " * 9000, "+1 " * 3000, "漢字" * 9000 + "1"]
    signs = ["1", "12", "255", "4111111111111111", ".", "@", "+", " ", "-", "(", ")", "a", "B_", "%", "é", "😀", "\n", "x@y.z", "10.0.0.1", "+1 555 1234567"]
    same_as_plain(spark, odd + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(400)])


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.{i % 256}.0.{i % 251} é" for i in range(3000))
    got = same_as_plain(spark, [text])
    assert got[0].spans == told(base(text))


def told_numbers(n, start=0):
    return [f"please call me at +1 (555) 010-{i:04d} today" for i in range(start, start + n)]


def test_contexts_find_unseen_numbers(spark):
    texts = told_numbers(12) + ["please call me at 555 019-7788 today", "my number 555 019-7788 is new", "we sold 555 019-7799 at noon", "meet me at noon", "at 12 or at 13", "write e-mail: jörg@exämple.de now", "no number here"] + [f"write e-mail: a{i}@b.org now" for i in range(9)]
    got = same_as_plain(spark, texts)
    assert got[12].spans == "phone:18:30" and got[12].n_phone == 0
    assert got[13].spans == "phone:10:22"  # found elsewhere by its context
    assert got[14].spans == ""  # the same shape, but no sure context
    assert got[17].spans == "email:14:29"
    assert all(got[i].spans == "" for i in (15, 16, 18))
    assert all(got[i].spans == told(base(texts[i])) for i in range(12))


def test_common_contexts_find_nothing(spark):
    """The same word before the numbers, but before plain words as often."""
    texts = told_numbers(12) + ["please call me at 555 019-7788 today"] + ["please call me at noon today"] * 8 + ["we met me at home"] * 4
    got = same_as_plain(spark, texts)
    assert got[12].spans == ""


def test_second_turn_uses_what_the_first_found(spark):
    first = told_numbers(200) + [f"please call me at 555 0{i}-7788 today" for i in range(10, 30)]
    second = [f"handy: 555 0{i}-7788" for i in range(10, 30)] + ["handy: 555 777-1234"]
    got = same_as_plain(spark, first + second)
    assert got[len(first) + 20].spans == "phone:7:19"


def test_rare_contexts_count_beside_many_values(spark):
    """A context of five values finds a sixth, however many values other contexts hold."""
    many = [". ".join(f"please call me at +1 555 {i:07d} today" for i in range(k, k + 100)) for k in range(0, 10_200, 100)]
    few = [f"handy: +1 777 000000{i}" for i in range(5)] * 3 + ["handy: 777 000-1234"]
    rows = spark.createDataFrame(list(enumerate(many + few)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in privacy.found(rows).collect()}
    assert got[len(many) + len(few) - 1] == "phone:7:19"


def test_odd_rows(spark, odd_docs, no_docs):
    got = privacy.found(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert privacy.found(no_docs).collect() == [] and privacy.redacted(no_docs).collect() == []
    rows = [(1, "a@b.c", "k"), (1, "10.0.0.1", "k"), (None, "a@b.c", "k"), (None, "a@b.c", None), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("spans", F.lit(1)).withColumn("value", F.lit(2)).withColumn("_x0", F.lit(3))
    assert sorted(r.spans for r in privacy.found(docs).collect()) == ["", "email:0:5", "email:0:5", "email:0:5", "ip:0:8"]
    out = privacy.redacted(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text or "", r.key or "", r._x0) for r in out.collect()) == [(0, "<email>", "", 3), (0, "<email>", "k", 3), (1, "<email>", "k", 3), (1, "<ip>", "k", 3), (2, "", "", 3)]


def test_redacted_overlaps(spark):
    text = "é +4111111111111111 x 10.0.0.1 and a@1.2.3.4."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [k for k, _, _ in base(text)] == ["email", "ip", "ip", "card"]
    assert privacy.redacted(docs).first().text == "é +<card> x <ip> and <email>."
